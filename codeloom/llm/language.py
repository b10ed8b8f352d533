"""Language identification by cross-parsing entropy.

For each language a suffix automaton of sample text holds all its substrings. A text is parsed
into phrases, each the longest match that the automaton has from where the last one ended; the
language that needs the fewest bits per letter (phrases times the bits of a place in its
sample, by the length of the text) wins. The automata are dense tables of a fixed size; tasks
walk many stretches of text through all of them in step.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm import kernels as K
from codeloom.llm.tables import text_of

#: Bounds of the labelled sample: documents per language, characters used of each, and
#: characters of a language's automaton.
SAMPLE_DOCS, SAMPLE_CHARS, AUTOMATON = 64, 4000, 16_384
#: Letters with a class of their own; others are one class, everything else is a separator.
CLASSES = 62
#: A phrase ends with its stretch of this many characters.
STRETCH = 2048
#: Bytes of text that a task parses in step.
BLOCK = 1 << 22
UNKNOWN = "und"


def held_out(id_col: Column) -> Column:
    """Documents whose labels are not learnt from."""
    number = F.crc32(id_col.cast("string").cast("binary"))
    return F.coalesce(F.pmod(number, F.lit(3)) == 1, F.lit(False))


def _sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> dict[str, list[str]]:
    """Bounded sample of labelled texts: the documents of a language with the smallest hashes
    of their ids."""
    lettered = F.col(text_col).rlike(r"\p{L}")
    labelled = docs.where(
        F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))
        & lettered)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
    chosen = labelled.select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"),
        F.xxhash64(F.col(id_col).cast("string")).alias("h"),
    ).withColumn("place", place).where(F.col("place") <= SAMPLE_DOCS)
    texts = labelled.select(
        F.col(id_col).alias("i"), F.col(lang_col).cast("string").alias("l"),
        F.substring(text_col, 1, SAMPLE_CHARS).alias("t"))
    rows = chosen.join(texts, (F.col("id") == F.col("i")) & (F.col("lang") == F.col("l")))
    found: dict[str, list[str]] = {}
    picked = rows.select("lang", "place", "t").distinct().orderBy("lang", "place", "t")
    for r in picked.toLocalIterator():
        found.setdefault(r.lang, []).append(r.t)
    return found


def _letters(texts: dict[str, list[str]]) -> str:
    """The most frequent letters of the sample, lower case."""
    counts: dict[str, int] = {}
    for own in texts.values():
        for t in own:
            for c in t.lower():
                if c.isalpha():
                    counts[c] = counts.get(c, 0) + 1
    return "".join(sorted(sorted(counts, key=lambda c: (-counts[c], c))[:CLASSES]))


def _classes(letters: str) -> np.ndarray:
    """Class of every code point: 0 separator, 1 other letter, then the letters."""
    own = {c: i + 2 for i, c in enumerate(letters)}
    table = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            table[code] = own.get(low if len(low) == 1 else c, 1)
    return table


def _coded(text: str, table: np.ndarray) -> np.ndarray:
    """Classes of a text's characters, runs of separators as one."""
    codes = table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    return codes[keep]


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the start."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return nxt


class LanguageModel:
    """Automata of all languages in one table: entry [place of state + class] is the place of
    the next state, or of the start where there is none."""

    def __init__(self, texts: dict[str, list[str]]):
        self.letters = _letters(texts)
        table = _classes(self.letters)
        width = len(self.letters) + 2
        self.langs, samples = [], []
        for lang in sorted(texts):
            codes = np.concatenate([np.append(_coded(t, table), 0) for t in texts[lang]])
            self.langs.append(lang)
            samples.append(codes[:AUTOMATON])
        places, self.starts, at = [], [], 0
        for codes in samples:
            states = suffix_automaton(codes.tolist())
            dense = np.full((len(states), width), at, np.int32)
            for s, moves in enumerate(states):
                for c, t in moves.items():
                    dense[s, c] = at + t * width
            places.append(dense.ravel())
            self.starts.append(at)
            at += len(states) * width
        self.table = np.concatenate(places) if places else np.zeros(0, np.int32)
        self.bits = np.array([log2(len(s) + 1) for s in samples])

    @classmethod
    def of(cls, state: dict) -> LanguageModel:
        """The model from its plain values, as they travel to the tasks."""
        model = cls.__new__(cls)
        model.__dict__.update(state)
        return model

    def phrases(self, stretches: list[np.ndarray]) -> np.ndarray:
        """Phrases of each stretch in each language, [language, stretch]."""
        lengths = np.array([len(s) for s in stretches])
        order = np.argsort(-lengths, kind="stable")
        steps = np.zeros((int(lengths.max(initial=0)), len(stretches)), np.uint8)
        for k, i in enumerate(order):
            steps[:lengths[i], k] = stretches[i]
        alive = np.searchsorted(-lengths[order], -np.arange(len(steps)), "left")
        starts = np.array(self.starts, np.int64)[:, None]
        place = np.repeat(starts, len(stretches), axis=1)
        count = np.zeros(place.shape, np.int32)
        for t in range(len(steps)):
            n = alive[t]
            c = steps[t, :n].astype(np.int64)
            now = self.table[place[:, :n] + c]
            lang, lane = np.nonzero(now == starts)
            if len(lane):
                # the phrase that was under way ends; a class without a match is one by itself
                again = self.table[starts[lang, 0] + c[lane]]
                count[lang, lane] += (place[lang, lane] != starts[lang, 0]).astype(np.int32)
                count[lang, lane] += (again == starts[lang, 0])
                now[lang, lane] = again
            place[:, :n] = now
        count += place != starts
        out = np.zeros_like(count)
        out[:, order] = count
        return out

    def predict(self, texts: list[str], table: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; ties go to the first name."""
        stretches, owner, lengths = [], [], np.zeros(len(texts), np.int64)
        lettered = np.zeros(len(texts), bool)
        for i, text in enumerate(texts):
            codes = _coded(text, table)
            lettered[i] = codes.any()
            if lettered[i] and self.langs:
                lengths[i] = len(codes)
                for a in range(0, len(codes), STRETCH):
                    stretches.append(codes[a:a + STRETCH])
                    owner.append(i)
        names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not stretches:
            return names, score
        counts = np.zeros((len(self.langs), len(texts)))
        per_stretch = self.phrases(stretches)
        for k in range(len(self.langs)):
            counts[k] = np.bincount(owner, per_stretch[k], len(texts))
        cost = counts * self.bits[:, None] / np.maximum(lengths, 1)
        best = np.argmin(cost, axis=0)
        least = cost[best, np.arange(len(texts))]
        if len(self.langs) > 1:
            second = np.partition(cost, 1, axis=0)[1]
            margin = 1 - least / np.maximum(second, 1e-12)
        else:
            margin = np.ones(len(texts))
        for i in np.flatnonzero(lettered):
            names[i], score[i] = self.langs[best[i]], margin[i]
        return names, score


def _predictor(shared, keep: list[str]) -> Callable:
    def run(batches):
        model = LanguageModel.of(shared.value)
        table = K.per_process(
            f"classes {model.letters}", lambda: _classes(model.letters))
        for batch in batches:
            data, offsets = K.text_array(batch.column("text"))
            for first, end, block, inner in K.blocks(data, offsets, BLOCK):
                raw = block.tobytes()
                texts = [raw[inner[i]:inner[i + 1]].decode() for i in range(end - first)]
                names, score = model.predict(texts, table)
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(names, pa.string()),
                     pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])
    return run


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang") -> LanguageModel:
    """Learn from the labelled documents that are not held out. The sample is bounded and
    comes to the driver; the automata have a fixed size."""
    return LanguageModel(_sample(docs, id_col, text_col, lang_col))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    ``und`` with score 0 if the text is null or has no letter, or if no language was learnt.
    The score is how much less the best language needs than the second, as a share; ties go
    to the first name and have score 0. Only the text is looked at. An empty table gives no
    rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vars(model))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"),
        text_of(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        _predictor(shared, ["doc_id", "held_out"]),
        f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def with_language(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The input rows as the struct ``row`` with lang_pred and score; the texts do not move."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        text_of(text_col).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(
        _predictor(shared, ["row"]), f"row {kind}, lang_pred string, score double")
