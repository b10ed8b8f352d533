"""Toxicity of texts: a convolutional classifier in numpy.

Words are runs of letters and digits in lower case. Each has two hashed embeddings side by
side, so that a word is taken for another one only if both hashes agree. Filters over one, two
and three neighbouring words are pooled by their maximum over the whole text, and a logistic
unit sums up. The first place of an embedding starts from the word's log-odds in the sample,
which gives the pooling something to choose from. Thresholds are calibrated per language, as
a word-count model tells it from the text.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm import kernels as K
from codeloom.llm.tables import text_of

#: Bounds of the labelled sample: documents with and without the label, characters of each.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 2500, 5000, 16_000
#: Slices in which the sample is ranked before it is ranked as a whole.
SAMPLE_SLICES = 64
BUCKETS, WIDTH, FILTERS, SPANS = 1 << 18, 8, 8, (1, 2, 3)
EPOCHS, BATCH, RATE = 8, 64, 0.05
#: Share of the sample for the thresholds; least documents for one of a language's own.
CALIBRATE, LEAST = 0.25, 150
LANG_BUCKETS = 1 << 16


def held_out(id_col: Column) -> Column:
    number = F.crc32(id_col.cast("string").cast("binary"))
    return F.coalesce(F.pmod(number, F.lit(5)) == 0, F.lit(False))


class Words:
    """Hashed words of the texts of a block."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = data | 32
        letters = ((low >= 97) & (low <= 122)) | ((data >= 48) & (data <= 57)) | (data >= 128)
        starts, ends, self.row = K.words(data, offsets, letters)
        hashes = K.word_hashes(data, starts, ends)
        self.a = (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)
        self.b = ((hashes >> np.uint64(32)) & np.uint64(BUCKETS - 1)).astype(np.int64)
        self.rows = len(offsets) - 1

    def some(self, rows: np.ndarray) -> Words:
        """The same for some rows, in their order."""
        out = Words.__new__(Words)
        bounds = np.searchsorted(self.row, np.arange(self.rows + 1))
        counts = bounds[rows + 1] - bounds[rows]
        at = np.repeat(bounds[rows], counts) + K.ranges(counts)
        out.a, out.b, out.rows = self.a[at], self.b[at], len(rows)
        out.row = np.repeat(np.arange(len(rows)), counts)
        return out


class ToxicityModel:
    """Weights; ``state`` has them as plain values."""

    def __init__(self, state: dict):
        self.__dict__.update(state)

    @property
    def state(self) -> dict:
        return dict(self.__dict__)

    def inputs(self, words: Words) -> np.ndarray:
        return np.concatenate([self.first[words.a], self.second[words.b]], axis=1)

    def _convolved(self, x: np.ndarray, words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Filter values of span k at every start, and the row of each start."""
        span = SPANS[k]
        n = max(len(x) - span + 1, 0)
        value = sum((x[j:j + n] @ self.filters[k][j] for j in range(span)),
                    np.zeros((n, FILTERS), np.float32))
        whole = words.row[:n] == words.row[span - 1:span - 1 + n]
        return value[whole], np.flatnonzero(whole)

    def pooled(self, words: Words, places: bool = False):
        """Pooled features per row, rectified; with ``places`` also where they are from."""
        x = self.inputs(words)
        features = np.zeros((words.rows, FILTERS * len(SPANS)), np.float32)
        found = np.full(features.shape, -1, np.int64)
        for k in range(len(SPANS)):
            value, at = self._convolved(x, words, k)
            if not len(at):
                continue
            rows, first = np.unique(words.row[at], return_index=True)
            most = np.maximum.reduceat(value, first, axis=0)
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            features[rows, cols] = np.maximum(most + self.bias[cols], 0)
            if places:
                ends = np.append(first[1:], len(value))
                for r, s, e in zip(rows, first, ends):
                    found[r, cols] = at[s + value[s:e].argmax(axis=0)]
        found[features <= 0] = -1
        return (features, found, x) if places else features

    def logit(self, words: Words) -> np.ndarray:
        return self.pooled(words) @ self.out + self.offset

    def language(self, words: Words) -> np.ndarray:
        """Index of the likeliest language per row."""
        total = np.zeros((words.rows, max(len(self.langs), 1)))
        for k in range(len(self.langs)):
            total[:, k] = np.bincount(
                words.row, self.lang_weights[k][words.a & (LANG_BUCKETS - 1)], words.rows)
        return total.argmax(axis=1)

    def score(self, words: Words) -> np.ndarray:
        cut = self.thresholds[self.language(words)]
        return 1 / (1 + np.exp(-np.clip(self.logit(words) - cut, -50, 50)))


def _start(words: Words, label: np.ndarray, seed: int) -> dict:
    rng = np.random.default_rng(seed)
    state: dict = {}
    for name, bucket in (("first", words.a), ("second", words.b)):
        pair = np.unique(bucket * words.rows + words.row)
        seen, of = pair // words.rows, label[pair % words.rows]
        toxic = np.bincount(seen, of, BUCKETS)
        clean = np.bincount(seen, 1 - of, BUCKETS)
        odds = np.log((toxic + 0.5) / (label.sum() + 1)) - np.log(
            (clean + 0.5) / ((1 - label).sum() + 1))
        table = np.zeros((BUCKETS, WIDTH), np.float32)
        # only words seen in several texts say something
        often = toxic + clean >= 4
        table[often, 0] = np.clip(odds[often], -2, 4) / 4
        table[often, 1:] = rng.normal(0, 0.05, (int(often.sum()), WIDTH - 1))
        state[name] = table
    state["filters"] = [
        rng.normal(0, 0.2, (s, 2 * WIDTH, FILTERS)).astype(np.float32) for s in SPANS]
    for f in state["filters"]:
        f[0, [0, WIDTH], :] += 0.8
    state["bias"] = np.full(FILTERS * len(SPANS), -0.2, np.float32)
    state["out"] = np.full(FILTERS * len(SPANS), 0.3, np.float32)
    state["offset"] = np.float32(-1.0)
    state["langs"], state["lang_weights"] = [], np.zeros((0, LANG_BUCKETS))
    state["thresholds"] = np.zeros(1)
    return state


def _trained(words: Words, label: np.ndarray, seed: int) -> ToxicityModel:
    """Stochastic steps with adaptive rates on the cross-entropy; both classes weigh alike."""
    model = ToxicityModel(_start(words, label, seed))
    rng = np.random.default_rng(seed + 1)
    weight = np.where(label == 1, 0.5 / max(label.mean(), 1e-6),
                      0.5 / max(1 - label.mean(), 1e-6))
    names = ("first", "second", "bias", "out")
    squares = {n: np.full_like(getattr(model, n), 1e-3) for n in names}
    squares["filters"] = [np.full_like(f, 1e-3) for f in model.filters]
    offset_square = 1e-3
    for epoch in range(EPOCHS):
        rate = RATE / (1 + epoch / 3)
        order = rng.permutation(words.rows)
        for a in range(0, words.rows, BATCH):
            rows = order[a:a + BATCH]
            part = words.some(rows)
            features, found, x = model.pooled(part, places=True)
            p = 1 / (1 + np.exp(-np.clip(features @ model.out + model.offset, -50, 50)))
            d = ((p - label[rows]) * weight[rows] / len(rows)).astype(np.float32)
            grads = {"out": features.T @ d + 1e-4 * model.out}
            back = d[:, None] * model.out[None, :] * (found >= 0)
            grads["bias"] = back.sum(axis=0)
            gx = np.zeros_like(x)
            gf = [np.zeros_like(f) for f in model.filters]
            for k, span in enumerate(SPANS):
                for c in range(FILTERS):
                    col = k * FILTERS + c
                    on = np.flatnonzero(found[:, col] >= 0)
                    at, g = found[on, col], back[on, col][:, None]
                    for j in range(span):
                        gf[k][j, :, c] += (x[at + j] * g).sum(axis=0)
                        np.add.at(gx, at + j, g * model.filters[k][j, :, c][None, :])
            touched = np.flatnonzero(np.abs(gx).sum(axis=1) > 0)
            for name, bucket, cols in (("first", part.a, slice(0, WIDTH)),
                                       ("second", part.b, slice(WIDTH, 2 * WIDTH))):
                ids, inverse = np.unique(bucket[touched], return_inverse=True)
                g = np.zeros((len(ids), WIDTH), np.float32)
                np.add.at(g, inverse, gx[touched][:, cols])
                squares[name][ids] += g * g
                getattr(model, name)[ids] -= rate * g / np.sqrt(squares[name][ids])
            for name in ("out", "bias"):
                squares[name] += grads[name] ** 2
                setattr(model, name,
                        getattr(model, name) - rate * grads[name] / np.sqrt(squares[name]))
            for k in range(len(SPANS)):
                squares["filters"][k] += gf[k] ** 2
                model.filters[k] = model.filters[k] - rate * gf[k] / np.sqrt(
                    squares["filters"][k])
            total = float(d.sum())
            offset_square += total * total
            model.offset = np.float32(model.offset - rate * total / np.sqrt(offset_square))
    return model


def _best_cut(logit: np.ndarray, label: np.ndarray) -> float:
    """Threshold with the greatest F1, in the middle of the gap above it."""
    order = np.argsort(-logit, kind="stable")
    hit = np.cumsum(label[order])
    f1 = 2 * hit / (np.arange(1, len(order) + 1) + max(label.sum(), 1))
    k = int(np.argmax(f1))
    below = logit[order[k + 1]] if k + 1 < len(order) else logit[order[k]] - 1
    return float((logit[order[k]] + below) / 2)


def train(words: Words, label: np.ndarray, langs: list[str | None], seed: int = 5
          ) -> ToxicityModel | None:
    """Model and thresholds from a sample; None if it lacks one of the two classes."""
    if label.sum() == 0 or label.sum() == len(label):
        return None
    rng = np.random.default_rng(seed)
    kept = rng.random(words.rows) < CALIBRATE
    if words.rows < 40 or label[kept].sum() < 5 or label[~kept].sum() < 5:
        learn, check = np.arange(words.rows), np.arange(words.rows)
    else:
        learn, check = np.flatnonzero(~kept), np.flatnonzero(kept)
    model = _trained(words.some(learn), label[learn].astype(np.float64), seed)
    names = sorted({x for x in langs if x is not None})
    weights = np.zeros((len(names), LANG_BUCKETS))
    for k, name in enumerate(names):
        part = words.some(np.flatnonzero(np.array([x == name for x in langs])))
        counts = np.bincount(part.a & (LANG_BUCKETS - 1), minlength=LANG_BUCKETS) + 0.5
        weights[k] = np.log(counts / counts.sum())
    model.langs, model.lang_weights = names, weights.astype(np.float32)
    part = words.some(check)
    logit, lang = model.logit(part), model.language(part)
    everywhere = _best_cut(logit, label[check])
    model.thresholds = np.full(max(len(names), 1), everywhere)
    for k in range(len(names)):
        own = lang == k
        if own.sum() >= LEAST and label[check][own].sum() >= LEAST // 10:
            model.thresholds[k] = _best_cut(logit[own], label[check][own])
    return model


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str,
            label_col: str) -> DataFrame:
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")
                          ).where(F.col("id").isNotNull() & F.col("y").isin(0, 1))
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    present = docs.select(F.col(id_col).alias("id")).distinct().join(known, "id")
    most = F.when(F.col("y") == 1, SAMPLE_TOXIC).otherwise(SAMPLE_CLEAN)

    def first_of(rows: DataFrame, *keys: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("h", "id"))
        return rows.withColumn("place", place).where(
            (F.col("place") <= max(SAMPLE_TOXIC, SAMPLE_CLEAN)) & (F.col("place") <= most))

    # the first of each slice before the first of all, so that the rows that meet in the
    # last task are bounded whatever the number of tasks before it
    named = F.col("id").cast("string")
    hashed = present.select("id", "y", F.xxhash64(named).alias("h"),
                            F.pmod(F.xxhash64(named, F.lit("slice")), SAMPLE_SLICES).alias("s"))
    chosen = first_of(first_of(hashed, "y", "s"), "y").select("id", "y")
    texts = docs.select(F.col(id_col).alias("id"),
                        F.substring(text_of(text_col), 1, SAMPLE_CHARS).alias("text"),
                        F.col(lang_col).cast("string").alias("lang"))
    return texts.join(chosen, "id").orderBy("id", "text")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang", label_col: str = "toxic") -> ToxicityModel | None:
    """Learn from a bounded sample of the labelled documents that are not held out."""
    sample = _sample(docs, labels, id_col, text_col, lang_col, label_col).toArrow()
    if not sample.num_rows:
        return None
    data, offsets = K.text_array(sample.column("text"))
    parts = [Words(block, inner) for _, _, block, inner in K.blocks(data, offsets)]
    words = parts[0]
    shift = np.cumsum([0, *(p.rows for p in parts)])
    words.row = np.concatenate([p.row + s for p, s in zip(parts, shift)])
    words.a, words.b = (np.concatenate([getattr(p, n) for p in parts]) for n in "ab")
    words.rows = int(shift[-1])
    label = np.array(sample.column("y").to_pylist(), np.int64)
    return train(words, label, sample.column("lang").to_pylist())


def _scorer(shared) -> Callable:
    def run(batches):
        model = ToxicityModel(shared.value) if shared.value else None
        for batch in batches:
            data, offsets = K.text_array(batch.column("text"))
            for first, end, block, inner in K.blocks(data, offsets):
                score = model.score(Words(block, inner)) if model else np.zeros(end - first)
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(score),
                     pa.array((score >= 0.5).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"])
    return run


def score_documents(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (score >= 0.5).

    Null counts as the empty text, which has the score of a text without words. Without a
    model (no labels, or of one kind only) every score is 0. An empty table gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model.state if model else None)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"),
        text_of(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        _scorer(shared), f"doc_id {kind}, held_out boolean, score double, predicted int")
