"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the normalised text sets the borders of chunks, so that a passage shared
by many documents is cut alike in all of them. A chunk that occurs more than once is encoded
once, by the text that owns it (the smallest key); texts with such chunks take the ids over
and encode only what lies between. A border may cut a word: around every join a few words on
both sides are encoded again, and more of them, until the first and the last word of that
stretch agree with what the pieces have. From there on the pieces are what the whole text
gives, since the split into words goes on from the end of a word regardless of what is before.

Everything is keyed by a digest of the text: null or repeated ids do no harm, and copies of
one text are assembled once.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import kernels as K
from codeloom.llm.tables import stored, text_of

#: Bytes under the rolling hash; a border where its low bits are 0, 1,024 bytes apart on
#: average; least and most bytes of a chunk.
WINDOW, BORDER_BITS, LEAST, MOST = 32, 10, 256, 8192
#: Words that a task remembers with their ids.
REMEMBERED = 250_000
#: Stands for the end of a word in the rank form; no simple text holds it.
END = "\x01"
#: Bits of the filter that tells texts without shared chunks; it is broadcast.
FILTER_BITS = 1 << 23
_FIRST, _SECOND = itemgetter(0), itemgetter(1)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _simple_characters() -> tuple[str, str, str]:
    """Letters, digits and others below U+0250 whose lower case is one character and which
    every Unicode version and NFC treat alike; no control or special white space."""
    kinds: dict[str, list[str]] = {"L": [], "N": [], "O": []}
    for code in chain(range(0x21, 0x7F), range(0xA1, 0x250), range(0x2013, 0x2027)):
        c = chr(code)
        kind = unicodedata.category(c)[0]
        if kind in "CZ" or len(c.lower()) != 1 or unicodedata.normalize("NFC", c) != c:
            continue
        kinds[kind if kind in "LN" else "O"].append(c)
    return tuple("".join(map(re.escape, kinds[k])) for k in "LNO")


class WordCodec:
    """The tokenizer taken apart: normalise, split into words, ids of a word, tokens of ids.

    Words are split by this class only where all characters are simple ones; other texts are
    normalised and split by the library. Ids of a word come from the vocabulary's merges in
    rank form, which the tests hold against the library.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Regex, Tokenizer
        from tokenizers.pre_tokenizers import Split

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            described = json.load(f)
        pattern = described["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = Split(Regex(pattern), "removed", invert=True)
        self.specials = [t["content"] for t in described["added_tokens"]]
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        size = self.tokenizer.get_vocab_size()
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        self.names = [self.tokenizer.id_to_token(i) for i in range(size)]
        self.digits = [str(i) for i in range(size)]
        letters, digits, others = _simple_characters()
        self.simple = re.compile(f"[ \\t\\n\\r{letters}{digits}{others}]*").fullmatch
        self.words = re.compile(
            f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[{others}]+").findall
        self.spans = re.compile("[^ ]+").finditer
        self.blank = re.compile(r"[ \t\n\r]{2,}|[\t\n\r]").sub
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = plain + [b for b in range(256) if b not in set(plain)]
        codes = plain + [256 + i for i in range(256 - len(plain))]
        self.shown = {b: chr(c) for b, c in zip(shown, codes)}
        self.known: dict[str, tuple[str, str, bytes]] = {}
        self._rank_form(described["model"], described["model"]["end_of_word_suffix"])

    def _rank_form(self, model: dict, suffix: str) -> None:
        """The same merges over bytes in order of rank, where END stands for the suffix:
        bytes at a word's end come first, then the merges in their order."""
        import tiktoken

        byte_of = {c: b for b, c in self.shown.items()}
        vocabulary, end = model["vocab"], END.encode()

        def raw(token: str) -> bytes:
            ending = token.endswith(suffix)
            body = token[:-len(suffix)] if ending else token
            return bytes(map(byte_of.__getitem__, body)) + (end if ending else b"")

        ranks = {bytes([b]) + end: b for b in range(256)}
        ids = [vocabulary[self.shown[b] + suffix] for b in range(256)]
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            ranks[raw(a) + raw(b)] = len(ids)
            ids.append(vocabulary[a + b])
        for b in range(256):
            ranks[bytes([b])] = len(ids)
            ids.append(vocabulary[self.shown[b]])
        self.ranked = tiktoken.Encoding(
            "words", pat_str=f"[^{END}]+{END}", mergeable_ranks=ranks, special_tokens={})
        self.id_of_rank = np.array(ids)
        self.is_end = np.array([n.endswith(suffix) for n in self.names])

    def is_special(self, text: str) -> bool:
        return "<|" in text and any(s in text for s in self.specials)

    def normalise(self, text: str) -> str:
        if self.simple(text):
            return self.blank(" ", text).lower()
        return self.normalizer.normalize_str(text)

    def word_list(self, text: str) -> list[str]:
        """Words of a normalised text. Of simple texts, what blanks separate: no word of the
        tokenizer holds a blank, so each of these has words of its own."""
        if self.simple(text):
            return text.split()
        return [text[a:b] for _, (a, b) in self.split.pre_tokenize_str(text)]

    def word_spans(self, text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Words of a normalised text with their starts and ends."""
        if not self.simple(text):
            found = [span for _, span in self.split.pre_tokenize_str(text)]
            spans = np.array(found, np.int64).reshape(-1, 2)
            return [text[x:y] for x, y in found], spans[:, 0], spans[:, 1]
        cells = text.split(" ")
        lengths = np.fromiter(map(len, cells), np.int64, len(cells))
        starts = np.cumsum(lengths + 1) - lengths - 1
        full = lengths > 0
        return [c for c in cells if c], starts[full], (starts + lengths)[full]

    def _learn(self, missing: list[str]) -> None:
        """Ids of new words, all in one call of the rank form."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        plain: list[str] = []
        parts: list[str] = []
        upto: list[int] = []
        for w in missing:
            if self.simple(w):
                plain.append(w)
                parts += self.words(w)
                upto.append(len(parts))
            else:
                shown = "".join(map(self.shown.__getitem__, w.encode()))
                self._remember(w, [t.id for t in self.model.tokenize(shown)])
        if plain:
            ranks = self.ranked.encode_ordinary(END.join(parts) + END)
            ids = self.id_of_rank[np.array(ranks, np.int64)]
            ends = (np.flatnonzero(self.is_end[ids]) + 1)[np.array(upto) - 1].tolist()
            ids = ids.tolist()
            for w, a, b in zip(plain, [0, *ends], ends):
                self._remember(w, ids[a:b])

    def _remember(self, word: str, ids: list[int]) -> None:
        self.known[word] = (
            " ".join([self.digits[i] for i in ids]), " ".join([self.names[i] for i in ids]),
            np.array(ids, self.kind).tobytes())

    def entries(self, words: list[str]) -> list[tuple[str, str, bytes]]:
        """(ids, tokens, ids as bytes) of each word; the first two joined by blanks."""
        known = self.known
        try:
            return [known[w] for w in words]
        except KeyError:
            self._learn(list(set(words).difference(known)))
        # what was known may have been forgotten for the new words
        return [self.known[w] if w in self.known else self._again(w) for w in words]

    def _again(self, word: str) -> tuple[str, str, bytes]:
        self._learn([word])
        return self.known[word]

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and where each word's ids end."""
        raw = [e[2] for e in self.entries(words)]
        width = np.dtype(self.kind).itemsize
        ends = np.fromiter(map(len, raw), np.int64, len(raw)) // width
        return np.frombuffer(b"".join(raw), self.kind), np.cumsum(ends)

    def flat(self, text: str) -> list[int]:
        return self.ids(self.word_list(text))[0].tolist()

    def digest(self, ids: list[int]) -> tuple[int, str, str]:
        """n_tokens, digest of the ids and of the decoded text."""
        numbers = " ".join(map(self.digits.__getitem__, ids))
        names = " ".join(map(self.names.__getitem__, ids))
        return (len(ids), hashlib.sha256(numbers.encode()).hexdigest(),
                hashlib.sha256(names.encode()).hexdigest())

    def digest_text(self, text: str) -> tuple[int, str, str]:
        """What ``digest`` gives for the whole text."""
        if self.is_special(text):
            return self.digest(self.encode(text))
        words = text.lower().split() if self.simple(text) else self.word_list(
            self.normalise(text))
        entries = self.entries(words)
        numbers = " ".join(map(_FIRST, entries))
        names = " ".join(map(_SECOND, entries))
        return (numbers.count(" ") + 1 if numbers else 0,
                hashlib.sha256(numbers.encode()).hexdigest(),
                hashlib.sha256(names.encode()).hexdigest())

    def encode(self, text: str) -> list[int]:
        if self.is_special(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.flat(self.normalise(text))


def codec(path: str) -> WordCodec:
    return K.per_process(f"codec {path}", lambda: WordCodec(path))


def borders(texts: list[bytes]) -> list[list[int]]:
    """Chunk borders of each text, 0 and its length included."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    out: list[list[int]] = []
    for first, end, block, inner in K.blocks(data, offsets):
        at = np.arange(WINDOW, len(block), dtype=np.int64)
        hashes = K.Hashes(block).of(at - WINDOW, at)
        found = at[(hashes >> np.uint64(64 - BORDER_BITS)) == 0]
        found = found[(block[found] & 0xC0) != 0x80]
        for row in range(end - first):
            a, b = int(inner[row]), int(inner[row + 1])
            own = found[np.searchsorted(found, a + WINDOW):np.searchsorted(found, b)]
            out.append(_spaced(own.tolist(), a, b, block))
    return out


def _spaced(found: list[int], a: int, b: int, block: np.ndarray) -> list[int]:
    """Borders at least LEAST and at most MOST bytes apart, where characters begin."""
    cuts = [a]
    for p in [*found, b]:
        while p - cuts[-1] > MOST:
            q = cuts[-1] + MOST
            while block[q] & 0xC0 == 0x80:
                q -= 1
            cuts.append(q)
        if p == b or p - cuts[-1] >= LEAST:
            cuts.append(p)
    return [c - a for c in cuts] if b > a else [0]


def _texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of stretches of a batch."""
    data, offsets = K.text_array(batch.column(name))
    for first, end, block, inner in K.blocks(data, offsets):
        raw = block.tobytes()
        yield first, [raw[inner[i]:inner[i + 1]].decode() for i in range(end - first)]


def _chunk_rows(path: str) -> Callable:
    def scan(batches):
        c = codec(path)
        for batch in batches:
            keys = batch.column("key").to_pylist()
            for first, texts in _texts(batch):
                norm = [b"" if c.is_special(t) else c.normalise(t).encode() for t in texts]
                key, place, digest = [], [], []
                for i, (raw, cuts) in enumerate(zip(norm, borders(norm))):
                    for k in range(len(cuts) - 1):
                        key.append(keys[first + i])
                        place.append(k)
                        digest.append(hashlib.blake2b(
                            raw[cuts[k]:cuts[k + 1]], digest_size=16).digest())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.binary()), pa.array(place, pa.int32()),
                     pa.array(digest, pa.binary())], ["key", "place", "digest"])
    return scan


def _maybe_shared(bits: bytes) -> Callable[[list[bytes]], np.ndarray]:
    """Whether the filter holds each key."""
    table = np.frombuffer(bits, "<u8")

    def test(keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        at = np.frombuffer(b"".join(k[:4] for k in keys), "<u4") % np.uint32(FILTER_BITS)
        return (table[at >> 6] >> (at & np.uint32(63)).astype(np.uint64)) & np.uint64(1) == 1
    return test


def _filter_bits(keys: DataFrame) -> bytes:
    """A bit for each key, by its first four bytes: FILTER_BITS / 64 numbers at most."""
    little = F.concat(*[F.hex(F.substring("key", p, 1)) for p in (4, 3, 2, 1)])
    number = F.conv(little, 16, 10).cast("long")
    at = number % FILTER_BITS
    words = keys.select(F.shiftright(at, 6).alias("w"), (at % 64).cast("int").alias("b"))
    found = words.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("v")).collect()
    table = np.zeros(FILTER_BITS // 64, np.int64)
    for r in found:
        table[r.w] = r.v
    return table.tobytes()


def _result_batch(ids: pa.Array, key: list | None, results: list[tuple | None]) -> pa.RecordBatch:
    columns = [ids] if ids is not None else []
    names = ["doc_id"] if ids is not None else []
    if key is not None:
        columns.append(pa.array(key, pa.binary()))
        names.append("key")
    kinds = (pa.int64(), pa.string(), pa.string())
    for j, (name, kind) in enumerate(zip(("n_tokens", "ids_sha256", "decoded_sha256"), kinds)):
        columns.append(pa.array([None if r is None else r[j] for r in results], kind))
        names.append(name)
    return pa.RecordBatch.from_arrays(columns, names)


def _encode_free(path: str, bits) -> Callable:
    """Texts without shared chunks are encoded where they are, neighbouring copies once; the
    others get nulls."""
    def run(batches):
        c, test = codec(path), _maybe_shared(bits.value)
        for batch in batches:
            keys = batch.column("key").to_pylist()
            waits = test(keys)
            for first, texts in _texts(batch):
                once: dict[bytes, tuple] = {}
                results = []
                for i, t in enumerate(texts):
                    key = keys[first + i]
                    if not waits[first + i] and key not in once:
                        once[key] = c.digest_text(t)
                    results.append(once.get(key))
                yield _result_batch(batch.column("doc_id").slice(first, len(texts)),
                                    keys[first:first + len(texts)], results)
    return run


def _waiting(bits) -> Callable:
    def run(batches):
        test = _maybe_shared(bits.value)
        for batch in batches:
            yield batch.filter(pa.array(test(batch.column("key").to_pylist())))
    return run


def _pieces(c: WordCodec, text: str) -> list[str]:
    raw = c.normalise(text).encode()
    cuts = borders([raw])[0]
    return [raw[a:b].decode() for a, b in zip(cuts, cuts[1:])]


def _encode_own(path: str) -> Callable:
    """(digest, ids, ends) of the chunks that a text owns: ids of all words and where those of
    each word end."""
    def run(batches):
        c = codec(path)
        for batch in batches:
            owned = batch.column("own").to_pylist()
            for first, texts in _texts(batch):
                digest, ids, ends = [], [], []
                for i, text in enumerate(texts):
                    if not owned[first + i]:
                        continue
                    pieces = _pieces(c, text)
                    for hole in owned[first + i]:
                        flat, upto = c.ids(c.word_list(pieces[hole["place"]]))
                        digest.append(hole["digest"])
                        ids.append(flat.tobytes())
                        ends.append(upto.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digest, pa.binary()), pa.array(ids, pa.binary()),
                     pa.array(ends, pa.binary())], ["digest", "ids", "ends"])
    return run


class _Piece:
    """A stretch of a normalised text from ``at``: starts and ends of its words in the whole
    text, their ids, and where each word's ids end."""

    def __init__(self, c: WordCodec, text: str, at: int, known: tuple[bytes, bytes] | None):
        words, starts, ends = c.word_spans(text)
        self.starts, self.ends, self.end = starts + at, ends + at, at + len(text)
        if known is None:
            self.ids, self.upto = c.ids(words)
        else:
            self.ids = np.frombuffer(known[0], c.kind)
            self.upto = np.frombuffer(known[1], "<u4").astype(np.int64)

    def tokens_before(self, word: int) -> int:
        return int(self.upto[word - 1]) if word else 0


def _join(c: WordCodec, text: str, left: _Piece, right: _Piece) -> None:
    """Add ``right`` to ``left``, encoding the words around the join again until the first and
    the last of them are where the two pieces have them."""
    reach = 2
    while True:
        keep, ahead = max(0, len(left.starts) - reach), min(reach, len(right.starts))
        start = int(left.starts[keep]) if 0 < keep else 0
        whole = ahead == len(right.starts)
        end = right.end if whole else int(right.ends[ahead - 1])
        again = _Piece(c, text[start:end], start, None)
        found = len(again.starts) > 0
        agree_left = keep == 0 or (
            found and again.starts[0] == start and again.ends[0] == left.ends[keep])
        agree_right = whole or (
            found and again.starts[-1] == right.starts[ahead - 1] and again.ends[-1] == end)
        if agree_left and agree_right:
            break
        reach *= 2
    a, b = left.tokens_before(keep), right.tokens_before(ahead)
    left.starts = np.concatenate([left.starts[:keep], again.starts, right.starts[ahead:]])
    left.ends = np.concatenate([left.ends[:keep], again.ends, right.ends[ahead:]])
    left.ids = np.concatenate([left.ids[:a], again.ids, right.ids[b:]])
    left.upto = np.concatenate([
        left.upto[:keep], again.upto + a, right.upto[ahead:] - b + a + len(again.ids)])
    left.end = right.end


def assemble(c: WordCodec, text: str, known: dict[int, tuple[bytes, bytes]]) -> list[int]:
    """Ids of a text; ``known`` has those of shared chunks by place."""
    if c.is_special(text) or not known:
        return c.encode(text)
    chunks = _pieces(c, text)
    norm = "".join(chunks)
    whole_text: _Piece | None = None
    k = 0
    while k < len(chunks):
        stop = k + 1
        if k not in known:
            while stop < len(chunks) and stop not in known:
                stop += 1
        piece = _Piece(c, "".join(chunks[k:stop]), whole_text.end if whole_text else 0, known.get(k))
        if whole_text is None:
            whole_text = piece
        else:
            _join(c, norm, whole_text, piece)
        k = stop
    return whole_text.ids.tolist()


def _assemble_all(path: str) -> Callable:
    def run(batches):
        c = codec(path)
        for batch in batches:
            keys, holes = batch.column("key").to_pylist(), batch.column("holes")
            for first, texts in _texts(batch):
                results = []
                for i, text in enumerate(texts):
                    known = {h["place"]: (h["ids"], h["ends"])
                             for h in holes[first + i].as_py() or ()}
                    results.append(c.digest(assemble(c, text, known)))
                yield _result_batch(None, keys[first:first + len(texts)], results)
    return run


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     tokenizer: str | None = None) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256 (ids joined by blanks),
    decoded_sha256 (the tokenizer's decoding of the ids).

    Chunks are shared if different texts have them. A text that is there many times shares
    nothing with itself: it stays where it is, and neighbouring copies are encoded once.

    ``tokenizer`` is the path of a tokenizer file on every machine. Null ends as the empty
    text, which has no tokens. Ids may be null or repeat; texts that hold the tokenizer's
    special strings are encoded by the library as a whole. An empty table gives no rows.
    """
    path = tokenizer or default_tokenizer()
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.select("doc_id", "text", F.unhex(F.md5("text")).alias("key"))
    id_kind = rows.schema["doc_id"].dataType.simpleString()

    chunks = stored(rows.select("key", "text").mapInArrow(
        _chunk_rows(path), "key binary, place int, digest binary"), "bpe-chunks")
    shared = chunks.groupBy("digest").agg(
        F.min(F.struct("key", "place")).alias("owner"), F.max("key").alias("last")
    ).where("owner.key <> last").drop("last")  # in different texts, not in copies of one
    holes = stored(chunks.distinct().join(shared, "digest").select(
        "key", "place", "digest",
        (F.struct("key", "place") == F.col("owner")).alias("own")), "bpe-holes")
    bits = spark.sparkContext.broadcast(_filter_bits(holes.select("key").distinct()))

    free = stored(rows.mapInArrow(_encode_free(path, bits), f"doc_id {id_kind}, key binary, "
                  "n_tokens long, ids_sha256 string, decoded_sha256 string"), "bpe-first")
    waiting = rows.select("key", "text").mapInArrow(_waiting(bits), "key binary, text string")
    texts = waiting.groupBy("key").agg(F.first("text").alias("text"))
    own = holes.where("own").groupBy("key").agg(
        F.collect_list(F.struct("place", "digest")).alias("own"))
    kept = stored(texts.join(own, "key", "left"), "bpe-texts")
    encoded = stored(kept.where(F.col("own").isNotNull()).select("text", "own").mapInArrow(
        _encode_own(path), "digest binary, ids binary, ends binary"), "bpe-encoded")
    filled = holes.join(encoded, "digest").groupBy("key").agg(
        F.collect_list(F.struct("place", "ids", "ends")).alias("holes"))
    late = kept.select("key", "text").join(filled, "key", "left").mapInArrow(
        _assemble_all(path), "key binary, n_tokens long, ids_sha256 string, decoded_sha256 string")
    done = free.where(F.col("n_tokens").isNotNull()).drop("key")
    rest = free.where(F.col("n_tokens").isNull()).select("doc_id", "key").join(late, "key").drop(
        "key")
    return done.unionByName(rest.select(*done.columns))
