"""Removal of passages that an earlier document has too, byte by byte.

A byte goes if a 50-byte string over it also starts in a document with a smaller id. Strings
are found in three steps:

1. Of every 31 neighbouring 20-byte strings of a text the one with the smallest hash is an
   anchor, so equal 50-byte strings have an anchor at the same place. Anchors go to fragments
   with a digest of their context, 30 bytes on both sides: all strings over the anchor.
2. Where whole contexts agree, the smallest id keeps its bytes and the others lose them. Most
   shared text ends here, however often it is repeated.
3. Contexts that differ (the ends of passages) are read from the few texts that have them, one
   for each different context, and indexed per fragment: a run-compressed Burrows-Wheeler
   index keeps the suffixes at the ends of its runs with the length of their match; the
   matching statistics of all other positions are streamed from these samples. Suffixes that
   match over 50 bytes or more are one string, which belongs to its smallest id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import kernels as K
from codeloom.llm.tables import key_filter, may_hold, partitions, stored, text_of

#: Bytes of a match, of an anchor, and of its context on each side.
MATCH, ANCHOR = 50, 20
SIDE = MATCH - ANCHOR
BLOCK = 1 << 22
#: Indexes per fragment: contexts of one anchor share an index, which must fit in memory.
INDEXES = 16
_SALT = np.uint64(0xD6E8FEB86659FD93)


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of each ``width`` neighbours, by doubling."""
    pick = np.minimum if least else np.maximum
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[:len(out) - step], out[step:])
        have += step
    return out


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, place in the text, hash, hash of the context) of the anchors of a block."""
    none = np.zeros(0, np.int64)
    n = len(data) - ANCHOR + 1
    if n < SIDE + 1:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    hashes = K.Hashes(data)
    at = np.arange(n)
    value = hashes.of(at, at + ANCHOR)
    rank = (value >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    least = _sliding(rank, SIDE + 1, True)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    least[row[:len(least)] != row[MATCH - 1:MATCH - 1 + len(least)]] = 0
    padded = np.concatenate([np.zeros(SIDE, np.uint32), least, np.zeros(SIDE, np.uint32)])
    place = np.flatnonzero(_sliding(padded, SIDE + 1, False)[:n] == rank)
    owner = row[place]
    a = np.maximum(place - SIDE, offsets[owner])
    b = np.minimum(place + ANCHOR + SIDE, offsets[owner + 1])
    context = K.mix64(hashes.of(a, b) + (place - a).astype(np.uint64) * _SALT)
    return owner, place - offsets[owner], value[place], context


def _fragment(value: np.ndarray, fragments: int) -> np.ndarray:
    return ((value >> np.uint64(48)) % np.uint64(fragments)).astype(np.int64)


_ANCHORS = "fragment int, docs binary, sizes binary, counts binary, places binary, hashes binary, contexts binary"


def _to_fragments(fragments: int) -> Callable:
    """Rows of _ANCHORS: for a stretch of texts, which of them (id, text key, size) have how
    many anchors in the fragment, and these."""
    def run(batches):
        for batch in batches:
            ids = np.stack([batch.column(c).to_numpy(zero_copy_only=False)
                            for c in ("rank", "key")], axis=1).astype("<i8")
            data, offsets = K.text_array(batch.column("text"))
            for first, end, block, inner in K.blocks(data, offsets, BLOCK):
                parts, at = [], 0
                for a, b, small, bounds in K.blocks(block, inner):
                    row, *rest = anchors(small, bounds)
                    parts.append((row + a, *rest))
                row, place, value, context = (
                    np.concatenate([p[k] for p in parts]) for k in range(4))
                part = _fragment(value, fragments)
                order = np.argsort(part, kind="stable")
                part = part[order]
                cuts = np.flatnonzero(np.diff(part, prepend=-1))
                out: list[list] = [[] for _ in range(7)]
                for x, y in zip(cuts, [*cuts[1:], len(part)]):
                    own = order[x:y]
                    rows, counts = np.unique(row[own], return_counts=True)
                    for column, cell in zip(out, (
                            int(part[x]), ids[first + rows].tobytes(),
                            np.diff(inner)[rows].astype("<u4").tobytes(),
                            counts.astype("<u4").tobytes(), place[own].astype("<u4").tobytes(),
                            K.pack48(value[own]), K.pack48(context[own]))):
                        column.append(cell)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int32()), *(pa.array(o, pa.binary()) for o in out[1:])],
                    ["fragment", "docs", "sizes", "counts", "places", "hashes", "contexts"])
    return run


def _cells(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _per_document(docs: np.ndarray, doc: np.ndarray, cells: np.ndarray) -> tuple[list, ...]:
    """(ids, keys, bytes) with the cells of each document joined."""
    order = np.argsort(doc, kind="stable")
    doc, cells = doc[order], cells[order]
    own, start = np.unique(doc, return_index=True)
    ends = np.append(start[1:], len(doc))
    return (docs[own, 0], docs[own, 1], [cells[a:b].tobytes() for a, b in zip(start, ends)])


_FOUND = "rank long, key long, spans binary, asks binary"


def _found(docs: np.ndarray, doc: np.ndarray, spans: np.ndarray, asker: np.ndarray,
           asks: np.ndarray) -> pa.Table:
    r1, k1, s1 = _per_document(docs, doc, spans)
    r2, k2, s2 = _per_document(docs, asker, asks)
    return pa.table({
        "rank": pa.array(np.concatenate([r1, r2]), pa.int64()),
        "key": pa.array(np.concatenate([k1, k2]), pa.int64()),
        "spans": pa.array(s1 + [None] * len(s2), pa.binary()),
        "asks": pa.array([None] * len(s1) + s2, pa.binary()),
    })


def _compare_contexts(table: pa.Table) -> pa.Table:
    """Of one fragment: spans that go because an earlier document has the whole context, and
    places whose context must be read since the anchor has several."""
    docs = _cells(table, "docs", "<i8").reshape(-1, 2)
    size = _cells(table, "sizes", "<u4").astype(np.int64)
    doc = np.repeat(np.arange(len(docs)), _cells(table, "counts", "<u4"))
    place = _cells(table, "places", "<u4").astype(np.int64)
    value = K.unpack48(b"".join(table.column("hashes").to_pylist()))
    context = K.unpack48(b"".join(table.column("contexts").to_pylist()))
    order = np.argsort(value, kind="stable")
    ends = np.flatnonzero(np.append(value[order][1:] != value[order][:-1], True)) + 1 \
        if len(order) else np.zeros(0, np.int64)
    count = np.diff(ends, prepend=0)
    order = order[np.repeat(count > 1, count)]
    value, context, doc, place = value[order], context[order], doc[order], place[order]
    rank = docs[doc, 0]
    order = np.lexsort((rank, context, value))
    value, context, doc, place, rank = (
        x[order] for x in (value, context, doc, place, rank))
    new_value = np.ones(len(value), bool)
    new_value[1:] = value[1:] != value[:-1]
    new_class = new_value.copy()
    new_class[1:] |= context[1:] != context[:-1]
    of_class = np.cumsum(new_class) - 1
    least = rank[new_class][of_class] if len(rank) else rank
    classes = np.add.reduceat(new_class, np.flatnonzero(new_value)) if len(rank) else rank
    several = (classes > 1)[np.cumsum(new_value) - 1] if len(rank) else new_class
    a = np.maximum(place - SIDE, 0)
    b = np.minimum(place + ANCHOR + SIDE, size[doc])
    gone = (rank > least) & (b - a >= MATCH)
    spans = np.stack([a, b], axis=1).astype("<u4")[gone]
    ask = (rank == least) & several
    return _found(docs, doc[gone], spans, doc[ask], place[ask].astype("<u4"))


_CONTEXTS = "fragment int, docs binary, places binary, lengths binary, bytes binary"


def _read_contexts(fragments: int) -> Callable:
    """Contexts of the places that were asked for, to the fragments of their anchors."""
    def run(batches):
        for batch in batches:
            rank, key, asks = (batch.column(c).to_pylist() for c in ("rank", "key", "asks"))
            data, offsets = K.text_array(batch.column("text"))
            for first, end, block, inner in K.blocks(data, offsets):
                places = [np.frombuffer(b"".join(asks[i] or ()), "<u4").astype(np.int64)
                          for i in range(first, end)]
                row = np.repeat(np.arange(end - first), [len(p) for p in places])
                place = np.concatenate(places)
                at = place + inner[row]
                part = _fragment(K.Hashes(block).of(at, at + ANCHOR), fragments)
                a = np.maximum(at - SIDE, inner[row])
                b = np.minimum(at + ANCHOR + SIDE, inner[row + 1])
                ids = np.array([(rank[first + i], key[first + i]) for i in range(end - first)],
                               "<i8").reshape(-1, 2)
                order = np.argsort(part, kind="stable")
                cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
                out: list[list] = [[] for _ in range(5)]
                for x, y in zip(cuts, [*cuts[1:], len(order)]):
                    own = order[x:y]
                    length = b[own] - a[own]
                    for column, cell in zip(out, (
                            int(part[own[0]]), ids[row[own]].tobytes(),
                            (a - inner[row])[own].astype("<u4").tobytes(),
                            length.astype("<u4").tobytes(),
                            block[np.repeat(a[own], length) + K.ranges(length)].tobytes())):
                        column.append(cell)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int32()), *(pa.array(o, pa.binary()) for o in out[1:])],
                    ["fragment", "docs", "places", "lengths", "bytes"])
    return run


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes by their first symbols, more than any context has; 0 ends one."""
    n = len(text)
    padded = np.concatenate([text.astype(np.uint64), np.zeros(8, np.uint64)])
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = (key << np.uint64(9)) | padded[k:k + n]
    depth = 7
    while True:
        order = np.argsort(key, kind="stable")
        new = np.ones(n, np.int64)
        new[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.zeros(n, np.int64)
        rank[order] = np.cumsum(new)
        if depth > MATCH + 2 * SIDE or new.all():
            return order
        ahead = np.zeros(n, np.int64)
        ahead[:max(n - depth, 0)] = rank[depth:]
        key = (rank.astype(np.uint64) << np.uint64(32)) | ahead.astype(np.uint64)
        depth *= 2


class RunIndex:
    """Run-compressed index of contexts, each ended by the symbol 0.

    ``samples`` are the text positions at run ends: those whose neighbour above in the order
    of suffixes is not the one that follows the neighbour of the position before, or where that
    position matches its neighbour in no symbol. Only they keep their neighbour and the length
    of the match with it; inside a run both go on by one.
    """

    def __init__(self, text: np.ndarray):
        n = len(text)
        self.order = suffix_order(text)
        above = np.full(n, -1, np.int64)
        above[self.order[1:]] = self.order[:-1]
        ends = np.ones(n, bool)
        ends[1:] = ((above[1:] != above[:-1] + 1) | (above[:-1] < 0) | (text[:-1] == 0)
                    | (text[:-1] != text[above[:-1]]))
        self.samples = np.flatnonzero(ends)
        self.match = self._compared(text, self.samples, above[self.samples])

    @staticmethod
    def _compared(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        length = np.zeros(len(a), np.int64)
        live = np.flatnonzero(b >= 0)
        step = 0
        while len(live):
            x, y = a[live] + step, b[live] + step
            inside = (x < len(text)) & (y < len(text))
            live, x, y = live[inside], x[inside], y[inside]
            live = live[(text[x] == text[y]) & (text[x] != 0)]
            step += 1
            length[live] = step
        return length

    def matching_statistics(self, n: int) -> np.ndarray:
        """Length of each position's match with its neighbour above, from the samples."""
        run = np.searchsorted(self.samples, np.arange(n), "right") - 1
        return np.maximum(self.match[run] - (np.arange(n) - self.samples[run]), 0)

    def strings(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(suffixes in order, whether each starts a string of MATCH bytes of its own)."""
        return self.order, self.matching_statistics(n)[self.order] < MATCH


def _matched(table: pa.Table) -> pa.Table:
    """Of one fragment: spans over strings that start in a context of a smaller id too."""
    docs = _cells(table, "docs", "<i8").reshape(-1, 2)
    place = _cells(table, "places", "<u4").astype(np.int64)
    length = _cells(table, "lengths", "<u4").astype(np.int64)
    raw = _cells(table, "bytes", "u1")
    starts = np.cumsum(length + 1) - length - 1
    text = np.zeros(len(raw) + len(length), np.int16)
    owner = np.repeat(np.arange(len(length)), length + 1)
    inside = np.repeat(starts, length) + K.ranges(length)
    text[inside] = raw.astype(np.int16) + 1
    order, new = RunIndex(text).strings(len(text))
    rank = docs[owner, 0][order]
    first = np.flatnonzero(new)
    least = np.minimum.reduceat(rank, first)[np.cumsum(new) - 1]
    hit = order[rank > least]
    at = place[owner[hit]] + hit - starts[owner[hit]]
    spans = np.stack([at, at + MATCH], axis=1).astype("<u4")
    none = np.zeros(0, np.int64)
    return _found(docs, owner[hit], spans, none, none.astype("<u4"))


def _remove(raw: bytes, spans: list[bytes]) -> tuple[int, int, int, bytes]:
    """(bytes, removed bytes, maximal removed runs, what is left)."""
    data = np.frombuffer(raw, np.uint8)
    pairs = np.frombuffer(b"".join(spans), "<u4").reshape(-1, 2).astype(np.int64)
    change = np.zeros(len(data) + 1, np.int64)
    np.add.at(change, pairs[:, 0], 1)
    np.add.at(change, pairs[:, 1], -1)
    gone = np.cumsum(change)[:-1] > 0
    runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    return len(data), int(gone.sum()), runs, data[~gone].tobytes()


def _results(batches):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        early, late = (batch.column(c).to_pylist() for c in ("spans", "late"))
        rows = [_remove(t.encode(), (e or []) + (x or []))
                for t, e, x in zip(texts, early, late)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)),
             pa.array([hashlib.sha256(r[3]).hexdigest() for r in rows], pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _passing(bits) -> Callable:
    def run(batches):
        for batch in batches:
            keep = may_hold(bits.value, batch.column("key").to_numpy(zero_copy_only=False))
            yield batch.filter(pa.array(keep))
    return run


def _collected(found: DataFrame) -> DataFrame:
    return found.groupBy("rank", "key").agg(
        F.collect_list("spans").alias("spans"), F.collect_list("asks").alias("asks"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Ids are whole numbers; null ids come last, and rows with the same id are not earlier than
    each other, so what only they share stays. Null counts as the empty text. Matches do not
    cross texts and are judged on the input. An empty table gives no rows.
    """
    fragments = partitions(docs)
    last = (1 << 63) - 1
    rows = docs.select(
        F.col(id_col).alias("id"), text_of(text_col).alias("text"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(last)).alias("rank"))
    rows = rows.withColumn("key", F.xxhash64("text"))
    sent = rows.select("rank", "key", "text").mapInArrow(_to_fragments(fragments), _ANCHORS)
    found = stored(sent.groupBy("fragment").applyInArrow(_compare_contexts, _FOUND),
                   "suffix-found")
    bits = docs.sparkSession.sparkContext.broadcast(
        key_filter(found.select("key").distinct()))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, text string, rank long, key long"
    likely = rows.mapInArrow(_passing(bits), schema)
    marked = stored(likely.join(_collected(found), ["rank", "key"]), "suffix-texts")
    read = marked.where(F.size("asks") > 0).select("rank", "key", "text", "asks").dropDuplicates(
        ["rank", "key"]).mapInArrow(_read_contexts(fragments * INDEXES), _CONTEXTS)
    matched = read.groupBy("fragment").applyInArrow(_matched, _FOUND)
    late = _collected(matched).select("rank", "key", F.col("spans").alias("late"))
    cut = marked.select("id", "text", "rank", "key", "spans").join(
        late, ["rank", "key"], "left").select("id", "text", "spans", "late").mapInArrow(
        _results, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long,"
        " kept_sha256 string")
    known = found.select("rank", "key").distinct()
    whole = rows.select(
        "id", "rank", "key", F.octet_length("text").cast("long").alias("n_bytes"),
        F.sha2("text", 256).alias("kept_sha256"),
    ).join(known, ["rank", "key"], "left_anti").select(
        F.col("id").alias("doc_id"), "n_bytes", F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), "kept_sha256")
    return whole.unionByName(cut)
