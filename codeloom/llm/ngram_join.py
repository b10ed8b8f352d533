"""Near duplicates by a join on word n-grams with vertical partitioning.

A document is the set of its five-word shingles; two documents link at a Jaccard similarity of
0.75 or more. Fragments are classes of shingle hashes, not stretches of the order of shingles:

1. Every text sends its shingles to their fragments, packed. A fragment finds those that
   several sets have and answers with a count per set, packed by ranges of sets, which add the
   counts up. A set with too few shared shingles cannot have a link. Most texts end here.
2. The remaining sets send their shingles once more; a fragment answers with those that are
   shared and in how many sets each is. They have their shingles in one global order, rarest first. Sets that agree
   in a random minimum are compared with the most central one among them: that links the bulk
   of a family of copies without forming its pairs.
3. Sets of different groups are candidates if they share a shingle in the prefix of that
   order in which any two linked sets must meet, and if lengths and places allow a link.
4. The overlap of candidates is counted per vertical fragment (a class of hashes) and summed
   per pair; fragments verify candidates and find none. Links are joined to components.

Equal sets are one class throughout, so copies are never paired.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm import kernels as K
from codeloom.llm.tables import key_filter, may_hold, partitions, stored, text_of
from codeloom.operators.dedup import connected_labels

WORDS = 5
#: Link at PERCENT * (size of the union) <= 100 * (size of the intersection).
PERCENT = 75
#: Random minima per set for the first links.
MINIMA = 8
#: Vertical fragments in which overlaps are counted.
FRAGMENTS = 4
#: Bytes of text whose shingles a task packs at a time.
BLOCK = 1 << 22
_ONE, _TWO = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def _sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, shingle, size per row, key per row): distinct shingles in row order; the key is
    16 bytes that depend on the set alone."""
    rows = len(offsets) - 1
    starts, ends, row = K.words(data, offsets)
    hashes = K.word_hashes(data, starts, ends)
    row, shingle = K.shingles(hashes, row, rows, WORDS)
    size = np.bincount(row, minlength=rows)
    keys = np.zeros((rows, 2), np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        first = np.concatenate([[0], np.cumsum(size[some])[:-1]])
        for k, salt in enumerate((_ONE, _TWO)):
            keys[some, k] = np.add.reduceat(K.mix64(shingle * salt + salt), first)
    return row, shingle, size, keys


def _blocks(batch: pa.RecordBatch, most: int) -> Iterator:
    data, offsets = K.text_array(batch.column("text"))
    return K.blocks(data, offsets, most)


def _fixed(raw: np.ndarray) -> pa.Array:
    """Rows of a two-column array of 64-bit numbers as 16-byte values."""
    return pa.Array.from_buffers(
        pa.binary(16), len(raw), [None, pa.py_buffer(np.ascontiguousarray(raw).tobytes())]
    ).cast(pa.binary())


def _keys(keep: list[str]) -> Callable:
    def run(batches):
        for batch in batches:
            for first, end, block, inner in _blocks(batch, K.BLOCK):
                _, _, size, keys = _sets(block, inner)
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(size, pa.int64()), _fixed(keys)],
                    [*keep, "n", "key"])
    return run


def _to_fragments(fragments: int, wanted=None) -> Callable:
    """Rows (fragment, keys, sizes, counts, shingles): for a stretch of texts, which sets have
    how many shingles in the fragment, and the low 48 bits of these. ``wanted``, a filter of
    keys, leaves other sets out."""
    def run(batches):
        bits = None if wanted is None else wanted.value
        for batch in batches:
            for first, end, block, inner in _blocks(batch, BLOCK):
                out = [list(x) for x in _packed(block, inner, fragments, bits)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[0] for o in out], pa.int32()),
                     *(pa.array([o[k] for o in out], pa.binary()) for k in range(1, 5))],
                    ["fragment", "keys", "sizes", "counts", "shingles"])
    return run


def _packed(block: np.ndarray, inner: np.ndarray, fragments: int, bits: bytes | None
            ) -> Iterator[tuple]:
    parts, keys, sizes, at = [], [], [], 0
    for _, end, data, offsets in K.blocks(block, inner):
        row, shingle, size, key = _sets(data, offsets)
        parts.append((row + at, shingle))
        keys.append(key)
        sizes.append(size)
        at += len(size)
    row, shingle = (np.concatenate([p[k] for p in parts]) for k in range(2))
    key, size = np.concatenate(keys), np.concatenate(sizes)
    # copies within the stretch are sent once
    once = np.zeros(len(key), bool)
    once[np.unique(_void(key), return_index=True)[1]] = True
    if bits is not None:
        once &= may_hold(bits, key[:, 0].view(np.int64))
    keep = once[row]
    row, shingle = row[keep], shingle[keep]
    fragment = (shingle >> np.uint64(48)) % np.uint64(fragments)
    order = np.argsort(fragment.astype(np.int32), kind="stable")
    row, shingle, fragment = row[order], shingle[order], fragment[order]
    cuts = np.flatnonzero(np.diff(fragment.astype(np.int64), prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(fragment)]):
        rows, counts = np.unique(row[a:b], return_counts=True)
        yield (int(fragment[a]), key[rows].tobytes(), size[rows].astype("<u4").tobytes(),
               counts.astype("<u4").tobytes(), K.pack48(shingle[a:b]))


def _void(keys: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(keys).view("V16").ravel()


_SHARED = "key binary, n int, count int, shingles binary, counts binary"


def _shared(table: pa.Table) -> tuple[np.ndarray, ...]:
    """(keys, sizes, entry, shingle, sets) of one fragment: for each shingle that several sets
    have, by entry of ``keys``, how many have it."""
    pieces = [np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
              for c, kind in (("keys", "V16"), ("sizes", "<u4"), ("counts", "<u4"))]
    shingle = K.unpack48(b"".join(table.column("shingles").to_pylist()))
    keys, sizes, counts = pieces
    _, first = np.unique(keys, return_index=True)
    once = np.zeros(len(keys), bool)
    once[first] = True
    entry = np.repeat(np.arange(len(keys)), counts)
    keep = once[entry]
    entry, shingle = entry[keep], shingle[keep]
    order = np.argsort(shingle, kind="stable")
    new = np.flatnonzero(np.diff(shingle[order], prepend=np.uint64(1 << 63)) != 0)
    frequency = np.diff(np.append(new, len(shingle)))
    in_sets = np.zeros(len(shingle), np.int64)
    in_sets[order] = np.repeat(frequency, frequency)
    shared = in_sets >= 2
    return keys, sizes, entry[shared], shingle[shared], in_sets[shared]


_COUNTED = "range int, keys binary, sizes binary, counts binary"
_SENT_BACK = f"{_COUNTED}, shingles binary, often binary"


def _by_range(keys: np.ndarray, ranges: int) -> list[tuple[int, np.ndarray]]:
    """(range, places of its keys)."""
    where = (keys.view("<u8")[::2] % np.uint64(ranges)).astype(np.int32)
    order = np.argsort(where, kind="stable")
    present, first = np.unique(where[order], return_index=True)
    return [(int(r), order[a:b])
            for r, a, b in zip(present, first, [*first[1:], len(order)])]


def _shared_of(ranges: int, shingles: bool) -> Callable[[pa.Table], pa.Table]:
    """Of one fragment: how many shared shingles each set has there, and with ``shingles``
    these and in how many sets each is; one row per range of sets."""
    def run(table: pa.Table) -> pa.Table:
        number = int(table.column("fragment")[0].as_py())
        keys, sizes, entry, shingle, in_sets = _shared(table)
        shingle = shingle | np.uint64((number & 0xFFFF) << 48)
        owners, start, count = np.unique(entry, return_index=True, return_counts=True)
        keys, sizes = keys[owners], sizes[owners]
        rows = []
        for at, places in _by_range(keys, ranges):
            row = [at, *(np.ascontiguousarray(v[places]).tobytes()
                         for v in (keys, sizes, count.astype("<u4")))]
            if shingles:
                n = count[places]
                cells = np.repeat(start[places] - np.cumsum(n) + n, n) + np.arange(n.sum())
                row += [shingle[cells].astype("<u8").tobytes(),
                        np.minimum(in_sets[cells], 0xFFFFFFFF).astype("<u4").tobytes()]
            rows.append(row)
        names = ["range", "keys", "sizes", "counts", "shingles", "often"][:6 if shingles else 4]
        return pa.table({name: pa.array([r[k] for r in rows], pa.binary() if k else pa.int32())
                         for k, name in enumerate(names)})
    return run


def _summed(table: pa.Table) -> tuple[np.ndarray, ...]:
    """(keys, sizes, which set each entry is, count per entry, sets with enough)."""
    keys, sizes, counts = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
                           for c, kind in (("keys", "V16"), ("sizes", "<u4"), ("counts", "<u4")))
    _, first, which = np.unique(keys, return_index=True, return_inverse=True)
    which = which.ravel()
    total = np.bincount(which, counts, len(first))
    enough = 100 * total >= PERCENT * sizes[first].astype(np.int64)
    return keys[first], sizes[first], which, counts.astype(np.int64), enough


def _enough(table: pa.Table) -> pa.Table:
    """Keys (their first eight bytes) of a range of sets whose counts allow a link."""
    keys, _, _, _, enough = _summed(table)
    return pa.table({"key": pa.array(
        np.ascontiguousarray(keys[enough]).view("<i8")[::2], pa.int64())})


_RECORD = ("key binary, n int, shared int, central float, shingles array<bigint>,"
           " prefix array<bigint>, minima array<bigint>")


def _records(table: pa.Table) -> pa.Table:
    """Sets of a range in the global order (rarest first, then by hash), with the prefix in
    which links must meet, random minima, and the mean frequency of the shingles."""
    salts = K.mix64(np.arange(1, MINIMA + 1, dtype=np.uint64)) | np.uint64(1)
    keys, sizes, which, counts, enough = _summed(table)
    shingles, oftens = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
                        for c, kind in (("shingles", "<u8"), ("often", "<u4")))
    owner = np.repeat(which, counts)
    keep = enough[owner]
    owner, shingles, oftens = owner[keep], shingles[keep], oftens[keep]
    order = np.lexsort((shingles, oftens, owner))
    owner, shingles, oftens = owner[order], shingles[order], oftens[order]
    present, first = np.unique(owner, return_index=True)
    out = []
    for at, a, b in zip(present.tolist(), first, [*first[1:], len(owner)]):
        n, shingle, often = int(sizes[at]), shingles[a:b], oftens[a:b].astype(np.int64)
        least = -(-PERCENT * n // 100)
        signed = shingle.astype(np.int64)
        out.append((
            keys[at].tobytes(), n, len(shingle), float(often.sum() + n - len(often)) / n, signed,
            signed[:len(shingle) - least + 1],
            [int(K.mix64(shingle * s).min().astype(np.int64)) for s in salts]))
    kinds = (pa.binary(), pa.int32(), pa.int32(), pa.float32(), *[pa.list_(pa.int64())] * 3)
    names = ["key", "n", "shared", "central", "shingles", "prefix", "minima"]
    return pa.table({name: pa.array([o[k] for o in out], kind)
                     for k, (name, kind) in enumerate(zip(names, kinds))})


def _linked(overlap: Column, a: Column, b: Column) -> Column:
    return (100 + PERCENT) * overlap >= PERCENT * (a + b)


def _in_fragment(k: int) -> Callable[[Column], Column]:
    return lambda s: F.pmod(F.shiftright(s, 40), F.lit(FRAGMENTS)) == k


def verified(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """Pairs (a, b) that link. The overlap is counted in each fragment by itself and summed."""
    one = segments.select(F.col("key").alias("a"), "fragment", F.col("n").alias("n_a"),
                          F.col("shingles").alias("s_a"))
    two = segments.select(F.col("key").alias("b"), "fragment", F.col("n").alias("n_b"),
                          F.col("shingles").alias("s_b"))
    parts = pairs.select("a", "b").join(one, "a").join(two, ["b", "fragment"])
    partial = parts.select(
        "a", "b", "n_a", "n_b", F.size(F.array_intersect("s_a", "s_b")).alias("common"))
    return partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("common").alias("common")).where(
        _linked(F.col("common"), F.col("n_a"), F.col("n_b"))).select("a", "b")


def _central_pairs(records: DataFrame) -> DataFrame:
    """Every set with the most central one that shares a random minimum."""
    cells = records.select("key", "central", F.posexplode("minima").alias("k", "least"))
    leader = cells.groupBy("k", "least").agg(
        F.max(F.struct("central", "key"))["key"].alias("b"))
    return cells.join(leader, ["k", "least"]).where(F.col("key") != F.col("b")).select(
        F.least("key", "b").alias("a"), F.greatest("key", "b").alias("b")).distinct()


def _prefix_pairs(records: DataFrame, labels: DataFrame) -> DataFrame:
    """Candidate pairs between groups: a common shingle in both prefixes, where lengths and
    places allow a link. A set and one at least as large share six sevenths of the smaller
    one or more, so that the smaller one's prefix is shorter (``early``); of two equally large
    sets both are."""
    named = records.join(labels.withColumnRenamed("id", "key"), "key", "left").select(
        "key", "n", "shared", "prefix", F.coalesce("label", "key").alias("label"))
    places = named.select(
        "key", "n", "shared", "label", F.posexplode("prefix").alias("place", "shingle"))
    several = places.groupBy("shingle").agg(
        F.min("label").alias("low"), F.max("label").alias("high")
    ).where(F.col("low") != F.col("high")).select("shingle")
    open_ = places.join(several, "shingle", "left_semi").withColumn("early", F.expr(
        f"place <= shared - ceil({2 * PERCENT} * n / {100 + PERCENT}D)"))
    columns = ("key", "n", "shared", "label", "place", "early")
    a = open_.where("early").select("shingle", *[F.col(c).alias(f"{c}_a") for c in columns])
    b = open_.select("shingle", *[F.col(c).alias(f"{c}_b") for c in columns])
    rest = F.least(F.col("shared_a") - F.col("place_a"), F.col("shared_b") - F.col("place_b"))
    most = F.least("place_a", "place_b") + rest
    smaller = (F.col("n_a") < F.col("n_b")) | (
        (F.col("n_a") == F.col("n_b")) & F.col("early_b") & (F.col("key_a") < F.col("key_b")))
    near = (
        smaller & (F.col("label_a") != F.col("label_b"))
        & (100 * F.col("n_a") >= PERCENT * F.col("n_b"))
        & _linked(most, F.col("n_a"), F.col("n_b")))
    met = a.join(b, "shingle").where(near)
    return met.select(F.least("key_a", "key_b").alias("a"),
                      F.greatest("key_a", "key_b").alias("b")).distinct()


def set_links(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links (a, b) between the keys of different sets that suffice for the components,
    labels (id, label) of the linked keys) from rows with ``text``."""
    fragments = partitions(rows)
    sent = "fragment int, keys binary, sizes binary, counts binary, shingles binary"
    counted = rows.select("text").mapInArrow(_to_fragments(fragments), sent).groupBy(
        "fragment").applyInArrow(_shared_of(fragments, False), _COUNTED)
    passed = counted.groupBy("range").applyInArrow(_enough, "key long")
    wanted = rows.sparkSession.sparkContext.broadcast(key_filter(passed))
    shared = rows.select("text").mapInArrow(_to_fragments(fragments, wanted), sent).groupBy(
        "fragment").applyInArrow(_shared_of(fragments, True), _SENT_BACK)
    records = stored(shared.groupBy("range").applyInArrow(_records, _RECORD), "ngram-sets")
    segments = stored(records.select("key", "n", F.explode(F.array(*[F.struct(
        F.lit(k).alias("fragment"),
        F.filter("shingles", _in_fragment(k)).alias("shingles"))
        for k in range(FRAGMENTS)])).alias("f")).select("key", "n", "f.*"),
        "ngram-segments")
    first = stored(verified(_central_pairs(records), segments), "ngram-links")
    labels = connected_labels(first.select(F.col("a").alias("id"), F.col("b").alias("leader")))
    pairs = stored(_prefix_pairs(records, labels), "ngram-pairs")
    links = stored(first.unionByName(verified(pairs, segments)), "ngram-all")
    return links, connected_labels(
        links.select(F.col("a").alias("id"), F.col("b").alias("leader")))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(
        F.col(id_col).alias("id"), text_of(text_col).alias("text"),
        F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("tie"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_keys(["id", "tie"]), f"id {kind}, tie long, n long, key binary")


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tie, n, component): component is null for empty sets, else (smallest id, its
    tie, links within the component)."""
    keyed = stored(_keyed(docs, id_col, text_col), "ngram-keys")
    _, labels = set_links(docs.select(text_of(text_col).alias("text")))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tie"))
    classes = stored(keyed.where("n > 0").groupBy("key").agg(least.alias("first"))
                     .join(labels.withColumnRenamed("id", "key"), "key", "left")
                     .withColumn("label", F.coalesce("label", "key")), "ngram-classes")
    groups = classes.groupBy("label").agg(F.min("first").alias("component"))
    of_key = classes.join(groups, "label").select("key", "component")
    return keyed.join(of_key, "key", "left").select("id", "tie", "n", F.when(
        F.col("n") > 0, F.col("component")).alias("component"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id that links reach).

    Words are lower-cased in A to Z only. A text with fewer than five words has its whole
    sequence as its one shingle; null, empty and blank texts have the empty set, which links
    with nothing: their component is their own id. Ids may repeat: every row has its own set.
    Null ids are never the smallest unless a component has no other. An empty table gives no
    rows.
    """
    return _grouped(docs, id_col, text_col).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component.id")).otherwise(F.col("id"))
        .alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows without those whose component has a smaller id (then a smaller digest of
    the row); rows that are equal in all columns stay or go together."""
    grouped = _grouped(docs, id_col, text_col)
    own = F.struct(F.col("id").isNull().alias("none"), "id", "tie")
    drop = grouped.where(F.col("component").isNotNull() & (F.col("component") != own)).select(
        F.col("id").alias("_drop_id"), F.col("tie").alias("_drop_tie")).distinct()
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col(id_col).alias("_id"), tie.alias("_tie"))
    return rows.join(
        drop, rows["_id"].eqNullSafe(drop["_drop_id"]) & (rows["_tie"] == drop["_drop_tie"]),
        "left_anti").select("row.*")
