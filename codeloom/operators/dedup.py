"""Unions without repeats, exact and near duplicates."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions.text import let
from codeloom.session import cut_lineage, stored

SIGNATURES = 100
ROWS_PER_BAND = 5
_COMPACT_EVERY = 8
_WORTH_IT = 10


def union_needed(needed: Column, found: Column) -> Column:
    """Needed files and search hits of one row, each once, needed ones first."""
    none = F.array().cast("array<string>")
    return F.array_union(F.coalesce(needed, none), F.coalesce(found, none))


def normalized(text: Column) -> Column:
    """Lower case, runs of whitespace as one blank, no whitespace around."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def keep_best(df: DataFrame, keys: Sequence[str], best: Sequence[str | Column]) -> DataFrame:
    """One row per key, the one that is largest by ``best`` (then by its other columns).

    A maximum instead of a ranking window: map tasks keep one row per key before the
    shuffle, so a key with a third of all rows costs one row per map task.
    """
    order = [F.expr(b) if isinstance(b, str) else b for b in best]
    ranks = F.struct(*[c.alias(f"r{i}") for i, c in enumerate(order)])
    rest = F.struct(*[c for c in df.columns if c not in keys])
    top = df.groupBy(*keys).agg(F.max(F.struct(ranks.alias("ranks"), rest.alias("rest")))
                                .alias("top"))
    return top.select(*keys, "top.rest.*").select(*df.columns)


def _copies(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, chars, copy_key): texts that are equal after normalising share a key."""
    return docs.select(
        F.col(id_col).alias("id"), F.length(text).alias("chars"),
        # a text that is null is a copy of nothing
        F.coalesce(F.sha2(normalized(F.col(text)), 256), F.concat(F.lit("null "), id_col))
        .alias("copy_key"),
    )


def drop_exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The longest, then newest (largest id), of the documents that are equal after
    normalising.

    Only ids, lengths and hashes are grouped. The texts meet the ids to drop in an anti
    join, which needs no shuffle of the texts while these ids are few enough to broadcast.
    """
    copies = cut_lineage(_copies(docs, id_col, text))  # narrow, and read twice
    best = copies.groupBy("copy_key").agg(
        F.max(F.struct("chars", "id"))["id"].alias("best"), F.count("*").alias("n")
    ).filter("n > 1")
    dropped = copies.join(best, "copy_key").filter("id <> best")
    return docs.join(dropped.select(F.col("id").alias(id_col)), id_col, "left_anti")


def shingles(text: Column, words: int = 3) -> Column:
    """Distinct hashes of runs of ``words`` words; a shorter text is one run."""

    def runs(tokens: Column) -> Column:
        last = F.greatest(F.size(tokens) - words, F.lit(0))
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(words)]),
        )

    return F.array_distinct(let(F.split(normalized(text), " "), runs))


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


_FACTORS = np.random.default_rng(42).integers(1, 1 << 63, SIGNATURES, np.uint64) * 2 + 1
_MASKS = np.random.default_rng(43).integers(0, 1 << 63, SIGNATURES, np.uint64)
_HASHES_AT_ONCE = 1 << 14


def minima(hashes: np.ndarray) -> np.ndarray:
    """Signature of one document: the smallest value of every seeded hash."""
    values = np.asarray(hashes).astype(np.int64).view(np.uint64)
    lowest = np.full(SIGNATURES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(values), _HASHES_AT_ONCE):
        some = values[start:start + _HASHES_AT_ONCE, None]
        lowest = np.minimum(lowest, ((some ^ _MASKS) * _FACTORS).min(axis=0))
    return lowest.view(np.int64)


def signatures(docs: DataFrame, id_col: str, hashes: Column) -> DataFrame:
    """(id, minima) of every document. Dozens of hashes per word are far faster in numpy
    than as array expressions; a document never leaves its task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(
                {"id": batch["id"], "minima": [minima(h) for h in batch["hashes"]]})

    schema = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType),
        T.StructField("minima", T.ArrayType(T.LongType())),
    ])
    return docs.select(F.col(id_col).alias("id"), hashes.alias("hashes")).mapInPandas(run, schema)


def bucket_members(signed: DataFrame) -> DataFrame:
    """(id, bucket), one bucket per band of the signature."""
    bands = [
        F.xxhash64(F.lit(start), *[F.get("minima", F.lit(start + k)) for k in range(ROWS_PER_BAND)])
        for start in range(0, SIGNATURES, ROWS_PER_BAND)
    ]
    return signed.select("id", F.explode(F.array(*bands)).alias("bucket"))


def near_duplicate_links(
    docs: DataFrame, id_col: str, hashes: Column, threshold: float
) -> DataFrame:
    """(id, leader, jaccard): each document that shares a bucket is compared with leaders of
    the bucket and is linked when their exact Jaccard is high enough.

    The first leader of a bucket is its smallest id. Documents that are like no leader go on
    to the next round, with twice as many leaders (the next smallest ids, compared with each
    other too), until every bucket is used up. One round is enough for copies of
    one text, however many. Unlike documents in one bucket cost as many comparisons as they
    are unlike, but the rounds grow only with the logarithm of the largest bucket. The rule
    does not depend on sizes. A document that is like a leader leaves the bucket, so links to
    it from documents unlike the leader may be missing; ``missing_links`` finds these.
    """
    signed = cut_lineage(signatures(docs, id_col, hashes))
    members = bucket_members(signed)
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    open_ = cut_lineage(members.join(shared.select("bucket"), "bucket", "left_semi"))
    # the sets, as large as the texts, are kept only for documents with company
    sets = cut_lineage(
        docs.withColumnRenamed(id_col, "id")
        .join(open_.select("id").distinct(), "id", "left_semi")
        .select("id", hashes.alias("hashes"))
    )
    done = sets.select(
        "id", F.col("id").alias("leader"), F.lit(1.0).alias("jaccard")).limit(0)
    rounds = 0
    while not open_.isEmpty():
        rounds += 1
        by_id = Window.partitionBy("bucket").orderBy("id")
        leaders = open_.withColumn("place", F.row_number().over(by_id)).filter(
            F.col("place") <= 1 << (rounds - 1)).select("bucket", F.col("id").alias("leader"))
        led = open_.join(leaders, "bucket").filter("id > leader")
        pairs = led.select("id", "leader").distinct()
        compared = cut_lineage(
            pairs.join(sets, "id")
            .join(sets.select(F.col("id").alias("leader"), F.col("hashes").alias("other")),
                  "leader")
            .select("id", "leader", jaccard(F.col("hashes"), F.col("other")).alias("jaccard"))
        )
        linked = compared.filter(F.col("jaccard") >= threshold)
        done = done.unionByName(linked)
        if rounds % _COMPACT_EVERY == 0:
            done = cut_lineage(done)
        used = leaders.select(F.col("leader").alias("id"), "bucket").unionByName(
            led.join(linked.select("id", "leader"), ["id", "leader"], "left_semi")
            .select("id", "bucket"))
        open_ = cut_lineage(open_.join(used, ["id", "bucket"], "left_anti"))
    return done.distinct()


def merging_links(sets: DataFrame, threshold: float) -> DataFrame:
    """(id, leader): links that join the bulk of each group of near copies in ``sets`` (id,
    hashes), a number of pairs that is at most that of the groups so far in every round.

    In each bucket a group has one member, drawn anew per round, and the bucket one leader of
    all of them. A group is compared with the leader that it meets in most buckets, then
    groups with a link are one. So thousands of copies of one text are compared with one of
    them, once each. Rounds end when one comparison in ``_WORTH_IT`` or fewer gives a link;
    links that remain between groups are left to ``missing_links``.
    """
    members = bucket_members(cut_lineage(signatures(sets, "id", F.col("hashes"))))
    several = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = cut_lineage(members.join(several.select("bucket"), "bucket", "left_semi"))
    named = members.withColumn("label", F.col("id"))
    links = members.select("id", F.col("id").alias("leader")).limit(0)
    seed = 0
    while True:
        seed += 1
        drawn = F.struct(F.xxhash64(F.lit(seed), "id").alias("order"), "id", "label")
        groups = named.groupBy("bucket", "label").agg(F.min(drawn).alias("one"))
        leaders = groups.groupBy("bucket").agg(F.min("one").alias("lead"))
        met = groups.join(leaders, "bucket").filter(F.col("label") != F.col("lead.label"))
        often = met.groupBy("label", F.col("lead.label").alias("other")).agg(
            F.count("*").alias("n"), F.min(F.struct("lead", "one")).alias("pair"))
        pairs = cut_lineage(
            often.groupBy("label").agg(F.max(F.struct("n", "pair")).alias("best"))
            .select("best.pair.*")
            .select(F.greatest("lead.id", "one.id").alias("id"),
                    F.least("lead.id", "one.id").alias("leader")).distinct())
        others = sets.select(F.col("id").alias("leader"), F.col("hashes").alias("other"))
        linked = cut_lineage(
            pairs.join(sets, "id").join(others, "leader")
            .filter(jaccard(F.col("hashes"), F.col("other")) >= threshold)
            .select("id", "leader"))
        found = linked.count()
        # written: what a checkpoint remembers of its plan would grow from round to round
        links = stored(links.unionByName(linked), "near-links")
        if found * _WORTH_IT <= pairs.count():
            return links
        named = members.join(connected_labels(links), "id", "left").select(
            "id", "bucket", F.coalesce("label", "id").alias("label"))


def missing_links(
    docs: DataFrame, id_col: str, hashes: Column, threshold: float, labels: DataFrame
) -> DataFrame:
    """(id, leader, jaccard): all links between documents of different labels (id, label),
    by an exact prefix join.

    Hashes of a set are ordered rarest first. Two sets that are alike share a hash in their
    prefixes of that order, where a prefix leaves out one less than the fewest hashes that
    the set shares with any set like it; the smaller set's prefix is shorter still. Hashes
    that one set alone has lead the order and are not shuffled further.
    """
    sets = cut_lineage(docs.select(F.col(id_col).alias("id"), hashes.alias("hashes")))
    cells = sets.select("id", F.size("hashes").alias("n"), F.explode("hashes").alias("hash"))
    often = cells.groupBy("hash").agg(F.count("*").alias("often")).filter("often > 1")
    ordered = cells.join(often, "hash").groupBy("id", "n").agg(
        F.array_sort(F.collect_list(F.struct("often", "hash"))).alias("cells"))

    def prefix(share: float) -> Column:
        # a little longer where rounding could make it too short
        return F.size("cells") - F.ceil(share * F.col("n") - 1e-6) + 1

    named = ordered.join(labels, "id", "left").select(
        "id", "n", F.size("cells").alias("shared"), F.coalesce("label", "id").alias("label"),
        prefix(2 * threshold / (1 + threshold)).alias("early"),
        F.posexplode(F.slice("cells", F.lit(1), F.greatest(prefix(threshold), F.lit(0)).cast(
            "int"))).alias("place", "cell"),
    )
    places = cut_lineage(named.select(
        "id", "n", "shared", "label", "place", (F.col("place") < F.col("early")).alias("early"),
        F.col("cell.hash").alias("hash")))
    several = places.groupBy("hash").agg(
        F.min("label").alias("low"), F.max("label").alias("high")
    ).filter("low <> high").select("hash")
    open_ = places.join(several, "hash", "left_semi")
    columns = ("id", "n", "shared", "label", "place", "early")
    a, b = (open_.select("hash", *[F.col(c).alias(f"{c}_{side}") for c in columns])
            for side in "ab")
    most = F.least("place_a", "place_b") + F.least(
        F.col("shared_a") - F.col("place_a"), F.col("shared_b") - F.col("place_b"))
    smaller = F.expr("n_a < n_b or n_a = n_b and early_b and id_a < id_b")
    pairs = a.filter("early_a").join(b, "hash").filter(
        smaller & F.expr("label_a <> label_b")
        & (F.col("n_a") >= threshold * F.col("n_b") - 1e-6)
        & ((1 + threshold) * most >= threshold * (F.col("n_a") + F.col("n_b")) - 1e-6)
    ).select(F.greatest("id_a", "id_b").alias("id"), F.least("id_a", "id_b").alias("leader"))
    return (
        pairs.distinct().join(sets, "id")
        .join(sets.select(F.col("id").alias("leader"), F.col("hashes").alias("other")), "leader")
        .select("id", "leader", jaccard(F.col("hashes"), F.col("other")).alias("jaccard"))
        .filter(F.col("jaccard") >= threshold)
    )


#: Hashes of a block of sets, which travel in one row per fragment.
BLOCK_HASHES = 1 << 20
_FRAGMENTS_PER_PARTITION = 2


def _least(n: int, threshold: float) -> int:
    """Fewest hashes that a set of ``n`` shares with a set like it."""
    return math.ceil(threshold * n - 1e-6)


def _sent(n: int, threshold: float, half: bool) -> tuple[int, int]:
    """How many of a set's hashes, smallest first, are sent, and how many of these at least
    are also sent by each set like it.

    The first q hashes that two sets share are among the n - least + q smallest of either.
    """
    least = _least(n, threshold)
    if not half:
        return n, least
    # the smallest set like it has ``least`` hashes and sends half of what that one shares
    return n - least + max(1, least // 2), max(1, _least(least, threshold) // 2)


def shared_enough(
    sets: DataFrame, threshold: float, labels: bool = False, half: bool = True
) -> DataFrame:
    """(id): the sets (id, hashes) that may be like another one, by counting alone.

    A set like another one shares ``threshold`` of its hashes with it. So each set's hashes
    are looked up in all other sets (with ``labels``: in sets of another ``label``), and sets
    with fewer hits are left out; all that stay are worth a comparison, none that is like
    another is lost. ``half`` looks up the smaller half of the hashes.

    No hash is ever a row. A block of sets sends one row per fragment of the hash space, with
    four bytes per hash and two for its set; the fragment, one at a time in memory, answers
    with a count per set of the block, and the blocks add up their counts. Rows follow blocks
    times fragments, whatever the sets share. Blocks are written before they are sent, so a
    step that is run again meets the same blocks.
    """
    id_type = sets.schema["id"].dataType
    partitions = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fragments = _FRAGMENTS_PER_PARTITION * partitions
    out = T.StructType([
        T.StructField("fragment", T.IntegerType()), T.StructField("block", T.LongType()),
        T.StructField("hashes", T.BinaryType()), T.StructField("places", T.BinaryType()),
        T.StructField("labels", T.BinaryType()), T.StructField("ids", T.ArrayType(id_type)),
    ])

    def packed(ids: pa.Array, values: np.ndarray, sizes: np.ndarray, label: np.ndarray | None,
               block: int) -> pa.RecordBatch:
        place = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
        limits = np.array([_sent(int(n), threshold, half) for n in sizes], np.int64)
        order = np.lexsort((values, place))
        values = values[order]
        rank = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        kept = rank < np.repeat(limits[:, 0], sizes)
        values, place = values[kept], place[kept]
        fragment = ((values >> np.uint64(32)) % np.uint64(fragments)).astype(np.int32)
        order = np.argsort(fragment, kind="stable")
        fragment, values, place = fragment[order], values[order].astype(np.uint32), place[order]
        present, first = np.unique(fragment, return_index=True)
        ends = [*first[1:], len(fragment)]
        cuts = list(zip(first, ends))
        n = len(cuts)
        # the block's own row passes by the fragments and waits for the counts
        return pa.RecordBatch.from_arrays([
            pa.array([*present.tolist(), -1 - abs(block) % fragments], pa.int32()),
            pa.array([block] * (n + 1), pa.int64()),
            pa.array([*(values[a:b].tobytes() for a, b in cuts),
                      limits[:, 1].astype(np.int32).tobytes()], pa.binary()),
            pa.array([*(place[a:b].tobytes() for a, b in cuts), None], pa.binary()),
            pa.array([None if label is None else label[place[a:b]].tobytes()
                      for a, b in cuts] + [None], pa.binary()),
            pa.array([None] * n + [ids.to_pylist()], pa.list_(ids.type)),
        ], out.fieldNames())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            sizes = np.diff(column.offsets.to_numpy()).astype(np.int64)
            values = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            label = batch.column(2).to_numpy(zero_copy_only=False) if labels else None
            starts, first = np.concatenate([[0], np.cumsum(sizes)]), 0
            while first < len(sizes):
                end = int(np.searchsorted(starts, starts[first] + BLOCK_HASHES, "right")) - 1
                end = min(max(end, first + 1), first + 65_000, len(sizes))
                yield packed(ids.slice(first, end - first), values[starts[first]:starts[end]],
                             sizes[first:end], None if label is None else label[first:end], block)
                first, block = end, block + 1

    def hits(rows: list[dict]) -> Iterator[tuple[int, bytes, bytes]]:
        hashes = np.concatenate([np.frombuffer(r["hashes"], np.uint32) for r in rows])
        if labels:
            order = np.argsort(hashes, kind="stable")
            own = np.concatenate([np.frombuffer(r["labels"], np.int64) for r in rows])[order]
            first = np.flatnonzero(np.r_[True, np.diff(hashes[order].astype(np.int64)) != 0])
            several = np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)
            shared = np.empty(len(hashes), bool)
            shared[order] = np.repeat(several, np.diff(np.r_[first, len(hashes)]))
        else:
            _, which, count = np.unique(hashes, return_inverse=True, return_counts=True)
            shared = (count > 1)[which]
        at = 0
        for r in rows:
            places = np.frombuffer(r["places"], np.uint16)
            found, n = np.unique(places[shared[at:at + len(places)]], return_counts=True)
            at += len(places)
            if len(found):
                yield r["block"], found.tobytes(), n.astype(np.int32).tobytes()

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fragment, rows = None, []

        def answers(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([f[i] for f in found], t) for i, t in
                 enumerate((pa.int64(), pa.binary(), pa.binary()))]
                + [pa.array([f[3] if len(f) > 3 else None for f in found], pa.list_(id_arrow))],
                ["block", "places", "counts", "ids"])

        id_arrow = None
        for batch in batches:
            id_arrow = batch.schema.field("ids").type.value_type
            done: list[tuple] = []
            for row in batch.to_pylist():
                if row["fragment"] < 0:
                    done.append((row["block"], None, row["hashes"], row["ids"]))
                    continue
                if row["fragment"] != fragment:
                    if rows:
                        done += hits(rows)
                    fragment, rows = row["fragment"], []
                rows.append(row)
            yield answers(done)
        if rows:
            yield answers(list(hits(rows)))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, own, total = None, None, None

        def passed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([i for i, ok in zip(own[1], total[:len(own[1])] >= own[0]) if ok],
                          id_arrow)], ["id"])

        for batch in batches:
            id_arrow = batch.schema.field("ids").type.value_type
            for row in batch.to_pylist():
                if row["block"] != block:
                    if own is not None:
                        yield passed()
                    block, own, total = row["block"], None, np.zeros(1 << 16, np.int64)
                if row["ids"] is not None:
                    own = np.frombuffer(row["counts"], np.int32), row["ids"]
                else:
                    total[np.frombuffer(row["places"], np.uint16)] += np.frombuffer(
                        row["counts"], np.int32)
        if own is not None:
            yield passed()

    answer = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("places", T.BinaryType()),
        T.StructField("counts", T.BinaryType()), T.StructField("ids", T.ArrayType(id_type))])
    columns = ["id", "hashes", *(["label"] if labels else [])]
    blocks = stored(sets.select(*columns).mapInArrow(send, out), "set-blocks")
    counted = blocks.repartition(partitions, "fragment").sortWithinPartitions(
        "fragment").mapInArrow(look_up, answer)
    return counted.repartition(partitions, "block").sortWithinPartitions("block").mapInArrow(
        add_up, T.StructType([T.StructField("id", id_type)]))


def compare_with_first(
    docs: DataFrame, id_col: str, text: str, block: Column, words: int = 3
) -> DataFrame:
    """(id, first_id, jaccard) of every document with the smallest id of its block."""
    sets = cut_lineage(docs.select(
        F.col(id_col), block.alias("block"), shingles(F.col(text), words).alias("hashes")))
    first = sets.groupBy("block").agg(F.min(id_col).alias("first_id"))
    others = sets.select(F.col(id_col).alias("first_id"), F.col("hashes").alias("other"))
    return (
        sets.join(first, "block").filter(F.col(id_col) != F.col("first_id"))
        .join(others, "first_id")
        .select(id_col, "first_id", jaccard(F.col("hashes"), F.col("other")).alias("jaccard"))
    )


def connected_labels(links: DataFrame) -> DataFrame:
    """(id, label): smallest id of each connected group of (id, leader) links.

    Every round takes the smallest label among the neighbours and then the label of that
    label, so long chains shrink fast; rounds end when no label changes.
    """
    edges = cut_lineage(
        links.select("id", F.col("leader").alias("other"))
        .unionByName(links.select(F.col("leader").alias("id"), F.col("id").alias("other")))
        .distinct()
    )
    labels = cut_lineage(
        edges.groupBy("id").agg(F.min("other").alias("label"))
        .select("id", F.least("id", "label").alias("label"))
    )
    while True:
        spread = (
            edges.join(labels.select(F.col("id").alias("other"), F.col("label").alias("l")),
                       "other")
            .groupBy("id").agg(F.min("l").alias("near"))
        )
        nearer = labels.join(spread, "id").select(
            "id", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("next"))
        moved = cut_lineage(
            nearer.join(jump, "label", "left")
            .select("id", "old", F.coalesce("next", "label").alias("label"))
        )
        labels = moved.select("id", "label")
        if moved.filter("label <> old").isEmpty():
            return labels


def near_duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = 0.8,
    words: int = 3,
) -> DataFrame:
    """(id, group_id, kept): groups of copies and near copies; one document is kept each.

    Equal texts are folded first, so a text copied any number of times counts once. Texts that
    do not share enough with others, by far the most, are left out by counting. A few links
    join the bulk of each group; texts that also share enough with other groups, few, are
    joined exactly, so the groups are those of all pairs. Kept is the longest text, then
    the largest id.
    """
    copies = cut_lineage(_copies(docs, id_col, text))
    first = copies.groupBy("copy_key").agg(F.min("id").alias("first_id"))
    firsts = copies.join(first, "copy_key")
    repeats = firsts.filter("id <> first_id").select(F.col("id").alias(id_col))
    distinct_docs = docs.select(id_col, text).where(F.col(text).isNotNull()).join(
        repeats, id_col, "left_anti")
    hashed = distinct_docs.select(
        F.col(id_col).alias("id"), shingles(F.col(text), words).alias("hashes"))
    sets = stored(
        hashed.join(cut_lineage(shared_enough(hashed, threshold)), "id", "left_semi"), "near-sets")
    hashes = F.col("hashes")
    links = merging_links(sets, threshold)
    labels = connected_labels(links)
    # numbers for labels of any type: two labels with one number would lose a link with a
    # chance of 2^-64 per pair
    numbered = sets.join(labels, "id", "left").select(
        "id", "hashes", F.xxhash64(F.coalesce("label", "id")).alias("label"))
    open_ = cut_lineage(shared_enough(numbered, threshold, labels=True, half=False))
    missing = missing_links(
        sets.join(open_, "id", "left_semi"), "id", hashes, threshold, labels)
    labels = connected_labels(links.unionByName(missing.select("id", "leader")))
    grouped = firsts.join(
        labels.select(F.col("id").alias("first_id"), "label"), "first_id", "left"
    ).select("id", "chars", F.coalesce("label", "first_id").alias("group_id"))
    best = grouped.groupBy("group_id").agg(F.max(F.struct("chars", "id"))["id"].alias("best"))
    return grouped.join(best, "group_id").select(
        "id", "group_id", (F.col("id") == F.col("best")).alias("kept")
    )
