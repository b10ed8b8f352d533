"""Exact duplicates by sorting the texts themselves.

Sampled splitters cut the order of normalised texts into ranges. Each range is sorted by one
task, outside memory where needed; equal texts become neighbours and every row is compared in
full with the row before it. The order ends with the id, so that a text with a third of all
rows is cut into several ranges like any other stretch of the order; runs that go on in the
next range are joined from the first and last rows of the ranges, two per range.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm.tables import SPACE, partitions, stored, text_of

#: Characters of the normalised text that lead the sort key; the digest and the full
#: comparison decide behind them.
LEAD = 64
#: Sampled rows per range.
SAMPLES = 8


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


def _position(key: Column, splitters: Column, count: int) -> Column:
    """How many splitters are not above the key, by binary search."""
    steps = [1 << k for k in reversed(range(count.bit_length()))]
    if not steps:
        return F.lit(0)
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda at, step: F.when(
            F.coalesce(F.get(splitters, at + step - 1) <= key, F.lit(False)), at + step,
        ).otherwise(at),
    )


def _splitters(keyed: DataFrame, ranges: int) -> tuple[Column | None, int]:
    """Literal array of keys that cut the rows into about equal ranges: a few short keys
    per range come to the driver."""
    total = keyed.count()
    if ranges < 2 or total < 2:
        return None, 0
    sample = keyed.select("key") if total <= SAMPLES * ranges else keyed.select("key").sample(
        SAMPLES * ranges / total, seed=11)
    as_json = F.to_json("key", {"ignoreNullFields": "false"}).alias("j")
    found = [json.loads(r.j) for r in sample.orderBy("key").select(as_json).collect()]
    chosen = [found[len(found) * i // ranges] for i in range(1, ranges)] if found else []
    chosen = [k for i, k in enumerate(chosen) if i == 0 or k != chosen[i - 1]]
    if not chosen:
        return None, 0
    kind = T.ArrayType(keyed.schema["key"].dataType)
    return F.from_json(F.lit(json.dumps(chosen, ensure_ascii=False)), kind), len(chosen)


def content_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after replacing each run of white space by one blank; null
    is the empty text. Of equal texts the row with the smallest id stays; null ids come last;
    of rows that share the smallest id too, exactly one stays. ``carry`` adds the input row as
    the struct ``row``, whatever its columns are called. An empty table gives no rows.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(id_col).alias("id"), text_of(text_col).alias("text"),
    )
    keyed = rows.withColumn("norm", normalised(F.col("text"))).select(
        "row", "id", "text",
        F.struct(
            F.substring("norm", 1, LEAD).alias("lead"), F.sha2("norm", 256).alias("sha"),
            F.col("id").isNull().alias("none"), F.col("id"),
            F.xxhash64(*[F.col(f"row.`{c}`") for c in docs.columns]).alias("tie"),
        ).alias("key"),
    )
    splitters, count = _splitters(keyed, partitions(docs))
    at = F.lit(0) if splitters is None else _position(F.col("key"), splitters, count)
    w = Window.partitionBy("range").orderBy("key")
    placed = keyed.select(
        at.alias("range"), "key", "text", "id", *(["row"] if carry else []),
    )
    neighbours = placed.withColumns({
        "last_text": F.lag("text").over(w), "last_sha": F.lag("key.sha").over(w),
        "first": F.row_number().over(w) == 1,
        "last": F.lead(F.lit(True)).over(w).isNull(),
    })
    same = F.coalesce(
        (F.col("key.sha") == F.col("last_sha"))
        & (normalised(F.col("text")) == normalised(F.col("last_text"))), F.lit(False))
    marked = neighbours.withColumn("starts", ~same)
    runs = marked.withColumn("run", F.sum(F.col("starts").cast("int")).over(w))
    piece = Window.partitionBy("range", "run")
    table = stored(runs.select(
        "range", "run", "id", F.col("key.sha").alias("sha"), "starts", "first", "last",
        F.when(F.col("first") | F.col("last"), F.col("text")).alias("edge"),
        F.min(F.struct("key.none", "key.id")).over(piece).alias("least"),
        F.count(F.lit(1)).over(piece).alias("size"), *(["row"] if carry else []),
    ), "content-sort")
    chains = _chains(table)
    joined = table.join(chains, ["range", "run"], "left")
    head = F.coalesce("chain_start", F.lit(True)) & F.col("starts")
    return joined.select(
        F.col("id").alias("doc_id"),
        F.coalesce("chain_least", "least")["id"].alias("keep_id"),
        F.coalesce("chain_size", "size").alias("group_size"),
        head.alias("kept"), F.col("sha").alias("text_sha256"), *(["row"] if carry else []),
    )


def _chains(table: DataFrame) -> DataFrame:
    """(range, run) of runs that touch a range's end, with size and smallest id of the whole
    group. Two rows per range at most, so one task orders them."""
    order = Window.orderBy("range", "run")
    ends = table.where(F.col("first") | F.col("last")).groupBy("range", "run").agg(
        F.max(F.when(F.col("first"), F.col("edge"))).alias("head"),
        F.max(F.when(F.col("last"), F.col("edge"))).alias("tail"),
        F.max("sha").alias("sha"), F.max("size").alias("size"), F.min("least").alias("least"),
    )
    linked = ends.withColumns({
        "prev_tail": F.lag("tail").over(order), "prev_sha": F.lag("sha").over(order),
        "prev_range": F.lag("range").over(order),
    }).withColumn("goes_on", F.coalesce(
        (F.col("prev_range") < F.col("range")) & (F.col("prev_sha") == F.col("sha"))
        & (normalised(F.col("prev_tail")) == normalised(F.col("head"))), F.lit(False)))
    chained = linked.withColumn(
        "chain", F.sum((~F.col("goes_on")).cast("int")).over(order))
    whole = Window.partitionBy("chain")
    return chained.select(
        "range", "run", (~F.col("goes_on")).alias("chain_start"),
        F.sum("size").over(whole).alias("chain_size"),
        F.min("least").over(whole).alias("chain_least"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows that stay, with their own columns."""
    return content_groups(docs, id_col, text_col, carry=True).where("kept").select("row.*")


SQL = """
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') t
           FROM documents),
     g AS (SELECT t, min(doc_id) keep_id, count(*) group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM n JOIN g USING (t)
"""
