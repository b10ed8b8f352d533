"""Mixing sources to target weights: certain whole copies, then Pareto order sampling.

Every source has a target number of words. Each of its documents is first taken as many whole
times as the target allows for all of them. What then lacks comes from a sample without
repeats: documents are ranked by their random odds divided by their inclusion odds, and taken
in that order until the lacking words are reached. Random odds come from the id, so reruns
agree.

Sources have one row each; documents are counted into a fixed number of rank bins before
anything is ordered, so that only the documents of one bin per source are ordered, however
many rows a source has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.tables import WORD, same, stored, text_of

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: All words of the mix as a share of all words there are.
SHARE = 1.5
#: A source is taken this many times at most.
MOST = 2
#: Rank bins per source.
BINS = 4096


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                   most: int = MOST) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    The target is the weight's share of the whole, but ``most`` times the source's size at
    most; what is above is shared by weight among the others until none is above. That ends
    where target = min(most * size, level * weight) with one level for all: with the sources
    in order of cap / weight, it is the greatest (rest of the whole) / (rest of the weights).
    Works on one row per source.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(ordered) - 1) % len(weights)
    weighed = sums.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), place))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"),
                              F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    later = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    cap = F.lit(most) * F.col("source_size")
    level = (
        F.lit(float(share)) * F.sum("source_size").over(everything)
        - F.coalesce(F.sum(cap).over(earlier), F.lit(0))
    ) / F.sum("weight").over(later)
    return weighed.withColumn("level", level).select(
        "source", "source_size",
        F.least(cap.cast("double"), F.max("level").over(everything) * F.col("weight"))
        .alias("target"),
    )


def _chance(key: Column) -> Column:
    """Uniform in [0, 1) from 52 bits of a digest."""
    digits = F.conv(F.substring(F.md5(F.concat(F.lit("mix-"), key)), 1, 13), 16, 10)
    return digits.cast("long") / F.lit(float(1 << 52))


def _ranked(rows: DataFrame) -> DataFrame:
    """Adds rank (0 to 1, from odds divided by odds), its bin, and the key that orders."""
    odds = F.expr("chance / (1 - chance)") * F.sqrt(F.greatest("size", F.lit(1)))
    return rows.withColumn(
        "chance", _chance(F.coalesce(F.col("id").cast("string"), F.lit("")))
    ).withColumn("odds", odds).withColumn("rank", F.col("odds") / (1 + F.col("odds"))).withColumn(
        "bin", F.floor(F.col("rank") * BINS).cast("int")
    ).withColumn("key", F.struct("rank", F.col("id").isNull().alias("none"), "id", "digest"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"),
        F.md5(text_of(text_col)).alias("digest"), *more,
    )


def mix_rules(sized: DataFrame) -> DataFrame:
    """One row per source: source_size, target, whole (certain copies of every document),
    full (last rank bin taken wholly), last (key of the last document taken behind it)."""
    targets = stored(source_targets(sized), "mix-targets").withColumn(
        "whole", F.when(F.col("source_size") == 0, 0)
        .otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("int")
    ).withColumn("lacking", F.col("target") - F.col("whole") * F.col("source_size"))
    ranked = _ranked(sized)
    sums = ranked.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    upto = Window.partitionBy("source").orderBy("bin")
    bins = stored(sums.withColumn("upto", F.sum("bin_size").over(upto)), "mix-bins")
    cut = bins.join(targets, same(bins["source"], targets["source"])).drop(targets["source"])
    full = cut.where(F.col("upto") <= F.col("lacking")).groupBy(
        F.col("source").alias("full_source")).agg(F.max("bin").alias("full"))
    broken = cut.where(
        (F.col("upto") > F.col("lacking")) & (F.col("upto") - F.col("bin_size") < F.col("lacking"))
    ).select(F.col("source").alias("s"), F.col("bin").alias("b"), "lacking",
             (F.col("upto") - F.col("bin_size")).alias("before"))
    by_rank = Window.partitionBy("source", "bin").orderBy("key").rowsBetween(
        Window.unboundedPreceding, 0)
    inside = ranked.join(
        broken, same(F.col("source"), F.col("s")) & (F.col("bin") == F.col("b"))
    ).withColumn("upto", F.col("before") + F.sum("size").over(by_rank))
    over, under = F.col("upto") - F.col("lacking"), F.col("lacking") - F.col("upto") + F.col("size")
    last = inside.where((over <= 0) | ((under > 0) & (over < under))).groupBy(
        F.col("source").alias("last_source")).agg(F.max("key").alias("last"))
    return targets.join(full, same(F.col("source"), F.col("full_source")), "left").join(
        last, same(F.col("source"), F.col("last_source")), "left"
    ).select(
        F.col("source").alias("rule_source"), "source_size", "target", "whole", "lacking",
        F.coalesce("full", F.lit(-1)).alias("full"), "last",
    )


def _copies(rows: DataFrame, rules: DataFrame) -> DataFrame:
    taken = (F.col("bin") <= F.col("full")) | (F.col("key") <= F.col("last"))
    chosen = F.coalesce(taken, F.lit(False)) & (F.col("lacking") > 0)
    return _ranked(rows).join(rules, same(F.col("source"), F.col("rule_source"))).withColumn(
        "copies", F.col("whole") + chosen.cast("int"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken (words, with repeats),
    copies (how often the document is in the mix).

    Size is the number of words; null text has none. Rows without an id share one random
    number; equal ranks go by id, null ids last, then by a digest of the text; rows that are
    equal in all of these are taken alike. Inclusion odds fall with the square root of the
    size, so that a few very long documents do not fill the sample. The last document is taken
    if that comes nearer to the target. A null source is a source of its own, the last one.
    An empty table gives no rows.
    """
    sized = stored(_sized(docs, id_col, text_col, source_col), "mix-sizes")
    rules = stored(mix_rules(sized), "mix-rules")
    return _copies(sized, rules).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target",
        (F.col("copies").cast("long") * F.col("size")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source") -> DataFrame:
    """The mix itself: input rows, as often as they are taken, with their own columns. The
    texts meet one row per source and are not ordered or grouped."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    sized = stored(_sized(docs, id_col, text_col, source_col), "mix-sizes")
    rules = stored(mix_rules(sized), "mix-rules")
    rows = _copies(_sized(docs, id_col, text_col, source_col, whole), rules)
    return rows.where("copies > 0").select(
        "row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


#: The last steps repeat the ranking of all documents in one window, which SQL can afford on
#: the small tables.
SQL = r"""
WITH d AS (SELECT doc_id, source,
             len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
             md5(coalesce(text, '')) AS digest FROM documents),
     s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
     p AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
                     WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
     l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
              - coalesce(sum(2 * source_size) OVER (ORDER BY source_size / weight::DOUBLE,
                  source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY source_size / weight::DOUBLE, source NULLS LAST
                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM p),
     t AS (SELECT source, source_size,
             least(2.0::DOUBLE * source_size, max(level) OVER () * weight) AS target FROM l),
     w AS (SELECT *, CASE WHEN source_size = 0 THEN 0
                          ELSE floor(target / source_size) END AS whole FROM t),
     c AS (SELECT d.*, w.source_size, w.target, w.whole,
             target - whole * source_size AS lacking,
             ('0x' || substr(md5('mix-' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
           FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source),
     r AS (SELECT *, (u / (1 - u)) * sqrt(greatest(size, 1)) AS odds FROM c),
     x AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY odds / (1 + odds), doc_id, digest
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM r)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  ((whole + CASE WHEN lacking > 0 AND (upto <= lacking OR
      (upto - size < lacking AND upto - lacking < lacking - (upto - size)))
    THEN 1 ELSE 0 END) * size)::BIGINT AS taken,
  (whole + CASE WHEN lacking > 0 AND (upto <= lacking OR
      (upto - size < lacking AND upto - lacking < lacking - (upto - size)))
    THEN 1 ELSE 0 END)::INTEGER AS copies
FROM x
"""
