"""Walks and joins over the edge table (src, pos, dst, ...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.ordering import with_dense_index
from codeloom.session import cut_lineage, stored_by

_COMPACT_EVERY = 8
CHAIN_SEPARATOR = " > "


def breadth_first(
    edges: DataFrame, entries: Sequence[str], max_depth: int | None = None,
    chains: bool = False, by_source: bool = False,
) -> DataFrame:
    """Files reachable from ``entries``: (path, depth, parent, seq).

    ``seq`` is the order in which a first-in-first-out queue would take the files;
    ``parent`` is the file that queued it first; ``chains=True`` adds ``chain``, the way from
    the entry. ``by_source`` says that ``edges`` are stored by ``src`` already (``stored_by``),
    else their copy is. A level is one join, so the number of Spark jobs follows the depth, not the
    files. Each file keeps only its smallest (parent seq, position), found before the
    shuffle as far as possible, so that a file imported from everywhere is one row per map
    task.
    """
    spark = edges.sparkSession
    # in buckets by source, so that no level shuffles the links again; a level's files are the
    # side that is hashed, so that none sorts them either
    links = (edges if by_source else stored_by(edges.select("src", "pos", "dst"), "src", "links")
             ).select("src", F.col("pos").cast("long").alias("pos"), "dst")
    start = list(dict.fromkeys(entries))
    level = spark.range(1).select(F.posexplode(F.lit(start)).alias("seq", "path")).select(
        "path",
        F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast("string").alias("parent"),
        F.col("seq").cast("long").alias("seq"),
    )
    if chains:
        level = level.withColumn("chain", F.col("path"))
    columns = level.columns
    seen, taken, depth = level, len(start), 0
    while max_depth is None or depth < max_depth:
        depth += 1
        parents = level.select(
            F.col("path").alias("src"), F.col("path").alias("parent"),
            F.col("seq").alias("parent_seq"), *(["chain"] if chains else []))
        first = F.min(F.struct(
            "parent_seq", "pos", "parent", *(["chain"] if chains else [])))
        found = (
            links.join(parents.hint("shuffle_hash"), "src")
            .groupBy(F.col("dst").alias("path"))
            .agg(first.alias("first"))
            .join(seen.select("path"), "path", "left_anti")
        )
        fresh = found.select(
            "path",
            F.lit(depth).cast("long").alias("depth"),
            "first.*",
        )
        if chains:
            fresh = fresh.withColumn("chain", F.concat("chain", F.lit(CHAIN_SEPARATOR), "path"))
        numbered, count = with_dense_index(fresh, ["parent_seq", "pos"], "seq", taken)
        level = numbered.select(*columns)
        if count == 0:
            break
        taken += count
        seen = seen.unionByName(level)
        if depth % _COMPACT_EVERY == 0:
            seen = cut_lineage(seen)
    return seen


def trace_order(tree: DataFrame) -> DataFrame:
    """``tree`` (path, parent, seq) with ``preorder`` and ``subtree``: the place of each file
    when every file is followed by all that was discovered through it, and their number.

    The tour around the tree goes down into and up out of each file. Steps left until its end
    come from pointer doubling, so that the number of joins follows the logarithm of the
    number of files, however deep the tree is. Children of a file are ordered in one group,
    which is no longer than the file's own list of links.
    """
    among = Window.partitionBy("parent").orderBy("seq")
    placed = cut_lineage(tree.select("path", "parent", "seq").withColumn(
        "sibling", F.lead("path").over(among)))
    eldest = placed.filter(F.col("parent").isNotNull()).groupBy(
        F.col("parent").alias("path")).agg(F.min_by("path", "seq").alias("child"))

    def step(down: bool, path: Column) -> Column:
        return F.when(path.isNotNull(), F.struct(F.lit(down).alias("down"), path.alias("path")))

    here = F.col("path")
    ways = placed.join(eldest, "path", "left")
    tour = ways.select(
        step(True, here).alias("at"), F.lit(1).cast("long").alias("left"),
        F.coalesce(step(True, F.col("child")), step(False, here)).alias("next"),
    ).unionByName(ways.select(
        step(False, here).alias("at"), F.lit(0).cast("long").alias("left"),
        F.coalesce(step(True, F.col("sibling")), step(False, F.col("parent"))).alias("next")))
    tour = cut_lineage(tour)
    while not tour.filter(F.col("next").isNotNull()).isEmpty():
        # a step whose tour has ended has no partner and stays as it is
        ahead = tour.select(F.col("at").alias("next"), F.col("left").alias("more"),
                            F.col("next").alias("beyond"))
        tour = cut_lineage(tour.join(ahead, "next", "left").select(
            "at", (F.col("left") + F.coalesce("more", F.lit(0))).alias("left"),
            F.col("beyond").alias("next")))
    counted = tour.groupBy(F.col("at.path").alias("path")).agg(
        F.max(F.when(F.col("at.down"), F.col("left"))).alias("entered"),
        F.max(F.when(~F.col("at.down"), F.col("left"))).alias("left_behind"))
    total = tree.agg(F.count("*").alias("total"))
    return tree.join(counted, "path").crossJoin(total).withColumns({
        "preorder": F.col("total") - F.col("entered"),
        "subtree": F.col("entered") - F.col("left_behind"),
    }).drop("entered", "left_behind", "total")


def reverse_dependencies(edges: DataFrame) -> DataFrame:
    """(dst, src) without repeats: who uses what, as rows."""
    return edges.select("dst", "src").distinct()


def used_by(edges: DataFrame, order: DataFrame, per_row: int = 1000) -> DataFrame:
    """(path, part, used_by): the users of each file, among the files of ``order`` (path,
    seq), in that order and joined by comma.

    Users go by their sequence number: part 0 holds those below ``per_row``, part 1 the next
    ones, and so on, parts without users have no row. So no task and no row holds an
    unbounded group, and all rows of a file together are its list. Links of files outside
    ``order`` go in the first join; repeats go within a part's own group.
    """
    placed = edges.select("dst", "src").join(
        order.select(F.col("path").alias("src"), "seq"), "src"
    ).withColumn("part", F.floor(F.col("seq") / per_row).cast("long"))
    users = F.array_sort(F.collect_set(F.struct("seq", "src")))
    return placed.groupBy(F.col("dst").alias("path"), "part").agg(
        F.array_join(F.transform(users, lambda u: u["src"]), ", ").alias("used_by")
    )


def first_and_further(users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, part, used_by) of each file's first part, and of its other parts."""
    first = users.groupBy("path").agg(F.min("part").alias("part"))
    return (users.join(first, ["path", "part"], "left_semi"),
            users.join(first, ["path", "part"], "left_anti"))


def links_per_file(edges: DataFrame) -> DataFrame:
    """(path, links): targets of each file in source order. Such a group cannot grow beyond
    the imports of one file, which already was one row."""
    found = F.array_sort(F.collect_list(F.struct("pos", "dst")))
    return edges.groupBy(F.col("src").alias("path")).agg(
        F.transform(found, lambda s: s["dst"]).alias("links")
    )


def missing_targets(edges: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(missing, source, reason, n_links) of relative targets that are no file.

    Edges that were resolved against the files know it already; only others need ``files``.
    """
    known = files is None
    wanted = edges.filter("is_relative AND NOT resolved" if known else "is_relative")
    # grouped before the anti join, so that a target wanted from everywhere is one row
    lost = wanted.groupBy("dst").agg(
        F.min(F.struct("src", "pos", "spec")).alias("first"), F.count("*").alias("n_links")
    )
    if not known:
        lost = lost.join(files.select(F.col("path").alias("dst")), "dst", "left_anti")
    return lost.select(
        F.col("dst").alias("missing"), F.col("first.src").alias("source"),
        F.concat(F.lit("imported as "), "first.spec").alias("reason"), "n_links",
    )


def unexplored(wanted: DataFrame, explored: DataFrame) -> DataFrame:
    """Rows of ``wanted`` whose (path, aspect) has not been explored."""
    return wanted.join(explored.select("path", "aspect").distinct(), ["path", "aspect"],
                       "left_anti")


def next_frontier(links: DataFrame, needed: DataFrame) -> DataFrame:
    """Union of linked and needed files (path, parent, pos), each path once; links win."""
    both = links.select("path", "parent", "pos", F.lit(0).alias("source_rank")).unionByName(
        needed.select("path", "parent", "pos", F.lit(1).alias("source_rank"))
    )
    return both.groupBy("path").agg(
        F.min(F.struct("source_rank", "parent", "pos")).alias("first")
    ).select("path", "first.*")


def with_context(files: DataFrame, edges: DataFrame, order: DataFrame,
                 summaries: DataFrame, per_row: int = 1000) -> DataFrame:
    """Each file with its links, users and summary: (path, part, links, used_by, summary).

    Part 0 holds links, summary and the first users; further users have rows of their own.
    """
    first, further = first_and_further(used_by(edges, order, per_row))
    head = (
        files.select("path", F.lit(0).cast("long").alias("part"))
        .join(links_per_file(edges), "path", "left")
        .join(summaries.select("path", "summary"), "path", "left")
        .join(first.select("path", "used_by"), "path", "left")
    )
    more = further.join(files.select("path"), "path", "left_semi")
    return head.unionByName(more, allowMissingColumns=True)
