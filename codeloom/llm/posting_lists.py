"""Nearest neighbours by inner product over balanced posting lists.

Equal vectors are one entry of the index with their smallest ids, as many as an answer can hold
and one more for the query's own; ties go to smaller ids, so no answer needs the others. One
more component, what a vector's length lacks to the greatest length, turns the largest inner
product into the smallest distance.

* Lists: centroids come from a bounded sample (``SAMPLE`` vectors, chosen by hash), cut in
  halves of equal size again and again and moved by a few rounds that charge for size. Every
  vector is indexed: it goes to the list of its nearest centroid and, near a boundary, to up to
  ``REPLICAS`` lists, unless a chosen centroid is nearer to the next than the vector itself.
* Centroids are found by best-first search in a graph of near, well spread centroids, which
  each task holds in memory (``MOST_LISTS`` centroids at most).
* A query searches the lists whose centroid is within a ratio of its nearest one's distance.
  The ratio is set from ``TRIALS`` queries that are compared with all vectors: lists within it
  hold the share ``COVER`` of their true neighbours. Lists are taken beyond the ratio until
  they surely hold an answer's number of vectors, so small tables are searched whole.
* Lists lie in shards of a bounded size; a list that is larger has several. A query goes once
  to a shard, with the lists it searches there, and meets the shard's vectors in one matrix
  product. Queries stream past a shard, so their number is not bounded by memory.

Scores are sums of products in double precision, in the order of the components. Vectors that
are null, zero or hold null or non-finite components, have no id, or do not have the commonest
length (the longer one in a tie) take no part. A query never finds its own id; an id with
several vectors is a query for each of them. Only vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.tables import partitions, stored
from codeloom.llm.value_codes import whole

#: Vectors of the sample that centroids come from, and centroids at most.
SAMPLE = 1 << 16
MOST_LISTS = 1 << 13
REPLICAS = 4
#: Distance of a further list's centroid, in that of the nearest one.
BOUNDARY = 1.15
#: Queries that set the ratio of lists to search, and the share of neighbours it must hold.
TRIALS = 64
COVER = 0.975
#: Size of a shard's vectors in memory.
SHARD_BYTES = 32 << 20
_DEGREE = 24
_WIDTH = 24
_QUERIES_AT_ONCE = 256


def _squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def lengthened(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the component that gives all of them the length ``longest``."""
    lacking = np.sqrt(np.maximum(longest ** 2 - _squares(vectors), 0.0))
    return np.concatenate([vectors, lacking[:, None]], axis=1)


def _halves(points: np.ndarray, rows: np.ndarray, k: int, found: list[np.ndarray]) -> None:
    """Centroids of ``k`` equally large groups, by cuts across the direction of two means."""
    todo = [(rows, k)]
    while todo:
        rows, k = todo.pop()
        if k <= 1 or len(rows) <= 1:
            found.append(points[rows].mean(axis=0))
            continue
        some = points[rows]
        left = k // 2
        cut = max(1, min(len(rows) - 1, len(rows) * left // k))
        away = some[np.argmax(_squares(some - some.mean(axis=0)))] - some.mean(axis=0)
        for _ in range(4):
            order = np.argsort(some @ away, kind="stable")
            away = some[order[cut:]].mean(axis=0) - some[order[:cut]].mean(axis=0)
        order = np.argsort(some @ away, kind="stable")
        todo += [(rows[order[:cut]], left), (rows[order[cut:]], k - left)]


def balanced_centroids(points: np.ndarray, k: int, rounds: int = 4) -> np.ndarray:
    """``k`` centroids at most; a round assigns points with a charge for crowded centroids."""
    found: list[np.ndarray] = []
    _halves(points, np.arange(len(points)), min(k, len(points)), found)
    centroids = np.array(found)
    charge = np.zeros(len(centroids))
    for _ in range(rounds):
        norms = _squares(centroids)
        chosen = np.concatenate([
            (norms + charge - 2 * points[i:i + 4096] @ centroids.T).argmin(axis=1)
            for i in range(0, len(points), 4096)])
        sizes = np.bincount(chosen, minlength=len(centroids))
        spread = _squares(points - centroids[chosen]).mean()
        sums = np.zeros_like(centroids)
        np.add.at(sums, chosen, points)
        full = sizes > 0
        centroids[full] = sums[full] / sizes[full, None]
        charge += 0.05 * spread * (sizes / max(sizes.mean(), 1) - 1)
    return centroids


class CentroidGraph:
    """Centroids and links to near ones, searched best first for many points at once."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = np.ascontiguousarray(centroids, np.float32)
        self.norms = _squares(self.centroids)
        n = len(centroids)
        near = min(n - 1, 3 * _DEGREE)
        links = np.zeros((n, min(n - 1, _DEGREE) + 1), np.int32)
        for i in range(n):
            distances = self.norms - 2 * self.centroids @ self.centroids[i]
            distances[i] = np.inf
            order = np.argpartition(distances, near - 1)[:near] if near else np.zeros(0, int)
            order = order[np.argsort(distances[order], kind="stable")]
            # a link is left out if a chosen neighbour is nearer to its end
            among = self.centroids[order]
            between = self.norms[order][:, None] + self.norms[order] - 2 * among @ among.T
            own = distances[order] + self.norms[i]
            chosen: list[int] = []
            for j in range(len(order)):
                if len(chosen) < _DEGREE and (not chosen or (between[j, chosen] > own[j]).all()):
                    chosen.append(j)
            rest = [j for j in range(len(order)) if j not in set(chosen)]
            chosen = (chosen + rest)[:links.shape[1] - 1]
            links[i, :-1] = order[chosen]
            links[i, -1] = (i + 1) % n  # a ring through all centroids keeps the graph whole
        self.links = links
        self.starts = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(np.int64))

    def distances(self, points: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """Squared distance of each point to its lists (points x lists)."""
        products = np.einsum("bkd,bd->bk", self.centroids[lists], points)
        return np.maximum(self.norms[lists] - 2 * products + _squares(points)[:, None], 0)

    def search(self, points: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance) of the ``width`` nearest that are found, in order."""
        points = np.ascontiguousarray(points, np.float32)
        n, b = len(self.centroids), len(points)
        width = min(width, n)
        rows = np.arange(b)
        seen = np.zeros((b, n), bool)
        lists = np.tile(self.starts, (b, 1))
        seen[:, self.starts] = True
        gaps = self.distances(points, lists)
        opened = np.zeros(lists.shape, bool)
        step = 4
        while True:
            order = np.argsort(gaps, axis=1, kind="stable")[:, :max(width, step)]
            lists, gaps, opened = (np.take_along_axis(x, order, 1)
                                   for x in (lists, gaps, opened))
            closed = ~opened & np.isfinite(gaps)
            live = closed.any(axis=1)
            if not live.any():
                break
            # the nearest lists not opened yet, a few at a time
            rank = np.where(closed, np.cumsum(closed, axis=1), 0)
            now = (rank > 0) & (rank <= step)
            opened |= now
            picks = np.argsort(~now, axis=1, kind="stable")[:, :step]
            valid = np.take_along_axis(now, picks, 1)
            ends = self.links[np.take_along_axis(lists, picks, 1)]
            ends = np.where(valid[:, :, None], ends, -1).reshape(b, -1)
            fresh = (ends >= 0) & ~seen[rows[:, None], np.maximum(ends, 0)]
            seen[rows[:, None], np.maximum(ends, 0)] |= fresh
            # a centroid that two links of this step name counts once
            sort = np.argsort(ends, axis=1, kind="stable")
            named = np.take_along_axis(ends, sort, 1)
            again = np.zeros(ends.shape, bool)
            again[:, 1:] = named[:, 1:] == named[:, :-1]
            twice = np.zeros(ends.shape, bool)
            np.put_along_axis(twice, sort, again, 1)
            fresh &= ~twice
            new = np.where(fresh, self.distances(points, np.maximum(ends, 0)), np.inf)
            lists = np.concatenate([lists, np.maximum(ends, 0)], axis=1)
            gaps = np.concatenate([gaps, new], axis=1)
            opened = np.concatenate([opened, ~fresh], axis=1)
        return lists[:, :width], gaps[:, :width]


class Index:
    """What a task needs to send vectors and queries to lists and shards."""

    def __init__(self, graph: CentroidGraph, longest: float):
        self.graph, self.longest = graph, longest
        self.ratio, self.width = BOUNDARY, _WIDTH
        self.first_shard = self.shards = self.sizes = None

    def homes(self, vectors: np.ndarray) -> list[list[int]]:
        """Lists of each vector, the nearest one first."""
        found = []
        for start in range(0, len(vectors), 1024):
            points = lengthened(vectors[start:start + 1024], self.longest)
            lists, gaps = self.graph.search(points, _WIDTH)
            for own, gap in zip(lists, gaps):
                chosen = [int(own[0])]
                for at, distance in zip(own[1:].tolist(), gap[1:].tolist()):
                    if len(chosen) == REPLICAS or distance > BOUNDARY ** 2 * gap[0]:
                        break
                    centres = self.graph.centroids
                    if (_squares(centres[chosen] - centres[at]) > distance).all():
                        chosen.append(at)
                found.append(chosen)
        return found

    def probes(self, queries: np.ndarray, least: int) -> list[np.ndarray]:
        """Lists that each query searches."""
        found = []
        for start in range(0, len(queries), 1024):
            points = np.concatenate(
                [queries[start:start + 1024], np.zeros((len(queries[start:start + 1024]), 1))],
                axis=1).astype(np.float32)
            lists, gaps = self.graph.search(points, self.width)
            for row, (own, gap) in enumerate(zip(lists, gaps)):
                if self.sizes[own].sum() < least and len(own) < len(self.sizes):
                    everything = self.graph.norms - 2 * self.graph.centroids @ points[row]
                    own = np.argsort(everything, kind="stable")
                    gap = everything[own] + _squares(points[row:row + 1])[0]
                before = np.cumsum(self.sizes[own]) - self.sizes[own]
                found.append(own[(gap <= self.ratio ** 2 * gap[0]) | (before < least)])
        return found

    def place(self, sizes: np.ndarray, primary: np.ndarray, room: int, least: int) -> int:
        """Put lists into shards of ``room`` vectors, ``least`` shards or more; the number."""
        self.sizes = primary
        room = max(1, min(room, -(-int(sizes.sum()) // least)))
        self.shards = np.maximum(1, -(-sizes // room))
        self.first_shard = np.zeros(len(sizes), np.int64)
        shard, held = 0, 0
        for at in range(len(sizes)):  # neighbours by number are neighbours in space
            if held and held + sizes[at] > room:
                shard, held = shard + 1, 0
            self.first_shard[at] = shard
            if self.shards[at] > 1:
                shard, held = shard + int(self.shards[at]), 0
            else:
                held += int(sizes[at])
        return shard + 1


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), length).astype(
        np.float64)


def scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of pairs, components added in order, whatever the other pairs are."""
    total = np.zeros(len(queries))
    for at in range(queries.shape[1]):
        total += queries[:, at] * vectors[:, at]
    return total


def _best(query: np.ndarray, rough: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int
          ) -> tuple[np.ndarray, np.ndarray]:
    """(row, score) of the ``k`` largest, ties to smaller ids; ``rough`` may be rounded."""
    rows = np.flatnonzero(rough > -np.inf)
    if len(rows) > k:
        bar = np.partition(rough[rows], len(rows) - k)[len(rows) - k]
        slack = 1e-9 * max(1e-300, float(np.sqrt((query ** 2).sum() * _squares(vectors).max())))
        rows = rows[rough[rows] >= bar - slack]
    exact = scores(np.broadcast_to(query, (len(rows), len(query))), vectors[rows])
    order = np.lexsort((ids[rows], -exact))[:k]
    return rows[order], exact[order]


_VECTOR = "a long, b long, least_id long"
_HITS = "array<struct<score:double,least_id:long,a:long,b:long>>"
_HIT = pa.list_(pa.struct([("score", pa.float64()), ("least_id", pa.int64()),
                           ("a", pa.int64()), ("b", pa.int64())]))


def _exact_neighbours(vectors: DataFrame, queries: np.ndarray, k: int, length: int
                      ) -> list[tuple[int, list[float]]]:
    """(query, vector) of the ``k`` nearest vectors of a few queries, from all vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in queries]
        for batch in batches:
            held = _matrix(batch.column(1), length)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            rough = queries @ held.T
            for at, query in enumerate(queries):
                rows, exact = _best(query, rough[at], held, ids, k)
                more = [(-s, int(ids[r]), held[r]) for r, s in zip(rows, exact.tolist())]
                best[at] = sorted(best[at] + more, key=lambda hit: hit[:2])[:k]
        flat = [(at, -s, i, v.tolist()) for at, hits in enumerate(best) for s, i, v in hits]
        if flat:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*flat), (
                    pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.float64())))],
                ["query", "score", "least_id", "vector"])

    found = vectors.select("least_id", "embedding").mapInArrow(
        run, "query int, score double, least_id long, vector array<double>")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "least_id")
    top = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return [(r["query"], r["vector"]) for r in top.select("query", "vector").collect()]


def fit(vectors: DataFrame, n: int, length: int, k: int) -> Index:
    """Centroids from a sample, and the ratio from a few queries against all vectors."""
    longest = vectors.select(F.max(F.sqrt(F.aggregate(
        "embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))).first()[0]
    share = min(1.0, SAMPLE / n)
    by_hash = F.shiftrightunsigned("a", 33) < F.lit(int(share * (1 << 31)))
    sample = vectors.where(by_hash).select("embedding").limit(2 * SAMPLE).toArrow()
    points = _matrix(sample.column(0).combine_chunks(), length)
    points = points[np.lexsort(points.T[::-1])]  # whatever order the rows came in
    lists = int(np.clip(2 * np.sqrt(n), 1, MOST_LISTS))
    index = Index(CentroidGraph(balanced_centroids(lengthened(points, longest), lists)), longest)
    trials = vectors.where("asked").orderBy("a", "b").select("embedding").limit(TRIALS).toArrow()
    queries = _matrix(trials.column(0).combine_chunks(), length)
    if not len(queries):
        return index
    true = _exact_neighbours(vectors, queries, k, length)
    homes = index.homes(np.array([v for _, v in true]))
    zero = np.zeros((len(queries), 1))
    points = np.concatenate([queries, zero], axis=1).astype(np.float32)
    every = np.tile(np.arange(len(index.graph.centroids)), (1, 1))
    gaps = np.concatenate([index.graph.distances(p[None], every) for p in points])
    least = np.maximum(gaps.min(axis=1), 1e-12)
    ratios = np.sort([min(np.sqrt(gaps[q, home] / least[q])) for (q, _), home in zip(true, homes)])
    index.ratio = float(ratios[min(len(ratios) - 1, int(np.ceil(COVER * len(ratios))))]) + 1e-6
    wide = (gaps <= index.ratio ** 2 * least[:, None]).sum(axis=1).max()
    index.width = int(min(len(index.graph.centroids), max(_WIDTH, 2 * wide)))
    return index


def _routed(assigned: DataFrame, index: Index, length: int, least: int) -> DataFrame:
    """(shard, asks, a, b, least_id, embedding, lists): every vector in each of its shards,
    every query in each shard that holds lists it searches."""
    vector_type = assigned.schema["embedding"].dataType.simpleString()
    out = f"shard int, asks boolean, {_VECTOR}, embedding {vector_type}, lists array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ids, vectors, homes, asked = batch.columns
            keys = a.to_numpy(zero_copy_only=False)
            shard, asks, row, lists = [], [], [], []

            def send(at: int, wanted: dict[int, list[int]], is_query: bool) -> None:
                for where, some in wanted.items():
                    shard.append(where)
                    asks.append(is_query)
                    row.append(at)
                    lists.append(some)

            for at, home in enumerate(homes.to_pylist()):
                wanted: dict[int, list[int]] = {}
                for one in home:
                    block = int(keys[at] % index.shards[one])
                    wanted.setdefault(int(index.first_shard[one]) + block, []).append(one)
                send(at, wanted, False)
            queries = np.flatnonzero(asked.to_numpy(zero_copy_only=False))
            if len(queries):
                matrix = _matrix(vectors.take(pa.array(queries)), length)
                for at, found in zip(queries.tolist(), index.probes(matrix, least)):
                    wanted = {}
                    for one in found.tolist():
                        for block in range(int(index.shards[one])):
                            wanted.setdefault(int(index.first_shard[one]) + block, []).append(one)
                    send(at, wanted, True)
            for start in range(0, len(row), 4096):
                cut = slice(start, start + 4096)
                take = pa.array(row[cut], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard[cut], pa.int32()), pa.array(asks[cut], pa.bool_()),
                     a.take(take), b.take(take), ids.take(take), vectors.take(take),
                     pa.array(lists[cut], pa.list_(pa.int32()))],
                    ["shard", "asks", "a", "b", "least_id", "embedding", "lists"])

    return assigned.select("a", "b", "least_id", "embedding", "lists", "asked").mapInArrow(run, out)


def _searched(routed: DataFrame, length: int, k: int) -> DataFrame:
    """(a, b, hits): best vectors of each query in each shard."""

    def members(lists: pa.Array, place: dict[int, int]) -> np.ndarray:
        table = np.zeros((len(lists), len(place)), np.float32)
        for row, some in enumerate(lists.to_pylist()):
            for one in some:
                if one in place:
                    table[row, place[one]] = 1
        return table

    def answer(queries: pa.Table, held: tuple) -> pa.RecordBatch:
        keys, ids, vectors, place, inside = held
        hits = []
        for start in range(0, queries.num_rows, _QUERIES_AT_ONCE):
            some = queries.slice(start, _QUERIES_AT_ONCE)
            asked = _matrix(some.column("embedding").combine_chunks(), length)
            probed = members(some.column("lists").combine_chunks(), place)
            rough = np.where(probed @ inside.T > 0, asked @ vectors.T, -np.inf)
            for at in range(len(asked)):
                rows, exact = _best(asked[at], rough[at], vectors, ids, k)
                hits.append([{"score": s, "least_id": int(ids[r]), "a": int(keys[0][r]),
                              "b": int(keys[1][r])} for r, s in zip(rows, exact.tolist())])
        return pa.RecordBatch.from_arrays(
            [queries.column("a").combine_chunks(), queries.column("b").combine_chunks(),
             pa.array(hits, _HIT)], ["a", "b", "hits"])

    def load(batches: list[pa.Table]) -> tuple:
        table = pa.concat_tables(batches)
        lists = table.column("lists").combine_chunks()
        place = {one: at for at, one in enumerate(sorted(set(lists.flatten().to_pylist())))}
        keys = [table.column(c).to_numpy() for c in ("a", "b")]
        return (keys, table.column("least_id").to_numpy(),
                _matrix(table.column("embedding").combine_chunks(), length), place,
                members(lists, place))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, waiting, held = None, [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            numbers = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(numbers)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(numbers)]):
                if low == high:
                    continue
                if numbers[low] != shard:
                    shard, waiting, held = numbers[low], [], None
                piece = table.slice(low, high - low)
                is_query = piece.column("asks").to_numpy()
                vectors = int((~is_query).sum())  # they come before the queries
                if vectors:
                    waiting.append(piece.slice(0, vectors))
                if vectors < piece.num_rows and waiting:
                    held = load(waiting) if held is None else held
                    yield answer(piece.slice(vectors), held)

    return routed.repartition(partitions(routed), "shard").sortWithinPartitions(
        "shard", "asks").mapInArrow(run, f"a long, b long, hits {_HITS}")


def _merged(hits: DataFrame, k: int) -> DataFrame:
    """(a, b, hits): the ``k`` best of each query from all its shards, each vector once."""

    def best(found: dict) -> list[dict]:
        order = sorted(found.values(), key=lambda h: (-h["score"], h["least_id"]))
        return order[:k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, found = None, {}
        for batch in batches:
            done = []
            for key, more in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()),
                                 batch.column(2).to_pylist()):
                if key != query:
                    if query is not None:
                        done.append((*query, best(found)))
                    query, found = key, {}
                found.update(((h["a"], h["b"]), h) for h in more)
                if len(found) > 64 * k:
                    found = {(h["a"], h["b"]): h for h in best(found)}
            yield _packed(done)
        if query is not None:
            yield _packed([(*query, best(found))])

    def _packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
             pa.array([r[2] for r in rows], _HIT)], ["a", "b", "hits"])

    return hits.repartition(partitions(hits), "a", "b").sortWithinPartitions("a", "b").mapInArrow(
        run, f"a long, b long, hits {_HITS}")


def nearest(embeddings: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of every id divisible by ``every``."""
    spark = embeddings.sparkSession
    usable = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(
        whole(F.col("embedding")) & F.col("vec_id").isNotNull()
        & F.exists("embedding", lambda x: x != 0))
    common = usable.groupBy(F.size("embedding").alias("length")).count().orderBy(
        F.desc("count"), F.desc("length")).first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    length = common["length"]
    rows = usable.where(F.size("embedding") == length).withColumns({
        "a": F.xxhash64("embedding"), "b": F.xxhash64(F.lit("b"), "embedding")})
    is_asked = F.col("vec_id") % every == 0
    vectors = stored(rows.groupBy("a", "b").agg(
        F.min("vec_id").alias("least_id"), F.max(is_asked).alias("asked"),
        F.count("*").alias("n"), F.first("embedding").alias("embedding")), "distinct-vectors")
    # ids of equal vectors: the smallest ones, cut before the shuffle by vector
    repeated = rows.select("vec_id", "a", "b").join(
        vectors.where("n > 1").select("a", "b"), ["a", "b"], "left_semi").distinct()
    by_id = Window.partitionBy("a", "b").orderBy("vec_id")
    copies = repeated.withColumn("place", F.row_number().over(by_id)).where(
        F.col("place") <= k + 1).groupBy("a", "b").agg(
        F.sort_array(F.collect_list("vec_id")).alias("ids"))

    index = fit(vectors, vectors.count(), length, k)
    assigned = stored(_assigned(vectors, index, length), "list-homes")
    lists = len(index.graph.centroids)
    sizes, primary = np.zeros(lists, np.int64), np.zeros(lists, np.int64)
    for row in assigned.select(F.posexplode("lists").alias("place", "list")).groupBy("list").agg(
            F.count("*").alias("n"), F.sum((F.col("place") == 0).cast("long")).alias("first")
    ).collect():
        sizes[row["list"]], primary[row["list"]] = row["n"], row["first"]
    index.place(sizes, primary, max(1, SHARD_BYTES // (8 * max(1, length))), partitions(rows))
    routed = _routed(assigned, index, length, k + 1)
    best = stored(_merged(_searched(routed, length, k + 1), k + 1), "query-hits")

    hit = best.select(F.col("a").alias("qa"), F.col("b").alias("qb"),
                      F.explode("hits").alias("hit")).select("qa", "qb", "hit.*")
    ids = hit.join(copies, ["a", "b"], "left").select("qa", "qb", "score", F.explode(
        F.coalesce("ids", F.array("least_id"))).alias("vec_id"))
    order = Window.partitionBy("qa", "qb").orderBy(F.desc("score"), "vec_id")
    answers = ids.withColumn("place", F.row_number().over(order)).where(
        F.col("place") <= k + 1).groupBy("qa", "qb").agg(F.sort_array(F.collect_list(
            F.struct("place", "vec_id", "score"))).alias("answers"))
    queries = rows.where(is_asked).select(
        F.col("vec_id").alias("query_id"), F.col("a").alias("qa"), F.col("b").alias("qb")).distinct()
    others = F.slice(F.filter("answers", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return queries.join(answers, ["qa", "qb"]).select(
        "query_id", F.posexplode(others).alias("rank", "found")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), "found.vec_id", "found.score")


def _assigned(vectors: DataFrame, index: Index, length: int) -> DataFrame:
    """Vectors with ``lists``, the numbers of their posting lists, the nearest first."""
    kind = vectors.schema["embedding"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            homes = index.homes(_matrix(batch.column(4), length))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(homes, pa.list_(pa.int32()))],
                ["a", "b", "least_id", "asked", "embedding", "lists"])

    return vectors.select("a", "b", "least_id", "asked", "embedding").mapInArrow(
        run, f"{_VECTOR}, asked boolean, embedding {kind}, lists array<int>")
