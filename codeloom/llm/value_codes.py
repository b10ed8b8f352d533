"""Compression of vectors to eight code bytes, with distances from value dictionaries.

Components become integers. A block of vectors is kept as a dictionary per dimension, its
distinct integers in order, and the number of each component in its dictionary. For a codebook
the squared differences of every distinct integer to all entries are tabulated once per block;
the distance of a part to the entries is then gathered from these tables and added up, without
touching the vectors again. Dictionaries belong to blocks, so they are never larger than a
block, whatever values a large table holds, and nothing about values goes over the network.

Every round is one job over the stored blocks. Tasks add up their blocks and give one sum per
entry and component, which are added before 16 times the dimension of them come to the driver.

Vectors that are null or hold null or non-finite components are left out, and so are those that
do not have the commonest length (the longer one in a tie): parts of them could not be compared.
If eight does not divide the length, part p takes the components from p * n // 8 on. Integers
beyond 2^27 in size count as 2^27, so that distances stay exact. Null ids come last in the
order of ids, equal ids go by their vectors; repeated rows are rows. Fewer than 16 vectors give
fewer entries. Only vec_id, embedding and label are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm.tables import stored

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Vectors of a block: numbers of its dictionaries fit 16 bits.
BLOCK_ROWS = 1 << 15
LARGEST = 1 << 27


def whole(vector: Column) -> Column:
    """Whether a vector has finite components only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite


def integers(vectors: np.ndarray) -> np.ndarray:
    scaled = np.floor(vectors.astype(np.float64) * SCALE)
    return np.clip(scaled, -LARGEST, LARGEST).astype(np.int64)


def part_bounds(length: int) -> list[tuple[int, int]]:
    return [(p * length // PARTS, (p + 1) * length // PARTS) for p in range(PARTS)]


class Block:
    """Vectors as numbers in a dictionary per dimension."""

    def __init__(self, numbers: np.ndarray, dictionaries: list[np.ndarray]):
        self.numbers, self.dictionaries = numbers, dictionaries

    @classmethod
    def of(cls, values: np.ndarray) -> Block:
        found = [np.unique(column, return_inverse=True) for column in values.T]
        numbers = np.array([n.reshape(-1) for _, n in found], np.uint16)
        return cls(numbers.reshape(values.shape[1], len(values)), [d for d, _ in found])

    @classmethod
    def read(cls, numbers: bytes, values: list[int], sizes: list[int], rows: int) -> Block:
        cuts = np.cumsum(sizes)[:-1]
        dictionaries = np.split(np.array(values, np.int64), cuts) if sizes else []
        return cls(np.frombuffer(numbers, np.uint16).reshape(len(sizes), rows), dictionaries)

    def nearest(self, codebooks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of every vector and part; the lower entry in a tie."""
        rows = self.numbers.shape[1]
        entries = np.zeros((rows, PARTS), np.uint8)
        distances = np.zeros((rows, PARTS), np.int64)
        for part, (low, high) in enumerate(part_bounds(len(self.dictionaries))):
            book = codebooks[part]
            total = np.zeros((rows, len(book)), np.int64)
            for at in range(low, high):
                table = (self.dictionaries[at][:, None] - book[None, :, at - low]) ** 2
                total += table[self.numbers[at]]
            best = total.argmin(axis=1)
            entries[:, part] = best
            distances[:, part] = total[np.arange(rows), best]
        return entries, distances

    def sums(self, entries: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(count per part and entry, sum per dimension and entry). A vector counts through
        its number: the dictionary is added up by how often each entry has a number."""
        counts = np.array([np.bincount(e, minlength=size) for e in entries.T], np.int64)
        sums = np.zeros((len(self.dictionaries), size), np.int64)
        for part, (low, high) in enumerate(part_bounds(len(self.dictionaries))):
            for at in range(low, high):
                values = self.dictionaries[at]
                seen = np.bincount(
                    entries[:, part].astype(np.int64) * len(values) + self.numbers[at],
                    minlength=size * len(values)).reshape(size, len(values))
                sums[at] = seen @ values
        return counts, sums


def _vectors(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), length)


def blocks(rows: DataFrame, length: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_ids, labels, numbers, values, sizes): one row per block of vectors."""
    types = {f.name: f.dataType for f in rows.schema.fields}
    out = T.StructType([
        T.StructField("vec_ids", T.ArrayType(types["vec_id"])),
        T.StructField("labels", T.ArrayType(types["label"])),
        T.StructField("numbers", T.BinaryType()),
        T.StructField("values", T.ArrayType(T.LongType())),
        T.StructField("sizes", T.ArrayType(T.IntegerType())),
    ])

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        ids, labels, vectors = (table.column(i).combine_chunks() for i in range(3))
        block = Block.of(integers(_vectors(vectors, length)))
        lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c)
                 for c in (ids, labels)]
        values = np.concatenate([np.zeros(0, np.int64), *block.dictionaries])
        return pa.RecordBatch.from_arrays([
            *lists, pa.array([block.numbers.tobytes()], pa.binary()),
            pa.array([values.tolist()], pa.list_(pa.int64())),
            pa.array([[len(d) for d in block.dictionaries]], pa.list_(pa.int32())),
        ], out.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            while batch.num_rows:
                some = batch.slice(0, block_rows - n)
                held.append(some)
                n += some.num_rows
                batch = batch.slice(some.num_rows)
                if n == block_rows:
                    yield packed(held)
                    held, n = [], 0
        if held:
            yield packed(held)

    return rows.select("vec_id", "label", "embedding").mapInArrow(run, out)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, Block]]:
    for batch in batches:
        for at in range(batch.num_rows):
            ids, labels = (batch.column(i).slice(at, 1).flatten() for i in range(2))
            numbers, values, sizes = (batch.column(i)[at].as_py() for i in (2, 3, 4))
            yield ids, labels, Block.read(numbers, values, sizes, len(ids))


def _summed(packed: DataFrame, codebooks: list[np.ndarray], length: int) -> DataFrame:
    """(dimension, entry, n, total) over all blocks, added up in the tasks first."""
    size = len(codebooks[0])
    part_of = np.zeros(length, np.int64)
    for part, (low, high) in enumerate(part_bounds(length)):
        part_of[low:high] = part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((PARTS, size), np.int64), np.zeros((length, size), np.int64)
        for _, _, block in _read(batches):
            more = block.sums(block.nearest(codebooks)[0], size)
            counts += more[0]
            sums += more[1]
        yield pa.RecordBatch.from_pydict({
            "dimension": np.repeat(np.arange(length, dtype=np.int32), size),
            "entry": np.tile(np.arange(size, dtype=np.int32), length),
            "n": counts[part_of].reshape(-1), "total": sums.reshape(-1)})

    parts = packed.mapInArrow(run, "dimension int, entry int, n long, total long")
    return parts.groupBy("dimension", "entry").agg(F.sum("n").alias("n"),
                                                   F.sum("total").alias("total"))


def fit(packed: DataFrame, first: list[list[float]], length: int, rounds: int = ROUNDS
        ) -> list[np.ndarray]:
    """Codebooks (entry, component) of each part, from the vectors that start them."""
    start = integers(np.array(first, np.float64).reshape(len(first), length))
    codebooks = [start[:, low:high].copy() for low, high in part_bounds(length)]
    for _ in range(rounds if length else 0):
        moved = [book.copy() for book in codebooks]
        for dimension, entry, n, total in _summed(packed, codebooks, length).collect():
            part = next(p for p, (low, high) in enumerate(part_bounds(length))
                        if low <= dimension < high)
            if n:
                moved[part][entry, dimension - part_bounds(length)[part][0]] = total // n
        codebooks = moved
    return codebooks


def coded(packed: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error) of every vector."""
    types = {f.name: f.dataType.elementType for f in packed.schema.fields[:2]}
    out = T.StructType([
        T.StructField("vec_id", types["vec_ids"]), T.StructField("label", types["labels"]),
        T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, block in _read(batches):
            entries, distances = block.nearest(codebooks)
            digits = entries.tobytes().hex()
            width = 2 * PARTS
            codes = [digits[i:i + width] for i in range(0, len(digits), width)]
            yield pa.RecordBatch.from_arrays(
                [ids, labels, pa.array(codes, pa.string()), pa.array(distances.sum(axis=1))],
                out.fieldNames())

    return packed.mapInArrow(run, out)


def codebooks_digest(codebooks: list[np.ndarray]) -> str:
    numbers = [str(v) for book in codebooks for v in book.reshape(-1).tolist()]
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def compressed(embeddings: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector that takes part."""
    rows = embeddings.select("vec_id", "label", "embedding").where(whole(F.col("embedding")))
    lengths = rows.groupBy(F.size("embedding").alias("length")).count()
    common = lengths.orderBy(F.desc("count"), F.desc("length")).first()
    length = common["length"] if common else 0
    rows = rows.where(F.size("embedding") == length)
    first = [r["embedding"] for r in rows.orderBy(
        F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).collect()]
    packed = stored(blocks(rows, length, block_rows), "value-blocks")
    if not first:
        none = rows.select("vec_id", "label", F.lit("").alias("code"),
                           F.lit(0).cast("long").alias("error"))
        found, digest = none, codebooks_digest([])
    else:
        codebooks = fit(packed, first, length)
        digest = codebooks_digest(codebooks)
        found = stored(coded(packed, codebooks), "value-codes")
    labels = found.groupBy(F.col("label").alias("_label")).agg(
        F.sum("error").alias("label_error"))
    return found.join(labels, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """The same with one row per component."""
    steps = ["""
WITH kept AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
wide AS (SELECT *, len(embedding) // 8 AS width FROM kept),
comp AS MATERIALIZED (
  SELECT r, (i - 1) // width AS part, (i - 1) % width AS pos,
    floor(4096 * embedding[i]::DOUBLE)::BIGINT AS v
  FROM (SELECT *, unnest(generate_series(1, len(embedding))) AS i FROM wide)),
book0 AS MATERIALIZED (SELECT r AS entry, part, pos, v FROM comp WHERE r < 16)"""]
    for k in range(ROUNDS + 1):
        steps.append(f"""
near{k} AS MATERIALIZED (
  SELECT r, part, min(struct_pack(d := d, entry := entry)) AS best FROM (
    SELECT c.r, c.part, b.entry, sum((c.v - b.v) * (c.v - b.v))::BIGINT AS d
    FROM comp c JOIN book{k} b USING (part, pos) GROUP BY ALL) GROUP BY ALL)""")
        if k < ROUNDS:
            steps.append(f"""
book{k + 1} AS MATERIALIZED (
  SELECT b.entry, b.part, b.pos, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN (
    SELECT n.best.entry AS entry, c.part, c.pos, floor(sum(c.v) / count(*))::BIGINT AS v
    FROM comp c JOIN near{k} n USING (r, part) GROUP BY ALL) m USING (entry, part, pos))""")
    steps.append(f"""
codes AS (
  SELECT r, string_agg(lpad(to_hex(best.entry), 2, '0'), '' ORDER BY part) AS code,
    sum(best.d)::BIGINT AS error FROM near{ROUNDS} GROUP BY r),
digest AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) AS sha
           FROM book{ROUNDS})""")
    return ",".join(steps) + """
SELECT vec_id, lower(code) AS code, error,
  (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha AS codebooks_sha256
FROM kept JOIN codes USING (r), digest
"""


SQL = _sql()
