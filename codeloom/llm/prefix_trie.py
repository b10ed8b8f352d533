"""Prefix trie of conversations: which openings are shared, by whom, and what sharing saves.

A turn is known by 16 bytes, a big-endian id made from role and text (a digest, so no join
numbers the turns; different turns share an id with a chance of 2^-128). A conversation is the
run of its turns' ids. All of these keys are sorted once over the cluster, by key and then by
conversation, so that a common opening or a conversation with very many copies spreads over
tasks. Each task puts its keys, block by block, into an adaptive radix tree; only depths that
are a whole number of turns are nodes of the trie.

A node lies in more than one block only if it is on the path of a block's first or last key.
What blocks say about such a node (members, children that no earlier block has, leaves, bytes)
adds up, so parts of nodes are summed by the digest of their path. Nothing else is merged.

Null roles and texts count as empty. Turns are ordered by number, null first; repeated numbers
by turn id, which is the same whatever order the rows come in. Rows without a conversation id
belong to no conversation and are left out. Equal rows are turns of their own. Only the named
columns are read, so others may have any name. Texts are read where they lie; a conversation's
ids and lengths (24 bytes a turn) are one row, which holds up to some 80 million turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.tables import partitions, stored, text_of
from codeloom.session import cut_lineage

#: Bytes of a turn id.
WIDTH = 16
#: A tree holds keys of this many bytes and so many conversations at most (or one key).
BLOCK_BYTES = 4 << 20
BLOCK_ROWS = 1 << 16

EMPTY_HASH = hashlib.sha256(b"").hexdigest()
_OUT = ("kind int, node binary, parent_node binary, conv_id long, depth long, "
        "parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends string, part int, seq long")
_WHOLE, _PART, _ENDS = 0, 1, 2
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
           "saved_tokens", "ends_sha256")


def turn_id(role: Column, text: Column) -> Column:
    """16 bytes for a turn; the length of the role keeps role and text apart."""
    return F.unhex(F.md5(F.concat(
        F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def shared_openings(conv_id: Column) -> tuple[Column, Column]:
    """(base, length): conversation and number of its first turns that replace a
    conversation's own ones."""
    return conv_id - conv_id % 5, (F.crc32(conv_id.cast("string").cast("binary")) % 9).cast("int")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, key, sizes): conversations that begin with the first turns of their base.

    One shuffle, by the base, of ids and lengths; texts stay where they are.
    """
    role, text = text_of("role"), text_of("text")
    base, _ = shared_openings(F.col("conv_id"))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), base.cast("long").alias("base"),
        F.struct(
            F.col("turn").isNotNull().alias("numbered"), F.col("turn").alias("turn"),
            turn_id(role, text).alias("id"), F.octet_length(text).alias("bytes"),
        ).alias("turn"))
    ordered = rows.repartition(partitions(turns), "base").groupBy("base", "conv_id").agg(
        F.array_sort(F.collect_list("turn")).alias("own"))
    _, taken = shared_openings(F.col("conv_id"))
    of_base = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, 8))).over(
        Window.partitionBy("base"))
    opened = ordered.select("conv_id", "own", taken.alias("h"), of_base.alias("first"))
    none = F.slice("own", 1, 0)
    turns_now = F.concat(
        F.slice(F.coalesce("first", none), F.lit(1), F.col("h")),
        F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0))))
    return opened.select("conv_id", turns_now.alias("turns")).select(
        "conv_id",
        F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), "")).alias("key"),
        F.transform("turns", lambda t: t["bytes"]).alias("sizes"))


class _Node:
    """A node of an adaptive radix tree.

    ``path`` are the bytes that lead to it from its parent, the branching byte first. Children
    lie in one of four layouts by their number: up to 4 and up to 16 with a sorted list of
    bytes, up to 48 with a table from byte to place, and one place per byte.
    """

    __slots__ = ("path", "layout", "bytes", "kids", "ends")

    def __init__(self, path: bytes, ends: tuple[int, int] | None = None):
        self.path, self.ends = path, ends
        self.layout, self.bytes, self.kids = 4, bytearray(), []

    def child(self, byte: int) -> _Node | None:
        if self.layout <= 16:
            at = self.bytes.find(byte)
            return self.kids[at] if at >= 0 else None
        if self.layout == 48:
            at = self.bytes[byte]
            return self.kids[at - 1] if at else None
        return self.kids[byte]

    def put(self, kid: _Node) -> None:
        """Add a child, or put it in the place of the one with the same first byte."""
        byte = kid.path[0]
        if self.layout <= 16:
            at = self.bytes.find(byte)
            if at >= 0:
                self.kids[at] = kid
                return
            if len(self.kids) < self.layout:
                at = sum(b < byte for b in self.bytes)
                self.bytes.insert(at, byte)
                self.kids.insert(at, kid)
                return
            self._grow()
            self.put(kid)
        elif self.layout == 48:
            at = self.bytes[byte]
            if at:
                self.kids[at - 1] = kid
            elif len(self.kids) < 48:
                self.kids.append(kid)
                self.bytes[byte] = len(self.kids)
            else:
                self._grow()
                self.put(kid)
        else:
            self.kids[byte] = kid

    def _grow(self) -> None:
        if self.layout == 4:
            self.layout = 16
        elif self.layout == 16:
            places = bytearray(256)
            for at, byte in enumerate(self.bytes):
                places[byte] = at + 1
            self.layout, self.bytes = 48, places
        else:
            kids: list[_Node | None] = [None] * 256
            for kid in self.kids:
                kids[kid.path[0]] = kid
            self.layout, self.bytes, self.kids = 256, bytearray(), kids

    def children(self) -> list[_Node]:
        if self.layout <= 16:
            return self.kids
        if self.layout == 48:
            return [self.kids[at - 1] for at in self.bytes if at]
        return [kid for kid in self.kids if kid is not None]


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def radix_tree(keys: list[bytes]) -> _Node:
    """Adaptive radix tree of ``keys``; equal keys, which lie together, end in one node."""
    root, first = _Node(b""), 0
    while first < len(keys):
        key, end = keys[first], first + 1
        while end < len(keys) and keys[end] == key:
            end += 1
        node, parent, at = root, None, 0
        while True:
            path = node.path
            fits = key.startswith(path, at)
            same = len(path) if fits else _common(key[at:at + len(path)], path)
            if not fits:  # the compressed path divides here
                upper = _Node(path[:same])
                node.path = path[same:]
                upper.put(node)
                parent.put(upper)
                node = upper
            at += same
            if at == len(key):
                node.ends = (first, end)
                break
            below = node.child(key[at])
            if below is None:
                node.put(_Node(key[at:], (first, end)))
                break
            node, parent = below, node
        first = end
    return root


def _path_digests(key: bytes, depth: int) -> list[bytes]:
    """Digest of the path to each depth from 0 on."""
    running, found = hashlib.md5(), []
    for d in range(depth + 1):
        if d:
            running.update(key[(d - 1) * WIDTH:d * WIDTH])
        found.append(running.copy().digest())
    return found


def trie_nodes(keys: list[bytes], convs: list[int], sizes: list, before: int, after: int,
               part: int, block: int) -> dict[str, list]:
    """Nodes of the trie of one block of sorted keys, as columns.

    ``before`` and ``after`` are the turns that the first key has in common with the key before
    the block, the last one with the key after it; -1 if there is none. Nodes up to these
    depths also lie in other blocks: of these only the parts are given, to be added up.
    """
    out: dict[str, list] = {name.split()[0]: [] for name in _OUT.split(", ")}
    heads = _path_digests(keys[0], max(before, 0))
    tails = _path_digests(keys[-1], max(after, 0))
    total = len(keys)

    def emit(depth: int, state: dict, ends: tuple[int, int] | None) -> None:
        """Add the node at ``depth`` above what ``state`` has found so far."""
        in_first = state["lo"] == 0 and depth <= before
        in_last = state["hi"] == total and depth <= after
        size = sizes[state["lo"]][depth - 1] if depth else 0
        n = state["hi"] - state["lo"]
        if not state["tops"] and not in_last:
            state["leaves"] += 1
        state["saved"] += (n if in_first else n - 1) * size
        shared = in_first or in_last
        digests = heads if in_first else tails
        for row in state["tops"]:
            if shared:
                out["parent_node"][row] = digests[depth]
            else:
                out["parent_conv_id"][row] = state["conv"]
        members = ",".join(map(str, convs[ends[0]:ends[1]])) if ends else ""
        if shared and ends:
            _append(out, kind=_ENDS, node=digests[depth], ends=members, part=part, seq=block)
        _append(
            out, kind=_PART if shared else _WHOLE, node=digests[depth] if shared else None,
            conv_id=state["conv"], depth=depth, n_convs=n, n_children=state["new"],
            n_leaves=state["leaves"], saved_tokens=state["saved"],
            ends=None if shared else hashlib.sha256(members.encode()).hexdigest())
        state["tops"], state["new"] = [len(out["kind"]) - 1], 0 if in_first else 1

    def fresh(ends: tuple[int, int] | None) -> dict:
        state = {"lo": total, "hi": 0, "conv": None, "leaves": 0, "saved": 0, "tops": [],
                 "new": 0}
        if ends:
            state |= {"lo": ends[0], "hi": ends[1], "conv": convs[ends[0]]}
        return state

    root = radix_tree(keys)
    stack = [(root, 0, iter(root.children()), fresh(root.ends))]
    while stack:
        node, start, kids, state = stack[-1]
        below = next(kids, None)
        if below is not None:
            stack.append((below, start + len(node.path), iter(below.children()),
                          fresh(below.ends)))
            continue
        stack.pop()
        end, ends = start + len(node.path), node.ends
        for depth in range(end // WIDTH, start // WIDTH if start or node.path else -1, -1):
            emit(depth, state, ends)
            ends = None
        if stack:
            above = stack[-1][3]
            above["lo"], above["hi"] = min(above["lo"], state["lo"]), max(above["hi"], state["hi"])
            above["conv"] = state["conv"] if above["conv"] is None else min(
                above["conv"], state["conv"])
            above["leaves"] += state["leaves"]
            above["saved"] += state["saved"]
            above["new"] += state["new"]
            if len(above["tops"]) < len(state["tops"]):
                above["tops"], state["tops"] = state["tops"], above["tops"]
            above["tops"].extend(state["tops"])
    return out


def _append(out: dict[str, list], **values) -> None:
    for name, column in out.items():
        column.append(values.get(name))


def _sorted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(name).to_pylist()
                         for name in ("_part", "key", "conv_id", "sizes")))


def _same_turns(a: bytes, b: bytes) -> int:
    return _common(a, b) // WIDTH


def _blocks(rows: Iterator[tuple], neighbours: dict[int, tuple[int, int]], limit: int
            ) -> Iterator[pa.RecordBatch]:
    schema = _arrow_schema()
    keys: list[bytes] = []
    convs: list[int] = []
    sizes: list = []
    held, block, before, part = 0, 0, None, None

    def done(after: int) -> pa.RecordBatch:
        found = trie_nodes(keys, convs, sizes, before, after, part, block)
        return pa.RecordBatch.from_pydict(found, schema=schema)

    for number, key, conv, lengths in rows:
        if part is None:
            part, before = number, neighbours[number][0]
        elif held + len(key) > limit or len(keys) == BLOCK_ROWS:
            common = _same_turns(keys[-1], key)
            yield done(common)
            keys, convs, sizes, held, before, block = [], [], [], 0, common, block + 1
        keys.append(key)
        convs.append(conv)
        sizes.append(lengths)
        held += len(key)
    if keys:
        yield done(neighbours[part][1])


def _arrow_schema() -> pa.Schema:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(name, types[kind]) for name, kind in
                      (column.split() for column in _OUT.split(", "))])


def _neighbours(placed: DataFrame) -> dict[int, tuple[int, int]]:
    """Per partition the turns that its first key has in common with the key before, and its
    last key with the one after: two numbers for each partition come to the driver."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for batch in batches:
            if batch.num_rows:
                first = batch.slice(0, 1) if first is None else first
                last = batch.slice(batch.num_rows - 1, 1)
        if first is not None:
            yield pa.RecordBatch.from_arrays(
                [first.column(0), first.column(1), last.column(1)], ["part", "first", "last"])

    edges = placed.select("_part", "key").mapInArrow(ends, "part int, first binary, last binary")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        previous = None
        for batch in batches:
            rows = [], [], []
            for part, first, last in zip(*(column.to_pylist() for column in batch.columns)):
                if previous is not None:
                    common = _same_turns(previous[1], first)
                    for column, value in zip(rows, (previous[0], part, common)):
                        column.append(value)
                previous = part, last
            yield pa.RecordBatch.from_pydict(
                {"left": pa.array(rows[0], pa.int32()), "right": pa.array(rows[1], pa.int32()),
                 "common": pa.array(rows[2], pa.int32())})

    # as many rows as partitions
    in_order = edges.repartition(1).sortWithinPartitions("part")
    found = in_order.mapInArrow(compare, "left int, right int, common int").collect()
    before = {row["right"]: row["common"] for row in found}
    after = {row["left"]: row["common"] for row in found}
    return {part: (before.get(part, -1), after.get(part, -1)) for part in before | after}


def _ends_of_parts(pieces: DataFrame) -> DataFrame:
    """(node, ends): digest of the members' ids that several blocks hold, block after block."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, running = None, None
        for batch in batches:
            nodes, ends = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if key != node:
                    if node is not None:
                        nodes.append(node)
                        ends.append(running.hexdigest())
                    node, running = key, hashlib.sha256(text.encode())
                else:
                    running.update(b"," + text.encode())
            yield pa.RecordBatch.from_pydict(
                {"node": pa.array(nodes, pa.binary()), "ends": pa.array(ends, pa.string())})
        if node is not None:
            yield pa.RecordBatch.from_pydict(
                {"node": pa.array([node], pa.binary()),
                 "ends": pa.array([running.hexdigest()], pa.string())})

    return pieces.select("node", "part", "seq", "ends").repartition(
        partitions(pieces), "node").sortWithinPartitions("node", "part", "seq").mapInArrow(
        digest, "node binary, ends string")


def trie(paths: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Nodes of the trie of ``paths`` (conv_id, key, sizes): one row per distinct prefix of
    whole turns, with the columns of ``COLUMNS``. No conversations, no nodes."""
    placed = cut_lineage(
        paths.select("key", "conv_id", "sizes").orderBy("key", "conv_id")
        .withColumn("_part", F.spark_partition_id()))
    neighbours = _neighbours(placed)
    alone = (-1, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class Known(dict):
            def __missing__(self, key: int) -> tuple[int, int]:
                return alone

        yield from _blocks(_sorted_rows(batches), Known(neighbours), block_bytes)

    found = stored(placed.mapInArrow(run, _OUT), "trie-nodes")
    parts = found.where(f"kind = {_PART}").groupBy("node", "depth").agg(
        F.max("parent_node").alias("parent_node"), F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    ends = _ends_of_parts(found.where(f"kind = {_ENDS}"))
    parts = cut_lineage(parts.join(ends, "node", "left").withColumn(
        "ends", F.coalesce("ends", F.lit(EMPTY_HASH))))
    whole = found.where(f"kind = {_WHOLE}")
    columns = ["conv_id", "depth", "parent_node", "n_convs", "n_children", "n_leaves",
               "saved_tokens", "ends"]
    # the few shared nodes are the parents of what the blocks could not say themselves
    open_ = whole.where("parent_node is not null").select(*columns).unionByName(
        parts.where("depth > 0").select(*columns))
    known = parts.select(F.col("node").alias("parent_node"),
                         F.col("conv_id").alias("parent_conv_id"))
    top = parts.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    done = whole.where("parent_node is null").unionByName(top, allowMissingColumns=True)
    return done.unionByName(open_.join(known, "parent_node"), allowMissingColumns=True).select(
        *COLUMNS[:-1], F.col("ends").alias("ends_sha256"))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """Trie of the rebuilt conversations of ``turns`` (conv_id, turn, role, text)."""
    return trie(rebuilt(turns))


#: The same by lists of turn ids per prefix; crc32 bit by bit.
SQL = """
WITH turns AS (
  SELECT conv_id, turn, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '')
           || coalesce(text, '')) AS id, strlen(coalesce(text, '')) AS bytes
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS n
        FROM turns),
convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''),
      lambda c: list_transform(range(8), lambda i: (ascii(c) >> i::INTEGER) & 1)))),
    lambda a, b: xor(a >> 1, (xor(a, b) & 1) * 3988292384))) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM own)),
joined AS (
  SELECT c.conv_id, 0 AS half, o.n, o.id, o.bytes
  FROM convs c JOIN own o ON o.conv_id = c.base AND o.n <= c.h
  UNION ALL
  SELECT c.conv_id, 1, o.n, o.id, o.bytes
  FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.n > c.h),
turn_at AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY half, n) AS depth
            FROM joined),
paths AS (
  SELECT conv_id, depth, bytes,
    md5(string_agg(id, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS path
  FROM turn_at
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
ended AS (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY ALL),
nodes AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)
           FILTER (e.depth IS NOT NULL), '')) AS ends_sha256
  FROM paths LEFT JOIN ended e USING (conv_id, depth) GROUP BY depth, path),
linked AS (
  SELECT n.*, up.path AS up_path, up_node.conv_id AS parent_conv_id
  FROM nodes n LEFT JOIN paths up ON up.conv_id = n.conv_id AND up.depth = n.depth - 1
  LEFT JOIN nodes up_node ON up_node.path = up.path AND up_node.depth = up.depth),
kids AS (SELECT depth - 1 AS depth, up_path AS path, count(*) AS n FROM linked
         WHERE depth > 0 GROUP BY ALL),
below AS (
  SELECT up.depth, up.path, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS n_leaves,
    sum((n.n_convs - 1) * n.bytes) AS saved
  FROM nodes n JOIN paths up ON up.conv_id = n.conv_id AND up.depth <= n.depth
  LEFT JOIN kids k ON k.depth = n.depth AND k.path = n.path GROUP BY ALL)
SELECT l.conv_id, l.depth::BIGINT AS depth, l.parent_conv_id, l.n_convs,
  coalesce(k.n, 0)::BIGINT AS n_children, b.n_leaves::BIGINT AS n_leaves,
  b.saved::BIGINT AS saved_tokens, l.ends_sha256
FROM linked l JOIN below b ON b.depth = l.depth AND b.path = l.path
LEFT JOIN kids k ON k.depth = l.depth AND k.path = l.path
"""
