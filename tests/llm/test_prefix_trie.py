"""Prefix trie against dictionaries of all prefixes."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict
from zlib import crc32

import pytest

from codeloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, sizes string, part int"


def brute(rows):
    """Nodes of the rebuilt conversations, from all their prefixes."""
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is None:
            continue
        role, text = role or "", text or ""
        digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
        own[conv].append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [t[3] for t in sorted(turns)] for c, turns in own.items()}
    full = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        full[c] = own.get(base, [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        size = len(path[-1][1].encode()) if path else 0
        leaves[path] = sum(leaves[k] for k in kids[path]) if kids[path] else 1
        saved[path] = (len(members[path]) - 1) * size + sum(saved[k] for k in kids[path])
    return sorted(
        ((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]),
          len(kids[p]), leaves[p], saved[p],
          hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
         for p in members), key=str)


def _odd_rows():
    rng = random.Random(5)
    rows = []
    for conv in range(-12, 260):
        turns = rng.randint(1, 9)
        for n in range(turns):
            rows.append((conv, n, "user" if n % 2 else None, rng.choice("abc") * rng.randint(0, 2)))
    # copies of one conversation, some with other conversations' openings
    for conv in range(1000, 1400):
        rows += [(conv, n, "user", f"common {n}") for n in range(12)]
    rows += [(5000, n, "user", f"long {n % 7}") for n in range(300)]
    rows += [(5005, n, "user", f"long {n % 7}") for n in range(290)]
    # null and repeated numbers, repeated rows, null values
    rows += [(7000, None, "user", "late"), (7000, None, None, None), (7000, 1, "a", "bc"),
             (7000, 1, "ab", "c"), (7000, 1, "ab", "c"), (None, 1, "user", "lost"),
             (7001, None, None, None), (7002, 0, "ü", "日本"), (7003, -4, "ü", "日本")]
    rng.shuffle(rows)
    return [(*r, "k", "s", 1) for r in rows]


def _found(frame, **how):
    result = prefix_trie.trie(prefix_trie.rebuilt(frame), **how)
    assert result.columns == list(prefix_trie.COLUMNS)
    return sorted((tuple(r) for r in result.collect()), key=str)


@pytest.mark.parametrize("block_bytes", [48, 4000, 1 << 20])
def test_trie_of_odd_conversations(spark, block_bytes):
    rows = _odd_rows()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert _found(frame, block_bytes=block_bytes) == brute(rows)


@pytest.mark.parametrize("rows", [
    [], [(1, 0, "a", "b")], [(4, None, None, None)], [(None, 0, "a", "b")],
    [(c, 0, "a", "b") for c in range(50)],
])
def test_small_tables(spark, rows):
    rows = [(*r, "k", "s", 1) for r in rows]
    assert _found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_layouts_grow_with_the_children():
    rng = random.Random(1)
    for n in (3, 5, 17, 49, 200, 256):
        keys = sorted(bytes([b]) + rng.randbytes(15) for b in range(n))
        keys += [k + rng.randbytes(16) for k in keys[:2]]
        keys = sorted(keys + keys[:3])
        root = prefix_trie.radix_tree(keys)
        assert root.layout == next(w for w in (4, 16, 48, 256) if w >= n)

        def walk(node, path):
            path += node.path
            if node.ends:
                yield path, node.ends
            for kid in node.children():
                assert node.child(kid.path[0]) is kid
                yield from walk(kid, path)

        found = [path for path, (low, high) in walk(root, b"") for _ in range(low, high)]
        assert found == keys
