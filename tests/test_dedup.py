"""Duplicates against brute force, with one text that a third of all documents share."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from codeloom.operators import dedup


def corpus():
    """Copies, near copies (one word changed) and unrelated texts; a third of one kind."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(words, k=60)) for _ in range(12)]
    docs = []
    for i in range(180):
        if i % 3 == 0:
            text = base[0] + (" tail" if i % 2 else "") + "  " * (i % 4)
        elif i % 3 == 1:
            text = base[1 + i % 11].split()
            text[rng.randrange(60)] = f"x{i}"
            text = " ".join(text)
        else:
            text = " ".join(rng.choices(words, k=rng.randint(1, 50)))
        docs.append((i, text.upper() if i % 5 == 0 else text))
    return docs


def norm(text):
    return re.sub(r"\s+", " ", text.lower()).strip(" ")


def runs(text):
    w = norm(text).split(" ")
    return {tuple(w[i:i + 3]) for i in range(max(len(w) - 2, 1))}


def similarity(a, b):
    return len(a & b) / len(a | b)


def test_exact(spark):
    docs = corpus()
    kept = dedup.drop_exact_duplicates(
        spark.createDataFrame(docs, "doc_id long, text string")).collect()
    best = {}
    for i, text in docs:
        best[norm(text)] = max(best.get(norm(text), (-1, -1)), (len(text), i))
    assert sorted(r["doc_id"] for r in kept) == sorted(i for _, i in best.values())


def test_shingles_and_jaccard(spark):
    df = spark.createDataFrame(
        [("a b c d", "A  b c\nd x"), ("one", "one"), ("a b", "b a")], "a string, b string")
    got = df.select(dedup.jaccard(dedup.shingles(F.col("a")), dedup.shingles(F.col("b")))).collect()
    assert [r[0] for r in got] == [2 / 3, 1.0, 0.0]


def leader_links(buckets, sets, threshold):
    """The same rounds in plain Python."""
    linked = set()
    members = {b: set(ids) for b, ids in buckets.items()}
    for ids in members.values():
        n = 1
        while len(ids) > 1:
            leaders = sorted(ids)[:n]
            like = {(i, k) for k in leaders for i in ids
                    if i > k and similarity(sets[i], sets[k]) >= threshold}
            linked |= like
            ids -= {i for i, _ in like} | set(leaders)
            n *= 2
    return linked


def test_near_links_equal_plain_rounds(spark):
    docs = [d for d in corpus()]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    hashes = dedup.shingles(F.col("text"))
    buckets = {}
    for row in dedup.bucket_members(dedup.signatures(df, "doc_id", hashes)).collect():
        buckets.setdefault(row["bucket"], []).append(row["id"])
    wanted = leader_links(buckets, {i: runs(t) for i, t in docs}, 0.8)
    got = dedup.near_duplicate_links(df, "doc_id", hashes, 0.8).collect()
    assert {(r["id"], r["leader"]) for r in got} == wanted
    assert all(r["jaccard"] >= 0.8 for r in got)


def test_hot_bucket_of_unlike_documents_ends_soon(spark, monkeypatch):
    """Texts that share most of their words, yet are no near copies, fill every bucket."""
    rng = random.Random(4)
    common = [f"c{i}" for i in range(60)]
    docs = [(i, " ".join(common + [f"u{i}x{k}" for k in range(16)])) for i in range(600)]
    # two near copies among them, and many copies of one text
    docs += [(1000 + i, docs[i][1] + " end") for i in range(5)]
    docs += [(2000 + i, " ".join(f"k{k}" for k in range(80)) + f" v{i}") for i in range(120)]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    hashes = dedup.shingles(F.col("text"))
    sizes = dedup.bucket_members(dedup.signatures(df, "doc_id", hashes)).groupBy("bucket").count()
    largest = sizes.agg(F.max("count")).first()[0]
    cuts = []
    real = dedup.cut_lineage
    monkeypatch.setattr(dedup, "cut_lineage", lambda d: cuts.append(1) or real(d))
    got = dedup.near_duplicate_links(df, "doc_id", hashes, 0.85).collect()
    rounds = len(cuts) // 2  # two checkpoints per round
    assert rounds < max(largest / 4, 8), (rounds, largest)
    linked = {(r["id"], r["leader"]) for r in got}
    sets = {i: runs(t) for i, t in docs}
    assert all(similarity(sets[a], sets[b]) >= 0.85 for a, b in linked)
    assert {(1000 + i, i) for i in range(5)} <= linked
    assert {(2000 + i, 2000) for i in range(1, 120)} <= linked


def test_near_groups_follow_similarity(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r["id"]: r for r in dedup.near_duplicate_groups(df, threshold=0.8).collect()}
    assert set(rows) == {i for i, _ in docs}
    sets = {i: runs(t) for i, t in docs}
    group = {i: r["group_id"] for i, r in rows.items()}
    # the planted copies are one group, with and without the added word
    assert len({group[i] for i, _ in docs if i % 3 == 0}) == 1
    # who is close to nobody stays alone; groups keep exactly one document
    for i, s in sets.items():
        if all(similarity(s, o) < 0.8 for j, o in sets.items() if j != i):
            assert group[i] == i and rows[i]["kept"]
    kept = [r["group_id"] for r in rows.values() if r["kept"]]
    assert sorted(kept) == sorted(set(group.values()))
    # nearly all close pairs are found
    close = [(i, j) for i in sets for j in sets if i < j and similarity(sets[i], sets[j]) >= 0.9]
    assert sum(group[i] == group[j] for i, j in close) >= 0.99 * len(close)


def test_connected_labels_of_a_long_chain(spark):
    links = [(i + 1, i) for i in range(40)] + [(101, 100), (103, 102), (103, 100)]
    df = spark.createDataFrame(links, "id long, leader long")
    labels = {r["id"]: r["label"] for r in dedup.connected_labels(df).collect()}
    assert labels == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 104)}}


def test_keep_best_takes_longest_then_latest(spark):
    df = spark.createDataFrame(
        [("a", "xx", 1), ("a", "yy", 2), ("a", "z", 9), ("b", "q", 1)],
        "k string, body string, at int")
    kept = dedup.keep_best(df, ["k"], [F.length("body"), "at"]).collect()
    assert sorted(tuple(r) for r in kept) == [("a", "yy", 2), ("b", "q", 1)]


def test_union_needed(spark):
    df = spark.createDataFrame(
        [(["b", "a", "b"], ["c", "a"]), (None, ["x"]), (["y"], None)],
        "n array<string>, f array<string>")
    got = df.select(dedup.union_needed(F.col("n"), F.col("f"))).collect()
    assert [r[0] for r in got] == [["b", "a", "c"], ["x"], ["y"]]


def test_boilerplate_loses_no_pair_and_null_texts_stay(spark):
    """Near copies among texts that share most words are linked however large their bucket."""
    rng = random.Random(9)
    common = [f"c{i}" for i in range(40)]
    docs = []
    for i in range(500):
        own = [f"u{i}x{k}" for k in range(20)]
        docs += [(i, " ".join(common + own)), (5000 + i, " ".join(common + own + ["end"]))]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs + [(9000, None), (9001, None)], "doc_id long, text string")
    rows = {r["id"]: r for r in dedup.near_duplicate_groups(df).collect()}
    assert len(rows) == 1002 and rows[9000]["kept"] and rows[9001]["kept"]
    assert all(rows[5000 + i]["group_id"] == rows[i]["group_id"] for i in range(500))
    assert len({r["group_id"] for r in rows.values()}) == 502


def all_pair_groups(docs, threshold):
    """Smallest id of each component of all pairs."""
    sets = {i: runs(t) for i, t in docs}
    group = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and group[i] != group[j] and similarity(sets[i], sets[j]) >= threshold:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = {k: new if g == old else g for k, g in group.items()}
    return group


def test_near_groups_equal_those_of_all_pairs(spark):
    """A text between many leaders and one that is like it alone, and random near copies."""
    rng = random.Random(21)
    docs = []
    for f in range(4):
        words = [f"f{f}w{k}" for k in range(60)]

        def variant(name, at):
            return " ".join(f"{name}x{k}" if k in at else w for k, w in enumerate(words))
        docs += [(1000 * f + i, variant(f"a{f}{i}", (3 + i, 33 + i % 20))) for i in range(24)]
        docs += [(1000 * f + 100, " ".join(words)), (1000 * f + 200, variant(f"b{f}", (30, 56)))]
    docs += [(9000 + i, t) for i, t in corpus()]
    for size in range(1, 30):
        words = [f"s{size}w{k}" for k in range(size)]
        docs += [(20000 + 10 * size + k, " ".join(words + ["end"] * k)) for k in range(3)]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for threshold in (0.8, 0.6):
        got = {r["id"]: r["group_id"]
               for r in dedup.near_duplicate_groups(df, threshold=threshold).collect()}
        assert got == all_pair_groups(docs, threshold)
