"""Operators against plain Python on whole small tables and on odd cases."""

from __future__ import annotations

import hashlib
import itertools
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry  # noqa: F401  registers the package for the workers
from codeloom.llm import bpe, lines, ngram_join, quality, suffix, token_counts
from tests.llm.cases import BASE, LOWER, WORD, documents, frame, rows


@pytest.fixture(params=["table", "odd"])
def docs(request, spark):
    return documents(spark) if request.param == "table" else frame(spark)


def _collected(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def _bag(df):
    return Counter(map(tuple, df.collect()))


def _statistics(text):
    words = WORD(text)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    marked = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i:i + 8])] > 1:
            marked.update(range(i, i + 8))
    own = [x for x in text.split("\n") if WORD(x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            len(own) - len(set(own)), len(marked), n < 20 or 100 * len(marked) > 30 * n)


def test_quality_statistics(docs):
    got = quality.judged(docs)
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "base_failed"]
    assert _bag(got.select(cols)) == Counter(
        (i, *_statistics(t)) for i, t in _collected(docs))
    assert got.where("base_failed and kept").count() == 0


def _vectors(spark, docs):
    stats = quality.statistics(docs, "doc_id", "lang", "source").withColumn(
        "base_failed", quality.base_failed()).where("not base_failed")
    return stats.select("lang", "source", *quality._vector())


def _estimate(x):
    """The estimate of one group without a wider one, by numpy."""
    floor = np.eye(x.shape[1]) * (quality.FLOOR * quality.UNIT) ** 2

    def fit(near, scale=1.0):
        return near.mean(axis=0), np.cov(near.T, bias=True) * scale + floor

    def distances(centre, cov):
        d = x - centre
        return np.round(np.minimum(np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d), 1e4) * 100)

    middle = np.median(x, axis=0)
    spread = np.maximum(
        1.4826 * np.median(np.round(np.abs(x - middle)), axis=0), quality.FLOOR * quality.UNIT)
    ends = []
    for start in ((middle, np.diag(spread ** 2)),
                  fit(middle + spread * np.tanh((x - middle) / spread))):
        last, params = np.inf, start
        while True:
            d2 = distances(*params)
            fresh = fit(x[d2 <= np.quantile(d2, quality.H)])
            now = np.linalg.slogdet(fresh[1])[1]
            if now < last:
                params, last, fall = fresh, now, last - now
            else:
                break
            if fall <= quality.LEAST_FALL:
                break
        ends.append((last, params))
    d2 = distances(*min(ends, key=lambda e: e[0])[1])
    near = x[d2 / max(np.median(d2), 1) * quality.CHI_MEDIAN <= quality.CHI_NEAR]
    centre, cov = fit(near, quality.CONSISTENCY)
    return centre, np.median(distances(centre, cov))


def test_quality_estimate_is_that_of_numpy(spark):
    """The steps of the group of all vectors, redone with numpy."""
    vectors = _vectors(spark, documents(spark, "/root/testdata/sf0.01"))
    x = np.array(vectors.select(*quality._NAMES).collect(), float)
    centre, middle = _estimate(x)
    row = quality.estimates(vectors).where("level = 0").collect()[0]
    assert np.allclose([row[f"m_{i}"] for i in range(5)], centre, rtol=1e-6, atol=1e-3)
    assert abs(row["middle"] - middle) <= 2


def test_quality_vectors_are_not_shuffled_to_their_groups(spark):
    """The numbers of a few groups go to the vectors, whatever Spark thinks of sizes."""
    zones = [(2, "en", "a"), (1, "en", None), (0, None, None)]
    rows = spark.createDataFrame(
        [(*z, i, i * i, -i, 7 * i % 5, i % 3) for i in range(40) for z in zones],
        "level int, g1 string, g2 string, x1 long, x2 long, x3 long, x4 long, x5 long")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        params = quality.stored(quality._starts(rows), "starts")
        near = quality._nearest(rows, params)
        plan = near._jdf.queryExecution().executedPlan().toString()
        kept = near.groupBy(*quality._GROUP).count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plan.count("BroadcastHashJoin") == 3 and "SortMergeJoin" not in plan
    assert len(kept) == 6 and min(r["count"] for r in kept) >= 30


def test_quality_texts_without_words_have_no_vector(spark):
    """Such texts fail the base rules; a division by their words must not end the job."""
    words = [" ".join(f"w{(i * k) % 97}" for k in range(20 + i % 9)) for i in range(30)]
    docs = spark.createDataFrame(
        [(i, t, "en" if i % 3 else None, "s") for i, t in enumerate([None, "", " \n", *words])],
        "doc_id long, text string, lang string, source string")
    stats = quality.statistics(docs, "doc_id")
    vectors = {r.doc_id: r for r in stats.select("doc_id", *quality._vector()).collect()}
    assert [vectors[i].x2 for i in range(3)] == [None] * 3 and vectors[3].x2 is not None
    got = {r.doc_id: r for r in quality.judged(docs).collect()}
    assert len(got) == 33
    assert all(got[i].base_failed and not got[i].kept and got[i].distance is None for i in range(3))


def test_quality_floor_is_far_below_the_spread(spark):
    vectors = _vectors(spark, documents(spark, "/root/testdata/sf0.01"))
    assert min(np.array(vectors.select(*quality._NAMES).collect(), float).std(axis=0)) > (
        10 * quality.FLOOR * quality.UNIT)


def test_quality_rejects_outliers_of_correlation(spark):
    """Texts whose every statistic is usual, but not all of them together: the covariance
    tells, bounds for each statistic alone would not."""
    rng = np.random.default_rng(2)
    known = [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiou" for c in ("r", "st", "sten", "ndig", "lung")]

    share = 1 / (np.arange(len(known)) + 3)

    def text(n, kinds):
        chosen = rng.choice(kinds, n, p=share[:kinds] / share[:kinds].sum())
        return " ".join(known[i] + "." * (rng.random() < 0.1) for i in chosen)

    rows = [(i, text(n, len(known)), "en", "s") for i, n in
            enumerate(rng.integers(30, 320, 600))]
    # as many words as a long text, as few different ones as a short text
    rows += [(1000 + i, text(300, 16), "en", "s") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.judged(docs).collect()}
    planted = [got[1000 + i] for i in range(5)]
    clean = [got[i] for i in range(600) if not got[i].base_failed]
    tested = [r for r in planted if not r.base_failed]
    assert len(tested) == 5 and not any(r.kept for r in tested)
    assert sum(r.kept for r in clean) >= 0.98 * len(clean)
    lows = min(r.n_distinct for r in clean), max(r.n_words for r in clean)
    assert all(r.n_distinct >= lows[0] and r.n_words <= lows[1] for r in tested)


def test_quality_groups_of_any_size(spark):
    """One text, or equal texts, are a group too and lie at the centre of nothing else."""
    docs = spark.createDataFrame(
        [(1, BASE, "xx", "a"), (2, BASE, None, None), (3, BASE, None, None)],
        "doc_id long, text string, lang string, source string")
    assert [r.kept for r in quality.judged(docs).collect()] == [True] * 3


def test_quality_keeps_clean_and_rejects_junk(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.judged(docs).where("not base_failed").join(labels, "doc_id").groupBy(
        "quality").agg({"*": "count", "kept": "max"})
    kept = dict(quality.judged(docs).where("not base_failed").join(labels, "doc_id").groupBy(
        "quality").agg({"doc_id": "count"}).collect())
    good = dict(quality.judged(docs).where("kept").join(labels, "doc_id").groupBy(
        "quality").agg({"doc_id": "count"}).collect())
    assert got.count() == 2
    assert good[1] >= 0.97 * kept[1] and good.get(0, 0) <= 0.2 * kept[0]


def test_bpe(docs):
    codec = bpe.codec(bpe.default_tokenizer())
    library = codec.tokenizer
    want = Counter()
    for i, t in _collected(docs):
        ids = library.encode(t, add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
              hashlib.sha256(text.encode()).hexdigest())] += 1
    assert _bag(bpe.encode_documents(docs)) == want


def test_bpe_joins_of_any_chunks_agree():
    codec = bpe.codec(bpe.default_tokenizer())
    for _, text, *_ in rows():
        if not text or codec.is_special(text):
            continue
        pieces = bpe._pieces(codec, text)
        for shared in (0, 1, 2):
            known = {}
            for k in range(shared, len(pieces), 2):
                ids, ends = codec.ids(codec.word_list(pieces[k]))
                known[k] = (ids.tobytes(), ends.astype("<u4").tobytes())
            assert bpe.assemble(codec, text, known) == codec.tokenizer.encode(
                text, add_special_tokens=False).ids


def _shingles(text):
    w = WORD(text.translate(LOWER))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_ngram_components(docs):
    data = _collected(docs)
    sets = [_shingles(t) for _, t in data]
    parent = list(range(len(data)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(data)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(data):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    want = Counter((i, len(s), least.get(root(k)) if s else i)
                   for k, ((i, _), s) in enumerate(zip(data, sets)))
    assert _bag(ngram_join.components(docs)) == want


def test_ngram_family_without_pairs(spark):
    """A large family of variants: every one links with the base, not all with each other."""
    words = BASE.split() * 1
    data = [(i, " ".join(w if j != i % 60 else f"new{i}" for j, w in enumerate(words)))
            for i in range(300)] + [(1000, BASE)]
    got = ngram_join.components(spark.createDataFrame(data, "doc_id long, text string"))
    assert {r.component_id for r in got.collect()} == {0}


def test_lines(docs):
    data = sorted(_collected(docs), key=lambda r: (r[0] is None, r[0]))
    if any(i is None for i, _ in data) or len({i for i, _ in data}) < len(data):
        data = [(i, t) for i, t in data if i is not None and i not in (17, 18)]
        docs = docs.where("doc_id is not null and doc_id not in (17, 18)")
    earlier, want = [], {}
    for i, t in data:
        gone = []
        for n, line in enumerate(t.split("\n")):
            s = frozenset(WORD(line.translate(LOWER)))
            if s and any(100 * len(s & e) >= lines.PERCENT * len(s | e) for e in earlier):
                gone.append(n)
            if s:
                earlier.append(s)
        want[i] = (t.count("\n") + 1, len(gone), gone)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.removed)
           for r in lines.line_decisions(docs).collect()}
    assert got == want


def test_lines_at_three_quarters(spark):
    """Against all pairs at 75 percent: one to three replaced words of lines of 5 to 40."""
    data = []
    for n in range(5, 41):
        for replaced in range(4):
            words = [f"l{n}w{k}" for k in range(n)]
            words[:replaced] = [f"new{n}x{replaced}y{k}" for k in range(replaced)]
            data.append((len(data), " ".join(words)))
    earlier, want = [], {}
    for i, t in data:
        s = frozenset(t.split())
        want[i] = any(100 * len(s & e) >= 75 * len(s | e) for e in earlier)
        earlier.append(s)
    got = lines.line_decisions(spark.createDataFrame(data, "doc_id long, text string"))
    assert {r.doc_id: r.n_removed == 1 for r in got.collect()} == want


def test_lines_with_further_searches(spark, monkeypatch):
    monkeypatch.setattr(lines, "TRIES", 1)
    monkeypatch.setattr(lines, "SURE", 10_000)
    test_lines(documents(spark))


def _pairs_compared(docs, monkeypatch):
    """(line decisions, pairs compared exactly in each search)."""
    compared, stored = [], lines.stored

    def counted(df, label):
        out = stored(df, label)
        if label == "lines-pairs":
            compared.append(out.count())
        return out

    monkeypatch.setattr(lines, "stored", counted)
    return {r.doc_id: r.removed for r in lines.line_decisions(docs).collect()}, compared


def test_long_lines_that_differ_are_not_compared(spark, monkeypatch):
    """Lines of 150 to 900 words with few in common, and a near copy of each."""
    draw = np.random.default_rng(5)
    data = []
    for i in range(40):
        words = [f"w{k}" for k in draw.choice(20_000, 150 + 750 * i // 40, replace=False)]
        words[:12] = [f"shared{k}" for k in range(12)]
        data.append((i, " ".join(words)))
        data.append((100 + i, " ".join(words[:-20] + [f"new{i}x{k}" for k in range(20)])))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got, compared = _pairs_compared(docs, monkeypatch)
    assert got == {i: [0] if i >= 100 else [] for i, _ in data}
    assert sum(compared) <= 80


def test_lines_are_taken_out(spark):
    docs = spark.createDataFrame(
        [(1, "a b c\nx", "s"), (2, "y\nc b a\nz", "t"), (3, None, "u")],
        "doc_id long, text string, removed string")
    got = lines.without_repeated_lines(docs)
    assert sorted(map(tuple, got.collect())) == [
        (1, "a b c\nx", "s"), (2, "y\nz", "t"), (3, None, "u")]


def test_repeated_passages(docs):
    data = sorted(_collected(docs), key=lambda r: (r[0] is None, r[0]))
    first, covered = {}, []
    for i, t in data:
        raw = t.encode()
        place = i if i is not None else 1 << 62
        for a in range(len(raw) - 49):
            s = raw[a:a + 50]
            first[s] = min(place, first.get(s, place))
    for i, t in data:
        raw, place = t.encode(), i if i is not None else 1 << 62
        gone = np.zeros(len(raw), bool)
        for a in range(len(raw) - 49):
            if first[raw[a:a + 50]] < place:
                gone[a:a + 50] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        covered.append((i, len(raw), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()))
    assert _bag(suffix.remove_repeats(docs)) == Counter(covered)


def test_run_index_matches():
    text = np.frombuffer(b"abracadabra" * 30 + b"\x00" + b"cadabraabra" * 30, np.uint8)
    text = np.append(text.astype(np.int16) + 1, 0)
    index = suffix.RunIndex(text)
    lengths = index.matching_statistics(len(text))
    place = {int(p): k for k, p in enumerate(index.order)}
    for p in range(len(text)):
        k = place[p]
        q = int(index.order[k - 1]) if k else -1
        n = 0
        while q >= 0 and p + n < len(text) and q + n < len(text) and (
                text[p + n] == text[q + n] != 0):
            n += 1
        assert min(n, 50) == min(int(lengths[p]), 50)
    assert len(index.samples) < len(text) / 2


def _after_three_symbols():
    """Lists of A+S, B+S and C+S in all row orders, with own symbols and an own S each."""
    chance, out = np.random.default_rng(7), []
    for k, order in enumerate(itertools.permutations(range(3))):
        tail = "".join(chance.choice(list("abcdefgh"), 79))
        out.append(["ABCDEFGHIJKLMNOPQR"[3 * k + x] + tail for x in order])
    return out


def test_run_index_after_first_suffix_of_a_symbol():
    """Neighbours go on together after a first symbol that differs."""
    for contexts in _after_three_symbols():
        text = np.concatenate([np.append(np.frombuffer(c.encode(), np.uint8).astype(np.int16) + 1,
                                         0) for c in contexts]).astype(np.int16)
        index = suffix.RunIndex(text)
        above = np.full(len(text), -1)
        above[index.order[1:]] = index.order[:-1]
        want = index._compared(text, np.arange(len(text)), above)
        assert index.matching_statistics(len(text)).tolist() == want.tolist()


def test_repeated_passages_after_different_symbols(spark):
    texts = [c for contexts in _after_three_symbols() for c in contexts]
    test_repeated_passages(spark.createDataFrame(
        list(enumerate(texts)), "doc_id long, text string"))


def test_edit_counts(docs):
    c = token_counts.counter(*token_counts.default_ranks())
    want = Counter()
    for i, t in _collected(docs):
        edits = token_counts.cleaning_edits(t)
        want[(i, c.whole(t), len(edits), c.whole(token_counts.apply_edits(t, edits)))] += 1
    got = token_counts.recounted(docs, token_counts.cleaning_edits)
    assert _bag(got.select("doc_id", "n_tokens", "n_edits", "n_tokens_after")) == want


def test_edits_of_a_column(spark):
    edits = [(3, 4, " new "), (0, 0, "  "), (500, 3, "x"), (10, 90, None)]
    docs = spark.createDataFrame(
        [(1, BASE, edits), (2, None, edits), (3, "a b", None)],
        "doc_id long, text string, edits array<struct<start:int,length:int,new:string>>")
    c = token_counts.counter(*token_counts.default_ranks())
    plain = [(a, b, n or "") for a, b, n in edits]
    for r in token_counts.recounted(docs).collect():
        text = {1: BASE, 2: "", 3: "a b"}[r.doc_id]
        after = token_counts.apply_edits(text, plain if r.doc_id < 3 else [])
        assert (r.n_tokens, r.n_tokens_after) == (c.whole(text), c.whole(after))


def test_tree_follows_any_edits():
    import random

    c, chance = token_counts.counter(*token_counts.default_ranks()), random.Random(4)
    for _, text, *_ in rows():
        tree, now = token_counts.TokenTree(text or "", c), text or ""
        for _ in range(25):
            edit = (chance.randrange(len(now) + 3), chance.choice([0, 1, 5, 300]),
                    chance.choice(["", "a", " b", "'s", "\n", "  ", "two words", "é"]))
            tree.edit(*edit)
            now = token_counts.apply_edits(now, [edit])
            assert tree.text() == now and tree.total == c.whole(now)
