"""Language, toxicity, content sort, mix and pipeline: odd cases, accuracy, stability."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from codeloom.llm import (
    bpe, content_sort, language, lines, mixing, ngram_join, quality, suffix, token_counts,
    toxicity,
)
from tests.llm.cases import WORD, documents, frame, rows


def test_every_operator_on_an_empty_table(spark):
    docs = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for result in (
        quality.judged(docs), bpe.encode_documents(docs),
        language.identify(docs, language.fit(docs)), ngram_join.components(docs),
        lines.line_decisions(docs), suffix.remove_repeats(docs),
        token_counts.recounted(docs, token_counts.cleaning_edits),
        content_sort.content_groups(docs), mixing.mix(docs),
        toxicity.score_documents(docs, toxicity.fit(docs, labels)),
    ):
        assert result.count() == 0


def _norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("partitions", ["2", "13"])
def test_content_groups(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = content_sort.content_groups(frame(spark)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    groups = defaultdict(list)
    for i, t, *_ in rows():
        groups[_norm(t)].append(i)
    want = Counter()
    for t, ids in groups.items():
        least = min((i for i in ids if i is not None), default=None)
        want.update((i, least, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == want
    kept = [r for r in found if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_content_groups_cut_a_large_group(spark):
    """One text in most rows falls into many ranges and is still one group."""
    docs = spark.range(600).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 > 0, "the  same\ttext").otherwise(F.col("id").cast("string"))
        .alias("text"))
    found = content_sort.content_groups(docs)
    assert found.where("kept").count() == 201
    assert found.where("group_size = 400 and keep_id = 1").count() == 400


def test_mix(spark):
    docs = frame(spark)
    first, again = mixing.mix(docs).collect(), mixing.mix(docs.repartition(7)).collect()
    assert Counter(first) == Counter(again)
    texts = Counter((i, len(WORD(t or ""))) for i, t, *_ in rows())
    assert Counter((r.doc_id, r.size) for r in first) == texts
    assert all(r.taken <= 2 * r.size and r.taken == r.copies * r.size for r in first)


def test_mix_meets_targets(spark):
    found = mixing.mix(documents(spark, "/root/testdata/sf0.01")).join(
        documents(spark, "/root/testdata/sf0.01").select("doc_id", "source"), "doc_id")
    sums = found.groupBy("source").agg(
        F.sum("taken").alias("taken"), F.max("target").alias("target"),
        F.max("size").alias("largest"), F.max("source_size").alias("size")).collect()
    assert all(abs(r.taken - r.target) <= r.largest for r in sums)
    assert abs(sum(r.target for r in sums) - 1.5 * sum(r["size"] for r in sums)) < 1


def test_mixed_documents_keep_columns(spark):
    docs = frame(spark)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    want = sum(r.copies for r in mixing.mix(docs).collect())
    assert mixed.count() == want


def test_cross_parsing_is_the_greedy_parse():
    model = language.LanguageModel({"a": ["banana bandana nab"], "b": ["cocoa coal alcove"]})
    table = language._classes(model.letters)
    for text in ("banana", "coal ban", "zzz", "nab, cove!", "b" * 50):
        codes = language._coded(text, table)
        for k, sample in enumerate(("banana bandana nab", "cocoa coal alcove")):
            known = bytes(language._coded(sample, table).tolist() + [0])
            raw, n, at = bytes(codes.tolist()), 0, 0
            while at < len(raw):
                m = 1
                while at + m < len(raw) and raw[at:at + m + 1] in known:
                    m += 1
                at += m
                n += 1
            assert model.phrases([codes])[k, 0] == n


def test_language(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    found = language.identify(docs, language.fit(docs)).join(docs, "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    odd = {r.doc_id: r for r in language.identify(frame(spark), language.fit(docs)).collect()}
    assert len(odd) and all(
        odd[i].lang_pred == "und" and odd[i].score == 0 for i in (5, 6, 7))
    assert odd[1].lang_pred != "und"


def test_language_does_not_see_held_out_labels(spark):
    docs = documents(spark)
    changed = docs.withColumn("lang", F.when(
        language.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    a, b = language.fit(docs), language.fit(changed)
    assert a.langs == b.langs and (a.table == b.table).all()


def test_toxicity(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels)
    found = toxicity.score_documents(docs, model).join(labels, "doc_id").where("held_out")
    n = {(r.toxic, r.predicted): r["count"] for r in
         found.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 0.85 * (n[1, 1] + n.get((1, 0), 0))
    assert n.get((0, 1), 0) <= 0.02 * (n[0, 0] + n.get((0, 1), 0))
    odd = toxicity.score_documents(frame(spark), model).collect()
    assert len(odd) == len(rows()) and all(0 <= r.score <= 1 for r in odd)
    assert all(r.predicted == (r.score >= 0.5) for r in odd)


def test_stages(spark):
    """Every stage keeps the columns and, on odd rows, what it must."""
    docs = frame(spark)
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, "/root/testdata/sf0.001")
        assert after.columns == docs.columns, name
        docs = after.cache()
        sizes.append(docs.count())
    ids = {r.doc_id for r in docs.collect()}
    assert not ids & {5, 6, 7} and sizes[0] > sizes[1] >= sizes[2]
    result = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert result.count() == sizes[-1]


def test_pipeline_against_plain_python(spark):
    """On a table: the rows of every stage follow from the operators tested above."""
    sf_dir = "/root/testdata/sf0.001"
    docs = documents(spark, sf_dir)
    seen, kept = set(), []
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        if any(c.isalpha() for c in r.text or "") and _norm(r.text) not in seen:
            seen.add(_norm(r.text))
            kept.append(r)
    sets = []
    for r in kept:
        w = WORD(r.text.translate({i: i + 32 for i in range(65, 91)}))
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))))
    group = list(range(len(kept)))
    for a in range(len(kept)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                old, new = sorted((group[a], group[b]))[::-1]
                group = [new if g == old else g for g in group]
    near = [r for k, r in enumerate(kept) if group[k] == k]
    copies = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(near, docs.schema))
              .collect()}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(r.doc_id for r in got) == Counter(
        {i: n for i, n in copies.items() if n})
    codec = bpe.codec(bpe.default_tokenizer())
    texts = {r.doc_id: r.text for r in near}
    for r in got:
        assert r.n_tokens == len(codec.encode(texts[r.doc_id]))


def test_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert len([q for q in names if q.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names
