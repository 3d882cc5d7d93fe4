"""The pipeline on the smallest tables: each stage against its operator's plain rules on that stage's own input."""

import os
import re

import pytest

import corpus_pipeline
from corvane.llm import packing, pii, simhash, toxicity

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, inputs = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        inputs.append(docs)
        out = stage(spark, docs, SMALL)
        if name != "packing":
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    whole, kept, single, clean, mixed = (d.toPandas() for d in inputs)
    scores = toxicity.toxicity(inputs[0], spark.read.parquet(f"{SMALL}/labels.parquet")).toPandas()
    assert sorted(kept.doc_id) == sorted(scores[scores.score < 0.5].doc_id) and 0 < len(kept) < len(whole)
    assert dict(zip(kept.doc_id, kept.text)) == {i: t for i, t in zip(whole.doc_id, whole.text) if i in set(kept.doc_id)}
    prints = {r.doc_id: simhash.fingerprint(r.text or "") for r in kept.itertuples()}
    left = set(single.doc_id)
    assert len(single) == len(left)
    assert not any((prints[a] ^ prints[b]).bit_count() <= 4 for a in left for b in left if a < b)
    assert all(any((prints[a] ^ prints[b]).bit_count() <= 4 and b != a for b in prints) for a in prints.keys() - left)
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert left == {root(i) for i in prints}
    texts = dict(zip(single.doc_id, single.text))
    assert len(clean) == len(single)
    for r in clean.itertuples():
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text) or r.text == texts[r.doc_id]
        if not pii.base_spans(texts[r.doc_id]):
            assert r.text == texts[r.doc_id]
    sanitised = {r.doc_id: r.spans for r in pii.personal_data(inputs[2]).collect()}
    for r in clean.itertuples():
        assert (r.text == texts[r.doc_id]) == (not sanitised[r.doc_id])
    size = lambda t: len(WORD.findall(t or ""))
    total = sum(map(size, clean.text))
    assert abs(sum(map(size, mixed.text)) - 1.5 * total) <= clean.source.nunique() + 1
    packed = docs.toPandas()
    assert packed.n_words.sum() == sum(map(size, mixed.text))
    bins = packed[packed.bin_id.notna()].groupby("bin_id").n_words.sum()
    assert bins.max() <= 2048 and (packed[packed.bin_id.notna()].groupby("bin_id").bin_words.first() == bins).all()
    source = dict(zip(whole.doc_id, whole.source))
    held = packed[packed.bin_id.notna()].assign(source=lambda d: d.doc_id.map(source))
    assert held.groupby(["bin_id", "source"]).size().max() == 1 and held.groupby(["bin_id", "doc_id"]).size().max() == 1
    groups = {}
    for r in mixed.itertuples():  # copies and near copies of a text never share a bin, whatever their ids
        groups.setdefault(r.doc_id, set()).update(packing.copy_groups((r.text or "").lower().encode().split()))
    for ids in held.groupby("bin_id").doc_id.apply(list):
        assert not any(groups[a] & groups[b] for i, a in enumerate(ids) for b in ids[:i] if mixed.doc_id.value_counts()[a] == mixed.doc_id.value_counts()[b] == 1)


def test_texts_that_share_an_id_stay_apart(spark):
    rows = [(5, "one two three four five six", "a"), (5, "one two three four five six", "a"), (5, "seven eight nine ten eleven twelve", "b"), (None, "one two three four five six", "a"), (None, "x y z", None), (None, "x y z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as fp", "2 as th", "3 as root")
    got = simhash.deduplicate(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == [(0, "x y z"), (5, "one two three four five six"), (5, "seven eight nine ten eleven twelve")]
