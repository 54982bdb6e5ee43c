import re

import pytest
from helpers import SMALL, make_docs
from test_line_dedup import plain as plain_dedup
from test_quality import plain as plain_quality
from test_quality import verdict
from test_simhash import plain_classes, plain_fingerprint
from test_tokens import assert_packed

import corpus_pipeline
from sherdline.llm import secrets


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What every stage got and returned."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out[name] = (docs, after)
        docs = after
    return out


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_order_and_columns(stages):
    assert list(stages) == ["quality_rules", "near_dedup", "substring_dedup", "secret_scan", "packing"]
    first = stages["quality_rules"][0]
    for name in list(stages)[:-1]:
        assert stages[name][1].dtypes == first.dtypes


def test_quality_stage(stages):
    before, after = map(rows, stages["quality_rules"])
    assert after == [(i, t) for i, t in before if not plain_quality(t)[-1] and verdict(t)]


def test_near_dedup_stage(stages):
    before, after = map(rows, stages["near_dedup"])
    classes = plain_classes([plain_fingerprint(t) for _, t in before])
    assert after == [row for k, row in enumerate(before) if classes[k] == k] and len(after) < len(before)


def test_substring_stage(stages):
    before, after = map(rows, stages["substring_dedup"])
    texts = dict(before)
    for (doc_id, removed), (i, text) in zip(plain_dedup(before), sorted(after, key=repr)):
        for a, b in reversed([tuple(map(int, s.split(":"))) for s in removed.split(",") if s]):
            texts[doc_id] = texts[doc_id][:a] + texts[doc_id][b:]
    assert after == sorted(texts.items())


def test_secret_stage(stages):
    before, after = map(rows, stages["secret_scan"])
    assert [i for i, _ in before] == [i for i, _ in after]
    for (_, a), (_, b) in zip(before, after):
        assert not secrets.find(b)[0]
        if not secrets.find(a)[0] and not secrets.find(a)[1]:
            assert a == b
        kept = b.split(secrets.SECRET)
        assert re.fullmatch(".+".join(map(re.escape, kept)), a, re.S) if len(kept) > 1 else True


def test_packing_stage(stages):
    before, after = stages["packing"]
    assert_packed(after.collect(), rows(before))


def test_run_equals_the_stages(spark, stages):
    key = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    whole = lambda df: sorted({(i, n) for i, n in ((r.doc_id, r.doc_tokens) for r in df.collect())})
    out = corpus_pipeline.run(spark, SMALL)
    assert whole(out) == whole(stages["packing"][1]) and out.columns == stages["packing"][1].columns and len(key(out)) > 0


def test_odd_documents_pass_every_stage(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs, make_docs(spark, [(None, None), (1, None), (1, None)])):
        given = docs
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SMALL)
            if name != "packing":
                assert docs.schema == given.schema
        assert docs.count() >= 0
