import pytest

import corpus_pipeline
from tessella.llm.common import table

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows into and out of each stage, by way of Parquet."""
    out, docs = {}, table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = before, docs
    return out


def test_stages(stages):
    assert list(stages) == ["language", "near_duplicates", "decontamination", "secrets", "mix"]
    for name, (before, after) in stages.items():
        if name != "mix":
            assert after.columns == COLUMNS
        assert {r["doc_id"] for r in after.select("doc_id").collect()} <= set(before)


def test_clean_documents_stay(stages):
    before, after = stages["language"]
    gone = set(before) - {r["doc_id"] for r in after.collect()}
    assert len(gone) <= 0.03 * len(before) and all(len(before[i]["text"]) < 100 for i in gone)


def test_one_of_each_group_stays(stages):
    from test_learned_operators import brute_components

    before, after = stages["near_duplicates"]
    ids = sorted(before)
    _, parts = brute_components([before[i]["text"] for i in ids], 5)
    assert {r["doc_id"] for r in after.collect()} == {ids[k] for k, p in enumerate(parts) if k == p}


def test_contaminated_documents_go(spark, stages):
    from test_native_operators import brute_hits

    before, after = stages["decontamination"]
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    ids = sorted(before)
    hits = brute_hits([before[i]["text"] for i in ids], items)
    assert {r["doc_id"] for r in after.collect()} == {i for i, h in zip(ids, hits, strict=True) if not h[1]}


def test_secrets_are_masked_and_the_rest_is_untouched(stages):
    from test_native_operators import brute_spans

    before, after = stages["secrets"]
    rows = {r["doc_id"]: r for r in after.collect()}
    assert set(rows) == set(before)
    masked = 0
    for i, r in rows.items():
        assert r["n_chars"] == (len(r["text"]) if r["text"] != before[i]["text"] else before[i]["n_chars"])
        if brute_spans(before[i]["text"]):
            masked += 1
            assert "<secret>" in r["text"] and not brute_spans(r["text"])
    assert masked > 0


def test_the_mix_comes_near_its_targets(stages):
    _, after = stages["mix"]
    by = {}
    for r in after.collect():
        assert r["copies"] in (1, 2) and r["taken"] == r["copies"] * r["size"]
        by.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    assert sum(n for _, n in by.values()) == pytest.approx(sum(t for t, _ in by.values()), rel=0.1)


def test_run_equals_the_stages(spark, stages):
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, stages["mix"][1].collect()))


def test_empty_documents(spark):
    docs = table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        if name != "mix":
            assert out.columns == COLUMNS
