"""The pipeline at the smallest size, stage by stage against what brute force says."""

import os

import pytest

import corpus_pipeline
from tessera.llm import common, decontamination, minhash_dedup, substring_dedup

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_stages_equal_brute_force(spark):
    docs = common.table(spark, SF, "documents")
    columns = docs.columns
    bench = [(r.item_id, r.text) for r in common.table(spark, SF, "benchmark").collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = common.stored(stage(spark, docs, SF), f"test-{k}")
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before)
        if k == 1:
            root = minhash_dedup.brute_force(list(before.items()))
            assert set(after) == {d for d in before if root[d] == d}
        if k == 2:
            cut = {d: n for d, (_, n, _) in substring_dedup.brute_force(list(before.items())).items()}
            assert all(after[d].text == before[d] for d in after if cut[d] == 0)
            assert all(len(after[d].text.split()) == len(before[d].split()) - cut[d] for d in after)
        if k == 3:
            hit = {d: n for d, (_, n, *_) in decontamination.brute_force(list(before.items()), bench).items()}
            assert all((after[d].text == before[d]) == (hit[d] == 0) for d in after)
        if k < 4:
            assert docs.columns == columns
    assert "ids" in docs.columns and after


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_stages_take_nulls_repeats_and_other_columns(spark, tmp_path):
    for name in ("labels", "benchmark"):
        common.table(spark, SF, name).write.parquet(f"{tmp_path}/{name}.parquet")
    passage = " ".join(f"word{k}" for k in range(60))
    rows = [(None, passage, "en"), (1, None, "en"), (2, "", None), (3, passage, "en"), (3, passage, "en"), (4, passage + " tail", "en"), (5, "x" * 300_000, "en")]
    docs = spark.createDataFrame([(*r, "s", 0, 1, 2, 3) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, ids int, _doc int, class_id int")
    columns, now = docs.columns, docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        # the classifier may reject these texts; all stages are to see them
        out = stage(spark, now, str(tmp_path))
        assert out.columns[: len(columns)] == columns and out.count() <= now.count()
        if k:
            now = common.stored(out, f"odd-{k}")
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    kept = {(r.doc_id, len(r.text or "")) for r in now.collect()}
    assert {(1, 0), (2, 0), (5, 300_000)} <= kept and sum(d == 3 for d, _ in kept) == 1 and now.columns[-2:] == ["_ids", "decoded_sha256"]
