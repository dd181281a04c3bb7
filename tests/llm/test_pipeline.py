import sys
from pathlib import Path

import pytest
from support import DATA

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture
def quick(monkeypatch):
    from citeloom.llm import quality_classifier

    monkeypatch.setattr(quality_classifier, "STEPS", 20)


def test_stages_keep_the_columns_and_take_effect(spark, odd, quick):
    import corpus_pipeline

    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        docs = out
    known = {(r.doc_id, r.text): r.asDict() for r in odd.collect()}
    assert all(r.asDict() == known[r.doc_id, r.text] for r in docs.collect())  # clashing columns come through as they were
    ids = {r.doc_id for r in corpus_pipeline.identify_languages(spark, odd, DATA).collect()}
    assert not ids & {2, 3, 4, 9}
    kept = sorted((r.doc_id is not None, r.doc_id or 0) for r in corpus_pipeline.drop_near_copies(spark, odd, DATA).collect())
    assert (True, 1) in kept and (True, 5) not in kept and len(kept) == odd.count() - 2
    assert corpus_pipeline.encode(spark, odd, DATA).where("lossless").count() == odd.where("text is not null").count()


def test_empty_tables_pass(spark, empty, quick):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0


def test_run_is_its_stages_one_after_another(spark, quick):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = corpus_pipeline.run(spark, DATA).collect()
    known = {r.doc_id: r.text for r in docs.collect()}
    assert got and all(r.lossless and r.doc_id in known for r in got)
    # the same as its stages, with each table written in several files and read again
    from citeloom.sources.scratch import stash

    step = docs
    for name, stage in corpus_pipeline.STAGES:
        step = stash(stage(spark, step, DATA).repartition(3), f"test-{name}")
    plain = lambda rows: sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows)
    assert plain(got) == plain(step.collect())
    # the last stage encodes what the one before wrote: each id as often as the mix took it, all copies whole
    assert max(sum(1 for r in got if r.doc_id == i) for i in {r.doc_id for r in got}) <= 3
    assert all(len(r.ids) == r.n_tokens for r in got)
