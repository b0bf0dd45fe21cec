"""The pipeline: each stage on its predecessor's rows, and what the whole keeps."""

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_strings", "decontamination", "packing"]


def test_columns_and_sizes(spark, sf_dir, stages):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in list(stages)[:-1]:
        assert stages[name].columns == COLUMNS
        assert 0 < stages[name].count() <= n
        n = stages[name].count()
    ids = {r.doc_id for r in stages["decontamination"].select("doc_id").collect()}
    assert {r.doc_id for r in stages["packing"].select("doc_id").collect()} == ids


def test_exact_copies_go_and_lengths_follow(stages):
    kept = stages["near_duplicates"].collect()
    assert len({r.text for r in kept}) == len(kept)
    assert all(r.n_chars == len(r.text) for r in stages["repeated_strings"].collect())


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.columns == stages["packing"].columns
    cut = lambda df: sorted((r.doc_id, r.piece, r.ids_crc32) for r in df.collect())
    assert cut(rows) == cut(stages["packing"])


def test_an_empty_corpus_runs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
