"""The pipeline's stages on a small corpus, each against a plain version of its operator."""

import pyarrow.parquet
import pytest

import corpus_pipeline
from cuesheet.llm import stages
from tests.llm.helpers import SCHEMA, frame, odd_documents
from tests.llm.test_dedup import plain_components, plain_lines
from tests.llm.test_rules import leaks


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """documents and benchmark tables in a folder of their own."""
    folder = tmp_path_factory.mktemp("corpus")
    docs, bench, _ = leaks(spark)
    leaked = {r.doc_id: (r.doc_id + 1000, r.text, "en", "src1", len(r.text or "")) for r in docs.filter("doc_id IS NOT NULL").collect()}
    rows = [tuple(r) for r in frame(spark, [r for r in odd_documents() if r[0] is not None]).collect()] + list(leaked.values()) + [(2000, "%% 12 !", "en", "src1", 7)]
    for name, df in (("documents", spark.createDataFrame(rows, SCHEMA)), ("benchmark", bench.filter("item_id IS NOT NULL"))):
        pyarrow.parquet.write_table(df.toArrow(), folder / f"{name}.parquet")
    return f"file://{folder}"


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    given = rows_of(docs)
    known = stages.keep_known_languages(spark, docs, corpus)
    assert known.columns == docs.columns
    held = rows_of(known)
    assert {i for i, _ in held} == {i for i, t in given if t and any(c.isalpha() for c in t)}
    cut = stages.drop_repeated_lines(spark, known, corpus)
    assert sorted(rows_of(cut)) == sorted((i, text) for (i, _, _, text), n in plain_lines(held).items() for _ in range(n))
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    one = stages.keep_one_of_each_group(spark, cut, corpus)
    stay = {i for i, _, _, kept in plain_components(rows_of(cut), 5, 80) if kept}
    assert sorted(rows_of(one)) == sorted(r for r in rows_of(cut) if r[0] in stay)
    clean = stages.drop_benchmark_leaks(spark, one, corpus)
    assert {i for i, _ in rows_of(one)} - {i for i, _ in rows_of(clean)} == {i for i in range(1001, 1009)} & {i for i, _ in rows_of(one)}
    assert clean.columns == docs.columns


def test_run(spark, corpus):
    out = corpus_pipeline.run(spark, corpus).collect()
    assert len(out) > 10 and len(corpus_pipeline.STAGES) == 5
    assert all(r.n_tokens >= 0 and len(r.ids_sha256) == 64 for r in out)


def test_empty_corpus(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, corpus)
    assert docs.count() == 0
