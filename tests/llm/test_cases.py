"""Empty tables, null ids, nulls in any column, ties and repeated rows: the cases that the docstrings define."""

import pytest
import corpus_pipeline
from pixelloom.llm import exact_dedup, html_extract, media, minhash, mixing, packing, secrets, suffix_dedup, toxicity, url_filter
from pixelloom.llm.queries import URL_RULES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def model():
    return secrets.SecretModel()


def test_empty_tables(spark, model):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    found = [
        minhash.near_duplicates(docs), packing.pack_documents(docs), media.media_digests(docs), mixing.mix_sources(docs), html_extract.extract_text(pages), suffix_dedup.remove_repeats(docs), exact_dedup.exact_dedup(docs),
        toxicity.score_toxicity(docs, labels), secrets.secret_digests(secrets.scan_secrets(docs, model=model)), url_filter.filter_urls(pages, spark.createDataFrame([], "canonical string"), URL_RULES),
    ]
    assert [df.collect() for df in found] == [[]] * len(found)


def test_null_ids(spark, model):
    docs = spark.createDataFrame([(None, "one two three", None, None, None), (None, None, None, None, None), (2**60 + 1, "", "en", "s", 0)], DOCS)
    labels = spark.createDataFrame([(None, None, None)], LABELS)
    for df in (
        minhash.near_duplicates(docs), media.media_digests(docs), mixing.mix_sources(docs), suffix_dedup.remove_repeats(docs), exact_dedup.exact_dedup(docs), toxicity.score_toxicity(docs, labels),
        secrets.secret_digests(secrets.scan_secrets(docs, model=model)), packing.pack_documents(docs),
    ):
        assert sorted((r.doc_id for r in df.collect()), key=str) == [2**60 + 1, None, None]


def write(spark, path, docs, labels):
    spark.createDataFrame(docs, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_pipeline_of_empty_tables(spark, tmp_path):
    path = write(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, path).collect() == []
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).collect() == []


def test_pipeline_of_odd_rows(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(40))
    docs = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text.upper(), None, None, None), (None, None, None, None, None), (None, "", None, None, None), (3, " \t ", "en", "b", 3), (4, "long " * 50_000, "en", None, None), (5, text + " and more", "en", "b", 0), (6, "other words here", None, "a", 0)]
    path = write(spark, tmp_path, docs, [(1, 1, 0), (None, None, None), (5, None, 0)])
    stages = dict(corpus_pipeline.STAGES)
    whole = spark.read.parquet(f"{path}/documents.parquet")
    assert stages["toxicity"](spark, whole, path).count() == len(docs)
    once = stages["exact_dedup"](spark, whole, path)
    # of equal texts the largest id stays; null and empty texts are one group, blanks another
    assert sorted((r.doc_id for r in once.collect()), key=str) == [2, 3, 4, 5, 6, None]
    near = stages["minhash"](spark, once, path)
    assert sorted((r.doc_id for r in near.collect()), key=str) == [2, 3, 4, 6, None]
    mixed = stages["mixing"](spark, near, path)
    assert mixed.columns == whole.columns and {r.doc_id for r in mixed.collect()} <= {2, 3, 4, 6, None}
    packed = stages["packing"](spark, near, path).collect()
    assert {r.doc_id: r.n_words for r in packed if r.doc_id in (2, 3, 6, None)} == {2: 40, 3: 0, 6: 3, None: 0} and sum(r.n_words for r in packed if r.doc_id == 4) == 50_000
    assert corpus_pipeline.run(spark, path).count() > 0
