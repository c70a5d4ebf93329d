"""Columns of any name keep their values in the operators that return whole documents."""

import pytest
from pixelloom.llm import exact_dedup, mixing
from pixelloom.llm.minhash import drop_near_duplicates
from pixelloom.llm.toxicity import drop_toxic

NAMES = "_digest _block _word _row _maybe digest block twice maybe row key sums cut _cut _source kin times copy _times _copy sid target toxicity _toxicity score _y rep comp Key DIGEST".split()


@pytest.fixture(scope="module")
def docs(spark):
    names = list({n.lower(): n for n in NAMES}.values())
    rows = [(i, f"text {i // 2} of the house and garden number {i // 2}", "ab"[i % 2], *(f"{n}{i // 2}" for n in names)) for i in range(40)] + [(None, None, None, *[None] * len(names))]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))


def same(docs, found):
    every = {tuple(r) for r in docs.collect()}
    rows = [tuple(r) for r in found.collect()]
    assert found.columns == docs.columns and rows and set(rows) <= every
    return rows


def test_exact_copies(spark, docs, monkeypatch):
    for most in (1 << 21, 0):
        monkeypatch.setattr(exact_dedup, "FILTER_ROWS", most)
        rows = same(docs, exact_dedup.drop_exact_copies(docs))
        assert sorted(r[0] for r in rows if r[0] is not None) == list(range(1, 40, 2)) and len(rows) == 21


def test_mixed(docs):
    rows = same(docs, mixing.mixed_documents(docs, (1, 2), 3))
    assert len(rows) >= 30


def test_near(docs):
    rows = same(docs, drop_near_duplicates(docs))
    assert {r[0] for r in rows} == {None, *range(0, 40, 2)}


def test_toxic(spark, docs):
    labels = spark.createDataFrame([(i, 0) for i in range(40)], "doc_id long, toxic int")
    assert len(same(docs, drop_toxic(docs, labels))) == 41  # without toxic labels nothing is rejected


def test_a_hot_group_overflows_its_block(spark):
    rows = [(i, "same" if i % 3 else f"text {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    found = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(df).collect()}
    assert found == {i: (2999, 2000) if t == "same" else (i, 1) for i, t in rows}
    seen = exact_dedup.repeat_filter(df.select(exact_dedup.text_digest(df.text).alias("d")), exact_dedup.F.col("d"), 4096)
    assert seen.count() < 600 and exact_dedup.ONES in {r.twice for r in seen.collect()}
