"""Executors without this package, and memory that texts and labels can't blow up."""

import os
import random
import string
import subprocess
import sys
import tracemalloc

import numpy as np
import pytest
from pixelloom.llm import secrets, textcnn, toxicity

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

CODE = """
import sys, tempfile
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").getOrCreate()
def there(_):
    try:
        import pixelloom
        yield True
    except ImportError:
        yield False
assert spark.sparkContext.parallelize([1], 1).mapPartitions(there).collect() == [False]
sys.path.insert(0, {root!r})
from pixelloom.llm.queries import QUERIES
for name, query in QUERIES.items():
    assert query(spark, "/root/testdata/sf0.001").count() > 0, name
print("ALL", len(QUERIES))
"""


def test_executors_need_no_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(root=ROOT)], cwd=tmp_path, capture_output=True, text=True, env=env, timeout=900)
    assert done.returncode == 0 and "ALL 13" in done.stdout, done.stderr[-3000:]


@pytest.fixture(scope="module")
def model():
    return secrets.SecretModel()


def test_pieces_score_as_the_whole(model, monkeypatch):
    rng = random.Random(1)
    runs = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n)) for n in (16, 63, 64, 65, 1000, 40, 129)]
    windows = [secrets.windowed(f"key {r} end", 4, 4 + len(r)) for r in runs]
    whole = model.logits(windows)
    for piece in (7, 64, 1 << 30):
        monkeypatch.setattr(textcnn, "PIECE", piece)
        assert np.allclose(model.logits(windows), whole, atol=1e-4)


def test_a_long_run_needs_little_memory(model):
    rng = random.Random(2)
    text = "src=data:" + "".join(rng.choices(string.ascii_letters + string.digits, k=10_000_000)) + " password = hunter2hunter2"
    tracemalloc.start()
    spans = secrets.scan([text], model)[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [k for *_, k in spans] == ["network", "assign"] and spans[0][:2] == (9, 10_000_009) and peak < 500e6


def test_the_sample_is_bounded(spark, monkeypatch):
    rows = [(1, f"bad word number {i}") for i in range(20_000)] + [(1, "the same text")] * 20_000 + [(i, f"good text {i}") for i in range(2, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(1, 1)] + [(i, i % 2) for i in range(2, 300)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity.ToxicityModel, "fit", lambda self, ids, lengths, y: seen.append((len(y), int(y.sum()), int(lengths.sum()))))
    toxicity.train(docs, labels)
    (n, toxic, _), = seen
    assert toxic == toxicity.MAX_POSITIVE and n - toxic > 100 and n <= toxicity.MAX_POSITIVE + toxicity.MAX_NEGATIVE
    monkeypatch.setattr(toxicity, "MAX_TOTAL", 1000)
    toxicity.train(docs, labels)
    assert 20 < seen[1][0] < 100
