"""Packing, mixing and suffix-array dedup against brute force and their contracts; the pipeline's stages against its rules."""

import hashlib
import random
import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pixelloom.llm import packing, suffix_dedup
from pixelloom.llm.mixing import mix_sources, mixed_documents
from pixelloom.llm.queries import ORACLES
from pixelloom.llm.suffix_array import common_prefixes, suffix_array

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string"


def corpus(n=400, seed=1, hot=0.4):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = None if i == 7 else "" if i == 8 else " ".join(rng.choice("abcdef") for _ in range(rng.choice((1, 5, 40, 300, 2500))))
        if i % 11 == 3:
            text = out[rng.randrange(len(out))][1]
        source = "hot" if rng.random() < hot else rng.choice(["s1", "s2", "s3", None])
        out.append((i, text, "en", source, 0, "clash"))
    return out


def test_packing(spark):
    rows = corpus()
    df = spark.createDataFrame(rows + rows[20:40], SCHEMA)
    found = packing.pack_documents(df, capacity=1000, quota=2, rows_per_shard=150).collect()
    words = {r[0]: len((r[1] or "").split()) for r in rows}
    times = Counter(r[0] for r in rows + rows[20:40])
    covered = defaultdict(list)
    bins = defaultdict(list)
    for r in found:
        covered[r.doc_id, r.copy].append((r.word_start, r.n_words))
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
    assert {k for k, _ in covered} == set(words)
    for (doc, copy), parts in covered.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == words[doc] and copy < times[doc]
    source, text = {r[0]: r[3] for r in rows}, {r[0]: (r[1] or "").lower() for r in rows}
    for items in bins.values():
        assert 0 < sum(r.n_words for r in items) <= 1000
        assert max(Counter(source[r.doc_id] for r in items).values()) <= 2 or len(items) == 1
        assert len({text[r.doc_id] for r in items}) == len(items)
    full = sum(words[r[0]] for r in rows + rows[20:40]) / 1000
    assert len(bins) < 1.6 * full + 40
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_packing_keeps_ids(spark, monkeypatch):
    monkeypatch.setattr(packing, "COPIES", 3)
    big = 2**60 + 1
    rows = [(None, "a b", "en", "s"), (None, "c d e", "en", "s"), (big, "a b", "en", None), (big + 1, None, "en", "s"), (big, "other text", "en", "s")]
    df = spark.createDataFrame(rows + [(None, "x y", "en", "s")] * 40 + [(5, "x  y", "en", "s")] * 7, "doc_id long, text string, lang string, source string")
    for shards in (1, 10, 1000):
        found = packing.pack_documents(df, capacity=8, quota=3, rows_per_shard=shards).collect()
        assert Counter((r.doc_id, r.n_words) for r in found) == Counter({(None, 2): 41, (None, 3): 1, (big, 2): 2, (big + 1, 0): 1, (5, 2): 7})
        assert sorted(r.copy for r in found if r.doc_id == 5) == list(range(7))
        assert max(Counter((r.bin_id, r.cluster) for r in found if r.bin_id is not None).values()) == 1
    named = spark.createDataFrame([("b", "one two", "s", None), ("b", "one two", "s", 7), (None, "one", "s", 7)], "doc_id string, text string, source string, group int")
    found = packing.pack_documents(named, capacity=100, quota=9, cluster="group").collect()
    assert Counter(r.doc_id for r in found) == Counter({"b": 2, None: 1}) and len({r.bin_id for r in found}) == 2


def test_search_finds_the_tightest_bin():
    """Each piece goes into a bin with the residual that a plain search over all compatible bins finds, given the same bins."""
    rng = random.Random(3)
    items = sorted(((rng.randint(1, 60), rng.randrange(3), rng.randrange(30)) for _ in range(400)), reverse=True)
    bins, states = packing.Bins(100), {}
    for size, source, cluster in items:
        fits = [s[0] for s in states.values() if s[0] >= size and s[1][source] < 2 and cluster not in s[2]]
        b = bins.place(size, source, 10 + cluster, 2)
        state = states.setdefault(b, [100, Counter(), set()])
        assert state[0] == (min(fits) if fits else 100) and state[1][source] < 2 and cluster not in state[2]
        state[0] -= size
        state[1][source] += 1
        state[2].add(cluster)


def test_mixing(spark):
    rows = corpus(600, 4)
    df = spark.createDataFrame(rows, SCHEMA)
    first = mix_sources(df).collect()
    assert sorted(first) == sorted(mix_sources(df.repartition(7)).collect())
    total = sum(r["size"] for r in first)
    targets = {r.source_size: r.target for r in first}
    assert abs(sum(targets.values()) - min(total, 3 * total)) < 1
    source = {r[0]: r[3] for r in rows}
    taken = Counter()
    for r in first:
        taken[source[r.doc_id]] += r.taken
        assert r.taken <= 3 * r["size"] and r.taken % max(1, r["size"]) == 0
    for r in first:
        assert r.target <= 3 * r.source_size + 1e-6 and abs(taken[source[r.doc_id]] - r.target) <= 2500
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    wanted = con.execute(ORACLES["op5_mixing"]).fetchall()
    assert sorted((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken, r.times) for r in first) == sorted((a, b, c, round(d, 6), e, f) for a, b, c, d, e, f in wanted)
    mixed = Counter(r.doc_id for r in mixed_documents(df).collect())
    assert mixed == Counter({r.doc_id: r.times for r in first if r.times})
    assert mix_sources(df.limit(0)).count() == 0 and mixed_documents(df.limit(0)).count() == 0


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(200):
        n, most = rng.randint(0, 150), rng.choice((1, 2, 5, 255))
        s = bytes(rng.randint(0, most) for _ in range(n))
        if rng.random() < 0.3:
            s = (s[:15] * 15)[:n]
        a = np.frombuffer(s, np.uint8)
        order = suffix_array(a)
        assert list(order) == sorted(range(n), key=lambda i: s[i:])
        if n:
            found = common_prefixes(a, order, 50)
            for i, j in zip(order[:-1], order[1:], strict=True):
                k = 0
                while k < min(n - i, n - j, 50) and s[i + k] == s[j + k]:
                    k += 1
                assert found[j] == k


def test_suffix_array_of_runs():
    begin = time.perf_counter()
    order = suffix_array(np.full(5_000_000, 97, np.uint8))
    assert (order == np.arange(5_000_000)[::-1]).all()
    s = (b"a" * 3000 + b"b" * 2999 + b"c" + b"b" * 500 + b"a" * 700) * 2
    assert list(suffix_array(np.frombuffer(s, np.uint8))) == sorted(range(len(s)), key=lambda i: s[i:])
    assert time.perf_counter() - begin < 10


def brute_repeats(rows, length=50):
    first = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in sorted(data, key=lambda x: (x[0] is None, x[0])):
        for k in range(len(b) - length + 1):
            if i is not None:
                first.setdefault(b[k : k + length], i)
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if i is not None and first[b[k : k + length]] < i:
                gone[k : k + length] = True
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("hot", [1 << 14, 3])
def test_remove_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_DOCS", hot)
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 1 << 14)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 1 << 13)
    monkeypatch.setattr(suffix_dedup, "BUCKET_ANCHORS", 1 << 9)
    rng = random.Random(8)
    make = lambda n: "".join(rng.choice("abcdefghé ñ") for _ in range(n))
    passages = [make(n) for n in (49, 50, 51, 120, 400)]
    rows = [(0, None), (1, ""), (2, "short"), (3, "z" * 5000), (4, "y" + "z" * 3000), (5, "z" * 5000)]
    for i in range(6, 90):
        parts = [make(rng.randint(0, 90)) for _ in range(4)] + rng.sample(passages, 2)
        rng.shuffle(parts)
        rows.append((i, "".join(parts)))
    rows += [(100, rows[20][1]), (100, rows[20][1]), (None, rows[30][1]), (101, make(60_000) + passages[4])]
    df = spark.createDataFrame([(i, t, "en", "s", 0, "x") for i, t in rows], SCHEMA)
    found = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df).collect())
    assert found == brute_repeats(rows)
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_anchors_of_many_groups():
    """A bucket's time grows with its anchors, not with its groups times its anchors."""
    groups, each = 6000, 100
    rng = np.random.default_rng(2)
    codes = [np.unique(rng.integers(0, 1 << 19, each).astype(np.uint32)) for _ in range(groups)]
    docs = [np.ones(len(c), np.uint16) for c in codes]
    columns = {"codes": [c.tobytes() for c in codes], "docs": [d.tobytes() for d in docs]}
    sent = pa.table({"bucket": pa.array([5] * groups, pa.int32()), "group": pa.array(range(groups), pa.int32())} | {k: pa.array(v, pa.binary()) for k, v in columns.items()})
    begin = time.process_time()
    rows = suffix_dedup.answer_anchors(sent).to_pylist()
    assert time.process_time() - begin < 3
    often = Counter(c for part in codes for c in part.tolist())
    assert [r["group"] for r in rows] == list(range(groups)) and not any(r["hot"] for r in rows)
    for r, part in zip(rows, codes, strict=True):
        assert np.frombuffer(r["repeated"], np.uint64).tolist() == [5 << 32 | c for c in part.tolist() if often[c] > 1]


def test_suffix_arrays_hold_what_may_match(monkeypatch):
    """Segments whose anchor no other segment of the shard shares stay out of the suffix array; the answers are those of all segments."""
    rng = random.Random(9)
    make = lambda n: bytes(rng.choice(b"abcd") for _ in range(n))
    same, core, alone = make(70), make(55), make(90)
    segments = [(same, 7, 1), (core + b"x", 4, 2), (same, 3, 1), (b"y" + core, 2, 2), (alone, 9, 3)]
    built = []
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda text: built.append(len(text)) or suffix_array(text))
    data, size = np.frombuffer(b"".join(s for s, _, _ in segments), np.uint8), np.array([len(s) for s, _, _ in segments])
    found = suffix_dedup.smallest_documents(data, size, np.array([d for _, d, _ in segments]), np.array([m for _, _, m in segments], np.uint32))
    first = {}
    windows = [(s[k : k + 50], d) for s, d, _ in segments for k in range(len(s) - 49)]
    for w, d in windows:
        first[w] = min(d, first.get(w, d))
    assert found.tolist() == [first[w] for w, _ in windows]
    assert built == [2 * (len(core) + 2)]


def test_remove_repeats_of_an_id_with_other_texts(spark):
    a, b = ("".join(random.Random(seed).choice("abcdefgh ") for _ in range(300)) for seed in (1, 2))
    rows = [(3, a), (5, a), (5, b), (5, a[:200] + b[:100]), (7, b), (7, b), (7, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 0, "x") for i, t in rows], SCHEMA)
    for most in (1 << 20, 0):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(suffix_dedup, "BROADCAST_IDS", most)
            found = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df).collect())
        assert found == brute_repeats(rows)


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(500)]
    base = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(120)]
    texts = base + [base[i].upper() for i in range(10)] + [base[i] + " tail" for i in range(20, 30)] + [b + " scum idiot" for b in base[40:60]]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int(i >= 140)) for i in range(len(rows))]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = Counter(r.doc_id for r in docs.select("doc_id").collect())
    clean = set(range(140))
    assert len(set(seen["toxicity"]) & clean) > 130 and len(set(seen["toxicity"]) - clean) < 6
    assert not any(i in seen["exact_dedup"] for i in range(10) if i + 120 in seen["toxicity"])
    assert not any(i in seen["minhash"] and i - 110 in seen["minhash"] for i in range(130, 140))
    assert set(seen["mixing"]) <= set(seen["minhash"]) and max(seen["mixing"].values()) <= 3
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert packed.agg(F.sum("n_words")).first()[0] == sum(len(texts[i].split()) * n for i, n in seen["mixing"].items())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == packed.count()
