"""Exact and near dedup against brute force, with the cases that the docstrings define."""

import hashlib
import random
import re

import numpy as np
import pytest
from pixelloom.llm import minhash
from pixelloom.llm.exact_dedup import drop_exact_copies, exact_dedup
from pixelloom.llm.minhash import drop_near_duplicates, near_duplicates

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _digest string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(texts, first=0):
    return [(first + i, t, "en", "s", 0, "clash") for i, t in enumerate(texts)]


def fixture(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " \t\n", "one", "One", "ONE two", "one two", "É é", "é É", "long " * 30_000]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy).upper() if rng.random() < 0.2 else "\n".join(copy))
    return texts


def brute(texts, width, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i), find(i) == i) for i, s in enumerate(sets)}


def test_exact_dedup(spark):
    texts = fixture() * 2
    df = spark.createDataFrame([*rows(texts), (None, "one", "en", None, 0, ""), (3, "one", "de", None, 0, "")], SCHEMA)
    found = exact_dedup(df).collect()
    assert len(found) == len(texts) + 2
    groups = {}
    for r in df.collect():
        groups.setdefault(hashlib.sha256((r.text or "").translate(UPPER).encode()).hexdigest(), []).append(r.doc_id)
    for r in found:
        ids = groups[r.text_sha256]
        assert r.doc_id in ids and r.group_size == len(ids) and r.keep_id == max(i for i in ids if i is not None)
        assert r.kept == (r.doc_id == r.keep_id)
    stay = drop_exact_copies(df)
    assert stay.columns == df.columns
    assert sorted(r.doc_id for r in stay.collect()) == sorted(max(i for i in ids if i is not None) for ids in groups.values())


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert not exact_dedup(none).collect() and not drop_exact_copies(none).collect()
    assert not near_duplicates(none).collect()


def test_near_duplicates(spark):
    texts = fixture()
    df = spark.createDataFrame(rows(texts), SCHEMA)
    for width, percent in ((3, 85), (5, 80)):
        found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, width, percent).collect()}
        assert found == brute(texts, width, percent)
    more = spark.createDataFrame([*rows(texts), (None, texts[-1], "en", None, 0, ""), (0, None, "en", None, 0, "")], SCHEMA)
    kept = [r.doc_id for r in drop_near_duplicates(more, 5, 80).collect()]
    assert sorted(x for x in kept if x is not None) == sorted([i for i, v in brute(texts, 5, 80).items() if v[2]] + [0])


def hot_corpus(n, seed):
    """Families of near copies that share most buckets, with members at every distance from the first, and some that link two families."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    first = [rng.choice(words) for _ in range(150)]
    second = first[:128] + [rng.choice(words) for _ in range(22)]
    texts = []
    for i in range(n):
        base = list(first if i % 3 else second)
        for _ in range(rng.choice((0, 1, 1, 2, 3, 4, 6, 8))):
            base[rng.randrange(len(base))] = rng.choice(words)
        texts.append(" ".join(base))
    return texts


def components_by_matrix(texts, width, percent):
    """As brute(), with set sizes and intersections from one incidence matrix."""
    sets, numbers = [], {}
    for t in texts:
        w = t.split()
        sets.append(sorted({numbers.setdefault(tuple(w[i : i + width]), len(numbers)) for i in range(len(w) - width + 1)}))
    both = np.zeros((len(texts), len(texts)), np.float32)
    for low in range(0, len(numbers), 4096):
        part = np.zeros((len(texts), 4096), np.float32)
        for i, s in enumerate(sets):
            own = np.array(s)
            part[i, own[(own >= low) & (own < low + 4096)] - low] = 1
        both += part @ part.T
    size = np.array([len(s) for s in sets], np.float32)
    linked = 100 * both >= percent * (size[:, None] + size[None] - both)
    root = np.arange(len(texts))
    while True:
        new = np.where(linked, root[None], len(texts)).min(axis=1)
        new = new[new]
        if (new == root).all():
            return root, size
        root = new


@pytest.mark.parametrize(("n", "small", "block"), [(1500, 1, 3), (5000, 48, 700)])
def test_large_buckets(spark, monkeypatch, n, small, block):
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = hot_corpus(n if small > 1 else n // 10, 7)
    root, size = components_by_matrix(texts, 3, 85)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows(texts), SCHEMA), 3, 85).collect()}
    assert found == {i: (int(size[i]), int(root[i])) for i in range(len(texts))}
    assert len(set(root)) > 10


def test_blocks_repeat_a_bucket_once_for_each_block_of_strays(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 10)
    for strays in (1, 10, 25):
        members = spark.range(100).selectExpr("7L AS bucket", "100L AS many", f"{strays}L AS strays", "id AS key", f"id < {strays} AS stray")
        dealt = [(r.sb, r.mb, r.key, r.stray) for r in minhash._blocks(members).collect()]
        assert len(dealt) <= 10 * strays + 100 * -(-strays // 10)
        met = {(a, b) for sa, ma, a, x in dealt if x for sb, mb, b, y in dealt if not y and (sa, ma) == (sb, mb)}
        assert met == {(a, b) for a in range(strays) for b in range(100)}
