"""Ranked search, WARC archives and Merkle manifests against brute force, and the cases that their docstrings define."""

import base64
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pixelloom.llm import lexical, merkle, warc
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, root string, tree string, score long"


def odd_documents(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Haus", "ÉTÉ", "été", "über", "naïve", "x" * 300, "漢字", "A1", "a1"]
    rows = []
    for i in range(n):
        text = rng.choice((" ", "-", "\n", "\x00", "_")).join(rng.choice(words) for _ in range(rng.choice((0, 1, 5, 30, 200))))
        rows.append((i * 3 % n, text, rng.choice((None, "en", "fr", "de", "é", "")), rng.choice((None, "a", "web")), rng.choice((None, len(text), 0)), "r", "t", 1))
    rows += [(None, "w1 w2 w3", "en", None, 8, None, None, None), (5, None, None, None, None, None, None, None), (7, "", "en", "", 0, "", "", 0), rows[3], rows[3], (9, "w1 " * 40_000 + "rare", "fr", "a", 1, None, None, None)]
    return rows


def test_numbers_keep_their_value():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**40, 2**62 + 3])
    data, ends = lexical.packed(values)
    assert lexical.unpacked(data.tobytes()).tolist() == values.tolist() and ends[-1] == len(data)
    assert lexical.unpacked(b"").tolist() == [] and lexical.packed(np.array([], np.int64))[0].tolist() == []


def terms_of(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def ranked(docs, queries, k):
    counted = [(r[0], terms_of(r[1])) for r in docs]
    counted = [(d, t) for d, t in counted if t]
    n, total = len(counted), sum(len(t) for _, t in counted)
    asked = {}
    for q, text in queries:
        asked.setdefault(q, set()).update(terms_of(text))
    df = {}
    for _, t in counted:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for q, terms in asked.items():
        found = []
        for d, t in counted:
            m = 100 - 90 + (90 * len(t) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((1000000000 * t.count(x)) // (1000 * t.count(x) + 8 * m)) for x in terms if x in df and x in t)
            if s > 0:
                found.append((-s, d is not None, d or 0, d))
        out += [(q, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [False, True])
def test_ranked_search(spark, monkeypatch, small):
    if small:  # many shards, blocks of queries, and terms that are not sent
        monkeypatch.setattr(lexical, "SHARD_BYTES", 3000)
        monkeypatch.setattr(lexical, "PIECE", 200)
        monkeypatch.setattr(lexical, "QUERY_BLOCK", 2)
        monkeypatch.setattr(lexical, "SENT_TERMS", 0)
    docs = odd_documents(300)
    queries = [(1, "w1 W2 w3 w3 haus"), (2, "ÉTÉ 漢字 unheard"), (3, None), (4, ""), (5, "rare " + "x" * 300), (6, " ".join(f"w{i}" for i in range(40))), (6, "a1"), (None, "w7,w9;naïve")]
    df = spark.createDataFrame(docs, DOCS).repartition(3)
    asked = spark.createDataFrame(queries, "item_id long, text string")
    found = lexical.ranked_search(df, asked)
    assert found.columns == ["item_id", "rank", "doc_id", "score"] and dict(found.dtypes)["rank"] == "int"
    assert sorted((tuple(r) for r in found.collect()), key=str) == ranked(docs, queries, 10)


def test_merge_of_postings_misses_nothing():
    rng = random.Random(3)
    for case in range(200):
        lists, totals = [], {}
        for _ in range(rng.randint(1, 8)):
            docs = sorted(rng.sample(range(60), rng.randint(1, 50)))
            adds = [rng.choice((1, 2, 3, 50)) for _ in docs]
            for d, a in zip(docs, adds):
                totals[d] = totals.get(d, 0) + a
            lists.append((memoryview(np.array(docs)), memoryview(np.array(adds)), max(adds)))
        k = rng.choice((1, 3, 10))
        assert lexical.best_documents(lists, k) == [(s, d) for d, s in sorted(totals.items(), key=lambda x: (-x[1], x[0]))[:k]], case


def test_terms_with_one_first_hash_stay_apart(monkeypatch):
    def alike(data):
        starts, first, second = real(data)
        return starts, first % np.uint64(3), second

    real = lexical._hashed
    shard, other = lexical.Shard(), lexical.Shard()
    text = "one two three four five six one two one".encode()
    other.add([1], np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    monkeypatch.setattr(lexical, "_hashed", alike)
    shard.add([1], np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    counts = [sorted(lexical.unpacked(x.as_py())[1] for x in s.rows(0).column(4)[1:]) for s in (shard, other)]
    assert counts == [[1, 1, 1, 1, 2, 3]] * 2


def H(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def manifest(rows):
    """Leaves, proofs and folded roots by the definition, levels as lists."""
    text = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
        return levels

    def climb(levels, i, node):
        siblings = []
        for level in levels[:-1]:
            s = level[i ^ 1] if i ^ 1 < len(level) else None
            node = H(node) if s is None else H(s, node) if i & 1 else H(node, s)
            siblings += [s] if s else []
            i //= 2
        return node, siblings

    groups = {}
    for d, content, lang, source, n, *_ in rows:
        leaf = H(*map(text, (d, source, lang, n, content)))
        hit = d is not None and zlib.crc32(str(d).encode()) % 7 == 0
        groups.setdefault(lang, []).append((d is not None, d or 0, leaf, d, H(*map(text, (d, source, lang, n if n is None else n + 1, content))) if hit else leaf))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g])]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for j, g in enumerate(names):
        for i, (_, _, leaf, d, used) in enumerate(sorted(groups[g])):
            node, own = climb(trees[g], i, used)
            end, more = climb(top, j, node)
            out.append((d, leaf, trees[g][-1][0], top[-1][0], H(*own, *more), end, end == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_manifest(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", levels)
    rows = odd_documents(60 if levels < 8 else 400) + [(1000 + i, "t", f"lang{i}", None, None, None, None, None) for i in range(5)]
    found = merkle.manifest_proofs(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert sorted((tuple(r) for r in found), key=str) == manifest(rows)
    assert {r.verified for r in found} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 100, 256])
def test_paths_advance_leaf_by_leaf(n):
    nodes = [H(str(i)) for i in range(n)]
    for levels in {merkle.height(n), 8}:
        whole = [nodes]
        for _ in range(levels):
            whole.append([H(*whole[-1][i : i + 2]) for i in range(0, len(whole[-1]), 2)])
        for i, siblings in enumerate(merkle.authentication_paths(nodes, levels)):
            assert siblings == [level[(i >> k) ^ 1] if (i >> k) ^ 1 < len(level) else None for k, level in enumerate(whole[:-1])]
            assert merkle.folded(nodes[i], merkle.path_text(i, siblings)) == whole[-1][0]


def odd_pages(n):
    rng = random.Random(4)
    rows = [(i, rng.choice((f"https://www.Host{i % 3}.example.org/p/{i % 5}?q={i}#x", "no address", None, "http://h.example/a b\r\nX-Evil: 1\t\x00", f"http://[::1]:80/{i}")), rng.choice((None, "", f"<p>{i}</p>", "<p>same</p>", "é\r\n\r\n\x00", "long " * 50_000)), "x", i) for i in range(n)]
    return rows + [(None, "http://h/1", "<p>same</p>", "x", 0), (None, None, "only null", "x", 0), (None, None, "only null", "x", 0), (n, "http://h/2", "twice", "x", 0), (n, "http://h/2", "twice", "x", 0)]


PAGES = "page_id long, url string, html string, file string, offset long"


@pytest.mark.parametrize("small", [False, True])
def test_archives(spark, monkeypatch, small):
    least = 5 if small else 0
    if small:  # many blocks, index files, archives and slices
        for name, value in (("BLOCK_LINES", 3), ("FILE_BLOCKS", 2), ("ARCHIVE_BYTES", 3000), ("SLICE", 1), ("READ_BYTES", 10)):
            monkeypatch.setattr(warc, name, value)
    rows = odd_pages(150)
    found = warc.archived_pages(spark.createDataFrame(rows, PAGES).repartition(4), least=least).collect()
    keep = {}
    for i, _, html, *_ in rows:
        keep[html or ""] = max(keep.get(html or "", -1), -1 if i is None else i)
    wanted = []
    for i, _, html, *_ in rows:
        data, best = (html or "").encode(), keep[html or ""]
        first = len(data) < least or best == (-1 if i is None else i)
        wanted.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else best))
    assert sorted((tuple(r) for r in found), key=str) == sorted(wanted, key=str)


def test_an_index_is_searched_by_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 10)
    captures = [(f"com,host{i % 7})/{i % 50:03d}", str(i % 10), "a", 100 * i, 7) for i in range(2000)] + [("com,hot)/", "1", "b", i, 9) for i in range(500)]
    index = warc.capture_index(spark.createDataFrame(captures, "key string, id string, file string, offset long, length long").repartition(5), f"file://{tmp_path}")
    reader = index.open()
    for key, ident in {(c[0], c[1]) for c in captures} | {("com,host1)/", "1"), ("a", ""), ("zz", "9")}:
        wanted = sorted(c[2:] for c in captures if c[:2] == (key, ident))
        assert sorted(reader.find((key.encode(), ident.encode()))) == wanted
        parts = [x for p in range(4) for x in reader.find((key.encode(), ident.encode()), p, 4)]
        assert sorted(parts) == wanted
    cold = index.open()
    assert len(list(cold.find((b"com,host3)/003", b"3")))) == 6 and cold.reads <= 6  # a directory and two blocks at most, in two files


def test_damaged_records_are_found():
    whole = warc.warc_record("7", "http://h/", b"<p>text</p>", warc.digest_text(b"<p>text</p>"))
    headers, payload = warc.read_record(whole)
    assert payload == b"<p>text</p>" and headers["warc-type"] == "response" and headers["warc-record-id"] == "<urn:row:7>"
    raw = zlib.decompress(whole, 31)
    pack = lambda data: (c := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(data) + c.flush()
    for bad in (whole[:-9], whole[5:], b"", pack(raw.replace(b"text</p>", b"test</p>")), pack(raw[:-4]), pack(b"nothing"), pack(raw.replace(b"WARC/1.1", b"HTTP/1.1"))):
        with pytest.raises(ValueError):
            warc.read_record(bad)


def test_keys_run_from_the_top(spark):
    df = spark.createDataFrame([("HTTP://WWW.Example.com/a/B?x=1#f",), (None,), ("none",), ("http://h",)], "url string")
    assert [r[0] for r in df.select(warc.url_key(F.col("url"))).collect()] == ["com,example,www)/a/B?x=1", ")", ")", "h)"]


def test_empty(spark):
    docs, pages = spark.createDataFrame([], DOCS), spark.createDataFrame([], PAGES)
    items = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert [df.collect() for df in (lexical.ranked_search(docs, items), lexical.ranked_search(docs, items.limit(0)), warc.archived_pages(pages), merkle.manifest_proofs(docs))] == [[]] * 4
