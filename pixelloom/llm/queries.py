"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER
from .exact_dedup import exact_dedup
from .html_extract import extract_text
from .lexical import ranked_search
from .media import media_digests
from .merkle import FIELDS, TAMPERED, manifest_proofs
from .minhash import near_duplicates
from .mixing import mix_sources
from .packing import pack_documents
from .secrets import scan_secrets, secret_digests
from .suffix_dedup import remove_repeats
from .toxicity import score_toxicity
from .url_filter import canonical, filter_urls, url_host
from .warc import archived_pages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Fixed value: a term of ranked search, as its contract defines it.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Host, path and verdict of the URL rules.
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: A page's canonical URL is put on the list if a label of its host is one of these; a production run passes its own list.
LISTED_LABELS = ("cheap-pills", "free-bets")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    bad = F.arrays_overlap(F.split(url_host(F.col("url")), r"\."), F.array(*map(F.lit, LISTED_LABELS)))
    listed = pages.where(bad).select(canonical(F.col("url")).alias("canonical"))
    return filter_urls(pages, listed, URL_RULES)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"), (1, 2, 3), 3)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(scan_secrets(_table(spark, sf_dir, "documents")))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(_table(spark, sf_dir, "pages"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_proofs(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_packing": op2_packing,
    "op3_url_filter": op3_url_filter,
    "op4_media": op4_media,
    "op5_mixing": op5_mixing,
    "op6_html": op6_html,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_secrets": op10_secrets,
    "op11_lexical_search": op11_lexical_search,
    "op12_warc": op12_warc,
    "op13_merkle": op13_merkle,
}

def _rules_sql(index: int) -> str:
    ordered = sorted(URL_RULES, key=lambda r: -len(r[0]) - len(r[1]))
    return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, v)[index]}'" for h, p, v in ordered) + " END"


def _crc_sql(text: str) -> str:
    """Unsigned crc32 of ASCII text, four bits at a time, by a table made from the reflected polynomial."""
    table = []
    for x in range(16):
        for _ in range(4):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        table.append(x)
    step = lambda crc, bits: f"xor({crc} >> 4, {table}[1 + ({bits})])"
    low = step("c", "xor(c, b) & 15")
    both = step(low, f"xor({low}, b >> 4) & 15")
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: {both}), 4294967295::BIGINT)"


def _field_sql(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR, '-')"


def _climb_sql(name: str, levels: str, of: str, i: str, seed: str) -> str:
    """A node's way up: at each level the sibling joins on its side, or the node is hashed alone."""
    return f"""
  SELECT {seed}
  UNION ALL
  SELECT f.{of}, f.{i}, f.k // 2, f.lvl + 1, (f.n + 1) // 2,
         sha256(CASE WHEN s.node IS NULL THEN f.node WHEN f.k % 2 = 1 THEN s.node || f.node ELSE f.node || s.node END), f.proof || coalesce(s.node, '')
  FROM {name} f LEFT JOIN {levels} s ON s.{of} IS NOT DISTINCT FROM f.{of} AND s.lvl = f.lvl AND s.i = xor(f.k, 1) WHERE f.n > 1"""


ORACLES = {
    "op3_url_filter": rf"""
WITH parts AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^?#]*\?([^#]*)', 1), '') AS query
  FROM pages),
named AS (
  SELECT *, array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref)(=|$)'))), '&') AS kept FROM parts),
canon AS (
  SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS canonical FROM named),
listed AS (
  SELECT DISTINCT canonical FROM canon WHERE list_has_any(string_split(host, '.'), {list(LISTED_LABELS)})),
judged AS (
  SELECT page_id, host, path, {_rules_sql(0)} AS rule, {_rules_sql(1)} AS rule_verdict, canonical IN (SELECT canonical FROM listed) AS hit FROM canon)
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN hit THEN 'block' ELSE 'allow' END) AS verdict, hit AND rule IS NULL AS listed FROM judged
""",
    "op5_mixing": rf"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('7:' || coalesce(doc_id::VARCHAR, '')) AS ord FROM documents),
sources AS (
  SELECT *, source_size * 3 AS most, (1 + (sid - 1) % 3)::BIGINT AS weight, sum(source_size) OVER ()::BIGINT AS budget
  FROM (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM sizes GROUP BY source)),
running AS (
  SELECT *, coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS fill, sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS rest,
         most::DOUBLE / weight AS limit_at, row_number() OVER o AS place
  FROM sources WINDOW o AS (ORDER BY most::DOUBLE / weight, sid)),
level AS (
  SELECT arg_min((budget - fill)::DOUBLE / rest, place) AS level FROM running WHERE (budget - fill)::DOUBLE / rest <= limit_at),
targets AS (
  SELECT source, sid, source_size, budget, coalesce(least(most::DOUBLE, level * weight), most::DOUBLE) AS target FROM running LEFT JOIN level ON true),
queued AS (
  SELECT d.doc_id, d.size, d.ord, t.*, sum(d.size) OVER (PARTITION BY sid ORDER BY ord, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM sizes d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT *, epoch * source_size + upto AS done, (epoch * source_size + upto)::DOUBLE / target AS finish
  FROM queued, (VALUES (0), (1), (2)) e(epoch) WHERE target > 0 AND epoch * source_size + upto - size < target),
cut AS (
  SELECT *, sum(size) OVER (ORDER BY finish, ord, doc_id, epoch, size ROWS UNBOUNDED PRECEDING) AS used FROM copies),
taken AS (
  SELECT doc_id, count(*) AS times FROM cut WHERE used <= budget GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, (q.size * coalesce(t.times, 0))::BIGINT AS taken, coalesce(t.times, 0)::INTEGER AS times
FROM queued q LEFT JOIN taken t USING (doc_id)
""",
    "op8_exact_dedup": f"""
WITH b AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
FROM b WINDOW w AS (PARTITION BY text_sha256)
""",
    "op11_lexical_search": rf"""
WITH words AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM documents),
counted AS (
  SELECT row, doc_id, len(terms) AS n, terms FROM words WHERE len(terms) > 0),
whole AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM counted),
tf AS (
  SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(terms) AS term FROM counted) GROUP BY row, term),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole WHERE term IN (SELECT term FROM asked) GROUP BY term),
scores AS (
  SELECT item_id, c.doc_id, c.row, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN counted c ON c.row = tf.row, whole GROUP BY item_id, c.doc_id, c.row),
ranked AS (
  SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST))::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
""",
    "op12_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keep FROM pages),
d AS (
  SELECT *, sha1(html) AS hex FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (k // 4)::INTEGER, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::INTEGER, 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM keep THEN keep END AS refers_to
FROM d
""",
    "op13_merkle": f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, sha256({" || ".join(map(_field_sql, FIELDS))}) AS leaf,
         CASE WHEN {_crc_sql("doc_id::VARCHAR")} % {TAMPERED} = 0 THEN sha256({" || ".join(_field_sql(f if f != "n_chars" else "n_chars::HUGEINT + 1") for f in FIELDS)}) END AS changed
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
nodes AS (
  SELECT lang, 0 AS lvl, i, n, leaf AS node FROM placed
  UNION ALL
  SELECT lang, lvl + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(node, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY lang, lvl, i // 2),
subroots AS (
  SELECT 0 AS tree, lang, node, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT tree, 0 AS lvl, i, n, node FROM subroots
  UNION ALL
  SELECT tree, lvl + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(node, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY tree, lvl, i // 2),
ways AS ({_climb_sql("ways", "nodes", "lang", "i", "lang, i, i AS k, 0 AS lvl, n, coalesce(changed, leaf) AS node, '' AS proof FROM placed")}),
climbs AS ({_climb_sql("climbs", "tops", "tree", "own", "w.tree, w.own, s.i AS k, 0 AS lvl, s.n, w.node, w.proof FROM (SELECT 0 AS tree, {'lang': lang, 'i': i} AS own, lang, node, proof FROM ways WHERE n = 1) w JOIN subroots s ON s.lang IS NOT DISTINCT FROM w.lang")})
SELECT p.doc_id, p.leaf, s.node AS subroot, t.node AS root, sha256(o.proof) AS proof_sha256, o.node AS folded_root, o.node = t.node AS verified
FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang JOIN (SELECT node FROM tops WHERE n = 1) t ON true
JOIN climbs o ON o.n = 1 AND o.own.i = p.i AND o.own.lang IS NOT DISTINCT FROM p.lang
""",
}
