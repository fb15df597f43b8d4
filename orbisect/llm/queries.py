"""The corpus operators' queries with their production parameters, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import centroids, conversation_trie, decontamination, html_text, imatch, line_dedup, mixing, pieces, quality, simhash, token_files, url_rules, warc

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"), mixing.Mix())


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archived(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The digest's base 32 is spelled out from the hexadecimal one.
SQL_WARC = """
WITH payloads AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (SELECT *, array_to_string(list_transform(string_split(hex, ''), lambda x: lpad(bin(strpos('0123456789abcdef', x) - 1), 4, '0')), '') AS b FROM payloads),
named AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + list_sum(list_transform(range(0, 5), lambda j: (1 << (4 - j)) * (substr(b, 5 * i + j + 1, 1) = '1')::INTEGER))::INTEGER, 1)), '') AS payload_digest,
         max(page_id) OVER (PARTITION BY hex) AS kept
  FROM bits)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id IS DISTINCT FROM kept AND kept IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM kept THEN kept END AS refers_to
FROM named
"""


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return docs.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


SQL_LINE_DEDUP = """
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
pos AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM docs),
keyed AS (
  SELECT doc_id, line, i, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM pos),
frequent AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
flagged AS (SELECT keyed.*, frequent.k IS NOT NULL AS gone FROM keyed LEFT JOIN frequent ON keyed.k = frequent.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digested(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.grouped(table(spark, sf_dir, "documents").select("doc_id", "text"), size=3, most=3)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprinted(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rated(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


#: Fixed rules of the query.
URL_RULES = tuple(
    url_rules.path_rule(text, verdict)
    for verdict, text in (
        ("block", "com/en/"),
        ("allow", "example.com/en/7"),
        ("allow", "net/de/"),
        ("block", "example.net/de/8"),
        ("block", "org/es/"),
    )
)


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judged(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


SQL_URL_RULES = """
WITH parts AS (
  SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1) AS raw_host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
named AS (SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts),
rules(rule, rule_host, rule_path, verdict) AS (VALUES
  ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'allow'),
  ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
ranked AS (
  SELECT page_id, host, path, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) AS n
  FROM named LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM ranked WHERE n = 1
"""


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), centroids.Clustering())


def sql_centroids(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """The rounds, each a pair of tables: vectors with their nearest centroid, then the next centroids."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""near{n} AS MATERIALIZED (
  SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': d, 'c': c}}) AS best
  FROM (SELECT rid, vec_id, v, c, list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, c{n}) GROUP BY rid)""")
        if n < rounds:
            steps.append(f"""sums{n} AS (
  SELECT c, d, sum(x) AS s, count(*)::HUGEINT AS n
  FROM (SELECT best.c AS c, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM near{n}) GROUP BY c, d),
means{n} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY d) AS m FROM sums{n} GROUP BY c),
c{n + 1} AS MATERIALIZED (SELECT old.c, coalesce(means{n}.m, old.m) AS m FROM c{n} AS old LEFT JOIN means{n} ON old.c = means{n}.c)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS m FROM (SELECT sha256('3:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT {k})),
{(","  + chr(10)).join(steps)},
ends AS (SELECT c, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM c{rounds})
SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia,
       (sum(best.d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM near{rounds} JOIN ends ON best.c = ends.c
"""


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    found = decontamination.scanned(docs, items, size=10, columns=["doc_id"])
    listed = F.array_join(F.array_sort(F.transform("found.item_ids", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", F.col("found.n_words").alias("n_words"), F.col("found.n_hit").alias("n_hit"), F.size("found.item_ids").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"), (F.col("found.n_hit") > 0).alias("contaminated"),
    )


SQL_DECONTAMINATION = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
wins AS (SELECT DISTINCT item_id, ws[i:i + 9] AS win FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM items WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM wins),
grams AS (SELECT r, i, n, ws[i:i + n - 1] AS win FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM docs, sizes WHERE len(ws) >= n)),
met AS (SELECT r, i, n, item_id FROM grams JOIN wins ON grams.win = wins.win),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM met) GROUP BY r),
own AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS listed FROM (SELECT DISTINCT r, item_id FROM met) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit ON docs.r = hit.r LEFT JOIN own ON docs.r = own.r
"""


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"), family=5, heads=9)
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: crc32 a byte, then eight bits, at a time; -1 stands for a bit.
SQL_CONVERSATION_TRIE = """
WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS ts FROM turns GROUP BY conv_id),
crc AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: list_prepend(ascii(ch)::BIGINT, [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1])))),
         lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 9 AS h
  FROM own),
convs AS (SELECT a.conv_id, list_concat(coalesce(b.ts, [])[:a.h], a.ts[a.h + 1:]) AS ts FROM crc AS a LEFT JOIN own AS b ON b.conv_id = a.conv_id - ((a.conv_id % 5) + 5) % 5),
members AS (SELECT conv_id, len(ts) AS n, d, ts[:d] AS p FROM (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS d FROM convs)),
nodes AS (
  SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
  FROM members GROUP BY d, p),
kids AS (SELECT d - 1 AS d, p[:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2),
told AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children, CASE WHEN nodes.d > 0 THEN (n_convs - 1) * strlen(nodes.p[nodes.d].text) ELSE 0 END AS saved
  FROM nodes LEFT JOIN kids ON nodes.d = kids.d AND nodes.p = kids.p),
sums AS (
  SELECT a AS d, p[:a] AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT p, n_children, saved, unnest(range(0, d + 1)) AS a FROM told) GROUP BY 1, 2)
SELECT told.conv_id, told.d::BIGINT AS depth, up.conv_id AS parent_conv_id, told.n_convs, told.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, told.ends_sha256
FROM told JOIN sums ON told.d = sums.d AND told.p = sums.p LEFT JOIN nodes AS up ON up.d = told.d - 1 AND up.p = told.p[:told.d - 1]
"""


def queries() -> dict[str, Query]:
    return {
        "op1_token_files": op1_token_files,
        "op2_mixing": op2_mixing,
        "op3_warc": op3_warc,
        "op4_line_dedup": op4_line_dedup,
        "op5_url_rules": op5_url_rules,
        "op6_pieces": op6_pieces,
        "op7_simhash": op7_simhash,
        "op8_imatch": op8_imatch,
        "op9_quality": op9_quality,
        "op10_html_text": op10_html_text,
        "op11_centroids": op11_centroids,
        "op12_decontamination": op12_decontamination,
        "op13_conversation_trie": op13_conversation_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc": SQL_WARC,
        "op4_line_dedup": SQL_LINE_DEDUP,
        "op5_url_rules": SQL_URL_RULES,
        "op11_centroids": sql_centroids(),
        "op12_decontamination": SQL_DECONTAMINATION,
        "op13_conversation_trie": SQL_CONVERSATION_TRIE,
    }
