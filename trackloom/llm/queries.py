"""The registered query of each corpus operator, and SQL for those that SQL can express.

A query derives the columns of its contract from what its operator returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bottom_k, decontaminate, jaccard_join, line_dedup, merkle, mixing, prefix_trie, quality, secrets, substring_dedup, token_records, topk, url_filter
from .common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated().alias("contaminated"),
    )


def _listed(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), "n_novel")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weight=mixing.length_weight()).select("doc_id", "size", "source_size", "target", "taken")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_chunks", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


#: (host, path, verdict)
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def tokenizer_path() -> str:
    """The installed public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_records.new_folder(spark)
    token_records.write(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_records.index(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32", "file", "offset", "length")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    return prefix_trie.trie(table(spark, sf_dir, "conversations"), conv - conv % 100, F.crc32(conv.cast("string")) % 6)


def op12_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottom_k.near_duplicates(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return merkle.prove(table(spark, sf_dir, "documents"), tampered, merkle.lower_cased(F.col("text")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_secrets": op2_secrets,
    "op3_mixing": op3_mixing,
    "op4_line_dedup": op4_line_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_quality": op7_quality,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_topk": op9_topk,
    "op10_token_records": op10_token_records,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_near_dedup": op12_near_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: One row with the list of the 256 steps of crc32, each after eight bits.
_CRC_TABLE = "SELECT list(v ORDER BY i) AS crcs FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, (c & 1) * 3988292384)) AS v FROM range(256) AS t(i))"


def _crc32(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of an ASCII text, where `crcs` is in reach."""
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, x: xor(c >> 8, crcs[(xor(c, x) & 255) + 1])))"


ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 13) AS n, unnest(range(0, len(ws) - least(len(ws), 13) + 1)) AS i, ws FROM b WHERE len(ws) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(ws[i + 1 : i + n], ' ') AS w FROM bw),
sizes AS (SELECT DISTINCT n FROM windows),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i + 1 : i + n], ' ') AS w
       FROM (SELECT doc_id, ws, n, unnest(range(0, len(ws) - n + 1)) AS i FROM d, sizes WHERE len(ws) >= n)),
hits AS (SELECT dw.doc_id, dw.n, dw.i, windows.item_id FROM dw JOIN windows ON dw.n = windows.n AND dw.w = windows.w),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(w.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.listed, '')) AS items_sha256,
       coalesce(w.n_hit, 0) > 0 AND 20 * coalesce(w.n_hit, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN words w USING (doc_id) LEFT JOIN items i USING (doc_id)
""",
    "op5_url_filter": r"""
WITH p AS (SELECT page_id,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(rule_host, rule_path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
SELECT page_id, host, path, r.rule_host || r.rule_path AS rule, coalesce(r.verdict, 'allow') AS verdict
FROM p LEFT JOIN rules r ON (host = r.rule_host OR host LIKE '%.' || r.rule_host) AND starts_with(path, r.rule_path)
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST) = 1
""",
    "op4_line_dedup": """
WITH d AS (SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(text, chr(10)) END AS ls FROM documents),
l AS (SELECT doc_id, i, line, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h
      FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM d)),
r AS (SELECT *, coalesce((lag(h) OVER w * 1000003 + h) % 2147483647, h) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT *, i = n OR (i > 1 AND r > lag(r) OVER w AND r > lead(r) OVER w) AS ends FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, coalesce(sum(CAST(ends AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM e),
chunks AS (SELECT doc_id, c, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM c GROUP BY doc_id, c),
ranked AS (SELECT *, n >= 2 AND (row_number() OVER (PARTITION BY body, n ORDER BY doc_id, c)) > 1 AS gone FROM chunks)
SELECT d.doc_id, CAST(len(d.ls) AS INTEGER) AS n_lines, CAST(coalesce(x.n_chunks, 0) AS INTEGER) AS n_chunks, CAST(coalesce(x.n_removed, 0) AS INTEGER) AS n_removed, sha256(coalesce(x.kept, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n_chunks, sum(CASE WHEN gone THEN n ELSE 0 END) AS n_removed, string_agg(CASE WHEN NOT gone THEN body END, chr(10) ORDER BY c) AS kept
                  FROM ranked GROUP BY doc_id) x USING (doc_id)
""",
    "op8_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
dw AS (SELECT doc_id, i, array_to_string(ws[i + 1 : i + 13], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 12)) AS i FROM d WHERE len(ws) >= 13)),
firsts AS (SELECT w, min(doc_id) AS first_id FROM dw GROUP BY w),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT dw.doc_id, unnest(range(dw.i, dw.i + 13)) AS p FROM dw JOIN firsts f ON dw.w = f.w WHERE f.first_id < dw.doc_id)),
words AS (SELECT doc_id, unnest(range(0, len(ws))) AS p, unnest(ws) AS word FROM d),
kept AS (SELECT w.doc_id, count(*) AS n_kept, string_agg(w.word, ' ' ORDER BY w.p) AS kept
         FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.p = g.p WHERE g.p IS NULL GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(len(d.ws) - coalesce(k.n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id)
""",
    "op9_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""",
    "op11_prefix_trie": rf"""
WITH RECURSIVE crc_table AS ({_CRC_TABLE}),
t AS (SELECT conv_id, length(coalesce(text, '')) AS chars, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, turn FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS p FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc32('CAST(conv_id AS VARCHAR)')} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t), crc_table),
turns AS (SELECT c.conv_id, 0 AS part, p.p, p.digest, p.chars FROM c JOIN p ON p.conv_id = c.base AND p.p <= c.h
          UNION ALL SELECT c.conv_id, 1, p.p, p.digest, p.chars FROM c JOIN p ON p.conv_id = c.conv_id AND p.p > c.h),
lists AS (SELECT c.conv_id, coalesce(ds, []) AS ds, coalesce(cs, []) AS cs FROM c LEFT JOIN
          (SELECT conv_id, list(digest ORDER BY part, p) AS ds, list(chars ORDER BY part, p) AS cs FROM turns GROUP BY conv_id) USING (conv_id)),
pre AS (SELECT conv_id, d, array_to_string(ds[1 : d], ',') AS k, CASE WHEN d > 0 THEN array_to_string(ds[1 : d - 1], ',') END AS pk, d = len(ds) AS ends, CASE WHEN d > 0 THEN cs[d] ELSE 0 END AS chars
        FROM (SELECT *, unnest(range(0, len(ds) + 1)) AS d FROM lists)),
nodes AS (SELECT d, k, min(pk) AS pk, min(conv_id) AS conv_id, count(*) AS n, min(chars) AS chars, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM pre GROUP BY d, k),
children AS (SELECT d - 1 AS d, pk AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY d, pk),
whole AS (SELECT x.*, coalesce(ch.n, 0) AS n_children, y.conv_id AS parent_conv_id FROM nodes x LEFT JOIN children ch ON x.d = ch.d AND x.k = ch.k LEFT JOIN nodes y ON y.d = x.d - 1 AND y.k = x.pk),
below AS (SELECT a.d, a.k, sum((w.n - 1) * w.chars) AS saved, sum(CASE WHEN w.n_children = 0 THEN 1 ELSE 0 END) AS leaves
          FROM whole w JOIN pre a ON a.conv_id = w.conv_id AND a.d <= w.d GROUP BY a.d, a.k)
SELECT w.conv_id, CAST(w.d AS BIGINT) AS depth, w.parent_conv_id, w.n AS n_convs, w.n_children, CAST(b.leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, w.ends_sha256
FROM whole w JOIN below b ON w.d = b.d AND w.k = b.k
""",
    "op12_near_dedup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i + 1 : i + 4], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - 3, 1))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.w = b.w AND a.doc_id <> b.doc_id JOIN n x ON a.doc_id = x.doc_id JOIN n y ON b.doc_id = y.doc_id
          GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id, doc_id AS top FROM d UNION SELECT l.a, r.top FROM reach r JOIN links l ON r.doc_id = l.b),
c AS (SELECT doc_id, min(top) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN c ON d.doc_id = c.doc_id
""",
    "op13_merkle_manifest": rf"""
WITH RECURSIVE crc_table AS ({_CRC_TABLE}),
d AS (SELECT *, {_crc32('CAST(doc_id AS VARCHAR)')} % 5 = 0 AS tampered, {_LOWERED} AS lowered FROM documents, crc_table),
f AS (SELECT doc_id, source, tampered,
      concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
             coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head,
      coalesce(strlen(text) || ':' || text, '-') AS tail, CASE WHEN text IS NULL THEN '-' ELSE strlen(lowered) || ':' || lowered END AS lowered_tail FROM d),
leaves AS (SELECT doc_id, source, sha256(head || tail) AS leaf, CASE WHEN tampered THEN sha256(head || lowered_tail) ELSE sha256(head || tail) END AS start FROM f),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot, count(*) OVER (PARTITION BY source) AS n FROM leaves),
nodes AS (SELECT source, 0 AS level, spot, n, leaf AS digest FROM placed
          UNION ALL
          SELECT source, level + 1, spot // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY spot)) FROM nodes WHERE n > 1 GROUP BY source, level, spot // 16, n),
subroots AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS spot, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper AS (SELECT 0 AS level, spot, n, subroot AS digest FROM subroots
          UNION ALL
          SELECT level + 1, spot // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY spot)) FROM upper WHERE n > 1 GROUP BY level, spot // 16, n),
steps AS (SELECT a.source, a.level, a.spot, coalesce(string_agg(b.digest, '' ORDER BY b.spot) FILTER (b.spot < a.spot), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.spot) FILTER (b.spot > a.spot), '') AS r
          FROM nodes a JOIN nodes b ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND a.spot // 16 = b.spot // 16 WHERE a.n > 1 GROUP BY a.source, a.level, a.spot),
upper_steps AS (SELECT a.level, a.spot, coalesce(string_agg(b.digest, '' ORDER BY b.spot) FILTER (b.spot < a.spot), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.spot) FILTER (b.spot > a.spot), '') AS r
                FROM upper a JOIN upper b ON a.level = b.level AND a.spot // 16 = b.spot // 16 WHERE a.n > 1 GROUP BY a.level, a.spot),
walk AS (SELECT doc_id, leaf, source, spot, n, 0 AS level, start AS h, '' AS proof FROM placed
         UNION ALL
         SELECT w.doc_id, w.leaf, w.source, w.spot // 16, (w.n + 15) // 16, w.level + 1, sha256(s.l || w.h || s.r), w.proof || s.l || s.r
         FROM walk w JOIN steps s ON w.source IS NOT DISTINCT FROM s.source AND w.level = s.level AND w.spot = s.spot WHERE w.n > 1),
over AS (SELECT w.doc_id, w.leaf, s.subroot, s.spot, s.n, 0 AS level, w.h, w.proof FROM walk w JOIN subroots s ON w.source IS NOT DISTINCT FROM s.source WHERE w.n = 1
         UNION ALL
         SELECT w.doc_id, w.leaf, w.subroot, w.spot // 16, (w.n + 15) // 16, w.level + 1, sha256(s.l || w.h || s.r), w.proof || s.l || s.r
         FROM over w JOIN upper_steps s ON w.level = s.level AND w.spot = s.spot WHERE w.n > 1)
SELECT o.doc_id, o.leaf, o.subroot, u.digest AS root, sha256(o.proof) AS proof_sha256, o.h AS folded_root, o.h = u.digest AS verified
FROM over o, upper u WHERE o.n = 1 AND u.n = 1
""",
}
