"""URL filters: host-suffix and path-prefix expressions matched by hash prefix, then by digest.

A rule is (host, path, verdict).  It fits its host and all subdomains, if the
URL's path starts with the rule's path; the longest fitting rule wins.  Each URL
is expanded only into suffixes with as many labels, and prefixes with as many
characters, as some rule has, so long hosts and paths make no more expressions
than short ones and none is missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of a digest that the join compares before the whole digests are.
PREFIX_DIGITS = 8
#: Rules up to this many bytes of text are broadcast; more are shuffled, with salted expressions.
BROADCAST_BYTES = 8 << 20
SALTS = 16


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of urls(page_id, url).

    rules(host, path, verdict): rows with a null are left out; of equal rules the
    one with the smaller verdict holds (allow before block).  A null URL, or one
    without `://`, has an empty host and path, which no rule fits.  Repeated rows
    come back as often as they occur.  Other columns are not read.
    """
    named = rules.dropna(subset=["host", "path", "verdict"]).groupBy(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path")).agg(F.min("verdict").alias("rule_verdict"))
    named = named.withColumn("rule_digest", _digest(F.col("rule_host"), F.col("rule_path"))).withColumn("rule_key", F.substring("rule_digest", 1, PREFIX_DIGITS))
    size = named.agg(
        F.coalesce(F.sum(F.octet_length("rule_host") + F.octet_length("rule_path") + 100), F.lit(0)).alias("bytes"),
        F.collect_set(F.size(F.split("rule_host", r"\."))).alias("labels"),
        F.collect_set(F.length("rule_path")).alias("lengths"),
    ).first()

    # One row per distinct (page, host, path) with its number of copies: a page that
    # comes very often is summed up before it is dealt out.
    pages = urls.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")).groupBy("page_id", "host", "path").agg(F.count("*").alias("copies"))
    labels, n = F.split("host", r"\."), F.size(F.split("host", r"\."))
    suffixes = [F.when(n >= k, F.array_join(F.slice(labels, n - k + 1, k), ".")) for k in sorted(size["labels"])]
    prefixes = [F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in sorted(size["lengths"])]
    pairs = [F.when(s.isNotNull() & p.isNotNull(), _digest(s, p)) for s in suffixes for p in prefixes]
    expressions = F.array_compact(F.array(*pairs)) if pairs else F.array().cast("array<string>")
    probes = pages.select("page_id", "host", "path", "copies", F.explode_outer(expressions).alias("digest")).withColumn("key", F.substring("digest", 1, PREFIX_DIGITS))
    if size["bytes"] <= broadcast_bytes:
        joined = probes.join(F.broadcast(named), F.col("key") == F.col("rule_key"), "left")
    else:
        probes = probes.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)))
        spread = named.withColumn("rule_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
        joined = probes.join(spread, (F.col("key") == F.col("rule_key")) & (F.col("salt") == F.col("rule_salt")), "left")
    fits = F.col("digest") == F.col("rule_digest")
    name = F.concat("rule_host", "rule_path")
    best = F.max(F.when(fits, F.struct(F.length(name).alias("size"), F.length("rule_host").alias("host_size"), name.alias("rule"), F.col("rule_verdict").alias("verdict")))).alias("best")
    return (
        joined.groupBy("page_id", "host", "path", "copies")
        .agg(best)
        .select(
            "page_id",
            "host",
            "path",
            F.col("best.rule").alias("rule"),
            F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
            F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
        )
        .drop("copy")
    )
