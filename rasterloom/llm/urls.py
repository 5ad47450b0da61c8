"""URL rules by a blocked Bloom filter and an exact hash join; DataFrame functions only.

A listed entry is a canonical (host, path) pair. For each url, the pairs of the shapes that the list has
(so many labels of the host, so many characters of the path) are probed in the filter; only possible hits go
on to the join with the list, which drops what the filter lets through by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER

#: Bits of the filter for each listed entry, and the most 64-bit blocks it may have: 2 MB at most.
BITS_PER_ENTRY, MAX_BLOCKS, PROBES = 24, 1 << 18, 4
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    """(verdict, rule_host, rule_path)"""
    if not rules:
        return spark.sql("SELECT '' AS verdict, '' AS rule_host, '' AS rule_path WHERE false")
    quoted = ", ".join("(" + ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in r) + ")" for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {quoted} AS t(verdict, rule_host, rule_path)")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or where there is no `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    authority = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(authority) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(authority, UPPER, LOWER), path


def _block(hashed: Column, blocks: int) -> Column:
    return F.pmod(hashed, F.lit(blocks)).cast("int")


def _mask(hashed: Column) -> Column:
    again = F.xxhash64(hashed)
    one = F.lit(1).cast("bigint")
    mask = None
    for i in range(PROBES):
        at = F.shiftrightunsigned(again, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        bit = F.call_function("shiftleft", one, at)
        mask = bit if mask is None else mask.bitwiseOR(bit)
    return mask


def bloom_filter(rules: DataFrame, blocks: int) -> DataFrame:
    """One row with one array of `blocks` 64-bit words; entry (host, path) sets PROBES bits of one word."""
    hashed = rules.select(F.xxhash64("rule_host", "rule_path").alias("h")).distinct()
    words = hashed.groupBy(_block(F.col("h"), blocks).alias("at")).agg(F.bit_or(_mask(F.col("h"))).alias("word"))
    all_ = rules.sparkSession.range(blocks).select(F.col("id").cast("int").alias("at")).join(words, "at", "left")
    return all_.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce("word", F.lit(0)).alias("word")))), lambda x: x["word"]).alias("words"))


def judge(pages: DataFrame, rules: DataFrame, *, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict), a row for each row of pages.

    A rule fits its host and all subdomains, if the path starts with the rule's; the longest wins (a tie is
    broken by the rule's text). Without a fitting rule, rule is null and the verdict `default`: the url is
    not listed. Null urls and ids, empty urls, repeated rows and an empty table or list are fine; further
    columns of pages are not read. The filter has at most MAX_BLOCKS words, however long the list is; the
    join is exact at any fill, and Spark broadcasts the list only under its own size threshold.
    """
    host, path = host_and_path(F.col(f"`{url}`"))
    pages = pages.select(F.col(f"`{page_id}`").alias("page_id"), host.alias("host"), path.alias("path"))
    rules = rules.where("rule_host IS NOT NULL AND rule_path IS NOT NULL").dropDuplicates(["rule_host", "rule_path"])
    listed, blocks = rules.count(), 1
    while blocks < MAX_BLOCKS and blocks * 64 < listed * BITS_PER_ENTRY:
        blocks *= 2
    # Shapes are at most (labels of the longest host) x (lengths of paths) pairs of small numbers.
    shapes = rules.agg(F.collect_set(F.struct(F.size(F.split("rule_host", r"\.")).alias("labels"), F.length("rule_path").alias("size"))).alias("s"))
    one = pages.groupBy("page_id", "host", "path").agg(F.count("*").alias("copies"))
    suffix = F.when(F.col("shape.labels") > 0, F.call_function("substring_index", F.col("host"), F.lit("."), -F.col("shape.labels")))
    probe = one.select("*", F.explode_outer(shapes.scalar()).alias("shape")).select("page_id", "host", "path", "copies", suffix.alias("h"), F.substring("path", F.lit(1), F.col("shape.size")).alias("p"))
    hashed = F.xxhash64("h", "p")
    word = F.element_at(bloom_filter(rules, blocks).scalar(), _block(hashed, blocks) + 1)
    passes = F.coalesce(word.bitwiseAND(_mask(hashed)) == _mask(hashed), F.lit(False))
    probe = probe.where(passes).select("page_id", "host", "path", "h", "p")
    listed_rules = rules.select(F.col("rule_host").alias("h"), F.col("rule_path").alias("p"), F.concat("rule_host", "rule_path").alias("rule"), "verdict")
    hits = probe.join(listed_rules, ["h", "p"]).select("page_id", "host", "path", F.struct(F.length("rule").alias("size"), "rule", "verdict").alias("hit"), F.lit(0).cast("bigint").alias("copies"))
    none = one.select("page_id", "host", "path", F.lit(None).cast("struct<size:int,rule:string,verdict:string>").alias("hit"), "copies")
    best = none.unionByName(hits).groupBy("page_id", "host", "path").agg(F.max("hit").alias("hit"), F.sum("copies").alias("copies"))
    # each url comes back as often as it was there
    return best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))


ORACLE_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), a AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS authority FROM u
), p AS (
  SELECT page_id, translate(authority, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(authority) + 1), '^[^?#]*') AS path FROM a
), j AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM j
"""
