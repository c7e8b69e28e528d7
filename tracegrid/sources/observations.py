"""Views of stored tables as one long relation: obs(site, platform, feature, value, page_kind, captured_at).

A site has one platform: that of its most confident index row, ties to the first name. Sites without an index row are
'unknown'. Names are in lower case; rows without a site or a feature say nothing and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrid.operators.tree_aggregate import platform_key
from tracegrid.session import table

HOST = r"^[^\p{L}\p{N}]*(?:[A-Za-z]+\s*:\s*/\s*/)?[^\p{L}\p{N}]*(?:[wW][wW][wW]\.)?([\p{L}\p{N}.-]+)"


def host(url: Column) -> Column:
    """The host of an address in any spelling, without ``www.``."""
    return F.lower(F.regexp_extract(url, HOST, 1))


def site_platform(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "capture_index").where("url is not null")
    rows = t.select(host(F.col("url")).alias("site"), platform_key(F.col("cms")).alias("platform"), F.coalesce("confidence", F.lit(-1.0)).alias("confidence")).where("site <> ''")
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "platform"))
    return rows.groupBy("site").agg(best.alias("b")).select("site", F.col("b.platform").alias("platform"))


def _with_platform(rows: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    return rows.join(site_platform(spark, sf), "site", "left").withColumn("platform", F.coalesce("platform", F.lit("unknown")))


def headers(spark: SparkSession, sf: str) -> DataFrame:
    """Header observations."""
    t = table(spark, sf, "header_values").where("site_host is not null and header_name is not null and header_name <> ''")
    rows = t.select(F.col("site_host").alias("site"), F.lower("header_name").alias("feature"), F.col("header_value").alias("value"), "page_kind", "captured_at")
    return _with_platform(rows, spark, sf)


def metas(spark: SparkSession, sf: str) -> DataFrame:
    """Meta tag observations; features carry the prefixes name:, property: and http-equiv:."""
    t = table(spark, sf, "meta_values").where("site_host is not null and tag_key is not null and tag_key <> ''")
    rows = t.select(F.col("site_host").alias("site"), F.lower("tag_key").alias("feature"), F.col("tag_value").alias("value"), F.lit("mainpage").alias("page_kind"), "captured_at")
    return _with_platform(rows, spark, sf)


def words(spark: SparkSession, sf: str) -> DataFrame:
    """Words of documents by language: site is the document, platform its language."""
    t = table(spark, sf, "documents").where("text is not null")
    rows = t.select(
        F.col("doc_id").alias("site"),
        F.coalesce(F.lower("lang"), F.lit("unknown")).alias("platform"),
        F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != ""))).alias("feature"),
        F.col("source").alias("value"),
    )
    return rows.withColumns({"page_kind": F.lit(None).cast("string"), "captured_at": F.lit(None).cast("timestamp_ntz")})


def orders(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers of orders by priority: sparse pairs, about four features a site."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("site"), F.col("o_orderpriority").alias("platform"))
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("site"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("feature"), F.col("l_linestatus").alias("value"))
    return li.join(o, "site").withColumns({"page_kind": F.lit(None).cast("string"), "captured_at": F.lit(None).cast("timestamp_ntz")})


_KEY = r"CASE WHEN coalesce(trim(cms, chr(32) || chr(9) || chr(10) || chr(13) || chr(160)), '') = '' THEN 'unknown' ELSE lower(trim(cms, chr(32) || chr(9) || chr(10) || chr(13) || chr(160))) END"
_SP = rf"""sp AS (
  SELECT site, platform FROM (
    SELECT site, platform, row_number() OVER (PARTITION BY site ORDER BY c DESC, platform) AS r FROM (
      SELECT lower(regexp_extract(url, '{HOST}', 1)) AS site, {_KEY} AS platform, coalesce(confidence, -1) AS c FROM capture_index WHERE url IS NOT NULL) WHERE site <> '') WHERE r = 1
)"""
HEADERS_SQL = f"""{_SP}, obs AS (
  SELECT site_host AS site, coalesce(platform, 'unknown') AS platform, lower(header_name) AS feature, header_value AS value, page_kind, captured_at
  FROM header_values LEFT JOIN sp ON site = site_host WHERE site_host IS NOT NULL AND header_name IS NOT NULL AND header_name <> ''
)"""
METAS_SQL = f"""{_SP}, obs AS (
  SELECT site_host AS site, coalesce(platform, 'unknown') AS platform, lower(tag_key) AS feature, tag_value AS value, 'mainpage' AS page_kind, captured_at
  FROM meta_values LEFT JOIN sp ON site = site_host WHERE site_host IS NOT NULL AND tag_key IS NOT NULL AND tag_key <> ''
)"""
WORDS_SQL = r"""obs AS (
  SELECT DISTINCT doc_id AS site, coalesce(lower(lang), 'unknown') AS platform, feature, source AS value
  FROM (SELECT doc_id, lang, source, unnest(string_split_regex(lower(text), '[^\p{L}]+')) AS feature FROM documents WHERE text IS NOT NULL) WHERE feature <> ''
)"""
ORDERS_SQL = """obs AS (
  SELECT o_orderkey AS site, o_orderpriority AS platform, 's' || l_suppkey AS feature, l_linestatus AS value FROM lineitem JOIN orders ON o_orderkey = l_orderkey
)"""

# Header names that stand for suppliers, so that catalogue lookups meet data: one name per supplier key, by remainder.
MAPPED = """x-pingback cf-ray x-served-by x-shopify-shop-id x-drupal-cache d-geo d-cache x-wp-total x-amz-cf-id x-powered-by server via x-cache-status x-aspnet-version x-laravel-session x-generator
etag content-type strict-transport-security x-frame-options x-sorting-hat-shopid x-custom-trace wp-engine-id shopify-edge-ip next-data-version x-cache-hits x-robots-tag x-varnish x-request-id
x-drupal-dynamic-cache acme-edge-id acme-edge-status acme-edge-cache x-acme-token x-acme-time session_id user_id x-app-version api-version recaptcha-token""".split()
MAPPED_PLATFORMS = "WordPress Drupal Shopify Joomla unknown".split()


def mapped_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as headers of the catalogue: site is the order, platform and feature follow from keys by remainder."""
    li = table(spark, sf, "lineitem")
    pick = lambda names, key: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col(key) % len(names) + 1).cast("int"))
    return li.select(
        F.col("l_orderkey").alias("site"),
        pick(MAPPED_PLATFORMS, "l_orderkey").alias("platform"),
        pick(MAPPED, "l_suppkey").alias("feature"),
        F.col("l_linestatus").alias("value"),
        F.lit("mainpage").alias("page_kind"),
        F.col("l_shipdate").alias("captured_at"),
    )


MAPPED_SQL = f"""obs AS (
  SELECT l_orderkey AS site, {MAPPED_PLATFORMS!r}[(l_orderkey % {len(MAPPED_PLATFORMS)} + 1)::INT] AS platform, {MAPPED!r}[(l_suppkey % {len(MAPPED)} + 1)::INT] AS feature,
    l_linestatus AS value, 'mainpage' AS page_kind, l_shipdate AS captured_at FROM lineitem
)"""
