"""Queries of the general data-pipeline operators: skewed keys, nested records, drifting schemas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrid.operators import merkle, schema_drift
from tracegrid.operators.tree_aggregate import platform_key, shares, tree_aggregate
from tracegrid.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p3_index(spark: SparkSession, sf: str) -> DataFrame:
    """Per platform: rows, the range of load times and the confidences of the capture index."""
    t = table(spark, sf, "capture_index")
    out = tree_aggregate(
        t,
        {"cms_key": platform_key(F.col("cms"))},
        {
            "n_rows": ("count", F.lit(1)),
            "n_confidence": ("count", F.col("confidence")),
            "sum_confidence": ("sum", F.col("confidence").cast("decimal(20,6)")),
            "max_confidence": ("max", F.col("confidence")),
            "first_loaded": ("min", F.col("loaded_at")),
            "last_loaded": ("max", F.col("loaded_at")),
        },
    )
    mean = F.round(F.col("sum_confidence").cast("double") / F.nullif(F.col("n_confidence"), F.lit(0)), 6)
    return out.select("cms_key", "n_rows", mean.alias("mean_confidence"), "max_confidence", "first_loaded", "last_loaded")


def p3_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """Per platform: snapshots and the sum of site counts of the platform distribution."""
    t = table(spark, sf, "cms_distribution")
    out = tree_aggregate(
        t,
        {"cms_key": platform_key(F.col("cms"))},
        {
            "n_rows": ("count", F.lit(1)),
            "sites": ("sum", F.col("site_count")),
            "largest": ("max", F.col("site_count")),
            "first_day": ("min", F.col("snapshot_day")),
            "last_day": ("max", F.col("snapshot_day")),
        },
    )
    return out.withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")})


def p3_platforms(spark: SparkSession, sf: str) -> DataFrame:
    """table_name, cms_key, load: rows of the index and site counts of the distribution per platform."""
    index, dist = table(spark, sf, "capture_index"), table(spark, sf, "cms_distribution")
    both = index.select(F.lit("capture_index").alias("table_name"), "cms", F.lit(1).cast("long").alias("load")).unionByName(
        dist.select(F.lit("cms_distribution").alias("table_name"), "cms", F.col("site_count").alias("load"))
    )
    keys = {"table_name": F.col("table_name"), "cms_key": platform_key(F.col("cms"))}
    return tree_aggregate(both, keys, {"load": ("sum", F.col("load"))})


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    out = shares(p3_platforms(spark, sf), "table_name", "load")
    return out.where("load * 20 >= total").select("table_name", "cms_key")


def _children(spark: SparkSession, sf: str, content: bool = False, roots: bool = False) -> DataFrame:
    captures, sites = table(spark, sf, "captures"), table(spark, sf, "site_analyses")
    page = F.struct(*[F.col(f"page_data.{c}").alias(c.split(".")[-1]) for c in ("http_info.headers", "metadata", "scripts", "forms")])
    a = merkle.bridges(captures, "captures", F.col("capture_id"), page, content, roots)
    return a.unionByName(merkle.bridges(sites, "site_analyses", F.col("record_id"), merkle.robots_document(F.col("robots_analysis")), content, roots))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _children(spark, sf).select("owner_table", "owner_id", "child_path", "parent_key", "item_no")


def p4_bridges(spark: SparkSession, sf: str) -> DataFrame:
    """Every occurrence of a child with the identities of itself and its parent, and the records themselves as roots."""
    return _children(spark, sf, roots=True)


def p4_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Every distinct object once, with its content and the number of its occurrences; roots are objects, too."""
    return merkle.nodes(_children(spark, sf, content=True, roots=True))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return schema_drift.changes(table(spark, sf, "capture_batches"))


def p5_scripts(spark: SparkSession, sf: str) -> DataFrame:
    """The edit scripts with moves told from renames."""
    rows = schema_drift.scripts(table(spark, sf, "capture_batches")).select("feed_id", "batch_no", F.explode("changes").alias("c"))
    return rows.select("feed_id", "batch_no", "c.*")


def p5_unified(spark: SparkSession, sf: str) -> DataFrame:
    """Every readable record in the first names and types of its fields."""
    return schema_drift.unified(table(spark, sf, "capture_batches"))


_KEY = r"CASE WHEN coalesce(trim(cms, chr(32) || chr(9) || chr(10) || chr(13) || chr(160)), '') = '' THEN 'unknown' ELSE lower(trim(cms, chr(32) || chr(9) || chr(10) || chr(13) || chr(160))) END"
_PLATFORMS = f"""
WITH p AS (
  SELECT 'capture_index' AS table_name, {_KEY} AS cms_key, count(*)::BIGINT AS load FROM capture_index GROUP BY ALL
  UNION ALL SELECT 'cms_distribution', {_KEY}, sum(site_count)::BIGINT FROM cms_distribution GROUP BY ALL
)
"""

_CHILDREN = """
WITH c AS (SELECT DISTINCT capture_id AS id, page_data AS p FROM captures),
sc AS (SELECT id, unnest(range(len(p.scripts))) AS i, unnest(p.scripts) AS s FROM c),
fo AS (SELECT id, unnest(range(len(p.forms))) AS i, unnest(p.forms) AS s FROM c),
he AS (SELECT id, unnest(map_entries(p.http_info.headers)) AS e FROM c),
me AS (SELECT id, unnest(map_entries(p.metadata)) AS e FROM c),
j0 AS (SELECT DISTINCT record_id AS id, try_cast(robots_analysis AS JSON) AS j FROM site_analyses),
j AS (SELECT id, CASE WHEN json_type(j) = 'VARCHAR' THEN try_cast(j->>'$' AS JSON) ELSE j END AS j FROM j0),
lists AS (
  SELECT id, 'signals' AS path, '' AS k, json_extract(j, '$.signals') AS v FROM j
  UNION ALL SELECT id, 'groups', '', json_extract(j, '$.robots.groups') FROM j
  UNION ALL SELECT id, 'headers', k, json_extract(j, concat('$."', k, '"')) FROM (SELECT id, json_extract(j, '$.headers') AS j, unnest(json_keys(json_extract(j, '$.headers'))) AS k FROM j WHERE json_type(json_extract(j, '$.headers')) = 'OBJECT')
), members AS (
  SELECT id, path, k, CASE WHEN json_type(v) = 'ARRAY' THEN json_extract(v, '$[*]') WHEN json_type(v) IS NULL OR json_type(v) = 'NULL' THEN [] ELSE [v] END AS v FROM lists
), items AS (SELECT id, path, k, unnest(range(len(v))) AS i, unnest(v) AS v FROM members),
g AS (
  SELECT id, 'groups.agents' AS path, i, json_extract(v, '$.userAgents') AS v FROM items WHERE path = 'groups'
  UNION ALL SELECT id, 'groups.disallows', i, json_extract(v, '$.disallows') FROM items WHERE path = 'groups'
), gm AS (
  SELECT id, path, i, CASE WHEN json_type(v) = 'ARRAY' THEN json_extract(v, '$[*]') WHEN json_type(v) IS NULL OR json_type(v) = 'NULL' THEN [] ELSE [v] END AS v FROM g
), gi AS (SELECT id, path, i::VARCHAR AS k, unnest(range(len(v))) AS i, unnest(v) AS v FROM gm),
flat AS (
  SELECT 'captures' AS owner_table, id AS owner_id, 'headers' AS child_path, e.key AS parent_key, i AS item_no FROM (SELECT id, e, unnest(range(len(e.value))) AS i, unnest(e.value) AS v FROM he) WHERE v IS NOT NULL
  UNION ALL SELECT 'captures', id, 'metadata', e.key, 0 FROM me WHERE e.value IS NOT NULL
  UNION ALL SELECT 'captures', id, 'scripts', '', i FROM sc WHERE s IS NOT NULL
  UNION ALL SELECT 'captures', id, 'forms', '', i FROM fo WHERE s IS NOT NULL
  UNION ALL SELECT 'captures', id, 'scripts.attributes', i::VARCHAR, n FROM (SELECT id, i, unnest(range(len(s.attributes))) AS n, unnest(s.attributes) AS v FROM sc) WHERE v IS NOT NULL
  UNION ALL SELECT 'captures', id, 'forms.field_types', i::VARCHAR, n FROM (SELECT id, i, unnest(range(len(s.field_types))) AS n, unnest(s.field_types) AS v FROM fo) WHERE v IS NOT NULL
  UNION ALL SELECT 'site_analyses', id, path, k, i FROM items WHERE json_type(v) <> 'NULL'
  UNION ALL SELECT 'site_analyses', id, path, k, i FROM gi WHERE json_type(v) <> 'NULL'
)
SELECT owner_table, owner_id, child_path, parent_key, item_no::INTEGER AS item_no FROM flat"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p3_index, p3_distribution, p3_platforms, p3_found, p4_found, p4_bridges, p4_nodes, p5_found, p5_scripts, p5_unified)}


def oracle_sql() -> dict[str, str]:
    return {
        "p3_index": f"""
SELECT {_KEY} AS cms_key, count(*) AS n_rows, round(sum(confidence::DECIMAL(20,6))::DOUBLE / nullif(count(confidence), 0), 6) AS mean_confidence,
  max(confidence) AS max_confidence, min(loaded_at) AS first_loaded, max(loaded_at) AS last_loaded
FROM capture_index GROUP BY ALL""",
        "p3_distribution": f"""
SELECT {_KEY} AS cms_key, count(*) AS n_rows, sum(site_count)::BIGINT AS sites, max(site_count) AS largest,
  min(snapshot_day)::VARCHAR AS first_day, max(snapshot_day)::VARCHAR AS last_day
FROM cms_distribution GROUP BY ALL""",
        "p4_found": _CHILDREN,
        "p3_platforms": _PLATFORMS + "SELECT * FROM p",
        "p3_found": _PLATFORMS + "SELECT table_name, cms_key FROM (SELECT *, sum(load) OVER (PARTITION BY table_name) AS total FROM p) WHERE load * 20 >= total",
    }
