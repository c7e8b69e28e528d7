"""How many distinct sites carry a feature, a value or a named pattern. All counts are of sites, not of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.functions.stats import ratio
from tracegrid.operators import discrimination as D

#: Names counted as security headers, and tag names that say nothing.
SECURITY = ("strict-transport-security", "content-security-policy", "x-frame-options", "x-content-type-options", "x-xss-protection", "referrer-policy", "permissions-policy", "feature-policy")
SKIPPED_TAGS = ("viewport", "charset", "content-type", "x-ua-compatible", "robots", "googlebot", "format-detection")


def total_sites(obs: DataFrame) -> DataFrame:
    return obs.agg(F.count_distinct("site").alias("n"))


def feature_frequency(obs: DataFrame, min_sites: int = 1) -> DataFrame:
    """feature, site_count, frequency: sites that carry a feature, and their share of all sites."""
    n = D.sites(obs)
    counts = D.features(obs).withColumnRenamed("n", "site_count").where(F.col("site_count") >= min_sites)
    return counts.select("feature", "site_count", F.round(ratio(F.col("site_count"), n), 6).alias("frequency"))


def header_frequency(obs: DataFrame, min_sites: int = 1) -> DataFrame:
    """feature_frequency with the flags security and custom."""
    security = F.col("feature").isin(*SECURITY)
    return feature_frequency(obs, min_sites).withColumns({"is_security": security, "is_custom": F.col("feature").startswith("x-") & ~security})


def value_frequency(obs: DataFrame, min_sites: int = 1) -> DataFrame:
    """feature, value, site_count, example: example is cut to 97 characters and three dots beyond 100."""
    rows = obs.where("value is not null").groupBy("feature", "value").agg(F.count_distinct("site").alias("site_count")).where(F.col("site_count") >= min_sites)
    cut = F.when(F.length("value") > 100, F.concat(F.substring("value", 1, 97), F.lit("..."))).otherwise(F.col("value"))
    return rows.withColumn("example", cut)


def top_values(obs: DataFrame, k: int = 1) -> DataFrame:
    """feature, top_value, top_sites, share: the most frequent values; ties go to the smaller value."""
    w = Window.partitionBy("feature").orderBy(F.desc("site_count"), "value")
    per = obs.groupBy("feature").agg(F.count_distinct("site").alias("n"))
    best = value_frequency(obs).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return best.join(per, "feature").select("feature", F.col("value").alias("top_value"), F.col("site_count").alias("top_sites"), F.round(ratio(F.col("site_count"), F.col("n")), 6).alias("share"))


def page_distribution(obs: DataFrame) -> DataFrame:
    """feature, main_share, robots_share of the sites that carry it; all main where neither page is known."""
    per = obs.groupBy("feature").agg(
        F.count_distinct(F.when(F.col("page_kind") == "mainpage", F.col("site"))).alias("m"), F.count_distinct(F.when(F.col("page_kind") == "robots", F.col("site"))).alias("r")
    )
    total = F.col("m") + F.col("r")
    return per.select("feature", F.round(ratio(F.col("m"), total, 1.0), 6).alias("main_share"), F.round(ratio(F.col("r"), total), 6).alias("robots_share"))


def meta_frequency(obs: DataFrame, min_sites: int = 1) -> DataFrame:
    """Tags without the names that say nothing, with their kind and the flags of the social vocabularies."""
    name = F.regexp_replace("feature", r"^(?:name|property|http-equiv):", "")
    kept = obs.where(~name.isin(*SKIPPED_TAGS))
    kind = F.when(F.col("feature").startswith("property:"), "property").when(F.col("feature").startswith("http-equiv:"), "http-equiv").otherwise("name")
    rows = feature_frequency(kept, min_sites).drop("frequency")
    n = total_sites(obs).scalar()
    return rows.withColumns(
        {
            "frequency": F.round(ratio(F.col("site_count"), n), 6),
            "kind": kind,
            "is_og": F.col("feature").contains("og:"),
            "is_twitter": F.col("feature").contains("twitter:"),
        }
    )


def occurrence_patterns(obs: DataFrame) -> DataFrame:
    """feature, value, occurrences, frequency, confidence: rows and not sites over all sites, weighted by platforms.

    Confidence is 1 - frequency, halved beyond five platforms, a fifth more for a single one, within .1 and 1.
    """
    n = total_sites(obs).scalar()
    rows = obs.where("value is not null").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("platform").alias("platforms"))
    f = ratio(F.col("occurrences"), n)
    weight = F.when(F.col("platforms") > 5, 0.5).when(F.col("platforms") == 1, 1.2).otherwise(1.0)
    return rows.select("feature", "value", "occurrences", "platforms", F.round(f, 6).alias("frequency"), F.round(F.greatest(F.lit(0.1), F.least(F.lit(1.0), (1 - f) * weight)), 6).alias("confidence"))


def top_features(parts: dict[str, DataFrame], k: int = 10) -> DataFrame:
    """dim, rank, feature, site_count: the k most frequent features of each dimension."""
    out = None
    for dim, obs in parts.items():
        best = obs.groupBy("feature").agg(F.count_distinct("site").alias("site_count")).orderBy(F.desc("site_count"), "feature").limit(k).withColumn("dim", F.lit(dim))
        out = best if out is None else out.unionByName(best)
    w = Window.partitionBy("dim").orderBy(F.desc("site_count"), "feature")
    return out.select("dim", F.row_number().over(w).alias("rank"), "feature", "site_count")
