"""Scripts by the catalogue of platform parts, by kind and by platform."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.functions import catalogue as K
from tracegrid.functions.stats import ratio


def parts_of(source: Column) -> Column:
    """Every catalogue part that a script address holds, as structs of pattern (category:platform:part), category, platform, base."""
    low = F.lower(source)
    tests = []
    for part, category, platform in K.SCRIPT_PARTS:
        base = 0.95 if any(x in part for x in K.SURE_SCRIPT_PARTS) else K.SCRIPT_CATEGORY_CONFIDENCE.get(category, 0.6)
        name = f"{category}:{platform.lower().replace(' ', '-')}:{part}"
        tests.append(F.when(low.contains(part.lower()), F.struct(F.lit(name).alias("pattern"), F.lit(category).alias("category"), F.lit(platform).alias("platform"), F.lit(base).alias("base"))))
    return F.array_compact(F.array(*tests))


def catalogue_matches(scripts: DataFrame) -> DataFrame:
    """site, pattern, category, platform, base: every match of every script (site, source)."""
    return scripts.where("source is not null").select("site", F.explode(parts_of(F.col("source"))).alias("m")).select("site", "m.*")


def platform_confidence(matches: DataFrame, total: Column) -> DataFrame:
    """platform, category, patterns, confidence: the best of base * (.7 + .3 * min(3 f, 1)) over its patterns."""
    per = matches.groupBy("pattern", "category", "platform", "base").agg(F.count_distinct("site").alias("n"))
    c = F.col("base") * (0.7 + 0.3 * F.least(3 * F.col("n") / total, F.lit(1.0)))
    return per.groupBy("platform", "category").agg(F.count(F.lit(1)).alias("patterns"), F.round(F.max(c), 6).alias("confidence"))


def kinds(patterns: DataFrame) -> DataFrame:
    """kind, patterns, occurrences, examples, on_cdn, relative, versioned of (kind, occurrences, examples) rows."""
    e = patterns.select("kind", "occurrences", F.coalesce("examples", F.array().cast("array<string>")).alias("e"))
    e = e.withColumn("e", F.filter("e", lambda x: x.isNotNull() & (x != "")))
    count = lambda rx: F.sum(F.size(F.filter("e", lambda x: F.lower(x).rlike(rx))))
    return e.groupBy("kind").agg(F.count(F.lit(1)).alias("patterns"), F.sum("occurrences").alias("occurrences"), F.sum(F.size("e")).alias("examples"), count(r"^(?:https?:)?//cdn\.").alias("on_cdn"), count(r"^/[^/]").alias("relative"), count(r"[?&]v(?:er)?=").alias("versioned"))


def by_platform(rows: DataFrame, least_sites: int = 3) -> DataFrame:
    """kind, platform, sites, share: distinct sites of a kind on each platform with enough sites (site, platform, kind rows)."""
    sizes = rows.select("site", "platform").distinct().groupBy("platform").agg(F.count(F.lit(1)).alias("np")).where(F.col("np") >= least_sites)
    per = rows.select("site", "platform", "kind").distinct().groupBy("kind", "platform").agg(F.count(F.lit(1)).alias("sites"))
    return per.join(sizes, "platform").select("kind", "platform", "sites", F.round(F.col("sites") / F.col("np"), 6).alias("share"))


def kind_power(shares: DataFrame) -> DataFrame:
    """kind, platforms, power: twice the population deviation of the positive shares, at most 1; 0 for a single platform."""
    p = shares.where("share > 0").groupBy("kind").agg(F.count(F.lit(1)).alias("platforms"), F.stddev_pop("share").alias("sd"))
    return p.select("kind", "platforms", F.round(F.when(F.col("platforms") <= 1, 0.0).otherwise(F.least(F.lit(1.0), 2 * F.col("sd"))), 6).alias("power"))


def two_platforms(shares: DataFrame, first: str, second: str) -> DataFrame:
    """kind, first, second, difference: shares of two platforms side by side, 0 where one has none."""
    per = shares.where(F.col("platform").isin(first, second)).groupBy("kind").agg(F.coalesce(F.max(F.when(F.col("platform") == first, F.col("share"))), F.lit(0.0)).alias("first"), F.coalesce(F.max(F.when(F.col("platform") == second, F.col("share"))), F.lit(0.0)).alias("second"))
    return per.withColumn("difference", F.round(F.col("first") - F.col("second"), 6))


def recommendations(shares: DataFrame, power: DataFrame) -> DataFrame:
    """kind, platform, share, advice: learn what tells platforms apart, skip what all have alike, else watch."""
    best = shares.groupBy("kind").agg(F.max("share").alias("share"), F.min(F.struct((-F.col("share")).alias("s"), "platform"))["platform"].alias("platform"))
    rows = best.join(power, "kind")
    return rows.select("kind", "platform", "share", F.when(F.col("power") >= 0.5, "learn").when((F.col("power") < 0.1) & (F.col("share") > 0.5), "skip").otherwise("watch").alias("advice"))


def cdn_share(k: DataFrame) -> DataFrame:
    return k.select("kind", F.round(ratio(F.col("on_cdn"), F.col("examples")), 6).alias("cdn_share"))
