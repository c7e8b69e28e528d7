"""Technologies that headers, tags and scripts give away, what they say about stacks, and versions of platforms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.functions.stats import ratio

# Technology, category, confidence, trend.
TECHNOLOGIES = [
    ("React", "frontend", 0.9, "rising"), ("Vue.js", "frontend", 0.85, "rising"), ("Angular", "frontend", 0.85, "stable"), ("jQuery", "frontend", 0.9, "declining"), ("PHP", "backend", 0.8, "stable"),
    ("Node.js", "backend", 0.8, "rising"), ("Apache", "server", 0.9, "stable"), ("Nginx", "server", 0.9, "rising"), ("Cloudflare", "cdn", 0.95, "rising"), ("AWS CloudFront", "cdn", 0.9, "stable"),
    ("WordPress", "cms", 0.9, "stable"), ("Drupal", "cms", 0.9, "stable"), ("Shopify", "ecommerce", 0.95, "rising"), ("Magento", "ecommerce", 0.9, "stable"), ("Google Analytics", "analytics", 0.95, "stable"),
    ("Let's Encrypt", "security", 0.8, "rising"), ("webpack", "development", 0.85, "stable"),
]
MODERN, LEGACY = ("React", "Vue.js", "Angular", "Node.js", "webpack"), ("jQuery", "PHP")
COMPATIBLE = {
    "React": ["Node.js", "webpack", "Cloudflare"], "Vue.js": ["Node.js", "webpack", "Cloudflare"], "Angular": ["Node.js", "webpack", "Cloudflare"],
    "WordPress": ["PHP", "Apache", "MySQL"], "Drupal": ["PHP", "Apache", "MySQL"], "Shopify": ["Cloudflare", "AWS CloudFront"],
}


def technologies_of(dim: Column, name: Column, value: Column) -> Column:
    """Technologies that one observation gives away; dim is header, meta, script or platform."""
    n, v = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(value, F.lit("")))
    any_ = lambda *xs: reduce(lambda a, b: a | b, [v.contains(x) for x in xs])
    head, meta, script, platform = dim == "header", dim == "meta", dim == "script", dim == "platform"
    told = v != ""
    rules = [
        ("Apache", head & (n == "server") & any_("apache")), ("Nginx", head & (n == "server") & any_("nginx")), ("PHP", head & (n == "x-powered-by") & any_("php")), ("Cloudflare", head & told & (n == "cf-ray")), ("AWS CloudFront", head & told & n.contains("x-amz-cf")),
        ("WordPress", (meta & (n == "generator") & any_("wordpress")) | (script & any_("wp-content")) | (platform & (v == "wordpress"))),
        ("Drupal", (meta & (n == "generator") & any_("drupal")) | (script & any_("drupal.js")) | (platform & v.isin("drupal", "joomla"))),
        ("React", (meta & told & (n == "next-head-count")) | (script & any_("react", "_next/static"))), ("Angular", (meta & told & (n == "ng-version")) | (script & any_("angular"))), ("Vue.js", script & any_("vue", "_nuxt")), ("jQuery", script & any_("jquery")),
        ("Shopify", script & any_("shopify.com", "shopifycloud.com")), ("Google Analytics", script & any_("google-analytics.com", "googletagmanager.com")), ("webpack", script & any_("webpack", "chunks/")),
    ]
    return F.array_compact(F.array(*[F.when(c, t) for t, c in rules]))


def detections(rows: DataFrame, total: Column) -> DataFrame:
    """technology, category, sites, adoption, trend, security: from rows (site, dim, name, value).

    Security is .8, .2 less for what declines and .1 less for a platform of unknown version.
    """
    found = rows.select("site", F.explode(technologies_of(F.col("dim"), F.col("name"), F.col("value"))).alias("technology"))
    per = found.groupBy("technology").agg(F.count_distinct("site").alias("sites"))
    pick = lambda i: reduce(lambda acc, t: acc.when(F.col("technology") == t[0], t[i]), TECHNOLOGIES[1:], F.when(F.col("technology") == TECHNOLOGIES[0][0], TECHNOLOGIES[0][i]))
    rows = per.withColumns({"category": pick(1), "confidence": pick(2).cast("double"), "trend": pick(3), "adoption": F.round(F.col("sites") / total, 6)})
    security = 0.8 - F.when(F.col("trend") == "declining", 0.2).otherwise(0.0) - F.when(F.col("category") == "cms", 0.1).otherwise(0.0)
    return rows.withColumn("security", F.round(security, 2))


def stack(found: DataFrame) -> DataFrame:
    """One row: categories, complexity, modernity and the names with confidence over .8."""
    t = F.col("technology")
    a = found.agg(
        F.count_distinct("category").alias("categories"), F.count_if(t.isin(*MODERN)).alias("m"), F.count_if(t.isin(*LEGACY)).alias("l"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("confidence") > 0.8, t))), ", ").alias("primary_stack")
    )
    k = F.col("categories")
    return a.select("categories", F.when(k <= 2, "simple").when(k <= 4, "moderate").when(k <= 6, "complex").otherwise("enterprise").alias("complexity"), F.round(ratio(F.col("m"), F.col("m") + F.col("l"), 0.5), 6).alias("modernity"), "primary_stack")


def compatibility(found: DataFrame) -> DataFrame:
    """technology, fits: which of the technologies that go with it the corpus shows as well."""
    spark = found.sparkSession
    pairs = spark.createDataFrame([(a, b) for a, bs in COMPATIBLE.items() for b in bs], "technology string, other string")
    there = found.select("technology")
    hit = pairs.join(there, "technology").join(there.withColumnRenamed("technology", "other"), "other", "left_semi")
    return hit.groupBy("technology").agg(F.array_join(F.array_sort(F.collect_set("other")), ", ").alias("fits"))


def is_valid_version(platform: Column, version: Column) -> Column:
    """Whether a version can be one of its platform."""
    part = lambda i: F.coalesce(F.try_element_at(F.split(version, r"\."), F.lit(i)).try_cast("int"), F.lit(0))
    a, b, c = part(1), part(2), part(3)
    two, any_ = version.rlike(r"^\d+\.\d+(?:\.\d+)?$"), version.rlike(r"^\d+(?:\.\d+){0,2}$")
    ok = (
        F.when(platform == "WordPress", two & a.between(4, 10) & (b <= 20) & (c <= 20))
        .when(platform == "Drupal", any_ & a.between(6, 11) & (b <= 50) & (c <= 50))
        .when(platform == "Joomla", two & a.between(1, 5) & (b <= 10) & (c <= 50))
        .when(platform == "Duda", version.rlike(r"^\d{4}$") & a.between(4000, 9999))
    )
    return F.coalesce(ok, F.lit(False))


def versions_of(text: Column, source: str, confidence: str) -> Column:
    """Versions that a text names after a platform, as structs with their source and confidence."""
    low = F.lower(text)
    out = []
    for p, rx in (("WordPress", r"wordpress[^\d]*(\d+\.\d+(?:\.\d+)?)"), ("Drupal", r"drupal[^\d]*(\d+(?:\.\d+)*)"), ("Joomla", r"joomla[^\d]*(\d+\.\d+(?:\.\d+)?)"), ("Duda", r"duda[^\d]*(\d+(?:\.\d+)*)")):
        v = F.regexp_extract(low, rx, 1)
        out.append(F.when(v != "", F.struct(F.lit(p).alias("platform"), v.alias("version"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence"))))
    return F.array_compact(F.array(*out))


def best_versions(found: DataFrame, key: str) -> DataFrame:
    """key, platform, version, source: the valid version of the best source, then of the best confidence, then the first by text."""
    order = F.struct(
        F.when(F.col("source") == "meta-generator", -3).when(F.col("source") == "http-header", -2).when(F.col("source") == "script-path", -1).otherwise(0).alias("s"),
        F.when(F.col("confidence") == "high", -3).when(F.col("confidence") == "medium", -2).otherwise(-1).alias("c"),
        "version",
    )
    valid = found.where(is_valid_version(F.col("platform"), F.col("version")))
    return valid.groupBy(key, "platform").agg(F.min_by(F.struct("version", "source"), order).alias("b")).select(key, "platform", "b.version", "b.source")


# Feature, platform, confidence, where to look, what to look for.
FEATURES = [
    ("hasWpContent", "WordPress", 0.9, "html", "wp-content"), ("hasWpJsonLink", "WordPress", 0.8, "html", "wp-json"), ("generatorContainsWordPress", "WordPress", 0.95, "generator", "wordpress"), ("hasPingback", "WordPress", 0.9, "header", "x-pingback"),
    ("hasDrupalSites", "Drupal", 0.8, "html", "/sites/"), ("generatorContainsDrupal", "Drupal", 0.95, "generator", "drupal"), ("hasDrupalDynamicCacheHeader", "Drupal", 0.95, "header", "x-drupal-dynamic-cache"), ("hasDrupalSettingsJson", "Drupal", 0.98, "html", "drupal-settings-json"),
    ("hasDrupalMessagesFallback", "Drupal", 0.97, "html", "data-drupal-messages-fallback"), ("hasJoomlaTemplates", "Joomla", 0.9, "html", "/templates/"), ("hasJoomlaScriptOptions", "Joomla", 1.0, "html", "joomla-script-options"), ("generatorContainsJoomla", "Joomla", 0.8, "generator", "joomla"),
    ("hasJoomlaUi", "Joomla", 0.9, "html", "/media/jui/"), ("hasDudaCdn", "Duda", 0.9, "html", "cdn-website.com"), ("hasDudaAlbum", "Duda", 0.9, "html", "dmalbum"),
]


def features(df: DataFrame, key: str, html: Column, headers: Column, generator: Column) -> DataFrame:
    """key, feature, platform, confidence of the telling features that a capture shows."""
    text, names, gen = F.lower(F.coalesce(html, F.lit(""))), F.coalesce(F.transform(F.map_keys(headers), lambda k: F.lower(k)), F.array().cast("array<string>")), F.lower(F.coalesce(generator, F.lit("")))
    test = {"html": lambda x: text.contains(x), "header": lambda x: F.array_contains(names, x), "generator": lambda x: gen.contains(x)}
    hits = F.array_compact(F.array(*[F.when(test[w](x), F.struct(F.lit(f).alias("feature"), F.lit(p).alias("platform"), F.lit(c).alias("confidence"))) for f, p, c, w, x in FEATURES]))
    return df.select(key, F.explode(hits).alias("h")).select(key, "h.*")
