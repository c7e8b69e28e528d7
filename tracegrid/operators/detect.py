"""Which platform a stored capture runs, scored offline; patterns mined per platform; rules and their evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.functions import catalogue as K
from tracegrid.functions.stats import ratio

ORDER = ("WordPress", "Joomla", "Drupal", "Duda")
THRESHOLD = 0.3


def html_confidence(html: Column, platform: str) -> Column:
    """k of n signatures: at least .5 for any, .8 k / n beyond; Joomla with three of them .2 more up to .8."""
    sigs = K.HTML_SIGNATURES[platform]
    k = reduce(lambda a, b: a + b, [html.contains(s).cast("int") for s in sigs])
    base = F.when(k > 0, F.greatest(F.lit(0.5), 0.8 * k / len(sigs))).otherwise(0.0)
    if platform == "Joomla":
        base = F.when(k >= 3, F.least(F.lit(0.8), base + 0.2)).otherwise(base)
    return F.coalesce(base, F.lit(0.0))


def header_confidence(headers: Column, platform: str) -> Column:
    """Sum of the rules that a header map (name to list of values) meets, at most 1."""
    entries = F.map_entries(headers)
    value = lambda e: F.lower(F.array_join(F.coalesce(e["value"], F.array().cast("array<string>")), " "))
    any_ = lambda f: F.coalesce(F.exists(entries, f), F.lit(False))
    both = lambda p: any_(lambda e: F.lower(e["key"]).contains(p) | value(e).contains(p))
    named = lambda n, p: any_(lambda e: (F.lower(e["key"]) == n) & value(e).rlike(p))
    rules = {
        "WordPress": [(named("link", "wp-json"), 0.9), (both("wordpress"), 0.8), (named("x-generator", r"wordpress\s*\d"), 0.95), (both("wp-"), 0.7)],
        "Joomla": [(named("x-content-encoded-by", "joomla"), 0.95), (both("joomla"), 0.7), (named("x-generator", r"joomla\s*\d"), 0.9)],
        "Drupal": [(named("x-generator", r"drupal\s+\d"), 0.95), (named("x-drupal-cache", ".*"), 0.8), (named("x-drupal-route-normalizer", ".*"), 0.8), (named("x-powered-by", "drupal"), 0.7)],
        "Duda": [(both("duda"), 0.8), (named("x-powered-by", "duda"), 0.9)],
    }[platform]
    return F.least(F.lit(1.0), reduce(lambda a, b: a + b, [F.when(c, v).otherwise(0.0) for c, v in rules]))


def generator_confidence(generator: Column, platform: str) -> Column:
    return F.when(F.lower(generator).contains(platform.lower()), 0.95).otherwise(0.0)


def generator_version(generator: Column) -> Column:
    return F.nullif(F.regexp_extract(generator, r"(\d+(?:\.\d+)+)", 1), F.lit(""))


def weighted(scores: dict[str, Column], platform: str) -> Column:
    """Mean of the methods that found anything, by their weights."""
    w = K.METHOD_WEIGHTS[platform]
    top = reduce(lambda a, b: a + b, [F.when(c > 0, c * w[m]).otherwise(0.0) for m, c in scores.items()])
    low = reduce(lambda a, b: a + b, [F.when(c > 0, w[m]).otherwise(0.0) for m, c in scores.items()])
    return F.least(F.lit(1.0), ratio(top, low))


def detected(df: DataFrame, key: str, html: Column, headers: Column, generator: Column) -> DataFrame:
    """key, platform, confidence: the best platform, ties in the order of ORDER; Unknown below the threshold."""
    per = {p: weighted({"meta-tag": generator_confidence(F.col("_g"), p), "html-content": html_confidence(F.col("_h"), p), "http-headers": header_confidence(F.col("_m"), p)}, p) for p in ORDER}
    rows = df.select(key, html.alias("_h"), headers.alias("_m"), F.coalesce(generator, F.lit("")).alias("_g")).select(key, *[c.alias(p) for p, c in per.items()])
    best = F.greatest(*ORDER)
    name = reduce(lambda acc, p: acc.when(F.col(p) == best, p), ORDER[1:], F.when(F.col(ORDER[0]) == best, ORDER[0]))
    return rows.select(key, F.when(best >= THRESHOLD, name).otherwise("Unknown").alias("platform"), F.round(best, 6).alias("confidence"))


def robots_scores(df: DataFrame, key: str, content: Column) -> DataFrame:
    """key, platform, confidence from the allow and disallow lines of a robots.txt.

    Mean of the met paths' confidences, plus .1 a path up to .3 and .15 an own path up to .3, less .2 a shared one up to .4,
    plus .2 for the older layout of one platform. Ties go to the first platform of the catalogue; Unknown at .3 and below.
    """
    lines = F.transform(F.split(F.lower(content), "\n"), lambda x: F.trim(F.regexp_replace(x, "\r", "")))
    paths = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, r"^(?:dis)?allow:\s*(.*)$", 1)), lambda p: p != "")
    rows = df.select(key, paths.alias("p"), F.lower(F.coalesce(content, F.lit(""))).alias("t"))

    def met(pattern: str) -> Column:
        bare = pattern.rstrip("/")
        one = lambda p: (F.regexp_replace(p, "/+$", "") == bare) | (p == pattern) | p.startswith(pattern + "*")
        if not pattern.startswith("/"):
            return F.coalesce(F.exists("p", lambda p: one(p) | p.contains(pattern)), F.lit(False))
        return F.coalesce(F.exists("p", one), F.lit(False))

    t = F.col("t")
    legacy = t.contains("/misc/") & t.contains("/profiles/") & t.contains("/modules/") & t.contains("/themes/") & ~t.contains("/core/")
    scores = {}
    for platform, rules in K.ROBOTS_PATHS.items():
        hits = [(met(p), c, p in K.SHARED_PATHS) for p, c in rules]
        total, n = reduce(lambda a, b: a + b, [F.when(h, c).otherwise(0.0) for h, c, _ in hits]), reduce(lambda a, b: a + b, [h.cast("int") for h, _, _ in hits])
        shared = reduce(lambda a, b: a + b, [h.cast("int") for h, _, s in hits if s] or [F.lit(0)])
        score = F.try_divide(total, n) + F.least(n * 0.1, F.lit(0.3)) + F.least((n - shared) * 0.15, F.lit(0.3)) - F.least(shared * 0.2, F.lit(0.4)) + F.when(legacy, 0.2).otherwise(0.0)
        scores[platform] = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).otherwise(0.0)
    rows = rows.select(key, *[c.alias(p) for p, c in scores.items()])
    names = list(scores)
    best = F.round(F.greatest(*names), 9)
    name = reduce(lambda acc, p: acc.when(F.round(F.col(p), 9) == best, p), names[1:], F.when(F.round(F.col(names[0]), 9) == best, names[0]))
    return rows.select(key, F.when(best > 0.3, name).otherwise("Unknown").alias("platform"), F.round(F.when(best > 0.3, best).otherwise(0.0), 6).alias("confidence"))


def mined_patterns(obs: DataFrame, least_frequency: float = 0.3, least_share: float = 0.6) -> DataFrame:
    """platform, pattern, frequency (occurrences per site of the platform), share (of the pattern's sites), best first.

    Kept are patterns at or above both floors.
    """
    sizes = obs.select("site", "platform").distinct().groupBy("platform").agg(F.count(F.lit(1)).alias("np"))
    per = obs.groupBy("platform", "feature").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("site").alias("n"))
    per = per.withColumn("everywhere", F.sum("n").over(Window.partitionBy("feature"))).join(sizes, "platform")
    f, share = F.col("rows") / F.col("np"), F.col("n") / F.col("everywhere")
    return per.select("platform", F.col("feature").alias("pattern"), F.round(f, 6).alias("frequency"), F.round(share, 6).alias("share")).where((F.col("frequency") >= least_frequency) & (F.col("share") >= least_share))


def signatures(mined: DataFrame, k: int = 5) -> DataFrame:
    """platform, pattern, weight, required: the k strongest patterns of each platform; required above .9 of both."""
    w = Window.partitionBy("platform").orderBy(F.desc("v"), "pattern")
    v = F.round(F.col("share") * F.least(F.col("frequency"), F.lit(1.0)), 6)
    best = mined.withColumn("v", v).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return best.select("platform", "pattern", F.col("v").alias("weight"), ((F.col("frequency") > 0.9) & (F.col("share") > 0.9)).alias("required"))


def rule_evaluation(rules: DataFrame, obs: DataFrame) -> DataFrame:
    """platform, tp, fp, fn, tn, precision, recall, accuracy of the rule 'carries a signature pattern' for each platform.

    A true confusion matrix over all sites, counted from distinct (site, platform rule) hits.
    """
    total = obs.agg(F.count_distinct("site")).scalar()
    sizes = obs.select("site", "platform").distinct().groupBy("platform").agg(F.count(F.lit(1)).alias("np"))
    hits = obs.select("site", F.col("platform").alias("own"), "feature").distinct().join(rules.select(F.col("platform").alias("rule"), F.col("pattern").alias("feature")), "feature").select("site", "own", "rule").distinct()
    per = hits.groupBy("rule").agg(F.count_if(F.col("own") == F.col("rule")).alias("tp"), F.count_if(F.col("own") != F.col("rule")).alias("fp"))
    all_ = sizes.join(per, sizes["platform"] == per["rule"]).withColumns({"fn": F.col("np") - F.col("tp"), "total": total})
    all_ = all_.withColumn("tn", F.col("total") - F.col("tp") - F.col("fp") - F.col("fn"))
    return all_.select(
        "platform", "tp", "fp", "fn", "tn", F.round(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(ratio(F.col("tp"), F.col("np")), 6).alias("recall"), F.round((F.col("tp") + F.col("tn")) / F.col("total"), 6).alias("accuracy")
    )


def completeness(found: DataFrame, required: DataFrame, by: str) -> DataFrame:
    """by, found, missing, score: how much of the required patterns each group holds, in percent."""
    need = required.select("pattern").distinct()
    n = need.agg(F.count(F.lit(1))).scalar()
    hit = found.select(by, "pattern").distinct().join(need, "pattern", "left_semi").groupBy(by).agg(F.count(F.lit(1)).alias("found"))
    groups = found.select(by).distinct().join(hit, by, "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return groups.select(by, "found", (n - F.col("found")).alias("missing"), F.round(F.col("found") * 100 / n, 4).alias("score"))


def name_consistency(df: DataFrame, identity: list[str], name: str) -> DataFrame:
    """Share of identities with exactly one name."""
    per = df.groupBy(F.md5(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity])).alias("id")).agg(F.count_distinct(name).alias("k"))
    a = per.agg(F.count(F.lit(1)).alias("identities"), F.count_if(F.col("k") == 1).alias("single"))
    return a.withColumn("consistency", F.round(ratio(F.col("single"), F.col("identities")), 6))
