"""What header names say: class, platform, vendor; what vendors a corpus shows and how they are mixed.

Tables of names are small and fixed, so they are compiled into one conditional expression per lookup instead of a join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.functions import catalogue as K
from tracegrid.functions.stats import clamp, ratio


def _first(tests: list[tuple[Column, object]]) -> Column:
    return reduce(lambda acc, t: acc.when(t[0], t[1]), tests[1:], F.when(tests[0][0], tests[0][1]))


def name_pattern(name: Column) -> Column:
    """The platform that a header name names: the longest pattern first; short ones only as a prefix."""
    ordered = sorted(K.NAME_PATTERNS, key=lambda x: -len(x[0]))
    tests = []
    for p, platform in ordered:
        hit = name.contains(p) if len(p) >= 3 else name == p
        tests.append((name.startswith(p) | hit if p.endswith("-") else hit, F.lit(platform)))
    return _first(tests)


def classified(names: DataFrame) -> DataFrame:
    """feature with category, score, advice and platform, by the first table that knows the name."""
    n = F.col("feature")
    table = {h: (p, s) for h, p, _, s in K.PLATFORM_HEADERS}
    own = n.isin(*table)
    pattern = name_pattern(n)
    steps = [(own, "platform"), (n.isin(*K.GENERIC_HEADERS), "generic"), (n.isin(*K.INDICATIVE_HEADERS), "cms-indicative"), (n.isin(*K.INFRASTRUCTURE_HEADERS), "infrastructure"), (pattern.isNotNull(), "platform")]
    category = _first([(c, F.lit(v)) for c, v in steps]).otherwise("custom")
    score = _first([(n == h, F.lit(s)) for h, (_, s) in table.items()])
    score = F.coalesce(score, _first([(c, F.lit(v)) for (c, _), v in zip(steps, (None, 0.0, 0.6, 0.3, 0.8))][1:]).otherwise(0.5))
    advice = _first([(own, F.lit("never-filter")), (steps[1][0], F.lit("always-filter")), (steps[2][0] | steps[3][0], F.lit("context-dependent")), (pattern.isNotNull(), F.lit("never-filter"))]).otherwise("context-dependent")
    named = [(n == h, F.lit(p[0])) for h, (p, _) in table.items() if p]
    platform = F.when(own, _first(named)).when(category == "platform", pattern)
    return names.withColumns({"category": category, "score": score.cast("double"), "advice": advice, "named_platform": platform})


def vendor_of(name: Column) -> Column:
    """The vendor of a header: by its full name, else by a catalogue name longer than three within it, in catalogue order."""
    exact = _first([(name.isin(*h.split()), F.lit(v)) for v, _, h in K.VENDORS])
    inside = _first([(reduce(lambda a, b: a | b, [name.contains(x) for x in h.split() if len(x) > 3]), F.lit(v)) for v, _, h in K.VENDORS])
    return F.coalesce(exact, inside)


def category_of(vendor: Column) -> Column:
    return _first([(vendor == v, F.lit(c)) for v, c, _ in K.VENDORS])


def detections(obs: DataFrame) -> DataFrame:
    """feature, vendor, category, kind, site_count, frequency, confidence of every header that a vendor is known for."""
    n = obs.agg(F.count_distinct("site")).scalar().cast("double")
    per = obs.groupBy("feature").agg(F.count_distinct("site").alias("site_count"))
    # The condition names the count, so the lookup stays above the aggregate: once per header instead of once per row.
    per = per.withColumn("vendor", F.when(F.col("site_count") > 0, vendor_of(F.col("feature")))).where("vendor is not null")
    per = per.withColumns({"category": category_of(F.col("vendor")), "f": F.col("site_count") / n})
    kind = F.when(F.col("category").isin("cdn", "hosting"), "infrastructure").when(F.col("category").isin("cms", "ecommerce", "framework"), "discriminative").otherwise("mixed")
    f = F.col("f")
    c = 0.7 + F.when(kind == "discriminative", 0.25).when(kind == "infrastructure", -0.1).otherwise(0.0)
    c = c + F.when(f > 0.1, 0.2).otherwise(0.0) + F.when(f > 0.3, 0.1).otherwise(0.0) - F.when(f < 0.01, 0.3).otherwise(0.0)
    c = c + F.when(F.col("category").isin("cms", "ecommerce"), 0.1).when(F.col("category") == "framework", -0.1).otherwise(0.0)
    return per.select("feature", "vendor", "category", kind.alias("kind"), "site_count", F.round(f, 6).alias("frequency"), F.round(clamp(c, 0.0, 1.0), 4).alias("confidence"))


def vendor_rollup(found: DataFrame) -> DataFrame:
    """vendor, category, headers, confidence (largest), share of all vendor headers."""
    total = found.agg(F.count(F.lit(1))).scalar()
    per = found.groupBy("vendor", "category").agg(F.count(F.lit(1)).alias("headers"), F.max("confidence").alias("confidence"))
    return per.withColumn("share", F.round(F.col("headers") / total, 6))


def vendor_concentration(found: DataFrame) -> DataFrame:
    """headers, vendors, hhi over the vendors' shares, and the largest share against an equal one."""
    r = vendor_rollup(found)
    return r.agg(
        F.sum("headers").alias("headers"), F.count(F.lit(1)).alias("vendors"), F.round(F.sum(F.pow(F.col("headers") / found.agg(F.count(F.lit(1))).scalar(), F.lit(2))), 6).alias("hhi"), F.round(F.max("share") * F.count(F.lit(1)), 4).alias("over_equal")
    )


def technology_stack(found: DataFrame) -> DataFrame:
    """category, best (most confident vendor, ties by name), vendors in order of confidence."""
    per = found.groupBy("category", "vendor").agg(F.max("confidence").alias("c"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "vendor"))), lambda x: x["vendor"])
    return per.groupBy("category").agg(F.array_join(listed, ", ").alias("vendors"), F.count(F.lit(1)).alias("n")).withColumn("best", F.element_at(F.split("vendors", ", "), 1))


def vendor_conflicts(found: DataFrame) -> DataFrame:
    """conflict, n: several platform headers, more than two frameworks, excluding platforms, many ubiquitous vendors."""
    a = found.agg(
        F.count_if(F.col("category") == "cms").alias("cms"),
        F.count_if(F.col("category") == "framework").alias("frameworks"),
        F.count_if(F.col("frequency") > 0.9).alias("ubiquitous"),
        F.collect_set("vendor").alias("v"),
    )
    pairs = [("WordPress", "Shopify"), ("WordPress", "Drupal"), ("Drupal", "Shopify")]
    has = lambda p: (F.array_contains("v", p[0]) & F.array_contains("v", p[1])).cast("int")
    excluding = reduce(lambda x, y: x + y, [has(p) for p in pairs])
    rows = F.array(
        *[
            F.struct(F.lit(k).alias("conflict"), c.cast("long").alias("n"), on.alias("on"))
            for k, c, on in (
                ("several platforms", F.col("cms"), F.col("cms") > 1),
                ("several frameworks", F.col("frameworks"), F.col("frameworks") > 2),
                ("excluding platforms", excluding, excluding > 0),
                ("ubiquitous vendors", F.col("ubiquitous"), F.col("ubiquitous") > 3),
            )
        ]
    )
    return a.select(F.explode(F.filter(rows, lambda r: r["on"])).alias("r")).select("r.conflict", "r.n")


def category_distribution(obs: DataFrame) -> DataFrame:
    """category, headers, sites, mean_score, top5: distinct headers and sites per class."""
    c = classified(obs.select("site", "feature").distinct())
    w = Window.partitionBy("category").orderBy(F.desc("n"), "feature")
    per = c.groupBy("category", "feature", "score").agg(F.count(F.lit(1)).alias("n")).withColumn("r", F.row_number().over(w))
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 5, F.struct("r", "feature")))), lambda x: x["feature"]), ", ").alias("top5")
    heads = per.groupBy("category").agg(F.count(F.lit(1)).alias("headers"), F.round(F.avg("score"), 6).alias("mean_score"), top)
    sites = c.groupBy("category").agg(F.count_distinct("site").alias("sites"))
    return heads.join(sites, "category")


def semantic_quality(obs: DataFrame) -> DataFrame:
    """headers, categorised (not custom), mean_score, vendor_rate, custom_ratio over the distinct headers."""
    c = classified(obs.select("feature").distinct()).withColumn("v", vendor_of(F.col("feature")))
    a = c.agg(F.count(F.lit(1)).alias("headers"), F.count_if(F.col("category") != "custom").alias("k"), F.avg("score").alias("m"), F.count_if(F.col("v").isNotNull()).alias("v"))
    n = F.col("headers")
    return a.select("headers", F.round(ratio(F.col("k"), n), 6).alias("categorised"), F.round(F.coalesce("m", F.lit(0.0)), 6).alias("mean_score"), F.round(ratio(F.col("v"), n), 6).alias("vendor_rate"), F.round(ratio(n - F.col("k"), n), 6).alias("custom_ratio"))


def site_conflicts(obs: DataFrame) -> DataFrame:
    """site, platforms, conflicts, score, dominant: platforms that a site's headers point to and that exclude each other.

    A pair conflicts if the first header of either side lists the other; a conflict weighs 1, .6 or .3 by the largest
    specificity of the headers of both.
    """
    spark = obs.sparkSession
    rows = [(h, p, cs, s) for h, ps, cs, s in K.PLATFORM_HEADERS for p in ps]
    dim = spark.createDataFrame(rows, "feature string, target string, excludes array<string>, spec double")
    hit = obs.select("site", "feature").distinct().join(F.broadcast(dim), "feature")
    per = hit.groupBy("site", "target").agg(F.min(F.struct("feature", "excludes")).alias("first"), F.max("spec").alias("spec"), F.count(F.lit(1)).alias("n"))
    a, b = per.select("site", F.col("target").alias("t1"), F.col("first").alias("f1"), F.col("spec").alias("s1")), per.select("site", F.col("target").alias("t2"), F.col("first").alias("f2"), F.col("spec").alias("s2"))
    met = a.join(b, "site").where("t1 < t2").where(F.array_contains("f1.excludes", F.col("t2")) | F.array_contains("f2.excludes", F.col("t1")))
    most = F.greatest("s1", "s2")
    weight = F.when(most > 0.9, 1.0).when(most > 0.7, 0.6).otherwise(0.3)
    found = met.groupBy("site").agg(F.count(F.lit(1)).alias("conflicts"), F.sum(weight).alias("w"))
    sites = per.groupBy("site").agg(F.count(F.lit(1)).alias("platforms"), F.min(F.struct((-F.col("n")).alias("n"), "target")).alias("d"))
    out = sites.join(found, "site", "left").withColumn("conflicts", F.coalesce("conflicts", F.lit(0)))
    return out.select("site", "platforms", "conflicts", F.round(F.least(F.coalesce("w", F.lit(0.0)) / F.greatest("platforms", F.lit(1)), F.lit(1.0)), 6).alias("score"), F.col("d.target").alias("dominant"))


def filter_advice(obs: DataFrame) -> DataFrame:
    """feature, action, confidence, level: what to filter and what to keep, by class, security and frequency."""
    n = obs.agg(F.count_distinct("site")).scalar().cast("double")
    per = classified(obs.groupBy("feature").agg(F.count_distinct("site").alias("k"))).withColumn("f", F.col("k") / n)
    security = F.col("feature").rlike("security|csp|frame|xss|policy")
    action = F.when((security & (F.col("f") > 0.3)) | (F.col("f") < 0.05), "filter").otherwise("retain")
    c = F.col("f") * F.when(F.col("f") < 0.05, 0.7).when(F.col("f") > 0.2, 1.1).otherwise(1.0)
    c = clamp(c, 0.0, 1.0)
    level = F.when(c >= 0.8, "very-high").when(c >= 0.6, "high").when(c >= 0.4, "medium").otherwise("low")
    return per.select("feature", "category", F.round("f", 6).alias("frequency"), action.alias("action"), F.round(c, 6).alias("confidence"), level.alias("level"))


def retention_advice(obs: DataFrame) -> DataFrame:
    """feature, confidence, reasons: headers worth keeping for a vendor, a telling class or a middling frequency."""
    n = obs.agg(F.count_distinct("site")).scalar().cast("double")
    per = classified(obs.groupBy("feature").agg(F.count_distinct("site").alias("k"))).withColumns({"f": F.col("k") / n, "vendor": vendor_of(F.col("feature"))})
    reasons = F.array_compact(
        F.array(
            F.when(F.col("vendor").isNotNull(), F.struct(F.lit("vendor").alias("r"), F.lit(0.8).alias("c"))),
            F.when(F.col("category").isin("platform", "cms-indicative"), F.struct(F.lit("category").alias("r"), F.lit(0.7).alias("c"))),
            F.when((F.col("f") >= 0.1) & (F.col("f") <= 0.8), F.struct(F.lit("frequency").alias("r"), F.lit(0.6).alias("c"))),
        )
    )
    per = per.withColumn("x", reasons).where(F.size("x") > 0)
    mean = F.exp(F.aggregate("x", F.lit(0.0), lambda acc, y: acc + F.ln(y["c"])) / F.size("x"))
    return per.select("feature", F.array_join(F.transform("x", lambda y: y["r"]), ", ").alias("reasons"), F.round(mean, 6).alias("confidence"))
