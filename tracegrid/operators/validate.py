"""Validation of feature frequencies in seven measured stages and a verdict, and the bias of a corpus towards platforms.

Stages are independent aggregates over one table of features (feature, site_count, frequency) and the cells of the cube;
each gives one row of metrics, so the pipeline is a union and its verdict an aggregate of that union.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.functions import stats as S
from tracegrid.operators import cooccurrence as C
from tracegrid.operators import discrimination as D
from tracegrid.operators import frequency as Q


def _row(df: DataFrame, stage: str, score: Column, passed: Column, metrics: dict[str, Column], digits: int = 5) -> DataFrame:
    named = F.map_from_entries(F.array(*[F.struct(F.lit(k), F.round(v.cast("double"), 5)) for k, v in metrics.items()]))
    return df.select(F.lit(stage).alias("stage"), F.round(score, digits).alias("score"), passed.alias("passed"), F.explode(named).alias("metric", "value"))


def stages(obs: DataFrame, min_sites: int, digits: int = 5) -> DataFrame:
    """stage, score, passed, metric, value: frequency, sample size, distribution, correlation, sanity, significance and the
    recommendations that these give rise to, with their mean confidence."""
    obs = obs if D.is_counted(obs) else D.counted(obs)
    total = D.sites(obs).cast("double")
    raw = Q.feature_frequency(obs)
    kept = raw.where(F.col("site_count") >= min_sites)
    n_kept = kept.agg(F.count(F.lit(1))).scalar()

    a = raw.agg(
        F.count(F.lit(1)).alias("all"), F.count_if(F.col("site_count") < min_sites).alias("dropped"), F.count_if((F.col("site_count") >= min_sites) & (((F.col("frequency") < 0.01) & (F.col("site_count") < 5)) | (F.col("frequency") > 0.95))).alias("warned")
    )
    rate = S.ratio(F.col("dropped"), F.col("all"))
    one = _row(a, "frequency", F.greatest(F.lit(0.5), 1 - 0.1 * F.col("warned") - 0.3 * rate), F.lit(True), {"filter_rate": rate, "warnings": F.col("warned")}, digits)

    b = D.platforms(obs).agg(F.sum("np").alias("n"))
    power = S.power(F.col("n"), 0.1)
    two = _row(b, "sample-size", (F.least(F.lit(1.0), F.col("n") / 30) + power) / 2, F.col("n") >= 5, {"sites": F.col("n"), "power": power, "required": S.min_sample(F.col("n"))}, digits)

    out = C.outliers(kept).agg(F.count(F.lit(1))).scalar()
    c = C.moments(kept)
    skew = F.abs(F.coalesce(F.col("skewness"), F.lit(0.0)))
    score = F.when(skew > 3, 0.56).when(skew > 2, 0.8).otherwise(1.0) * F.greatest(F.lit(0.5), 1 - out * 0.1) * (0.5 + 0.5 * F.coalesce(F.col("coverage"), F.lit(0.0)))
    three = _row(c, "distribution", score, F.lit(True), {"skewness": F.coalesce(F.col("skewness"), F.lit(0.0)), "outliers": out, "coverage": F.coalesce(F.col("coverage"), F.lit(0.0))}, digits)

    sizes = D.platforms(obs)
    balance = sizes.select((F.col("np") / total).alias("p")).agg(S.ratio(-F.sum(F.col("p") * F.log2("p")), F.log2(F.count(F.lit(1))))).scalar()
    cells = D.cells(obs, min_sites)
    biggest = cells.groupBy("feature", "nf").agg(F.max("np").alias("m")).withColumn("r", F.least(F.lit(1.0), F.col("nf") / F.col("m")))
    d = biggest.agg(F.coalesce(F.avg("r"), F.lit(0.8)).alias("r"), F.count_if(F.col("r") > 0.95).alias("high"))
    four = _row(d, "correlation", (balance + F.col("r")) / 2, F.lit(True), {"balance": balance, "mean_correlation": F.col("r"), "high": F.col("high")}, digits)

    # Six checks: shares add up, lie within 0 and 1, are borne by thirty sites if high (a warning), agree by Bayes' rule (a
    # warning), sites are conserved, and no cell exceeds its feature.
    p, left, right = F.col("n") / F.col("nf"), F.col("n") / F.col("nf") * (F.col("nf") / total), F.col("f") * F.col("np") / total
    e = cells.groupBy("feature", "nf").agg(
        F.sum(p).alias("s"), F.sum("n").alias("n"), F.count_if((p < 0) | (p > 1)).alias("out"), F.count_if((p > 0.7) & (F.col("n") < 30)).alias("weak"),
        F.count_if(F.abs(left - right) / F.greatest(left, right, F.lit(0.001)) > 0.05).alias("bayes"), F.count_if(F.col("n") > F.col("nf")).alias("over"),
    )
    e = e.agg(F.count_if(F.abs(F.col("s") - 1) > 0.01).alias("sums"), F.sum("out").alias("out"), F.sum("weak").alias("weak"), F.sum("bayes").alias("bayes"), F.count_if(F.col("n") != F.col("nf")).alias("counts"), F.sum("over").alias("over"))
    e = e.select(*[F.coalesce(c, F.lit(0)).alias(c) for c in e.columns])
    broken = sum(((F.col(c) > 0).cast("int") for c in ("out", "counts", "over")), (F.col("sums") > 0).cast("int"))
    sane = F.when(broken == 0, F.greatest(F.lit(0.7), 1 - (F.col("weak") + F.col("bayes")) * 0.1)).otherwise(F.greatest(F.lit(0.2), (6 - broken) / 6))
    five = _row(e, "sanity", sane, broken == 0, {"sums": F.col("sums"), "ranges": F.col("out"), "weak_support": F.col("weak"), "bayes": F.col("bayes"), "counts": F.col("counts"), "impossible": F.col("over")}, digits)

    f = C.binomial(obs, min_sites).agg(F.count_if("significant").alias("k"))
    share = S.ratio(F.col("k"), n_kept)
    six = _row(f, "significance", F.greatest(F.lit(0.3), share), F.lit(True), {"significant": F.col("k"), "rate": share}, digits)

    # What the stages recommend: more data for a high filter rate (.8) or low power (.9), wider coverage (.7), repair of checks.
    facts = [a.select(rate.alias("rate")).select("rate").scalar(), b.select(power.alias("p")).select("p").scalar(), c.select("coverage").scalar(), e.select(broken.alias("b")).select("b").scalar()]
    asked = F.array_compact(F.array(F.when(facts[0] > 0.5, 0.8), F.when(facts[1] < 0.8, 0.9), F.when(F.coalesce(facts[2], F.lit(0.0)) < 0.5, 0.7), F.when(facts[3] > 3, 0.9).when(facts[3] > 0, 0.8)))
    g = b.select(asked.alias("r")).select(F.size("r").alias("k"), F.when(F.size("r") == 0, 1.0).otherwise(F.aggregate("r", F.lit(0.0), lambda x, y: x + y) / F.size("r")).alias("m"))
    seven = _row(g, "recommendation", (F.col("m") + 1) / 2, F.lit(True), {"recommendations": F.col("k"), "mean_confidence": F.col("m")}, digits)
    return one.unionByName(two).unionByName(three).unionByName(four).unionByName(five).unionByName(six).unionByName(seven)


def verdict(found: DataFrame) -> DataFrame:
    """score (product of the stages, halved for each that failed), grade and pass of the pipeline."""
    per = found.select("stage", "score", "passed").distinct()
    a = per.agg(F.exp(F.sum(F.ln(F.greatest(F.col("score") * F.when(F.col("passed"), 1.0).otherwise(0.5), F.lit(1e-9))))).alias("s"), F.bool_and("passed").alias("ok"), F.count(F.lit(1)).alias("stages"))
    grade = F.when(F.col("s") >= 0.9, "A").when(F.col("s") >= 0.8, "B").when(F.col("s") >= 0.7, "C").when(F.col("s") >= 0.6, "D").otherwise("F")
    return a.select("stages", F.round("s", 4).alias("score"), grade.alias("grade"), (F.col("ok") & (F.col("s") >= 0.7)).alias("passed"))


def platform_metrics(obs: DataFrame, min_sites: int) -> DataFrame:
    """Per cell: occurrences, expected, chi-square share, whether it stands out, and the spread of the cell's values.

    Spread is the entropy of the value counts over log2 of their number.
    """
    total = obs.agg(F.count_distinct("site")).scalar().cast("double")
    c = D.cells(obs, min_sites).withColumn("total", total)
    f = F.col("nf") / F.col("total")
    e = f * F.col("np")
    values = obs.where("value is not null").groupBy("feature", "platform", "value").agg(F.count_distinct("site").alias("k"))
    spread = values.groupBy("feature", "platform").agg(F.count(F.lit(1)).alias("values"), (F.log2(F.sum("k")) - F.sum(F.col("k") * F.log2("k")) / F.sum("k")).alias("h"))
    rows = c.join(spread, ["feature", "platform"], "left")
    return rows.select(
        "feature", "platform", "n", F.round(e, 5).alias("expected"), F.round(F.pow(F.col("n") - e, F.lit(2)) / e, 4).alias("chi_share"), (F.abs(F.col("n") - e) > 1.96 * F.sqrt(e * (1 - f)) + 1e-12).alias("stands_out"),
        F.coalesce("values", F.lit(0)).alias("values"), F.round(S.ratio(F.col("h"), F.log2("values")), 5).alias("spread"),
    )


def overall_metrics(obs: DataFrame, min_sites: int) -> DataFrame:
    """feature, sites, values, values_per_site, modal_value (ties to the smallest) over the whole corpus."""
    v = obs.where("value is not null").groupBy("feature", "value").agg(F.count_distinct("site").alias("k"))
    per = v.groupBy("feature").agg(F.count(F.lit(1)).alias("values"), F.sum("k").alias("pairs"), F.min(F.struct((-F.col("k")).alias("k"), "value")).alias("m"))
    sites = obs.groupBy("feature").agg(F.count_distinct("site").alias("sites")).where(F.col("sites") >= min_sites)
    return sites.join(per, "feature").select("feature", "sites", "values", F.round(F.col("pairs") / F.col("sites"), 5).alias("values_per_site"), F.col("m.value").alias("modal_value"))


def risk(obs: DataFrame, min_sites: int) -> DataFrame:
    """feature, factors, risk, confidence: how far a recommendation on a feature can be trusted.

    Six factors: telling one platform (high), frequent on a dominant platform (high), rare and concentrated, too few sites,
    few significant platforms (medium each), one or two values only (low).
    """
    cube = D.counted(obs)
    total, k = D.sites(cube).cast("double"), D.platforms(cube).agg(F.count(F.lit(1))).scalar()
    spec = D.specificity(cube, min_sites)
    fit = D.conditional(cube, min_sites).groupBy("feature").agg(F.count_if("significant").alias("sig"))
    lead = D.cells(cube, min_sites).where("platform <> 'unknown'").groupBy("feature").agg(F.min(F.struct((-F.col("f")).alias("f"), "platform", "np")).alias("b"))
    m = overall_metrics(obs, min_sites)
    rows = m.join(spec, "feature").join(fit, "feature").join(lead, "feature", "left").withColumn("total", total)
    freq = F.col("sites") / F.col("total")
    few = F.col("sites") < 5
    factors = F.array_compact(
        F.array(
            F.when(F.col("specificity") > 0.7, "high:platform"),
            F.when((-F.col("b.f") > 0.8) & (F.col("b.np") / F.col("total") > 0.5), "high:dataset"),
            F.when((freq < 0.1) & (F.col("specificity") > 0.5), "medium:concentration"),
            F.when(few, "medium:sample"),
            F.when(F.col("sig") / k < 0.3, "medium:significance"),
            F.when((F.col("values") < 3) & (F.col("sites") > 10), "low:values"),
        )
    )
    rows = rows.withColumn("x", factors)
    high, medium = F.exists("x", lambda v: v.startswith("high")), F.size(F.filter("x", lambda v: v.startswith("medium")))
    confidence = F.when(high, "low").when(F.array_contains("x", "medium:concentration") | F.array_contains("x", "medium:sample"), "medium").otherwise("high")
    return rows.select("feature", F.array_join("x", ", ").alias("factors"), F.when(high, "high").when(medium > 1, "medium").otherwise("low").alias("risk"), confidence.alias("confidence"))


def warnings(obs: DataFrame) -> DataFrame:
    """warning, value: a platform over 60 % of the sites, two platforms or fewer, over 30 % unknown, strong concentration."""
    sizes = D.platforms(obs)
    total = sizes.agg(F.sum("np")).scalar().cast("double")
    a = sizes.agg((F.max("np") / total).alias("top"), F.count(F.lit(1)).alias("k"), (F.sum(F.when(F.col("platform") == "unknown", F.col("np")).otherwise(0)) / total).alias("u"), F.sum(F.pow(F.col("np") / total, F.lit(2))).alias("h"))
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("warning"), F.round(v.cast("double"), 6).alias("value"), on.alias("on"))
            for n, v, on in (("dominant platform", F.col("top"), F.col("top") > 0.6), ("few platforms", F.col("k"), F.col("k") <= 2), ("many unknown", F.col("u"), F.col("u") > 0.3), ("concentrated", F.col("h"), F.col("h") > 0.3))
        ]
    )
    return a.select(F.explode(F.filter(rows, lambda r: r["on"])).alias("r")).select("r.warning", "r.value")


def sensitivity(obs: DataFrame, min_sites: int) -> DataFrame:
    """feature, sensitivity, label: specificity times largest P(platform | feature) times concentration, at most 1."""
    obs = D.counted(obs)
    h = D.concentration(obs).select("hhi").scalar()
    top = D.cells(obs, min_sites).groupBy("feature").agg(F.max(F.col("n") / F.col("nf")).alias("p"))
    rows = D.specificity(obs, min_sites).join(top, "feature").withColumn("s", F.least(F.lit(1.0), F.col("specificity") * F.col("p") * h))
    return rows.select("feature", F.round("s", 5).alias("sensitivity"), F.when(F.col("s") < 0.2, "robust").when(F.col("s") > 0.5, "sensitive").otherwise("moderate").alias("label"))


SUPPORTED = ("wordpress", "drupal", "joomla", "shopify", "magento")
_RELEVANT = {
    "wordpress": r"wp-|wordpress|wp/|xmlrpc|pingback", "drupal": r"drupal|sites/default|modules/", "joomla": r"joomla|administrator/|component|modules/mod_",
    "shopify": r"shopify|shop-id|myshopify", "magento": r"magento|mage|skin/frontend|js/mage",
}
_TELLING = {
    "wordpress": r"wp-admin|wp-content|wp-includes|xmlrpc\.php|wp-json", "drupal": r"sites/default|core/modules|core/themes", "joomla": r"administrator/index\.php|modules/mod_|components/com_",
    "shopify": r"cdn\.shopify\.com|shopify-stage|shop-id|myshopify\.com", "magento": r"skin/frontend|js/mage|catalog/product",
}
_NAMING = {"wordpress": r"wp-|wordpress", "drupal": "drupal", "joomla": "joomla", "shopify": "shopify", "magento": "magento|mage"}


def dimension_support(scored: dict[str, DataFrame]) -> DataFrame:
    """platform, dim, support: mean of score, name specificity and frequency over a platform's telling patterns.

    scored: discrimination tables by dimension. Relevant are patterns whose name fits the platform, with a score above .3
    and a name specificity above .3 (.95 telling, .7 naming).
    """
    out = None
    for dim, t in scored.items():
        fits = []
        for p in SUPPORTED:
            spec = F.when(F.col("feature").rlike(_TELLING[p]), 0.95).when(F.col("feature").rlike(_NAMING[p]), 0.7).otherwise(0.1)
            fits.append(F.when(F.col("feature").rlike(_RELEVANT[p]), F.struct(F.lit(p).alias("platform"), spec.alias("spec"))))
        # One row per platform that a name fits, from one pass over the table.
        rows = t.select(F.lit(dim).alias("dim"), "discriminative_score", "frequency", F.explode(F.array_compact(F.array(*fits))).alias("x")).select("dim", "discriminative_score", "frequency", "x.*")
        out = rows if out is None else out.unionByName(rows)
    kept = out.where("discriminative_score > 0.3 and spec > 0.3")
    return kept.groupBy("platform", "dim").agg(F.round(F.avg(F.col("discriminative_score") * F.col("spec") * F.col("frequency")), 6).alias("support"), F.count(F.lit(1)).alias("patterns"))


def platform_signatures(support: DataFrame, dims: int = 3) -> DataFrame:
    """platform, strength, agreement, total, rank: how dimensions bear each other out.

    Strength is 1 less the population deviation of the supports (0 where a dimension has none); they agree if all or none
    exceed .3.
    """
    per = support.groupBy("platform").agg(F.sum("support").alias("s"), F.sum(F.col("support") * F.col("support")).alias("q"), F.count_if(F.col("support") > 0.3).alias("over"))
    mean = F.col("s") / dims
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("q") / dims - mean * mean))
    w = Window.orderBy(F.desc("total"), "platform")
    rows = per.select("platform", F.round(1 - sd, 6).alias("strength"), F.col("over").isin(0, dims).alias("agreement"), F.round("s", 6).alias("total"))
    # Five platforms at most, so one task ranks them.
    return rows.withColumn("rank", F.row_number().over(w))
