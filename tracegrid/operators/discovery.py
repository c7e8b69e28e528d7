"""Naming patterns nobody listed: shared prefixes, suffixes, tokens and shapes of feature names, and their vendors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.functions import catalogue as K


#: Names that a pattern of each type needs at least, and from which on its confidence is full.
_LEAST = {"prefix": (2, 10), "suffix": (2, 8), "contains": (3, 15), "regex": (2, 5)}


def _of_type(column: int) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in _LEAST.items() for x in (k, v[column])]), F.col("type"))


def _rolled(members: DataFrame, obs: DataFrame) -> DataFrame:
    """pattern, type, members, site_count, frequency, confidence of (type, pattern, feature) rows: distinct sites of the union.

    The names of all types meet the observations in one join.
    """
    n = obs.agg(F.count_distinct("site")).scalar().cast("double")
    sizes = members.groupBy("type", "pattern").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") >= _of_type(0))
    sites = members.join(sizes, ["type", "pattern"]).join(obs.select("site", "feature").distinct(), "feature")
    per = sites.groupBy("type", "pattern", "members").agg(F.count_distinct("site").alias("site_count"))
    return per.select("pattern", "type", "members", "site_count", F.round(F.col("site_count") / n, 6).alias("frequency"), F.round(F.least(F.col("members") / _of_type(1), F.lit(1.0)), 6).alias("confidence"))


def _names(obs: DataFrame) -> DataFrame:
    return obs.select("feature").distinct()


def _prefix_members(names: DataFrame) -> DataFrame:
    """Prefixes of 2 to 12 characters that end before a separator, with it; two names at least."""
    name = F.col("feature")
    top = F.least(F.lit(12), F.length(name) - 2)
    cuts = F.filter(F.when(top >= 2, F.sequence(F.lit(2), top)), lambda i: F.substring(name, i + 1, F.lit(1)).isin("-", "_"))
    rows = names.select("feature", F.explode(F.transform(cuts, lambda i: F.substring(name, F.lit(1), i + 1))).alias("pattern"))
    return rows.select(F.lit("prefix").alias("type"), "pattern", "feature")


def prefix_patterns(obs: DataFrame) -> DataFrame:
    return _rolled(_prefix_members(_names(obs)), obs)


def _suffix_members(names: DataFrame) -> DataFrame:
    """Each name by its longest suffix of 2 to 8 characters that it shares with another; groups of two at least."""
    name = F.col("feature")
    top = F.least(F.lit(8), F.length(name) - 1)
    each = names.select("feature", F.explode(F.transform(F.when(top >= 2, F.sequence(F.lit(2), top)), lambda i: F.substring(name, F.length(name) - i + 1, i))).alias("pattern"))
    shared = each.groupBy("pattern").agg(F.count(F.lit(1)).alias("c")).where("c >= 2").select("pattern")
    w = Window.partitionBy("feature").orderBy(F.desc(F.length("pattern")))
    longest = each.join(shared, "pattern").withColumn("r", F.row_number().over(w)).where("r = 1").select("feature", "pattern")
    return longest.select(F.lit("suffix").alias("type"), "pattern", "feature")


def suffix_patterns(obs: DataFrame) -> DataFrame:
    return _rolled(_suffix_members(_names(obs)), obs)


def _token_members(names: DataFrame) -> DataFrame:
    """Tokens of three letters and more that three names share."""
    tokens = F.filter(F.array_union(F.split("feature", r"[-_.\s]"), F.regexp_extract_all("feature", F.lit(r"([a-z]{3,})"), 1)), lambda t: F.length(t) >= 3)
    rows = names.select("feature", F.explode(F.array_distinct(tokens)).alias("pattern"))
    return rows.select(F.lit("contains").alias("type"), "pattern", "feature")


def token_patterns(obs: DataFrame) -> DataFrame:
    return _rolled(_token_members(_names(obs)), obs)


def _shape_members(names: DataFrame) -> DataFrame:
    """Names of one of the known shapes; two at least."""
    shapes = F.array_compact(F.array(*[F.when(F.col("feature").rlike(rx), F.lit(n)) for n, rx in K.NAME_SHAPES]))
    return names.select("feature", F.explode(shapes).alias("pattern")).select(F.lit("regex").alias("type"), "pattern", "feature")


def shape_patterns(obs: DataFrame) -> DataFrame:
    return _rolled(_shape_members(_names(obs)), obs)


def discovered(obs: DataFrame, min_sites: int, k: int = 100) -> DataFrame:
    """The k strongest patterns of all types: frequency over .05 (.1 below a hundred sites) and enough sites."""
    n = obs.agg(F.count_distinct("site")).scalar()
    names = _names(obs)
    members = _prefix_members(names).unionByName(_suffix_members(names)).unionByName(_token_members(names)).unionByName(_shape_members(names))
    all_ = _rolled(members, obs)
    floor = F.when(n >= 100, 0.05).otherwise(0.1)
    sig = F.when(F.col("site_count") < 5, 0.1).otherwise((F.least(F.col("frequency") * 2, F.lit(1.0)) + F.least(F.col("site_count") / 100, F.lit(1.0))) / 2)
    kept = all_.where((F.col("frequency") >= floor) & (F.col("site_count") >= min_sites)).withColumns({"rank_value": F.round(F.col("frequency") * F.col("confidence"), 6), "significance": F.round(sig, 6)})
    return kept.orderBy(F.desc("rank_value"), "type", "pattern").limit(k)


_INDICATORS = [
    ("cloudflare", ["cf", "cloudflare"]), ("fastly", ["fastly", "fl"]), ("akamai", ["akamai", "ak"]), ("amazon", ["aws", "amazon", "amz"]), ("microsoft", ["ms", "microsoft", "azure"]),
    ("google", ["goog", "google", "gc"]), ("shopify", ["shopify", "shop"]), ("wordpress", ["wp", "wordpress"]), ("drupal", ["drupal"]), ("duda", ["duda", "d"]),
]
_COMMON = ["content", "cache", "request", "response", "session", "user", "api", "data", "version", "total", "time", "status", "header", "value", "test"]


def vendor_of_token(token: Column) -> Column:
    """The vendor that a token hints at, in this order (short hints match widely); an uncommon word of three letters itself."""
    out = None
    for name, hints in _INDICATORS:
        hit = F.lit(False)
        for h in hints:
            hit = hit | token.contains(h)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.when((F.length(token) >= 3) & ~token.isin(*_COMMON), token)


def emerging_vendors(found: DataFrame, least: int = 2, floor: float = 0.3) -> DataFrame:
    """vendor, patterns, confidence: vendors that several discovered patterns hint at."""
    v = found.withColumn("vendor", vendor_of_token(F.lower(F.regexp_replace("pattern", r"[-_*]", "")))).where("vendor is not null")
    per = v.groupBy("vendor").agg(F.count(F.lit(1)).alias("patterns"), F.round(F.avg("confidence"), 6).alias("confidence"), F.max("site_count").alias("most_sites"))
    return per.where((F.col("patterns") >= least) & (F.col("confidence") >= floor))


def anomalies(classified: DataFrame, freq: DataFrame) -> DataFrame:
    """feature, expected, actual: names that hint at one class and are listed under another."""
    n = F.col("feature")
    expected = F.when(n.contains("cache"), "infrastructure").when(n.contains("security") | n.contains("csp"), "security").when(n.contains("wp"), "cms-indicative")
    rows = classified.join(freq, "feature").withColumn("expected", expected)
    return rows.where("expected is not null and expected <> category and frequency > 0.01").select("feature", "expected", F.col("category").alias("actual"), F.col("score").alias("confidence"), "frequency")


def halves(obs: DataFrame) -> DataFrame:
    """obs with the column late: whether a row lies in the second half by time. Needs ten rows at least.

    Rows are counted per day, days are added up, and the day in which the half falls is told; only the rows of that day are
    ranked, all others are placed by their day. The days are as many as the corpus has, however many rows they hold.
    """
    rows = obs.where("captured_at is not null").withColumn("day", F.to_date("captured_at"))
    days = rows.groupBy("day").agg(F.count(F.lit(1)).alias("c"))
    upto = days.withColumn("upto", F.sum("c").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))
    half = rows.agg(F.floor(F.count(F.lit(1)) / 2)).scalar()
    border = upto.where(F.col("upto") >= half).agg(F.min(F.struct("day", (F.col("upto") - F.col("c")).alias("prior"))).alias("b"))
    day, prior = border.select("b.day").scalar(), border.select("b.prior").scalar()
    other = rows.where(F.col("day") != day).withColumn("late", F.col("day") > day)
    w = Window.orderBy("captured_at", "site", "feature", "value")
    ranked = rows.where(F.col("day") == day).withColumn("late", prior + F.row_number().over(w) > half)
    return other.unionByName(ranked)


def evolution(obs: DataFrame) -> DataFrame:
    """feature, change: features seen in only one half of the observed time, 'new' or 'deprecated'."""
    h = halves(obs)
    per = h.groupBy("feature").agg(F.bool_or("late").alias("l"), F.bool_or(~F.col("late")).alias("e"))
    return per.where("l <> e").select("feature", F.when(F.col("l"), "new").otherwise("deprecated").alias("change"))


def version_families(obs: DataFrame) -> DataFrame:
    """family, versions, earliest, latest of names that end in a version number."""
    names = _names(obs).select("feature", F.regexp_extract("feature", r"^(.+?)-?v?(\d+)$", 1).alias("family"), F.regexp_extract("feature", r"^(.+?)-?v?(\d+)$", 2).alias("v")).where("family <> ''")
    return names.groupBy("family").agg(F.count(F.lit(1)).alias("versions"), F.min(F.expr("cast(v as decimal(38,0))")).cast("string").alias("earliest"), F.max(F.expr("cast(v as decimal(38,0))")).cast("string").alias("latest")).where("versions >= 2")
