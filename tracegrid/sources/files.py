"""Reading and writing captures: JSON documents, capture indexes, address lists, labelled sites; Parquet, JSON lines, CSV.

Schemas are declared, never inferred; what does not fit goes to ``_corrupt_record`` and is split off as rejects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Both shapes of a stored capture, current and older, as nullable columns of one schema.
CAPTURE = """url string, timestamp timestamp, statusCode int, htmlContent string, title string,
httpHeaders map<string,string>, metaTags array<struct<name:string,property:string,httpEquiv:string,content:string>>, scripts array<struct<src:string,inline:boolean,content:string,type:string>>,
pageData struct<httpInfo:struct<headers:map<string,string>>,metadata:map<string,string>,scripts:array<struct<src:string>>>,
robotsTxt struct<content:string,accessible:boolean,httpHeaders:map<string,string>>,
detectionResult struct<allTechnologies:array<string>>, detectionResults array<struct<detector:string,strategy:string,cms:string,confidence:double,version:string,executionTime:double>>, _corrupt_record string"""
INDEX = "fileId string, url string, timestamp timestamp, cms string, confidence double, filePath string"
LABELLED = "url string, cms string, version string, confidence double, addedAt timestamp, verifiedBy string, notes string, detectedVersion string, versionSource string"
EXPORT = ("url", "timestamp", "statusCode", "title", "cms", "confidence", "headers", "meta_tags", "scripts", "html_size")


def captures(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Captures stored as JSON, one document a line, and the lines that could not be read."""
    text = spark.read.text(path).where("trim(value) <> ''")
    rows = text.select("value", F.from_json("value", CAPTURE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    bad = F.col("r._corrupt_record").isNotNull() | F.col("r").isNull()
    return normalised(rows.where(~bad).select("r.*").drop("_corrupt_record")), rows.where(bad).select("value")


def normalised(raw: DataFrame) -> DataFrame:
    """Either shape as one: headers (lower-case names of page and robots.txt to distinct values), metas, scripts."""
    page = F.coalesce("httpHeaders", "pageData.httpInfo.headers")
    lower = lambda m: F.map_from_entries(F.array_distinct(F.transform(F.map_entries(m), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))))
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(lower(page), empty), F.coalesce(lower(F.col("robotsTxt.httpHeaders")), empty)
    headers = F.map_zip_with(a, b, lambda _, x, y: F.array_distinct(F.array_compact(F.array(x, y))))
    named = F.filter("metaTags", lambda t: t["name"].isNotNull())
    metas = F.coalesce(F.map_from_entries(F.transform(F.array_distinct(F.transform(named, lambda t: t["name"])), lambda n: F.struct(n.alias("key"), F.element_at(F.filter(named, lambda t: t["name"] == n), 1)["content"].alias("value")))), F.col("pageData.metadata"))
    scripts = F.array_distinct(F.filter(F.coalesce(F.transform("scripts", lambda s: s["src"]), F.transform("pageData.scripts", lambda s: s["src"])), lambda s: s.isNotNull()))
    return raw.select("url", "timestamp", F.col("statusCode").alias("status_code"), F.col("htmlContent").alias("html"), "title", headers.alias("headers"), metas.alias("metas"), scripts.alias("scripts"), F.col("detectionResult.allTechnologies").alias("technologies"), F.col("detectionResults").alias("detections"))


def index(spark: SparkSession, path: str) -> DataFrame:
    """A capture index: a bare array, or one under the key files."""
    doc = spark.read.text(path, wholetext=True)
    bare = F.from_json("value", f"array<struct<{INDEX.replace(' string', ':string').replace(' timestamp,', ':timestamp,').replace(' double', ':double')}>>")
    kept = F.from_json("value", f"files array<struct<{INDEX.replace(' string', ':string').replace(' timestamp,', ':timestamp,').replace(' double', ':double')}>>")
    return doc.select(F.explode(F.coalesce(kept["files"], bare)).alias("r")).select("r.*")


def addresses(spark: SparkSession, path: str) -> DataFrame:
    """A list of addresses from a CSV file: the first of the columns url, urls, website, link; blanks skipped."""
    t = spark.read.option("header", True).csv(path)
    names = {c.strip().lower(): c for c in t.columns}
    pick = next((names[n] for n in ("url", "urls", "website", "link") if n in names), None)
    if pick is None:
        raise ValueError("no column url, urls, website or link")
    return t.select(F.trim(F.col(pick)).alias("url")).where("url is not null and url <> ''")


def labelled(spark: SparkSession, path: str) -> DataFrame:
    """Sites with a known platform: an object with the list sites."""
    doc = spark.read.text(path, wholetext=True)
    kind = ", ".join(f"{c.split()[0]}:{c.split()[1]}" for c in LABELLED.split(", "))
    return doc.select(F.explode(F.from_json("value", f"sites array<struct<{kind}>>")["sites"]).alias("r")).select("r.*")


def required_patterns(spark: SparkSession, path: str) -> DataFrame:
    """cms, pattern of lists of required patterns; doubles once."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "cms string, version string, required_patterns array<string>").alias("d"))
    return doc.select("d.cms", F.explode("d.required_patterns").alias("pattern")).distinct()


def append(df: DataFrame, path: str, day: str | None = None) -> None:
    """Append captures as Parquet, one folder per day of a time column, so that date filters prune."""
    if day:
        df.withColumn("captured_date", F.to_date(day)).write.mode("append").partitionBy("captured_date").parquet(path)
    else:
        df.write.mode("append").parquet(path)


def export(df: DataFrame, path: str, fmt: str) -> None:
    """Export as json, jsonl or csv; nested columns of a CSV become JSON text, every cell is quoted."""
    if fmt in ("json", "jsonl"):
        df.write.mode("overwrite").json(path)
    elif fmt == "csv":
        flat = [F.to_json(c).alias(c) if k.startswith(("array", "map", "struct")) else F.col(c) for c, k in df.dtypes]
        df.select(*flat).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)
    else:
        raise ValueError(f"unknown format {fmt}")
