"""The queries of the text operators and, where SQL can express them over whole tables, their twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrid.llm import bpe, canonical, heavy, packing, quality, residue
from tracegrid.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _addresses(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.canonical_urls(table(spark, sf, "capture_index"), "entry_id", "url")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.copies(_addresses(spark, sf))


def p1_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    """One record per address with the number of its copies."""
    return canonical.collapse(_addresses(spark, sf)).select("first_id", "n_copies")


def p1_collisions(spark: SparkSession, sf: str) -> DataFrame:
    """Digests that two different addresses share."""
    found = canonical.collisions(canonical.collapse(_addresses(spark, sf)))
    return found.select(F.lower(F.hex("_h")).alias("digest"), "n_texts")


FIELDS = ("header", "meta", "script")


def _values(spark: SparkSession, sf: str) -> DataFrame:
    parts = [
        table(spark, sf, "header_values").select(F.lit(0).alias("field"), F.col("header_value").alias("value")),
        table(spark, sf, "meta_values").select(F.lit(1).alias("field"), F.col("tag_value").alias("value")),
        table(spark, sf, "script_patterns").select(F.lit(2).alias("field"), F.explode("examples").alias("value")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _field_kind() -> F.Column:
    return F.element_at(F.array(*[F.lit(x) for x in FIELDS]), F.col("field") + 1)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    top = heavy.most_frequent(_values(spark, sf), 0.005)
    return top.select(_field_kind().alias("field_kind"), F.col("value").alias("item"))


def p2_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The frequent values with their exact counts, and whether these lie within what the summary promised."""
    top = heavy.most_frequent(_values(spark, sf), 0.005)
    within = (F.col("approx_count") <= F.col("exact_count")) & (F.col("exact_count") <= F.col("approx_count") + F.col("error"))
    return top.select(_field_kind().alias("field_kind"), F.col("value").alias("item"), "exact_count", "n", within.alias("within"))


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    a, b = table(spark, sf, "captures"), table(spark, sf, "site_analyses")
    pages = residue.judged_captures(a, F.col("capture_id"), F.col("url"), F.col("page_data.metadata"), F.col("page_data.html_content"))
    return pages.unionByName(residue.judged_robots(b, F.col("record_id"), F.col("url"), F.col("robots_analysis")))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue.residue(_judged(spark, sf))


def p6_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """How many records each kind of evidence in the residual decides, and for how many boilerplate had to go first."""
    found = residue.verdicts(_judged(spark, sf)).distinct()
    return found.groupBy("owner_table", "reason").agg(F.count(F.lit(1)).alias("records"), F.count_if("subtracted").alias("after_subtracting"))


def p6_boilerplate(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks that recur on a host, by hash: what is subtracted before a record is judged."""
    return residue.boilerplate(_judged(spark, sf))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_table(table(spark, sf, "documents"), "doc_id", F.col("text"))


def _sized(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """The documents in tokens, and their number, which the footers of the files tell."""
    docs = table(spark, sf, "documents")
    return bpe.count_table(docs, "doc_id", F.col("text")), docs.count()


def p8_packed(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's place in the containers of each kind; all tokens bear loss and segments are not limited."""
    items, n = _sized(spark, sf)
    packed = packing.pack(items.withColumn("loss_tokens", F.col("n_tokens")), table(spark, sf, "containers").select("container_kind", "capacity_tokens"), n)
    return packed.drop("loss_tokens")


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Per kind: containers against the fewest possible, and the share of room in use."""
    items, n = _sized(spark, sf)
    kinds = table(spark, sf, "containers").select("container_kind", "capacity_tokens")
    return packing.fill_report(packing.pack(items.withColumn("loss_tokens", F.col("n_tokens")), kinds, n), kinds)


def _instructions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents as instruction data: the second half of a text is the answer and bears loss, a container holds eight
    segments at most and three fifths of its tokens may bear loss. All three limits bind."""
    items, n = _sized(spark, sf)
    kinds = table(spark, sf, "containers").select("container_kind", "capacity_tokens", F.lit(8).alias("segments"), F.expr("capacity_tokens * 3 div 5").alias("loss_tokens"))
    items = items.withColumn("loss_tokens", F.when(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0, F.col("n_tokens")).otherwise(F.expr("n_tokens div 2")))
    return packing.pack(items, kinds, n), kinds


def p8_instructions(spark: SparkSession, sf: str) -> DataFrame:
    """Places of the documents under limits on tokens, segments and loss-bearing tokens at once."""
    return _instructions(spark, sf)[0]


def p8_instructions_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Per kind: containers under the three limits against the fewest possible."""
    return packing.fill_report(*_instructions(spark, sf))


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = quality.train(docs, table(spark, sf, "doc_labels"), "doc_id", F.col("text"), docs.count())
    return quality.classified(docs, "doc_id", F.col("text"), model)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _classified(spark, sf).where("doc_class <> 'prose'").select("doc_id", "doc_class")


def p9_classes(spark: SparkSession, sf: str) -> DataFrame:
    """The class of every document with its calibrated probability."""
    return _classified(spark, sf)


def p9_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return quality.statistics(table(spark, sf, "documents"), "doc_id", F.col("text"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_collapsed, p1_collisions, p2_found, p2_counts, p6_found, p6_verdicts, p6_boilerplate, p7_ids, p8_packed, p8_fill, p8_instructions, p8_instructions_fill, p9_found, p9_classes, p9_statistics)}


_CANONICAL = r"""
WITH bare AS (
  SELECT entry_id, regexp_replace(url, '^(?:%(?:20|09|0[aAdD])|[^\p{L}\p{N}])+', '') AS u FROM capture_index WHERE url IS NOT NULL
), cut AS (
  SELECT entry_id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)\s*:\s*/\s*/', 1)) AS scheme,
    regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*\s*:\s*/\s*/[^\p{L}\p{N}]*', '') AS rest FROM bare
), parts AS (
  SELECT entry_id, scheme, regexp_extract(rest, '^[^/?#]*') AS authority, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query, regexp_extract(rest, '^[^#]*#((?s:.*))$', 1) AS fragment FROM cut
), ported AS (
  SELECT *, regexp_extract(authority, ':\s*0*(\d+)[^\p{L}\p{N}]*$', 1) AS port,
    regexp_replace(lower(url_decode(regexp_replace(authority, ':\s*\d+[^\p{L}\p{N}]*$', ''))), '^www\s*\.', '') AS host FROM parts
), keyed AS (
  SELECT entry_id, concat_ws(chr(1),
    trim(regexp_replace(lower(host), '[^\p{L}\p{N}\p{M}]+', ' ', 'g')),
    CASE WHEN (port = '80' AND scheme IN ('http', '')) OR (port = '443' AND scheme = 'https') THEN '' ELSE port END,
    trim(regexp_replace(lower(url_decode(path)), '[^\p{L}\p{N}\p{M}]+', ' ', 'g')),
    array_to_string(list_sort(list_filter(list_transform(string_split(query, '&'),
      lambda x: trim(regexp_replace(lower(url_decode(x)), '[^\p{L}\p{N}\p{M}]+', ' ', 'g'))), lambda x: x <> '')), '&'),
    trim(regexp_replace(lower(url_decode(fragment)), '[^\p{L}\p{N}\p{M}]+', ' ', 'g'))) AS k FROM ported
), grouped AS (SELECT entry_id, min(entry_id) OVER (PARTITION BY k) AS first_id, k FROM keyed)
"""

_VALUES = """
WITH v AS (
  SELECT 'header' AS field_kind, header_value AS item FROM header_values
  UNION ALL SELECT 'meta', tag_value FROM meta_values
  UNION ALL SELECT 'script', unnest(examples) FROM script_patterns
), c AS (SELECT field_kind, item, count(*) AS k FROM v WHERE item IS NOT NULL AND item <> '' GROUP BY ALL),
t AS (SELECT *, sum(k) OVER (PARTITION BY field_kind) AS n FROM c)
"""

_STATISTICS = r"""
WITH w AS (
  SELECT doc_id, text AS t, list_filter(string_split_regex(text, '[ \t\r\n]+'), lambda x: x <> '') AS w,
    list_filter(string_split_regex(text, '[\r\n]+'), lambda x: length(trim(x, ' ')) > 0) AS l FROM documents
)
SELECT doc_id, coalesce(len(w), 0)::INTEGER AS word_count,
  round(length(array_to_string(w, '')) / nullif(len(w), 0), 6) AS mean_word_length,
  round(length(regexp_replace(t, '[\p{L}\p{N} \t\r\n]', '', 'g')) / nullif(length(t), 0), 6) AS symbol_ratio,
  round(len(list_filter(l, lambda x: regexp_matches(trim(x, ' '), '[.!?:;]$'))) / nullif(len(l), 0), 6) AS punctuated_lines,
  round(len(list_filter(w, lambda x: lower(regexp_replace(x, '[^\p{L}]', '', 'g')) IN (@COMMON))) / nullif(len(w), 0), 6) AS common_words
FROM w"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _CANONICAL + "SELECT first_id AS entry_id_a, entry_id AS entry_id_b FROM grouped WHERE entry_id <> first_id",
        "p1_collapsed": _CANONICAL + "SELECT first_id, count(*) AS n_copies FROM grouped GROUP BY first_id",
        "p1_collisions": _CANONICAL + "SELECT md5(k) AS digest, count(DISTINCT k) AS n_texts FROM grouped GROUP BY md5(k) HAVING count(DISTINCT k) > 1",
        "p9_statistics": _STATISTICS.replace("@COMMON", ", ".join(f"'{w}'" for w in sorted(quality.COMMON))),
        "p2_counts": _VALUES + "SELECT field_kind, item, k AS exact_count, n::BIGINT AS n, true AS within FROM t WHERE k * 200 >= n",
        "p2_found": _VALUES + "SELECT field_kind, item FROM t WHERE k * 200 >= n",
    }
