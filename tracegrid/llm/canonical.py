"""Duplicates hidden by formatting: canonicalise, hash to 128 bits, count copies with map-side combining.

Everything is a built-in expression, so canonicalising and hashing run inside code generation. A record travels through
the shuffle as a 16-byte digest, an independent 64-bit check, a length and an id; the text itself never does.

Defined cases
* null text: no canonical form, so it is nobody's copy (``collapse`` leaves it out, ``copies`` gives no row).
* empty or blank text, or punctuation alone: all of these share the empty canonical form and are copies of each other.
* very long text: canonicalised as a whole; the digest has the same size.
* ties: the smallest id of a group stands for it. Repeated rows with one id count as copies but give no pair (a, a).
* columns with clashing names: the id and the text are taken out under private names first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NOT_WORD = r"[^\p{L}\p{N}\p{M}]+"


def runs(text: Column) -> Column:
    """The runs of letters and digits of a text in lower case, one blank between them."""
    return F.trim(F.regexp_replace(F.lower(text), _NOT_WORD, " "))


def percent_decode(text: Column) -> Column:
    """Percent escapes as their characters; a percent sign that starts no escape stays one."""
    whole = F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(F.contains(text, F.lit("%")), F.coalesce(F.try_url_decode(whole), text)).otherwise(text)


def canonical_urls(df: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """_id and _k: one text for all spellings of an address; rows without an address are left out.

    Scheme, leading ``www.`` and the scheme's default port go; host, port, path and fragment become runs of letters and
    digits; query fields become runs each and are sorted, so that they compare as a multiset. The steps are projections
    of their own, so that no part is taken out more than once.
    """
    rows = df.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_u")).where(F.col("_u").isNotNull())
    rows = rows.select("_id", F.regexp_replace("_u", r"^(?:%(?:20|09|0[aAdD])|[^\p{L}\p{N}])+", "").alias("_u"))
    rows = rows.select(
        "_id",
        F.lower(F.regexp_extract("_u", r"^([A-Za-z][A-Za-z0-9+.-]*)\s*:\s*/\s*/", 1)).alias("_s"),
        F.regexp_replace("_u", r"^[A-Za-z][A-Za-z0-9+.-]*\s*:\s*/\s*/[^\p{L}\p{N}]*", "").alias("_u"),
    )
    rows = rows.select(
        "_id",
        "_s",
        F.regexp_extract("_u", r"^[^/?#]*", 0).alias("_a"),
        F.regexp_extract("_u", r"^[^/?#]*([^?#]*)", 1).alias("_p"),
        F.when(F.contains("_u", F.lit("?")), F.regexp_extract("_u", r"^[^?#]*\?([^#]*)", 1)).otherwise("").alias("_q"),
        F.when(F.contains("_u", F.lit("#")), F.regexp_extract("_u", r"^[^#]*#([\s\S]*)$", 1)).otherwise("").alias("_f"),
    )
    # Without a colon there is no port, and most addresses have none.
    port = F.when(F.contains("_a", F.lit(":")), F.regexp_extract("_a", r":\s*0*(\d+)[^\p{L}\p{N}]*$", 1)).otherwise("")
    host = F.when(F.contains("_a", F.lit(":")), F.regexp_replace("_a", r":\s*\d+[^\p{L}\p{N}]*$", "")).otherwise(F.col("_a"))
    rows = rows.select("_id", "_s", "_p", "_q", "_f", port.alias("_port"), F.regexp_replace(F.lower(percent_decode(host)), r"^www\s*\.", "").alias("_a"))
    kept = F.when(((F.col("_port") == "80") & F.col("_s").isin("http", "")) | ((F.col("_port") == "443") & (F.col("_s") == "https")), "").otherwise(F.col("_port"))
    fields = F.array_sort(F.filter(F.transform(F.split("_q", "&"), lambda x: runs(percent_decode(x))), lambda x: x != ""))
    query = F.when(F.col("_q") == "", "").otherwise(F.array_join(fields, "&"))
    parts = [runs(F.col("_a")), kept, runs(percent_decode(F.col("_p"))), query, F.when(F.col("_f") == "", "").otherwise(runs(percent_decode(F.col("_f"))))]
    return rows.select("_id", F.concat_ws("\u0001", *parts).alias("_k"))


def canonical_record(*fields: Column) -> Column:
    """One text for a record of several fields, whatever their order, case, white space and punctuation."""
    each = F.transform(F.array(*[x.cast("string") for x in fields]), lambda x: F.coalesce(runs(x), F.lit("\u0002")))
    return F.array_join(F.array_sort(each), "\u0001")


def digested(keys: DataFrame) -> DataFrame:
    """Columns _id, _h (128-bit digest), _c (64-bit check of its own) and _n (length) of a frame _id, _k."""
    return keys.where(F.col("_k").isNotNull()).select("_id", F.unhex(F.md5("_k")).alias("_h"), F.xxhash64(F.lit(1), "_k").alias("_c"), F.length("_k").alias("_n"))


def collapse(keys: DataFrame) -> DataFrame:
    """One row per record of a frame _id, _k: _h, _c, _n, the smallest id as first_id and the number of rows as n_copies.

    The check and the length are part of the grouping key, so two texts that share a digest stay apart; ``collisions``
    reports those. The count combines on the map side, so a text that makes up a third of the rows sends one row per task.
    """
    return digested(keys).groupBy("_h", "_c", "_n").agg(F.min("_id").alias("first_id"), F.count(F.lit(1)).alias("n_copies"))


def collisions(groups: DataFrame) -> DataFrame:
    """Digests shared by different texts, with the number of these; empty unless 128 bits failed."""
    return groups.groupBy("_h").agg(F.count(F.lit(1)).alias("n_texts")).where("n_texts > 1")


def copies(keys: DataFrame) -> DataFrame:
    """entry_id_a, entry_id_b: the first row of each group with every other row of it.

    Groups of one row, the bulk, leave before the join. The join has one row per group on one side, so a hot group is
    split by adaptive execution on the other side; nothing is collected per group.
    """
    groups = collapse(keys).where("n_copies > 1").select("_h", "_c", "_n", "first_id")
    return (
        digested(keys)
        .join(groups, ["_h", "_c", "_n"])
        .where(F.col("_id") != F.col("first_id"))
        .select(F.col("first_id").alias("entry_id_a"), F.col("_id").alias("entry_id_b"))
    )
