"""Nested records as flat child tables with Merkle identities.

The identity of a value is a 128-bit hash made bottom-up: of its text for an atom, of its members' identities for an
array, of name and identity of its non-null fields in name order for a struct, of its sorted entries for a map. Equal
objects have one identity wherever they occur, so their content is stored once (``nodes``) while every occurrence stays as
a row that names owner, path, parent and ordinal (``bridges``).

The Spark schema is compiled into two array expressions. The first annotates a record from the leaves up: each value becomes a
struct of its identity and its annotated children, bound once, so no subtree is hashed twice. The second walks the annotated
record and yields the rows. One scan, one explode, and a shuffle only to keep one of several rows that repeat an owner.

Paths name arrays and maps; a plain struct on the way adds no part, a list within a list adds ``[]`` and a map within a list
or map adds ``{}``. ``parent_key`` is '' at the top, the key of a map's entry for what lies in it, and the position of the
parent item for what lies in an item; further down these are joined by '.'. Positions start at 0 and count null members,
which themselves give no row. Containers may be nested in any way and to any depth.

Defined cases: null and empty containers at any level give no rows; rows of an owner that repeat in full count once, and
rows that differ under one owner id all count; rows without an id are kept once per content; empty tables give empty
tables; owner and root are taken under private names, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHILD = "array<struct<child_path:string,parent_key:string,item_no:int,parent_hash:binary,node_hash:binary,content:string>>"
JSON_DOC = "struct<signals:array<string>,headers:map<string,array<string>>,groups:array<struct<agents:array<string>,disallows:array<string>,crawl_delay:string>>>"


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def annotated(value: Column, kind: T.DataType, content: bool = False) -> Column:
    """A value as a struct of h (its identity as hexadecimal text, 'null' for a null), has (whether it is not null), c (its
    content, if wanted) and k, its annotated children: a list of items, of key and value, or a struct of fields."""
    some = value.isNotNull()
    text = [_content(value, kind).alias("c")] if content else []

    def made(own: Column, children: Column | None = None) -> Column:
        parts = [F.when(some, F.md5(own)).otherwise("null").alias("h"), some.alias("has"), *text]
        return F.struct(*parts, *([children.alias("k")] if children is not None else []))

    if isinstance(kind, T.ArrayType):
        items = F.transform(value, lambda x: annotated(x, kind.elementType, content))
        return _bound(items, lambda k: made(F.concat(F.lit("["), F.array_join(F.transform(k, lambda x: x["h"]), ",")), k))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].cast("string").alias("key"), annotated(e["value"], kind.valueType, content).alias("value")))
        named = lambda e: F.concat(F.md5(F.concat(F.lit(f"{kind.keyType.simpleString()}:"), e["key"])), F.lit(":"), e["value"]["h"])
        return _bound(entries, lambda k: made(F.concat(F.lit("<"), F.array_join(F.array_sort(F.transform(k, named)), ",")), k))
    if isinstance(kind, T.StructType) and kind.fields:
        fields = F.struct(*[annotated(value[f.name], f.dataType, content).alias(f"f{i}") for i, f in enumerate(kind.fields)])
        order = sorted(range(len(kind.fields)), key=lambda i: kind.fields[i].name)
        named_parts = lambda k: [F.when(k[f"f{i}"]["has"], F.concat(F.lit(f"{kind.fields[i].name}="), k[f"f{i}"]["h"])) for i in order]
        return _bound(fields, lambda k: made(F.concat(F.lit("{"), F.concat_ws(",", *named_parts(k))), k))
    return made(F.concat(F.lit(f"{kind.simpleString()}:"), value.cast("string")))


def identity(value: Column, kind: T.DataType) -> Column:
    """The Merkle identity of a value, as hexadecimal text; null has the identity 'null'."""
    return annotated(value, kind)["h"]


def _content(value: Column, kind: T.DataType) -> Column:
    return F.to_json(value) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else value.cast("string")


def _nested(kind: T.DataType) -> bool:
    """Whether a value can hold an array or a map."""
    if isinstance(kind, T.StructType):
        return any(isinstance(f.dataType, (T.ArrayType, T.MapType)) or _nested(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.ArrayType, T.MapType))


def _row(node: Column, path: str, key: Column, no: Column, parent: Column, content: bool) -> Column:
    """The row of an annotated child; null if the child is null."""
    text = node["c"] if content else F.lit(None).cast("string")
    return F.when(node["has"], F.struct(F.lit(path).alias("child_path"), key.alias("parent_key"), no.cast("int").alias("item_no"), F.unhex(parent).alias("parent_hash"), F.unhex(node["h"]).alias("node_hash"), text.alias("content")))


def _joined(arrays: list[Column]) -> Column:
    none = F.array().cast(CHILD)
    return F.coalesce(arrays[0], none) if len(arrays) == 1 else F.flatten(F.array(*[F.coalesce(a, none) for a in arrays]))


def _under(key: Column, part: Column) -> Column:
    return F.when(key == "", part).otherwise(F.concat_ws(".", key, part))


def _walk(node: Column, kind: T.DataType, path: str, key: Column, parent: Column, content: bool) -> list[Column]:
    """Arrays of rows below an annotated value that lies at a path, under a key and a parent."""
    if isinstance(kind, T.StructType):
        out = []
        for i, f in enumerate(kind.fields):
            if _nested(f.dataType):
                out += _walk(node["k"][f"f{i}"], f.dataType, f"{path}.{f.name}" if path else f.name, key, parent, content)
        return out
    if isinstance(kind, T.ArrayType):
        return _items(node["k"], kind.elementType, path, key, parent, content)
    if isinstance(kind, T.MapType):
        of = kind.valueType
        if isinstance(of, T.ArrayType):
            # A list in a map: its members stand under the key of the entry.
            each = lambda e: _joined(_items(e["value"]["k"], of.elementType, path, _under(key, e["key"]), parent, content))
            return [F.flatten(F.transform(node["k"], each))]
        out = [F.transform(node["k"], lambda e: _row(e["value"], path, _under(key, e["key"]), F.lit(0), parent, content))]
        if _nested(of):
            at = path + "{}" if isinstance(of, T.MapType) else path
            out.append(F.flatten(F.transform(node["k"], lambda e: _joined(_walk(e["value"], of, at, _under(key, e["key"]), e["value"]["h"], content)))))
        return out
    return []


def _items(items: Column, of: T.DataType, path: str, key: Column, parent: Column, content: bool) -> list[Column]:
    """Rows of the members of a list and of what lies in them."""
    out = [F.transform(items, lambda x, i: _row(x, path, key, i, parent, content))]
    if _nested(of):
        at = path + ("[]" if isinstance(of, T.ArrayType) else "{}" if isinstance(of, T.MapType) else "")
        out.append(F.flatten(F.transform(items, lambda x, i: _joined(_walk(x, of, at, _under(key, i.cast("string")), x["h"], content)))))
    return out


def bridges(df: DataFrame, owner_table: str, owner_id: Column, root: Column, content: bool = False, roots: bool = False) -> DataFrame:
    """owner_table, owner_id, child_path, parent_key, item_no, parent_hash, node_hash and, if wanted, content.

    roots: also a row with an empty path and no parent for each record itself.
    """
    rows = df.select(owner_id.alias("_owner"), root.alias("_root"))
    kind = rows.schema["_root"].dataType
    whole = annotated(F.col("_root"), kind, content)

    def flat(node: Column) -> Column:
        arrays = _walk(node, kind, "", F.lit(""), node["h"], content)
        if roots:
            arrays = [F.array(_row(node, "", F.lit(""), F.lit(0), F.lit(None).cast("string"), content)), *arrays]
        return F.struct(node["h"].alias("h"), F.array_compact(_joined(arrays)).alias("c"))

    rows = rows.select("_owner", _bound(whole, flat).alias("_a")).select("_owner", F.unhex(F.col("_a.h")).alias("_rh"), F.col("_a.c").alias("_c"))
    once = rows.groupBy("_owner", "_rh").agg(F.first("_c").alias("_c"))
    out = once.select(F.lit(owner_table).alias("owner_table"), F.col("_owner").alias("owner_id"), F.explode("_c").alias("_x"))
    # Identities travel as 16 bytes and become text at the end.
    hashes = [F.lower(F.hex(F.col(f"_x.{c}"))).alias(c) for c in ("parent_hash", "node_hash")]
    return out.select("owner_table", "owner_id", "_x.child_path", "_x.parent_key", "_x.item_no", *hashes, *(["_x.content"] if content else []))


def nodes(with_content: DataFrame) -> DataFrame:
    """node_hash, content, n_occurrences: each distinct object once."""
    return with_content.groupBy("node_hash").agg(F.first("content").alias("content"), F.count(F.lit(1)).alias("n_occurrences"))


def _text(x: Column) -> Column:
    """A variant as text; null for a null."""
    return F.when(x.isNotNull() & ~F.is_variant_null(x), F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x)))


def _members(v: Column, path: str) -> Column:
    """The members of a list, or the single member that stands in its place; null for a missing or null key."""
    own = F.try_variant_get(v, path, "variant")
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.when(own.isNotNull() & ~F.is_variant_null(own), F.array(own)))


def unwrapped(text: Column) -> Column:
    """A JSON document as a variant, also where it is stored once more as a JSON string; null if it cannot be read."""
    outer = F.try_parse_json(text)
    return F.coalesce(F.try_parse_json(F.when(F.schema_of_variant(outer) == "STRING", F.try_variant_get(outer, "$", "string"))), outer)


def robots_document(text: Column) -> Column:
    """A stored robots analysis as a struct of lists; unreadable ones null."""
    doc = unwrapped(text)
    headers = F.transform_values(F.try_variant_get(doc, "$.headers", "map<string,variant>"), lambda _, x: F.transform(_members(x, "$"), _text))
    groups = F.transform(
        _members(doc, "$.robots.groups"),
        lambda g: F.when(
            g.isNotNull() & ~F.is_variant_null(g),
            F.struct(
                F.transform(_members(g, "$.userAgents"), _text).alias("agents"),
                F.transform(_members(g, "$.disallows"), _text).alias("disallows"),
                _text(F.try_variant_get(g, "$.crawlDelay", "variant")).alias("crawl_delay"),
            ),
        ),
    )
    return F.when(doc.isNotNull(), F.struct(F.transform(_members(doc, "$.signals"), _text).alias("signals"), headers.alias("headers"), groups.alias("groups")))
