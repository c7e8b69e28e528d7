"""Schemas that drift between the batches of a feed: a report of every change, and one table over all shapes.

A record is flattened to its field paths. Its shape, the paths with their types, is one of few, so a record travels as the
number of its shape with 32-bit hashes of its values, and shapes are kept once. Per batch, the fields that enough records
hold form a schema tree.

Consecutive trees of a feed are compared by the edit distance of unordered labelled trees with subtree moves. Deleting or
inserting a node costs one, retyping it in place costs one; renaming a subtree under its parent or moving it to another costs
one and what of the two subtrees does not carry over. A node keeps its place at no cost. A subtree may only be mapped onto
one that holds, for the same record key, what the old one held, or, where the batches share no keys, one of like name, type
and form. The cheapest script is found exactly among the admissible mappings (``edit_script``), of any number.

The evidence is linear in the records: which shapes meet under one key is counted per pair of shapes, and agreement per key
and value, so no pairs of fields are formed for a record.

Scripts of a feed chain into lineages, and lineages compile into a projection per batch that brings each record to the
fields' first names and types. Nothing of a record is dropped on the way: what does not fit its field's first type stays as
it came, in JSON.

Defined cases: null, cut-off and non-object payloads are unreadable and do not count; repeated rows count once; null
values and empty batches hold no field; a batch is compared with the previous one of its feed that has readable records;
null feeds and batch numbers are a feed and a batch of their own; ties between types go to the alphabetically first; long
payloads are parsed whole.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache
from typing import Any

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.session import cut

MIN_SHARE = 0.2
MIN_AGREEMENT = 0.5
OUTSIDE = ("url", "statusCode")
#: Names under which header and metadata maps are known, in lower case without separators.
MAP_NAMES = ("headers", "httpheaders", "responseheaders", "metadata", "meta", "metatags")
#: Keys by which a map shows under any other name.
HEADER_KEYS = ("server", "etag", "age", "vary", "link", "set-cookie", "last-modified", "content-language", "content-type", "cache-control", "x-powered-by", "date", "expires")
METADATA_KEYS = ("title", "description", "keywords", "generator", "robots", "viewport", "author", "canonical")

#: Agreement asked for where only names and forms can be compared, and keys that a pair of batches must share to be compared by values.
MIN_LIKENESS = 0.6
MIN_SHARED = 5

PARSED = "raw_id bigint, feed_id string, batch_no int, digest bigint, url string, shape bigint, marks array<int>, values array<int>, paths array<string>, kinds array<string>"
CHANGES = "array<struct<change_kind:string,field_path:string,new_path:string>>"


@lru_cache(maxsize=50_000)
def _named_map(name: str) -> bool:
    return name.lower().replace("_", "").replace("-", "") in MAP_NAMES


@lru_cache(maxsize=50_000)
def _map_key(key: str) -> tuple[bool, bool]:
    """Whether a key is a header's name, and whether it is one of metadata."""
    low = key.lower()
    return low in HEADER_KEYS or low.startswith("x-"), low in METADATA_KEYS or ":" in key


def is_map(name: str, value: dict[str, Any]) -> bool:
    """Whether an object's keys are data: by its name, or by keys that are header or metadata names."""
    for v in value.values():
        if isinstance(v, dict):
            return False
    if _named_map(name):
        return True
    if len(value) < 2:
        return False
    known = [_map_key(k) for k in value]
    return sum(h for h, _ in known) * 2 > len(value) or all(m for _, m in known)


_KINDS = {bool: "boolean", int: "number", float: "number", str: "string", list: "array", dict: "object"}


def kind_of(v: Any) -> str:
    return _KINDS[type(v)] if v is not None else "object"


def _most(kinds: list[str]) -> str:
    if len(set(kinds)) == 1:
        return kinds[0]
    return min(Counter(kinds).items(), key=lambda x: (-x[1], x[0]))[0]


def _digest(v: Any) -> int:
    if isinstance(v, str):
        h = xxhash.xxh32_intdigest(("s" + v).encode("utf-8", "replace"))
    elif isinstance(v, (dict, list)):
        # Flat containers are told by their plain form, in which members have an order.
        deep = any(isinstance(x, dict) for x in (v.values() if isinstance(v, dict) else v))
        flat = json.dumps(v, sort_keys=True) if deep else repr(sorted(v.items())) if isinstance(v, dict) else repr(v)
        h = xxhash.xxh32_intdigest(flat.encode("utf-8", "replace"))
    else:
        h = xxhash.xxh32_intdigest(f"n{v}")
    return h - (1 << 31)


def flatten(record: dict[str, Any]) -> dict[str, tuple[str, int | None]]:
    """path -> kind and value hash of every non-null field; plain objects have no hash of their own."""
    out: dict[str, tuple[str, int | None]] = {}

    def members(path: str, values: list[Any]) -> None:
        values = [v for v in values if v is not None]
        if not values:
            return
        out[path] = (_most([kind_of(v) for v in values]), None)
        lists = [x for v in values if isinstance(v, list) for x in v]
        if lists:
            members(path + "[]", lists)
        for v in values:
            if isinstance(v, dict):
                for k, x in v.items():
                    walk(x, f"{path}.{k}", k)

    def walk(v: Any, path: str, name: str) -> None:
        if v is None:
            return
        if isinstance(v, dict):
            if is_map(name, v):
                out[path] = ("object", _digest(v))
                members(path + ".*", list(v.values()))
            else:
                out.setdefault(path, ("object", None))
                for k, x in v.items():
                    walk(x, f"{path}.{k}", k)
        elif isinstance(v, list):
            out[path] = ("array", _digest(v))
            members(path + "[]", v)
        else:
            out[path] = (kind_of(v), _digest(v))

    for k, x in record.items():
        if k not in OUTSIDE:
            walk(x, k, k)
    return out


@lru_cache(maxsize=20_000)
def _shape_of(fields: tuple[tuple[str, str], ...]) -> int:
    h = xxhash.xxh64_intdigest("\0".join(f"{k}\1{v}" for k, v in sorted(fields)).encode("utf-8", "replace"))
    return h - (1 << 64) if h >> 63 else h


@lru_cache(maxsize=50_000)
def mark(path: str) -> int:
    """A path as 32 bits; within a pair of batches a clash would only mix the evidence of two fields."""
    return xxhash.xxh32_intdigest(path.encode("utf-8", "replace")) - (1 << 31)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep: list[int] = []
        urls: list[str | None] = []
        digests: list[int] = []
        shapes: list[int] = []
        ends, marks, values = [0], [], []
        paths: list[list[str] | None] = []
        kinds: list[list[str] | None] = []
        seen: set[int] = set()
        for i, text in enumerate(b.column(3).to_pylist()):
            try:
                record = json.loads(text) if text else None
            except (ValueError, RecursionError):
                record = None
            if not isinstance(record, dict):
                continue
            keep.append(i)
            urls.append(record["url"] if isinstance(record.get("url"), str) else None)
            h = xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))
            digests.append(h - (1 << 64) if h >> 63 else h)
            fields = flatten(record)
            shape = _shape_of(tuple([(p, k) for p, (k, _) in fields.items()]))
            shapes.append(shape)
            # A shape is told once a batch of rows, by the first record that has it.
            fresh = shape not in seen
            seen.add(shape)
            paths.append(list(fields) if fresh else None)
            kinds.append([k for k, _ in fields.values()] if fresh else None)
            for path, (_, v) in fields.items():
                if v is not None:
                    marks.append(mark(path))
                    values.append(v)
            ends.append(len(marks))
        own = b.take(pa.array(keep, pa.int64()))
        at = pa.array(ends, pa.int32())
        cols = [own.column(0), own.column(1), own.column(2), pa.array(digests, pa.int64()), pa.array(urls, pa.string()), pa.array(shapes, pa.int64())]
        cols += [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (marks, values)] + [pa.array(x, pa.list_(pa.string())) for x in (paths, kinds)]
        yield pa.RecordBatch.from_arrays(cols, ["raw_id", "feed_id", "batch_no", "digest", "url", "shape", "marks", "values", "paths", "kinds"])


def parsed(batches: DataFrame) -> DataFrame:
    """The readable records of raw_id, feed_id, batch_no, payload by shape and values; repeated rows are still repeated."""
    rows = batches.select("raw_id", "feed_id", F.col("batch_no").cast("int").alias("batch_no"), "payload").where("payload is not null")
    return rows.mapInArrow(_parse, PARSED)


def schemas(records: DataFrame) -> DataFrame:
    """feed_id, batch_no, n, fields: map of path to type of the fields that at least MIN_SHARE of a batch's records hold."""
    once = records.select("feed_id", "batch_no", "raw_id", "digest", "shape").distinct()
    counts = once.groupBy("feed_id", "batch_no", "shape").agg(F.count(F.lit(1)).alias("k"))
    shapes = records.where("paths is not null").groupBy("shape").agg(F.first("paths").alias("paths"), F.first("kinds").alias("kinds"))
    n = counts.groupBy("feed_id", "batch_no").agg(F.sum("k").alias("n"))
    held = counts.join(shapes, "shape").select("feed_id", "batch_no", "k", F.explode(F.arrays_zip("paths", "kinds")).alias("f"))
    held = held.groupBy("feed_id", "batch_no", "f.paths", "f.kinds").agg(F.sum("k").alias("k")).withColumnsRenamed({"paths": "path", "kinds": "kind"})
    # The most frequent type, ties to the alphabetically first.
    per = held.groupBy("feed_id", "batch_no", "path").agg(F.sum("k").alias("k"), F.min(F.struct((-F.col("k")).alias("k"), "kind"))["kind"].alias("kind"))
    tree = per.groupBy("feed_id", "batch_no").agg(F.collect_list(F.struct("path", "kind", "k")).alias("f"))
    both = n.withColumnsRenamed({"feed_id": "_f", "batch_no": "_b"}).join(tree, F.col("_f").eqNullSafe(F.col("feed_id")) & F.col("_b").eqNullSafe(F.col("batch_no")), "left")
    enough = F.filter("f", lambda x: x["k"] + 1e-9 >= F.col("n") * MIN_SHARE)
    fields = F.map_from_entries(F.transform(enough, lambda x: F.struct(x["path"], x["kind"])))
    # A batch whose records share no field still takes its place in the sequence.
    return both.select(F.col("_f").alias("feed_id"), F.col("_b").alias("batch_no"), "n", F.coalesce(fields, F.create_map().cast("map<string,string>")).alias("fields"))


def pairs(trees: DataFrame) -> DataFrame:
    """Each batch with the tree before it: feed_id, batch_no, before_no, before, fields. One row per batch is sorted."""
    w = Window.partitionBy("feed_id").orderBy("batch_no")
    both = trees.select("feed_id", "batch_no", F.lag("batch_no").over(w).alias("before_no"), F.lag("fields").over(w).alias("before"), "fields")
    return both.where("before_no is not null")


def evidence(records: DataFrame, both: DataFrame) -> DataFrame:
    """feed_id, at, met, agreed, spread for the batches in which fields left and entered, by marks of paths.

    met: which left fields and which entered ones were held for the same key, with the number of keys. agreed: left and
    entered fields that hold equal values for a key, with the number of keys. spread: how many values a left field has, about.

    Only values of fields that left or entered travel. Records meet the changes of their batch in a join with two rows per
    batch on one side, so a hot batch can be split; after that everything is grouped by key.
    """
    gone, come = F.array_except(F.map_keys("before"), F.map_keys("fields")), F.array_except(F.map_keys("fields"), F.map_keys("before"))
    hashed = F.udf(lambda ps: [mark(p) for p in ps], "array<int>", useArrow=True)
    moved = both.select("feed_id", "batch_no", "before_no", gone.alias("gone"), come.alias("come")).where("size(gone) > 0 and size(come) > 0")
    moved = moved.select("feed_id", "batch_no", "before_no", hashed("gone").alias("gone"), hashed("come").alias("come"))
    sides = F.array(F.struct(F.col("before_no").alias("no"), F.lit(False).alias("late"), F.col("gone").alias("want")), F.struct(F.col("batch_no").alias("no"), F.lit(True).alias("late"), F.col("come").alias("want")))
    want = moved.select(F.col("feed_id").alias("_f"), F.col("batch_no").alias("at"), F.explode(sides).alias("s")).select("_f", "at", "s.*")
    rows = records.where("url is not null").select("feed_id", "batch_no", "raw_id", "url", "marks", "values")
    hit = rows.join(want, F.col("feed_id").eqNullSafe(F.col("_f")) & F.col("batch_no").eqNullSafe(F.col("no")))
    kept = F.filter(F.arrays_zip("marks", "values"), lambda e: F.array_contains(F.col("want"), e["marks"]))
    hit = hit.select("feed_id", "at", "late", "url", "raw_id", F.transform(kept, lambda e: e["marks"]).alias("marks"), F.transform(kept, lambda e: e["values"]).alias("values"))
    # Of several records of a key in a batch the last one counts.
    newest = lambda late: F.max_by(F.when(F.col("late") == late, F.struct("marks", "values")), F.when(F.col("late") == late, F.col("raw_id")))
    met = hit.groupBy("feed_id", "at", "url").agg(newest(False).alias("a"), newest(True).alias("b")).where("a is not null and b is not null")
    # Read three times below.
    met = cut(met)
    held = met.groupBy("feed_id", "at", F.array_sort("a.marks").alias("gone"), F.array_sort("b.marks").alias("come")).agg(F.count(F.lit(1)).alias("k"))
    held = held.groupBy("feed_id", "at").agg(F.collect_list(F.struct("gone", "come", "k")).alias("met"))
    each = F.array(F.struct(F.lit(False).alias("late"), F.col("a").alias("r")), F.struct(F.lit(True).alias("late"), F.col("b").alias("r")))
    flat = met.select("feed_id", "at", "url", F.explode(each).alias("x")).select("feed_id", "at", "url", "x.late", F.explode(F.arrays_zip("x.r.marks", "x.r.values")).alias("e"))
    flat = flat.select("feed_id", "at", "url", "late", F.col("e.marks").alias("mark"), F.col("e.values").alias("value"))
    equal = flat.groupBy("feed_id", "at", "url", "value").agg(F.collect_set(F.when(~F.col("late"), F.col("mark"))).alias("old"), F.collect_set(F.when(F.col("late"), F.col("mark"))).alias("new")).where("size(old) > 0 and size(new) > 0")
    agreed = equal.select("feed_id", "at", F.explode("old").alias("old"), "new").select("feed_id", "at", "old", F.explode("new").alias("new")).groupBy("feed_id", "at", "old", "new").agg(F.count(F.lit(1)).alias("agree"))
    agreed = agreed.groupBy("feed_id", "at").agg(F.collect_list(F.struct("old", "new", "agree")).alias("agreed"))
    spread = flat.where("not late").groupBy("feed_id", "at", "mark").agg(F.approx_count_distinct("value").alias("k"))
    spread = spread.groupBy("feed_id", "at").agg(F.collect_list(F.struct("mark", "k")).alias("spread"))

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        r = right.withColumnsRenamed({"feed_id": "_f", "at": "_at"})
        return left.join(r, left["feed_id"].eqNullSafe(r["_f"]) & (left["at"] == r["_at"]), "left").drop("_f", "_at")

    return beside(beside(held, agreed), spread)


def _under(path: str, root: str) -> bool:
    return path.startswith(root) and path[len(root) : len(root) + 1] in (".", "[")


def _parents(path: str) -> list[str]:
    """The ancestors of a path, nearest first."""
    out = []
    while True:
        cut_at = max(path.rfind("."), len(path) - 2 if path.endswith("[]") else -1)
        if cut_at <= 0:
            return out
        path = path[:cut_at]
        out.append(path)


def _bits(m: int) -> Iterator[int]:
    while m:
        yield (m & -m).bit_length() - 1
        m &= m - 1


def _best(options: list[tuple], clashing: list[int]) -> list[tuple]:
    """The options, best first, that save most together without a clash; ties go to the earlier. Sets are bits of a number.

    Parts of the clash graph that do not touch are searched one by one; a search ends where cliques of what is left show
    that it cannot save more. No number of options changes the method.
    """

    def parts(m: int) -> list[int]:
        out = []
        while m:
            part, new = 0, m & -m
            while new:
                part |= new
                near = 0
                for i in _bits(new):
                    near |= clashing[i]
                new = near & m & ~part
            out.append(part)
            m &= ~part
        return out

    def most(m: int) -> float:
        """No less than what m can save: prices of cliques, of which each option is paid for by those it is in."""
        left = {i: options[i][0] for i in _bits(m)}
        total = 0.0
        while left:
            i = min(left, key=left.__getitem__)
            clique, price = [i], left[i]
            near = clashing[i]
            for k in sorted((k for k in left if near >> k & 1), key=left.__getitem__, reverse=True):
                if near >> k & 1:
                    clique.append(k)
                    near &= clashing[k]
            total += price
            for k in clique:
                left[k] -= price
                if left[k] <= 1e-12:
                    del left[k]
        return total + 1e-9

    @cache
    def one(part: int) -> tuple[float, int]:
        top, picked, rest = 0.0, 0, part
        while rest and most(rest) > top:
            i = next(_bits(rest))
            rest ^= 1 << i
            gain, others = best(rest & ~clashing[i])
            if gain + options[i][0] > top:
                top, picked = gain + options[i][0], others | 1 << i
            if len(parts(rest)) > 1:
                if most(rest) > top:
                    gain, others = best(rest)
                    if gain > top:
                        top, picked = gain, others
                break
        return top, picked

    def best(m: int) -> tuple[float, int]:
        found = [one(p) for p in parts(m)]
        return sum(g for g, _ in found), sum(c for _, c in found)

    return [options[i] for i in _bits(best((1 << len(options)) - 1)[1])]


def _likeness(r: str, a: str, before: dict[str, str], after: dict[str, str]) -> float:
    """How alike two subtrees are by name, type and form, for batches without common keys; 0 to 1."""
    words = lambda p: set(re.findall(r"[a-z]+|[A-Z][a-z]*|\d+", p.rsplit(".", 1)[-1].replace("[]", "")))
    x, y = ({w.lower() for w in words(p)} for p in (r, a))
    name = len(x & y) / max(1, min(len(x), len(y))) if x and y else 0.0
    form_r = {p[len(r) :] + k for p, k in before.items() if _under(p, r)}
    form_a = {p[len(a) :] + k for p, k in after.items() if _under(p, a)}
    if not form_r and not form_a:
        return name if name and r.rsplit(".", 1)[0] == a.rsplit(".", 1)[0] or r.rsplit(".", 1)[-1] == a.rsplit(".", 1)[-1] else 0.0
    return 0.5 * name + 0.5 * len(form_r & form_a) / max(1, len(form_r | form_a))


def edit_script(before: dict[str, str], after: dict[str, str], seen: dict[tuple[str, str], tuple[int, int, int]]) -> list[tuple[str, str, str]]:
    """The cheapest script from one schema tree to the next as (kind, path, new path).

    Kinds are removed, added, retyped, renamed (under the same parent, itself mapped or not) and moved (to another).
    """
    retyped = [p for p in before if p in after and before[p] != after[p]]
    retyped = [p for p in retyped if not any(q in retyped for q in _parents(p))]
    inside = lambda p: any(_under(p, r) for r in retyped)
    gone = sorted(p for p in before if p not in after and not inside(p))
    come = sorted(p for p in after if p not in before and not inside(p))
    shared = max((h for h, _, _ in seen.values()), default=0)
    under_gone = {r: [p for p in gone if p == r or _under(p, r)] for r in gone}
    under_come = {a: {p for p in come if p == a or _under(p, a)} for a in come}

    def carried(r: str, a: str) -> tuple[float, int]:
        """How surely a holds what r held, and the nodes that carry over."""
        same = [p for p in under_gone[r] if a + p[len(r) :] in under_come[a]]
        if shared < MIN_SHARED:
            alike = _likeness(r, a, before, after)
            return (1.0 if alike >= MIN_LIKENESS else 0.0), len(same)
        held = agree = values = 0
        for p in same:
            h, g, v = seen.get((p, a + p[len(r) :]), (0, 0, 0))
            held, agree, values = held + h, agree + g, max(values, v)
        if not held:
            return 0.0, 0
        chance = min(0.5, 1 / max(values, 1))
        return (agree / held - chance) / (1 - chance), len(same)

    options = []
    for r in gone:
        for a in come:
            if before[r] == after[a]:
                sure, nodes = carried(r, a)
                if sure >= MIN_AGREEMENT:
                    size = len(under_gone[r]) + len(under_come[a])
                    # Deleting and inserting both subtrees costs size; mapping costs one and what does not carry over.
                    saving = 2 * nodes - 1 - 2 * nodes * (1 - sure)
                    options.append((saving, -size, r, a))
    options = sorted((o for o in options if o[0] > 0), key=lambda o: (-o[0], o[1], o[2], o[3]))

    def clash(x: tuple, y: tuple) -> bool:
        """Whether two mappings exclude each other; a part may leave or join a subtree that is itself mapped."""
        for i, j in ((2, 3), (3, 2)):
            theirs = come if i == 2 else gone
            for big, part in ((x, y), (y, x)):
                if big[i] == part[i] or (_under(part[i], big[i]) and (_under(part[j], big[j]) or big[j] + part[i][len(big[i]) :] in theirs)):
                    return True
        return False

    chosen = _best(options, [sum(1 << j for j, y in enumerate(options) if j != i and clash(x, y)) for i, x in enumerate(options)])
    place = {r: a for _, _, r, a in chosen}

    def parent_after(r: str) -> str:
        """Where the parent of a left node is in the new tree."""
        up = _parents(r)
        if not up:
            return ""
        for q in up:
            if q in place:
                return place[q] + up[0][len(q) :]
        return up[0]

    out = [("retyped", p, "") for p in retyped]
    out += [("renamed" if (_parents(a) or [""])[0] == parent_after(r) else "moved", r, a) for r, a in place.items()]
    old, new = list(place), list(place.values())
    out += [("removed", p, "") for p in gone if p not in old and not any(_under(p, r) for r in old) and not any(q in gone for q in _parents(p))]
    out += [("added", p, "") for p in come if p not in new and not any(_under(p, a) for a in new) and not any(q in come for q in _parents(p))]
    return out


def distance(before: dict[str, str], after: dict[str, str], script: list[tuple[str, str, str]]) -> int:
    """What a script costs: one for each node added or removed, and for each subtree retyped, renamed or moved."""
    cost = 0
    for kind, p, n in script:
        if kind in ("added", "removed"):
            tree = after if kind == "added" else before
            cost += sum(q == p or _under(q, p) for q in tree)
        elif kind == "retyped":
            cost += 1
        else:
            a, b = {q[len(p) :] for q in before if q == p or _under(q, p)}, {q[len(n) :] for q in after if q == n or _under(q, n)}
            cost += 1 + len(a ^ b)
    return cost


def _seen(before: dict[str, str], after: dict[str, str], met: list, agreed: list, spread: list) -> dict[tuple[str, str], tuple[int, int, int]]:
    """For each left and entered path: keys that hold both, keys that hold equal values, distinct values of the left one."""
    gone = {mark(p): p for p in before if p not in after}
    come = {mark(p): p for p in after if p not in before}
    held: Counter[tuple[int, int]] = Counter()
    for m in met:
        for r in m["gone"]:
            for a in m["come"]:
                held[r, a] += m["k"]
    agree = {(x["old"], x["new"]): x["agree"] for x in agreed}
    values = {x["mark"]: x["k"] for x in spread}
    return {(gone[r], come[a]): (k, agree.get((r, a), 0), values.get(r, 1)) for (r, a), k in held.items() if r in gone and a in come}


def _scripts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        found = []
        for before, after, met, agreed, spread in zip(f["before"], f["fields"], f["met"], f["agreed"], f["spread"]):
            lists = [[] if x is None else x for x in (met, agreed, spread)]
            before, after = dict(before), dict(after)
            found.append([{"change_kind": k, "field_path": p, "new_path": n} for k, p, n in edit_script(before, after, _seen(before, after, *lists))])
        yield pd.DataFrame({"feed_id": f["feed_id"], "batch_no": f["batch_no"], "changes": found})


def _scripted(records: DataFrame, trees: DataFrame) -> DataFrame:
    both = pairs(trees)
    e = evidence(records, both)
    e = e.withColumnsRenamed({"feed_id": "_f", "at": "_at"})
    rows = both.join(e, both["feed_id"].eqNullSafe(e["_f"]) & (both["batch_no"] == e["_at"]), "left").select("feed_id", "batch_no", "before", "fields", "met", "agreed", "spread")
    return rows.mapInPandas(_scripts, f"feed_id string, batch_no int, changes {CHANGES}")


def scripts(batches: DataFrame) -> DataFrame:
    """feed_id, batch_no, changes: the edit script of each batch against the one before, with moves told from renames."""
    records = cut(parsed(batches))
    return _scripted(records, cut(schemas(records)))


def changes(batches: DataFrame) -> DataFrame:
    """feed_id, batch_no, change_kind, field_path, new_path; what moved to another parent is reported as renamed."""
    rows = scripts(batches).select("feed_id", "batch_no", F.explode("changes").alias("c")).select("feed_id", "batch_no", "c.*")
    return rows.withColumn("change_kind", F.when(F.col("change_kind") == "moved", "renamed").otherwise(F.col("change_kind")))


def _number(text: str) -> float | int | str:
    """The number that a text is; any other text as it is."""
    try:
        v = json.loads(text.strip())
    except ValueError:
        return text
    return v if isinstance(v, (int, float)) and not isinstance(v, bool) else text


def coerce(value: Any, kind: str, member: str | None) -> Any:
    """A value in the type that its field had first, where nothing is lost by it; else as it is.

    A list of one member stands for the member, a single value for a list of it, a text for the number it is, a number for
    its text, and an object of one field for its value in a list of values.
    """
    if kind != "array" and isinstance(value, list) and len(value) == 1:
        value = value[0]
    if kind == "array" and not isinstance(value, list) and value is not None:
        value = [x.strip() for x in value.split(",")] if isinstance(value, str) else [value]
    if kind == "number" and isinstance(value, str):
        value = _number(value)
    if kind == "string" and isinstance(value, (int, float)):
        value = json.dumps(value)
    if isinstance(value, list) and kind == "array" and member not in (None, "object"):
        value = [next(iter(v.values())) if isinstance(v, dict) and len(v) == 1 else v for v in value]
    if isinstance(value, list) and kind == "array" and member == "object":
        value = [v if isinstance(v, dict) or v is None else {"value": v} for v in value]
    return value


def lineages(scripted: DataFrame, trees: DataFrame) -> DataFrame:
    """feed_id, batch_no, lineage: each path that the feed has used so far with its first path and first type.

    Per feed the scripts are folded over the batches; what is folded are schemas, one a batch, whose size does not depend on
    how many records a batch has.
    """

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        known: dict[str, tuple[str, str]] = {}
        out = []
        rows = rows.sort_values("batch_no", na_position="first")
        for fields, changes in zip(rows["fields"], rows["changes"]):
            for c in changes if changes is not None else []:
                if c["change_kind"] in ("renamed", "moved"):
                    old, new = c["field_path"], c["new_path"]
                    known.update({new + p[len(old) :]: f for p, f in known.items() if p == old or _under(p, old)})
            for p, k in dict(fields).items():
                known.setdefault(p, (p, k))
            out.append([{"path": p, "first": f, "kind": k} for p, (f, k) in known.items()])
        return pd.DataFrame({"feed_id": rows["feed_id"], "batch_no": rows["batch_no"].astype("Int64"), "lineage": out})

    t = trees.withColumnsRenamed({"feed_id": "_f", "batch_no": "_b"})
    rows = t.join(scripted, t["_f"].eqNullSafe(scripted["feed_id"]) & t["_b"].eqNullSafe(scripted["batch_no"]), "left").select(F.col("_f").alias("feed_id"), F.col("_b").alias("batch_no"), "fields", "changes")
    return rows.groupBy("feed_id").applyInPandas(fold, "feed_id string, batch_no int, lineage array<struct<path:string,first:string,kind:string>>")


UNIFIED = "raw_id bigint, feed_id string, batch_no int, url string, status_code string, headers map<string,array<string>>, metadata map<string,array<string>>, page map<string,array<string>>, detection map<string,array<string>>"
SIDES = ("headers", "metadata", "page", "detection")


def _text(v: Any) -> str | None:
    return v if isinstance(v, str) or v is None else json.dumps(v, sort_keys=True)


def project(record: dict[str, Any], lineage: dict[str, tuple[str, str]]) -> dict[str, dict[str, list[str | None]]]:
    """A record in the first names and types of its fields: for each side, name -> texts.

    Several fields that come under one name keep all their values, in the order of the record.
    """
    out: dict[str, dict[str, list[str | None]]] = {k: {} for k in SIDES}

    def put(side: str, name: str, values: list[Any]) -> None:
        out[side].setdefault(name, []).extend(_text(v) for v in values)

    def walk(v: Any, path: str, name: str) -> None:
        first, kind = lineage.get(path, (path, kind_of(v)))
        last = first.rsplit(".", 1)[-1]
        if kind == "object" and isinstance(v, list) and v and all(isinstance(x, dict) and "key" in x and set(x) <= {"key", "val", "value"} for x in v):
            merged: dict[str, Any] = {}
            for x in v:
                merged.setdefault(x["key"], []).append(x.get("val", x.get("value")))
            v = {k: x if len(x) > 1 else x[0] for k, x in merged.items()}
        if isinstance(v, dict) and v and is_map(last, v):
            side = "metadata" if sum(k.lower() in METADATA_KEYS or ":" in k for k in v) * 2 > len(v) else "headers"
            for k, x in v.items():
                put(side, k, x if isinstance(x, list) else [x])
        elif isinstance(v, dict) and v:
            for k, x in v.items():
                walk(x, f"{path}.{k}", k)
        else:
            member = lineage.get(path + "[]", (None, None))[1]
            root, _, rest = first.partition(".")
            side = "detection" if root.lower().startswith(("detect", "result")) else "page"
            put(side, rest or root, [coerce(v, kind, member)])

    for k, v in record.items():
        if k not in OUTSIDE:
            walk(v, k, k)
    return out


def _unified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts = pa.map_(pa.string(), pa.list_(pa.string()))
    for b in batches:
        keep: list[int] = []
        urls: list[str | None] = []
        codes: list[str | None] = []
        sides: dict[str, list] = {k: [] for k in SIDES}
        lineages_of: dict[str, dict] = {}
        for i, (payload, lineage) in enumerate(zip(b.column(3).to_pylist(), b.column(4))):
            try:
                record = json.loads(payload)
            except (ValueError, RecursionError):
                continue
            if not isinstance(record, dict):
                continue
            key = f"{b.column(1)[i]}\0{b.column(2)[i]}"
            if key not in lineages_of:
                lineages_of[key] = {x["path"]: (x["first"], x["kind"]) for x in lineage.as_py() or []}
            keep.append(i)
            urls.append(_text(record.get("url")))
            codes.append(_text(record.get("statusCode")))
            for k, v in project(record, lineages_of[key]).items():
                sides[k].append(list(v.items()))
        own = b.take(pa.array(keep, pa.int64()))
        cols = [own.column(0), own.column(1), own.column(2), pa.array(urls, pa.string()), pa.array(codes, pa.string()), *[pa.array(sides[k], texts) for k in SIDES]]
        yield pa.RecordBatch.from_arrays(cols, ["raw_id", "feed_id", "batch_no", "url", "status_code", *SIDES])


def unified(batches: DataFrame) -> DataFrame:
    """One consistent table over all shapes: headers, metadata, page fields and detection fields under their first names.

    Every readable record is one row, repeated rows once, and every value of it is in the row.
    """
    records = cut(parsed(batches))
    trees = cut(schemas(records))
    lines = lineages(_scripted(records, trees), trees).withColumnsRenamed({"feed_id": "_f", "batch_no": "_b"})
    rows = batches.select("raw_id", "feed_id", F.col("batch_no").cast("int").alias("batch_no"), "payload").where("payload is not null")
    once = rows.groupBy("raw_id", "feed_id", "batch_no", F.md5("payload").alias("_h")).agg(F.first("payload").alias("payload"))
    on = F.col("feed_id").eqNullSafe(F.col("_f")) & F.col("batch_no").eqNullSafe(F.col("_b"))
    return once.join(lines, on, "left").select("raw_id", "feed_id", "batch_no", "payload", "lineage").mapInArrow(_unified, UNIFIED)
