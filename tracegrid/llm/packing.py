"""Items of varying length into containers of fixed capacity: vector bin packing with the dot-product heuristic.

Every item has a demand in three dimensions: tokens, segments (one each) and loss-bearing tokens. A container is filled
one item at a time: of the items that fit in all dimensions the one whose demand has the largest dot product with what is
left, both in units of the capacity, is next. Items of equal demand are interchangeable, so a step looks at distinct
demands, at most as many as there are sizes, and not at items.

Items are spread over shards by a hash of their id, each small enough for one task; a shard wastes room only in its last
containers. The emptiest containers of neighbouring shards are therefore opened and packed again in a second round.

An item above the capacity is cut: full parts fill containers of their own, the rest is an item. No other item is cut.

Defined cases: items of no tokens (null and empty texts) take no room and give no row; ties go to the larger item, then
the smaller id; repeated rows are items of their own; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrid.session import cut

ITEMS_PER_SHARD = 50_000
REOPENED = 32
NEIGHBOURS = 64
_OUT = "container_kind string, container_id long, doc_id long, part_no int, token_from long, n_tokens long, loss_tokens long, capacity long, segments long, most_loss long, reopen boolean"


def fill(tokens: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int]) -> np.ndarray:
    """The container number of each item; every item must fit an empty container. Items come in the order of preference."""
    if limits[0] == limits[2] and limits[1] >= limits[0] and np.array_equal(tokens, loss):
        return _fill_line(tokens, limits[0])
    caps = np.array(limits, float)
    sizes, which = np.unique(np.stack([tokens, loss], 1), axis=0, return_inverse=True)
    which = which.reshape(-1)
    order = np.argsort(which, kind="stable")
    ends = np.cumsum(np.bincount(which, minlength=len(sizes)))
    nxt, left = np.concatenate([[0], ends[:-1]]), np.diff(np.concatenate([[0], ends]))
    demand = np.concatenate([sizes[:, :1], np.ones((len(sizes), 1)), sizes[:, 1:]], 1).astype(float)
    unit = demand / caps
    out = np.zeros(len(tokens), np.int64)
    box, room, remaining = 0, caps.copy(), len(tokens)
    alive = np.arange(len(sizes))
    while remaining:
        if (left[alive] == 0).sum() * 4 > len(alive):
            alive = alive[left[alive] > 0]
        fits = (left[alive] > 0) & (demand[alive, 0] <= room[0]) & (demand[alive, 1] <= room[1]) & (demand[alive, 2] <= room[2])
        if not fits.any():
            box, room = box + 1, caps.copy()
            continue
        score = np.where(fits, unit[alive] @ (room / caps), -1.0)
        best = alive[len(score) - 1 - int(np.argmax(score[::-1]))]
        out[order[nxt[best]]] = box
        nxt[best] += 1
        left[best] -= 1
        room -= demand[best]
        remaining -= 1
    return out


def _fill_line(tokens: np.ndarray, capacity: int) -> np.ndarray:
    """The same containers where the three demands move together and the dot product only grows with the size.

    The best item is then the largest that fits, found in a chain that skips the sizes that are used up.
    """
    sizes, which = np.unique(tokens, return_inverse=True)
    order = np.argsort(which, kind="stable").tolist()
    left = np.bincount(which, minlength=len(sizes)).tolist()
    nxt = (np.cumsum([0, *left])[:-1]).tolist()
    # at[s + 1]: the place of the largest size not above s, 0 for none; below[p]: the next place down that is not used up.
    at = np.searchsorted(sizes, np.arange(capacity + 1), side="right").tolist()
    below = list(range(len(sizes) + 1))

    def live(p: int) -> int:
        root = p
        while below[root] != root:
            root = below[root]
        while below[p] != root:
            below[p], p = root, below[p]
        return root

    out = np.zeros(len(tokens), np.int64)
    box, room = 0, capacity
    widths = sizes.tolist()
    for _ in range(len(tokens)):
        p = live(at[room])
        if p == 0:
            box, room = box + 1, capacity
            p = live(at[room])
        out[order[nxt[p - 1]]] = box
        nxt[p - 1] += 1
        left[p - 1] -= 1
        room -= widths[p - 1]
        if left[p - 1] == 0:
            below[p] = p - 1
    return out


def _cut(rows: pd.DataFrame, limits: tuple[int, int, int]) -> pd.DataFrame:
    """Parts of the items: full parts of those above the capacity in tokens or in loss-bearing tokens, and the rests."""
    n = rows["n_tokens"].to_numpy(np.int64)
    borne = rows["loss_tokens"].to_numpy(np.int64)
    # The loss-bearing tokens come last in an item; a part may hold as many of them as the limit says.
    capacity = limits[0] if (borne <= limits[2]).all() else min(limits[0], limits[2])
    parts = -(-n // capacity)
    at = np.repeat(np.arange(len(rows)), parts)
    no = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
    size = np.minimum(capacity, n[at] - no * capacity)
    loss = np.clip(no * capacity + size - (n - borne)[at], 0, size)
    return pd.DataFrame({"doc_id": rows["doc_id"].to_numpy()[at], "part_no": no.astype(np.int32), "token_from": no * capacity, "n_tokens": size, "loss_tokens": loss})


def _pack(parts: pd.DataFrame, kind: str, limits: tuple[int, int, int], base: int, reopen: int) -> pd.DataFrame:
    parts = parts.sort_values(["n_tokens", "doc_id", "part_no"], ascending=[False, True, True]).reset_index(drop=True)
    box = fill(parts["n_tokens"].to_numpy(np.int64), parts["loss_tokens"].to_numpy(np.int64), limits)
    used = np.bincount(box, weights=parts["n_tokens"])
    emptiest = np.zeros(len(used), bool)
    if reopen:
        emptiest[np.argsort(used, kind="stable")[:reopen]] = True
        emptiest &= used < limits[0]
    return parts.assign(container_kind=kind, container_id=base + box, capacity=limits[0], segments=limits[1], most_loss=limits[2], reopen=emptiest[box])


def pack(items: DataFrame, kinds: DataFrame, n_items: int) -> DataFrame:
    """container_kind, container_id, doc_id, part_no, token_from, n_tokens, loss_tokens for each kind by itself.

    items: doc_id, n_tokens, loss_tokens. kinds: container_kind, capacity_tokens and, if given, segments and loss_tokens, the
    most segments and loss-bearing tokens of a container, by default as many as tokens; a table of any length. n_items: their
    number, which sets the number of shards.
    """
    shards = max(1, -(-n_items // ITEMS_PER_SHARD))
    own = set(kinds.columns)
    limits = [F.coalesce(F.col(c).cast("long"), F.col("capacity_tokens").cast("long")) if c in own else F.col("capacity_tokens").cast("long") for c in ("segments", "loss_tokens")]
    each = kinds.where("capacity_tokens > 0").groupBy("container_kind").agg(F.min(F.struct(F.col("capacity_tokens").cast("long").alias("capacity"), limits[0].alias("segments"), limits[1].alias("most_loss"))).alias("k")).select("container_kind", "k.*")
    demand = items.where("n_tokens > 0").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_tokens").cast("long").alias("n_tokens"), F.col("loss_tokens").cast("long").alias("loss_tokens"), F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"))
    # Every item meets every kind by definition: the kinds, one row each, come as a list that is told once.
    listed = each.agg(F.collect_list(F.struct("container_kind", "capacity", "segments", "most_loss"))).scalar()
    spread = demand.withColumn("k", F.explode(listed)).select("doc_id", "n_tokens", "loss_tokens", "shard", "k.*")
    by = ["container_kind", "capacity", "segments", "most_loss"]

    def first(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        kind, capacity, segments, loss, shard = key
        limits = (int(capacity), int(segments), int(loss))
        return _pack(_cut(rows, limits), kind, limits, int(shard) << 28, REOPENED if shards > 1 else 0)

    def second(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        kind, capacity, segments, loss, group = key
        limits = (int(capacity), int(segments), int(loss))
        return _pack(rows[["doc_id", "part_no", "token_from", "n_tokens", "loss_tokens"]], kind, limits, (1 << 62) + (int(group) << 28), 0)

    packed = spread.groupBy(*by, "shard").applyInPandas(first, _OUT)
    kept = packed
    if shards > 1:
        # Each shard is packed once: what it keeps and what is opened again are told apart in the table it wrote.
        packed = cut(packed)
        group = F.expr(f"(container_id >> 28) div {NEIGHBOURS}").alias("group")
        again = packed.where("reopen").groupBy(*by, group).applyInPandas(second, _OUT)
        kept = packed.where("not reopen").unionByName(again)
    return kept.select("container_kind", "container_id", "doc_id", "part_no", "token_from", "n_tokens", "loss_tokens")


def fill_report(packed: DataFrame, kinds: DataFrame) -> DataFrame:
    """Per kind: containers, the fewest that any packing needs, tokens, and the share of room in use.

    The bound is the largest of what tokens, segments and loss-bearing tokens need by themselves.
    """
    own = set(kinds.columns)
    caps = kinds.select("container_kind", F.col("capacity_tokens").alias("capacity"), *[(F.coalesce(F.col(c), F.col("capacity_tokens")) if c in own else F.col("capacity_tokens")).alias(f"most_{c}") for c in ("segments", "loss_tokens")])
    per = packed.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("parts"), F.sum("loss_tokens").alias("loss"))
    per = per.groupBy("container_kind").agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.sum("parts").alias("parts"), F.sum("loss").alias("loss"), F.max("used").alias("fullest"), F.max("parts").alias("most_parts"), F.max("loss").alias("most_loss"))
    rows = per.join(caps, "container_kind")
    bound = F.greatest(F.ceil(F.col("tokens") / F.col("capacity")), F.ceil(F.col("parts") / F.col("most_segments")), F.ceil(F.col("loss") / F.col("most_loss_tokens")))
    return rows.select("container_kind", "containers", bound.alias("least_containers"), "tokens", "fullest", "most_parts", "most_loss", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("share_used"))
