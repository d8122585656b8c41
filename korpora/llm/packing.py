"""Filling containers of a fixed capacity with texts of varying length.

Large-item matching over the histogram of sizes: items above a third of the
capacity pair at most twice per container (each takes the largest partner that
fits), smaller items go to the fullest container that still has room. All items
of one size are alike, so the plan is made for sizes with counts; it has at
most a few entries per size and its size depends on the capacity, never on the
number of items. Items then find their container by their rank among the items
of their size; ranks come from counts per bucket of a size and their prefix
sums, so a size that many items share is numbered in parallel.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Items of one size that one task numbers.
BUCKET_ROWS = 250_000
#: Profiles that one call packs for.
MAX_PROFILES = 100


class _Bins:
    """Groups of equal containers, found by the room that is left in them."""

    def __init__(self):
        self.by_room: dict[int, list[tuple[int, tuple]]] = {}
        self.rooms: list[int] = []

    def add(self, room: int, count: int, content: tuple) -> None:
        if count <= 0:
            return
        if room not in self.by_room:
            self.by_room[room] = []
            self.rooms.insert(bisect_left(self.rooms, room), room)
        self.by_room[room].append((count, content))

    def tightest(self, size: int) -> tuple[int, int, tuple] | None:
        at = bisect_left(self.rooms, size)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        count, content = self.by_room[room].pop()
        if not self.by_room[room]:
            del self.by_room[room], self.rooms[at]
        return room, count, content


def plan_containers(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple]]:
    """[(number of containers, ((size, items of it in each), ...)), ...] for item counts by size (1 to capacity)."""
    left = {s: n for s, n in counts.items() if n > 0}
    if any(s < 1 or s > capacity for s in left):
        raise ValueError("sizes must lie between 1 and the capacity")
    bins = _Bins()
    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        a = large[-1]
        at = bisect_right(large, capacity - a) - 1
        if at < 0:
            n = left[a]
            bins.add(capacity - a, n, ((a, 1),))
        elif large[at] == a and left[a] > 1:
            n = left[a] - left[a] % 2
            bins.add(capacity - 2 * a, n // 2, ((a, 2),))
        else:
            at -= large[at] == a  # a single item of its size takes the next smaller one
            b = large[at] if at >= 0 else 0
            n = min(left[a], left[b]) if b else left[a]
            bins.add(capacity - a - b, n, ((a, 1), (b, 1)) if b else ((a, 1),))
            if b:
                left[b] -= n
                if not left[b]:
                    del large[at]
        left[a] -= n
        if not left[a]:
            large.remove(a)
    for size in sorted((s for s in left if 3 * s <= capacity and left[s]), reverse=True):
        n = left[size]
        while n:
            found = bins.tightest(size)
            room, count, content = found if found else (capacity, -(-n // (capacity // size)), ())
            each = room // size
            full = min(count, n // each)
            bins.add(room - each * size, full, content + ((size, each),))
            n -= full * each
            rest = count - full
            if rest and n:  # fewer than a container takes
                bins.add(room - n * size, 1, content + ((size, n),))
                n, rest = 0, rest - 1
            if found:
                bins.add(room, rest, content)
    return [group for groups in bins.by_room.values() for group in groups]


class _Lookup:
    """Containers by (slot, rank): slots are (profile, size), ranks from 0."""

    def __init__(self, histograms: dict[str, tuple[int, dict[int, int]]]):
        self.offset: dict[tuple[str, int], int] = {}
        starts, each, base, total = [], [], [], 0
        for profile in sorted(histograms):
            capacity, counts = histograms[profile]
            taken = {}
            for size in sorted(counts):
                self.offset[profile, size] = taken[size] = total
                total += counts[size]
            container = 0
            for n, content in plan_containers(counts, capacity):
                for size, k in content:
                    starts.append(taken[size])
                    each.append(k)
                    base.append(container)
                    taken[size] += n * k
                container += n
        order = np.argsort(np.array(starts, np.int64), kind="stable")
        self.starts, self.each, self.base = (np.array(x, np.int64)[order] for x in (starts, each, base))


def profile_list(profiles: DataFrame) -> list[tuple[str, int]]:
    """The distinct profiles (profile, capacity) with a positive capacity; at most MAX_PROFILES, as every item is packed once for each."""
    found = profiles.where("capacity > 0").select("profile", F.col("capacity").cast("int")).distinct().orderBy("profile", "capacity").limit(MAX_PROFILES + 1).collect()
    if len(found) > MAX_PROFILES:
        raise ValueError(f"more than {MAX_PROFILES} profiles")
    return [tuple(r) for r in found]


def pieces_of(sizes: DataFrame, profiles: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(profile, capacity, id, piece_no, start_token, n_tokens): each text, split only where it alone exceeds a container."""
    known = profile_list(profiles)
    each = F.array(*[F.struct(F.lit(p).cast("string").alias("profile"), F.lit(c).alias("capacity")) for p, c in known]) if known else F.array().cast("array<struct<profile: string, capacity: int>>")
    n, c = F.col("n_tokens"), F.col("capacity")
    starts = F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / c), F.lit(0)).cast("int"))
    return (
        sizes.select(id_col, "n_tokens", F.explode(each).alias("_p")).select("_p.profile", "_p.capacity", id_col, "n_tokens")
        .select("profile", "capacity", id_col, "n_tokens", F.explode(starts).alias("piece_no"))
        .withColumn("start_token", F.col("piece_no") * c)
        .withColumn("n_tokens", F.least(c, n - F.col("start_token")))
    )


def pack(sizes: DataFrame, profiles: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(profile, container_id, id, piece_no, start_token, n_tokens).

    ``sizes`` has (id, n_tokens), ``profiles`` a few rows (profile, capacity);
    profiles without a positive capacity are left out. Every row of ``sizes``
    comes out once per profile and piece, repeated rows and null ids as often as
    they occur. A text longer than a container is cut into full containers and
    a rest, which is packed like any other item. A text without tokens (also a
    null ``n_tokens``) needs no room: one row with a null ``container_id``.
    Read ``sizes`` from a stored table, as it is used twice.
    """
    sizes = sizes.select(id_col, F.coalesce("n_tokens", F.lit(0)).cast("int").alias("n_tokens"))
    items = pieces_of(sizes, profiles, id_col)
    placed = items.where("n_tokens > 0")
    # At most one row per size up to the capacity: bounded by the profiles, whatever the data.
    rows = placed.groupBy("profile", "capacity", "n_tokens").count().collect()
    histograms: dict[str, tuple[int, dict[int, int]]] = {}
    for r in rows:
        histograms.setdefault(r["profile"], (r["capacity"], {}))[1][r["n_tokens"]] = r["count"]
    lookup = _Lookup(histograms)
    slots = sizes.sparkSession.createDataFrame(
        [(r["profile"], r["n_tokens"], lookup.offset[r["profile"], r["n_tokens"]], -(-r["count"] // BUCKET_ROWS)) for r in rows],
        "profile string, n_tokens int, slot_start bigint, buckets bigint",
    )
    keyed = placed.join(F.broadcast(slots), ["profile", "n_tokens"]).withColumn(
        "bucket", F.pmod(F.xxhash64(id_col, "piece_no"), F.col("buckets"))
    )
    slot = ["profile", "n_tokens", "bucket"]
    ahead = keyed.groupBy(*slot).count().select(
        *slot,
        F.coalesce(F.sum("count").over(W.partitionBy("profile", "n_tokens").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"),
    )
    numbered = keyed.withColumn("nth", F.row_number().over(W.partitionBy(*slot).orderBy(F.col(id_col), "piece_no")) - 1).join(ahead, slot)
    starts, each, base = lookup.starts, lookup.each, lookup.base

    @F.pandas_udf("bigint")
    def container(rank: pd.Series) -> pd.Series:
        at = np.searchsorted(starts, rank.to_numpy(), side="right") - 1
        return pd.Series(base[at] + (rank.to_numpy() - starts[at]) // each[at])

    columns = ["profile", "container_id", id_col, "piece_no", "start_token", "n_tokens"]
    filled = numbered.withColumn("container_id", container(F.col("slot_start") + F.col("ahead") + F.col("nth"))).select(*columns)
    return filled.unionByName(items.where("n_tokens <= 0").withColumn("container_id", F.lit(None).cast("bigint")).select(*columns))


def fill_report(packed: DataFrame, profiles: DataFrame) -> DataFrame:
    """(profile, containers, tokens, least_containers, unused_share) of a packing."""
    per = packed.groupBy("profile").agg(
        (F.coalesce(F.max("container_id"), F.lit(-1)) + 1).alias("containers"), F.sum("n_tokens").alias("tokens")
    )
    return per.join(F.broadcast(profiles.select("profile", "capacity").distinct()), "profile").select(
        "profile", "containers", "tokens",
        F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"),
        F.round(1 - F.col("tokens") / F.greatest(F.col("containers") * F.col("capacity"), F.lit(1)), 4).alias("unused_share"),
    )
