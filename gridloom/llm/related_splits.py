"""Train, calibration and holdout partitions that never separate related records.

Entities are related if a chain of shared source keys joins them. Names are coded as numbers in their order,
once; components are found by alternating large and small stars over an edge table of numbers that is written to
the shared folder in each round; a key of many entities contributes a star around its least entity, never all
pairs. Where rows are joined with what was summed up of their key, keys of more than a thousandth of all rows
(a few thousand at most, by arithmetic) are joined by broadcast, so that a hub is no task of its own. Nothing of
the graph reaches the driver but counts and a checksum a round.

The partition is a min-cost flow. Components of the same size and label profile (none labelled; none over
budget; quarter of the share over budget) form a bundle. Bundles supply rows; each row flows to a (profile,
partition) node and on to its partition, where what exceeds the profile's share costs 1 a row and what exceeds
the partition's quota 10. A component larger than a quota has no arc to that partition. The flow is an exact one:
successive shortest paths over residual arcs in both directions, from one bundle after the other. It is rounded to
whole components, the rest going to the largest deficits, largest components first. Within a bundle the
components are ordered by a seeded hash and dealt in that order.

The flow sees one row a bundle. Sizes that differ add up to the rows, so that of N rows there are at most
sqrt(12 N) bundles of the six profiles: some 110,000 of a thousand million rows. No count is coarsened.

Defined results: an entity of null name is related to nothing; its rows are dealt one by one, equal rows
together. Keys that are null, blank or among ``ignore`` link nothing, nor does a null kind. Repeated
links change nothing. Entities without links are components of their own, labelled by their name;
others by the least name in them. Entities that only the links know take no rows. With one component
larger than the quotas allow, shares deviate and every row still has exactly one partition. Empty tables
give empty results. Input columns named like those made here (``entity``, ``component``, ``split``) raise
``ValueError``.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.names import trimmed
from gridloom.session import broadcast_if_small, stage, unstage

SPLITS = {"train": 0.8, "calibration": 0.1, "holdout": 0.1}


#: Keys of fewer rows than this are never taken for hubs.
HUB = 100_000


def _beside(rows: DataFrame, by: list[str], summed: DataFrame, total: int, hub: int = HUB) -> DataFrame:
    """``rows`` joined with the one row of ``summed`` of their key, which has the number ``n`` of rows of the key.

    Of ``total`` rows at most a thousand keys (and their like in repeated counts) have more than a thousandth: these are
    broadcast, and only rows of other keys are shuffled by key."""
    if total <= hub:
        return rows.join(summed, by)
    most = max(hub, total // 1000)
    heavy = F.broadcast(summed.where(F.col("n") > most))
    others = rows.join(heavy.select(*by), by, "left_anti").join(summed.where(F.col("n") <= most), by)
    return rows.join(heavy, by).unionByName(others)


def link_edges(links: DataFrame, entity: str, kind: str, key: str, ignore: tuple[str, ...] = ("unknown",), hub: int = HUB) -> DataFrame:
    """Edges (u, v), u > v, of which each source key makes a star around its least entity."""
    usable = links.where(F.col(entity).isNotNull() & F.col(kind).isNotNull() & (trimmed(key) != "") & ~F.col(key).isin(*ignore))
    rows = usable.select(F.col(entity).alias("u"), F.col(kind).alias("kind"), F.col(key).alias("key")).distinct()
    least = rows.groupBy("kind", "key").agg(F.min("u").alias("v"), F.count("*").alias("n"))
    return _beside(rows, ["kind", "key"], least, links.count(), hub).where("u > v").select("u", "v").distinct()


def _large_star(edges: DataFrame, total: int, hub: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return _beside(both.where("v > u"), ["u"], least, 2 * total, hub).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, total: int, hub: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    inner = _beside(edges, ["u"], least, total, hub).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return inner.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, hub: int = HUB) -> DataFrame:
    """(entity, component) of all entities on edges; the component's label is its least entity."""
    named = stage(edges, "edges")
    ends = named.select(F.col("u").alias("name")).unionByName(named.select(F.col("v").alias("name"))).distinct()
    # numbers in the order of the names: rows are sorted over all partitions, and ids grow with partition and row
    names = stage(ends.sort("name").withColumn("id", F.monotonically_increasing_id()), "names")
    start = named.join(names.withColumnsRenamed({"name": "u", "id": "a"}), "u").join(names.withColumnsRenamed({"name": "v", "id": "b"}), "v")
    now, before = stage(start.select(F.col("a").alias("u"), F.col("b").alias("v")), "edges"), None
    unstage(named)
    while True:
        mark = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if mark == before or not mark["n"]:
            break
        before = mark
        large = stage(_large_star(now, mark["n"], hub), "edges")
        after = stage(_small_star(large, mark["n"], hub), "edges")
        unstage(now)
        unstage(large)
        now = after
    roots = now.select(F.col("v").alias("u"), "v").distinct()
    label = names.withColumnsRenamed({"name": "component", "id": "v"})
    return now.unionByName(roots).join(names.withColumnsRenamed({"name": "entity", "id": "u"}), "u").join(label, "v").select("entity", "component")


def related_pairs(members: DataFrame, present: DataFrame, block: int = 1000, hub: int = HUB) -> DataFrame:
    """All pairs (a < b) of present entities of one component. The pairs are the result itself; a large component is
    parted into blocks of about ``block`` entities, and each pair of blocks is a task's share of its own."""
    held = stage(members.join(present.select("entity").distinct(), "entity", "left_semi"), "members")
    sizes = held.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
    parts = _beside(held, ["component"], sizes, held.count(), hub).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    parts = parts.select("component", "entity", "blocks", F.pmod(F.xxhash64("entity"), F.col("blocks")).cast("int").alias("own"))
    left = parts.select("component", F.col("entity").alias("x"), F.col("own").alias("i"), F.explode(F.sequence(F.col("own"), F.col("blocks") - 1)).alias("j"))
    right = parts.select("component", F.col("entity").alias("y"), F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"), F.col("own").alias("j"))
    pairs = left.join(right, ["component", "i", "j"]).where("i < j or x < y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "component")


class Bundle(NamedTuple):
    size: float
    count: int
    profile: int  # class of the label profile


EPS = 1e-6


class _Network:
    """The residual network of bundles, (class, split) nodes and splits. A node of the class c and the split j is
    c * k + j, the split j itself is n * k + j with n classes."""

    def __init__(self, bundles: list[Bundle], quotas: np.ndarray) -> None:
        self.k = k = len(quotas)
        size, supply = np.array([b.size for b in bundles]), np.array([b.size * b.count for b in bundles])
        room = np.floor(quotas[None, :] / np.maximum(size[:, None], 1)) * size[:, None]
        # what no quota holds goes to the largest
        room[:, int(np.argmax(quotas))] = np.where(room.sum(axis=1) < supply, np.inf, room[:, int(np.argmax(quotas))])
        classes = sorted({b.profile for b in bundles})
        self.of = [classes.index(b.profile) for b in bundles]
        self.n = len(classes)
        self.supply, self.room, self.sent = supply.tolist(), room.tolist(), [[0.0] * k for _ in bundles]
        share = np.zeros((self.n, k))
        for c, rows in zip(self.of, self.supply, strict=True):
            share[c] += rows * quotas / quotas.sum()
        self.share, self.used = share.ravel().tolist(), [0.0] * (self.n * k)
        self.quota, self.full = quotas.tolist(), [0.0] * k
        # bundles that can pass rows from one split to another, of each class
        self.movers: list[dict[tuple[int, int], dict[int, None]]] = [{(j, m): {} for j in range(k) for m in range(k) if j != m} for _ in range(self.n)]

    def _arcs(self):
        """All residual arcs between nodes: from, to, cost, room, bundle that moves (-1: none)."""
        k, n = self.k, self.n
        for c in range(n):
            for j in range(k):
                at, split = c * k + j, n * k + j
                free = self.share[at] - self.used[at]
                yield at, split, *((0.0, free) if free > EPS else (1.0, np.inf)), -1
                if self.used[at] > EPS:
                    yield split, at, *((-1.0, -free) if -free > EPS else (0.0, self.used[at])), -1
            for (j, m), able in self.movers[c].items():
                if able:
                    i = next(iter(able))
                    yield c * k + j, c * k + m, 0.0, min(self.sent[i][j], self.room[i][m] - self.sent[i][m]), i

    def _add(self, i: int, j: int, rows: float) -> None:
        self.sent[i][j] += rows
        sent, room = self.sent[i], self.room[i]
        for (x, y), able in self.movers[self.of[i]].items():
            if sent[x] > EPS and room[y] - sent[y] > EPS:
                able[i] = None
            else:
                able.pop(i, None)

    def push(self, i: int) -> float:
        """Sends rows of a bundle along a shortest path; how many."""
        k, n, c = self.k, self.n, self.of[i]
        cost = [np.inf] * ((n + 1) * k)
        by: list[tuple | None] = [None] * len(cost)
        for j in range(k):
            if self.room[i][j] - self.sent[i][j] > EPS:
                cost[c * k + j] = 0.0
        arcs, changed = list(self._arcs()), True
        while changed:
            changed = False
            for arc in arcs:
                if cost[arc[0]] + arc[2] < cost[arc[1]] - 1e-12:
                    cost[arc[1]], by[arc[1]], changed = cost[arc[0]] + arc[2], arc, True
        over = [0.0 if self.quota[j] - self.full[j] > EPS else 10.0 for j in range(k)]
        j = min(range(k), key=lambda j: cost[n * k + j] + over[j])
        if cost[n * k + j] == np.inf:  # no arc with room is left
            self.room[i][max(range(k), key=self.quota.__getitem__)] = np.inf
            self._add(i, 0, 0.0)
            return 0.0
        path, at = [], n * k + j
        while by[at]:
            path.append(by[at])
            at = by[at][0]
        first = at - c * k
        rows = min([self.supply[i], self.room[i][first] - self.sent[i][first], np.inf if over[j] else self.quota[j] - self.full[j], *(arc[3] for arc in path)])
        for a, b, _, _, mover in path:
            if mover >= 0:
                self._add(mover, a % k, -rows)
                self._add(mover, b % k, rows)
            elif a < n * k:
                self.used[a] += rows
            else:
                self.used[b] -= rows
        self._add(i, first, rows)
        self.full[j] += rows
        self.supply[i] -= rows
        return rows


def flow(bundles: list[Bundle], quotas: np.ndarray) -> np.ndarray:
    """Rows of each bundle to each split at the least cost, by successive shortest paths.

    Arcs: bundle -> (class, split), as far as whole components fit the quota; (class, split) -> split, free up to the
    class's share, 1 a row beyond; split -> sink, free up to the quota, 10 a row beyond. Each bundle's rows go along
    shortest paths of the residual network, in which what was sent can be taken back: so the flow stays one of least
    cost for the bundles so far, whatever their order."""
    if not bundles:
        return np.zeros((0, len(quotas)))
    net = _Network(bundles, quotas)
    for i in sorted(range(len(bundles)), key=lambda i: (-bundles[i].size, i)):
        while net.supply[i] > EPS:
            net.push(i)
    return np.array(net.sent)


def rounded(bundles: list[Bundle], sent: np.ndarray, quotas: np.ndarray) -> np.ndarray:
    """Whole components of each bundle to each split."""
    size, count = np.array([b.size for b in bundles]), np.array([b.count for b in bundles])
    whole = np.floor(sent / size[:, None] + 1e-9).astype(int) if len(bundles) else np.zeros((0, len(quotas)), int)
    deficit = quotas - (whole * size[:, None]).sum(axis=0)
    for i in sorted(range(len(bundles)), key=lambda i: (-size[i], i)):
        for _ in range(int(count[i] - whole[i].sum())):
            # largest deficit after taking the component; among equals the split the flow chose
            j = int(np.lexsort((-(sent[i] - whole[i] * size[i]), -deficit))[0])
            whole[i, j] += 1
            deficit[j] -= size[i]
    return whole


def split_components(sizes: DataFrame, splits: dict[str, float] = SPLITS, seed: int = 0) -> DataFrame:
    """(component, split) from (component, n_over, n_within, n_unlabelled)."""
    spark = sizes.sparkSession
    labelled = F.col("n_over") + F.col("n_within")
    quarter = 1 + F.floor(4 * (F.col("n_over") - 1) / labelled)
    part = F.when(labelled == 0, -1).when(F.col("n_over") == 0, 0).otherwise(quarter)
    b = ["size", "profile"]
    marked = sizes.select("component", (labelled + F.col("n_unlabelled")).alias("size"), part.cast("int").alias("profile"))
    got = marked.groupBy(*b).agg(F.count("*").alias("n")).orderBy(*b).collect()  # sqrt(12 N) rows at most
    bundles = [Bundle(float(r["size"]), r["n"], r["profile"]) for r in got]
    quotas = np.array(list(splits.values())) * sum(b.size * b.count for b in bundles)
    dealt = rounded(bundles, flow(bundles, quotas), quotas) if bundles else np.zeros((0, len(splits)), int)
    ends = np.cumsum(dealt, axis=1).tolist()
    table = spark.createDataFrame([(r["size"], r["profile"], e) for r, e in zip(got, ends, strict=True)], "size long, profile int, ends array<long>")
    table = F.broadcast(table) if len(got) <= 200_000 else table
    # order within a bundle by hash: offsets of 256 hash ranges, then a rank within each range
    keyed = marked.select("component", *b, F.xxhash64("component", F.lit(seed)).alias("h")).withColumn("part", F.shiftrightunsigned("h", 56).cast("int"))
    before = keyed.groupBy(*b, "part").agg(F.count("*").alias("n")).withColumn("skip", F.sum("n").over(W.partitionBy(*b).orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n"))
    ranked = keyed.withColumn("r", F.row_number().over(W.partitionBy(*b, "part").orderBy("h", "component"))).join(before.drop("n"), [*b, "part"])
    placed = ranked.join(table, b).withColumn("place", F.col("skip") + F.col("r"))
    name = F.element_at(F.array(*map(F.lit, splits)), F.size(F.filter("ends", lambda e: e < F.col("place"))) + 1)
    return placed.select("component", name.alias("split"))


class Source(NamedTuple):
    """A table with its entity column (already in comparable form) and its label, if any."""

    df: DataFrame
    entity: str
    label: str | None = None


def assign_splits(sources: dict[str, Source], edges: DataFrame, budget: float, splits: dict[str, float] = SPLITS, seed: int = 0) -> dict[str, DataFrame]:
    """Each table with the columns ``component`` and ``split``."""
    marked, counted = {}, []
    for name, (df, entity, label) in sources.items():
        if {"entity", "component", "split"} & set(df.columns) or len(set(df.columns)) < len(df.columns):
            raise ValueError(f"columns of {name} clash with entity, component or split, or with each other")
        lone = F.concat(F.lit("\x00row "), F.lit(name), F.lit(" "), F.hex(F.xxhash64(*df.columns)), F.hex(F.xxhash64(F.lit(1), *df.columns)))
        rows = marked[name] = df.withColumn("entity", F.coalesce(entity, lone))
        value = F.when(F.isnan(label), None).otherwise(F.col(label)) if label else F.lit(None).cast("double")
        counted.append(rows.select("entity", (value > budget).alias("over")).groupBy("entity").agg(F.count_if("over").alias("n_over"), F.count_if(~F.col("over")).alias("n_within"), F.count_if(F.col("over").isNull()).alias("n_unlabelled")))
    per_entity = counted[0]
    for more in counted[1:]:
        per_entity = per_entity.unionByName(more)
    member = components(edges)
    joined = stage(per_entity.join(member, "entity", "left").withColumn("component", F.coalesce("component", "entity")), "entities")
    sizes = joined.groupBy("component").agg(*(F.sum(c).alias(c) for c in ("n_over", "n_within", "n_unlabelled")))
    dealt = joined.select("entity", "component").distinct().join(split_components(sizes, splits, seed), "component")
    ready = broadcast_if_small(stage(dealt, "splits"), 200_000)
    return {name: rows.join(ready, "entity").drop("entity") for name, rows in marked.items()}
