import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm.related_splits import Bundle, Source, assign_splits, components, flow, link_edges, related_pairs, rounded, split_components


def brute(links):
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    keys = {}
    for e, kind, key in links:
        if e is None or kind is None or not key or not key.strip() or key == "unknown":
            continue
        if (kind, key) in keys:
            a, b = find(keys[kind, key]), find(e)
            parent[max(a, b)] = min(a, b)
        keys.setdefault((kind, key), e)
    return {e: find(e) for e in parent}


def make(spark, links):
    return link_edges(spark.createDataFrame(links, "e string, kind string, key string"), "e", "kind", "key")


def test_components_of_chains_stars_and_noise(spark):
    rnd = random.Random(1)
    links = [(f"c{i}", "hash", f"k{i // 2}") for i in range(40)] + [(f"c{i}", "config", f"k{(i + 1) // 2}") for i in range(40)]  # a chain
    links += [(f"s{i}", "config", "hub") for i in range(200)]
    links += [(f"r{rnd.randrange(60)}", rnd.choice(["hash", "config", None]), rnd.choice(["", " ", None, "unknown", *[f"q{j}" for j in range(40)]])) for _ in range(150)]
    links += [(None, "hash", "k0"), links[0], links[0]]
    got = {r.entity: r.component for r in components(make(spark, links)).collect()}
    want = brute(links)
    linked = {e: c for e, c in want.items() if sum(1 for x in want.values() if x == c) > 1}
    assert got == linked
    present = spark.createDataFrame([("c0",), ("c0",), ("c39",), ("s1",), ("zz",), (None,)], "entity string")
    pairs = related_pairs(components(make(spark, links)), present).collect()
    assert [(r.a, r.b) for r in pairs] == [("c0", "c39")]


def test_hubs_and_blocks_change_nothing(spark):
    rnd = random.Random(8)
    links = [(f"s{i}", "config", "hub") for i in range(120)] + [(f"s{i}", "hash", "all") for i in range(100, 180)]
    links += [(f"r{rnd.randrange(60)}", rnd.choice(["hash", "config"]), f"q{rnd.randrange(40)}") for _ in range(100)]
    edges = link_edges(spark.createDataFrame(links, "e string, kind string, key string"), "e", "kind", "key", hub=10)
    assert {tuple(r) for r in edges.collect()} == {tuple(r) for r in make(spark, links).collect()}
    found = components(edges, hub=10)
    want = brute(links)
    got = {r.entity: r.component for r in found.collect()}
    assert got == {e: c for e, c in want.items() if sum(1 for x in want.values() if x == c) > 1}
    present = spark.createDataFrame([(e,) for e in want], "entity string")
    pairs = sorted((r.a, r.b) for r in related_pairs(found, present, block=7, hub=10).collect())
    assert pairs == sorted((a, b) for a in got for b in got if a < b and got[a] == got[b])


def test_no_links(spark):
    assert components(make(spark, [])).count() == 0
    assert components(make(spark, [("a", "hash", "1"), ("b", "hash", "unknown")])).count() == 0


def test_flow_meets_quotas_and_profiles():
    bundles = [Bundle(50.0, 3, 0), Bundle(7.0, 40, 0), Bundle(7.0, 20, 1), Bundle(1.0, 300, 1), Bundle(400.0, 1, 0)]
    total = sum(b.size * b.count for b in bundles)
    quotas = np.array([0.8, 0.1, 0.1]) * total
    sent = flow(bundles, quotas)
    assert np.allclose(sent.sum(axis=1), [b.size * b.count for b in bundles])
    assert np.allclose(sent.sum(axis=0), quotas)
    assert sent[4, 1:].sum() == 0  # larger than the small quotas
    whole = rounded(bundles, sent, quotas)
    assert (whole.sum(axis=1) == [b.count for b in bundles]).all()
    assert np.abs((whole * np.array([b.size for b in bundles])[:, None]).sum(axis=0) - quotas).max() <= 4


def residual_cost(bundles, quotas, sent):
    """The cost of a flow, and whether its whole residual network has a cycle of negative cost (then it is not optimal)."""
    k, total = len(quotas), sum(quotas)
    classes = sorted({b.profile for b in bundles})
    arcs, cost = [], 0.0
    for i, b in enumerate(bundles):
        room = [np.floor(q / b.size) * b.size for q in quotas]
        if sum(room) < b.size * b.count:
            room[int(np.argmax(quotas))] = np.inf
        for j in range(k):
            node = ("c", b.profile, j)
            if sent[i, j] < room[j] - 1e-4:
                arcs.append((("b", i), node, 0))
            if sent[i, j] > 1e-4:
                arcs.append((node, ("b", i), 0))
    for c in classes:
        of = [i for i, b in enumerate(bundles) if b.profile == c]
        rows = sum(bundles[i].size * bundles[i].count for i in of)
        for j in range(k):
            used, share = sent[of, j].sum(), rows * quotas[j] / total
            cost += max(0, used - share)
            arcs.append((("c", c, j), ("s", j), 1 if used >= share - 1e-4 else 0))
            if used > 1e-4:
                arcs.append((("s", j), ("c", c, j), -1 if used > share + 1e-4 else 0))
    for j in range(k):
        full = sent[:, j].sum()
        cost += 10 * max(0, full - quotas[j])
        arcs.append((("s", j), "sink", 10 if full >= quotas[j] - 1e-4 else 0))
        if full > 1e-4:
            arcs.append(("sink", ("s", j), -10 if full > quotas[j] + 1e-4 else 0))
    far = dict.fromkeys({x for a in arcs for x in a[:2]}, 0.0)
    for _ in range(len(far) + 1):
        changed = False
        for a, b, c in arcs:
            if far[a] + c < far[b] - 1e-9:
                far[b], changed = far[a] + c, True
    return cost, changed


def test_flow_is_of_least_cost():
    bundles = [Bundle(12.0, 5, 2), Bundle(5.0, 2, 0), Bundle(3.0, 5, 2)]
    quotas = np.array([68.0, 8.5, 8.5])
    assert residual_cost(bundles, quotas, flow(bundles, quotas)) == (pytest.approx(6), False)
    rnd = random.Random(9)
    for _ in range(300):
        bundles = list({(s := rnd.randrange(1, 40), p := rnd.randrange(-1, 5)): Bundle(float(s), rnd.randrange(1, 12), p) for _ in range(rnd.randrange(1, 14))}.values())
        quotas = np.array([0.8, 0.1, 0.1]) * sum(b.size * b.count for b in bundles)
        sent = flow(bundles, quotas)
        assert np.allclose(sent.sum(axis=1), [b.size * b.count for b in bundles]) and sent.min() > -1e-5
        assert not residual_cost(bundles, quotas, sent)[1]


def test_one_huge_component():
    bundles = [Bundle(900.0, 1, 0), Bundle(1.0, 100, 0)]
    quotas = np.array([800.0, 100.0, 100.0])
    whole = rounded(bundles, flow(bundles, quotas), quotas)
    assert whole[0].tolist() == [1, 0, 0] and whole.sum() == 101


def test_every_component_once(spark):
    rnd = random.Random(2)
    sizes = [(f"g{i}", rnd.randrange(5), rnd.randrange(50), rnd.randrange(9) + 1) for i in range(800)]
    df = spark.createDataFrame(sizes, "component string, n_over long, n_within long, n_unlabelled long")
    got = {r.component: r.split for r in split_components(df).collect()}
    assert len(got) == 800
    rows = {"train": 0, "calibration": 0, "holdout": 0}
    for c, a, b, u in sizes:
        rows[got[c]] += a + b + u
    total = sum(rows.values())
    off = max(abs(rows["train"] - 0.8 * total), abs(rows["holdout"] - 0.1 * total))
    assert off <= 3
    again = {r.component: r.split for r in split_components(df.repartition(3)).collect()}
    assert again == got


def test_rows_of_related_designs_stay_together(spark):
    links = [(f"d{i}", "hash", f"k{i // 3}") for i in range(60)]
    rows = [(f"d{i}" if i else None, 0.05 if i % 4 else None, i % 7) for i in range(60) for _ in range(1 + i % 5)]
    df = spark.createDataFrame(rows, "design string, label_v double, other int")
    out = assign_splits({"t": Source(df, "design", "label_v")}, make(spark, links), 0.045)["t"].collect()
    assert len(out) == len(rows)
    seen = {}
    for r in out:
        if r.design:
            assert seen.setdefault(int(r.design[1:]) // 3, r.split) == r.split
    assert {r.split for r in out} == {"train", "calibration", "holdout"}
    with pytest.raises(ValueError):
        assign_splits({"t": Source(df.withColumn("split", F.lit(1)), "design")}, make(spark, links), 0.045)
    empty = assign_splits({"t": Source(df.limit(0), "design", "label_v")}, make(spark, []), 0.045)["t"]
    assert empty.count() == 0
