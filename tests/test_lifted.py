"""Lifted diagrams against all matchings tried, tracks of moving bumps, meetings against all pairs."""

import itertools
import math

import numpy as np
import pytest

from isofold.operators import diagrams, incidence, lifted, topology
from isofold.plans import registry

W = lifted.Weights(0.7, 0.2, 1.5, 0.5, 2.0)


def plain_cost(a, b, w, p):
    """One pair's cost to another, or to the diagonal if b is None."""
    axes = (w.x, w.y, w.z)
    if b is None:
        return (w.saddle if a[2] == 1 else w.extremum) * abs(a[1] - a[0]) ** p + sum(c * abs(a[7 + k] - a[4 + k]) ** p for k, c in enumerate(axes))
    if a[2] == 1:
        ways = [abs((a[4 + k] + a[7 + k]) / 2 - (b[4 + k] + b[7 + k]) / 2) for k in range(3)]
        first = last = w.saddle
    elif a[3] and b[3]:
        ways = [abs(a[7 + k] - b[7 + k]) for k in range(3)]
        first, last = w.saddle, w.extremum
    else:
        ways = [abs(a[4 + k] - b[4 + k]) for k in range(3)]
        first, last = w.extremum, w.saddle
    return first * abs(a[0] - b[0]) ** p + last * abs(a[1] - b[1]) ** p + sum(c * x**p for c, x in zip(axes, ways))


def plain_total(a, b, w, p):
    join, q = (max, 1.0) if math.isinf(p) else (sum, p)
    totals = [0.0]
    for kind in range(3):
        x, y = [r for r in a if r[2] == kind], [r for r in b if r[2] == kind]
        slots = [*range(len(y)), *[-1] * len(x)]
        best = math.inf
        for chosen in set(itertools.permutations(slots, len(x))):
            used = {j for j in chosen if j >= 0}
            c = [plain_cost(r, y[j] if j >= 0 else None, w, q) for r, j in zip(x, chosen)] + [plain_cost(r, None, w, q) for j, r in enumerate(y) if j not in used]
            best = min(best, join(c or [0.0]))
        totals.append(best)
    return join(totals)


def drawn(rng, n):
    kind = rng.integers(0, 3, n)
    top = (kind == 2) | ((kind == 0) & (rng.random(n) < 0.3))
    birth = rng.random(n)
    return np.column_stack((birth, birth + rng.random(n), kind, top, rng.random((n, 6))))


@pytest.mark.parametrize("p", [1.0, 2.0, math.inf])
@pytest.mark.parametrize("seed", range(8))
def test_partners_are_the_best_of_all(seed, p):
    rng = np.random.default_rng(seed)
    a, b = drawn(rng, int(rng.integers(0, 7))), drawn(rng, int(rng.integers(0, 7)))
    found, total = lifted.partners(a, b, W, p)
    assert total == pytest.approx(plain_total(a, b, W, p)) and total == pytest.approx(lifted.partners(b, a, W, p)[1])
    assert sorted(i for i, _, _ in found if i >= 0) == list(range(len(a))) and sorted(j for _, j, _ in found if j >= 0) == list(range(len(b)))
    q = 1.0 if math.isinf(p) else p
    assert all(c == pytest.approx(plain_cost(a[i] if i >= 0 else b[j], b[j] if i >= 0 and j >= 0 else None, W, q)) for i, j, c in found)


def bumps(spark, n=24, steps=7):
    """Two bumps that pass one another, their heights changing places at each step, a third that nears the first and is gone after step 4, and a high one that stays."""
    g = incidence.Grid(n, n)
    rows = []
    for t in range(steps):
        at = [(4 + 2 * t, 5, 1.0 if t % 2 else 1.3), (18 - 2 * t, 18, 1.3 if t % 2 else 1.0), (21, 10, 2.0)]
        if t <= 4:
            at.append((4 + 2 * t, 13 - t, 0.8))
        for v in range(n * n):
            x, y = v % n, v // n
            rows.append((t, v, float(x), float(y), 0.0, float(sum(h * math.exp(-((x - a) ** 2 + (y - b) ** 2) / 3) for a, b, h in at))))
    v = spark.createDataFrame(rows, "ds long, vid long, x double, y double, z double, value double")
    c = spark.createDataFrame([(t, r["cid"], r["verts"]) for t in range(steps) for r in g.cells(spark).collect()], "ds long, cid long, verts array<long>")
    return v, c


def test_tracks_follow_moving_bumps(spark):
    v, c = bumps(spark)
    d = diagrams.constrained(topology.persistence_diagram(v, c), "absolute", threshold=0.2)
    pairs = lifted.lifted(d, v)
    found = lifted.tracks(pairs, lifted.Weights(0.1, 0.1, 1.0, 1.0, 0.0)).toPandas()
    high = found[found["kind"] == lifted.MAXIMUM]
    for row in (5, 18):
        own = high[high["y"] == row].sort_values("t")
        assert own["track"].nunique() == 1 and len(own) == 7 and (np.abs(np.diff(own["x"])) == 2).all()
    by_value = lifted.tracks(pairs).toPandas()
    assert any(g["y"].nunique() > 1 for _, g in by_value[(by_value["kind"] == lifted.MAXIMUM) & by_value["y"].isin([5, 18])].groupby("track"))
    third = high[(high["y"] > 7) & (high["y"] < 15)]
    assert third["track"].nunique() == 1 and sorted(third["t"]) == [0, 1, 2, 3, 4]
    met = lifted.meetings(spark.createDataFrame(found), 5.0).toPandas()
    gone = met[(met["track"] == third["track"].iloc[0]) & (met["event"] == "ends")]
    assert set(gone["t"]) == {4} and len(gone) == 1 and gone["distance"].iloc[0] < 5
    whole = lifted.merged(spark.createDataFrame(found), 5.0).toPandas()
    assert len(whole) == len(found) and whole.groupby("track")["component"].nunique().max() == 1
    of = dict(zip(whole["track"], whole["component"]))
    assert all(of[a] == of[b] for a, b in zip(met["track"], met["other"]))


def test_meetings_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(int(t), 0.0, 1.0, int(k), bool(k == 2), 0, 0, *map(float, rng.normal(0, 1, 3)), tr) for tr in range(25) for k in [int(rng.integers(0, 3))] for t in range(*sorted(rng.choice(9, 2, replace=False)))]
    found = spark.createDataFrame(rows, "t long, birth double, death double, kind int, top boolean, birth_vid long, death_vid long, x double, y double, z double, track long")
    want = set()
    for a in rows:
        times = [r[0] for r in rows if r[10] == a[10]]
        for b in rows:
            if a[10] != b[10] and a[0] == b[0] and a[3] != 1 and b[3] != 1 and a[4] == b[4] and math.dist(a[7:10], b[7:10]) < 1.5:
                want |= {(a[10], b[10], a[0], e) for e, end in (("begins", min(times)), ("ends", max(times))) if end == a[0]}
    got = [tuple(r)[:4] for r in lifted.meetings(found, 1.5).collect()]
    assert set(got) == want and len(got) == len(want) > 5
    with pytest.raises(ValueError):
        lifted.meetings(found, 0.0)
    assert lifted.merged(found.limit(0), 1.0).count() == 0


def test_queries(spark, sf):
    """The query's matrix equals all matchings of the smaller diagrams; without weights of places the lifted costs are of values alone."""
    rows = {(r["i"], r["j"]): r["dist"] for r in registry.QUERIES["lifted_wasserstein"](spark, sf).collect()}
    pairs = registry.daily_pairs(spark, sf).toPandas()
    members = {int(d): lifted._rows(g) for d, g in pairs.groupby("ds")}
    assert len(rows) == len(members) * (len(members) - 1) // 2 > 0
    for (i, j), dist in list(rows.items())[:200]:
        assert dist == pytest.approx(math.sqrt(lifted.partners(members[i], members[j], registry.PLACES, 2.0)[1]), abs=1e-5)
    for r in registry.QUERIES["lifted_bottleneck"](spark, sf).limit(200).collect():
        assert r["dist"] == pytest.approx(lifted.partners(members[r["i"]], members[r["j"]], registry.PLACES, math.inf)[1], abs=1e-5)
    tracked = registry.QUERIES["tracking_lifted"](spark, sf).toPandas()
    assert len(tracked) == len(pairs) and (tracked.groupby(["track", "t"]).size() == 1).all()
    assert (tracked["component"] <= tracked["track"]).all()
    of = dict(zip(tracked["track"], tracked["component"]))
    met = registry.QUERIES["tracking_meetings"](spark, sf).collect()
    assert met and all(r["distance"] < 1.5 and of[r["track"]] == of[r["other"]] for r in met)
