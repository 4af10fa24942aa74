"""The bounded scans against brute force, with one key that holds most rows."""

import math
import random

import pandas as pd
import pytest

from signalbed.functions.forest import climb
from signalbed.functions.ordered import neighbours, previous, running_total
from signalbed.functions.quantiles import ranked_percentiles, value_counts
from signalbed.functions.spacing import keep_spaced
from signalbed.functions.times import DAY, HOUR, SECOND


def moments(seed, n, spread):
    rng = random.Random(seed)
    return sorted({("hot" if rng.random() < 0.8 else rng.choice("ab"), rng.randrange(-DAY, spread)) for _ in range(n)})


@pytest.mark.parametrize("spread", [50, 5 * SECOND, 4 * DAY])
def test_running_total(spark, spread):
    rows = [(k, at, i % 5) for i, (k, at) in enumerate(moments(1, 400, spread))]
    df = spark.createDataFrame(rows, "k string, at long, n long")
    got = {(r.k, r.at): r.total for r in running_total(df, ["k"], "at", "n", "total").collect()}
    assert got == {(k, at): sum(n for k2, at2, n in rows if k2 == k and at2 <= at) for k, at, _ in rows}


@pytest.mark.parametrize("spread", [50, 5 * SECOND, 4 * DAY])
def test_neighbours(spark, spread):
    points, probes = moments(2, 200, spread), moments(3, 200, spread)
    p = spark.createDataFrame([(k, at, f"{k}{at}") for k, at in points], "k string, at long, name string")
    q = spark.createDataFrame(probes, "k string, at long")
    rows = neighbours(p, q, ["k"], "at", ["name"]).collect()
    assert len(rows) == len(probes)
    for r in rows:
        below = [at for k, at in points if k == r.k and at <= r.at]
        above = [at for k, at in points if k == r.k and at >= r.at]
        assert (r.before.at if r.before else None) == (max(below) if below else None)
        assert (r.after.at if r.after else None) == (min(above) if above else None)
        assert not r.after or r.after.name == f"{r.k}{r.after.at}"


def test_previous(spark):
    rows = moments(4, 300, 3 * DAY)
    df = spark.createDataFrame(rows, "k string, at long")
    for r in previous(df, ["k"], "at", []).collect():
        below = [at for k, at in rows if k == r.k and at < r.at]
        assert (r.before.at if r.before else None) == (max(below) if below else None)


def spaced(times, gap):
    kept, last = [], None
    for at in sorted(times):
        if last is None or at >= last + gap:
            kept.append(at)
            last = at
    return kept


@pytest.mark.parametrize("chunk,gap,spread", [
    (200_000, HOUR, 3 * DAY), (1, 7, 400), (3, 7, 400), (5, 100, 400), (7, HOUR, 6 * DAY), (16, 5000, 400), (4, 1, 400),
])
def test_keep_spaced(spark, chunk, gap, spread):
    rows = moments(chunk + gap, 250, spread)
    df = spark.createDataFrame([(k, at, gap) for k, at in rows], "k string, at long, gap long")
    got = sorted((r.k, r.at) for r in keep_spaced(df, "k", "at", "gap", chunk).collect())
    want = sorted((k, at) for k in {k for k, _ in rows} for at in spaced([t for k2, t in rows if k2 == k], gap))
    assert got == want


def test_percentiles_of_a_hot_group(spark):
    rng = random.Random(7)
    rows = [("hot", round(rng.lognormvariate(0, 2), 3)) for _ in range(20_000)] + [("hot", 1.0)] * 5000 + [("one", 4.0)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["k", "v"]))
    wanted = {f"p{p}": p for p in (0, 1, 25, 50, 90, 95, 99, 99.9, 100)}
    got = {r.k: r.asDict() for r in ranked_percentiles(value_counts(df, ["k"], "v"), ["k"], "v", wanted).collect()}
    for key in ("hot", "one"):
        values = sorted(v for k, v in rows if k == key)
        for name, p in wanted.items():
            rank = min(max(math.ceil(p / 100.0 * len(values)), 1), len(values))
            assert got[key][name] == values[int(rank) - 1], (key, name)


def test_climb_long_chain_star_orphans_and_cycle(spark):
    rows = [("t", 0, None)] + [("t", n, n - 1) for n in range(1, 300)] + [("t", n, 0) for n in range(1000, 1400)]
    rows += [("t", 2000, -1), ("t", 2001, 2000), ("t", 3000, 3001), ("t", 3001, 3000), ("t", 3002, 3001), ("u", 0, None)]
    df = spark.createDataFrame(rows, "k string, node long, up long")
    got = {(r.k, r.node): (r.top, r.hops) for r in climb(df, ["k"], "node", "up").collect()}
    want = {("t", n): (0, n) for n in range(300)} | {("t", n): (0, 1) for n in range(1000, 1400)} | {("u", 0): (0, 0)}
    assert got == want
