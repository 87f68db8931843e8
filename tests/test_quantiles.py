"""Exact discrete quantiles against a sort-based reference, including a hot group."""

import math
import random

from funnelkit.functions.quantiles import group_quantiles


def _disc(values, p):
    v = sorted(values)
    return v[max(1, math.ceil(p * len(v))) - 1]


def test_exact_matches_sorted_reference(spark):
    rnd = random.Random(7)
    rows = []
    for g, n in (("hot", 5000), ("a", 1), ("b", 2), ("c", 7), ("d", 100), ("e", 101)):
        rows += [(g, rnd.randint(-50, 400)) for _ in range(n)]
    rows += [("nulls", None), ("e", None)]
    df = spark.createDataFrame(rows, "g string, v int")
    probs = [0.5, 0.75, 0.9]
    got = {r.g: (r.q50, r.q75, r.q90) for r in group_quantiles(df, ["g"], "v", probs, ["q50", "q75", "q90"]).collect()}
    by_group = {}
    for g, v in rows:
        if v is not None:
            by_group.setdefault(g, []).append(v)
    assert set(got) == set(by_group)  # all-NULL groups do not appear
    for g, vals in by_group.items():
        assert got[g] == tuple(_disc(vals, p) for p in probs), g


def test_global_and_approx(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 1001)], "v int")
    (row,) = group_quantiles(df, [], "v", [0.5, 0.9], ["a", "b"]).collect()
    assert (row.a, row.b) == (500, 900)
    (row,) = group_quantiles(df, [], "v", [0.5, 0.9], ["a", "b"], method="approx", accuracy=100000).collect()
    assert (row.a, row.b) == (500, 900)
