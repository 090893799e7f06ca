"""Multi-select against sorting; summaries within their bound."""

import math
import random

from tidewatch.llm import percentiles

SCHEMA = "g string, day int, v double, vals string, k0 int"


def rank_value(values, permille):
    s = sorted(values)
    return s[max(1, -(-permille * len(s) // 1000)) - 1]


def data(n=6000):
    rnd = random.Random(2)
    rows = []
    for i in range(n):
        g = rnd.choice(["a", "a", "a", "b", None, "few"] if i % 50 == 0 else ["a", "a", "a", "b", None])
        v = rnd.choice([rnd.gauss(0, 1), float(rnd.randrange(3)), rnd.choice([None, float("nan"), float("inf"), -0.0])])
        rows.append((g, i % 5, v, "x", 1))
    return rows


def groups(rows):
    out = {}
    for g, _, v, *_ in rows:
        if v is not None and math.isfinite(v):
            out.setdefault(g, []).append(v)
    return out


def test_exact_with_ties_nulls_and_small_groups(spark, monkeypatch):
    monkeypatch.setattr(percentiles, "RUN_VALUES", 500)
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {(r.g, r.permille): (r.readings, r.percentile) for r in percentiles.group_percentiles(df, ("g",), "v", (1, 250, 500, 999, 1000), finish=4).collect()}
    want = {(g, p): (len(v), rank_value(v, p)) for g, v in groups(rows).items() for p in (1, 250, 500, 999, 1000)}
    assert got == want


def test_all_equal_and_empty(spark):
    df = spark.createDataFrame([("a", 1, 3.5, "", 0)] * 200, SCHEMA)
    assert {r.percentile for r in percentiles.group_percentiles(df, ("g",), "v", finish=4).collect()} == {3.5}
    assert percentiles.group_percentiles(df.where("false"), ("g",), "v").collect() == []


def test_joined_where_there_are_too_many_targets_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(percentiles, "BROADCAST_TARGETS", 0)
    rows = data(1500)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.g, r.permille): r.percentile for r in percentiles.group_percentiles(df, ("g",), "v", (500,), finish=2).collect()}
    assert got == {(g, 500): rank_value(v, 500) for g, v in groups(rows).items()}


def test_combined_summaries_keep_the_bound(spark):
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA)
    points = 20
    apart = [percentiles.slice_summaries(df.where(f"day % 2 = {k}"), ("g",), "day", "v", points) for k in (0, 1)]
    for r in percentiles.combined(apart[0].unionByName(apart[1]), ("g",)).collect():
        v = sorted(groups(rows)[r.g])
        want = max(1, -(-r.permille * len(v) // 1000))
        low, high = sum(x < r.percentile for x in v) + 1, sum(x <= r.percentile for x in v)
        off = max(0, low - want, want - high)
        assert r.readings == len(v) and off <= len(v) / points + 5
