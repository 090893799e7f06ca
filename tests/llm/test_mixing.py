"""Mixing: shares, caps, the dual's solution, and the cases without one."""

import math
import random

import pytest

from tidewatch.llm import mixing

SIZES = "doc_id long, source string, tokens long, cap string"
TARGETS = "source string, target_share double, max_repeats int"


def sizes(spark, spec, seed=1):
    rnd = random.Random(seed)
    rows = [(None, s, n) for s, k in spec.items() for n in [int(rnd.lognormvariate(6, 0.7)) + 1 for _ in range(k)]]
    return spark.createDataFrame([(i, s, n, "x") for i, (_, s, n) in enumerate(rows)], SIZES)


def test_shares_and_caps(spark):
    df = sizes(spark, {"a": 3000, "b": 800, "c": 300, "other": 50}).unionByName(spark.createDataFrame([(10**6, None, 10, "x"), (10**6 + 1, "a", 0, "x")], SIZES))
    goals = spark.createDataFrame([("a", 0.4, 1), ("b", 0.3, 2), ("c", 0.2, 5), ("absent", 0.1, 3)], TARGETS)
    out = mixing.mixed(df, goals)
    rows = out.collect()
    caps = {"a": 1, "b": 2, "c": 5}
    assert all(1 <= r.copies <= caps[r.source] for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    share = {r.source: r.actual_share for r in mixing.shares(out, goals).collect()}
    assert share["absent"] == 0.0
    for s, want in {"a": 0.4 / 0.9, "b": 0.3 / 0.9, "c": 0.2 / 0.9}.items():
        assert abs(share[s] - want) < 0.002


def test_total_given_and_multipliers_solve_the_dual(spark):
    df = sizes(spark, {"a": 500, "b": 500})
    goals = spark.createDataFrame([("a", 0.9, 4), ("b", 0.1, 4)], TARGETS)
    plan = mixing._plan(df, goals, 400_000)
    lam = mixing.multipliers(df, plan)
    for s, p in plan.items():
        mass = sum(min(p["cap"], math.exp(lam[s] * r.tokens / p["mean"])) * r.tokens for r in df.where(f"source = '{s}'").collect())
        assert abs(mass - p["wanted"]) < 1e-5 * p["wanted"]
    total = sum(r.copies * r.tokens for r in mixing.mixed(df, goals, total_tokens=400_000).collect())
    assert abs(total - 400_000) < 0.01 * 400_000


def test_one_source_takes_all_and_nothing(spark):
    df = sizes(spark, {"a": 40})
    goals = spark.createDataFrame([("a", 1.0, 3), (None, 0.5, 1)], TARGETS)
    assert {r.copies for r in mixing.mixed(df, goals).collect()} == {3}
    assert mixing.mixed(df.where("false"), goals).count() == 0
    assert mixing.mixed(df, goals.where("false")).count() == 0


def test_steps_without_end_are_an_error(spark):
    df = sizes(spark, {"a": 50, "b": 50})
    plan = mixing._plan(df, spark.createDataFrame([("a", 0.5, 4), ("b", 0.5, 1)], TARGETS), 20_000)
    with pytest.raises(RuntimeError):
        mixing.multipliers(df, plan, rounds=1)


def test_few_tokens_of_many_are_still_met(spark):
    """A target far below what there is: nearly every document's chance is small, and no threshold is out of reach."""
    df, goals = sizes(spark, {"a": 4000}), spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    got = sum(r.copies * r.tokens for r in mixing.mixed(df, goals, total_tokens=30_000).collect())
    assert abs(got - 30_000) < 0.05 * 30_000


def test_same_seed_same_mix(spark):
    df, goals = sizes(spark, {"a": 300, "b": 300}), spark.createDataFrame([("a", 0.7, 2), ("b", 0.3, 1)], TARGETS)
    one = {(r.doc_id, r.copies) for r in mixing.mixed(df, goals).collect()}
    assert one == {(r.doc_id, r.copies) for r in mixing.mixed(df.repartition(7), goals).collect()}


def test_token_counts(spark):
    path = mixing.tokenizer_path()
    df = spark.createDataFrame([(1, "a", "Hello world"), (2, "a", ""), (3, "a", None), (4, None, "x" * 50_000 + " end"), (5, "a", "<|endoftext|>")], "doc_id long, source string, text string")
    got = {r.doc_id: r.tokens for r in mixing.token_counts(df, path).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 100 and got[5] > 1


def test_too_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 1)
    with pytest.raises(ValueError):
        mixing.mixed(sizes(spark, {"a": 3}), spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], TARGETS))
