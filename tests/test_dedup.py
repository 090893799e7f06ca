"""Repeated messages against brute force; nulls, ties, clashing names, hot identifiers, equal digests."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.operators import dedup

T0 = datetime(2025, 1, 1, tzinfo=timezone.utc)
SCHEMA = "asset_id string, event_id string, ingestion_time timestamp, delivery_id long, q_text string, is_copy int"


def wanted(rows):
    """Delivery ids of the copies that go."""
    best = {}
    for a, e, t, d, *_ in rows:
        if e is None:
            continue
        order = (t is None, t or T0, d)
        if (a, e) not in best or order < best[a, e]:
            best[a, e] = order
    return sorted(d for a, e, t, d, *_ in rows if e is not None and best[a, e] != (t is None, t or T0, d))


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(r.delivery_id for r in dedup.extra_copies(df, ("asset_id", "event_id"), "ingestion_time", "delivery_id", **kw).collect())


def test_against_brute_force_with_nulls_and_clashing_columns(spark):
    rnd = random.Random(3)
    rows = []
    for d in range(3000):
        a = rnd.choice(["a", "b", None])
        e = rnd.choice([None, *[f"e{i}" for i in range(400)]])
        t = rnd.choice([None, T0 + timedelta(seconds=rnd.randrange(5))])
        rows.append((a, e, t, d, "mine", 7))
    assert found(spark, rows) == wanted(rows)
    assert found(spark, rows, partitions=2, shards_each=5) == wanted(rows)


def test_columns_pass_through_and_every_row_comes_out(spark):
    rows = [("a", "e", T0, 1, "x", 5), ("a", "e", T0, 2, "y", 6), ("a", None, T0, 3, "z", 7)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = dedup.mark_copies(df, ("asset_id", "event_id"), "ingestion_time", "delivery_id", out="dup").collect()
    assert sorted((r.delivery_id, r.q_text, r.is_copy, r.dup) for r in out) == [(1, "x", 5, False), (2, "y", 6, True), (3, "z", 7, False)]


def test_one_identifier_holds_most_rows(spark):
    rows = [("a", "hot" if d % 4 else f"e{d}", T0 + timedelta(seconds=(d * 7919) % 1000), d, "", 0) for d in range(20000)]
    assert found(spark, rows, partitions=5) == wanted(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_identities_are_unambiguous(spark):
    rows = [("a:b", "c", T0, 1, "", 0), ("a", "b:c", T0, 2, "", 0), (None, "c", T0, 3, "", 0), ("", "c", T0, 4, "", 0), ("-", "c", T0, 5, "", 0)]
    assert found(spark, rows) == []


@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1)), min_size=1, max_size=50))
@settings(max_examples=50, deadline=None)
def test_permutation_is_invertible(pairs):
    hi, lo = (np.array(x, np.uint64) for x in zip(*pairs))
    a, b = dedup.unpermute(*dedup.permute(hi, lo))
    assert (a == hi).all() and (b == lo).all()


def test_equal_digests_of_different_texts_stay_apart():
    table = dedup.QuotientTable()
    same = np.array([9, 9, 9], np.uint64)
    table.insert(same, same, np.array([1, 2, 0]), np.array([1, 2, 3]), pa.array(["x", "y", "x"]), np.ones(3, bool))
    assert table.lost.tolist() == [True, False, False]


def test_table_grows_and_keeps_the_best():
    rnd = np.random.RandomState(1)
    table, seen = dedup.QuotientTable(16), {}
    for _ in range(5):
        ids = rnd.randint(0, 3000, 4000)
        order = rnd.randint(0, 50, 4000)
        lane = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        base = table.rows
        table.insert(lane, lane, order, np.arange(base, base + 4000), pa.array(ids.astype(str)), np.ones(4000, bool))
        for k, (i, o) in enumerate(zip(ids, order)):
            seen[i] = min(seen.get(i, (99, 0)), (o, base + k))
    assert sorted(np.flatnonzero(~table.lost)) == sorted(r for _, r in seen.values())
