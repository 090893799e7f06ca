"""Change feed against brute force in any order; publication."""

import random

from tidewatch.operators import cdc

SCHEMA = "aggregate_id string, pane_index int, change_id long, op string, deleted string, c_bucket int, at timestamp"


def brute(rows):
    best = {}
    for r in rows:
        if r[0] is None:
            continue
        order = (-(2**63) if r[1] is None else r[1], -(2**63) if r[2] is None else r[2])
        if r[0] not in best or order > best[r[0]][0]:
            best[r[0]] = (order, r)
    return best


def test_any_order_and_repetition(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([None, "hot", "hot", *[f"k{i}" for i in range(300)]]), rnd.choice([None, 0, 1, 2, 3]), c, rnd.choice(["insert", "U", " update", "D", "DELETE ", "delete", None, "x"]), "mine", 3, None) for c in range(4000)]
    want = {k: (r[2], (r[3] or "").strip().lower() in ("d", "delete")) for k, (_, r) in brute(rows).items()}
    for seed in (0, 1):
        shuffled = rows + rnd.sample(rows, 500)
        random.Random(seed).shuffle(shuffled)
        df = spark.createDataFrame(shuffled, SCHEMA).repartition(3 + seed)
        out = cdc.apply_changes(df, "aggregate_id", ("pane_index", "change_id"), "op", buckets=3)
        assert out.columns == [*df.columns, "_deleted"]
        assert {r.aggregate_id: (r.change_id, r["_deleted"]) for r in out.collect()} == want


def test_late_older_change_does_not_bring_back(spark):
    rows = [("k", 2, 5, "delete", "", 0, None), ("k", 1, 9, "update", "", 0, None)]
    out = cdc.apply_changes(spark.createDataFrame(rows, SCHEMA), "aggregate_id", ("pane_index", "change_id"), "op").collect()
    assert [(r.change_id, r["_deleted"]) for r in out] == [(5, True)]


def test_empty_feed(spark):
    assert cdc.apply_changes(spark.createDataFrame([], SCHEMA), "aggregate_id", ("pane_index",), "op").collect() == []


def test_publication_switches_whole(spark, tmp_path):
    root = f"file://{tmp_path}"
    cdc.publish(spark.range(3), root, "t")
    first = cdc.read_published(spark, root, "t")
    cdc.publish(spark.range(5), root, "t")
    assert first.count() == 3 and cdc.read_published(spark, root, "t").count() == 5
    assert cdc.vacuum(spark, root, "t") == 1 and cdc.read_published(spark, root, "t").count() == 5
