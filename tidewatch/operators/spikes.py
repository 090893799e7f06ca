"""Implausible measurements per source: spikes, stuck values, physically impossible readings.

Spikes: a Hampel filter. A reading is a candidate if it is far from the rolling median just before it and
from the one just after it, measured in median absolute deviations and in the source's usual scatter, which
a first pass over all its readings finds: quantiles of each block's deviations, put together per source.
A candidate whose level the source also reports elsewhere nearby is a normal operating state, no spike.
Stuck: runs of equal values, found by run-length detection. Impossible: outside the stream's bounds.

A source's readings are cut into blocks of time, so that a source with a third of all rows spreads over
tasks; a block also sees its neighbours' nearest readings, which the rolling windows never leave. Runs of
equal values that meet at a block's edge are put together afterwards from each block's first and last run.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.late import finite
from tidewatch.shared import partitions_for, written

SPIKE, STUCK, EDGE = 1, 2, 4
MAD = 1.4826
CHUNK = 150_000
#: Scatters of at most so many sources are broadcast; more would take the driver's memory.
MOST_SOURCES = 10_000


def _row_median(m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Lower median of the first ``n`` sorted entries of each row; missing entries are +inf."""
    m = np.sort(m, axis=1)
    return m[np.arange(len(m)), np.maximum((n - 1) // 2, 0)]


def _side(v: np.ndarray, group: np.ndarray, t: np.ndarray, k: int, step: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Median, MAD and count of the ``k`` readings on one side (``step`` -1 or 1) within ``reach``."""
    n = len(v)
    near = np.full((n, k), np.inf)
    for j in range(1, min(k, n - 1) + 1):
        a, b = (slice(j, n), slice(0, n - j)) if step < 0 else (slice(0, n - j), slice(j, n))
        ok = (group[a] == group[b]) & (np.abs(t[a] - t[b]) <= reach)
        near[a, j - 1] = np.where(ok, v[b], np.inf)
    count = np.isfinite(near).sum(axis=1)
    med = _row_median(near, count)
    dev = np.abs(near - np.where(count > 0, med, 0.0)[:, None])
    return med, _row_median(dev, count), count


def _by_group(x: np.ndarray, group: np.ndarray, groups: int, share: float = 0.0, from_top: int = 0) -> np.ndarray:
    """Per group the value at a share of its ascending order, or ``from_top`` places from its end (-inf if it has fewer)."""
    order = np.lexsort((x, group))
    size = np.bincount(group, minlength=groups)
    start = np.r_[0, np.cumsum(size)[:-1]]
    at = start + (size - 1 - from_top if from_top else ((size - 1) * share).astype(np.int64))
    ok = (at >= start) & (size > 0)
    return np.where(ok, x[order][np.clip(at, 0, max(len(x) - 1, 0))] if len(x) else -np.inf, -np.inf)


def deviations(v: np.ndarray, group: np.ndarray, t: np.ndarray, *, side: int = 7, reach: int = 1_800_000_000) -> np.ndarray:
    """The MAD of the ``side`` readings before each one, as :func:`spikes` has it; NaN where fewer than three are within ``reach``."""
    with np.errstate(invalid="ignore", over="ignore"):
        _, db, nb = _side(v, group, t, side, -1, reach)
    return np.where(nb >= 3, db, np.nan)


def spikes(v: np.ndarray, group: np.ndarray, t: np.ndarray, scatter: np.ndarray, *, side: int = 7, factor: float = 4.0, reach: int = 1_800_000_000, around: int = 150, own: int = 4, usual: int = 4, alike: float = 0.1, switches: int = 4) -> np.ndarray:
    """Which readings are spikes; ``group`` numbers blocks of sources from 0 in order, each sorted by ``t`` (microseconds).

    ``side`` readings before and after, no farther than ``reach``, make the two rolling windows. A candidate
    lies more than ``factor`` scatters from both medians; the scatter is the larger of the window's MAD and
    the source's usual one, ``scatter`` (per reading, as a MAD), which :func:`suspicious` takes from the 9th
    decile of all its windows' MADs, as an operating state can be noisier than another. Where the source
    switches states, having made two or more lasting moves at least half as far within this block, a
    candidate is a normal state if at least ``usual`` readings among the ``around`` on either side, the
    ``own`` next ones left out, lie within ``alike`` of its distance from the medians; after ``switches``
    such moves, if that many of the block's readings do. Moves and levels are a block's, a day's by
    default: what a source did weeks ago says little about whether it switches now.
    """
    n = len(v)
    if not n:
        return np.zeros(0, bool)
    with np.errstate(invalid="ignore", over="ignore"):
        mb, db, nb = _side(v, group, t, side, -1, reach)
        ma, da, na = _side(v, group, t, side, 1, reach)
        groups = int(group[-1]) + 1
        typical = scatter * MAD
        tiny = 1e-9 * np.abs(v) + 1e-12
        before, after = np.abs(v - mb), np.abs(v - ma)
        far_b = before > np.maximum(np.maximum(factor * MAD * db, factor * typical), tiny)
        far_a = after > np.maximum(np.maximum(factor * MAD * da, factor * typical), tiny)
        # at a series' end the one side there is decides
        hit = np.flatnonzero(np.where(nb >= 3, far_b, na >= 3) & np.where(na >= 3, far_a, nb >= 3))
        off = np.minimum(np.where(nb >= 3, before, np.inf), np.where(na >= 3, after, np.inf))[hit]
    rest = np.ones(n, bool)
    rest[hit] = False
    lasting = np.flatnonzero(rest[1:] & rest[:-1] & (group[1:] == group[:-1]) & (np.diff(t) <= reach // 6))
    sizes = np.abs(np.diff(v))[lasting]
    some, many = (_by_group(sizes, group[lasting], groups, from_top=k - 1) for k in (2, switches))
    at = np.flatnonzero(rest)
    order = np.lexsort((v[at], group[at]))
    level, ends = v[at][order], np.r_[0, np.cumsum(np.bincount(group[at], minlength=groups))]
    out = np.zeros(n, bool)
    out[hit] = True
    near = np.maximum(alike * off, 2 * typical[hit])
    shift = np.r_[np.arange(-around, -own), np.arange(own + 1, around + 1)]
    moving = np.flatnonzero(off <= 2 * some[group[hit]])
    for lo in range(0, len(moving), 4096):
        m = moving[lo : lo + 4096]
        i = hit[m]
        j = i[:, None] + shift
        ok = (j >= 0) & (j < n)
        j = np.clip(j, 0, n - 1)
        ok &= (group[j] == group[i][:, None]) & (np.abs(t[j] - t[i][:, None]) <= 2 * reach)
        out[i] = (ok & (np.abs(v[j] - v[i][:, None]) <= near[m][:, None])).sum(axis=1) < usual
    for m in moving:
        i = hit[m]
        if out[i] and off[m] <= 2 * many[group[i]]:
            mine = level[ends[group[i]] : ends[group[i] + 1]]
            out[i] = np.searchsorted(mine, v[i] + near[m], "right") - np.searchsorted(mine, v[i] - near[m], "left") < usual
    return out


def run_lengths(v: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and length of the run of equal values each reading belongs to."""
    new = np.r_[True, (v[1:] != v[:-1]) | (group[1:] != group[:-1])] if len(v) else np.zeros(0, bool)
    run = np.cumsum(new) - 1
    return run, np.bincount(run, minlength=1)[run] if len(v) else run


def suspicious(kept: DataFrame, keys: Sequence[str], time: str, value: str, ident: str, *, carry: Sequence[str] = (), run: int = 10, block_seconds: int = 86_400, halo_seconds: int = 3_600, partitions: int | None = None, sources: int | None = None) -> DataFrame:
    """The spikes and stuck readings of ``kept``: ``keys``, ``carry``, ``value``, ``ident`` and ``spike``, ``stuck``.

    Readings are ordered by ``time``, ties by ``ident``. Values that aren't finite are no readings, and so
    are rows without a time; null keys are a source of their own; a source with fewer than three readings
    nearby has no spikes. Every reading comes out at most once. ``halo_seconds`` must be at least twice
    the reach of the windows, which is 1,800 seconds. ``sources`` is a bound on the number of sources, if one
    is known: up to ``MOST_SOURCES`` their scatters, a number each, are broadcast. Else each goes to the
    partitions of its source's blocks, and the driver holds nothing that grows with the input.
    """
    k, cs = [f"k{i}" for i in range(len(keys))], [f"c{i}" for i in range(len(carry))]
    us = F.unix_micros(time)
    block, halo = F.lit(block_seconds * 1_000_000), F.lit(halo_seconds * 1_000_000)
    own = F.floor(us / block).cast("long")
    inside = F.pmod(us, block)
    named = kept.where(finite(value) & F.col(time).isNotNull()).select(*[F.col(c).alias(a) for c, a in zip([*keys, *carry], [*k, *cs])], F.col(ident).cast("long").alias("id"), F.col(value).cast("double").alias("v"), us.alias("t"), own.alias("own"), F.when(inside <= halo, own - 1).alias("prev"), F.when(block - inside <= halo, own + 1).alias("next"))
    each = named.withColumn("block", F.explode(F.array_compact(F.array("own", "prev", "next")))).select(*k, *cs, "id", "v", "t", "block", (F.col("block") == F.col("own")).alias("core"))
    n = partitions or partitions_for(kept)
    # by one value that is never null: a join on it finds the rows where they are, as it doesn't with null-safe keys
    source = F.struct(*k)
    parted = each.repartition(n, source, "block")
    ordered = lambda df: df.sortWithinPartitions(*k, "block", "t", "id")
    flag, edge, length = T.StructField("flag", T.IntegerType()), T.StructField("edge", T.IntegerType()), T.StructField("length", T.IntegerType())
    out = T.StructType([*[each.schema[c] for c in [*k, *cs, "id", "v", "block"]], flag, edge, length])

    def starts(b: pa.Table) -> np.ndarray:
        new = np.zeros(b.num_rows, bool)
        new[:1] = True
        for c in [*k, "block"]:
            col = b[c].combine_chunks()
            a, z = col.slice(1), col.slice(0, len(col) - 1)
            differs = pc.or_kleene(pc.fill_null(pc.not_equal(a, z), False), pc.xor(pc.is_null(a), pc.is_null(z)))
            new[1:] |= np.asarray(differs.to_numpy(zero_copy_only=False), bool)
        return new

    def judge(b: pa.Table, new: np.ndarray) -> pa.Table:
        group = np.cumsum(new) - 1
        v, t = b["v"].to_numpy(), b["t"].to_numpy()
        core = np.asarray(b["core"].to_numpy(), bool)
        flags = np.where(spikes(v, group, t, b["scatter"].to_numpy()) & core, SPIKE, 0)
        at = np.flatnonzero(core)
        r, size = run_lengths(v[at], group[at])
        flags[at[size >= run]] |= STUCK
        edges, lengths = np.full(len(v), -1), np.zeros(len(v), np.int64)
        if len(at):
            g = group[at]
            first_run = r[np.flatnonzero(np.r_[True, g[1:] != g[:-1]])]
            last_run = r[np.flatnonzero(np.r_[g[1:] != g[:-1], True])]
            ordinal = np.cumsum(np.r_[True, g[1:] != g[:-1]]) - 1
            is_first, is_last = r == first_run[ordinal], r == last_run[ordinal]
            head = np.r_[True, r[1:] != r[:-1]]
            here = (is_first | is_last) & ((size < run) | head)  # of a run that is stuck already one row stands for all
            edges[at[here]] = np.where(is_first & is_last, 2, np.where(is_first, 0, 1))[here]
            lengths[at[here]] = size[here]
            flags[at[here]] |= EDGE
        keep = np.flatnonzero(flags)
        rows = b.select([*k, *cs, "id", "v", "block"]).take(pa.array(keep))
        return rows.append_column("flag", pa.array(flags[keep], pa.int32())).append_column("edge", pa.array(edges[keep], pa.int32())).append_column("length", pa.array(lengths[keep], pa.int32()))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
        """Whole blocks, many at a time, with where each starts."""
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size < CHUNK:
                continue
            t = pa.Table.from_batches(held)
            new = starts(t)
            cut = int(np.flatnonzero(new)[-1])  # the last block may go on in the next batch
            if cut:
                yield t.slice(0, cut), new[:cut]
            held, size = t.slice(cut).to_batches(), t.num_rows - cut
        if size:
            t = pa.Table.from_batches(held)
            yield t, starts(t)

    def scatters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, new in blocks(batches):
            group = np.cumsum(new) - 1
            d = deviations(b["v"].to_numpy(), group, b["t"].to_numpy())
            use = np.asarray(b["core"].to_numpy(), bool) & ~np.isnan(d)
            at, mads, weights = _points(d[use], group[use])
            bare = np.setdiff1d(np.arange(int(new.sum())), at)  # blocks without a scatter of their own are told the source's too
            at, mads, weights = np.r_[at, bare], np.r_[mads, np.full(len(bare), np.nan)], np.r_[weights, np.zeros(len(bare), np.int64)]
            first = b.select([*k, "block"]).take(pa.array(np.flatnonzero(new)[at]))
            yield from first.append_column("mad", pa.array(mads, from_pandas=True)).append_column("weight", pa.array(weights)).to_batches()

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, new in blocks(batches):
            yield from judge(b, new).to_batches()

    points = T.StructType([*[each.schema[c] for c in k], T.StructField("u_block", T.LongType()), T.StructField("mad", T.DoubleType()), T.StructField("weight", T.LongType())])
    usual = ordered(parted).mapInArrow(scatters, points).groupBy(*k).agg(F.expr("coalesce(percentile(mad, 0.9, weight), 0.0D)").alias("scatter"), F.collect_set("u_block").alias("u_blocks"))
    if sources is not None and sources <= MOST_SOURCES:
        usual, same = F.broadcast(usual.select(source.alias("u_source"), "scatter")), source == F.col("u_source")
    else:
        usual, same = usual.select(source.alias("u_source"), F.explode("u_blocks").alias("u_block"), "scatter").hint("shuffle_hash"), (source == F.col("u_source")) & (F.col("block") == F.col("u_block"))
    told = parted.join(usual, same, "left").drop("u_source", "u_block")  # sorted after it: Catalyst drops a sort below a join
    # read twice, for the runs at the blocks' edges: written, so that it isn't made twice
    seen = written(ordered(told).mapInArrow(judged, out), "seen-readings")
    return _stitched(seen, k, cs, run).select(*[F.col(a).alias(c) for c, a in zip([*keys, *carry], [*k, *cs])], F.col("v").alias(value), F.col("id").alias(ident), "spike", "stuck")


def _points(x: np.ndarray, group: np.ndarray, most: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Up to ``most`` even quantiles of each group's values: group, value, and how many values each stands for."""
    if not len(x):
        return np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
    order = np.lexsort((x, group))
    x, group = x[order], group[order]
    begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[begin, len(x)])
    points = np.minimum(size, most)
    at = np.repeat(np.arange(len(begin)), points)
    i = np.arange(len(at)) - np.repeat(np.cumsum(points) - points, points)
    rank = -(-(i + 1) * size[at] // points[at])
    before = -(-i * size[at] // points[at])
    return group[begin][at], x[begin[at] + rank - 1], rank - before


def _stitched(seen: DataFrame, k: list[str], cs: list[str], run: int) -> DataFrame:
    """Judge the runs at the blocks' edges; one row per reading that is a spike or stuck."""
    by_source = Window.partitionBy(*k).orderBy("block", "edge")
    edge = F.col("flag").bitwiseAND(EDGE) != 0
    runs = seen.where(edge).groupBy(*k, "block", "edge").agg(F.first("v").alias("v"), F.max("length").alias("length"))
    before = {"b_v": F.lag("v").over(by_source), "b_edge": F.lag("edge").over(by_source)}
    goes_on = F.col("edge").isin(0, 2) & F.col("b_edge").isin(1, 2) & (F.col("b_v") == F.col("v"))
    island = F.sum((~F.coalesce(goes_on, F.lit(False))).cast("int")).over(by_source.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("length").over(Window.partitionBy(*k, "island"))
    long = runs.withColumns(before).withColumn("island", island).withColumn("total", total).where(F.col("total") >= run).select(*[F.col(c).alias("l_" + c) for c in [*k, "block", "edge"]])
    on = [F.col(c).eqNullSafe(F.col("l_" + c)) for c in [*k, "block", "edge"]]
    judged = seen.join(long.hint("merge"), on, "left")  # estimates of packed files are no measure for a broadcast
    flag = lambda bit: F.col("flag").bitwiseAND(bit) != 0
    marked = judged.withColumns({"spike": flag(SPIKE), "stuck": flag(STUCK) | F.col("l_block").isNotNull()})
    return marked.where("spike OR stuck").select(*k, *cs, "v", "id", "spike", "stuck")


def out_of_bounds(deliveries: DataFrame, bounds: DataFrame, stream: str, value: str, low: str = "phys_min", high: str = "phys_max") -> DataFrame:
    """Deliveries with a finite value outside their stream's bounds (both ends are inside).

    A stream without a row in ``bounds``, or with a null bound, has no limit on that side.
    """
    b = bounds.groupBy(F.col(stream).alias("b_stream")).agg(F.max(low).alias("b_low"), F.min(high).alias("b_high"))
    joined = deliveries.where(finite(value)).join(b, F.col(stream) == F.col("b_stream"))
    return joined.where((F.col(value) < F.col("b_low")) | (F.col(value) > F.col("b_high"))).drop("b_stream", "b_low", "b_high")
