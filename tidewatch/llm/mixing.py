"""Mixing sources to target weights by entropy balancing.

Each document gets a rate, its expected number of copies. The rates stay as close as possible, in entropy,
to one copy of every document, while each source's tokens times rates add up to its share. The solution
tilts exponentially, ``min(cap, exp(lambda * tokens / mean))`` with one multiplier per source, which
distributed Newton steps on the convex dual find: each step is one sum per source. Rates are then rounded
into whole copies by a hash of the document, with a threshold per source that makes the totals fit.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.shared import written

#: Sources with a target are gathered on the driver; more than these are refused.
MOST_SOURCES = 10_000
BINS = 4_096


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where a public tokenizer's ranks lie on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _encoder(path: str, pattern: str | None):
    import tiktoken

    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, path: str, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", pattern: str | None = None) -> DataFrame:
    """``doc_id``, ``source``, ``tokens`` of each document; null and empty texts have 0."""
    named = documents.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    out = T.StructType([named.schema["doc_id"], named.schema["source"], T.StructField("tokens", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for b in batches:
            encode = encode or _encoder(path, pattern).encode_ordinary
            n = [len(encode(t.as_py())) if t.is_valid else 0 for t in b["text"]]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["source"], pa.array(n, pa.int64())], names=out.names)

    return named.mapInArrow(count, out)


def _plan(sizes: DataFrame, targets: DataFrame, total: int | None) -> dict[str, dict]:
    """Per source that can be mixed: its wanted tokens, cap and mean size."""
    rows = targets.limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources have a target")
    goal = {r.source: (r.target_share, r.max_repeats) for r in rows if r.source is not None and (r.target_share or 0) > 0 and (r.max_repeats or 0) > 0}
    if not goal:
        return {}
    have = sizes.where(F.col("source").isin(*goal)).groupBy("source").agg(F.sum("tokens").alias("tokens"), F.avg(F.when(F.col("tokens") > 0, F.col("tokens"))).alias("mean")).collect()
    have = {r.source: r for r in have if r.tokens}
    shares = sum(goal[s][0] for s in have)
    plan = {s: {"share": goal[s][0] / shares, "cap": float(goal[s][1]), "tokens": float(r.tokens), "mean": float(r["mean"])} for s, r in have.items()}
    most = min((p["cap"] * p["tokens"] / p["share"] for p in plan.values()), default=0.0)
    size = most if total is None else min(float(total), most)
    for p in plan.values():
        p |= {"wanted": p["share"] * size, "full": p["share"] * size >= p["cap"] * p["tokens"] * (1 - 1e-12)}
    return plan


def _rate(column: str = "lam"):
    tilt = F.exp(F.least(F.lit(60.0), F.col(column) * F.col("tokens") / F.col("mean")))
    return F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), tilt))


def _with(sizes: DataFrame, plan: dict[str, dict], field: str, values: dict[str, float]) -> DataFrame:
    """Sizes of the mixed sources with their plan; the plan has at most ``MOST_SOURCES`` rows."""
    rows = [(s, p["cap"], p["mean"], p["full"], p["wanted"], float(values[s])) for s, p in plan.items()]
    small = sizes.sparkSession.createDataFrame(rows, f"p_source string, cap double, mean double, full boolean, wanted double, {field} double")
    return sizes.select("doc_id", "source", "tokens").join(F.broadcast(small), F.col("source") == F.col("p_source")).drop("p_source")


def multipliers(sizes: DataFrame, plan: dict[str, dict], *, tolerance: float = 1e-7, rounds: int = 300) -> dict[str, float]:
    """The dual's solution: Newton steps, kept inside a bracket by bisection, for all sources at once.

    The brackets halve, so the steps end; if they haven't after ``rounds``, the call fails and says for which sources.
    """
    lam = {s: 0.0 for s in plan}
    low, high = {s: -math.inf for s in plan}, {s: math.inf for s in plan}
    todo = {s for s, p in plan.items() if not p["full"]}
    for _ in range(rounds):
        if not todo:
            break
        now = {s: plan[s] for s in todo}
        rate = _rate()
        x = F.col("tokens") / F.col("mean")
        sums = _with(sizes, now, "lam", lam).groupBy("source").agg(F.sum(rate * F.col("tokens")).alias("mass"), F.sum(F.when(rate < F.col("cap"), rate * x * F.col("tokens")).otherwise(0.0)).alias("slope")).collect()
        for r in sums:
            s, gap = r.source, r.mass - plan[r.source]["wanted"]
            if abs(gap) <= tolerance * plan[s]["wanted"]:
                todo.discard(s)
                continue
            if gap > 0:
                high[s] = lam[s]
            else:
                low[s] = lam[s]
            step = lam[s] - gap / r.slope if r.slope > 0 else math.nan
            if not low[s] < step < high[s]:
                step = (low[s] + high[s]) / 2 if math.isfinite(low[s]) and math.isfinite(high[s]) else (2 * low[s] if low[s] > 0 else low[s] + 1.0) if math.isfinite(low[s]) else (2 * high[s] if high[s] < 0 else high[s] - 1.0)
            lam[s] = step
    if todo:
        raise RuntimeError(f"no multiplier within {tolerance} after {rounds} rounds for {sorted(todo)[:10]}")
    return lam


def mixed(sizes: DataFrame, targets: DataFrame, *, total_tokens: int | None = None, seed: int = 7) -> DataFrame:
    """``doc_id``, ``source``, ``tokens``, ``copies`` (1 or more) of the documents chosen.

    ``sizes`` has ``doc_id``, ``source``, ``tokens`` and should be a written table, as it is read once a
    step; ``targets`` has ``source``, ``target_share``, ``max_repeats``. Sources without documents can't
    have their share: the others' shares are raised in proportion. Documents of a null source, of one
    without a target, and empty ones are not chosen. The total is the largest that no cap forbids, or
    ``total_tokens`` if that is less. No document is used more than ``max_repeats`` times; equal documents
    are documents of their own. Without targets or documents nothing is chosen.
    """
    plan = _plan(sizes, targets, total_tokens)
    if not plan:
        return sizes.where("false").select("doc_id", "source", "tokens", F.lit(0).alias("copies"))
    lam = multipliers(sizes, plan)
    rated = _with(sizes.where("tokens > 0"), plan, "lam", lam).withColumn("rate", _rate())
    base = F.floor(F.col("rate")).cast("int")
    chance = F.col("rate") - base
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11).cast("double") / F.lit(float(1 << 53))
    # below the threshold, a half in expectation, a document has one copy more than its whole part
    drawn = rated.withColumns({"base": base, "at": F.when(chance > 0, uniform / (uniform + chance))})
    bins = F.floor(F.col("at") * BINS).cast("int")
    by_bin = drawn.groupBy("source", bins.alias("bin")).agg(F.sum(F.col("base") * F.col("tokens")).alias("sure"), F.sum("tokens").alias("more"), F.max("wanted").alias("wanted"))
    thresholds = _thresholds(by_bin)
    chosen = drawn.join(F.broadcast(thresholds), F.col("source") == F.col("t_source"))
    copies = (F.col("base") + F.coalesce((F.col("at") < F.col("threshold")).cast("int"), F.lit(0))).cast("int")
    return chosen.select("doc_id", "source", "tokens", copies.alias("copies")).where("copies > 0")


def _thresholds(by_bin: DataFrame) -> DataFrame:
    """Per source the edge of a bin at which the tokens come closest to what is wanted; one row per source with a target."""
    w = Window.partitionBy("source")
    all_sure = F.sum("sure").over(w)
    upto = F.sum(F.when(F.col("bin").isNotNull(), F.col("more")).otherwise(0)).over(w.orderBy(F.col("bin").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    off = F.abs(all_sure + upto - F.col("wanted"))
    edge = F.coalesce((F.col("bin") + 1) / F.lit(BINS), F.lit(0.0))
    none = F.struct(F.abs(F.col("all_sure") - F.col("wanted")).alias("off"), F.lit(0.0).alias("edge"))
    lines = by_bin.select("source", "wanted", all_sure.alias("all_sure"), F.struct(off.alias("off"), edge.alias("edge")).alias("one"))
    best = lines.groupBy("source").agg(F.min("one").alias("one"), F.min(none).alias("none"))
    return best.select(F.col("source").alias("t_source"), F.least("one", "none").getField("edge").alias("threshold"))


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """``source``, ``target_share``, ``max_repeats``, ``documents``, ``copies``, ``tokens``, ``actual_share`` per target."""
    got = chosen.groupBy(F.col("source").alias("g_source")).agg(F.count("*").alias("documents"), F.sum("copies").cast("long").alias("copies"), F.sum(F.col("copies") * F.col("tokens")).cast("long").alias("tokens"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    joined = targets.join(got, targets["source"] == got["g_source"], "left").select("source", "target_share", "max_repeats", zero("documents"), zero("copies"), zero("tokens"))
    every = joined.withColumn("all", F.sum("tokens").over(Window.partitionBy(F.lit(1))))  # at most a row per source with a target
    return every.select("source", "target_share", "max_repeats", "documents", "copies", "tokens", F.coalesce(F.try_divide(F.col("tokens"), F.col("all")), F.lit(0.0)).alias("actual_share"))


def mix_documents(documents: DataFrame, targets: DataFrame, path: str, **kw) -> DataFrame:
    """:func:`mixed` of documents whose tokens are counted first."""
    return mixed(written(token_counts(documents, path), "mix-sizes"), targets, **kw)
