"""Messages delivered more than once: exact quotient hash tables.

An identity of any width becomes a fixed-width identifier of 128 bits. A Feistel network permutes it,
which loses nothing, so that quotient (the top bits: the shard) and remainder (all other bits) together
are the identifier. A shard's open-addressing table stores the complete remainders and inserts each
identifier once; a found remainder is then compared by the identity's whole text, so that two identities
whose digests agree stay apart. There are no false matches.

A shard is a range of quotients; a task handles its shards one after the other, so the memory it needs is a
shard's, however few tasks there are.

Each map task first runs a table over its Arrow batch, so that of a message with a third of all rows only
one copy per batch is sent to its shard; the copies that lost are spread over all shards.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.shared import fresh, input_bytes, partitions_for

LAST = np.iinfo(np.int64).max
#: A shard's input, as files have it; its table and rows take some ten times as much.
SHARD_BYTES = 16 << 20
_U = np.uint64


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + _U(key)) * _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


ROUND_KEYS = (0x243F6A88, 0x85A308D3, 0x13198A2E, 0x03707344)


def permute(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bijection of 128-bit identifiers, given as two uint64 lanes."""
    for k in ROUND_KEYS:
        hi, lo = lo, hi ^ _mix(lo, k)
    return hi, lo


def unpermute(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    for k in reversed(ROUND_KEYS):
        hi, lo = lo ^ _mix(hi, k), hi
    return hi, lo


class QuotientTable:
    """Open addressing over complete remainders; the best copy (least order) of an identifier holds its slot.

    Remainders, order and text are kept of the rows inserted, in buffers that double; of rows that only pass
    (copies that lost before, rows without identifier) nothing but the mark is.
    """

    def __init__(self, capacity: int = 1 << 12) -> None:
        self.slots = np.full(capacity, -1, np.int64)
        self.used = self.held = self.rows = 0
        self.hi, self.lo = np.empty(capacity, np.uint64), np.empty(capacity, np.uint64)
        self.o1, self.o2, self.row = (np.empty(capacity, np.int64) for _ in range(3))
        self.texts: list[pa.Array] = []
        self.marks: list[np.ndarray] = []

    @property
    def lost(self) -> np.ndarray:
        """Of each row inserted or passed, whether a better copy of its identifier is known."""
        if len(self.marks) > 1:
            self.marks = [np.concatenate(self.marks)]
        return self.marks[0] if self.marks else np.empty(0, bool)

    def _same_text(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if len(self.texts) > 64:
            self.texts = [pa.concat_arrays([c if isinstance(c, pa.Array) else c.combine_chunks() for c in self.texts])]
        texts = pa.chunked_array(self.texts)
        return np.asarray(pc.equal(texts.take(pa.array(a)), texts.take(pa.array(b))).to_numpy(), bool)

    def _grow(self, coming: int) -> None:
        if self.held + coming > len(self.hi):
            room = 2 * (self.held + coming)
            for name in ("hi", "lo", "o1", "o2", "row"):
                old = getattr(self, name)
                new = np.empty(room, old.dtype)
                new[: self.held] = old[: self.held]
                setattr(self, name, new)
        need = 1 << max(12, int(2 * (self.used + coming)).bit_length())
        if need > len(self.slots):
            held = self.slots[self.slots >= 0]
            self.slots = np.full(need, -1, np.int64)
            home = (self.lo[held] & _U(need - 1)).astype(np.int64)
            while len(held):
                free = self.slots[home] < 0
                self.slots[home[free]] = held[free]
                rest = self.slots[home] != held
                held, home = held[rest], (home[rest] + 1) & (need - 1)

    def insert(self, hi: np.ndarray, lo: np.ndarray, o1: np.ndarray, o2: np.ndarray, text: pa.Array, active: np.ndarray) -> None:
        """Rows get the next numbers; ``active`` are those to insert."""
        first_row, some = self.rows, np.flatnonzero(active)
        self.rows += len(hi)
        lost = np.zeros(len(hi), bool)
        self._grow(len(some))
        base, end = self.held, self.held + len(some)
        for mine, given in ((self.hi, hi), (self.lo, lo), (self.o1, o1), (self.o2, o2)):
            mine[base:end] = given[some]
        self.row[base:end] = some + first_row
        self.texts.append(text.take(pa.array(some)) if len(some) < len(hi) else text)
        self.held = end
        self.marks.append(lost)
        row = np.arange(base, end)
        mask = len(self.slots) - 1
        at = (self.lo[row] & _U(mask)).astype(np.int64)
        beaten = []
        while len(row):
            cur = self.slots[at]
            empty = cur < 0
            if empty.any():
                self.slots[at[empty]] = row[empty]  # of several claims the last holds
                won = empty & (self.slots[at] == row)
                self.used += int(won.sum())
                row, at = row[~won], at[~won]
                cur = self.slots[at]
            if not len(row):
                break
            same = (self.hi[cur] == self.hi[row]) & (self.lo[cur] == self.lo[row])
            where = np.flatnonzero(same)
            if len(where):
                same[where[~self._same_text(cur[where], row[where])]] = False
            if same.any():
                slot, copy = at[same], row[same]
                held = np.unique(slot)
                slot, copy = np.concatenate([held, slot]), np.concatenate([self.slots[held], copy])
                order = np.lexsort((self.o2[copy], self.o1[copy], slot))
                slot, copy = slot[order], copy[order]
                first = np.r_[True, slot[1:] != slot[:-1]]
                self.slots[slot[first]] = copy[first]
                beaten.append(copy[~first])
            row, at = row[~same], (at[~same] + 1) & mask
        if beaten:
            self.lost[self.row[np.concatenate(beaten)]] = True


def _lane(col: pa.Array, null: int = 0) -> np.ndarray:
    if pa.types.is_timestamp(col.type):
        col = pc.cast(col, pa.int64())
    return np.asarray(pc.fill_null(col, null).to_numpy(zero_copy_only=False), np.int64)


def _texts(b: pa.RecordBatch, names: Sequence[str]) -> pa.Array:
    """The text of each identity, from columns that are text; null where the last one is."""
    if len(names) == 1:
        return b[names[0]]
    head = [x for n in names[:-1] for x in (pc.coalesce(pc.cast(pc.utf8_length(b[n]), pa.string()), pa.scalar("-")), pc.coalesce(b[n], pa.scalar("")))]
    return pc.binary_join_element_wise(*head, b[names[-1]], ":")


def identity_text(cols: Sequence[str]) -> Column:
    """One string per identity, different for different identities; null where the last column is null."""
    head = [F.concat(F.coalesce(F.length(F.col(c).cast("string")).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in cols[:-1]]
    return F.concat(*head, F.col(cols[-1]).cast("string")) if head else F.col(cols[-1]).cast("string")


def mark_copies(df: DataFrame, id_cols: Sequence[str], order_time: str, order_id: str, *, out: str = "is_copy", partitions: int | None = None, shards_each: int | None = None) -> DataFrame:
    """``df`` with a column ``out``: true for every copy of a message but the one to keep.

    A message is identified by ``id_cols`` together. Null in the last of them: each such row is its own
    message and is kept; null in another is a value like any other. Kept is the copy with the earliest
    ``order_time`` (null last), then the smallest ``order_id`` (null last; among full ties any one).
    All rows come out, none twice. Any further columns pass through whatever they are called; an empty
    table gives an empty table. ``order_time`` may be a timestamp or a number. Shards are made for about
    ``SHARD_BYTES`` of input each; ``partitions`` and ``shards_each`` set their numbers by hand.
    """
    cols = df.columns
    h1, h2 = (fresh(x, cols, [out]) for x in ("q_h1", "q_h2"))
    n = partitions or partitions_for(df, SHARD_BYTES, most=20_000)
    each = shards_each or max(1, -(-input_bytes(df) // (n * SHARD_BYTES)) if not partitions else 1)
    shards = n * each
    # only what the rows don't have already is sent beside them: text of other types, times as numbers, digests
    sent = {c: fresh(f"q_id{i}", cols, [out]) for i, c in enumerate(id_cols) if not isinstance(df.schema[c].dataType, T.StringType)}
    names = [sent.get(c, c) for c in id_cols]
    ranks = {c: fresh(f"q_o{i}", cols, [out]) for i, c in enumerate((order_time, order_id)) if not isinstance(df.schema[c].dataType, (T.TimestampType, T.LongType))}
    o1, o2 = (ranks.get(c, c) for c in (order_time, order_id))
    text = identity_text(id_cols)
    keyed = df.withColumns({**{a: F.col(c).cast("string") for c, a in sent.items()}, **{a: F.col(c).cast("long") for c, a in ranks.items()}, h1: F.xxhash64(text), h2: F.xxhash64(F.lit(1), text)})
    shard, lost = fresh("q_shard", cols, [out]), out
    mid = T.StructType([*keyed.schema.fields, T.StructField(shard, T.IntegerType()), T.StructField(lost, T.BooleanType())])
    final = T.StructType([*df.schema.fields, T.StructField(lost, T.BooleanType())])

    def lanes(b: pa.RecordBatch) -> tuple:
        hi, lo = _lane(b[h1]).view(np.uint64), _lane(b[h2]).view(np.uint64)
        return *permute(hi, lo), _lane(b[o1], LAST), _lane(b[o2], LAST), _texts(b, names)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = 0
        for b in batches:
            hi, lo, a, c, t = lanes(b)
            table = QuotientTable()
            known = np.asarray(t.is_valid())
            table.insert(hi, lo, a, c, t, known)
            to = ((hi >> _U(32)) * _U(shards) >> _U(32)).astype(np.int32)  # the quotient
            free = table.lost | ~known
            to[free] = (np.arange(int(free.sum())) + spread + int(a[0] if len(a) else 0)) % shards
            spread += int(free.sum())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(to), pa.array(table.lost)], names=[*b.schema.names, shard, lost])

    def flagged(table: QuotientTable, held: list) -> Iterator[pa.RecordBatch]:
        at = 0
        for b, before in held:
            flags = table.lost[at : at + len(before)] | before
            at += len(before)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(flags)], names=[*cols, lost])

    def sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table, held = None, QuotientTable(), []
        for whole in batches:
            to = _lane(whole[shard])
            cuts = np.flatnonzero(np.diff(to)) + 1 if each > 1 else []
            for start, end in zip([0, *cuts], [*cuts, len(to)]):
                if each > 1 and end > start and to[start] != now:
                    yield from flagged(table, held)
                    now, table, held = to[start], QuotientTable(), []
                b = whole.slice(start, end - start)
                hi, lo, a, c, t = lanes(b)
                before = np.asarray(b[lost].to_numpy(zero_copy_only=False), bool)
                table.insert(hi, lo, a, c, t, np.asarray(t.is_valid()) & ~before)
                held.append((b.select(cols), before))
        yield from flagged(table, held)

    routed = keyed.mapInArrow(local, mid).repartitionById(n, (F.col(shard) / each).cast("int"))
    return (routed.sortWithinPartitions(shard) if each > 1 else routed).mapInArrow(sharded, final)


def kept_once(df: DataFrame, id_cols: Sequence[str], order_time: str, order_id: str, **kw) -> DataFrame:
    """Exactly one copy of each message (see :func:`mark_copies`), with the columns of ``df``."""
    out = fresh("is_copy", df.columns)
    return mark_copies(df, id_cols, order_time, order_id, out=out, **kw).where(~F.col(out)).drop(out)


def extra_copies(df: DataFrame, id_cols: Sequence[str], order_time: str, order_id: str, **kw) -> DataFrame:
    """The copies that :func:`kept_once` leaves out."""
    out = fresh("is_copy", df.columns)
    return mark_copies(df, id_cols, order_time, order_id, out=out, **kw).where(F.col(out)).drop(out)
