"""Evaluation texts leaking into training text: Wu-Manber search for many word patterns at once.

Texts are folded into words and words into numbers; the patterns are all windows of ``window`` words of the
items. A shift table over blocks of words says how far a position can move without missing a pattern;
where it says nothing, the block's suffix bucket names the patterns that end so, and the words are compared
directly. Occurrences are then extended on both sides, word by word as folded (a stroke may be repeated), and
a document leaks an item if a run of at least ``least`` consecutive words of the item comes out. Every text is searched whole; long ones are cut into
overlapping stretches only to move many cursors side by side.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.subtitles import fold, words

BLOCK = 3
TABLE_BITS = 20
STRETCH = 256
#: Items are searched in blocks of at most so many characters: what is sent to every task is bounded.
ITEM_CHARS = 4_000_000
BLOCKS_A_PASS = 16
#: Bytes of documents that are searched for one block before the next is unpacked.
HELD_CHARS = 32 << 20


def _block_hash(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = (a.astype(np.uint64) * np.uint64(0x9E3779B1) + b.astype(np.uint64)) * np.uint64(0x85EBCA77) + c.astype(np.uint64)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


class Patterns:
    """Shift table, suffix buckets and words of a block of items."""

    def __init__(self, items: Sequence[tuple[int, str]], window: int) -> None:
        self.window, self.ids = window, [i for i, _ in items]
        self.vocabulary: dict[str, int] = {}
        self.item_words: list[list[str]] = []
        self.item_place: list[np.ndarray] = []  # a folded word's place among the item's words as written
        flat, starts = [], [0]
        for _, text in items:
            folded, place = [], []
            for k, w in enumerate(re.split(r"\s+", (text or "").strip())):
                for piece in fold(w).split():
                    folded.append(piece)
                    place.append(k)
            self.item_words.append(folded)
            self.item_place.append(np.array(place, np.int64))
            flat += [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in folded]
            starts.append(len(flat))
        self.flat, self.starts = np.array(flat, np.int64), np.array(starts, np.int64)
        self.item_of = np.repeat(np.arange(len(items)), np.diff(self.starts))
        where = np.arange(len(flat))
        room = self.starts[self.item_of + 1] - where if len(flat) else where
        begin = where[room >= window]  # every window of every item
        self.shift = np.full(1 << TABLE_BITS, window - BLOCK + 1, np.int8)
        for q in range(BLOCK - 1, window):
            at = begin + q
            h = _block_hash(self.flat[at - 2], self.flat[at - 1], self.flat[at])
            np.minimum.at(self.shift, h, np.int8(window - 1 - q))
        last = begin + window - 1
        h = _block_hash(self.flat[last - 2], self.flat[last - 1], self.flat[last])
        order = np.argsort(h, kind="stable")
        self.bucket_hash, self.bucket_start = np.unique(h[order], return_index=True)
        self.bucket_end = np.r_[self.bucket_start[1:], len(order)]
        self.bucket = begin[order]

    def occurrences(self, ids: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start in ``ids`` and start in ``flat`` of each occurrence in the stretches ``first:end``."""
        w, stops = self.window, []
        pos, lane_end = first + w - 1, end
        live = pos < lane_end
        pos, lane_end = pos[live], lane_end[live]
        while len(pos):
            s = self.shift[_block_hash(ids[pos - 2], ids[pos - 1], ids[pos])]
            stops.append(pos[s == 0])
            pos = pos + np.maximum(s, 1)
            live = pos < lane_end
            if not live.all():
                pos, lane_end = pos[live], lane_end[live]
        at = np.concatenate(stops) if stops else np.empty(0, np.int64)
        if not len(at) or not len(self.bucket):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        h = _block_hash(ids[at - 2], ids[at - 1], ids[at])
        b = np.minimum(np.searchsorted(self.bucket_hash, h), len(self.bucket_hash) - 1)
        known = self.bucket_hash[b] == h
        at, b = at[known] - (w - 1), b[known]
        size = self.bucket_end[b] - self.bucket_start[b]
        text = np.repeat(at, size)
        inner = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
        pattern = self.bucket[np.repeat(self.bucket_start[b], size) + inner]
        for k in (0, w - 1, *range(1, w - 1)):
            same = ids[text + k] == self.flat[pattern + k]
            text, pattern = text[same], pattern[same]
        return text, pattern


REPEATED = re.compile(r"(.)\1+")


def near(a: str, b: str) -> bool:
    """Whether one folded word can stand for the other: they differ only in how often a stroke is repeated."""
    return a == b or (a[:1] == b[:1] and abs(len(a) - len(b)) <= 2 and REPEATED.sub(r"\1", a) == REPEATED.sub(r"\1", b))


def _longest(p: Patterns, item: int, doc: list[str], offset: int, seed: int) -> int:
    """Length, in the item's words as written, of the run around item position ``seed`` on the diagonal ``offset``."""
    mine, place = p.item_words[item], p.item_place[item]
    lo = seed
    while lo > 0 and 0 < lo + offset <= len(doc) and near(mine[lo - 1], doc[lo - 1 + offset]):
        lo -= 1
    hi = seed
    while hi < len(mine) and hi + offset < len(doc) and near(mine[hi], doc[hi + offset]):
        hi += 1
    return int(place[hi - 1] - place[lo]) + 1 if hi > lo else 0


def _search(p: Patterns, doc_ids: list, texts: list[str | None], least: int) -> list[tuple]:
    docs = [words(t) if t else [] for t in texts]
    get = p.vocabulary.get
    gap = [0] * p.window
    flat: list[int] = []
    begins = np.zeros(len(docs) + 1, np.int64)
    for i, d in enumerate(docs):
        flat += [get(w, 0) for w in d]
        begins[i + 1] = len(flat)
    ids = np.array(flat + gap, np.int64)
    first, end = [], []
    for i in range(len(docs)):
        a, z = int(begins[i]), int(begins[i + 1])
        for s in range(a, z, STRETCH):
            first.append(s)
            end.append(min(z, s + STRETCH + p.window - 1))
    text, pattern = p.occurrences(ids, np.array(first, np.int64), np.array(end, np.int64))
    if not len(text):
        return []
    doc = np.searchsorted(begins, text, "right") - 1
    item = p.item_of[pattern]
    here, there = text - begins[doc], pattern - p.starts[item]
    best: dict[tuple[int, int], int] = {}
    covered: dict[tuple[int, int, int], int] = {}
    for k in np.lexsort((there, here - there, item, doc)):
        d, i, offset, seed = int(doc[k]), int(item[k]), int(here[k] - there[k]), int(there[k])
        if covered.get((d, i, offset), -1) >= seed:
            continue
        n = _longest(p, i, docs[d], offset, seed)
        covered[d, i, offset] = seed + p.window
        if n >= least and n > best.get((d, i), 0):
            best[d, i] = n
    return [(doc_ids[d], p.ids[i], n) for (d, i), n in best.items()]


def leaked(documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = 15, window: int = 6) -> DataFrame:
    """``doc_id``, ``item_id``, ``run_words``: the documents that hold ``least`` or more consecutive words of an item.

    Not counted are letter case, punctuation, line breaks, cue numbers, times, markup and sound
    descriptions; words damaged by recognition or a wrong encoding count as the words they stand for. A run
    is found if ``window`` of its words in a row are damaged in ways that folding undoes, or not at all.
    Null or empty texts leak nothing; a null id is an id like any other; repeated rows give repeated
    results only if their ids repeat. Items pass the driver in blocks of about ``ITEM_CHARS`` characters;
    the documents are read once for every ``BLOCKS_A_PASS`` blocks, which go out compressed. Empty tables
    give no rows.
    """
    if not BLOCK <= window <= least:
        raise ValueError(f"window must be from {BLOCK} to {least}")
    out = T.StructType([T.StructField("doc_id", documents.schema[doc_id].dataType), T.StructField("item_id", items.schema[item_id].dataType), T.StructField("run_words", T.IntegerType())])
    named = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    blocks = _blocks(items.where(F.col(item_text).isNotNull()).select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).toLocalIterator())
    packed = (zlib.compress(pickle.dumps(block)) for block in blocks)
    found = None
    while group := list(islice(packed, BLOCKS_A_PASS)):
        one = named.mapInArrow(_searcher(group, window, least), out)
        found = one if found is None else found.unionByName(one)
    return found if found is not None else documents.sparkSession.createDataFrame([], out)


def _searcher(packed: list[bytes], window: int, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Searches documents for all blocks; of several blocks only one is unpacked at a time, for ``HELD_CHARS`` of documents."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        part, size = [], 0
        for b in batches:
            part.append(b)
            size += b.nbytes
            if len(packed) == 1 or size >= HELD_CHARS:
                yield part
                part, size = [], 0
        if part:
            yield part

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = None
        for part in held(batches):
            for block in packed:
                if patterns is None or len(packed) > 1:
                    patterns = Patterns(pickle.loads(zlib.decompress(block)), window)
                for b in part:
                    rows = []
                    ids, texts = b["doc_id"].to_pylist(), b["text"]
                    for s in range(0, b.num_rows, 1000):
                        rows += _search(patterns, ids[s : s + 1000], texts.slice(s, 1000).to_pylist(), least)
                    if rows:
                        d, i, n = zip(*rows)
                        yield pa.RecordBatch.from_arrays([pa.array(d, b["doc_id"].type), pa.array(i), pa.array(n, pa.int32())], names=["doc_id", "item_id", "run_words"])

    return search


def _blocks(rows: Iterator) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for r in rows:
        block.append((r.i, r.t))
        size += len(r.t)
        if size >= ITEM_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block
