"""Benchmark decontamination (Wu-Manber multi-pattern search over words).

Every benchmark item gives windows of ``window`` consecutive words (an item with fewer
words, but not none, is one window). The windows of one length form a pattern group with
Wu-Manber's tables: a shift table over hashed blocks of two words (how far the end of the
window can move without passing an occurrence), buckets of windows by the hash of their
last block, and a direct comparison of the words' bytes. All segments of a batch move
their window ends together, so the search is numpy code inside ``mapInArrow``; documents
are never shuffled.

The pattern tables are broadcast: patterns are compiled in blocks of at most
``BLOCK_WORDS`` words (rows are segments of at most ``SEGMENT_WORDS`` words, dealt by
hash), one block in memory at a time; with more than one block the partial hits are
written to the checkpoint folder between blocks.

Defined cases: null or wordless texts have no words and no hits; null benchmark texts and
items without words have no window; repeated items or rows count once per item id; a null
item id is the id ``null``; empty tables give no hits (or no rows); other columns of
``docs`` pass through untouched.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merchantry.llm import wordhash as W
from merchantry.session import materialize, ship_package

WINDOW = 10
BLOCK_WORDS = 1 << 20
SEGMENT_WORDS = 1 << 14
STRIDE = 256                 # words per lockstep segment of a document
MAX_PAIRS = 1 << 20          # (cursor, candidate window) pairs compared at once

HITS = T.ArrayType(T.StructType([
    T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))
ITEMS = T.ArrayType(T.StringType())


def benchmark_segments(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, words): items cut into segments that overlap by ``window - 1`` words."""
    def split(it):
        for batch in W.batches(it, "text"):
            ids = batch.column(0).to_pylist()
            ws = W.words_of(batch.column(1), W.ALNUM_WORDS)
            items, out = [], []
            for d, item in enumerate(ids):
                a, b = int(ws.first[d]), int(ws.first[d + 1])
                for s in range(a, b, SEGMENT_WORDS):
                    if s > a and b - s < window:
                        break                       # covered by the segment before
                    items.append(item)
                    out.append([ws.word(i).decode("utf-8", "replace")
                                for i in range(s, min(b, s + SEGMENT_WORDS + window - 1))])
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.string()), pa.array(out, pa.list_(pa.string()))], ["item", "words"])
    return (benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
            .mapInArrow(split, "item string, words array<string>"))


def _block_keys(h: np.ndarray, size: int) -> np.ndarray:
    """Key of the block that ends at each word."""
    if size == 1:
        return h
    prev = np.concatenate([h[:1], h[:-1]])
    return W.mix64(prev * np.uint64(0x9E3779B97F4A7C15) + h)


class PatternGroup:
    """Tables for windows of one length: ``rows`` is a list of (words, items)."""

    def __init__(self, rows: list[tuple[tuple[bytes, ...], list[str]]]):
        self.m = len(rows[0][0])
        flat = pa.array([w.decode("utf-8", "replace") for ws, _ in rows for w in ws], pa.string())
        h = W.words_of(flat, W.ALNUM_WORDS).hash.reshape(len(rows), self.m)
        self.block = min(2, self.m)
        keys = np.stack([_block_keys(r, self.block) for r in h])
        order = np.argsort(keys[:, -1], kind="stable")
        self.hashes, keys = h[order], keys[order]
        self.words = [rows[i][0] for i in order]
        self.items = [rows[i][1] for i in order]
        self.suffix = keys[:, -1]
        size = 1 << max(10, int(len(rows) * self.m * 4).bit_length())
        self.mask = np.uint64(size - 1)
        self.shift = np.full(size, self.m - self.block + 1, dtype=np.int64)
        for q in range(self.block - 1, self.m):     # block ends at word q of the window
            np.minimum.at(self.shift, (keys[:, q] & self.mask).astype(np.int64), self.m - 1 - q)

    def search(self, ws: W.Words) -> tuple[np.ndarray, np.ndarray]:
        """(end word index, window index) of every occurrence."""
        n = ws.counts()
        has = np.flatnonzero(n >= self.m)
        if not len(has):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys = _block_keys(ws.hash, self.block)
        segs = -(-(n[has] - self.m + 1) // STRIDE)
        text = np.repeat(has, segs)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(segs) - segs, segs)
        end = ws.first[text] + self.m - 1 + nth * STRIDE
        limit = np.minimum(end + STRIDE, ws.first[text + 1])
        found_end, found_win = [], []
        while len(end):
            k = keys[end]
            s = self.shift[(k & self.mask).astype(np.int64)]
            at = np.flatnonzero(s == 0)
            if len(at):
                lo = np.searchsorted(self.suffix, k[at], "left")
                n_cand = np.searchsorted(self.suffix, k[at], "right") - lo
                for a, b in _pieces(n_cand):
                    e = np.repeat(end[at[a:b]], n_cand[a:b])
                    c = np.arange(len(e)) - np.repeat(np.cumsum(n_cand[a:b]) - n_cand[a:b], n_cand[a:b])
                    w = np.repeat(lo[a:b], n_cand[a:b]) + c
                    for q in range(self.m):
                        same = ws.hash[e - self.m + 1 + q] == self.hashes[w, q]
                        e, w = e[same], w[same]
                    same = np.fromiter((self._equal(ws, int(x), int(y)) for x, y in zip(e, w)), bool, len(e))
                    found_end.append(e[same])
                    found_win.append(w[same])
                s = np.maximum(s, 1)
            end = end + s
            go = end < limit
            end, limit = end[go], limit[go]
        if not found_end:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found_end), np.concatenate(found_win)

    def _equal(self, ws: W.Words, e: int, w: int) -> bool:
        return all(ws.word(e - self.m + 1 + q) == x for q, x in enumerate(self.words[w]))


def _pieces(sizes: np.ndarray):
    """Runs of entries whose sizes add up to about MAX_PAIRS."""
    total = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + MAX_PAIRS, "right")))
        yield at, to
        at = to


def compile_groups(segments: list[tuple[str, list[str]]], window: int = WINDOW) -> list[PatternGroup]:
    by_words: dict[tuple[bytes, ...], set[str]] = {}
    for item, words in segments:
        ws = [w.encode() for w in words]
        m = min(window, len(ws))
        if m:
            for i in range(len(ws) - m + 1):
                by_words.setdefault(tuple(ws[i:i + m]), set()).add(item)
    by_len: dict[int, list] = {}
    for ws, items in by_words.items():
        by_len.setdefault(len(ws), []).append((ws, sorted(items)))
    return [PatternGroup(rows) for rows in by_len.values()]


def _pattern_blocks(benchmark: DataFrame, window: int):
    """Lists of segments, each of about BLOCK_WORDS words at most."""
    segments = materialize(benchmark_segments(benchmark, window), "benchmark_segments")
    total = segments.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = -(-int(total) * 2 // BLOCK_WORDS) if total > BLOCK_WORDS else 1
    for b in range(blocks):
        part = segments if blocks == 1 else segments.filter(
            F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == b)
        yield b == blocks - 1, [(r[0], r[1]) for r in part.toLocalIterator()]


def _merge_spans(mask: np.ndarray, first: np.ndarray) -> list[list[dict]]:
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if a == b or not mask[a:b].any():
            out.append([])
            continue
        m = np.concatenate([[0], mask[a:b].astype(np.int8), [0]])
        d = np.diff(m)
        s, e = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
        out.append([{"start": int(x), "length": int(y - x)} for x, y in zip(s, e)])
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` (needs ``text``) with ``bench_words`` (words of the text), ``bench_spans``
    (covered word ranges, merged) and ``bench_items`` (item ids with an occurring window,
    sorted as strings). Input columns of these names are replaced."""
    spark = docs.sparkSession
    ship_package(spark)
    own = ["bench_words", "bench_spans", "bench_items"]
    out = (docs.drop(*own)
           .withColumn("bench_words", F.lit(0).cast("long"))
           .withColumn("bench_spans", F.array().cast(HITS)).withColumn("bench_items", F.array().cast(ITEMS)))
    at = out.columns.index("text")
    for last, segments in _pattern_blocks(benchmark, window):
        tables = spark.sparkContext.broadcast(compile_groups(segments, window))
        out = out.mapInArrow(_scanner(tables, at), out.schema)
        if not last:
            out = materialize(out, "leak_hits")
            tables.unpersist()
    return out


def _scanner(tables, text_at: int):
    def scan(it):
        groups = tables.value
        for batch in W.batches(it, "text"):
            ws = W.words_of(batch.column(text_at), W.ALNUM_WORDS)
            n_words = len(ws.hash)
            n = batch.num_rows
            cover = np.zeros(n_words + 1, np.int64)
            text_of = ws.text_of()
            items = [set(x) for x in batch.column(n_cols(batch) - 1).to_pylist()]
            for spans, a in zip(batch.column(n_cols(batch) - 2).to_pylist(), ws.first):
                for s in spans:
                    cover[a + s["start"]] += 1
                    cover[a + s["start"] + s["length"]] -= 1
            for g in groups:
                end, win = g.search(ws)
                np.add.at(cover, end - g.m + 1, 1)
                np.add.at(cover, end + 1, -1)
                for d, w in set(zip(text_of[end].tolist(), win.tolist())):
                    items[d].update(g.items[w])
            mask = np.cumsum(cover[:-1]) > 0
            cols = list(batch.columns)[:-3]
            names = batch.schema.names
            out_types = batch.schema.types[-3:]
            cols += [pa.array(ws.counts(), pa.int64()),
                     pa.array(_merge_spans(mask, ws.first), out_types[1]),
                     pa.array([sorted(x) for x in items], out_types[2])]
            assert len(cols[0]) == n
            yield pa.RecordBatch.from_arrays(cols, names)
    return scan


def n_cols(batch) -> int:
    return len(batch.schema.names)


def drop_leaked(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any occurring benchmark window, columns unchanged."""
    spark = docs.sparkSession
    ship_package(spark)
    for last, segments in _pattern_blocks(benchmark, window):
        tables = spark.sparkContext.broadcast(compile_groups(segments, window))
        docs = docs.mapInArrow(_clean_only(tables, docs.columns.index("text")), docs.schema)
        if not last:
            docs = materialize(docs, "leak_free")
            tables.unpersist()
    return docs


def _clean_only(tables, text_at: int):
    def keep(it):
        for batch in W.batches(it, "text"):
            ws = W.words_of(batch.column(text_at), W.ALNUM_WORDS)
            text_of = ws.text_of()
            clean = np.ones(batch.num_rows, bool)
            for g in tables.value:
                end, _ = g.search(ws)
                clean[text_of[end]] = False
            yield batch.filter(pa.array(clean))
    return keep
