"""Packing token sequences into fixed windows (non-negative least squares).

Documents are tokenised inside ``mapInArrow`` and packed unit by unit, a unit being the
documents of one task up to ``UNIT_TOKENS`` tokens, so nothing is shuffled and memory stays
bounded. In a unit:

1. every full window of a document is a sequence of its own; the rest is a piece of 1 to
   ``window - 1`` tokens;
2. shallow combinations (two or three length classes that fill the window up to rounding)
   are enumerated, repeat counts solved by non-negative least squares against the unit's
   length histogram and rounded down;
3. combinations that still have pieces are repeated greedily, and the residual pieces are
   laid end to end and cut at the window; the last stretch of a unit is cut into powers of
   two, which need no padding.

The ids are those of ``tokenizers`` with ``byte_bpe_50k.json``. ``tiktoken`` with the same
vocabulary computes them several times faster; texts with very long unbroken runs, where it
is quadratic, go to ``tokenizers``.

Defined cases: a null or empty text is the single end id; repeated rows are packed as
separate documents; an empty table gives no rows; only ``doc_id`` and ``text`` are read.
"""
from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from merchantry.llm.wordhash import batches
from merchantry.session import ship_package

WINDOW = 2048
END_ID = 1
CLASS_WIDTH = 4               # tokens per length class
UNIT_TOKENS = 1 << 23
NNLS_STEPS = 300
LONG_RUN = regex.compile(r"\S{2000}|\s{2000}")
SPECIAL = "<|endoftext|>"


@lru_cache(4)
def encoder(json_file: str, ranks_file: str):
    """text -> ids. Both arguments are file names that ``public_tokenizers.path`` knows."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer
    with open(public_tokenizers.path(ranks_file), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={SPECIAL: len(ranks)})
    slow = Tokenizer.from_file(public_tokenizers.path(json_file))

    def encode(text: str) -> list[int]:
        if LONG_RUN.search(text):
            return slow.encode(text, add_special_tokens=False).ids
        if SPECIAL in text:
            return fast.encode(text, allowed_special="all")
        return fast.encode_ordinary(text)
    return encode


@lru_cache(4)
def combinations(classes: int) -> np.ndarray:
    """Pairs and triples of length classes 1..classes-1 that add up to ``classes`` (rows of
    three class numbers, 0 for none)."""
    out = [(classes - a, a, 0) for a in range(1, classes // 2 + 1)]
    for a in range(1, classes // 3 + 1):
        b = np.arange(a, (classes - a) // 2 + 1)
        out.extend(zip((classes - a - b).tolist(), b.tolist(), [a] * len(b)))
    return np.array(out, dtype=np.int64).reshape(-1, 3)


def solve_counts(combos: np.ndarray, hist: np.ndarray, steps: int = NNLS_STEPS) -> np.ndarray:
    """x >= 0 minimising ||A x - hist||, A's columns being the combinations (accelerated
    projected gradient; a column has at most three entries, so products are gathers)."""
    n = len(hist)
    weight = (combos > 0).astype(float)

    def forward(x):
        return sum(np.bincount(combos[:, i], weights=x * weight[:, i], minlength=n) for i in range(3))

    def back(r):
        return sum(r[combos[:, i]] * weight[:, i] for i in range(3))

    v = np.ones(len(combos))
    norm = 1.0
    for _ in range(20):
        v = back(forward(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(combos))
    t = 1.0
    target = hist.astype(float)
    target[0] = 0
    for _ in range(steps):
        nxt = np.maximum(0, y - back(forward(y) - target) / norm)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = nxt + (t - 1) / t2 * (nxt - x)
        x, t = nxt, t2
    return x


def plan_unit(lengths: np.ndarray, window: int = WINDOW, width: int = CLASS_WIDTH
              ) -> tuple[list[np.ndarray], np.ndarray]:
    """(groups, residual): groups of piece indices that share a window each, and the indices
    left for end-to-end packing."""
    classes = window // width
    cls = -(-lengths // width)
    hist = np.bincount(cls, minlength=classes + 1)
    combos = combinations(classes)
    combos = combos[(hist[combos[:, 0]] > 0) & (hist[combos[:, 1]] > 0)
                    & ((combos[:, 2] == 0) | (hist[combos[:, 2]] > 0))]
    groups: list[np.ndarray] = []
    order = np.argsort(cls, kind="stable")
    at = np.concatenate([[0], np.cumsum(hist)])
    used = np.zeros(len(hist), dtype=np.int64)
    left = hist.copy()

    def take(combo, most):
        parts = [int(c) for c in combo if c]
        need = {c: parts.count(c) for c in parts}
        k = min([most] + [int(left[c]) // m for c, m in need.items()])
        if k <= 0:
            return
        cols = []
        for c in parts:
            cols.append(order[at[c] + used[c]: at[c] + used[c] + k])
            used[c] += k
            left[c] -= k
        groups.extend(np.stack(cols, axis=1))

    if len(combos):
        x = solve_counts(combos, hist)
        counts = np.floor(x + 1e-9).astype(np.int64)
        for j in np.argsort(-x, kind="stable"):
            if counts[j] <= 0:
                break
            take(combos[j], counts[j])
        for j in np.argsort(-x, kind="stable"):
            take(combos[j], len(lengths))
    rest = [order[at[c] + used[c]: at[c + 1]] for c in range(len(hist))]
    return groups, np.concatenate(rest[::-1]) if rest else np.zeros(0, np.int64)


class _Unit:
    """Rows of one unit, built in the task."""

    def __init__(self, window: int, next_id):
        self.window, self.next_id = window, next_id
        self.docs: list = []
        self.tokens = 0

    def add(self, doc_id, ids: np.ndarray):
        self.docs.append((doc_id, ids))
        self.tokens += len(ids)

    def rows(self):
        """(doc_id, start, ids, doc_tokens, sequence_id, offset)."""
        w = self.window
        rest = []
        for d, (doc_id, ids) in enumerate(self.docs):
            n = len(ids)
            for s in range(0, n - w + 1, w):
                yield doc_id, s, ids[s:s + w], n, self.next_id(), 0
            if n % w:
                rest.append((d, n - n % w, n % w))
        if not rest:
            return
        lengths = np.array([r[2] for r in rest], dtype=np.int64)
        groups, residual = plan_unit(lengths, w)
        for g in groups:
            seq, off = self.next_id(), 0
            for i in g:
                d, s, n = rest[i]
                doc_id, ids = self.docs[d]
                yield doc_id, s, ids[s:s + n], len(ids), seq, off
                off += n
        total = int(lengths[residual].sum())
        sizes = [w] * (total // w)
        tail = total % w
        sizes += [1 << b for b in range(tail.bit_length() - 1, -1, -1) if tail >> b & 1]
        nth, room, seq = 0, sizes[0] if sizes else 0, None
        for i in residual:
            d, s, n = rest[i]
            doc_id, ids = self.docs[d]
            while n:
                if seq is None:
                    seq, room, off = self.next_id(), sizes[nth], 0
                k = min(n, room)
                yield doc_id, s, ids[s:s + k], len(ids), seq, off
                s, n, room, off = s + k, n - k, room - k, off + k
                if not room:
                    seq, nth = None, nth + 1


def pack(docs: DataFrame, json_file: str = "byte_bpe_50k.json", ranks_file: str = "byte_bpe_50k.tiktoken",
         window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces (doc_id, start, ids, doc_tokens, sequence_id, offset); ``ids`` is binary,
    little-endian unsigned 32-bit. Concatenating a sequence's pieces by ``offset`` gives its
    tokens."""
    ship_package(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType

    def run(it):
        encode = encoder(json_file, ranks_file)
        base, nth = TaskContext.get().partitionId() << 40, iter(range(1 << 40))
        next_id = lambda: base + next(nth)
        unit, arrow_type = _Unit(window, next_id), None

        def flush():
            rows: list = []
            size = 0
            for r in unit.rows():
                rows.append(r)
                size += len(r[2])
                if size > 1 << 21:
                    yield _record(rows, arrow_type)
                    rows, size = [], 0
            if rows:
                yield _record(rows, arrow_type)

        for batch in batches(it, "text"):
            arrow_type = batch.schema.types[0]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text) if text else []
                ids.append(end_id)
                unit.add(doc_id, np.array(ids, dtype="<u4"))
                if unit.tokens >= UNIT_TOKENS:
                    yield from flush()
                    unit = _Unit(window, next_id)
        yield from flush()

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {id_type.simpleString()}, start long, ids binary, doc_tokens long, sequence_id long, offset long")


def _record(rows, id_type):
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[0], id_type), pa.array(cols[1], pa.int64()),
         pa.array([x.tobytes() for x in cols[2]], pa.binary()), pa.array(cols[3], pa.int64()),
         pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.int64())],
        ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"])
