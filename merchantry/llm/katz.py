"""Bigram language model with Katz backoff (Good-Turing discounts, normalised backoff weights).

Tokens of a text are its words and one end; the history of the first token is a start mark. With
training counts c and k = ``GT_MAX``::

    P(w)     = d(c) c / N                      c > 0;  all unknown words share the rest, P(unknown)
    P(w | v) = d2(c(v,w)) c(v,w) / c(v)        c(v,w) >= MIN_BIGRAM
             = alpha(v) P(w)                   otherwise (alpha = 1 for a history never seen)

d and d2 are Good-Turing discounts for counts up to k (1 above), alpha(v) is chosen so that the
probabilities after v add up to exactly 1. Every bigram that training has is in the model, those
seen once with their Good-Turing discount d2(1) too.

The model has too many bigrams for one task, and a token may need any of them, so the work is dealt
out in two ways. A *block* is a run of documents of one task with about
``BLOCK_TOKENS`` tokens; a *part* holds all words, or all bigrams of a history, with one hash
remainder (histories above a 1/``HOT`` share of the tokens are dealt by their successors too).
Blocks send every part their distinct entries with counts, parts add them up and return what the
block asked about, in the block's order:

1. words: blocks ask with their words and training counts, parts return total counts;
2. bigrams, in ``ROUNDS`` rounds of parts: blocks ask with their bigrams, training counts and the counts from 1; parts return the
   total of each bigram in the model and, per history, what its alpha needs; the model itself is
   stored by part (``model`` of the result);
3. every block evaluates its documents token by token.

Texts travel compressed to meet the answers of their block. A block is named by a digest of its
contents, so a table that changed between two readings raises an error. Words are 48-bit hashes.

Defined cases: null and empty texts are the end token alone; a corpus without training rows gives
every token P(unknown) = 1; repeated rows count and are scored each; an empty table gives no rows;
other columns are ignored; null ids hash as ''.
"""
from __future__ import annotations

import ctypes
import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchantry.llm import wordhash as W
from merchantry.session import materialize, ship_package

BLOCK_TOKENS = 3 << 19
PART_BYTES = 1 << 24           # text bytes per part
ROUNDS = 2                     # bigram parts are dealt with in rounds, whose shuffles and answers follow each other
HOT = 1024
GT_MAX = 5
MIN_BIGRAM = 1
START, END = 1, 2
WORDS, TOTALS, MODEL, HISTORIES = 0, 1, 2, 3       # kinds of answer rows

ANSWER = "kind int, block long, part int, words binary, counts binary, sums binary"


def _squeeze(values: np.ndarray) -> bytes:
    """Integers (0 or more) or doubles as compressed byte planes, without the planes that are 0."""
    import zstandard
    real = values.dtype.kind == "f"
    width = 8 if real else max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    raw = values.astype("<f8" if real else "<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.T))


def _spread(data: bytes, kind: str = "<u8") -> np.ndarray:
    import zstandard
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), dtype=np.uint8).reshape(data[0], -1)
    raw = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    raw[:, :data[0]] = planes.T
    return raw.view(kind).ravel()


def _sorted_squeeze(values: np.ndarray) -> bytes:
    return _squeeze(np.diff(values, prepend=values.dtype.type(0)))


def _sorted_spread(data: bytes) -> np.ndarray:
    return np.cumsum(_spread(data), dtype=np.uint64)


def discounts(n: list[float], top: int = GT_MAX) -> np.ndarray:
    """Good-Turing discounts d[0..top] from counts of counts ``n[r]``, r = 1..top+1; where they are
    not between 0 and 1 (sparse counts), absolute discounting."""
    d = np.ones(top + 1)
    r = np.arange(1, top + 1)
    n = np.asarray(n, dtype=float)
    if (n[1:top + 2] > 0).all():
        common = (top + 1) * n[top + 1] / n[1]
        gt = ((r + 1) * n[2:top + 2] / (r * n[1:top + 1]) - common) / (1 - common) if common < 1 else np.zeros(top)
        if ((gt > 0) & (gt < 1)).all():
            d[1:] = gt
            return d
    cut = min(0.9, max(0.1, n[1] / (n[1] + 2 * n[2]))) if n[1] > 0 else 0.5
    d[1:] = (r - cut) / r
    return d


@dataclass
class Unigrams:
    """Everything but the counts: P(w) from a training count."""
    total: int
    distinct: int
    d: np.ndarray
    unknown: float
    scale: float

    @classmethod
    def fit(cls, total: int, distinct: int, n: list[float]) -> "Unigrams":
        d = discounts(n)
        r = np.arange(len(d))
        spare = float((np.asarray(n[:len(d)]) * r * (1 - d)).sum())
        scale = total if spare > 0 else total + 1
        return cls(total, distinct, d, (spare or 1.0) / max(scale, 1), max(scale, 1))

    def p(self, c: np.ndarray) -> np.ndarray:
        d = np.where(c <= GT_MAX, self.d[np.minimum(c, GT_MAX)], 1.0)
        return np.where(c > 0, d * c / self.scale, self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.total + 0.1 * (self.distinct + 1)))


class Block:
    """Tokens of a run of documents and their distinct words and bigrams, by part."""

    def __init__(self, ids, held, texts: list[str], parts: int, hot: np.ndarray, name: int | None = None):
        self.ids, self.held, self.texts = ids, np.asarray(held, dtype=bool), texts
        ws = W.words_of(pa.array(texts, pa.string()), W.SPACE_SEPARATED)
        n = ws.counts()
        self.n_tokens = n + 1
        self.first = np.concatenate([[0], np.cumsum(self.n_tokens)]).astype(np.int64)
        self.token = np.full(int(self.first[-1]), END, dtype=np.uint64)
        at = np.arange(len(ws.hash)) + ws.text_of()
        word = ws.hash >> np.uint64(16)
        self.token[at] = np.where(word < 16, word + np.uint64(16), word)
        self.history = np.concatenate([[np.uint64(START)], self.token[:-1]]).astype(np.uint64)
        self.history[self.first[:-1]] = START
        self.train = np.repeat(~self.held, self.n_tokens)
        self.parts, self.hot = parts, hot
        self.name = self._digest() if name is None else name

    def _digest(self) -> int:
        ids_sum = sum(hash_id(i) for i in self.ids) & (2 ** 64 - 1)
        mixed = W.mix64(W.ngram_hashes(self.token, 1) + np.arange(len(self.token), dtype=np.uint64))
        return int((int(mixed.sum(dtype=np.uint64)) ^ ids_sum) >> 1)

    def word_parts(self) -> np.ndarray:
        """Sets ``words`` (distinct, sorted), ``word_at`` (of each token), ``word_count``."""
        self.words, at = np.unique(self.token, return_inverse=True)
        self.word_at = at.astype(np.int32)         # a block's positions fit, they are its largest arrays
        self.word_count = np.bincount(self.word_at, weights=self.train, minlength=len(self.words)).astype(np.uint64)
        return (self.words % np.uint64(self.parts)).astype(np.int64)

    def bigrams(self):
        """Sets ``v, w`` (distinct bigrams, sorted), their positions among the words ``v_at`` (-1: start),
        ``w_at``, ``bigram_at`` (of each token), ``bigram_count``. Needs ``word_parts``."""
        # the start mark sorts before every word; positions among the words stand for the hashes
        before = np.concatenate([np.zeros(1, np.int32), self.word_at[:-1] + np.int32(1)])
        before[self.first[:-1]] = 0
        key = before * np.int64(len(self.words) + 1) + self.word_at
        order = np.argsort(key)
        key = key[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        del key
        nth = np.cumsum(new, dtype=np.int32) - np.int32(1)
        self.bigram_at = np.empty(len(order), dtype=np.int32)
        self.bigram_at[order] = nth
        first = order[new]
        self.bigram_count = np.bincount(nth, weights=self.train[order], minlength=len(first)).astype(np.uint64)
        del order, nth, new
        self.v, self.w = self.history[first], self.token[first]
        self.w_at = self.word_at[first]
        self.v_at = before[first] - np.int32(1)
        spread = np.isin(self.v, self.hot)
        return ((self.v + np.where(spread, self.w, np.uint64(0))) % np.uint64(self.parts)).astype(np.int64)


def hash_id(i) -> int:
    import zlib
    return zlib.crc32(str(i).encode()) * 0x9E3779B97F4A7C15


def _give_back() -> None:
    """Return freed memory to the system: Python workers live on for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):              # another C library: it keeps what it keeps
        pass


def _tidied(fn, *tables: pa.Table) -> pa.Table:
    out = fn(*tables)
    _give_back()
    return out


def _by_part(part: np.ndarray):
    """(part, indices in order) of every part that occurs."""
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for at in np.split(order, cuts):
        if len(at):
            yield int(part[at[0]]), at


def _runs(it, columns):
    """Documents of a task in runs of about BLOCK_TOKENS tokens (judged by bytes)."""
    got, size = [[], [], []], 0
    for batch in W.batches(it, "text"):
        for x in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns]):
            for values, value in zip(got, x):
                values.append(value)
            got[2][-1] = got[2][-1] or ""
            size += len(got[2][-1]) + 6
            if size >= 6 * BLOCK_TOKENS:
                yield got
                got, size = [[], [], []], 0
    if got[0]:
        yield got


COLUMNS = ["doc_id", "held_out", "text"]


def _ask_words(parts: int):
    def run(it):
        for ids, held, texts in _runs(it, COLUMNS):
            b = Block(ids, held, texts, parts, np.zeros(0, np.uint64))
            part = b.word_parts()
            rows = [(p, b.name, _sorted_squeeze(b.words[at]), _squeeze(b.word_count[at])) for p, at in _by_part(part)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["part", "block", "words", "counts"])
    return run


def _answer(rows) -> pa.Table:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                    names=["kind", "block", "part", "words", "counts", "sums"])


def _add_words(hot_above: int):
    """Totals of one part's words for every asking block; the part's counts of counts; its words that
    may be hot (more often than ``hot_above``)."""
    def add(asked: pa.Table) -> pa.Table:
        lists = [_sorted_spread(x) for x in asked["words"].to_pylist()]
        counts = np.concatenate([_spread(x) for x in asked["counts"].to_pylist()])
        words, at = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.bincount(at, weights=counts, minlength=len(words)).astype(np.uint64)
        part = asked["part"][0].as_py()
        hist = np.bincount(np.minimum(total, GT_MAX + 2).astype(np.int64), minlength=GT_MAX + 3)
        summary = np.concatenate([[total.sum(), (total > 0).sum(), total[words == END].sum()], hist]).astype(np.uint64)
        often = np.argsort(-total.astype(np.int64), kind="stable")[:HOT]
        often = often[total[often] > hot_above]
        rows = [(TOTALS, -1, part, _squeeze(words[often]), _squeeze(total[often]), _squeeze(summary))]
        start = 0
        for block, words_of in zip(asked["block"].to_pylist(), lists):
            rows.append((WORDS, block, part, None, _squeeze(total[at[start:start + len(words_of)]]), None))
            start += len(words_of)
        return _answer(rows)
    return lambda asked: _tidied(add, asked)


def _texts():
    """(block, ids, held, text): the documents of a block, texts compressed."""
    def run(it):
        import zstandard
        pack = zstandard.ZstdCompressor(level=1)
        for ids, held, texts in _runs(it, COLUMNS):
            b = Block(ids, held, texts, 1, np.zeros(0, np.uint64))
            raw = [t.encode("utf-8", "surrogatepass") for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([b.name], pa.int64()), pa.array([[None if i is None else str(i) for i in ids]]),
                 pa.array([[bool(h) for h in held]], pa.list_(pa.bool_())),
                 pa.array([[len(x) for x in raw]], pa.list_(pa.int64())),
                 pa.array([pack.compress(b"".join(raw))], pa.binary())], ["block", "ids", "held", "bytes", "text"])
    return run


def _blocks(table: pa.Table, parts: int, hot: np.ndarray):
    import zstandard
    for row in table.to_pylist():
        raw = zstandard.ZstdDecompressor().decompress(row["text"], max_output_size=sum(row["bytes"]) + 1)
        ends = np.cumsum([0, *row["bytes"]])
        texts = [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(ends[:-1], ends[1:])]
        yield Block(row["ids"], row["held"], texts, parts, hot, row["block"])


def _answers(table: pa.Table) -> dict:
    out: dict = {}
    for row in table.to_pylist():
        out[row["kind"], row["part"]] = row
    return out


def _word_totals(b: Block, answers: dict) -> np.ndarray:
    part = b.word_parts()
    total = np.zeros(len(b.words), dtype=np.int64)
    for p, at in _by_part(part):
        got = answers.get((WORDS, p))
        values = _spread(got["counts"]).astype(np.int64) if got else None
        if values is None or len(values) != len(at):
            raise RuntimeError("the documents changed between two readings")
        total[at] = values
    return total


def _ask_bigrams(parts: int, hot: np.ndarray, turn: int):
    """Asks of a block's bigrams in the parts of round ``turn``."""
    def ask(texts: pa.Table, answered: pa.Table) -> pa.Table:
        answers = _answers(answered)
        rows = []
        for b in _blocks(texts, parts, hot):
            total = _word_totals(b, answers)
            part = b.bigrams()
            of_w = total[b.w_at]
            for p, at in _by_part(part):
                if p % ROUNDS != turn:
                    continue
                v = b.v[at]
                heads = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
                w = b.w[at].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                rows.append((p, b.name, _sorted_squeeze(v[heads]), _squeeze(np.diff(heads, append=len(v))),
                             np.ascontiguousarray(w).tobytes(), _squeeze(b.bigram_count[at]), _squeeze(of_w[at])))
        kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 5)
        cols = zip(*rows) if rows else [[]] * 7
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds)],
                        names=["part", "block", "v", "n", "w", "counts", "of_w"])
    return lambda texts, answered: _tidied(ask, texts, answered)


def _add_bigrams(uni: Unigrams, hot: np.ndarray):
    def add(asked: pa.Table) -> pa.Table:
        part = asked["part"][0].as_py()
        v_of, heads_of, w_of = [], [], []
        for v, n, w in zip(*[asked[c].to_pylist() for c in ("v", "n", "w")]):
            heads, n = _sorted_spread(v), _spread(n).astype(np.int64)
            heads_of.append(heads)
            v_of.append(np.repeat(heads, n))
            full = np.zeros((len(w) // 6, 8), dtype=np.uint8)
            full[:, :6] = np.frombuffer(w, dtype=np.uint8).reshape(-1, 6)
            w_of.append(full.view("<u8").ravel())
        sizes = [len(x) for x in w_of]
        v, w = np.concatenate(v_of), np.concatenate(w_of)
        del v_of, w_of
        counts = np.concatenate([_spread(x) for x in asked["counts"].to_pylist()])
        of_w = np.concatenate([_spread(x) for x in asked["of_w"].to_pylist()]).astype(np.int64)
        order = np.argsort(W.mix64(v * np.uint64(0x9E3779B97F4A7C15) + w))      # equal bigrams together
        sv, sw = v[order], w[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (sv[1:] != sv[:-1]) | (sw[1:] != sw[:-1])
        nth = np.cumsum(new) - 1
        c = np.bincount(nth, weights=counts[order]).astype(np.int64)
        dv, dw, p = sv[new], sw[new], uni.p(of_w[order][new])
        hist = np.bincount(np.minimum(c, GT_MAX + 2), minlength=GT_MAX + 3).astype(np.uint64)
        c = np.where(c >= MIN_BIGRAM, c, 0)
        heads, of_head = np.unique(dv, return_inverse=True)
        # per history: number of model bigrams with count MIN_BIGRAM..GT_MAX, sum of larger counts, sum of P(w)
        sums = [np.bincount(of_head, weights=c == r, minlength=len(heads)) for r in range(MIN_BIGRAM, GT_MAX + 1)]
        sums.append(np.bincount(of_head, weights=np.where(c > GT_MAX, c, 0), minlength=len(heads)))
        sums.append(np.bincount(of_head, weights=np.where(c > 0, p, 0.0), minlength=len(heads)))
        sums = np.stack(sums, axis=1)
        known = np.flatnonzero(c > 0)
        known = known[np.argsort(of_head[known], kind="stable")]       # by history, whose differences are small
        model = np.concatenate([np.diff(dv[known], prepend=np.uint64(0)), dw[known]])
        rows = [(MODEL, -1, part, _squeeze(model), _squeeze(c[known]), _squeeze(hist))]
        shared = np.isin(heads, hot)
        if shared.any():
            rows.append((HISTORIES, -1, part, _squeeze(heads[shared]), None, _squeeze(sums[shared].ravel().astype(float))))
        total = np.empty(len(order), dtype=np.int64)
        total[order] = c[nth]
        start = 0
        for block, n, asked_heads in zip(asked["block"].to_pylist(), sizes, heads_of):
            own = sums[np.searchsorted(heads, asked_heads)]
            rows.append((TOTALS, block, part, None, _squeeze(total[start:start + n]), _squeeze(own.T.ravel().astype(float))))
            start += n
        return _answer(rows)
    return lambda asked: _tidied(add, asked)


def _score(parts: int, hot: np.ndarray, uni: Unigrams, d2: np.ndarray, hot_sums: np.ndarray, n_starts: int, id_type):
    n_sums = GT_MAX - MIN_BIGRAM + 3

    def log_alpha(sums: np.ndarray, of_v: np.ndarray):
        """(log10 alpha, denominator) of histories with these sums and training counts."""
        r = np.arange(MIN_BIGRAM, GT_MAX + 1)
        mass = (sums[:, :len(r)] * (r * d2[r])).sum(axis=1) + sums[:, len(r)]
        below = np.where(mass >= of_v - 1e-9, of_v + 1.0, of_v)
        left = np.where(mass > 0, 1 - mass / np.maximum(below, 1), 1.0)
        return np.log10(left / np.maximum(1 - sums[:, -1], 1e-300)), below

    def score(texts: pa.Table, answered: pa.Table) -> pa.Table:
        answers = _answers(answered)
        out: list[list] = [[] for _ in range(6)]
        for b in _blocks(texts, parts, hot):
            total = _word_totals(b, answers)
            part = b.bigrams()
            c = np.zeros(len(b.v), dtype=np.int64)
            of_v = np.where(b.v_at < 0, n_starts, total[b.v_at]).astype(float)
            alpha, below = np.empty(len(b.v)), np.empty(len(b.v))
            for p, at in _by_part(part):
                got = answers.get((TOTALS, p))
                if not got:
                    raise RuntimeError("the documents changed between two readings")
                c[at] = _spread(got["counts"]).astype(np.int64)
                v = b.v[at]
                new = np.concatenate([[True], v[1:] != v[:-1]])
                nth = np.cumsum(new) - 1
                of_head = log_alpha(_spread(got["sums"], "<f8").reshape(n_sums, -1).T, of_v[at][new])
                alpha[at], below[at] = of_head[0][nth], of_head[1][nth]
            shared = np.isin(b.v, hot)
            if shared.any():
                heads, new, nth = np.unique(np.searchsorted(hot, b.v[shared]), return_index=True, return_inverse=True)
                of_head = log_alpha(hot_sums[heads], of_v[shared][new])
                alpha[shared], below[shared] = of_head[0][nth], of_head[1][nth]
            lower = np.log10(uni.p(total))
            own = np.log10(np.where(c <= GT_MAX, d2[np.minimum(c, GT_MAX)], 1.0) * np.maximum(c, 1) / np.maximum(below, 1))
            p = np.where(c > 0, own, alpha + lower[b.w_at])[b.bigram_at]
            del own, alpha, below, of_v, c
            of_token = total[b.word_at]
            at = b.first[:-1]
            out[0] += b.ids
            out[1] += b.held.tolist()
            out[2] += b.n_tokens.tolist()
            out[3] += np.add.reduceat((of_token > 0).astype(np.int64), at).tolist()
            out[4] += np.add.reduceat(uni.base(of_token), at).tolist()
            out[5] += np.add.reduceat(p, at).tolist()
        kinds = (pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([pa.array(x, t) for x, t in zip(out, kinds)],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
    return lambda texts, answered: _tidied(score, texts, answered)


def fit_and_score(docs: DataFrame, held_out: Column) -> tuple[DataFrame, DataFrame]:
    """(scores, model). ``docs`` needs doc_id, text; rows where ``held_out`` is true are scored but not
    learned from. ``scores``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    ``model``: a row per part, for ``read_model``. ``docs`` must read the same twice (a table)."""
    spark = docs.sparkSession
    ship_package(spark)
    id_type = docs.schema["doc_id"].dataType
    docs = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-size // PART_BYTES))
    asked = docs.mapInArrow(_ask_words(parts), "part int, block long, words binary, counts binary")
    # a word with a 1/HOT share of the tokens has at least a byte and a separator each time
    words = materialize(asked.groupBy("part").applyInArrow(_add_words(size // (64 * HOT)), ANSWER), "word_totals")
    none = [0] * (GT_MAX + 6)
    summary, often = np.array(none), {}
    for r in words.filter((F.col("kind") == TOTALS)).select("words", "counts", "sums").toLocalIterator():
        summary = summary + _spread(r["sums"]).astype(np.int64)
        often.update(zip(_spread(r["words"]).tolist(), _spread(r["counts"]).tolist()))
        total = max(int(summary[0]), 1)
        often = {w: c for w, c in often.items() if c * HOT >= total}      # at most HOT words at any time
    n = [0, *summary[4:].tolist()]
    uni = Unigrams.fit(int(summary[0]), int(summary[1]), n)
    n_starts = int(summary[2])
    hot = np.array(sorted({START, *often}), dtype=np.uint64)

    texts = docs.mapInArrow(_texts(), "block long, ids array<string>, held array<boolean>, bytes array<bigint>, text binary")
    word_answers = words.filter(F.col("kind") == WORDS)
    rounds = []
    for turn in range(ROUNDS):
        asked = texts.groupBy("block").cogroup(word_answers.groupBy("block")).applyInArrow(
            _ask_bigrams(parts, hot, turn), "part int, block long, v binary, n binary, w binary, counts binary, of_w binary")
        rounds.append(materialize(asked.groupBy("part").applyInArrow(_add_bigrams(uni, hot), ANSWER), "bigram_totals"))
    pairs = functools.reduce(DataFrame.unionByName, rounds)
    n2, hot_sums = np.zeros(GT_MAX + 3, dtype=np.int64), np.zeros((len(hot), GT_MAX - MIN_BIGRAM + 3))
    for r in pairs.filter((F.col("kind") == MODEL) | (F.col("kind") == HISTORIES)).select(
            "kind", F.when(F.col("kind") == HISTORIES, F.col("words")).alias("words"), "sums").toLocalIterator():
        if r["kind"] == MODEL:
            n2 += _spread(r["sums"]).astype(np.int64)
        else:
            heads = _spread(r["words"])
            np.add.at(hot_sums, np.searchsorted(hot, heads), _spread(r["sums"], "<f8").reshape(len(heads), -1))
    d2 = discounts(n2.tolist())
    answers = word_answers.unionByName(pairs.filter(F.col("kind") == TOTALS))
    scores = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _score(parts, hot, uni, d2, hot_sums, n_starts, id_type),
        "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    scores = scores.select(F.col("doc_id").cast(id_type).alias("doc_id"), "held_out", "n_tokens", "n_known",
                           F.lit(uni.total).cast("long").alias("train_tokens"), "base_score", "score")
    return scores, pairs.filter(F.col("kind") == MODEL)


def read_model(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(v, w, count) of the model bigrams in a row of ``model``."""
    both = _spread(row["words"])
    return np.cumsum(both[:len(both) // 2], dtype=np.uint64), both[len(both) // 2:], _spread(row["counts"]).astype(np.int64)
