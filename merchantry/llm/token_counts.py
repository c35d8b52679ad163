"""Token counts that follow edits.

A document's text is kept as pre-tokens (the pieces in which the tokenizer's pattern splits a text
before any merge, so a text's token count is the sum of its pre-tokens' counts), in chunks that are
the leaves of a segment tree of character and token sums. An edit re-encodes only the pre-tokens it
touches and the context at its borders:

* to the left it starts at the pre-token that holds the second character before the edit (the
  pattern looks at most two characters past a pre-token's end);
* to the right it matches on until a new boundary falls on an old one behind the edit; from there
  on the pattern sees the same text and gives the same pre-tokens.

The changed leaves and their ancestors' sums are then updated. ``tiktoken`` with ``byte_bpe_50k``
counts; strings that name special tokens are ordinary text.

Defined cases: null texts count as empty (no pre-tokens, 0 tokens); edits are (start, end, text) in
characters of the unedited text, are clipped to the text and null edits or texts read as none and '';
of edits that overlap, the one that starts (then ends) first is made, the others are left out; equal rows are edited alike; an empty table gives no rows; other columns pass
through.
"""
from __future__ import annotations

import base64
import re
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry.llm.wordhash import batches
from merchantry.session import ship_package

CHUNK = 64                     # pre-tokens in a fresh leaf
REBUILD = 1024                 # a leaf that grows beyond this makes the tree be built anew
CONTEXT = 8                    # old pre-tokens that matching first looks at behind an edit
CACHE = 1 << 18                # pre-tokens whose counts a task remembers
EDIT = "struct<start:bigint,end:bigint,text:string>"


class PieceCounter:
    """Token count of a pre-token, with a bounded cache."""

    def __init__(self, ranks_file: str):
        import public_tokenizers
        import tiktoken
        with open(public_tokenizers.path(ranks_file), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self._encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                         special_tokens={}).encode_ordinary
        self._seen: dict[str, int] = {}
        self.encoded_chars = 0

    def counts(self, pieces: list[str]) -> list[int]:
        found = list(map(self._seen.get, pieces))
        return [self.count(p) if n is None else n for p, n in zip(pieces, found)] if None in found else found

    def count(self, piece: str) -> int:
        n = self._seen.get(piece)
        if n is None:
            n = len(self._encode(piece))
            if len(self._seen) >= CACHE:
                self._seen.clear()
            if len(piece) <= 64:
                self._seen[piece] = n
        return n


@lru_cache(2)
def piece_counter(ranks_file: str) -> PieceCounter:
    return PieceCounter(ranks_file)


class Leaf:
    __slots__ = ("pieces", "counts", "chars", "tokens")

    def __init__(self, pieces: list[str], counts: list[int]):
        self.pieces, self.counts = pieces, counts
        self.chars, self.tokens = sum(map(len, pieces)), sum(counts)


class SegmentTree:
    """Sums over leaves; ``chars[1]`` and ``tokens[1]`` are the totals of the document."""

    def __init__(self, text: str, counter: PieceCounter):
        self.counter = counter
        self.reencoded = 0
        self._build(counter.pattern.findall(text))

    def _build(self, pieces: list[str], counts: list[int] | None = None):
        counts = counts or self.counter.counts(pieces)
        self.leaves = [Leaf(pieces[i:i + CHUNK], counts[i:i + CHUNK])
                       for i in range(0, len(pieces), CHUNK)] or [Leaf([], [])]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, leaf in enumerate(self.leaves):
            self.chars[self.size + i], self.tokens[self.size + i] = leaf.chars, leaf.tokens
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _splice(self, i: int, a: int, b: int, pieces: list[str], counts: list[int]):
        """Put ``pieces`` in the place of those from ``a`` to ``b`` of leaf ``i`` and update the sums above."""
        leaf = self.leaves[i]
        d_chars = sum(map(len, pieces)) - sum(map(len, leaf.pieces[a:b]))
        d_tokens = sum(counts) - sum(leaf.counts[a:b])
        leaf.pieces[a:b], leaf.counts[a:b] = pieces, counts
        leaf.chars += d_chars
        leaf.tokens += d_tokens
        i += self.size
        while i and (d_chars or d_tokens):
            self.chars[i] += d_chars
            self.tokens[i] += d_tokens
            i >>= 1

    def _find(self, at: int) -> tuple[int, int]:
        """(leaf, its first character) of character ``at`` (the last leaf for the text's end)."""
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if at >= start + self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.size, start

    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf.pieces)

    def replace(self, start: int, end: int, new: str):
        total = self.chars[1]
        start = max(0, min(start, total))
        end = max(start, min(end, total))
        first, base = self._find(max(0, start - 2))
        # the kept pre-tokens of the first leaf: all that end at the second character before or earlier
        before = list(accumulate(map(len, self.leaves[first].pieces), initial=0))
        kept = max(0, bisect_right(before, start - 2 - base) - 1)
        at = base + before[kept]
        # old pre-tokens from there on, a few at a time, until matching meets an old boundary
        old, size, step, last, i = [], 0, CONTEXT, first, kept
        while True:
            part = self.leaves[last].pieces[i:i + step]
            if not part and last + 1 < len(self.leaves):
                last, i = last + 1, 0
                continue
            old += part
            size += sum(map(len, part))
            i += len(part)
            more = i < len(self.leaves[last].pieces) or last + 1 < len(self.leaves)
            found = None
            if not more or at + size >= end:
                found = self._match(old, "".join(old), start - at, end - at, new, more)
            if found is not None:
                break
            step *= 2
        fresh, used = found
        self.reencoded += sum(map(len, fresh))
        put = fresh, self.counter.counts(fresh)
        i, a = first, kept
        while True:
            n = min(used, len(self.leaves[i].pieces) - a)
            self._splice(i, a, a + n, *put)
            used -= n
            if not used:
                break
            i, a, put = i + 1, 0, ([], [])
        if len(self.leaves[first].pieces) > REBUILD:
            self._build([p for x in self.leaves for p in x.pieces], [c for x in self.leaves for c in x.counts])

    def replace_all(self, edits):
        """Make ``edits``, (start, end, text) in characters of the text as it is now. Of edits that overlap,
        the one that starts (then ends) first is made and the others are left out."""
        made, free, total = [], 0, self.chars[1]
        for start, end, new in sorted(edits, key=lambda e: e[:2]):
            start = max(0, min(start, total))
            end = max(start, min(end, total))
            if start >= free:
                made.append((start, end, new))
                free = end
        for start, end, new in reversed(made):
            self.replace(start, end, new)

    def _match(self, old, old_text, start, end, new, more):
        """(new pre-tokens, number of old ones they replace); None if the text behind is too short to tell."""
        text = old_text[:start] + new + old_text[end:]
        shift = len(new) - (end - start)
        bounds, at = {}, 0
        for i, p in enumerate(old):
            if at >= end:
                bounds[at + shift] = i
            at += len(p)
        if not more:
            bounds[at + shift] = len(old)
        fresh = []
        for m in self.counter.pattern.finditer(text):
            if m.start() in bounds and m.start() >= start + len(new):
                return fresh, bounds[m.start()]
            if more and m.end() + 2 > len(text):
                return None
            fresh.append(m.group())
        return None if more else (fresh, len(old))


def with_pattern_edits(docs: DataFrame, pattern: str, replacement: str) -> DataFrame:
    """``docs`` with ``edits`` (replaced if there): one for every match of ``pattern`` (as ``re`` reads it) in ``text``."""
    docs = docs.drop("edits")
    schema = docs.withColumn("edits", F.array().cast(f"array<{EDIT}>")).schema

    def run(it):
        find = re.compile(pattern).finditer
        for batch in batches(it, "text"):
            found = [[{"start": m.start(), "end": m.end(), "text": replacement} for m in find(t or "")]
                     for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, "edits"])
    return docs.mapInArrow(run, schema)


def recount(docs: DataFrame, edits: str = "edits", ranks_file: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``docs`` (needs ``text`` and the array column ``edits``) with ``text`` edited and
    ``tokens_before``, ``tokens_after``, ``pretokens_after``, ``reencoded_chars``."""
    ship_package(docs.sparkSession)
    own = ["tokens_before", "tokens_after", "pretokens_after", "reencoded_chars"]
    docs = docs.drop(*own)
    schema = docs.withColumns({c: F.lit(0).cast("long") for c in own}).schema

    def run(it):
        counter = piece_counter(ranks_file)
        for batch in batches(it, "text"):
            names = batch.schema.names
            texts, got = [], []
            for text, todo in zip(batch.column(names.index("text")).to_pylist(), batch.column(names.index(edits)).to_pylist()):
                tree = SegmentTree(text or "", counter)
                before = tree.tokens[1]
                todo = [e for e in todo or [] if e is not None and e["start"] is not None and e["end"] is not None]
                tree.replace_all([(e["start"], e["end"], e["text"] or "") for e in todo])
                texts.append(tree.text() if todo and text is not None else text)
                got.append((before, tree.tokens[1], sum(len(x.pieces) for x in tree.leaves), tree.reencoded))
            cols = list(batch.columns)
            cols[names.index("text")] = pa.array(texts, batch.schema.field("text").type)
            extra = [pa.array(c, pa.int64()) for c in zip(*got)]
            yield pa.RecordBatch.from_arrays(cols + extra, names + own)
    return docs.mapInArrow(run, schema)
