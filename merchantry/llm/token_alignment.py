"""Alignment of two tokenizers' tokens (divide and conquer at shared cuts).

Both tokenizers cut the bytes of ``" " + text``: A is a byte-level BPE (its file of ranks, the ids
of the JSON file of the same vocabulary), B a sentencepiece model that adds the space itself. The
byte offsets where a token of each ends split the tokens into groups. They are found by divide and
conquer: of a document's interval of A ends the one nearest its middle is looked up among the B
ends by bisect; if it is not there the next one outwards is, at a hit both halves go on by
themselves, and an interval without a shared end is a leaf, one group. What has been probed in vain
is handed down to the half that holds it, so no end is probed twice. The intervals of all documents
of a batch take their steps together, as array operations.

``align`` gives each document its groups and links: a link is a pair of an A and a B token that share
a group. ``pair_counts`` counts for each pair of ids the documents that hold it linked, ``scored``
brings the counts back to the documents. A pair that only one document holds needs no table entry:
its count is 1. Per A id the highest count is at most one row per vocabulary entry, so it is
broadcast; the counts of 2 and more are broadcast up to BROADCAST_PAIRS rows and joined by a shuffle
beyond.

Defined cases: null and empty texts, and texts whose joined A or B bytes differ from ``" " + text``
(the model normalises or can't spell them), have no tokens: zeros and groups ''; strings that name
special tokens are ordinary text; repeated rows are documents of their own, in the counts too; a
null id is carried along; other columns don't matter; an empty table gives no rows. Memory of a task:
a batch of BATCH_CHARS characters or one document, and of a group its different A ids times its
different B ids.
"""
from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry.session import materialize, ship_package

RANKS = "byte_bpe_50k.tiktoken"
MODEL = "piece_bpe_32k.model"
BATCH_CHARS = 1 << 19
WIDE_GROUP = 64                # links from which a group's ids are counted before they are paired
BROADCAST_PAIRS = 1 << 22      # 4 million (pair, count) rows, 16 bytes each
SCHEMA = ("doc_id {}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, {}"
          "pairs array<bigint>, links array<bigint>")


class Vocabularies:
    """Encoders of both sides and the byte length and spelling of every id."""

    def __init__(self, ranks_file: str, model_file: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        with open(public_tokenizers.path(ranks_file), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.a = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model_file))
        n_a, n_b = max(ranks.values()) + 1, self.b.get_piece_size()
        self.b_bytes = [self._piece(i) for i in range(n_b)]
        self.b_ids = n_b
        self.a_len = np.zeros(n_a, dtype=np.int64)
        self.a_len[list(ranks.values())] = [len(t) for t in ranks]
        self.b_len = np.array([len(t) for t in self.b_bytes], dtype=np.int64)
        # an id with the mark that follows it: , within a group's side, | after its A ids, ; after its B ids
        self.marked = [b"%d%s" % (i, mark) for n, marks in ((n_a, (b",", b"|")), (n_b, (b",", b";")))
                       for mark in marks for i in range(n)]
        self.mark_at = 0, n_a, 2 * n_a, 2 * n_a + n_b

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list) -> list:
        """A list (A ids, B ids) for every text, None for one that has no tokens."""
        out = []
        for text, b in zip(texts, self.b.encode([t or "" for t in texts], num_threads=1)):
            if not text:
                out.append(None)
                continue
            raw, a = (" " + text).encode(), self.a.encode_ordinary(" " + text)
            same = b"".join(map(self.b_bytes.__getitem__, b)) == raw and self.a.decode_bytes(a) == raw
            out.append((a, b) if same else None)
        return out


@lru_cache(2)
def vocabularies(ranks_file: str, model_file: str) -> Vocabularies:
    return Vocabularies(ranks_file, model_file)


def shared_cuts(a: np.ndarray, b: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the ends in ``a`` and of those in ``b`` that both hold. Ends increase; ``last`` has the
    indices in ``a`` of the documents' last ends, which ``b`` holds too."""
    cut = np.zeros(len(a), dtype=bool)
    cut[last] = True
    lo = np.concatenate([[0], last[:-1] + 1])     # an interval: ends lo..hi-1 are not known to be shared,
    hi = last.copy()                              # of which from..to-1, round its middle, are known not to be
    start = to = (lo + hi) // 2
    while len(lo):
        open_ = (to < hi) | (start > lo)
        lo, hi, start, to = lo[open_], hi[open_], start[open_], to[open_]
        middle = (lo + hi) // 2
        up = (to < hi) & ((start <= lo) | (to - middle <= middle - start + 1))
        probe = np.where(up, to, start - 1)
        hit = b[np.searchsorted(b, a[probe])] == a[probe]
        cut[probe[hit]] = True
        to, start = to + (up & ~hit), start - (~up & ~hit)
        # the lower half keeps what was probed if the cut is above it, the upper half if it is below
        lo_, hi_ = np.concatenate([lo[hit], probe[hit] + 1]), np.concatenate([probe[hit], hi[hit]])
        keeps = np.concatenate([up[hit], ~up[hit]]) & np.tile(to[hit] > start[hit], 2)
        half = (lo_ + hi_) // 2
        lo, hi = np.concatenate([lo[~hit], lo_]), np.concatenate([hi[~hit], hi_])
        start = np.concatenate([start[~hit], np.where(keeps, np.tile(start[hit], 2), half)])
        to = np.concatenate([to[~hit], np.where(keeps, np.tile(to[hit], 2), half)])
    cut_b = np.zeros(len(b), dtype=bool)
    cut_b[np.searchsorted(b, a[cut])] = True
    return cut, cut_b


def _weighted_unique(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weights[order], first) if len(first) else weights


def _links(a, b, group_a, group_b, size_a, size_b, doc_of_group, b_ids):
    """(doc << 32 | pair, number of links) of all links, keys in order."""
    start_b = np.cumsum(size_b) - size_b
    wide = size_a * size_b > WIDE_GROUP
    token = np.flatnonzero(~wide[group_a])
    times = size_b[group_a[token]]
    left = np.repeat(token, times)
    nth = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
    group = group_a[left]
    keys = (doc_of_group[group] << 32) + a[left] * b_ids + b[start_b[group] + nth]
    keys, n = np.unique(keys, return_counts=True)
    if not wide.any():
        return keys, n
    start_a = np.cumsum(size_a) - size_a
    more_keys, more_n = [keys], [n]
    for g in np.flatnonzero(wide):
        ua, ca = np.unique(a[start_a[g]:start_a[g] + size_a[g]], return_counts=True)
        ub, cb = np.unique(b[start_b[g]:start_b[g] + size_b[g]], return_counts=True)
        more_keys.append(((doc_of_group[g] << 32) + ua[:, None] * b_ids + ub).ravel())
        more_n.append((ca[:, None] * cb).ravel())
    return _weighted_unique(np.concatenate(more_keys), np.concatenate(more_n))


def align_texts(texts: list, vocab: Vocabularies) -> dict:
    """Columns of SCHEMA without the id, the pair arrays as (offsets, flat values); ``groups`` as bytes."""
    coded = vocab.encode(texts)
    n_a = np.array([len(c[0]) if c else 0 for c in coded], dtype=np.int64)
    n_b = np.array([len(c[1]) if c else 0 for c in coded], dtype=np.int64)
    a, b = (np.fromiter(chain.from_iterable(c[side] for c in coded if c), dtype=np.int64) for side in (0, 1))
    docs = np.arange(len(texts))
    doc_a, doc_b = np.repeat(docs, n_a), np.repeat(docs, n_b)
    cut_a, cut_b = shared_cuts(np.cumsum(vocab.a_len[a]), np.cumsum(vocab.b_len[b]), np.cumsum(n_a)[n_a > 0] - 1)
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    size_a, size_b = np.bincount(group_a), np.bincount(group_b)
    doc_of_group = doc_a[cut_a]
    per_doc = lambda x: np.bincount(doc_of_group, weights=x, minlength=len(texts)).astype(np.int64)
    keys, n = _links(a, b, group_a, group_b, size_a, size_b, doc_of_group, vocab.b_ids)
    links = np.zeros(len(texts), dtype=np.int64)
    np.add.at(links, doc_of_group, size_a * size_b)
    # the groups as text: a group's A ids stand before its B ids, each with its mark
    spelt = np.empty(len(a) + len(b), dtype=np.int64)
    before_a, before_b = np.cumsum(size_b) - size_b, np.cumsum(size_a)
    spelt[np.arange(len(a)) + before_a[group_a]] = a + np.where(cut_a, vocab.mark_at[1], vocab.mark_at[0])
    spelt[np.arange(len(b)) + before_b[group_b]] = b + np.where(cut_b, vocab.mark_at[3], vocab.mark_at[2])
    spelt, at, groups = spelt.tolist(), 0, []
    for size in (n_a + n_b).tolist():
        groups.append(b"".join([vocab.marked[i] for i in spelt[at:at + size]])[:-1])
        at += size
    ends = np.searchsorted(keys, (docs + 1) << 32)
    return {"n_a": n_a, "n_b": n_b, "n_groups": per_doc(None), "n_links": links, "groups": groups,
            "offsets": np.concatenate([[0], ends]), "pairs": keys & 0xFFFFFFFF, "links": n}


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_file: str = RANKS,
          model_file: str = MODEL, with_groups: bool = False) -> DataFrame:
    """One row per document: ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256``, the different
    pairs of linked ids (A id * B vocabulary + B id) in ``pairs`` and their numbers of links in ``links``,
    and with ``with_groups`` the groups themselves (``a1,a2|b1;a3|b2,b3``)."""
    ship_package(docs.sparkSession)

    def rows(ids, texts, id_type):
        out = align_texts(texts, vocabularies(ranks_file, model_file))
        nested = lambda x: pa.ListArray.from_arrays(pa.array(out["offsets"], pa.int32()), pa.array(x, pa.int64()))
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
        cols = [pa.array(ids, id_type)] + [pa.array(out[c], pa.int64()) for c in names[1:5]]
        cols.append(pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in out["groups"]], pa.string()))
        if with_groups:
            names, cols = names + ["groups"], cols + [pa.array([g.decode() for g in out["groups"]], pa.string())]
        return pa.RecordBatch.from_arrays(cols + [nested(out["pairs"]), nested(out["links"])], names + ["pairs", "links"])

    def run(it):
        for batch in it:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            first = size = 0
            for i, text in enumerate(texts):
                size += len(text or "")
                if size >= BATCH_CHARS or i == len(texts) - 1:
                    yield rows(ids[first:i + 1], texts[first:i + 1], batch.schema.field(0).type)
                    first, size = i + 1, 0

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = SCHEMA.format(picked.schema["doc_id"].dataType.simpleString(), "groups string, " if with_groups else "")
    return picked.mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n_docs): in how many rows of ``aligned`` the pair of ids is linked."""
    return aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n_docs"))


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_file: str = RANKS,
           model_file: str = MODEL, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``align`` without its pairs, and ``n_best`` (links whose pair has the highest count of its A id) and
    ``count_sum`` (the counts of all links added up)."""
    import public_tokenizers
    import sentencepiece
    b_ids = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model_file)).get_piece_size()
    aligned = align(docs, id_col, text_col, ranks_file, model_file)
    aligned = materialize(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned", "zstd")
    counts = materialize(pair_counts(aligned), "pair_counts")
    a_id = F.floor(F.col("pair") / b_ids).alias("a_id")
    best = counts.groupBy(a_id).agg(F.max("n_docs").alias("most"))
    several = counts.filter(F.col("n_docs") > 1)
    if several.limit(broadcast_pairs + 1).count() <= broadcast_pairs:
        several = F.broadcast(several)
    links = (aligned.select("row", F.inline(F.arrays_zip("pairs", "links"))).withColumnsRenamed({"pairs": "pair"})
             .join(several, "pair", "left").withColumn("a_id", a_id).join(F.broadcast(best), "a_id"))
    n = F.coalesce("n_docs", F.lit(1))
    sums = links.groupBy("row").agg(F.sum(F.when(n == F.col("most"), F.col("links")).otherwise(0)).alias("n_best"),
                                    F.sum(n * F.col("links")).alias("count_sum"))
    none = F.lit(0).cast("long")
    return (aligned.drop("pairs", "links").join(sums, "row", "left").drop("row")
            .withColumns({c: F.coalesce(c, none) for c in ("n_best", "count_sum")}))
