"""Language ID by compression (zstandard with one raw-content dictionary per language).

``fit`` takes, per language, the labelled rows with the smallest hash of their id: at most
``SAMPLE_DOCS`` rows (found below a hash threshold that the language's row count gives), joined into a dictionary of ``DICT_BYTES`` bytes. That bounded sample
is all that is learned. ``identify`` compresses every whole text, lower-cased, in pieces of
``PIECE_BYTES`` bytes (so the dictionary counts over the whole of a long text) with each
dictionary and takes the language with the fewest bytes. The score is the margin to the
second best, as a share of the second best's bytes (an empty frame's
bytes are not counted); a text is rejected when the score is below ``min_margin`` or when it has no letter.

Defined cases: null, empty or letterless texts are ``und`` with score 0 and rejected; equal
sizes go to the first language in alphabetical order (score 0); one learned language always
wins with score 1; without any labelled row every text is ``und``; null ids hash as ''.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchantry.llm.wordhash import batches
from merchantry.session import ship_package

SAMPLE_DOCS = 400
DICT_BYTES = 1 << 17
PIECE_BYTES = 1 << 12
LEVEL = 9
EMPTY_FRAME = 9
MIN_MARGIN = 0.004
LETTER = regex.compile(r"\p{L}")


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Dictionaries by language from (doc_id, text, lang); at most languages x ``sample_docs``
    x ``dict_bytes`` / 64 characters reach the driver."""
    share = max(1, dict_bytes // 64)          # bytes that one document may give
    id_hash = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sizes = {r[0]: r[1] for r in labelled.filter("lang is not null").groupBy("lang").count().collect()}
    # twice the sample's share of the hash space, so that few rows of any language are shuffled
    space = 1 << 40
    top = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(space, 2 * sample_docs * space // n + 1))]) \
        if sizes else F.create_map(F.lit(""), F.lit(0))
    rows = labelled.filter(F.col("text").rlike(r"\p{L}") & (F.pmod(id_hash, F.lit(space)) < F.try_element_at(top, F.col("lang"))))
    ranked = (rows.select("lang", F.encode(F.substring(F.lower("text"), 1, share), "utf-8").alias("text"),
                          F.pmod(id_hash, F.lit(space)).alias("o0"), F.crc32("text").alias("o1"))
              .withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("o0", "o1", "text")))
              .filter(F.col("nth") <= sample_docs))
    parts: dict[str, list[bytes]] = {}
    for r in ranked.select("lang", "nth", "text").orderBy("lang", "nth").toLocalIterator():
        parts.setdefault(r[0], []).append(bytes(r[2]))
    return {k: b"\n".join(v)[:dict_bytes] for k, v in sorted(parts.items())}


def held_out(doc_id: Column, remainder: int, modulus: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


class Classifier:
    """Built once per task from the dictionaries."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL, piece: int = PIECE_BYTES):
        import zstandard
        self.langs, self.piece = sorted(dictionaries), piece
        self.packers = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.packers.append(zstandard.ZstdCompressor(
                dict_data=d, level=level, write_checksum=False, write_content_size=False, write_dict_id=False))

    def sizes(self, text: bytes) -> list[int]:
        pieces = [text[i:i + self.piece] for i in range(0, len(text), self.piece)]
        return [sum(len(p.compress(x)) - EMPTY_FRAME for x in pieces) for p in self.packers]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not LETTER.search(text):
            return "und", 0.0
        if len(self.langs) == 1:
            return self.langs[0], 1.0
        sizes = self.sizes(text.lower().encode("utf-8", "replace"))
        first, second = np.argsort(sizes, kind="stable")[:2]
        return self.langs[first], min(1.0, max(0.0, (sizes[second] - sizes[first]) / max(1, sizes[second])))


def identify(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """``docs`` (needs ``text``) with ``lang_pred``, ``lang_score`` and ``lang_rejected``.
    Input columns of these names are replaced."""
    ship_package(docs.sparkSession)
    docs = docs.drop("lang_pred", "lang_score", "lang_rejected")
    schema = docs.withColumns({"lang_pred": F.lit(""), "lang_score": F.lit(0.0), "lang_rejected": F.lit(False)}).schema

    def run(it):
        model = Classifier(dictionaries)
        for batch in batches(it, "text"):
            got = [model.predict(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            score = np.array([s for _, s in got], dtype=float)
            und = np.array([x == "und" for x, _ in got], dtype=bool)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x for x, _ in got], pa.string()), pa.array(score),
                 pa.array(und | (score < min_margin))],
                [*batch.schema.names, "lang_pred", "lang_score", "lang_rejected"])
    return docs.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, labelled: DataFrame, min_margin: float = MIN_MARGIN) -> DataFrame:
    """The documents whose language is identified, columns unchanged."""
    ship_package(docs.sparkSession)
    dictionaries = fit(labelled)

    def run(it):
        model = Classifier(dictionaries)
        for batch in batches(it, "text"):
            keep = []
            for t in batch.column(batch.schema.get_field_index("text")).to_pylist():
                lang, score = model.predict(t)
                keep.append(lang != "und" and score >= min_margin)
            yield batch.filter(pa.array(keep, pa.bool_()))
    return docs.mapInArrow(run, docs.schema)
