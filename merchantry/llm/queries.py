"""The registered queries ``opN_<name>`` of this subpackage: thin reports over the operators."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantry.llm import (chat, decontaminate, embedding_dups, katz, langid, licenses, line_dedup, ngram_join, packing,
                            pivot_search, token_alignment, token_counts, whitening)
from merchantry.llm.catalog import register
from merchantry.llm.langid import held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op4_nnls_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@register("op8_compression_language")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    training = docs.filter(~held_out(F.col("doc_id"), 2, 4)).select("doc_id", "text", "lang")
    found = langid.identify(docs.select("doc_id", "text"), langid.fit(training))
    return found.select("doc_id", held_out(F.col("doc_id"), 2, 4).alias("held_out"), "lang_pred",
                        F.col("lang_score").alias("score"))


@register("op9_wu_manber_leaks")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                    table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("bench_spans", F.lit(0).cast("long"), lambda a, s: a + s["length"])
    return hits.select(
        "doc_id", F.col("bench_words").alias("n_words"), n_hit.alias("n_hit"),
        F.size("bench_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("bench_items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"))


@register("op7_heavy_light_join")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id")


@register("op6_fuzzy_line_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").alias("before"))
    out = line_dedup.dedup_lines(docs)
    lines = lambda c: F.size(F.split(F.coalesce(F.col(c), F.lit("")), "\n")).cast("long")
    return out.select("doc_id", lines("before").alias("n_lines"), F.size("lines_removed").cast("long").alias("n_removed"),
                      "lines_removed", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


@register("op1_chat_fingerprints")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(
        spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.explode(F.array(
            F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role")),
            F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role")))).alias("r"))
        .select("conv_id", "r.turn", "r.role", F.lit(sample).alias("text")))
    records = rows.select("conv_id", "turn", F.to_variant_object(F.struct("role", "text")).alias("record"))
    turns = chat.segments(chat.canonical(records), ["conv_id", "turn"])
    return chat.digests(turns, "conv_id", ["turn", "role", "text"])


@register("op2_pivot_top_k")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@register("op3_license_digests", licenses.scan_sql())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs, licenses.known_digests(spark)).select("doc_id", "license_digest", "license_id")


#: Personal data and shouting marks that a cleaning step edits: e-mail addresses, long numbers, "!!".
MASKED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+|[0-9][0-9 ()-]{5,}[0-9]|!{2,}"


@register("op10_edited_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    edited = token_counts.recount(token_counts.with_pattern_edits(docs, MASKED, "[x]"))
    return edited.select("doc_id", "tokens_before", F.size("edits").cast("long").alias("n_edits"),
                         "tokens_after", "pretokens_after", "reencoded_chars", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


@register("op5_katz_backoff")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, _ = katz.fit_and_score(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                   held_out(F.col("doc_id"), 0, 10))
    return scores


@register("op11_hnsw_near_dups")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dups.near_duplicates(table(spark, sf_dir, "embeddings"))


@register("op12_chebyshev_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@register("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.scored(table(spark, sf_dir, "documents").select("doc_id", "text"))
