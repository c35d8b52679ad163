"""Brand families (C9 token-containment self join, G5 connected components).

Edges: a -> b when tokens(a) is a subset of tokens(b). Instead of comparing all pairs,
each name is joined only on its rarest token (any superset must contain it). The list of a
token that very many names hold is dealt to several salts, and a 64-bit signature of the token
set (a bit per token hash) rules pairs out in the join; the subset test runs on what is left. One-word names contained in >= 3 others are hubs
and do not link. Components come from alternating large-star and small-star rounds.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry import constants as K
from merchantry.functions.text import name_tokens
from merchantry.operators import components


POSTING_ROWS = 4096            # names of one token in a salt


def name_token_table(names: DataFrame, col: str = "name") -> DataFrame:
    return names.select(F.col(col).alias("name"), name_tokens(col).alias("toks")).distinct()


def hubs(tt: DataFrame) -> DataFrame:
    """One-token names whose token occurs in at least HUB_MIN_CONTAINERS other names."""
    per_tok = (tt.select("name", F.explode("toks").alias("tok"))
               .groupBy("tok").agg(F.countDistinct("name").alias("_f")))
    single = tt.filter(F.size("toks") == 1).select("name", F.col("toks")[0].alias("tok"))
    return (single.join(per_tok, "tok")
            .filter(F.col("_f") - 1 >= K.HUB_MIN_CONTAINERS).select("name"))


def _signature(toks: str):
    """A bit per token: that of its hash modulo 64. A subset's bits are among its superset's."""
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(t), F.lit(64)).cast("int"))
    return F.aggregate(toks, F.lit(0).cast("long"), lambda acc, t: acc.bitwiseOR(bit(t)))


def containment_edges(names: DataFrame, col: str = "name", posting_rows: int = POSTING_ROWS) -> DataFrame:
    """(a, b) with tokens(a) a subset of tokens(b), a != b, neither empty nor a hub."""
    tt = name_token_table(names, col)
    tt = tt.join(hubs(tt), "name", "left_anti").filter(F.size("toks") > 0)
    exploded = tt.select("name", "toks", F.explode("toks").alias("tok"))
    freq = exploded.groupBy("tok").agg(F.count(F.lit(1)).alias("_f"))
    rarest = (exploded.join(freq, "tok")
              .groupBy("name", "toks")
              .agg(F.min_by("tok", F.struct("_f", "tok")).alias("tok")))
    salts = F.ceil(F.col("_f") / F.lit(posting_rows)).cast("int")
    a = (rarest.join(freq, "tok")
         .select(F.col("name").alias("a"), F.col("toks").alias("ta"), "tok", _signature("toks").alias("sa"),
                 F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")))
    b = (exploded.join(freq, "tok")
         .select(F.col("name").alias("b"), F.col("toks").alias("tb"), "tok", _signature("toks").alias("sb"),
                 F.pmod(F.xxhash64("name"), salts).cast("int").alias("salt")))
    inside = (F.col("sa").bitwiseAND(F.bitwise_not("sb")) == 0) & (F.size("ta") <= F.size("tb"))
    return (a.join(b, ["tok", "salt"])
            .filter(inside & (F.col("a") != F.col("b")) & (F.size(F.array_except("ta", "tb")) == 0))
            .select("a", "b"))


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, family) where family = the smallest name of the component.
    ``nodes`` has ``name``; ``edges`` has (a, b), treated as undirected. The rounds grow with the
    logarithm of the longest chain (``operators/components.py``)."""
    found = components.connected_components(edges).select(F.col("node").alias("name"), F.col("component").alias("family"))
    return (nodes.select("name").distinct().join(found, "name", "left")
            .select("name", F.coalesce("family", "name").alias("family")))


def brand_families(merchants: DataFrame, col: str = "name") -> DataFrame:
    """Merchant -> family key (smallest name in its family) from containment edges
    plus the explicit family links present in the list."""
    names = merchants.select(F.col(col).alias("name")).filter(F.col("name").isNotNull()).distinct()
    edges = containment_edges(names)
    spark = merchants.sparkSession
    links = spark.createDataFrame(K.FAMILY_LINKS, "a string, b string")
    links = (links.join(names.withColumnRenamed("name", "a"), "a", "left_semi")
             .join(names.withColumnRenamed("name", "b"), "b", "left_semi").select("a", "b"))
    return connected_components(names, edges.unionByName(links))


def family_sizes(fam: DataFrame) -> DataFrame:
    return fam.groupBy("family").agg(F.count(F.lit(1)).alias("size"))

