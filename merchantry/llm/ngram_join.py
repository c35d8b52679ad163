"""Similarity join of documents on word n-grams (size-aware heavy-light join).

A document's set holds its distinct word shingles. Two documents link when
``100 * |intersection| >= percent * |union|``, so both sets share at least
``ceil(percent * n / 100)`` shingles, n being the larger size.

* **Order.** All shingles have one total order: those in the lower ``ZONE`` of the hash space
  by document frequency, then the others by hash. Frequencies are counted for the zone only.
* **Light (small) sets** enumerate the fixed-size subsets (pairs) of their extended prefix, the
  ``n - overlap + 2`` first shingles: two linking sets share two of them. Shingles that only
  one document has can't be shared and are left out.
* **Heavy (large) sets** are scanned through inverted lists of their prefix, the
  ``n - overlap + 1`` first shingles, of which linking sets share one.
* **Boundary.** Both costs are summed by size class over all documents (a bounded histogram) and
  the cheapest boundary is taken. Sets just below the boundary are in both structures.
* **Candidates.** The members of a list (same subset, or same shingle) are first compared with
  the list's most shared member; links are exact set intersections. Then only pairs of one list
  that are still in different components, and whose sizes allow a link, are compared, so
  every link between components is found while a large group of near copies costs one
  comparison a member. Exact copies are one class and need none.

Documents with the same set are a class by a 128-bit digest. Set elements are 63-bit hashes of
shingles.

Defined cases: null and wordless texts have the empty set, size 0, and link with nothing; texts
with fewer words than a shingle are one shingle of all their words; rows that repeat an id are
one document that links when any of its rows does; a null id has component null; an empty table
gives no rows; other columns are ignored (``link_components``) or kept (``one_per_group``).
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from merchantry.llm import wordhash as W
from merchantry.llm.lookup import by_ids, with_ids
from merchantry.operators.components import connected_components
from merchantry.session import discard, materialize, ship_package

SHINGLE = 4
PERCENT = 85
ZONE = 0.25                    # share of the hash space whose frequencies are counted
BIT_WORDS = 16
MORE_WORDS, MORE_FROM = 128, 1200
LEADERS = 16
COMMON = 4096                  # a shingle of at least a 1/COMMON share of the postings is counted apart; at most COMMON are
SUBSET_COST = 1.5              # a subset row (made, hashed, shuffled) against a row of a list
_ZONE_END = int(ZONE * 2 ** 63)


def overlap(n, percent: int):
    """Least number of shared shingles of a link in which the larger set has ``n``."""
    return -(-(percent * n) // 100)


def text_sets(col, size: int):
    """Per text: sorted distinct shingle hashes (int64, not negative)."""
    ws = W.words_of(col, W.SPACE_SEPARATED)
    grams = (W.ngram_hashes(ws.hash, size) >> np.uint64(1)).astype(np.int64)
    for a, b in zip(ws.first[:-1].tolist(), ws.first[1:].tolist()):
        if b - a >= size:
            yield np.unique(grams[a:b - size + 1])
        elif b > a:
            whole = W.ngram_hashes(ws.hash[a:b], b - a) + np.uint64(b - a)
            yield (W.mix64(whole) >> np.uint64(1)).astype(np.int64)
        else:
            yield np.zeros(0, np.int64)


def _parities(s: np.ndarray, words: int) -> list[int]:
    odd = np.bincount(s & (64 * words - 1), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _summaries(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, n, c1, c2, z, lead, grams, bits): ``c1, c2`` digest the set. Only for the first
    set of each class in the task (``lead``): ``grams`` has all shingles in the zone (``z``), then
    as many others as its extended prefix needs; ``bits`` has, for each of ``64 * BIT_WORDS`` hash
    remainders, the parity of the set's shingles, ``more`` the same for ``64 * MORE_WORDS``
    remainders if the set has ``MORE_FROM`` or more."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(it):
        seen: set = set()
        for batch in W.batches(it, "text"):
            n, c1, c2, z, lead, grams, ends, bits, more = [], [], [], [], [], [], [0], [], []
            for s in text_sets(batch.column(1), size):
                u = s.view(np.uint64)
                a = int(W.mix64(u).sum(dtype=np.uint64))
                b = int(W.mix64(u ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64))
                first = len(s) > 0 and (a, b) not in seen
                if first:
                    seen.add((a, b))
                inside = int(np.searchsorted(s, _ZONE_END))
                need = len(s) - overlap(len(s), percent) + 2
                n.append(len(s))
                c1.append(a - (1 << 63))
                c2.append(b - (1 << 63))
                z.append(inside)
                lead.append(first)
                if first:
                    grams.append(s[:max(inside, min(need, len(s)))])
                bits.append(_parities(s, BIT_WORDS) if first else None)
                more.append(_parities(s, MORE_WORDS) if first and len(s) >= MORE_FROM else None)
                ends.append(ends[-1] + (len(grams[-1]) if first else 0))
            flat = np.concatenate(grams) if grams else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int32()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()),
                 pa.array(z, pa.int32()), pa.array(lead, pa.bool_()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64())),
                 pa.array(bits, pa.list_(pa.int64())), pa.array(more, pa.list_(pa.int64()))],
                ["doc_id", "n", "c1", "c2", "z", "lead", "grams", "bits", "more"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {id_type}, n int, c1 long, c2 long, z int, lead boolean, grams array<bigint>, bits array<bigint>, "
            "more array<bigint>")


def _sets(docs: DataFrame, size: int, *more: str) -> DataFrame:
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(it):
        for batch in W.batches(it, "text"):
            sets = list(text_sets(batch.column(1), size))
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets), pa.int64())),
                 *batch.columns[2:]], ["doc_id", "grams", *more])
    kept = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in more)
    return docs.select("doc_id", "text", *more).mapInArrow(run, f"doc_id {id_type}, grams array<bigint>{kept}")


def _with_frequency(postings: DataFrame) -> DataFrame:
    """(row, gram, df): ``postings`` with the number of postings of their shingle. Shingles in at least a
    1/``COMMON`` share of all postings are counted by an aggregate (a sketch over all postings names a
    bounded number of them, the counts are exact), so that no task gathers one; the others by a window."""
    top = postings.agg(F.expr(f"approx_top_k(gram, {COMMON}, {8 * COMMON})").alias("top"),
                       F.count(F.lit(1)).alias("n")).first()
    common = [r["item"] for r in top["top"] or [] if r["count"] * COMMON >= top["n"]]
    if not common:
        return postings.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("gram")))
    counts = postings.filter(F.col("gram").isin(common)).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    rest = postings.filter(~F.col("gram").isin(common))
    return (rest.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("gram")))
            .unionByName(postings.join(F.broadcast(counts), "gram")))


def _prefixes(summary: DataFrame, percent: int) -> DataFrame:
    """(row, node, n, gram, df, nth, keep, shared): the shared shingles of every lead's extended
    prefix. A document is a lead once per task and text, so sets are ranked by ``row``. ``nth`` counts those that are kept, ``keep`` is the length of its plain prefix
    among them, ``shared`` says how many of its zone other documents have."""
    leads = summary.filter("lead").filter(F.col("doc_id").isNotNull())
    postings = leads.select("row", F.explode("grams").alias("gram"))
    outside = F.col("gram") >= _ZONE_END
    known = _with_frequency(postings).filter((F.col("df") > 1) | outside).withColumn("outside", outside)
    by_row = Window.partitionBy("row")
    order = by_row.orderBy("outside", F.when(F.col("outside"), 0).otherwise(F.col("df")), "gram")
    prefix = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)).cast("int") + 1
    ranked = (known.withColumn("nth", F.row_number().over(order))
              .withColumn("shared", F.sum(F.when(F.col("outside"), 0).otherwise(1)).over(by_row))
              .join(leads.select("row", F.col("doc_id").alias("node"), "n", "z"), "row")
              .withColumn("keep", prefix - (F.col("z") - F.col("shared"))))
    return (ranked.filter((F.col("nth") <= F.col("keep") + 1) & (F.col("df") > 1))
            .select("row", "node", "n", "gram", "df", "nth", "keep", F.col("shared").cast("int").alias("shared")))


def choose_boundary(prefixes: DataFrame) -> int:
    """Largest size of a light set, by cost over all documents (at most one row per power of
    1.1 reaches the driver). A light set costs its subsets, a heavy one its list entries, those of
    long lists somewhat more: a member is compared with its list's leader, not with every member."""
    size_class = F.floor(F.log("n") / F.log(F.lit(1.1))).cast("int")
    light = (prefixes.groupBy("row", "n").agg(F.count(F.lit(1)).alias("s"))
             .groupBy(size_class.alias("k")).agg(F.sum(F.col("s") * (F.col("s") - 1) / 2).alias("light"), F.max("n").alias("top")))
    heavy = (prefixes.filter(F.col("nth") <= F.col("keep"))
             .groupBy(size_class.alias("k")).agg(F.sum(1 + F.log("df")).alias("heavy")))
    rows = light.join(heavy, "k", "full").select("k", "light", "heavy", "top").collect()
    rows.sort(key=lambda r: r["k"])
    best, boundary = None, 1
    for i in range(len(rows) + 1):
        cost = (sum(SUBSET_COST * (r["light"] or 0) for r in rows[:i]) + sum(r["heavy"] or 0 for r in rows[i:]))
        if best is None or cost < best:
            best, boundary = cost, (rows[i - 1]["top"] or 1) if i else 1
    return boundary


def _lists(prefixes: DataFrame, boundary: int, percent: int) -> DataFrame:
    """(key, node, n, shared): members of every list that has two or more. Lists with the same
    first and last member are merged, since near copies share very many lists."""
    own = ["node", "n", "shared"]
    heavy = (prefixes.filter((F.col("nth") <= F.col("keep")) & (F.col("n") * 100 >= boundary * percent))
             .select(F.xxhash64(F.lit(1), "gram").alias("key"), *own))
    small = (prefixes.filter((F.col("n") <= boundary) & (F.col("n") > 1))
             .groupBy("row", *own).agg(F.sort_array(F.collect_set("gram")).alias("g")))
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("g") - 1), lambda i: F.transform(
        F.slice("g", i + 1, F.size("g")), lambda x: F.xxhash64(F.lit(2), F.element_at("g", i), x))))
    light = small.filter(F.size("g") > 1).select(F.explode(pairs).alias("key"), *own)
    rows = materialize(heavy.unionByName(light), "list_rows")
    ends = (rows.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo != hi"))
    lists = materialize(rows.join(ends, "key").select(F.xxhash64("lo", "hi").alias("key"), *own).distinct(), "lists")
    discard(rows)
    return lists


def _may_link(na: str, nb: str, bits_a: str, bits_b: str, percent: int):
    """False only if the sizes, or the parities that differ, rule a link out: each of these takes
    a shingle that one set has and the other hasn't, and a link has few of them. Null parities rule
    nothing out."""
    differ = F.lit(0)
    for i in range(BIT_WORDS):
        differ = differ + F.bit_count(F.col(bits_a)[i].bitwiseXOR(F.col(bits_b)[i]))
    return ((F.least(na, nb) * 100 >= F.greatest(na, nb) * percent)
            & (F.coalesce(differ, F.lit(0)) * (100 + percent) <= (F.col(na) + F.col(nb)) * (100 - percent)))


def _not_ruled_out(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), those of large sets only if their longer parity vectors allow a link."""
    a, b = (bits.filter("more is not null").select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("more").alias(f"m{c}"))
            for c in "ab")
    differ = F.aggregate(F.zip_with("ma", "mb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    ruled_out = differ * (100 + percent) > (F.col("na") + F.col("nb")) * (100 - percent)
    return (pairs.join(a, "a", "left").join(b, "b", "left")
            .filter(~F.coalesce(ruled_out, F.lit(False))).select("a", "b"))


def _verify(candidates: DataFrame, docs: DataFrame, bits: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by exact intersection of the sets of their documents."""
    pairs = materialize(_not_ruled_out(candidates, bits, percent), "compared_pairs")
    discard(candidates)
    ends = materialize(pairs.select(F.col("a").alias("doc_id"), F.lit(True).alias("is_a")).unionByName(
        pairs.select(F.col("b").alias("doc_id"), F.lit(False).alias("is_a"))).groupBy("doc_id").agg(
        F.bool_or("is_a").alias("is_a"), F.bool_or(~F.col("is_a")).alias("is_b")), "compared")
    wanted = ends.select("doc_id", (F.col("is_a").cast("int") + 2 * F.col("is_b").cast("int")).alias("side"))
    sets = materialize(_sets(with_ids(docs, wanted), size, "side"), "compared_sets")
    a = sets.filter("side != 2").select(F.col("doc_id").alias("a"), F.col("grams").alias("ga"))
    b = sets.filter("side != 1").select(F.col("doc_id").alias("b"), F.col("grams").alias("gb"))
    links = materialize(
        pairs.join(a, "a").join(b, "b").withColumn("i", F.size(F.array_intersect("ga", "gb")))
        .filter(F.col("i") * 100 >= (F.size("ga") + F.size("gb") - F.col("i")) * percent)
        .select("a", "b").distinct(), "links")
    discard(pairs, ends, sets)
    return links


def _leader_pairs(lists: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Every member with its list's leader, unless ruled out. Lists are dealt to LEADERS orders by
    their key, each has the first member of its order: the lists of a group of near copies then
    have few leaders in all, but a member that is in several lists meets more than one."""
    order = F.pmod("key", F.lit(LEADERS))
    first = F.when(order == 0, F.col("shared")).otherwise(F.xxhash64(order, "node"))
    lead = materialize(lists.groupBy("key").agg(F.max(F.struct(first.alias("o"), "node", "n")).alias("l")), "list_leaders")
    pairs = (lists.join(lead, "key").filter(F.col("node") != F.col("l.node"))
             .select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("l.node").alias("y"), F.col("l.n").alias("ny")))
    x, y = (bits.select(F.col("node").alias(c), F.col("bits").alias(f"b{c}")) for c in "xy")
    found = materialize(pairs.distinct().join(x, "x").join(y, "y").filter(_may_link("nx", "ny", "bx", "by", percent))
                        .select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "leader_pairs")
    discard(lead)
    return found


def _cross_pairs(lists: DataFrame, components: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Pairs of one list that are in different components, unless ruled out."""
    comp = components.select("node", "component")
    named = lists.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = materialize(named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"))
                        .groupBy("key").agg(F.max_by("component", "m").alias("main"), F.count(F.lit(1)).alias("parts"))
                        .filter("parts > 1").select("key", "main"), "split_keys")
    rows = materialize(named.join(split, "key").join(bits.select("node", "bits"), "node")
                       .select("key", "node", "n", "component", "main", "bits"), "split_lists")
    # one side of a pair is outside the list's largest component
    x, y = (rows.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "component", "main", "bits")]) for s in "ab")
    found = materialize(
        x.filter("component_a != main_a").join(y, "key").filter("component_a != component_b")
        .filter(_may_link("n_a", "n_b", "bits_a", "bits_b", percent))
        .select(F.greatest("node_a", "node_b").alias("a"), F.least("node_a", "node_b").alias("b")).distinct(), "cross_pairs")
    discard(split, rows)
    return found


def _bits(summary: DataFrame, members: DataFrame) -> DataFrame:
    """(node, n, bits, more) of list members; an id with different sets has null parities, since a
    link of any of them counts."""
    leads = (summary.filter("lead").select(F.col("doc_id").alias("node"), "n", "c1", "c2", "bits", "more")
             .join(members.withColumnRenamed("doc_id", "node"), "node", "left_semi"))
    key = F.struct("n", "c1", "c2")
    many = leads.groupBy("node").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).filter("lo != hi").select(
        "node", F.lit(True).alias("many"))
    one = leads.dropDuplicates(["node"]).join(many, "node", "left")
    return one.select("node", "n", *[F.when(F.col("many").isNull(), F.col(c)).alias(c) for c in ("bits", "more")])


def link_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (needs doc_id, text)."""
    ship_package(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    summary = materialize(_summaries(docs, shingle, percent).withColumn("row", F.monotonically_increasing_id()), "set_summaries")
    prefixes = materialize(_prefixes(summary, percent), "prefixes")
    lists = _lists(prefixes, choose_boundary(prefixes), percent)
    discard(prefixes)
    members = materialize(lists.select(F.col("node").alias("doc_id")).distinct(), "list_members")
    bits = materialize(_bits(summary, members), "member_bits")

    reps = materialize(summary.filter("n > 0").groupBy("c1", "c2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    of_class = summary.select("doc_id", "n", "c1", "c2").join(reps, ["c1", "c2", "n"], "left")
    named = materialize(of_class.select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                                        F.coalesce("rep", "doc_id").alias("rep")), "class_members")
    discard(summary, reps)
    copies = named.filter("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    # copies that no list has need no part in the search for components of list members
    listed = copies.join(members.withColumnRenamed("doc_id", "a"), "a", "left_semi")

    found = _verify(_leader_pairs(lists, bits, percent), docs, bits, shingle, percent)
    comp = materialize(connected_components(found.unionByName(listed)), "list_components")
    more = _verify(_cross_pairs(lists, comp, bits, percent), docs, bits, shingle, percent)
    discard(lists, members, bits, comp)
    links = found.unionByName(more)
    rep_of = named.select("doc_id", "rep").distinct()
    ends = (links.join(rep_of.select(F.col("doc_id").alias("a"), F.col("rep").alias("ra")), "a")
            .join(rep_of.select(F.col("doc_id").alias("b"), F.col("rep").alias("rb")), "b").select("ra", "rb"))
    # rows that repeat an id with different texts tie their classes together
    repeated = copies.join(copies.groupBy("a").agg(F.min("b").alias("m")), "a").filter("b != m").select(
        F.col("b").alias("ra"), F.col("m").alias("rb"))
    whole = materialize(connected_components(ends.unionByName(repeated), "ra", "rb"), "components")
    return (named.join(whole.select(F.col("node").alias("rep"), "component"), "rep", "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("n_shingles") == 0, F.col("doc_id"))
                    .otherwise(F.coalesce("component", "rep")).alias("component_id")))


def one_per_group(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents whose component has a smaller id, columns unchanged."""
    found = link_components(docs, shingle, percent)
    gone = found.filter("component_id < doc_id").select("doc_id").distinct()
    return by_ids(docs, materialize(gone, "linked_copies"), keep=False)
