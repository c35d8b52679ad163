"""Fuzzy line deduplication (MinHash over character shingles), DataFrame functions only.

1. Every non-blank line, trimmed and lower-cased, is keyed by two 64-bit hashes; equal lines are
   one class.
2. A class's signature has ``VALUES`` MinHash values of its character shingles of length
   ``SHINGLE_CHARS`` (a shorter line is one shingle), whatever the script, the length and whether or not
   it has spaces: the smallest and largest of the shingles' hashes under each seed. A band is six values, one of each
   sixth of the signature, every value is in six bands: lines 0.8 alike share one of the 66 bands with probability
   0.9999 if values are independent, lines 0.2 alike with 0.004, lines 0.1 alike with 0.00007, and lines with equal
   sets always. Lines of one language are some 0.1 alike, so that what shares a band is mostly alike.
   Equal lines meet first, so that each class is hashed once and nothing but texts and bands is shuffled, the bands
   a sixth at a time.
3. Candidates are verified exactly: the Jaccard similarity of the sets of all ``SHINGLE_CHARS``
   character shingles (a shorter line is one shingle) is at least ``threshold``. No pair is compared that
   an exact bound rules out: ``SKETCH_WORDS`` words of parities of each set (more, the longer the line: sets
   much larger than that would differ in half of them) differ at most as often as the sets themselves.
   A band is cut where, by falling size, the next set is too small for any before it. Each line is first compared
   with the band leader (the line with most copies) it shares most bands with, then, if the pairs left would be more than
   ``PAIRS_A_ROW`` a line, up to ``ROUNDS`` times, lines outside their band's largest component with new leaders, one
   from it and one from outside: each takes as many pairs as there are lines. Of the other pairs of a band only those in
   different components are compared. Of these, each line is first compared with the one whose parities differ least,
   then pairs still apart are.
4. Distributed union-find gives the components; of each, the first line (document id, line number)
   stays.

``docs`` is read several times, so it should be a table or cheap to compute.

Defined cases: blank lines are never removed; null texts stay null and texts without duplicate
lines stay as they are; documents with a null id take no part and stay as they are; rows that
repeat an id are one document (the same lines go from each); an empty table gives no rows;
other columns pass through.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchantry.llm.lookup import BROADCAST_IDS, with_ids
from merchantry.operators.components import connected_components
from merchantry.session import discard, materialize

SHINGLE_CHARS = 5
THRESHOLD = 0.8
SKETCH_WORDS = 8
SKETCH_CHARS = 256             # characters of a line per SKETCH_WORDS words, rounded up to a power of two of them
MAX_SKETCH_PARTS = 64
SHINGLES_A_ROW = 4
ROUNDS = 3
PAIRS_A_ROW = 64               # pairs of a row of the bands, on average, that are compared without a round before
#: Each seed gives two signature values. The seeds differ in their first bits, so that the values of a
#: line are mostly those of different shingles.
SEEDS = [k * 64 // 33 << 57 | k * 0x1D872B41A3C5F60B % (1 << 57) for k in range(33)]
VALUES = 2 * len(SEEDS)
VALUE_BITS = 16                # of a shingle's hash: what a value keeps of its shingle, four values to a word
BAND_VALUES = 6
_STEP = VALUES // BAND_VALUES
_PACKED = 64 // VALUE_BITS
#: Bands: one value from each sixth of the signature, in six arrangements that have no pair of values in common.
BANDS = [[tuple(q * _STEP + (j + q * turn) % _STEP for q in range(BAND_VALUES)) for j in range(_STEP)] for turn in range(6)]


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line, h1, h2): non-blank lines, trimmed and lower-cased."""
    return (docs.filter(F.col("doc_id").isNotNull())
            .select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
            .withColumn("line", F.lower(F.btrim("line", F.lit(" \t\r\x0b\x0c\xa0"))))
            .filter(F.col("line") != "")
            .withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(7), "line")}))


def _grams(line: str, size: int) -> Column:
    """A line's character shingles in order: every match of one character that looks ahead."""
    ahead = F.regexp_extract_all(line, F.lit(f"(?s)(?=(.{{{size}}}))."), F.lit(1))
    return F.when(F.char_length(line) < size, F.array(line)).otherwise(ahead)


def line_classes(lines: DataFrame) -> DataFrame:
    """(h1, h2, rank, s0, s1, ...) per class of equal lines; ``rank`` is 63 less the number of times its copies can be
    halved, the words s0, s1, ... are its signature, VALUE_BITS of each value. Lines are shuffled once, by their keys;
    their shingles are rows that a hash aggregate takes in where they are made."""
    distinct = lines.groupBy("h1", "h2").agg(F.first("line").alias("line"), F.count(F.lit(1)).alias("copies"))
    rank = (63 - F.floor(F.log2("copies"))).alias("rank")
    # four bytes a character: a shingle is found by its place and cut out as bytes
    wide = distinct.select("h1", "h2", rank, F.encode("line", "UTF-32").alias("wide"))
    last = F.greatest(F.octet_length("wide") - 4 * SHINGLE_CHARS + 1, F.lit(1))
    # several shingles a row, so that the aggregate's buffer is updated less often; the last row repeats the last shingle
    at = [F.least(F.col("i") + 4 * k, F.col("last")) for k in range(SHINGLES_A_ROW)]
    hashed = (wide.select("h1", "h2", "rank", "wide", last.alias("last"))
              .select("h1", "h2", "rank", "wide", "last", F.explode(F.sequence(F.lit(1), "last", F.lit(4 * SHINGLES_A_ROW))).alias("i"))
              .select("h1", "h2", "rank", *[F.xxhash64(F.substring("wide", i, F.lit(4 * SHINGLE_CHARS))).alias(f"g{k}")
                                            for k, i in enumerate(at)]))
    values = []
    for k, seed in enumerate(SEEDS):
        g = [F.col(f"g{j}").bitwiseXOR(F.lit(seed)) for j in range(SHINGLES_A_ROW)]
        values += [F.min(F.least(*g)).alias(f"v{2 * k}"), F.max(F.greatest(*g)).alias(f"v{2 * k + 1}")]
    low = lambda k: F.col(f"v{k}").bitwiseAND(F.lit((1 << VALUE_BITS) - 1))
    words = [reduce(Column.bitwiseOR, [F.shiftleft(low(k), k % _PACKED * VALUE_BITS) for k in range(w, min(w + _PACKED, VALUES))])
             for w in range(0, VALUES, _PACKED)]
    return hashed.groupBy("h1", "h2", "rank").agg(*values).select(
        "h1", "h2", "rank", *[word.alias(f"s{i}") for i, word in enumerate(words)])


def _band_members(classes: DataFrame, turn: int) -> DataFrame:
    """(band, node): members of every band of an arrangement that has two or more lines. The band is named by a hash
    of the set of its members, so that bands of the same lines have one name."""
    value = lambda k: F.shiftrightunsigned(f"s{k // _PACKED}", k % _PACKED * VALUE_BITS).bitwiseAND(F.lit((1 << VALUE_BITS) - 1))
    keys = F.array(*[F.xxhash64(F.lit(turn * _STEP + j), *[value(k) for k in band]) for j, band in enumerate(BANDS[turn])])
    members = F.bit_xor(F.xxhash64("node")).over(Window.partitionBy("key"))
    return (classes.select("node", F.explode(keys).alias("key")).withColumn("band", members)
            .filter(F.col("band") != F.xxhash64("node")).select("band", "node"))


def _bands(classes: DataFrame) -> DataFrame:
    """(band, node, w): members of every band that has two or more lines, ``w`` bands of the same lines being one. The
    arrangements are dealt out one after the other, so that no shuffle holds more than the bands of one."""
    turns = [materialize(_band_members(classes, turn), "turn_bands") for turn in range(len(BANDS))]
    bands = materialize(reduce(DataFrame.unionByName, turns).groupBy("band", "node").agg(F.count(F.lit(1)).alias("w")), "line_bands")
    discard(*turns)
    return bands


def _sized_bands(bands: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """``bands`` (band, node and others) and a leader: cut where, by falling size of the members' sets, the next one is too
    small to be alike with any before it; parts of one line go. A part's leader is its least node."""
    by_size = Window.partitionBy("band").orderBy(F.desc("n"), "node")
    cut = F.col("n") + 1e-6 < threshold * F.lag("n").over(by_size)
    runs = (bands.join(sketches.select("node", "n"), "node").withColumn("cut", F.coalesce(cut, F.lit(False)).cast("int"))
            .withColumn("band", F.xxhash64("band", F.sum("cut").over(by_size))))
    in_run = Window.partitionBy("band")
    return (runs.withColumns({"m": F.count(F.lit(1)).over(in_run), "leader": F.min("node").over(in_run)})
            .filter("m > 1").select(*bands.columns, "leader"))


def _shingles(line: str) -> Column:
    """The set of a line's character shingles."""
    return F.array_distinct(_grams(line, SHINGLE_CHARS))


def _texts(keys: DataFrame, lines: DataFrame) -> DataFrame:
    """(node, line) of the classes ``keys`` (node, h1, h2)."""
    found = with_ids(lines.select("h1", "h2", "line"), keys, key=["h1", "h2"])
    return found.groupBy("node").agg(F.first("line").alias("line"))


def _sketches(texts: DataFrame) -> DataFrame:
    """(node, n, p0, p1, ..., wide): size of the line's shingle set, and for each of ``64 * SKETCH_WORDS`` hash
    remainders the parity of the set's shingles; ``wide``, null for lines up to SKETCH_CHARS characters, is the same for as
    many more remainders as the line is longer. Equal remainders of ``wide`` add up to those of the words."""
    tiers = F.ceil(F.log2(F.char_length("line") / SKETCH_CHARS))
    parts = F.pow(F.lit(2.0), F.least(F.greatest(tiers, F.lit(0)), F.lit(MAX_SKETCH_PARTS.bit_length() - 1))).cast("int")
    grams = (texts.select("node", parts.alias("parts"), F.explode(_shingles("line")).alias("g"))
             .select("node", "parts", F.xxhash64("g").alias("g"))
             .withColumn("part", F.shiftrightunsigned("g", (64 * SKETCH_WORDS).bit_length() - 1).bitwiseAND(F.col("parts") - 1)))
    bit = F.expr("shiftleft(1L, cast(g & 63 as int))")
    word = F.col("g").bitwiseAND(F.lit(64 * (SKETCH_WORDS - 1)))
    names = [f"p{k}" for k in range(SKETCH_WORDS)]
    words = [F.bit_xor(F.when(word == 64 * k, bit).otherwise(F.lit(0).cast("long"))).alias(p) for k, p in enumerate(names)]
    each = grams.groupBy("node", "parts", "part").agg(F.count(F.lit(1)).alias("n"), *words)
    short = each.filter("parts = 1").select("node", "n", *names, F.lit(None).cast("array<bigint>").alias("wide"))
    # a part without shingles has no row
    found = F.map_from_entries(F.collect_list(F.struct("part", F.array(*names))))
    none = F.array(*[F.lit(0).cast("long")] * SKETCH_WORDS)
    wide = F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1),
                                 lambda k: F.coalesce(F.try_element_at("m", k), none)))
    long = (each.filter("parts > 1").groupBy("node", "parts")
            .agg(F.sum("n").alias("n"), *[F.bit_xor(p).alias(p) for p in names], found.alias("m"))
            .select("node", "n", *names, wide.alias("wide")))
    return short.unionByName(long)


def _differ() -> Column:
    """Number of parities in which the sets ``a`` and ``b`` differ."""
    return sum((F.bit_count(F.col(f"p{k}_a").bitwiseXOR(F.col(f"p{k}_b"))) for k in range(SKETCH_WORDS)), F.lit(0))


def _differ_wide() -> Column:
    """The same for the wide parities, at the smaller number of them; null if one side has none, or one has more
    than twice as many."""
    size = F.least(F.size("wide_a"), F.size("wide_b"))
    xor = lambda x, y: x.bitwiseXOR(y)
    fold = lambda w: F.when(F.size(w) > size, F.zip_with(F.slice(w, 1, size), F.slice(w, size + 1, size), xor)).otherwise(F.col(w))
    counts = F.zip_with(fold("wide_a"), fold("wide_b"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    # a null side, whose size is -1 or null, meets neither condition
    comparable = (F.size("wide_a") > 0) & (F.size("wide_b") > 0) & (F.greatest(F.size("wide_a"), F.size("wide_b")) <= 2 * size)
    return F.when(comparable, F.aggregate(counts, F.lit(0), lambda total, x: total + x))


def _may_link(threshold: float) -> Column:
    """False only if the sizes of the sets ``a`` and ``b``, or the parities that differ, rule a link out."""
    n_a, n_b = F.col("n_a"), F.col("n_b")
    rounding = 1e-6
    near = lambda differ: differ * (1 + threshold) <= (n_a + n_b) * (1 - threshold) + rounding
    return ((F.least(n_a, n_b) + rounding >= threshold * F.greatest(n_a, n_b))
            & near(_differ()) & F.coalesce(near(_differ_wide()), F.lit(True)))


def _verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose lines are alike, by exact Jaccard similarity."""
    both = (pairs.join(texts.select(F.col("node").alias("a"), F.col("line").alias("la")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("line").alias("lb")), "b"))
    # explode of one element: filters on its result are not pushed below it, which would compute the
    # sets once for every mention
    sets = both.select("a", "b", F.explode(F.array(F.struct(_shingles("la").alias("a"), _shingles("lb").alias("b")))).alias("s"))
    counts = F.struct(F.size(F.array_intersect("s.a", "s.b")).alias("i"), (F.size("s.a") + F.size("s.b")).alias("n"))
    shared = sets.select("a", "b", F.explode(F.array(counts)).alias("c"))
    return shared.filter(F.col("c.i") * (1 + threshold) >= threshold * F.col("c.n")).select("a", "b")


def _cross_pairs(rest: DataFrame, threshold: float) -> DataFrame:
    """(a, b, gap): pairs of one band in different components, unless ruled out; one side is outside
    the band's largest component. ``gap`` is the share of parities that differ."""
    x, y = (rest.select("band", *[F.col(c).alias(f"{c}_{s}") for c in rest.columns if c != "band"]) for s in "ab")
    other = F.col("component_a") != F.col("component_b")
    once = (F.col("component_b") == F.col("main_b")) | (F.col("node_a") < F.col("node_b"))
    return (x.filter("component_a != main_a").join(y, "band").filter(other & once & _may_link(threshold))
            .select(F.greatest("node_a", "node_b").alias("a"), F.least("node_a", "node_b").alias("b"),
                    (_differ() / (F.col("n_a") + F.col("n_b"))).alias("gap")).distinct())


def _nearest(pairs: DataFrame) -> DataFrame:
    """For every node the pair (a, b) with the smallest gap that it is in."""
    best = F.min_by(F.struct("a", "b"), F.struct("gap", "a", "b")).alias("p")
    return pairs.select("*", F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(best).select("p.a", "p.b").distinct()


def _apart(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """The pairs (a, b) whose nodes are in different components."""
    for c in "ab":
        named = components.select(F.col("node").alias(c), F.col("component").alias(f"component_{c}"))
        pairs = pairs.join(named, c, "left").withColumn(f"component_{c}", F.coalesce(f"component_{c}", c))
    return pairs.filter("component_a != component_b").select("a", "b")


def _possible(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes that their sketches don't rule out."""
    for c in "ab":
        pairs = pairs.join(sketches.select(*[F.col(x).alias(c if x == "node" else f"{x}_{c}") for x in sketches.columns]), c)
    return pairs.filter(_may_link(threshold)).select("a", "b")


def _split(bands: DataFrame, components: DataFrame) -> DataFrame:
    """(band, node, component, main): members of those ``bands`` (band, node) that lie in several components, with the
    band's largest one."""
    named = bands.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = materialize(named.select("band", "node", "component"), "named_bands")
    main = materialize(named.groupBy("band", "component").agg(F.count(F.lit(1)).alias("m"))
                       .groupBy("band").agg(F.max_by("component", "m").alias("main"), F.count(F.lit(1)).alias("parts"))
                       .filter("parts > 1").select("band", "main"), "split_keys")
    split = materialize(named.join(main, "band").select("band", "node", "component", "main"), "split_bands")
    discard(named, main)
    return split


def _to_leaders(split: DataFrame, turn: int) -> DataFrame:
    """(a, b): a line outside its band's largest component with a leader of the band, one of that component and one
    of the others; of all its bands' leaders of a kind, the one it shares most bands with. Leaders are least by
    their number with bits flipped as ``turn`` says."""
    flip = F.lit(SEEDS[turn + 1] & (1 << 62) - 1)
    leaders = split.groupBy("band", (F.col("component") == F.col("main")).alias("inside")).agg(
        F.min(F.col("node").bitwiseXOR(flip)).alias("least"))
    leaders = leaders.select("band", "inside", F.col("least").bitwiseXOR(flip).alias("leader"))
    shared = (split.filter("component != main").select("band", "node").join(leaders, "band").filter("node != leader")
              .groupBy("node", "inside", "leader").agg(F.count(F.lit(1)).alias("m")))
    best = shared.groupBy("node", "inside").agg(F.max_by("leader", F.struct("m", "leader")).alias("leader"))
    return best.select(F.greatest("node", "leader").alias("a"), F.least("node", "leader").alias("b")).distinct()


def _is_narrow(split: DataFrame) -> bool:
    """Whether the pairs of a line outside its band's largest component with another of the band are few for a line."""
    members = split.groupBy("band").agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("component") != F.col("main")).alias("out"))
    rows, pairs = members.agg(F.sum("m"), F.sum(F.col("m").cast("double") * F.col("out"))).first()
    return (pairs or 0) <= PAIRS_A_ROW * (rows or 0)


def line_components(lines: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(h1, h2, component) of those of ``lines`` (as ``lines_of`` gives them) that are near another
    line; ``component`` is a number that all lines of a component have."""
    # the more copies, the lower the node: what is near to a line is mostly near to the one copied most
    node = F.shiftleft("rank", 57) + F.monotonically_increasing_id()
    classes = materialize(line_classes(lines).withColumn("node", node).drop("rank"), "line_classes")
    bands = _bands(classes)
    keys = materialize(classes.select("node", "h1", "h2").join(bands.select("node").distinct(), "node", "left_semi"), "line_keys")
    discard(classes)
    texts = materialize(_texts(keys, lines), "line_texts", "zstd")
    sketches = materialize(_sketches(texts), "line_sketches")
    before, bands = bands, materialize(_sized_bands(bands, sketches, threshold), "sized_bands")
    discard(before)
    # every line with the leader it shares most bands with
    star = (bands.filter(F.col("node") != F.col("leader")).groupBy("node", "leader").agg(F.sum("w").alias("m"))
            .groupBy("node").agg(F.max_by("leader", F.struct("m", -F.col("leader"))).alias("leader"))
            .select(F.col("node").alias("a"), F.col("leader").alias("b")))
    star = materialize(_possible(star, sketches, threshold), "line_pairs")
    found = materialize(_verify(star, texts, threshold), "line_links")
    comp = connected_components(found)
    split = _split(bands.select("band", "node"), comp)
    discard(bands)
    for turn in range(ROUNDS):
        if _is_narrow(split):
            break
        near = materialize(_possible(_apart(_to_leaders(split, turn), comp), sketches, threshold), "leader_pairs")
        links = materialize(_verify(near, texts, threshold), "leader_links")
        discard(near)
        if links.isEmpty():
            break
        found = materialize(found.unionByName(links), "line_links")
        comp = connected_components(found)
        before, split = split, _split(split.select("band", "node"), comp)
        discard(before, links)
    rest = materialize(split.join(sketches, "node"), "split_sketches")
    discard(split, sketches)
    cross = materialize(_cross_pairs(rest, threshold), "line_cross_pairs")
    discard(rest)
    nearest = materialize(_nearest(cross), "nearest_pairs")
    found = materialize(found.unionByName(_verify(nearest, texts, threshold)), "line_near_links")
    left = _apart(cross.join(nearest, ["a", "b"], "left_anti"), connected_components(found))
    more = materialize(_verify(materialize(left, "line_last_pairs"), texts, threshold), "line_cross_links")
    discard(texts, cross, nearest)
    return keys.join(connected_components(found.unionByName(more)), "node").select("h1", "h2", "component")


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (needs doc_id, text) with ``text`` without the duplicate lines, plus
    ``lines_removed`` (array of line numbers from 0, empty if none). An input column of that
    name is replaced."""
    lines = lines_of(docs.select("doc_id", "text"))
    comp = line_components(lines, threshold)
    # a line's group: its component, or its keys where it has none
    root = [F.coalesce("component", F.lit(-1)).alias("r0"),
            *[F.when(F.col("component").isNull(), F.col(h)).otherwise(0).alias(r) for h, r in (("h1", "r1"), ("h2", "r2"))]]
    placed = materialize(lines.select("doc_id", "pos", "h1", "h2").join(comp, ["h1", "h2"], "left")
                         .select("doc_id", "pos", *root), "line_places")
    root = ["r0", "r1", "r2"]
    first = materialize(placed.groupBy(*root).agg(F.min(F.struct("doc_id", "pos")).alias("kept"), F.count(F.lit(1)).alias("m"))
                        .filter("m > 1").drop("m"), "first_lines")
    gone = (placed.join(first, root).filter(F.struct("doc_id", "pos") != F.col("kept"))
            .groupBy("doc_id").agg(F.sort_array(F.collect_set("pos")).alias("lines_removed")))
    gone = materialize(gone, "lines_removed")
    discard(placed, first)
    total = gone.agg(F.sum(F.size("lines_removed") + 2)).first()[0] or 0
    docs = docs.drop("lines_removed")
    # split before the join, so that the array is a column and not computed for every line
    own_lines = "_".join(["text_lines", *docs.columns])          # a name that no input column has
    joined = (docs.withColumn(own_lines, F.split("text", "\n"))
              .join(F.broadcast(gone) if total <= BROADCAST_IDS else gone, "doc_id", "left"))
    left = F.array_except(F.sequence(F.lit(0), F.size(F.col(f"`{own_lines}`")) - 1), "lines_removed")
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col(f"`{own_lines}`"), i)), "\n")
    return joined.select(
        *[F.when(F.col("lines_removed").isNotNull(), kept).otherwise(F.col("text")).alias("text") if c == "text"
          else F.col(f"`{c}`") for c in docs.columns],
        F.coalesce("lines_removed", F.array().cast("array<int>")).alias("lines_removed"))


def without_duplicate_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with duplicate lines removed, columns unchanged; documents that had non-blank
    lines and lost all of them go."""
    out = dedup_lines(docs, threshold)
    empty = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"\S")
    return out.filter(~(empty & (F.size("lines_removed") > 0))).select(*[F.col(f"`{c}`") for c in docs.columns])
