import random

from merchantry.llm import line_dedup


def grams(s):
    return {s[i:i + line_dedup.SHINGLE_CHARS] for i in range(len(s) - line_dedup.SHINGLE_CHARS + 1)} or {s}


def alike(a, b):
    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


def test_bands_are_cut_by_size_and_led_by_the_least_node(spark):
    sizes = {1: 100, 2: 80, 3: 64, 4: 51, 5: 40, 6: 10, 7: 8, 8: 200}
    bands = spark.createDataFrame([(5, node) for node in sizes] + [(6, 1), (6, 6)], "band long, node long")
    sketches = spark.createDataFrame(list(sizes.items()), "node long, n long")
    rows = line_dedup._sized_bands(bands, sketches, 0.8).collect()
    parts = {}
    for r in rows:
        parts.setdefault((r.band, r.leader), set()).add(r.node)
    # 51 is too small for 64, 40 for 51, 10 for 40, 100 for 200; of two in one part of a band every one stays
    assert sorted(map(sorted, parts.values())) == [[1, 2, 3], [6, 7]]
    assert {leader for _, leader in parts} == {1, 6}


def test_near_copies_meet_the_line_copied_most(spark, monkeypatch):
    """Lines alike to one line that has copies, but not to each other: no pairs by the square of their number."""
    rng = random.Random(4)
    base = "".join(rng.choices("abcdefghij", k=300))
    lines = []
    while len(lines) < 120:
        new = list(base)
        for i in rng.sample(range(5, 295), 5):
            new[i] = rng.choice("qrstuvwxyz")
        if alike(base, "".join(new)) >= 0.82:
            lines.append("".join(new))
    far = sum(alike(a, b) < 0.8 for a in lines for b in lines if a < b)
    assert far > 5000
    counts, write = {}, line_dedup.materialize

    def counting(df, name, codec=None):
        table = write(df, name, codec)
        counts[name] = counts.get(name, 0) + table.count()
        return table
    monkeypatch.setattr(line_dedup, "materialize", counting)
    df = spark.createDataFrame(list(enumerate(lines[:60] + [base] * 40 + lines[60:])), "doc_id long, text string")
    gone = {r.doc_id for r in line_dedup.dedup_lines(df).collect() if r.lines_removed}
    assert gone == set(range(1, 160))
    assert counts["line_cross_pairs"] <= len(lines) and counts["line_pairs"] <= len(lines)


def test_sizes_are_of_sets_so_repeats_within_a_line_part_nothing(spark):
    """A line and the same one twice over have nearly the same shingles."""
    rng = random.Random(6)
    base = "".join(rng.choices("abcdefghijklmnop", k=200))
    df = spark.createDataFrame([(1, base), (2, base * 2), (3, base * 5), (4, "😀é" + base)], "doc_id long, text string")
    assert {r.doc_id for r in line_dedup.dedup_lines(df).collect() if r.lines_removed} == {2, 3, 4}


def test_lines_of_one_vocabulary_share_few_bands(spark, monkeypatch):
    """Lines that only have common words are no candidates; near copies among them are."""
    rng = random.Random(9)
    words = ["".join(rng.choices("aeinorst", k=rng.randint(2, 6))) for _ in range(120)]
    lines = [" ".join(rng.choices(words, k=70)) for _ in range(1500)]
    met = sorted(alike(*rng.sample(lines, 2)) for _ in range(200))
    assert 0.1 < met[100] < 0.4
    copies = [lines[i][:120] + "zzzz" + lines[i][120:] for i in range(0, 1500, 50)]
    rows, write = {}, line_dedup.materialize

    def counting(df, name, codec=None):
        table = write(df, name, codec)
        rows.setdefault(name, []).append(table.count())
        return table
    monkeypatch.setattr(line_dedup, "materialize", counting)
    df = spark.createDataFrame(list(enumerate(lines + copies)), "doc_id long, text string")
    gone = {r.doc_id for r in line_dedup.dedup_lines(df).collect() if r.lines_removed}
    assert gone == set(range(1500, 1530))
    assert sum(rows["line_keys"]) < 400
    # the bands are dealt out in several tables, none of which has more than one arrangement of them
    assert len(rows["turn_bands"]) == len(line_dedup.BANDS) and max(rows["turn_bands"]) < sum(rows["turn_bands"]) / 2


def test_signatures_do_not_depend_on_how_many_shingles_a_row_has(spark, monkeypatch):
    lines = spark.createDataFrame([("",), ("abcd",), ("abcde",), ("abcdefgh",), ("é😀" * 7,), ("ab" * 90,), ("the quick brown fox",)],
                                  "text string").selectExpr("1L as doc_id", "text")
    found = []
    for rows in (2, line_dedup.SHINGLES_A_ROW, 7):
        monkeypatch.setattr(line_dedup, "SHINGLES_A_ROW", rows)
        found.append(sorted(map(tuple, line_dedup.line_classes(line_dedup.lines_of(lines)).collect())))
    assert len(found[0]) == 6 and found[0] == found[1] == found[2]
