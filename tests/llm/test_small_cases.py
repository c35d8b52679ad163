"""Every dealt operator on nulls, empty and odd texts, repeated rows, clashing columns and empty tables."""
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from merchantry.llm import (chat, decontaminate, katz, langid, licenses, line_dedup, ngram_join, packing, pivot_search,
                            token_counts)

LONG = "alpha beta gamma delta " * 3000
TEXTS = [(1, None), (2, ""), (3, "   \n\n"), (4, "one"), (5, "One"), (6, "a b c d e f g h i j k l m"), (6, "a b c d e f g h i j k l m"),
         (7, LONG), (8, LONG + "omega"), (None, "a b c d e f g h i j k l m"), (9, "1234 !!"), (10, "ünï cödé 漢字 テスト x")]
SCHEMA = "doc_id long, text string, lang string, n_words long, grams string, lines_removed string, edits string, node string, a string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en" if t else None, 0, "g", "r", "e", "n", "a") for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def bench(spark, rows=((1, "b c d e f g h i j k"), (2, None), (3, ""), (None, "beta gamma"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def test_find_leaks(spark, docs, none):
    rows = {r.doc_id: r for r in decontaminate.find_leaks(docs, bench(spark)).collect()}
    assert rows[6].bench_items == ["1"] and rows[6].bench_spans[0].asDict() == {"start": 1, "length": 10}
    assert rows[7].bench_items == ["null"] and sum(s.length for s in rows[7].bench_spans) == 6000
    assert rows[1].bench_words == 0 and rows[9].bench_words == 1 and rows[6].n_words == 0
    assert decontaminate.find_leaks(none, bench(spark)).count() == 0
    assert {r.bench_items == [] for r in decontaminate.find_leaks(docs, bench(spark, ())).collect()} == {True}
    kept = decontaminate.drop_leaked(docs, bench(spark))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 5, 9, 10]


def test_pack(spark, docs, none):
    rows = packing.pack(docs).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert all(len(by_doc[i]) == 1 and by_doc[i][0].doc_tokens == 1 for i in (1, 2))
    assert by_doc[1][0].ids == b"\x01\0\0\0"
    assert sum(len(r.ids) // 4 for r in by_doc[7]) == by_doc[7][0].doc_tokens
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, len(r.ids) // 4))
    for pieces in by_seq.values():
        at = 0
        for off, n in sorted(pieces):
            assert off == at
            at += n
        assert at <= 2048
    assert packing.pack(none).count() == 0


def test_language(spark, docs, none):
    train = spark.createDataFrame([(1, "the and of with the", "en"), (2, "der und die mit den", "de"), (3, "x", None)],
                                  "doc_id long, text string, lang string")
    model = langid.fit(train)
    assert sorted(model) == ["de", "en"]
    rows = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].lang_score == 0 and rows[i].lang_rejected for i in (1, 2, 3, 9))
    assert rows[7].lang_pred in ("de", "en") and 0 <= rows[7].lang_score <= 1
    assert langid.identify(none, model).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(none)).collect()} == {"und"}
    assert langid.keep_identified(docs, train).columns == docs.columns


def test_common_shingles_are_counted_apart(spark, none):
    # shingle 7 in every third set, 100,000 others once or twice
    rows = spark.range(60_000).select(F.col("id").alias("row"), F.explode(F.array(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") + 1_000_000), F.col("id") % 40_000 + 100)).alias("gram"))
    got = ngram_join._with_frequency(rows)
    assert "approx_top_k" not in got._jdf.queryExecution().toString() and "Union" in got._jdf.queryExecution().toString()
    plain = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).join(rows, "gram").select("row", "gram", "df")
    assert got.count() == 120_000 and got.exceptAll(plain).isEmpty()
    assert ngram_join._with_frequency(rows.filter("row < 0")).isEmpty()


def test_lines(spark, docs, none):
    rows = {r.doc_id: r for r in line_dedup.dedup_lines(docs).filter("doc_id is not null").collect()}
    assert rows[1].text is None and rows[3].text == "   \n\n" and rows[4].text == "one"
    assert rows[5].text == "" and list(rows[5].lines_removed) == [0]
    assert rows[8].text == "" and rows[6].text.startswith("a b")
    kept = line_dedup.without_duplicate_lines(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "10", "2", "3", "4", "6", "6", "7", "9", "None"]
    assert line_dedup.dedup_lines(none).count() == 0


def test_lines_of_any_length(spark):
    """Short lines, rules and repeated characters against all pairs."""
    rng = random.Random(8)
    lines = [c * n for c in "-=*ab" for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 40, 200)] + ["ab" * n for n in range(1, 12)]
    lines += ["".join(rng.choices("abcdefgh", k=n)) for n in range(1, 30) for _ in range(3)]
    lines += [x + "q" for x in lines[-80:]] + ["x" + x for x in lines[-80:]]
    lines = list(dict.fromkeys(lines))
    grams = lambda t: {t[i:i + 5] for i in range(len(t) - 4)} or {t}
    sets = [grams(x) for x in lines]
    root = list(range(len(lines)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(lines)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = {i for i in range(len(lines)) if find(i) != i}
    df = spark.createDataFrame([(i, x, "c") for i, x in enumerate(lines)], "doc_id long, text string, __text_lines string")
    rows = line_dedup.dedup_lines(df).collect()
    assert {r.doc_id for r in rows if r.lines_removed} == want and len(want) > 60
    assert {r["__text_lines"] for r in rows} == {"c"}


def test_lines_without_spaces(spark):
    rest = ";berlin;warehouse-north;pallets-of-printer-paper;delivered-in-full;signed-by-night-shift"
    thai = "การจัดส่งสินค้าไปยังคลังสินค้าทางเหนือของเมืองในตอนกลางคืน"
    texts = ["1001" + rest, "1002" + rest, "7" + rest.replace(";", "\t").replace("-", "\t"), "8" + rest.replace(";", "\t").replace("-", "\t"),
             thai, "กก" + thai[1:], "https://a.example/" + "x/y1/z2/" * 3 + "page", "not_alike_at_all=1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in line_dedup.dedup_lines(df).collect() if r.lines_removed} == {1, 3, 5}


def test_line_recall(spark):
    """Pairs of different lines just above the threshold, every pair in letters of its own draw."""
    rng = random.Random(5)
    grams = lambda s: {s[i:i + line_dedup.SHINGLE_CHARS] for i in range(len(s) - line_dedup.SHINGLE_CHARS + 1)}
    rows = []
    while len(rows) < 800:
        a = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(rng.randint(20, 40)))
        b = list(a)
        while True:
            i = rng.randrange(len(b))
            b[i] = "#"
            x, y = grams(a), grams("".join(b))
            if len(x & y) < 0.83 * len(x | y):
                break
        if len(x & y) >= 0.8 * len(x | y):
            rows += [(len(rows), a), (len(rows) + 1, "".join(b))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = [r.doc_id for r in line_dedup.dedup_lines(df).collect() if r.lines_removed]
    assert all(i % 2 for i in gone) and len(gone) >= 0.99 * 400


def test_join(spark, docs, none):
    rows = ngram_join.link_components(docs).collect()
    assert len(rows) == len(TEXTS)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].n_shingles == by_id[2].n_shingles == by_id[3].n_shingles == 0
    assert by_id[2].component_id == 2 and by_id[3].component_id == 3
    assert by_id[4].n_shingles == 1 and by_id[5].component_id == 4 and by_id[8].component_id == 7 or by_id[8].component_id == 8
    assert by_id[None].component_id == 6 or by_id[None].component_id is None
    assert ngram_join.link_components(none).count() == 0
    kept = ngram_join.one_per_group(docs)
    assert kept.columns == docs.columns and 5 not in [r.doc_id for r in kept.collect()]


def test_join_repeated_ids(spark):
    """Rows of one id in different tasks: the same text twice, and two texts, each with a partner that just links."""
    rng = random.Random(7)
    text = lambda: [f"w{rng.randrange(10 ** 9)}" for _ in range(23)]
    first, again, partners = [], [], []
    for i in range(0, 1200, 3):
        a, b = text(), text()
        first.append((i, " ".join(a)))
        again.append((i, " ".join(a if i % 2 else b)))
        partners.append((i + 1, " ".join(a[3:])))
        if not i % 2:
            partners.append((i + 2, " ".join(b[:-3])))
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = ngram_join.link_components(make(first).unionByName(make(again)).unionByName(make(partners))).collect()
    assert len(got) == 800 + len(partners)
    assert not [r.doc_id for r in got if r.component_id != r.doc_id // 3 * 3]


def test_language_model(spark, docs, none):
    scores, model = katz.fit_and_score(docs, F.col("doc_id") == 4)
    rows = {r.doc_id: r for r in scores.collect()}
    assert len(scores.collect()) == len(TEXTS)
    assert rows[1].n_tokens == rows[2].n_tokens == 1 and rows[4].held_out and not rows[5].held_out
    assert rows[7].score > rows[7].base_score and all(r.score <= 0 for r in rows.values())
    scores, _ = katz.fit_and_score(docs, F.lit(True))
    assert {(r.train_tokens, r.n_known) for r in scores.collect()} == {(0, 0)}
    assert katz.fit_and_score(none, F.lit(False))[0].count() == 0


def test_bigrams_seen_once(spark):
    df = spark.createDataFrame([(1, "a b"), (4, "a b")], "doc_id long, text string")
    scores, model = katz.fit_and_score(df, F.col("doc_id") == 4)
    d1 = katz.discounts([0, 3] + [0] * katz.GT_MAX)[1]
    assert sum(katz.read_model(r)[2].sum() for r in model.collect()) == 3
    assert {r.doc_id: r.score for r in scores.collect()} == pytest.approx({i: 3 * math.log10(d1) for i in (1, 4)})


def test_search(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]),
            (5, [float("inf"), 0.0]), (None, [1.0, 1.0]), (50, [-1.0, 0.25]), (100, [1.0]), (7, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in pivot_search.top_k(df, F.col("vec_id") % 50 == 0).collect()]
    assert sorted(got) == [(0, 1, 1, 32768), (0, 2, 1, 32768), (0, 3, 50, -65536),
                           (50, 1, 1, -24576), (50, 2, 1, -24576), (50, 3, 0, -65536)]
    assert pivot_search.top_k(df.filter("false"), F.lit(True)).count() == 0


def test_search_repeated_queries(spark):
    rows = [(0, [1.0, 0.0])] * 2 + [(50, [0.0, 1.0]), (50, [1.0, 1.0])] + [(i, [float(i), -float(i)]) for i in range(1, 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in pivot_search.top_k(df, F.col("vec_id") % 50 == 0).collect()]
    unit = 256 * 256
    want = [(0, n + 1, 5 - n, (5 - n) * unit) for n in range(5)]
    want += [(50, n + 1, v, s * unit) for n, (v, s) in enumerate([(0, 0), (0, 0), (1, -1), (2, -2), (3, -3)])]
    want += [(50, n + 1, v, s * unit) for n, (v, s) in enumerate([(0, 1), (0, 1), (1, 0), (2, 0), (3, 0)])]
    assert sorted(got) == sorted(want)


def test_licenses(spark, docs, none):
    text = next(t for i, t in licenses.KNOWN if i == "MIT")
    other = "Copyright (c) 2020 Someone\n\n" + text.upper().replace("SUBLICENSE", "sub-licence").replace(",", " ,")
    df = spark.createDataFrame([(1, text), (2, other), (3, text + " extra"), (4, None), (5, "!!"), (1, text)], "doc_id long, text string")
    known = licenses.known_digests(spark)
    rows = sorted((r.doc_id, r.license_id) for r in licenses.scan(df, known).collect())
    assert rows == [(1, "MIT"), (1, "MIT"), (2, "MIT"), (3, None), (4, None), (5, None)]
    assert licenses.scan(none, known).count() == 0
    assert licenses.scan(df, known.filter("false")).filter("license_id is not null").count() == 0
    assert known.count() == len(licenses.KNOWN)


def test_wrapped_and_titled_licence_files(spark):
    import textwrap
    known = licenses.known_digests(spark)
    rows, plain = [], {i: t for i, t in reversed(licenses.KNOWN) if i in licenses.TITLES}
    assert len(plain) == len(licenses.TITLES)
    for name, text in plain.items():
        for width in (50, 60, 70, 72, 76, 80):
            wrapped = "\n\n".join(textwrap.fill(part, width) for part in text.split("\n\n"))
            for title in ["", *licenses.TITLES[name]]:
                notice = "Copyright (c) 2020-2024 Someone <a@b.example>\nCopyright 1999 by Another\n  (C) 2001 A Third\nAll rights reserved.\n\n"
                rows += [(name, f"{title}\n\n{wrapped}\n"), (name, f"{title}\n\n{notice}{wrapped}"), (None, f"{title}\n{notice}{wrapped} more")]
    df = spark.createDataFrame([(k, n, t) for k, (n, t) in enumerate(rows)], "k int, name string, text string")
    got = licenses.scan(df, known).filter(~F.col("name").eqNullSafe(F.col("license_id"))).collect()
    assert got == []


def test_chat(spark):
    records = [
        (1, '{"messages": [{"role": "user", "content": "a <s> \\\\ b"}, {"role": "assistant", "content": null}], "meta": 1}', "messages"),
        (2, '{"conversations": [{"from": "human", "value": "x"}, {"from": "gpt", "value": "[INST]"}]}', "conversations"),
        (3, '{"instruction": "do", "input": "this", "output": "done"}', "instruction"),
        (4, '{"prompt": "p", "response": "r"}', "prompt_response"),
        (5, '{"prompt": "p", "messages": [{"role": "user", "content": "m"}]}', None),
        (6, "not json", None), (7, None, None), (8, "{}", None)]
    df = spark.createDataFrame([(i, r) for i, r, _ in records], "id long, raw string").select(
        "id", F.try_parse_json("raw").alias("record"))
    got = {r.id: r for r in chat.canonical(df).collect()}
    assert {i: got[i].layout for i in got} == {i: lay for i, _, lay in records}
    turns = {i: [(t.role, t.text) for t in got[i].turns] for i in got}
    assert turns[1] == [("user", "a <s> \\ b"), ("assistant", "")]
    assert turns[2] == [("user", "x"), ("assistant", "[INST]")]
    assert turns[3] == [("user", "do\n\nthis"), ("assistant", "done")]
    assert turns[5] == turns[6] == turns[7] == turns[8] == []
    for s in chat.segments(chat.canonical(df), ["id"]).collect():
        assert chat.read_back(s.segment) == [(s.role, s.text)]
        assert s.loss_chars == (len(s.segment[s.loss_start:s.loss_start + s.loss_chars]) if s.role == "assistant" else 0)
        inner = s.segment[len(chat.BEGIN):-len(chat.END)].replace(chat.MIDDLE, "", 1)
        assert not any(c in inner for c in chat.CONTROLS)


@pytest.mark.parametrize("text", ["", "\\", "\\\\<s>\\", "<s</s>s>", "<|turn|><|over|>", "a\n\r\n<|says|>b", "[INST][/INST]\\n", "漢<s>字"])
def test_escape_round_trip(spark, text):
    df = spark.createDataFrame([(text,)], "t string").select(chat.escape(F.col("t")).alias("e"))
    e = df.first().e
    assert chat.unescape(e) == text and not any(c in e for c in chat.CONTROLS)


def test_chat_digests(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a</s>"), (1, 2, None, None), (2, 0, "assistant", "z"), (2, 0, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    turns = chat.segments(chat.canonical(df.select("conv_id", "turn", F.to_variant_object(F.struct("role", "text")).alias("record"))),
                          ["conv_id", "turn"])
    got = {r.conv_id: r for r in chat.digests(turns, "conv_id", ["turn", "role", "text"]).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 3 and got[1].turns_sha256 == sha("user\nhi\nassistant\na</s>\n\n\n")
    assert got[1].loss_chars == 5 and got[1].loss_sha256 == sha("a</s>") and got[2].loss_sha256 == sha("zz")
    assert chat.digests(turns.filter("false"), "conv_id", ["turn"]).count() == 0


def test_token_counts(spark, docs, none):
    edited = token_counts.recount(token_counts.with_pattern_edits(docs, "[0-9]+|beta ", "it's"))
    counter = token_counts.piece_counter("byte_bpe_50k.tiktoken")
    whole = lambda t: sum(counter.count(p) for p in counter.pattern.findall(t or ""))
    for r in edited.collect():
        assert r.tokens_after == whole(r.text)
        if r.text is not None and r.doc_id not in (7, 8, 9):
            assert r.tokens_before == r.tokens_after and not r.edits
    row = next(r for r in edited.collect() if r.doc_id == 7)
    assert row.text == re.sub("beta ", "it's", LONG) and row.tokens_before == whole(LONG)
    assert token_counts.recount(token_counts.with_pattern_edits(none, "x", "y")).count() == 0


def test_overlapping_edits(spark):
    """The edit that starts first is made; touching edits and insertions at one place are all made."""
    rows = [(1, "hello world again", [(3, 8, "Y"), (0, 5, "X")]), (2, "abcdef", [(2, 4, "-"), (0, 2, "+"), (4, 4, "1"), (4, 4, "2")]),
            (3, "abc", [(-5, 1, "x"), (2, 99, "z"), (50, 60, "!")]), (4, "abcdef", [(0, 6, ""), (1, 2, "q")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:bigint,end:bigint,text:string>>")
    got = {r.doc_id: r for r in token_counts.recount(df).collect()}
    assert [got[i].text for i in (1, 2, 3, 4)] == ["X world again", "+-12ef", "xbz!", ""]
    again = token_counts.recount(df.select("doc_id", F.lit(None).alias("edits").cast(df.schema["edits"].dataType),
                                           F.create_map(*[F.lit(x) for i in got for x in (i, got[i].text)])[F.col("doc_id")].alias("text")))
    assert all(r.tokens_before == got[r.doc_id].tokens_after for r in again.collect())


def test_search_overflow(spark):
    df = spark.createDataFrame([(0, [1e16, 1e16]), (1, [1e16, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        pivot_search.top_k(df, F.col("vec_id") % 50 == 0).collect()


def test_long_lines_are_ruled_out_by_sketches_and_links_never(spark):
    import random
    rng = random.Random(5)
    syllables = ["".join(rng.choice("aeinorst") for _ in range(3)) for _ in range(40)]
    text = lambda n: "".join(rng.choice(syllables) for _ in range(n // 3))
    grams = lambda s: {s[i:i + line_dedup.SHINGLE_CHARS] for i in range(len(s) - line_dedup.SHINGLE_CHARS + 1)}
    lines = []
    for n in (400, 700, 760, 1300, 1440, 1500, 2900, 6000):
        base = text(n)
        lines += [base, base[:int(n * 0.93)], base[: n // 2] + text(n // 12) + base[n // 2 + n // 12:], text(n), "ab" * n]
    texts = spark.createDataFrame(list(enumerate(lines)), "node long, line string")
    pairs = spark.createDataFrame([(a, b) for a in range(len(lines)) for b in range(a)], "a long, b long")
    left = {(r.a, r.b) for r in line_dedup._possible(pairs, line_dedup._sketches(texts), 0.8).collect()}
    sets = [grams(s) for s in lines]
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    every = [(a, b) for a in range(len(lines)) for b in range(a)]
    links = {p for p in every if alike(*p) >= 0.8}
    assert len(links) > 15 and links <= left
    far = {p for p in every if alike(*p) < 0.6}
    assert not far & left


def test_a_round_compares_each_line_with_two_leaders(spark):
    rows = [(band, node, 0 if node < 30 else node, 0) for band in range(3) for node in range(60)]
    split = spark.createDataFrame(rows, "band long, node long, component long, main long")
    seen = set()
    for turn in range(line_dedup.ROUNDS):
        pairs = [(r.a, r.b) for r in line_dedup._to_leaders(split, turn).collect()]
        assert 30 <= len(pairs) <= 60 and all(a > b and a >= 30 for a, b in pairs)
        seen |= set(pairs)
    assert len(seen) > 60
