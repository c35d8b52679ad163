"""The pipeline's stages, each against plain Python on its own input; odd and empty tables end to end."""
import collections
import itertools
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline as P
from merchantry.session import materialize

LOWER = {i: i + 32 for i in range(65, 91)}


def low(text):
    return (text or "").translate(LOWER)


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """The rows before the first stage and after each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs.collect()]
    for name, fn in P.STAGES:
        docs = materialize(fn(spark, docs, sf_dir), name)
        out.append(docs.collect())
    return out


def test_columns_and_decisions(stages):
    for before, after in itertools.pairwise(stages[:5]):
        assert after[0].__fields__ == before[0].__fields__
        assert {r.doc_id for r in after} <= {r.doc_id for r in before}
    first, known, lines, single, clean, _ = stages
    texts = {r.doc_id: r.text for r in first}
    assert all(r.text == texts[r.doc_id] for r in known) and len(known) >= 0.95 * sum(
        bool(re.search(r"[^\W\d_]", t or "")) for t in texts.values())
    # lines are only taken out, and their order stays
    for r in lines:
        rest = iter((texts[r.doc_id] or "").split("\n"))
        assert r.text is None or all(line in rest for line in r.text.split("\n"))


def test_near_duplicates(stages):
    before, after = stages[2], stages[3]
    sets = {}
    for r in before:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(r.text))
        sets[r.doc_id] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    by_gram = collections.defaultdict(list)
    for d, s in sets.items():
        for g in s:
            by_gram[g].append(d)
    root = {d: d for d in sets}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for a, b in {p for ds in by_gram.values() for p in itertools.combinations(sorted(ds), 2)}:
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert {r.doc_id for r in after} == {d for d in sets if find(d) == d}


def test_decontamination(spark, sf_dir, stages):
    before, after = stages[3], stages[4]
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = re.findall(word, low(r.text))
        windows |= {tuple(w[i:i + 10]) for i in range(len(w) - 9)} if len(w) >= 10 else ({tuple(w)} if w else set())
    sizes = {len(w) for w in windows}
    leaked = set()
    for r in before:
        w = re.findall(word, low(r.text))
        if any(tuple(w[i:i + n]) in windows for n in sizes for i in range(len(w) - n + 1)):
            leaked.add(r.doc_id)
    assert leaked and {r.doc_id for r in after} == {r.doc_id for r in before} - leaked


def packed_whole(docs, pieces, encode):
    by_doc, by_seq = collections.defaultdict(dict), collections.defaultdict(dict)
    for p in pieces:
        ids = [int.from_bytes(p.ids[i:i + 4], "little") for i in range(0, len(p.ids), 4)]
        by_doc[p.doc_id][p.start] = ids
        by_seq[p.sequence_id][p.offset] = len(ids)
    for doc_id, text in docs:
        assert [i for _, ids in sorted(by_doc[doc_id].items()) for i in ids] == encode(text or "") + [1]
    for seq in by_seq.values():
        assert [off for off, _ in sorted(seq.items())] == list(itertools.accumulate(
            [0, *[n for _, n in sorted(seq.items())][:-1]])) and sum(seq.values()) <= 2048


@pytest.fixture(scope="module")
def encode():
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    return lambda text: tok.encode(text, add_special_tokens=False).ids


def test_packing(stages, encode):
    packed_whole([(r.doc_id, r.text) for r in stages[4]], stages[5], encode)


WORDS = "the old bridge over the river was closed after heavy rain and nobody knew when the town would open it again"
OTHER = "several students asked whether the library could stay open later during the weeks before their final examinations"

LONG = " ".join(f"the {a} saw that {b} and the {c} were {d}" for a, b, c, d in itertools.permutations(
    "house garden river mountain window teacher children winter village".split(), 4))
GERMAN = "der alte mann ging langsam durch die kleine stadt und kaufte auf dem markt frisches brot und etwas obst"


def odd_folder(path, sf_dir, rows):
    schema = pq.read_schema(f"{sf_dir}/documents.parquet")
    plain = pa.schema([("doc_id", schema.field("doc_id").type), ("text", pa.string()), ("lang", pa.string()),
                       ("source", pa.string()), ("n_chars", pa.int64()), ("grams", pa.string()), ("component", pa.int64()),
                       ("line", pa.string()), ("lang_pred", pa.string()), ("bench_words", pa.int64())])
    made = [dict(zip(plain.names, (i, t, lang, "s", len(t or ""), "g", 5, "l", "p", 7))) for i, t, lang in rows]
    pq.write_table(pa.Table.from_pylist(made, plain), f"{path}/documents.parquet")
    pq.write_table(pq.read_table(f"{sf_dir}/benchmark.parquet"), f"{path}/benchmark.parquet")
    return str(path)


def test_odd_table(spark, sf_dir, tmp_path, encode):
    leak = pq.read_table(f"{sf_dir}/benchmark.parquet")["text"][0].as_py()
    rows = [(1, None, None), (2, "", "en"), (3, "1234 !!", None), (4, WORDS, "en"), (5, WORDS, "en"), (5, WORDS, "en"),
            (6, OTHER, "en"), (7, LONG, "en"), (8, f"{OTHER[:40]} zebra {leak} quietly", "en"), (9, GERMAN, "de"),
            (None, WORDS + " yesterday evening they came home", "en")]
    folder = odd_folder(tmp_path, sf_dir, rows)
    pieces = P.run(spark, folder).collect()
    kept = {p.doc_id for p in pieces}
    assert not kept & {1, 2, 3, 8} and {4, 6, 7, 9} <= kept and 5 not in kept
    packed_whole([(4, WORDS), (6, OTHER), (7, LONG), (9, GERMAN)], pieces, encode)


def test_empty_table(spark, sf_dir, tmp_path):
    assert P.run(spark, odd_folder(tmp_path, sf_dir, [])).isEmpty()
