"""Token alignment against plain Python: other encoder calls, cuts by set intersection, counts by dict."""
import collections
import hashlib
import random

import numpy as np
import pytest

import __spark_entry__ as E
from merchantry.llm import token_alignment as T

ODD = ["", None, "one", " two  spaces ", "<|endoftext|> <s> </s> <unk> <0x41>", "▁ is a space to one of them", "aaaa" * 3000,
       "漢字 テスト ünï cödé ‍\U0001f469‍\U0001f467", "\n\n\t x\r\n", "\x00 zero", "word " * 2000, "é ﬁ ①"]


def byte_table():
    """The letters that stand for bytes in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@pytest.fixture(scope="module")
def plain():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer
    hf = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    hf.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    letters = byte_table()

    def b_piece(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") and sp.is_byte(i) else p.replace("▁", " ").encode()

    def groups(text):
        if not text:
            return []
        raw = (" " + text).encode()
        a = [(i, bytes(letters[c] for c in hf.id_to_token(i))) for i in hf.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, b_piece(i)) for i in sp.encode(text)]
        if b"".join(t for _, t in a) != raw or b"".join(t for _, t in b) != raw:
            return []
        ends = [set(np.cumsum([len(t) for _, t in side]).tolist()) for side in (a, b)]
        cuts = sorted(ends[0] & ends[1])
        out = [([], []) for _ in cuts]
        for k, side in enumerate((a, b)):
            at = 0
            for i, t in side:
                out[np.searchsorted(cuts, at, side="right")][k].append(i)
                at += len(t)
        return out
    return groups


def expected(texts, groups_of):
    groups = [groups_of(t) for t in texts]
    links = [collections.Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    held = collections.Counter(p for one in links for p in one)
    most = collections.defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    rows = []
    for g, one in zip(groups, links):
        spelt = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        rows.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(one.values()),
                     hashlib.sha256(spelt.encode()).hexdigest() if g else "",
                     sum(n for p, n in one.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in one.items())))
    return rows


def as_rows(df):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum) for r in df]


def test_query_equals_plain_python(spark, sf_dir, plain):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = dict(zip([r.doc_id for r in docs], expected([r.text for r in docs], plain)))
    rows = E.queries()["op13_token_alignment"](spark, sf_dir).collect()
    assert dict(zip([r.doc_id for r in rows], as_rows(rows))) == want and len(rows) == len(docs)


@pytest.mark.parametrize("limit", [T.BROADCAST_PAIRS, 3])
def test_odd_texts(spark, plain, limit):
    texts = ODD + ["one", "aaaa" * 3000]
    df = spark.createDataFrame([(i if i else None, t, "p", 1, "r", "x") for i, t in enumerate(texts)],
                               "doc_id int, text string, pairs string, n_docs int, row string, a_id string")
    rows = sorted(T.scored(df, broadcast_pairs=limit).collect(), key=lambda r: r.doc_id or 0)
    assert rows[0].doc_id is None and as_rows(rows) == expected(texts, plain)
    assert rows[5].n_a == 0 and rows[5].groups_sha256 == "" and rows[4].n_a > 5
    assert T.scored(df.limit(0)).count() == 0


def test_groups_are_returned(spark, plain):
    df = spark.createDataFrame([(1, "ein Wort, noch eins")], "doc_id long, text string")
    row = T.align(df, with_groups=True).first()
    a, b = zip(*plain("ein Wort, noch eins"))
    assert row.groups == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in zip(a, b))
    assert len(row.pairs) == len(row.links) and sum(row.links) == row.n_links


def test_shared_cuts_on_random_ends():
    rng = random.Random(5)
    for share in (0.0, 0.02, 0.5, 1.0):
        for _ in range(40):
            ends_a, ends_b, last, base = [], [], [], 0
            for _ in range(rng.randint(1, 4)):
                n = rng.randint(1, 400)
                a, b = {n}, {n}
                for at in range(1, n):
                    both = rng.random() < share
                    side = rng.random()
                    if both or side < 0.4:
                        a.add(at)
                    if both or 0.4 <= side < 0.8:
                        b.add(at)
                ends_a += [base + x for x in sorted(a)]
                ends_b += [base + x for x in sorted(b)]
                last.append(len(ends_a) - 1)
                base += n
            cut_a, cut_b = T.shared_cuts(np.array(ends_a), np.array(ends_b), np.array(last))
            both = sorted(set(ends_a) & set(ends_b))
            assert np.array(ends_a)[cut_a].tolist() == both == np.array(ends_b)[cut_b].tolist()
