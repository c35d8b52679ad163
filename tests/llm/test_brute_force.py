"""The registered queries against plain Python over the same tables (sf0.001)."""
import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as E
from merchantry.llm import katz, langid, line_dedup, token_counts

LOWER = {i: i + 32 for i in range(65, 91)}


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def query(spark, sf_dir, prefix):
    name, = [n for n in E.queries() if n.startswith(prefix)]
    return E.queries()[name](spark, sf_dir).collect()


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (text or "").translate(LOWER))


def test_op1(spark, sf_dir):
    rows = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    rows += [{"conv_id": -1, "turn": i, "role": r, "text": "</s>[INST] ok [/INST]"} for i, r in enumerate(("user", "assistant"))]
    convs = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["turn"])):
        convs[r["conv_id"]].append((r["role"], r["text"] or ""))
    got = {r.conv_id: r for r in query(spark, sf_dir, "op1_")}
    assert len(got) == len(convs)
    for k, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[k].n_turns, got[k].turns_sha256, got[k].loss_chars, got[k].loss_sha256) == (
            len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))


def test_op2(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    x = np.array([[math.floor(256 * float(np.float32(c))) for c in r.embedding] for r in rows], dtype=np.int64)
    ids = np.array([r.vec_id for r in rows])
    want = set()
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if j != i][:5]
        want |= {(int(ids[i]), n + 1, int(ids[j]), int(s[j])) for n, j in enumerate(order)}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in query(spark, sf_dir, "op2_")} == want


def test_op4(spark, sf_dir, texts):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: [*t.encode(x or "", add_special_tokens=False).ids, 1] for d, x, _ in texts}
    pieces, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in query(spark, sf_dir, "op4_"):
        part = np.array(ids[r.doc_id][r.start:r.start + r.length], dtype="<u4")
        assert zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        seqs[r.sequence_id].append((r.offset, r.length))
    assert len(pieces) == len(ids)
    for spans, n in [(v, len(ids[k])) for k, v in pieces.items()] + [(v, None) for v in seqs.values()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at and length > 0
            at += length
        assert at == n if n else at <= 2048
    sizes = [sum(n for _, n in v) for v in seqs.values()]
    padding = sum(2048 - n for n in sizes if n & (n - 1))
    assert padding <= 0.01 * sum(sizes)


def test_op5(spark, sf_dir, texts):
    train = [words(x) + [None] for d, x, _ in texts if zlib.crc32(str(d).encode()) % 10]
    uni = collections.Counter(w for t in train for w in t)
    bi = collections.Counter(p for t in train for p in zip(["<s>", *t], t))
    total = sum(uni.values())
    counts = lambda c: [sum(1 for v in c.values() if v == r) for r in range(katz.GT_MAX + 2)]
    d1, d2 = katz.discounts(counts(uni)), katz.discounts(counts(bi))
    disc = lambda d, c: (d[c] if c <= katz.GT_MAX else 1.0) * c
    unknown = 1 - sum(disc(d1, c) for c in uni.values()) / total
    p1 = lambda w: disc(d1, uni[w]) / total if w in uni else unknown
    after = collections.defaultdict(dict)
    for (v, w), c in bi.items():
        if c >= katz.MIN_BIGRAM:
            after[v][w] = c
    of_v = {**uni, "<s>": len(train)}
    alpha, below = {}, {}
    for v, ws in after.items():
        mass = sum(disc(d2, c) for c in ws.values())
        below[v] = of_v[v] if mass < of_v[v] - 1e-9 else of_v[v] + 1
        alpha[v] = (1 - mass / below[v]) / (1 - sum(p1(w) for w in ws))
    for v in list(after)[:20]:
        whole = sum(disc(d2, after[v][w]) / below[v] if w in after[v] else alpha[v] * p1(w) for w in uni) + alpha[v] * unknown
        assert whole == pytest.approx(1)
    held = [0.0, 0.0]
    got = query(spark, sf_dir, "op5_")
    assert len(got) == len(texts)
    by_id = {r.doc_id: r for r in got}
    for d, x, _ in texts:
        t = words(x) + [None]
        s = sum(math.log10(disc(d2, after[v][w]) / below[v] if w in after.get(v, {}) else alpha.get(v, 1.0) * p1(w))
                for v, w in zip(["<s>", *t], t))
        base = sum(math.log10((uni.get(w, 0) + 0.1) / (total + 0.1 * (len(uni) + 1))) for w in t)
        r = by_id[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(w in uni for w in t), total)
        assert r.score == pytest.approx(s, rel=1e-9) and r.base_score == pytest.approx(base, rel=1e-9)
        if r.held_out:
            held = [held[0] + r.score, held[1] + r.base_score]
    assert held[0] > held[1]


def test_op6(spark, sf_dir, texts):
    lines = collections.OrderedDict()
    for d, x, _ in sorted(texts):
        for i, line in enumerate((x or "").split("\n")):
            line = line.strip().lower()
            if line:
                lines.setdefault(line, (d, i))
    grams = lambda s, q=line_dedup.SHINGLE_CHARS: {s[i:i + q] for i in range(len(s) - q + 1)} or {s}
    sets = {n: grams(s) for s, n in lines.items()}
    root = {n: n for n in sets}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    links = []
    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
            links.append((a, b))
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = set()
    for d, x, _ in texts:
        for i, line in enumerate((x or "").split("\n")):
            line = line.strip().lower()
            if line and find(lines[line]) != (d, i):
                want.add((d, i))
    got = {(r.doc_id, i) for r in query(spark, sf_dir, "op6_") for i in r.lines_removed}
    assert not got - want                        # verified exactly, so nothing else goes
    assert len(got) >= 0.98 * len(want)


def test_op7(spark, sf_dir, texts):
    sets = {}
    for d, x, _ in texts:
        w = words(x)
        sets[d] = {tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
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
        if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in query(spark, sf_dir, "op7_")} == {
        (d, len(s), find(d)) for d, s in sets.items()}


def test_op8(spark, sf_dir, texts):
    got = {r.doc_id: r for r in query(spark, sf_dir, "op8_")}
    held = [(got[d].lang_pred, lang) for d, x, lang in texts if got[d].held_out and len(x or "") >= 100]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= got[d].score <= 1 for d, _, _ in texts)


def test_op8_sizes():
    model = langid.Classifier({"a": b"abc " * 100, "b": b"xyz " * 100})
    assert model.predict("abc abc abc abc")[0] == "a" and model.predict("xyz xyz xyz xyz")[0] == "b"


def test_op9(spark, sf_dir, texts):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = collections.defaultdict(set)
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = words(r.text, pattern)
        m = min(10, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[i:i + m])].add(str(r.item_id))
    got = {r.doc_id: r for r in query(spark, sf_dir, "op9_")}
    assert len(got) == len(texts)
    for d, x, _ in texts:
        w = words(x, pattern)
        hit, items = set(), set()
        for m in {len(k) for k in windows}:
            for i in range(len(w) - m + 1):
                if (k := tuple(w[i:i + m])) in windows:
                    hit |= set(range(i, i + m))
                    items |= windows[k]
        sha = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        r = got[d]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(items), sha, bool(hit))


def test_op10(spark, sf_dir, texts):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    from merchantry.llm.queries import MASKED
    got = {r.doc_id: r for r in query(spark, sf_dir, "op10_")}
    for d, x, _ in texts:
        new = re.sub(MASKED, "[x]", x or "")
        r = got[d]
        assert (r.tokens_before, r.tokens_after) == tuple(len(t.encode(s, add_special_tokens=False).ids) for s in (x or "", new))
        assert r.text_md5 == hashlib.md5(new.encode()).hexdigest()


@pytest.mark.parametrize("seed", range(40))
def test_segment_tree(seed):
    rng = random.Random(seed)
    counter = token_counts.piece_counter("byte_bpe_50k.tiktoken")
    draw = lambda n: "".join(rng.choice(["a", "b ", " ", "  ", "\n", "'s", "'ll", "1", "23", "!", "é", "漢", "the ", "'"]) for _ in range(n))
    text = draw(rng.choice([0, 3, 50, 1500]))
    tree = token_counts.SegmentTree(text, counter)
    for _ in range(60):
        a = rng.randint(0, len(text))
        b = min(len(text), a + rng.choice([0, 0, 1, 2, 5, 300]))
        new = draw(rng.choice([0, 1, 2, 8, 200]))
        text = text[:a] + new + text[b:]
        tree.replace(a, b, new)
        want = counter.pattern.findall(text)
        assert [p for leaf in tree.leaves for p in leaf.pieces] == want
        assert tree.tokens[1] == sum(map(counter.count, want)) and tree.chars[1] == len(text)
