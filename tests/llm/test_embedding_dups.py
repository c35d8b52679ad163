"""Near-duplicate embeddings against all pairs, and the graph's recall."""
import numpy as np
import pytest

import __spark_entry__ as E
from merchantry.llm import embedding_dups as D
from merchantry.llm import hnsw


def all_pairs(rows, threshold=0.9):
    """{position: (links, component)} of (id, vector or None) rows."""
    usable = [k for k, (i, v) in enumerate(rows) if i is not None and v and None not in v
              and np.isfinite(v).all() and np.any(v)]
    x = np.array([rows[k][1] for k in usable], dtype=float).reshape(len(usable), -1)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= threshold
    out = {k: (0, rows[k][0]) for k in range(len(rows))}
    label = list(range(len(usable)))
    changed = True
    while changed:
        new = [min(label[b] for b in np.flatnonzero(close[a])) for a in range(len(usable))]
        changed, label = new != label, new
    least = {}
    for a, k in enumerate(usable):
        least[label[a]] = min(least.get(label[a], rows[k][0]), rows[k][0])
    for a, k in enumerate(usable):
        out[k] = (int(close[a].sum()) - 1, least[label[a]])
    return out


def planted(n=1500, dim=32, groups=40, seed=4):
    """Random vectors, groups of near copies of every size up to 40, equal ones among them."""
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=dim) for _ in range(n)]
    for g in range(1, groups + 1):
        centre = rng.normal(size=dim)
        rows += [centre + rng.normal(size=dim) * 0.15 for _ in range(g)] + [centre] * (g % 3)
    order = rng.permutation(len(rows))
    return [(int(k) * 3 + 1, rows[k].astype(np.float32).tolist()) for k in order]


def test_query_equals_all_pairs(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = {rows[k][0]: v for k, v in all_pairs(rows).items()}
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.queries()["op11_hnsw_near_dups"](spark, sf_dir).collect()}
    assert got == want


def test_planted_groups(spark):
    rows = planted()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = {r.vec_id: r for r in D.near_duplicates(df, per_shard=64).collect()}      # five shards, fifteen cells
    want = {rows[k][0]: v for k, v in all_pairs(rows).items()}
    assert got.keys() == want.keys()
    true, ours = sum(n for n, _ in want.values()), sum(r.n_links for r in got.values())
    assert 0.99 * true <= ours <= true and all(got[i].n_links <= n for i, (n, _) in want.items())
    same = sum(got[i].component_id == c for i, (_, c) in want.items())
    assert same >= 0.99 * len(want) and all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_odd_rows(spark):
    v = [0.5, 0.25, -1.0]
    rows = [(1, None), (2, []), (3, [0.0, -0.0, 0.0]), (4, [float("nan"), 1.0, 0.0]), (5, [float("inf"), 1.0, 0.0]), (6, [1.0, None, 0.0]),
            (10, v), (11, v), (11, v), (12, [2 * c for c in v]), (13, [1e200, 5e199, -2e200]), (None, v), (14, [-0.0, 1.0, 0.0]),
            (15, [0.0, 1.0, 0.0]), (16, [1.0, 0.0]), (17, [0.0, 0.0, 1.0])]
    df = spark.createDataFrame([(i, e, "c", 1, 2) for i, e in rows], "vec_id int, embedding array<double>, vec string, node int, dim int")
    got = D.near_duplicates(df).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["vec_id", "n_links", "component_id", "kept"]
    seen = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str)
    assert [r for r in seen if r[0] in (1, 2, 3, 4, 5, 6, 16, 17)] == [(i, 0, i, True) for i in (1, 16, 17, 2, 3, 4, 5, 6)]
    assert [r for r in seen if r[0] in (10, 11, 12, 13)] == [(10, 4, 10, True), (11, 4, 10, False), (11, 4, 10, False),
                                                           (12, 4, 10, False), (13, 4, 10, False)]
    assert (None, 0, None, True) in seen and (14, 1, 14, True) in seen and (15, 1, 14, False) in seen
    assert D.near_duplicates(df.limit(0)).count() == 0 and D.near_duplicates(df.filter("vec_id < 5")).count() == 4


@pytest.mark.parametrize("n", [1, 2, 17, 300, 3000])
def test_graph_recall(n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw.Graph.build(x)
    assert [len(level) for level in graph.links] == hnsw.level_sizes(n)
    q = x[: min(n, 200)] + 0.05 * rng.normal(size=(min(n, 200), 24)).astype(np.float32)
    nodes, sims = graph.search(q, 64)
    assert (nodes[:, 0] == (q @ x.T).argmax(axis=1)).mean() >= 0.98
    want = np.sort(q @ x.T, axis=1)[:, ::-1][:, :10]
    assert (sims[:, :want.shape[1]] >= want - 1e-5).mean() >= 0.95
    for row in nodes:
        row = row[row >= 0]
        assert len(set(row.tolist())) == len(row)


def test_beam_widens_until_the_audit_passes():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw.Graph.build(x.astype(np.float32))
    beam = D.audited_beam(graph, x, 0.9, beam=1)
    assert beam > 1 and D.audited_beam(graph, x, 0.9, beam=beam) == beam


def test_saturated_beams_are_compared_with_every_node(monkeypatch):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=16)
    x = np.concatenate([centre + 0.1 * rng.normal(size=(400, 16)), rng.normal(size=(400, 16))])
    shard = D.Shard.__new__(D.Shard)
    shard.x = x / np.linalg.norm(x, axis=1, keepdims=True)
    shard.single = shard.x.astype(np.float32)
    shard.nodes, shard.copies, shard.beam = np.arange(800) * 7, np.full(800, 2), 8
    shard.graph = hnsw.Graph.build(shard.single)
    nodes, links, roots = D.links_in_cell(shard, shard, 0.9)
    close = shard.x @ shard.x.T >= 0.9
    want = 2 * (close.sum(axis=1) - 1)
    got = np.zeros(800, int)
    got[nodes // 7] = links
    assert (got == want).mean() > 0.99 and (got <= want).all() and len(set(roots[nodes < 2800].tolist())) == 1
