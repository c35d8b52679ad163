"""Near-duplicate embeddings by cosine (a navigable small-world graph per shard).

Equal vectors are one node with a number of copies. Nodes are dealt to shards by hash; a task builds each
shard's graph (``hnsw``) and stores it in parts. Every pair of shards is one cell: the nodes of the
one search the graph of the other, and in a shard's own cell its nodes search their own graph, each
starting at itself, so every vector meets every shard and a pair is looked for once. Shards grow
with the square root of the number of nodes, so do their number, up to SHARD_NODES.

Beams widen until audits pass: when a graph is built, queries planted at exactly the threshold from
its own nodes must be found again (PLANTED of them, share RECALL); in a cell, the links of AUDIT
queries are counted by brute force and the same share of them must be found. A query whose whole
beam links goes on with a wider beam, and when a quarter of the graph would be in it, is compared
with every node. Candidates count only after their cosine is verified in double precision.

A cell gives one row per node with a link: the number of links and the root of the node's tree in the
cell, so rows do not grow with the pairs of a dense group; the trees' edges are united by alternating
stars.

Defined cases: vectors that are null, empty, zero or hold null, NaN or infinite entries link with
nothing, nor do rows with a null id (which stay, ``kept``); only vectors of the same length are compared;
the two zeros are equal; repeated rows count as vectors of their own, also those that repeat an id; other
columns don't matter; an empty table gives no rows. Building the result runs the searches. A task holds
one or two shards, at most SHARD_NODES nodes each.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry.llm import hnsw
from merchantry.operators.components import connected_components
from merchantry.session import materialize, ship_package

THRESHOLD = 0.9
SHARD_NODES = 1 << 20
PER_SHARD = 1024               # a table of n nodes has sqrt(n / PER_SHARD) shards
PART = 1024                    # nodes in a stored part of a graph
BEAM = 48
RECALL = 0.99
PLANTED, AUDIT = 256, 64
MARGIN = 1e-4                  # of single precision, candidates are verified in double
FOUND = "node long, n long, root long"
STORED = "dim int, shard int, part int, n int, beam int, nodes binary, copies binary, vec binary, links binary"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, dim, vec): ``vec`` holds the entries' bytes in their own precision, null if the row takes no part."""
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = pa.float32() if single else pa.float64()

    def run(it):
        for batch in it:
            dims, vecs = [], []
            for i, v in zip(batch.column(0), batch.column(1)):
                vec = None
                if i.is_valid and v.is_valid and len(v.values) and not v.values.null_count:
                    x = np.asarray(v.values.cast(kind)) + 0.0
                    vec = x.tobytes() if np.isfinite(x).all() and x.any() else None
                dims.append(len(v.values) if vec else None)
                vecs.append(vec)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary())],
                                             ["vec_id", "dim", "vec"])
    picked = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<float>" if single else "array<double>"))
    return picked.mapInArrow(run, f"vec_id {picked.schema['vec_id'].dataType.simpleString()}, dim int, vec binary")


def units(raw: bytes, rows: int, dim: int) -> np.ndarray:
    """Rows of length 1 in double precision."""
    x = np.frombuffer(raw, f"<f{len(raw) // (rows * dim)}").reshape(rows, dim).astype(float)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def audited_beam(graph: hnsw.Graph, x: np.ndarray, threshold: float, beam: int = BEAM) -> int:
    """The beam that finds planted queries, ``threshold`` away from nodes of the graph in random directions."""
    rng = np.random.default_rng(7)
    at = np.unique(np.linspace(0, len(x) - 1, min(PLANTED, len(x))).astype(int))
    away = rng.standard_normal((len(at), x.shape[1]))
    away -= (away * x[at]).sum(axis=1, keepdims=True) * x[at]
    norm = np.linalg.norm(away, axis=1, keepdims=True)
    q = threshold * x[at] + math.sqrt(1 - threshold ** 2) * away / np.where(norm > 1e-9, norm, np.inf)
    while beam < len(x):
        nodes, sims = graph.search(q.astype(np.float32), beam)
        if ((nodes == at[:, None]).any(axis=1) | (sims[:, -1] >= threshold - MARGIN)).mean() >= RECALL:
            break
        beam *= 2
    return beam


def _build(table: pa.Table, threshold: float) -> pa.Table:
    table = table.take(pa.array(np.lexsort((table["node"], table["random"]))))
    dim, shard = table["dim"][0].as_py(), table["shard"][0].as_py()
    x = units(b"".join(table["vec"].to_pylist()), table.num_rows, dim)
    graph = hnsw.Graph.build(x.astype(np.float32))
    beam, out = audited_beam(graph, x, threshold), []
    nodes, copies = np.asarray(table["node"]), np.asarray(table["copies"])
    for part, at in enumerate(range(0, len(x), PART)):
        rows = slice(at, at + PART)
        out.append({"dim": dim, "shard": shard, "part": part, "n": len(x), "beam": beam, "nodes": nodes[rows].tobytes(),
                    "copies": copies[rows].tobytes(), "vec": b"".join(table["vec"][at:at + PART].to_pylist()),
                    "links": b"".join(level[rows].tobytes() for level in graph.links)})
    schema = [(c, {"int": pa.int32(), "binary": pa.binary()}[t]) for c, t in (f.split() for f in STORED.split(", "))]
    return pa.Table.from_pylist(out, schema=pa.schema(schema))


class Shard:
    """Nodes of a stored shard, and its graph if the links came along."""

    def __init__(self, parts: pa.Table):
        parts = parts.sort_by("part").to_pylist()
        self.nodes = np.frombuffer(b"".join(p["nodes"] for p in parts), np.int64)
        self.copies = np.frombuffer(b"".join(p["copies"] for p in parts), np.int64)
        self.x = units(b"".join(p["vec"] for p in parts), len(self.nodes), parts[0]["dim"])
        self.single, self.beam, self.graph = self.x.astype(np.float32), parts[0]["beam"], None
        if parts[0]["links"] is not None:
            levels = [[] for _ in hnsw.level_sizes(len(self.nodes))]
            for p in parts:
                flat, at = np.frombuffer(p["links"], np.int32), p["part"] * PART
                for level, size in enumerate(hnsw.level_sizes(len(self.nodes))):
                    n = max(0, min(size - at, PART)) * hnsw.width(level)
                    levels[level].append(flat[:n].reshape(-1, hnsw.width(level)))
                    flat = flat[n:]
            self.graph = hnsw.Graph(self.single, [np.concatenate(part) for part in levels])


def verified(queries: Shard, shard: Shard, rows, nodes, threshold: float):
    """The pairs whose cosine in double precision reaches the threshold."""
    good = np.concatenate([np.zeros(0, bool)] + [
        np.einsum("ij,ij->i", queries.x[rows[a:a + 65536]], shard.x[nodes[a:a + 65536]]) >= threshold
        for a in range(0, len(rows), 65536)])
    return rows[good], nodes[good]


def compared(queries: Shard, shard: Shard, rows: np.ndarray, threshold: float):
    """Blocks (rows, nodes) of all links of some queries, by comparing them with every node."""
    size = max(1, (1 << 21) // len(shard.nodes))
    for at in range(0, len(rows), size):
        block = rows[at:at + size]
        a, b = np.nonzero(queries.x[block] @ shard.x.T >= threshold)
        yield block[a], b


def searched(queries: Shard, shard: Shard, threshold: float, own: bool):
    """Blocks (rows, nodes, whether these are all links of the rows) of the links between the queries and a shard."""
    n, beam = len(shard.nodes), shard.beam
    search = lambda rows, beam: shard.graph.search(queries.single[rows], beam, rows if own else None)

    def hits(rows, nodes, sims):
        a, b = np.nonzero(sims >= threshold - MARGIN)
        return verified(queries, shard, rows[a], nodes[a, b], threshold)

    sample = np.unique(np.linspace(0, len(queries.nodes) - 1, min(AUDIT, len(queries.nodes))).astype(int))
    true = sum(len(a) for a, _ in compared(queries, shard, sample, threshold))
    while 4 * beam < n and len(hits(sample, *search(sample, beam))[0]) < RECALL * true:
        beam *= 2
    left = np.arange(len(queries.nodes))
    while len(left) and 4 * beam < n:
        full = np.zeros(len(left), dtype=bool)
        for at in range(0, len(left), 4096):
            rows = left[at:at + 4096]
            nodes, sims = search(rows, beam)
            full[at:at + 4096] = sims[:, -1] >= threshold - MARGIN
            done = ~full[at:at + 4096]
            yield *hits(rows[done], nodes[done], sims[done]), False
        left, beam = left[full], 2 * beam
    for a, b in compared(queries, shard, left, threshold):
        yield a, b, True


def _find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if (up == x).all():
            return x
        parent[x] = parent[up]
        x = parent[x]


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray):
    while len(a):
        a, b = _find(parent, a), _find(parent, b)
        apart = a != b
        a, b = np.maximum(a, b)[apart], np.minimum(a, b)[apart]
        np.minimum.at(parent, a, b)


def links_in_cell(queries: Shard, shard: Shard, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, number of links, root node or the node itself) of every linked node of a cell; ``queries`` may be
    the shard itself."""
    own, n = queries is shard, len(shard.nodes)
    ids, copies = (shard.nodes, shard.copies) if own else (np.concatenate([getattr(s, c) for s in (shard, queries)])
                                                           for c in ("nodes", "copies"))
    parent, links = np.arange(len(ids)), np.zeros(len(ids), dtype=np.int64)
    whole, keys = np.zeros(len(ids), dtype=bool), [np.zeros(0, np.int64)]
    for a, b, all_ in searched(queries, shard, threshold, own):
        if own:
            a, b = a[a != b], b[a != b]
            if all_:                      # a row's links are complete, other rows have found theirs
                whole[a] = True
                np.add.at(links, a, copies[b])
            # links between two complete rows are counted on both sides already
            keep = ~(whole[a] & whole[b])
            keys.append(np.unique(np.minimum(a, b)[keep] * n + np.maximum(a, b)[keep]))
        else:
            a = a + n
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
        _unite(parent, a, b)
    if own:
        pairs = np.unique(np.concatenate(keys))
        for a, b in ((pairs // n, pairs % n), (pairs % n, pairs // n)):
            part = ~whole[a]
            np.add.at(links, a[part], copies[b[part]])
    linked = np.flatnonzero(links)
    return ids[linked], links[linked], ids[_find(parent, linked)]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    threshold: float = THRESHOLD, per_shard: int = PER_SHARD) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per vector."""
    spark = vectors.sparkSession
    ship_package(spark)
    rows = materialize(usable(vectors, id_col, vector_col), "vectors")
    nodes = rows.filter(F.col("vec").isNotNull()).groupBy("dim", "vec").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "vector_nodes")
    # one row per vector length
    sizes = [(r["dim"], max(math.ceil(math.sqrt(r["n"] / per_shard)), -(-r["n"] // SHARD_NODES)))
             for r in nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()]
    shards = spark.createDataFrame(sizes, "dim int, shards int")
    dealt = nodes.join(shards, "dim").select(
        "dim", F.pmod(F.xxhash64("vec", F.lit(1)), "shards").cast("int").alias("shard"), "node", "copies", "vec",
        F.xxhash64("vec", F.lit(2)).alias("random"))
    tasks = sum(s for _, s in sizes)
    graphs = materialize(dealt.repartition(max(tasks, 1), "dim", "shard").groupBy("dim", "shard").applyInArrow(
        lambda t: _build(t, threshold), STORED), "graphs")

    # cell (i, j): the nodes of shard i search the graph of shard j
    parts = graphs.join(shards, "dim")
    searched_in = parts.select("*", F.col("shard").alias("j"), F.explode(F.sequence(F.lit(0), "shard")).alias("i"))
    searching = parts.filter(F.col("shard") < F.col("shards") - 1).withColumn("links", F.lit(None).cast("binary")).select(
        "*", F.explode(F.sequence(F.col("shard") + 1, F.col("shards") - 1)).alias("j"), F.col("shard").alias("i"))

    def cell(table: pa.Table) -> pa.Table:
        own = np.asarray(table["shard"]) == table["j"][0].as_py()
        found = np.zeros((3, 0), np.int64)
        if own.any() and (table["i"][0].as_py() == table["j"][0].as_py() or not own.all()):
            shard = Shard(table.filter(pa.array(own)))
            queries = shard if own.all() else Shard(table.filter(pa.array(~own)))
            found = links_in_cell(queries, shard, threshold)
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("node", "n", "root"), found)})

    cells = searched_in.unionByName(searching).repartition(
        max(1, min(10_000, sum(s * (s + 1) // 2 for _, s in sizes))), "dim", "i", "j")
    found = materialize(cells.groupBy("dim", "i", "j").applyInArrow(cell, FOUND), "cell_links")

    components = materialize(connected_components(found.filter(F.col("node") != F.col("root")), "node", "root"), "components")
    least = components.join(nodes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("first"))
    placed = components.join(least, "component").select("node", "first")
    of_node = (nodes.join(found.groupBy("node").agg(F.sum("n").alias("n")), "node", "left").join(placed, "node", "left")
               .select("dim", "vec", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
                       F.coalesce("first", "least").alias("component_id")))
    out = rows.join(of_node, ["dim", "vec"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
