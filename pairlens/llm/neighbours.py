"""Approximate nearest neighbours by a navigable small-world graph per shard.

Equal vectors are one node.  Each shard of nodes gets a hierarchical graph:
nodes are inserted in turn, link to near earlier nodes that a diversity rule
selects, and a node reaches each level with a falling probability.  Candidates
for linking are found by blocked products inside the shard, which has a fixed
size, instead of by walking the unfinished graph.  A graph is stored as flat
arrays.  Every query walks the graph of every shard; the shards' results are
scored again in double precision and merged.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairlens.llm.common import partitions_for, stored

#: Nodes of a shard and queries of a block (about): they bound what a task holds.
SHARD_NODES, BLOCK_QUERIES = 8192, 8192
#: Links per node and level (twice as many at the ground), candidates, and the width of a walk.
LINKS, CANDIDATES, WIDTH = 16, 96, 128


def _levels(n: int) -> np.ndarray:
    """How high each node reaches: exponential, from its number."""
    u = np.random.default_rng(n).random(n)
    return np.minimum((-np.log(1 - u) / np.log(LINKS)).astype(np.int64), 8)


def _diverse(unit: np.ndarray, near: np.ndarray, similar: np.ndarray, most: int) -> np.ndarray:
    """Of ``near``, nearest first, those nearer to the node than to a node already selected; then the nearest others."""
    among = unit[near] @ unit[near].T
    taken: list[int] = []
    for i in range(len(near)):
        if len(taken) == most:
            break
        if not taken or among[i, taken].max() < similar[i]:
            taken.append(i)
    if len(taken) < most:
        rest = np.setdiff1d(np.arange(len(near)), taken)
        taken += rest[:most - len(taken)].tolist()
    return near[taken]


def build(vectors: np.ndarray) -> dict[str, np.ndarray]:
    """The graph of ``vectors`` (no zero rows) as flat arrays: per level its nodes and their neighbours (-1: none)."""
    unit = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)
    level = _levels(len(unit))
    out: dict[str, np.ndarray] = {"vectors": vectors, "levels": np.array(level.max() + 1 if len(level) else 0)}
    for k in range(int(out["levels"])):
        nodes = np.flatnonzero(level >= k)
        most = LINKS * 2 if k == 0 else LINKS
        links: list[list[int]] = [[] for _ in nodes]
        for start in range(0, len(nodes), 512):
            rows = np.arange(start, min(start + 512, len(nodes)))
            s = unit[nodes[rows]] @ unit[nodes[:rows[-1] + 1]].T
            s[np.arange(len(rows))[:, None] <= np.arange(s.shape[1])[None, :] - start] = -2  # earlier nodes only
            width = min(CANDIDATES, s.shape[1])
            near = np.argpartition(-s, width - 1, axis=1)[:, :width]
            for j, i in enumerate(rows):
                c = near[j][s[j, near[j]] > -2]
                if not len(c):
                    continue
                c = c[np.argsort(-s[j, c], kind="stable")]
                for other in _diverse(unit, nodes[c], s[j, c], LINKS):
                    o = int(np.searchsorted(nodes, other))
                    links[i].append(o)
                    links[o].append(int(i))
                    if len(links[o]) > 2 * most:
                        links[o] = _trim(unit, nodes, o, links[o], most)
        flat = np.full((len(nodes), most), -1, np.int32)
        for i, l in enumerate(links):
            l = _trim(unit, nodes, i, l, most) if len(l) > most else l
            flat[i, :len(l)] = nodes[l]
        out[f"nodes{k}"], out[f"links{k}"] = nodes.astype(np.int32), flat
    return out


def _trim(unit: np.ndarray, nodes: np.ndarray, i: int, links: list[int], most: int) -> list[int]:
    own = nodes[np.array(links)]
    s = unit[own] @ unit[nodes[i]]
    order = np.argsort(-s, kind="stable")
    return np.searchsorted(nodes, _diverse(unit, own[order], s[order], most)).tolist()


def search(graph: dict[str, np.ndarray], unit: np.ndarray, query: np.ndarray, width: int) -> np.ndarray:
    """The nodes that a walk of ``width`` towards ``query`` ends with, down from the highest level."""
    top = int(graph["levels"]) - 1
    q = (query / np.linalg.norm(query)).astype(np.float32)
    at = int(graph[f"nodes{top}"][0])
    best = float(unit[at] @ q)
    for k in range(top, 0, -1):
        nodes, links = graph[f"nodes{k}"], graph[f"links{k}"]
        while True:
            near = links[np.searchsorted(nodes, at)]
            near = near[near >= 0]
            if not len(near):
                break
            s = unit[near] @ q
            j = int(s.argmax())
            if s[j] <= best:
                break
            at, best = int(near[j]), float(s[j])
    links = graph["links0"]
    seen = np.zeros(len(unit), bool)
    seen[at] = True
    open_, kept = [(-best, at)], [(best, at)]
    while open_:
        s, node = heapq.heappop(open_)
        if len(kept) >= width and -s < kept[0][0]:
            break
        near = links[node]
        near = near[near >= 0]
        near = near[~seen[near]]
        if not len(near):
            continue
        seen[near] = True
        found = unit[near] @ q
        if len(kept) >= width:
            ahead = found > kept[0][0]
            near, found = near[ahead], found[ahead]
        for value, other in zip(found.tolist(), near.tolist()):
            if len(kept) < width:
                heapq.heappush(kept, (value, other))
            elif value > kept[0][0]:
                heapq.heapreplace(kept, (value, other))
            else:
                continue
            heapq.heappush(open_, (-value, other))
    return np.array([node for _, node in kept])


def _dump(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, dim, vector) of the usable rows; vector is the doubles' bytes."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = [np.asarray(v, np.float64) for v in batch["v"]]
            yield pd.DataFrame({"vec_id": batch["vec_id"], "dim": [len(v) for v in raw], "vector": [(v + 0.0).tobytes() for v in raw]})

    v = F.col("embedding").cast("array<double>")
    usable = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    usable = usable.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
                          " and exists(v, x -> x != 0)")
    return usable.mapInPandas(run, "vec_id long, dim int, vector binary")


def build_index(vectors: DataFrame, k: int) -> tuple[DataFrame, int]:
    """(dim, shard, graph) of all vectors, and the number of shards.

    A node keeps the k + 1 smallest vec_ids of its vector: ties go to smaller
    ids, so no other of them can be among a query's k nearest.
    """
    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: dict[tuple[int, bytes], list[int]] = {}
        for batch in batches:
            for i, dim, v in zip(batch["vec_id"], batch["dim"], batch["vector"]):
                own = ids.setdefault((dim, v), [])
                if i not in own:
                    own.append(i)
                    if len(own) > k + 1:
                        own.remove(max(own))
        yield pd.DataFrame({"dim": [d for d, _ in ids], "vector": [v for _, v in ids], "ids": list(ids.values())},
                           dtype=object)

    # Each partition has sent at most k + 1 ids of a vector on.
    parts = vectors.mapInPandas(first, "dim int, vector binary, ids array<long>")
    nodes = stored(parts.groupBy("dim", "vector").agg(
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids")), "vectors")
    shards = partitions_for(nodes.count(), SHARD_NODES)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vector")
        g = build(np.stack([np.frombuffer(v, np.float64) for v in group["vector"]]))
        g["ids"] = np.full((len(group), k + 1), -1, np.int64)
        g["n"] = np.array([len(i) for i in group["ids"]])
        for row, i in enumerate(group["ids"]):
            g["ids"][row, :len(i)] = i
        return pd.DataFrame({"dim": group["dim"].iloc[:1], "shard": group["shard"].iloc[:1], "graph": [_dump(g)]})

    shard = F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int")
    index = nodes.withColumn("shard", shard).groupBy("dim", "shard").applyInPandas(run, "dim int, shard int, graph binary")
    return stored(index, "graphs"), shards


def nearest(embeddings: DataFrame, every: int, k: int = 5, width: int = WIDTH) -> DataFrame:
    """query_id, rank, vec_id and score of the k vectors nearest to each query, by cosine.

    Queries are the rows whose vec_id ``every`` divides; candidates all rows
    with another vec_id.  Nearest first, ties to the smaller vec_id.  Vectors
    that are null, empty, zero or hold null or non-finite components, and rows
    without vec_id, take no part; vectors of different length are not compared;
    of rows that repeat a vec_id the nearest counts.  Fewer candidates give
    fewer rows, an empty table none; other columns are ignored.
    """
    vectors = stored(_vectors(embeddings), "usable-vectors")
    index, shards = build_index(vectors, k)
    queries = vectors.where(F.col("vec_id") % every == 0).distinct()
    blocks = partitions_for(queries.count(), BLOCK_QUERIES)
    # The stated query set against every shard, in blocks.  Queries times shards are many more rows than
    # either, so they are dealt to their shard by a shuffle: a planner that knows the queries' size only
    # would broadcast them all.  A graph is sent once for each block.
    block = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)).cast("int")
    asked = queries.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), block.alias("block"),
                           "vec_id", "vector")
    graphs = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(queries_: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries_) and len(graph):
            with np.load(io.BytesIO(graph["graph"].iloc[0])) as z:
                g = {name: z[name] for name in z.files}
            own = g["vectors"]
            norms = np.sqrt((own * own).sum(1))
            unit = (own / norms[:, None]).astype(np.float32)
            for vec_id, vector in zip(queries_["vec_id"], queries_["vector"]):
                v = np.frombuffer(vector, np.float64)
                found = search(g, unit, v, width)
                score = (own[found] * v).sum(1) / (norms[found] * np.sqrt((v * v).sum()))
                rows = [(-s, int(i)) for s, f in zip(score.tolist(), found.tolist())
                        for i in g["ids"][f, :g["n"][f]] if i != vec_id]
                out += [(vec_id, i, -s) for s, i in heapq.nsmallest(k, rows)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    key = ("dim", "shard", "block")
    found = asked.groupBy(*key).cogroup(graphs.groupBy(*key)).applyInPandas(run, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
