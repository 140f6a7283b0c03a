"""Similarity join over word shingles with an R-tree of count vectors.

The shingles of a document are hashed into groups; the counts of the groups are a
point.  Two sets have at most as many shingles in common as the sum of the smaller
counts, coordinate by coordinate, and a box of points bounds that sum for all of
them by its largest counts.  The tree is joined with itself from its top: pairs of
boxes whose bound is too small for a link fall away with all that lies in them,
pairs of points that survive are verified on the full sets.

With many coordinates random texts lie far from each other in the sum but near in
each coordinate, so boxes alone would not keep a task's part of the tree small.
The tree is therefore dealt out by exact places: a link of a set of ``a`` shingles
with a larger one differs in at most ``a * (100 - percent) / percent`` shingles.
If the groups are dealt into one run more than that, at least one run has the same
counts on both sides.  A class of sizes, a run and its counts are a *cell*; every
linked pair meets in some cell, and each cell has a tree of its own, whose leaves
are packed by a range sort, so a cell with very many documents is spread out.

Documents with equal sets are one node.  Nodes are first compared with one or two
central nodes of their cells, by their points and where these allow a link by their
full sets, and linked ones are contracted; the tree join then looks only for links
between different components, so a group of copies is never compared pair by pair.
Nothing is left out: a pair that is not looked at lies in one component or cannot be
a link.

What travels is kept small: cells leave the rows of a document only as (cell, row),
points and sets are read for nodes that share a cell or may be linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import small_side, stored
from pairlens.llm.graph import components
from pairlens.llm.shingling import Words, dealt, digest, linked, node_sets, shingles

#: Coordinates of a point; groups of a run.
GROUPS, RUN_GROUPS = 128, 32
#: The largest count that a point tells.
MANY = 65_535
#: Entries of a leaf and of an inner node.
LEAF, FANOUT = 64, 64

_ONE, _TWO, _THREE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: One random summand for each group of a run: the sum stands for the counts.
_SUMMANDS = np.random.default_rng(20250211).integers(1, 2**63, RUN_GROUPS, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _TWO
    return x ^ (x >> np.uint64(29))


def size_classes(percent: int, most: int) -> list[tuple[int, int]]:
    """(least, most) size of each class: a set's partners that are no smaller lie in its class or the next."""
    out, least = [], 1
    while least <= most:
        out.append((least, 100 * least // percent))
        least = out[-1][1] + 1
    return out


class Classes:
    """Size classes as far as they are needed."""

    def __init__(self, percent: int):
        self.percent, self.bounds = percent, size_classes(percent, 1000)

    def of(self, n: int) -> list[tuple[int, int]]:
        """(class, runs) in which a set of ``n`` shingles looks for partners; none if only equal sets can link."""
        while self.bounds[-1][1] < n:
            self.bounds = size_classes(self.percent, 2 * n)
        i = int(np.searchsorted([b for _, b in self.bounds], n)) if n > 64 else next(
            j for j, (_, b) in enumerate(self.bounds) if n <= b)
        own = [i]
        if i and -(-self.percent * n // 100) <= self.bounds[i - 1][1]:
            own.append(i - 1)
        differing = [(j, self.bounds[j][1] * (100 - self.percent) // self.percent) for j in own]
        return [(j, t + 1) for j, t in differing if t]


def cells(shingle_set: np.ndarray, classes: Classes) -> np.ndarray:
    """The keys of the cells in which a set stands."""
    h = _mix(shingle_set * _ONE)
    summand = _SUMMANDS[(h >> np.uint64(56)) % np.uint64(RUN_GROUPS)]
    where = (h >> np.uint64(8)) & np.uint64(0xFFFFFFFF)
    out = []
    for i, runs in classes.of(len(shingle_set)):
        sums = np.zeros(runs, np.uint64)
        np.add.at(sums, (where % np.uint64(runs)).astype(np.int64), summand)
        tag = np.arange(runs, dtype=np.uint64) * _THREE + np.uint64((i + 1) * int(_ONE) % 2**64)
        out.append(_mix(_mix(sums ^ tag) + tag))
    return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)


def point(shingle_set: np.ndarray) -> bytes:
    """The counts of the groups, ``MANY`` for any larger one; big-endian, so that byte order is the order of counts."""
    group = _mix(shingle_set * _THREE) % np.uint64(GROUPS)
    return np.minimum(np.bincount(group.astype(np.int64), minlength=GROUPS), MANY).astype(">u2").tobytes()


def _points(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), ">u2").reshape(-1, GROUPS).astype(np.int32)


def _common(points: np.ndarray, points2: np.ndarray) -> np.ndarray:
    """The most that sets with these counts can have in common: no bound where both counts are ``MANY``."""
    least = np.minimum(points, points2)
    return np.where((least == MANY).any(-1), np.int64(1) << 40, least.sum(-1))


def _may_link(common, size_a, size_b, percent: int):
    """Whether sets of these sizes with at most ``common`` shingles in common may be a link."""
    return (100 + percent) * common >= percent * (size_a + size_b)


def _described(docs: DataFrame, words: int, percent: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, classes = Words(), Classes(percent)
        for batch in batches:
            for start in range(0, len(batch), 1000):
                part, out = batch[start:start + 1000], []
                for text in part["text"]:
                    s = shingles(text, words, hashes)
                    out.append((len(s), digest(s), point(s), cells(s, classes)) if len(s) else (0, None, None, None))
                out = pd.DataFrame(out, columns=["n_shingles", "digest", "point", "cells"])
                out.insert(0, "doc_id", part["doc_id"].to_numpy())
                yield out

    return docs.mapInPandas(run, "doc_id long, n_shingles long, digest binary, point binary, cells array<long>")


# -- the tree ----------------------------------------------------------------------------

_BOX = "key long, box long, parent long, high binary, least long, most long, low_component long, high_component long"
_ENTRIES = "nodes array<long>, sizes array<long>, components array<long>, points binary"


def _packer(per: int, leaves: bool):
    """Rows in order -> consecutive ones of a key packed into boxes of at most ``per``."""
    columns = ["key", "box", "high", "least", "most", "low_component", "high_component"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        held: list[np.ndarray] | None = None

        def boxes(rows: list[np.ndarray], last: bool) -> tuple[list[tuple], list[np.ndarray] | None]:
            """The boxes of full runs of a key, and the rows of one that may go on."""
            nonlocal number
            key, box, high, least, most, low, top = rows
            border = np.flatnonzero(key[1:] != key[:-1]) + 1
            out = []
            for lo, hi in zip([0, *border.tolist()], [*border.tolist(), len(key)]):
                for at in range(lo, hi, per):
                    to = min(at + per, hi)
                    if not last and to == len(key):
                        return out, [c[at:] for c in rows]
                    number += 1
                    points = b"".join(high[at:to])
                    own = ((box[at:to], least[at:to], low[at:to], points) if leaves else (box[at:to],))
                    bound = np.frombuffer(points, ">u2").reshape(-1, GROUPS).max(0).astype(">u2").tobytes()
                    out.append((key[at], number, None, bound, least[at:to].min(), most[at:to].max(), low[at:to].min(),
                                top[at:to].max(), *own))
            return out, None

        names = ["key", "box", "parent", "high", "least", "most", "low_component", "high_component",
                 *(["nodes", "sizes", "components", "points"] if leaves else ["children"])]
        for batch in batches:
            if len(batch):
                rows = [batch[c].to_numpy() for c in columns]
                out, held = boxes(rows if held is None else [np.concatenate(x) for x in zip(held, rows)], last=False)
                yield pd.DataFrame(out, columns=names)
        if held is not None:
            yield pd.DataFrame(boxes(held, last=True)[0], columns=names)

    return run


def _leaves(entries: DataFrame) -> DataFrame:
    """Leaves of the trees of all cells: entries in order of size and counts."""
    rows = entries.select("key", F.col("node").alias("box"), F.col("point").alias("high"), F.col("size").alias("least"),
                          F.col("size").alias("most"), F.col("component").alias("low_component"),
                          F.col("component").alias("high_component"))
    order = ("key", "least", "high", "box")
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(
        _packer(LEAF, True), f"{_BOX}, {_ENTRIES}")


def _inner(below: DataFrame) -> DataFrame:
    """One level more: neighbouring boxes of a cell under one box."""
    order = ("key", "least", "high", "box")
    return below.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(
        _packer(FANOUT, False), f"{_BOX}, children array<long>")


def _surviving(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs of boxes (with both boxes' columns) that may hold a link between different components."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                common = _common(_points(batch["high"]), _points(batch["high2"]))
                yield batch.loc[_may_link(common, batch["least"].to_numpy(), batch["least2"].to_numpy(), percent),
                                ["key", "box", "box2"]]

    near = ((F.col("most") * 100 >= F.col("least2") * percent) & (F.col("most2") * 100 >= F.col("least") * percent))
    apart = ((F.col("low_component") != F.col("high_component")) | (F.col("low_component2") != F.col("high_component2"))
             | (F.col("low_component") != F.col("low_component2")))
    return pairs.where(near & apart).select("key", "box", "box2", "high", "high2", "least", "least2").mapInPandas(
        run, "key long, box long, box2 long")


def _twice(boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    kept = boxes.select("key", "box", "parent", "high", "least", "most", "low_component", "high_component")
    return kept, kept.toDF(*(c if c == "key" else f"{c}2" for c in kept.columns))


def tree_join(entries: DataFrame, percent: int) -> DataFrame:
    """(a, b), a > b: nodes of different components in a common cell whose points allow a link.

    ``entries`` is (key, node, size, component, point).  Levels are built until
    no cell has more than ``FANOUT`` boxes at the top; the join then goes down
    level by level, so a pair of boxes gives at most ``FANOUT`` squared pairs.
    """
    levels = [stored(_leaves(entries), "tree-leaves")]
    while not levels[-1].groupBy("key").count().where(F.col("count") > FANOUT).isEmpty():
        levels.append(stored(_inner(levels[-1].drop("nodes", "sizes", "components", "points", "children")), "tree-level"))
    for i in range(len(levels) - 1):
        above = levels[i + 1].select(F.explode("children").alias("box"), F.col("box").alias("over"))
        levels[i] = levels[i].drop("parent").join(above, "box").withColumnRenamed("over", "parent")
    left, right = _twice(levels[-1])
    pairs = _surviving(left.join(right, "key").where("box <= box2"), percent)
    for level in reversed(levels[:-1]):
        pairs = stored(pairs, "box-pairs")
        left, right = _twice(level)
        up = pairs.select(F.col("box").alias("parent"), F.col("box2").alias("parent2"))
        below = up.join(left, "parent").join(right.drop("key"), "parent2")
        pairs = _surviving(below.where("parent != parent2 or box <= box2"), percent)
    pairs = stored(pairs.select("box", "box2").where("box != box2"), "leaf-pairs")

    def compared(row, other) -> np.ndarray | None:
        """The pairs of nodes of two leaves (or of one, if ``other`` is None) that may be links."""
        nodes, sizes, comps, points = row
        nodes2, sizes2, comps2, points2 = other or row
        common = _common(points[:, None], points2[None, :])
        yes = _may_link(common, sizes[:, None], sizes2[None, :], percent) & (comps[:, None] != comps2[None, :])
        if other is None:
            yes = np.triu(yes, 1)
        i, j = np.nonzero(yes)
        return np.stack([nodes[i], nodes2[j]]) if len(i) else None

    def found(parts: list) -> pd.DataFrame:
        both = np.concatenate([p for p in parts if p is not None] or [np.empty((2, 0), np.int64)], 1)
        return pd.DataFrame({"a": both.max(0), "b": both.min(0)}, dtype="int64").drop_duplicates()

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield found([compared((*map(np.asarray, r[:3]), _points([r[3]])), None) for r in zip(
                batch["nodes"], batch["sizes"], batch["components"], batch["points"])])

    def between(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield found([compared((*map(np.asarray, r[:3]), _points([r[3]])), (*map(np.asarray, r[4:7]), _points([r[7]])))
                         for r in zip(*(batch[c] for c in [*entry, *(f"{c}2" for c in entry)]))])

    entry = ["nodes", "sizes", "components", "points"]
    # A leaf with itself needs no other row; only pairs of leaves travel.
    own = levels[0].where("low_component != high_component").select(*entry).mapInPandas(within, "a long, b long")
    leaves = levels[0].select("box", *entry)
    seconds = leaves.toDF("box2", *(f"{c}2" for c in entry))
    met = pairs.join(leaves, "box").join(seconds, "box2").select(*entry, *(f"{c}2" for c in entry))
    return own.union(met.mapInPandas(between, "a long, b long")).distinct()


def near_pairs(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose points allow a link; ``nodes`` tells (node, size, point)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        target, size, counts = None, 0, None
        for batch in batches:
            out, own = [], _points(batch["point"]) if len(batch) else None
            for i, (t, kind, node, n) in enumerate(zip(batch["target"], batch["kind"], batch["node"], batch["size"])):
                if kind == 0:
                    target, size, counts = t, n, own[i].copy()
                elif t == target and _may_link(_common(own[i], counts), n, size, percent):
                    out.append((node, t))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return dealt(pairs, nodes.select("node", "size", "point")).select("target", "kind", "node", "size", "point").mapInPandas(
        run, "a long, b long")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def similarity_join(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Rows whose shingle sets have ``100 * common >= percent * union`` are linked;
    component_id is the smallest doc_id that links reach.  A text of fewer words
    is one shingle; a null text and one without words have none and link with
    nothing.  A row without doc_id takes no part and has no component_id; rows
    that repeat a doc_id are compared by their own texts.  An empty table gives
    an empty result; other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = stored(_described(texts, words, percent).withColumn("row", F.monotonically_increasing_id()), "described")
    usable = base.where("doc_id is not null and digest is not null")
    firsts = stored(usable.groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("least_id")), "firsts")
    # Cells of more than one row; then of more than one node, as copies of a node share its cells.
    keyed = usable.select(F.explode("cells").alias("key"), F.col("row").alias("node"))
    often = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    met = stored(keyed.join(often, "key").join(firsts.select("node"), "node", "left_semi"), "cell-rows")
    shared = met.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("centre")).where("n > 1")
    members = stored(met.join(shared, "key"), "cell-members")
    described = base.select(F.col("row").alias("node"), "doc_id", "digest", F.col("n_shingles").alias("size"), "point")
    nodes = stored(described.join(members.select("node").distinct(), "node", "left_semi"), "join-nodes")

    # Every node against the first node of its cells and of its largest cell.
    centres = members.groupBy("node").agg(F.min("centre").alias("c1"), F.max_by("centre", F.struct("n", "key")).alias("c2"))
    pairs = stored(centres.select(F.col("node").alias("a"), F.explode(F.array("c1", "c2")).alias("b")).where("a != b").distinct(),
                   "centre-pairs")
    near = stored(near_pairs(pairs, nodes, percent), "near-pairs")
    compared = _ends(near)
    sets = stored(node_sets(texts, stored(nodes.join(compared, "node", "left_semi").select("node", "doc_id", "digest"), "compared"),
                            words), "node-sets")
    links = stored(linked(near, sets, percent), "links")
    labels = stored(components(links), "labels")

    # What shares a cell but lies in different components goes into the tree.
    now = members.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    open_ = now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n"),
                                   *[F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"x{i}") for i in range(2)]).where("lo != hi")
    # Cells with the same nodes say the same; one of them is enough.
    open_ = open_.groupBy("n", "x0", "x1").agg(F.min("key").alias("key")).select("key")
    entries = stored(now.join(open_, "key").join(nodes.select("node", "size", "point"), "node"), "tree-entries")
    asked = stored(tree_join(entries, percent).join(pairs, ["a", "b"], "left_anti"), "surviving-pairs")
    ends = stored(_ends(asked), "asked-nodes")
    fresh = stored(nodes.join(ends, "node", "left_semi").join(sets, "node", "left_anti").select("node", "doc_id", "digest"), "compared")
    known = sets.join(small_side(ends), "node", "left_semi")
    more = stored(linked(asked, known.union(node_sets(texts, fresh, words)), percent), "links")
    if not more.isEmpty():
        labels = stored(components(links.union(more)), "labels")

    reach = firsts.join(labels, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    least = reach.groupBy("component").agg(F.min("least_id").alias("reached"))
    by_digest = reach.join(least, "component").select(F.col("digest").alias("d"), "reached")
    return (base.join(by_digest, (base["digest"] == by_digest["d"]) & base["doc_id"].isNotNull(), "left")
            .select("doc_id", "n_shingles", F.coalesce("reached", "doc_id").alias("component_id")))
