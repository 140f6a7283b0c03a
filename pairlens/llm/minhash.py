"""Near duplicates by min-max hashing.

Each permutation of a document's shingles keeps both its smallest and its
largest value, so a signature of ``2 * PERMUTATIONS`` values costs
``PERMUTATIONS`` hash evaluations per shingle; both are unbiased for the
resemblance and together vary less.  A band is two permutations, four values:
at a resemblance of 0.8 a link shares none of the 32 bands with a probability
under one in a million, for sets of a few shingles as well.

Documents with equal sets are one node.  Nodes that share a band are compared
on their full sets, but a large group of copies is not compared pair by pair:
each node is first compared with a central node of its largest bands and linked
nodes are contracted.  Afterwards only nodes of different components that share
a band are compared: pair by pair in bands of few nodes, and by blocks of nodes
whose sets meet once where a component or a band is large.  Nodes of one component need no comparison, so no link that would
change a component is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairlens.llm.common import small_side, stored
from pairlens.llm.graph import components
from pairlens.llm.shingling import Words, digest, linked, mix, node_sets, shingles

PERMUTATIONS = 64
BANDS = 32
#: Largest bands of a node that propose its central node.
PROPOSALS = 4
#: Nodes up to which a component counts as small; the two sides of a block, the
#: first of which is also the most nodes of a band that are paired one by one.
SMALL, BLOCK_OUT, BLOCK_IN = 16, 64, 512
#: Shingles hashed at a time, to bound memory on very long texts.
BLOCK = 1 << 13

_ONE, _THREE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0x165667B19E3779F9))
_SEEDS = np.random.default_rng(20240607).integers(1, 2**63, (2, PERMUTATIONS), dtype=np.uint64)
_FACTORS, _SHIFTS = _SEEDS[0] | np.uint64(1), _SEEDS[1]


def bands(shingle_set: np.ndarray) -> np.ndarray:
    """The band keys of a shingle set: (minimum, maximum) of two permutations each."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for start in range(0, len(shingle_set), BLOCK):
        x = shingle_set[start:start + BLOCK][None, :] * _FACTORS[:, None]
        x ^= x >> np.uint64(32)
        x *= _THREE
        x += _SHIFTS[:, None]
        np.minimum(low, x.min(1), out=low)
        np.maximum(high, x.max(1), out=high)
    each = PERMUTATIONS // BANDS
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _ONE
    for j in range(each):
        key = mix((key ^ low[j::each]) * _ONE)
        key = mix((key ^ high[j::each]) * _THREE)
    return key.view(np.int64)


def shingled(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, digest, bands); digest of the set, null for an empty one."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Words()
        for batch in batches:
            sizes, digests, keys = [], [], []
            for text in batch["text"]:
                s = shingles(text, words, hashes)
                sizes.append(len(s))
                digests.append(digest(s) if len(s) else None)
                keys.append(bands(s) if len(s) else None)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_shingles": sizes, "digest": digests, "bands": keys})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInPandas(run, "doc_id long, n_shingles long, digest binary, bands array<long>")


def _linked_blocks(sides: DataFrame, inside: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the nodes that ``sides`` (a, target) sends to a component and that component's nodes.

    Both sides are dealt into blocks; each pair of blocks meets once, and a
    set travels once per block of the other side instead of once per pair.
    """
    out_n = sides.groupBy("target").agg(F.ceil(F.count(F.lit(1)) / BLOCK_OUT).cast("int").alias("outs"))
    in_n = inside.groupBy("target").agg(F.ceil(F.count(F.lit(1)) / BLOCK_IN).cast("int").alias("ins"))
    blocks = out_n.join(in_n, "target")

    def dealt(rows: DataFrame, own: str, other: str, *names: str) -> DataFrame:
        return (rows.join(blocks, "target").join(sets, "node").select(
            "target", F.pmod(F.xxhash64("node"), F.col(own)).cast("int").alias("own"),
            F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("other"), "node", "set").toDF(*names))

    left = dealt(sides.withColumnRenamed("a", "node"), "outs", "ins", "t1", "o1", "i1", "node", "set")
    right = dealt(inside, "ins", "outs", "t2", "i2", "o2", "node2", "set2")

    def run(outs: pd.DataFrame, ins: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        if len(outs) and len(ins):
            own = [np.frombuffer(raw, np.uint64) for raw in outs["set"]]
            sizes = np.array([len(s) for s in own])
            values = np.concatenate(own)
            owner = np.repeat(np.arange(len(own)), sizes)
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            nodes = outs["node"].to_numpy()
            for b, raw in zip(ins["node2"], ins["set2"]):
                s = np.frombuffer(raw, np.uint64)
                lo, hi = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
                n = hi - lo
                at = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
                common = np.bincount(owner[at], minlength=len(own))
                yes = 100 * common >= percent * (sizes + len(s) - common)
                found += [(int(a), int(b)) for a in nodes[yes] if a != b]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return left.groupBy("t1", "o1", "i1").cogroup(right.groupBy("t2", "o2", "i2")).applyInPandas(run, "a long, b long")


def _near_sizes(percent: int):
    return ((F.col("size_a") * 100 >= F.col("size_b") * percent)
            & (F.col("size_b") * 100 >= F.col("size_a") * percent))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and the digest of the shingle set for every row.

    Rows whose shingle sets have ``100 * common >= percent * union`` are linked;
    component_id is the smallest doc_id that links reach and ``kept`` marks its
    row.  A row without words is linked with nothing.  A row without doc_id is
    kept out of all links: its component_id is null and it is not ``kept``.  Rows
    that repeat a doc_id are compared by their own texts.  An empty table gives
    an empty result; other columns are ignored.
    """
    base = stored(shingled(docs, words).withColumn("row", F.monotonically_increasing_id()), "shingled")
    usable = base.where("doc_id is not null and digest is not null")
    # One node per distinct set; copies are counted away before anything is compared.
    nodes = stored(usable.groupBy("digest").agg(
        F.min("row").alias("node"), F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("size"),
        F.first("bands").alias("bands")), "nodes")
    keyed = nodes.select(F.explode("bands").alias("key"), "node", F.col("size").cast("int").alias("size"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stored(keyed.join(shared, "key"), "band-members")
    compared = members.select("node").distinct()
    wanted = stored(nodes.join(compared, "node", "left_semi").select("node", "doc_id", "digest"), "compared-nodes")
    sets = stored(node_sets(docs, wanted, words), "node-sets")

    # Every node against the most central node of its largest bands.
    own = Window.partitionBy("node")
    ranked = members.select("*", F.sum("n").over(own).alias("score"),
                            F.row_number().over(own.orderBy(F.desc("n"), "key")).alias("nth")).where(F.col("nth") <= PROPOSALS)
    centre = ranked.groupBy("key").agg(F.max_by(F.struct("node", "size"), F.struct("score", "node")).alias("c"))
    proposed = ranked.join(centre, "key").where("node != c.node").select(
        F.col("node").alias("a"), F.col("c.node").alias("b"), F.col("size").alias("size_a"),
        F.col("c.size").alias("size_b")).where(_near_sizes(percent))
    pairs = proposed.select("a", "b").distinct()
    links = stored(linked(pairs, sets, percent), "near-links")
    labels = stored(components(links), "labels")

    # What shares a band but lies in different components is compared next.
    counts = labels.groupBy("component").agg(F.count(F.lit(1)).alias("of"))
    sized = labels.join(counts, "component")
    now = members.select("key", "node", "size").join(sized, "node", "left").withColumns(
        {"component": F.coalesce("component", "node"), "of": F.coalesce("of", F.lit(1))})
    split = now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")) \
        .where("lo != hi").select("key")
    open_ = stored(now.join(split, "key"), "band-open")
    kinds = open_.groupBy("key").agg(F.max("of").alias("most"), F.count(F.lit(1)).alias("n"),
                                     F.max_by("component", F.struct("of", "component")).alias("main"))
    open_ = open_.join(kinds, "key")
    # A band of few nodes in small components: pair by pair, each once.
    few = open_.where((F.col("most") <= SMALL) & (F.col("n") <= BLOCK_OUT))
    small = (few.select("key", F.col("node").alias("a"), F.col("component").alias("ca"), F.col("size").alias("size_a"))
             .join(few.select("key", F.col("node").alias("b"), F.col("component").alias("cb"), F.col("size").alias("size_b")), "key")
             .where((F.col("a") > F.col("b")) & (F.col("ca") != F.col("cb")) & _near_sizes(percent))
             .select("a", "b").distinct())
    small = stored(small.join(pairs, ["a", "b"], "left_anti"), "small-pairs")
    # A band with a large component: its other nodes against that whole component and
    # each other.  Any other band of many nodes: all of them against each other.
    large = F.col("most") > SMALL
    sides = open_.where(~((F.col("most") <= SMALL) & (F.col("n") <= BLOCK_OUT))).where(
        ~large | (F.col("component") != F.col("main"))).select(
        F.col("node").alias("a"), F.when(large, F.col("main")).otherwise(F.col("key")).alias("target"))
    sides = stored(sides.distinct(), "block-sides")
    more = linked(small, sets, percent)
    if not sides.isEmpty():
        targets = sides.select(F.col("target").alias("component")).distinct()
        inside = labels.join(targets, "component", "left_semi").select(F.col("component").alias("target"), "node")
        inside = stored(inside.union(sides.select("target", F.col("a").alias("node"))).distinct(), "block-nodes")
        more = more.union(_linked_blocks(sides, inside, sets, percent))
    more = stored(more, "near-links")
    if not more.isEmpty():
        labels = stored(components(links.union(more)), "labels")

    reach = nodes.select("digest", "node", "doc_id").join(labels, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    least = reach.groupBy("component").agg(F.min("doc_id").alias("reached"))
    by_digest = reach.join(least, "component").select(F.col("digest").alias("d"), "reached")
    return (base.join(by_digest, (base["digest"] == by_digest["d"]) & base["doc_id"].isNotNull(), "left")
            .select("doc_id", "n_shingles", F.coalesce("reached", "doc_id").alias("component_id"), "digest")
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group is kept, with all their columns.

    The one with the smallest doc_id stays; rows without doc_id stay.  Of rows
    that repeat a doc_id with other texts, only those whose text goes are dropped.
    """
    judged = stored(near_duplicates(docs, words, percent).where("doc_id is not null").select("doc_id", "digest", "kept"), "judged")
    by_id = judged.groupBy("doc_id").agg(F.bool_or("kept").alias("some"), F.bool_and("kept").alias("all")).where("not all")
    by_id = stored(by_id.select("doc_id", "some"), "dropped-ids")
    stay = docs.join(small_side(by_id), "doc_id", "left_anti").select(*docs.columns)
    parted = by_id.where("some").select("doc_id")
    if parted.isEmpty():
        return stay
    # Ids some of whose rows go: a row is told from the others by the digest of its set.
    gone = judged.where("not kept").join(parted, "doc_id").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).distinct()
    rows = docs.join(parted, "doc_id", "left_semi").select(*docs.columns)

    @F.pandas_udf("binary")
    def set_digest(texts: pd.Series) -> pd.Series:
        hashes = Words()
        sets = (shingles(t, words, hashes) for t in texts)
        return pd.Series([digest(s) if len(s) else None for s in sets])

    told = rows.withColumn("__own", set_digest(F.col("text").cast("string")))
    told = told.join(gone, (told["doc_id"] == gone["__id"]) & told["__own"].eqNullSafe(gone["__digest"]), "left_anti")
    return stay.unionByName(told.select(*docs.columns))
