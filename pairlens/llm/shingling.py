"""Word shingles as sorted 64-bit hashes, and links verified on whole sets; used by the near-duplicate operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import small_side

#: Words whose hash a worker remembers (a cache only).
WORDS_KEPT = 50_000
#: Texts that are held as sets at a time.
SLICE = 500
#: Partners for which a set travels once.
BLOCK = 256

_ONE, _TWO = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


class Words(dict):
    """64-bit hash of each word, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _TWO
    x ^= x >> np.uint64(29)
    return x


def shingles(text: str | None, words: int, hashes: Words) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's ``words``-word shingles.

    A-Z are lower-cased and words are runs without ASCII white space.  A text
    of fewer words is one shingle, a null text or one without words has none.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, parts), np.uint64, len(parts))
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        out = mix((out ^ h[j:len(h) - n + 1 + j]) * _ONE)
    return np.unique(out)


def digest(shingle_set: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(shingle_set.tobytes())


def node_sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, set) of the ``nodes`` (node, doc_id, digest); the digest tells a node's text from others of its doc_id."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Words()
        for batch in batches:
            for start in range(0, len(batch), SLICE):
                part = batch[start:start + SLICE]
                sets = [shingles(t, words, hashes) for t in part["text"]]
                same = [digest(s) == d for s, d in zip(sets, part["digest"])]
                yield pd.DataFrame({"node": part["node"][same], "set": [s.tobytes() for s, yes in zip(sets, same) if yes]})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(small_side(nodes), "doc_id").select("node", "digest", "text").mapInPandas(run, "node long, set binary")
    return found.dropDuplicates(["node"])


def dealt(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` as rows (target = b, kind, node, what ``held`` says of the node), b itself (kind 0) before each a (kind 1).

    The pairs of one b are dealt out by ``BLOCK`` partners; b's row travels once
    with each block, the row of each a once with its pair.
    """
    salts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("salts"))
    asked = pairs.join(salts, "b").select(F.col("a").alias("node"), F.col("b").alias("target"),
                                          F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"))
    targets = salts.select(F.col("b").alias("node"), F.col("b").alias("target"),
                           F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"))
    return (asked.union(targets).join(held, "node").repartition("target", "salt")
            .sortWithinPartitions("target", "salt", "kind").drop("salt"))


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets have 100 * common >= percent * union."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        target, other = None, np.empty(0, np.uint64)
        for batch in batches:
            out = []
            for t, kind, node, raw in zip(batch["target"], batch["kind"], batch["node"], batch["set"]):
                s = np.frombuffer(raw, np.uint64)
                if kind == 0:
                    target, other = t, s.copy()
                elif t == target:
                    common = len(np.intersect1d(s, other, assume_unique=True))
                    if 100 * common >= percent * (len(s) + len(other) - common):
                        out.append((node, t))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return dealt(pairs, sets).select("target", "kind", "node", "set").mapInPandas(run, "a long, b long")
