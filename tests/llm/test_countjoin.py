"""The similarity join against all pairs."""
import random

import numpy as np
import pytest

from pairlens.llm import countjoin
from pairlens.llm.common import table
from pairlens.llm.queries import op11_countjoin

SMALL = "/root/testdata/sf0.001"


def shingle_set(text, words):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    parts = low.split(" ") if " " in low else [low]
    parts = [w for p in parts for w in p.replace("\t", "\n").replace("\r", "\n").replace("\v", "\n").replace("\f", "\n").split("\n") if w]
    n = min(words, len(parts))
    return {tuple(parts[i:i + n]) for i in range(len(parts) - n + 1)} if parts else set()


def by_hand(rows, words, percent):
    """(doc_id, n_shingles, component_id) of every row, in any order."""
    sets = [shingle_set(t, words) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None:
                common = len(a & b)
                if 100 * common >= percent * (len(a) + len(b) - common):
                    label[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_linked_sets_share_a_cell_and_the_bound_holds():
    rng = np.random.default_rng(3)
    for percent in (60, 90):
        classes = countjoin.Classes(percent)
        for _ in range(300):
            n = int(rng.integers(2, 400))
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            t = len(a) * (100 - percent) // percent
            gone = int(rng.integers(0, t + 1))
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**63, int(rng.integers(0, t - gone + 1)), dtype=np.uint64)]))
            common = len(np.intersect1d(a, b))
            p, q = countjoin._points([countjoin.point(a)])[0], countjoin._points([countjoin.point(b)])[0]
            assert np.minimum(p, q).sum() >= common
            if common < len(a) and len(b) and 100 * common >= percent * (len(a) + len(b) - common):
                assert set(countjoin.cells(a, classes).tolist()) & set(countjoin.cells(b, classes).tolist())


def test_query_equals_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()]
    assert got(op11_countjoin(spark, SMALL)) == by_hand(rows, 3, 90)


def test_families_of_near_copies_through_several_levels(spark, monkeypatch):
    """A family whose members often miss the threshold: the tree has leaves of three and several levels."""
    monkeypatch.setattr(countjoin, "LEAF", 3)
    monkeypatch.setattr(countjoin, "FANOUT", 3)
    rnd = random.Random(4)
    line = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(70):
        words = list(line)
        for at in rnd.sample(range(60), rnd.randint(0, 3)):
            words[at] = f"x{rnd.randint(0, 40)}"
        rows.append((i, " ".join(words)))
    expected = by_hand(rows, 3, 90)
    assert 1 < len({c for *_, c in expected}) < 70
    df = spark.createDataFrame(rows, "doc_id long, text string")
    entries = []
    real = countjoin.tree_join

    def watched(e, percent):
        entries.append(e.groupBy("key").count().agg({"count": "max"}).first()[0])
        return real(e, percent)

    monkeypatch.setattr(countjoin, "tree_join", watched)
    assert got(countjoin.similarity_join(df, 3, 90)) == expected
    assert entries[0] > 9  # more than one level of boxes over the leaves of a cell


def test_edge_rows(spark):
    long = "long words and more of them, number 17 is here. " * 4000
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, long), (4, long), (5, long + " end"), (None, long), (6, "a B"), (7, "A b"),
            (8, "a"), (9, "a b"), (10, "x" * 50_000), (11, " ".join(f"w{i}" for i in range(30))),
            (12, " ".join(f"w{i}" for i in range(31))), (11, "a quite different text of its own")]
    wide = [(i, t, 1, 2, "c", 3, "p") for i, t in rows]
    df = spark.createDataFrame(wide, "doc_id long, text string, node long, size long, cells string, key long, point string")
    assert got(countjoin.similarity_join(df)) == by_hand(rows, 3, 90)
    assert countjoin.similarity_join(df.limit(0)).collect() == []
    assert got(countjoin.similarity_join(df.where("text is null"))) == [(1, 0, 1)]


def test_sets_are_read_only_for_nodes_that_points_do_not_rule_out(spark, monkeypatch):
    """Texts with half of their words in common meet in cells; only near copies and what they are compared with are read again."""
    rnd = random.Random(8)
    line = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(line[:20 + i % 3] + [f"y{rnd.randint(0, 10**6)}" for _ in range(15)])) for i in range(60)]
    rows += [(100 + i, " ".join([f"z{i}"] + [f"v{j}" for j in range(60)])) for i in range(3)]
    rows += [(100, rows[-3][1]), (101, rows[-2][1]), (200, rows[0][1])]  # copies
    read, real = [], countjoin.node_sets

    def watched(docs, nodes, words):
        read.extend(r.doc_id for r in nodes.collect())
        return real(docs, nodes, words)

    monkeypatch.setattr(countjoin, "node_sets", watched)
    # Every pair meets: a cell for all.
    monkeypatch.setattr(countjoin, "cells", lambda s, classes: np.array([7], np.int64))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(countjoin.similarity_join(df)) == by_hand(rows, 3, 90)
    assert set(read) >= {100, 101, 102} and len(read) == len(set(read)) and len(read) < 10


def test_near_pairs_keeps_what_points_allow(spark):
    rng = np.random.default_rng(5)
    a = np.unique(rng.integers(0, 2**63, 200, dtype=np.uint64))
    sets = [a, a[6:], np.unique(rng.integers(0, 2**63, 200, dtype=np.uint64)), a[:120]]
    nodes = spark.createDataFrame([(i, len(s), bytearray(countjoin.point(s))) for i, s in enumerate(sets)], "node long, size long, point binary")
    pairs = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (3, 1)], "a long, b long")
    assert [tuple(r) for r in countjoin.near_pairs(pairs, nodes, 90).collect()] == [(1, 0)]
    assert countjoin.near_pairs(pairs.limit(0), nodes, 90).collect() == []
