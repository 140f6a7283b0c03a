"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.llm import (bpe, decontaminate, minhash, neighbours, pseudonyms, secrets, sharding, suffixes, toxicity,
                          wrappers)
from pairlens.llm.queries import word_bpe

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, shard int, size long, key long, node long, "
          "words string, place int, count int, batch long, bands string, digest string, score double, candidate string, "
          "before string, h string, t string")
LONG = "long words and more of them, number 17 is here. " * 4000
TEXTS = [(1, None), (2, ""), (3, "   \n\t "), (4, LONG), (4, LONG), (None, "no id"), (5, "tie"), (6, "tie"), (7, "x" * 5000),
         (8, "a"), (9, "\x00\x01é  token = \"0123456789abcdef0123456789abcdef01234567\""), (None, None)]


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(i, t, "en", "s", len(t or ""), 1, 2, 3, 4, "w", 5, 6, 7, "b", "d", 0.5, "c", "b", "h", "t") for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (2, 0), (4, 0), (5, 1), (None, 1), (7, None)], "doc_id long, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, LONG[:300], "x"), (2, None, "x"), (3, "", "x"), (None, "a b c d e f", "x")],
                                 "item_id long, text string, words string")


def runs(spark, labels, benchmark):
    model = toxicity.train(["you idiot " * 9, "kind words"] * 30, [1, 0] * 30).dump()
    forest = secrets.train(secrets.example_findings(spark, 600))
    return {
        "bpe": lambda d: bpe.digest_documents(d, word_bpe()),
        "bpe ids": lambda d: bpe.decode_ids(bpe.encode_documents(d, word_bpe()), word_bpe()),
        "suffixes": lambda d: suffixes.remove_repeats(d),
        "toxicity": lambda d: toxicity.score_documents(d, model),
        "pseudonyms": lambda d: pseudonyms.pseudonymise(d, b"k"),
        "sharding": lambda d: sharding.shard_documents(d, 3),
        "minhash": lambda d: minhash.near_duplicates(d, 2, 80),
        "leaks": lambda d: decontaminate.find_leaks(d, benchmark),
        "secrets": lambda d: secrets.find_secrets(d, forest),
        "redact": lambda d: secrets.redact(d, forest),
        "no leaks": lambda d: decontaminate.drop_leaks(d, benchmark),
        "no copies": lambda d: minhash.drop_near_duplicates(d),
        "no toxic": lambda d: toxicity.drop_toxic(d, model),
    }


def test_each_operator_takes_edge_rows_and_an_empty_table(spark, edges, labels, benchmark):
    kept = {"leaks": 1, "secrets": 1, "no leaks": len(TEXTS) - 2, "no copies": len(TEXTS) - 1, "no toxic": None}
    for name, run in runs(spark, labels, benchmark).items():
        rows = run(edges).collect()
        expected = kept.get(name, len(TEXTS))
        assert expected is None or len(rows) == expected, (name, len(rows))
        assert run(edges.limit(0)).collect() == [], name


def test_defined_results(spark, edges, labels, benchmark):
    by = lambda df: sorted(df.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    size = {r["doc_id"]: r["size"] for r in sharding.shard_documents(edges, 3).collect()}
    assert size[1] == size[2] == 8 and size[8] == 9
    cut = by(suffixes.remove_repeats(edges))
    both = [r for r in cut if r["doc_id"] == 4]
    assert {r["n_removed"] for r in both} >= {len(LONG)}  # the second copy goes whole
    assert max(r["n_removed"] for r in cut if r["doc_id"] == 7) == 4999 - 0 - 0 - 99 + 99
    near = {r["doc_id"]: r for r in minhash.near_duplicates(edges, 2, 80).collect()}
    assert near[6]["component_id"] == 5 and not near[6]["kept"] and near[5]["kept"]
    assert near[None]["component_id"] is None and near[1]["n_shingles"] == 0 and near[1]["kept"]
    flat = toxicity.fit(edges, labels.limit(0))
    assert len({r["score"] for r in toxicity.score_documents(edges, flat).collect()}) == 1
    assert toxicity.fit(edges, labels) is not None


def test_pages_and_vectors(spark):
    pages = spark.createDataFrame(
        [(1, None, None, "x"), (2, "http://a.example/", "", "x"), (None, "::", "<p>x", "x"), (4, "http://a.example/", "<p>y", "x"),
         (4, "http://a.example/", "<p>y", "x"), (5, "http://a.example/", "<article>" + "<p>w</p>" * 3000, "x")],
        "page_id long, url string, html string, wrapper string")
    got = wrappers.extract_pages(pages, wrappers.infer_wrappers(pages)).collect()
    assert len(got) == 6 and {r["page_id"]: r["text"] for r in got}[1] == ""
    assert {r["page_id"]: r["n_chars"] for r in got}[5] == 3000 * 2 - 1
    assert wrappers.extract_pages(pages.limit(0), wrappers.infer_wrappers(pages.limit(0))).collect() == []
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (50, [2.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, []), (7, [1.0, None]),
            (8, [float("nan"), 1.0]), (9, [float("inf"), 1.0]), (None, [1.0, 1.0]), (10, [1.0, 1.0, 1.0]), (11, [-1.0, 0.0]), (100, [0.0, 1.0])]
    vectors = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, shard int")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], round(r["score"], 9)) for r in neighbours.nearest(vectors, 50, 5).collect()}
    assert got[0, 1] == (3, 1.0) and got[0, 2] == (50, 1.0) and got[0, 3] == (100, 0.0) and got[0, 4] == (11, -1.0)
    assert (0, 5) not in got and got[50, 1] == (0, 1.0)
    assert neighbours.nearest(vectors.limit(0), 50, 5).collect() == []


def test_queries_go_to_their_shards_by_a_shuffle(spark, monkeypatch):
    """Queries times shards, far more than either, are not brought to the driver; every query meets every shard."""
    monkeypatch.setattr(neighbours, "SHARD_NODES", 25)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 4)
    x = np.random.default_rng(3).normal(size=(300, 8))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = neighbours.nearest(vectors, 20, 5)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in found.collect()}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 300, 20):
        s = unit @ unit[q]
        s[q] = -2
        assert [got[q, rank] for rank in range(1, 6)] == np.argsort(-s, kind="stable")[:5].tolist()
    assert len(got) == 15 * 5
