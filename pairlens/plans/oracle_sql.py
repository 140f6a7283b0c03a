"""Independent DuckDB formulations of the derived tables and metrics.

These are the correctness oracle: plain SQL over the same parquet tables,
written without the Spark code paths (vectors are exploded per dimension
and summed with GROUP BY, Jaccard uses list functions, the vocabulary rank
is an ordinary window).  ``with_ctes`` pulls in the named CTEs together with
everything they depend on.
"""

from __future__ import annotations

# name -> (dependencies, body)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "doc_words": ((), """
        SELECT doc_id, regexp_extract_all(lower(text), '\\p{L}+') AS ws FROM documents"""),
    "tok": (("doc_words",), """
        SELECT doc_id AS qid, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM doc_words"""),
    "voc": (("tok",), """
        SELECT w, n, row_number() OVER (ORDER BY n DESC, w) - 1 AS wid
        FROM (SELECT w, count(*) AS n FROM tok GROUP BY w) c"""),
    "tokv": (("tok", "voc"), """
        SELECT t.qid, t.pos, v.wid,
               row_number() OVER (PARTITION BY t.qid, v.wid ORDER BY t.pos) AS occ
        FROM tok t JOIN voc v ON v.w = t.w"""),
    "question": (("tokv",), """
        SELECT d.doc_id AS qid,
               coalesce(q.word_ids, []::BIGINT[]) AS word_ids,
               coalesce(q.tags, []::VARCHAR[]) AS tags
        FROM documents d LEFT JOIN (
            SELECT qid, list(wid ORDER BY pos) AS word_ids,
                   list(wid::VARCHAR || ':' || occ::VARCHAR) AS tags
            FROM tokv GROUP BY qid) q ON q.qid = d.doc_id"""),
    "word_vec": ((), """
        SELECT vec_id AS wid, embedding::DOUBLE[] AS features FROM embeddings"""),
    "wv": (("word_vec",), """
        SELECT wid, unnest(features) AS x, generate_subscripts(features, 1) - 1 AS dim FROM word_vec"""),
    "dims": (("wv",), "SELECT DISTINCT dim FROM wv"),
    "qmiss": (("question", "tokv", "word_vec"), """
        SELECT q.qid, len(q.word_ids) AS n_words, coalesce(m.n_missing, 0) AS n_missing
        FROM question q LEFT JOIN (
            SELECT t.qid, count(*) AS n_missing
            FROM tokv t LEFT JOIN word_vec v ON v.wid = t.wid
            WHERE v.wid IS NULL GROUP BY t.qid) m ON m.qid = q.qid"""),
    "qsum": (("tokv", "wv"), """
        SELECT t.qid, wv.dim, sum(wv.x) AS value FROM tokv t JOIN wv ON wv.wid = t.wid
        GROUP BY t.qid, wv.dim"""),
    "qvec": (("question", "dims", "qsum"), """
        SELECT q.qid, d.dim, coalesce(s.value, 0.0) AS value
        FROM question q JOIN dims d ON TRUE
        LEFT JOIN qsum s ON s.qid = q.qid AND s.dim = d.dim"""),
    "doc_keys": (("doc_words",), """
        SELECT doc_id, md5(array_to_string(ws, ' ')) AS key, len(ws) AS n_words FROM doc_words"""),
    "firsts": (("doc_keys",), """
        SELECT key, min(doc_id) AS q1 FROM doc_keys WHERE n_words > 0 GROUP BY key"""),
    "copies": (("doc_keys", "firsts"), """
        SELECT f.q1, k.doc_id AS q2 FROM doc_keys k JOIN firsts f ON f.key = k.key
        WHERE k.n_words > 0 AND k.doc_id <> f.q1"""),
    "apart": (("doc_keys",), """
        SELECT CASE WHEN a.doc_id % 37 = 0 THEN 1 ELSE 0 END AS label, a.doc_id AS q1, b.doc_id AS q2
        FROM doc_keys a JOIN doc_keys b ON b.doc_id = a.doc_id + 1
        WHERE a.key <> b.key"""),
    "train_pair": (("copies", "apart", "doc_keys"), """
        SELECT 1 AS label, q1, q2 FROM copies
        UNION ALL SELECT 1, q2, q1 FROM copies WHERE q2 % 5 = 0
        UNION ALL SELECT 1, doc_id, doc_id FROM doc_keys WHERE doc_id % 50 = 0
        UNION ALL SELECT label, q1, q2 FROM apart
        UNION ALL SELECT 1 - label, q1, q2 FROM apart WHERE q1 % 7 = 0"""),
    "pair": (("train_pair",), """
        SELECT q1, q2, min(label) AS label FROM train_pair GROUP BY q1, q2"""),
    "asked": (("pair",), """
        SELECT q1, q2 FROM pair UNION ALL SELECT q1, -1 - q2 FROM pair WHERE q1 % 40 = 0
        UNION ALL SELECT -1 - q1, q2 FROM pair WHERE q1 % 40 = 0"""),
    "test_pair": ((), """
        SELECT a.doc_id AS q1, b.doc_id AS q2, a.doc_id AS row_no
        FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 2"""),
    "pvec": (("pair", "qvec"), """
        SELECT p.q1, p.q2, p.label,
               sum(a.value * b.value) AS dot,
               sqrt(sum(a.value * a.value)) AS norm1,
               sqrt(sum(b.value * b.value)) AS norm2,
               max(abs(a.value - b.value)) AS chebyshev,
               sum(abs(a.value - b.value)) AS manhattan,
               sum((a.value - b.value) * (a.value - b.value)) AS ssd
        FROM pair p JOIN qvec a ON a.qid = p.q1
        JOIN qvec b ON b.qid = p.q2 AND b.dim = a.dim
        GROUP BY p.q1, p.q2, p.label"""),
    "pmetric": (("pvec",), """
        SELECT q1, q2, label, dot, norm1, norm2, chebyshev, manhattan, ssd,
               CASE WHEN norm1 * norm2 = 0 THEN 'nan'::DOUBLE ELSE dot / (norm1 * norm2) END AS cosine,
               CASE WHEN ssd = 0 THEN 'inf'::DOUBLE ELSE pow(ssd, -2.0) END AS euclidean,
               sqrt(ssd) AS euclidean_l2
        FROM pvec"""),
    "pwords": (("pair", "question"), """
        SELECT p.q1, p.q2, p.label,
               len(a.word_ids) AS q1_length, len(b.word_ids) AS q2_length,
               len(list_intersect(a.tags, b.tags)) AS inter_multi,
               len(list_intersect(a.word_ids, b.word_ids)) AS inter_set,
               len(list_distinct(list_concat(a.word_ids, b.word_ids))) AS union_size
        FROM pair p JOIN question a ON a.qid = p.q1 JOIN question b ON b.qid = p.q2"""),
    "pjac": (("pwords",), """
        SELECT q1, q2, label, q1_length, q2_length,
               CASE WHEN union_size = 0 THEN 'nan'::DOUBLE ELSE inter_multi / union_size END AS jaccard,
               CASE WHEN union_size = 0 THEN 'nan'::DOUBLE ELSE inter_set / union_size END AS jaccard_set
        FROM pwords"""),
    # Deterministic scorer used to check the evaluation and output operators
    # without a trained model: p1 = logistic(10 * jaccard_set - 5).
    "scored": (("pjac",), """
        SELECT q1, q2, label,
               1.0 / (1.0 + exp(-(10.0 * coalesce(nullif(jaccard_set, 'nan'::DOUBLE), 0.0) - 5.0))) AS p1
        FROM pjac"""),
    "scored_pred": (("scored",), """
        SELECT q1, q2, label, p1, 1.0 - p1 AS p0,
               CASE WHEN p1 > 0.5 THEN 1 ELSE 0 END AS prediction
        FROM scored"""),
    "test_scored": (("test_pair", "question"), """
        SELECT q1, q2, row_no, p1, 1.0 - p1 AS p0, CASE WHEN p1 > 0.5 THEN 1 ELSE 0 END AS prediction
        FROM (
            SELECT t.q1, t.q2, t.row_no,
                   1.0 / (1.0 + exp(-(10.0 * CASE
                       WHEN len(list_distinct(list_concat(a.word_ids, b.word_ids))) = 0 THEN 0.0
                       ELSE len(list_intersect(a.word_ids, b.word_ids))
                            / len(list_distinct(list_concat(a.word_ids, b.word_ids))) END - 5.0))) AS p1
            FROM test_pair t JOIN question a ON a.qid = t.q1 JOIN question b ON b.qid = t.q2) s"""),
    "auc_counts": (("scored",), """
        SELECT p1, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
               sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS neg
        FROM scored GROUP BY p1"""),
    "auc_value": (("auc_counts",), """
        SELECT sum(pos * (below + 0.5 * neg)) / nullif(sum(pos) * sum(neg), 0) AS auc,
               sum(pos) AS n_pos, sum(neg) AS n_neg
        FROM (SELECT p1, pos, neg,
                     sum(neg) OVER (ORDER BY p1 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - neg AS below
              FROM auc_counts) c"""),
}


#: The edit distance of every pair, one anti-diagonal of its table at a time (the cells of a diagonal do not
#: depend on each other): k is the diagonal, place i of a list the cell of i symbols of the shorter text.
EDIT_DISTANCE = """,
texts AS MATERIALIZED (
    SELECT p.q1, p.q2, p.label, CASE WHEN len(a.word_ids) <= len(b.word_ids) THEN a.word_ids ELSE b.word_ids END AS s,
           CASE WHEN len(a.word_ids) <= len(b.word_ids) THEN b.word_ids ELSE a.word_ids END AS l
    FROM pair p JOIN question a ON a.qid = p.q1 JOIN question b ON b.qid = p.q2),
diagonal(q1, q2, k, cur, prev) USING KEY (q1, q2) AS (
    SELECT q1, q2, 0, [0]::INTEGER[], []::INTEGER[] FROM texts WHERE s <> l AND len(s) > 0
    UNION ALL
    SELECT d.q1, d.q2, d.k + 1, list_transform(range(0, least(len(t.s), d.k + 1) + 1), lambda i: CASE
               WHEN d.k + 1 - i > len(t.l) THEN 1000000000
               WHEN i = 0 THEN d.k + 1 WHEN i = d.k + 1 THEN i
               ELSE least(coalesce(d.cur[i], 1000000000) + 1, coalesce(d.cur[i + 1], 1000000000) + 1,
                          d.prev[i] + CASE WHEN t.s[i] = t.l[d.k + 1 - i] THEN 0 ELSE 1 END) END), d.cur
    FROM diagonal d JOIN texts t ON t.q1 = d.q1 AND t.q2 = d.q2 WHERE d.k < len(t.s) + len(t.l))
SELECT t.q1, t.q2, t.label, CASE WHEN t.s = t.l THEN 0 WHEN len(t.s) = 0 THEN len(t.l) ELSE d.cur[len(t.s) + 1] END::DOUBLE AS edit_distance
FROM texts t LEFT JOIN diagonal d ON d.q1 = t.q1 AND d.q2 = t.q2"""


def recursive(tail: str, *needs: str) -> str:
    """The CTEs in ``needs`` with ``tail`` (more CTEs, some recursive, and the query) after them."""
    return with_ctes("SELECT 1", *needs).replace("WITH ", "WITH RECURSIVE ", 1).rsplit("SELECT 1", 1)[0].rstrip() + tail


def with_ctes(body: str, *needs: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        deps, _ = CTES[name]
        for d in deps:
            visit(d)
        order.append(name)

    for n in needs:
        visit(n)
    if not order:
        return body.strip()
    parts = ",\n".join(f"{n} AS ({CTES[n][1].rstrip()}\n)" for n in order)
    return f"WITH {parts}\n{body.strip()}"


def r6(expr: str) -> str:
    """Round a finite double to 6 decimals; NaN and infinities become NULL."""
    return f"CASE WHEN isfinite({expr}) THEN round({expr}, 6) END"


def kind(expr: str) -> str:
    return (f"CASE WHEN {expr} IS NULL THEN 'null' WHEN isnan({expr}) THEN 'nan' "
            f"WHEN {expr} = 'inf'::DOUBLE THEN '+inf' WHEN {expr} = '-inf'::DOUBLE THEN '-inf' "
            f"ELSE 'finite' END")
