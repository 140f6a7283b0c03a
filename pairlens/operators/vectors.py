"""Per-question bag-of-words vectors and word-vector reduction.

``question_features`` turns ``question(qid, word_ids)`` and
``word_vec(wid, features)`` into one row per question carrying everything
the pair metrics need: the summed vector, its norm, the word sequence and
the occurrence tags used by the multiset Jaccard.

Sums do not depend on the order of addition.  A word vector is written as two
fixed-point integers per component (``fixed_point``), whose sums are exact, so
equal texts get bit-identical vectors on any partitioning and partial sums may
be merged in any order: no task ever holds a list of vectors.

Plan shape (the vectors come to the questions, sums are never shuffled in parts):

* words are counted per question first, so a word repeated in a text is
  looked up once and added as ``count * vector``;
* questions are dealt into groups of a bounded number of words.  The distinct
  words of each group, far fewer than its words, are joined to the vocabulary
  on ``wid``, and their vectors are sent to the group, which adds them up
  (``vector_sums``).  What is shuffled is the counts once and each vector once
  per group that has its word, not a row of sums per question and partition;
* the vocabulary is broadcast to that join only when rows x components x 16
  bytes, counted beforehand, stay under ``spark.sql.autoBroadcastJoinThreshold``.
  Beyond that both sides are shuffled on ``wid``; a word as frequent as ``the``
  has one row for each group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.functions import metrics as M
from pairlens.session import SCRATCH_CODEC

MISSING_MODES = ("zero", "truncate")


#: Bits of each of the two parts of a fixed-point component.
FIXED_BITS = 30
#: Words of the questions whose sums one task adds up at a time, and words whose vectors it holds as 64-bit numbers.
GROUP_WORDS, ADD_WORDS = 4_000_000, 16_384
#: Words of a group that is added up: most of the vectors go to every group, so there are no more groups than need be.
SUM_WORDS = 16_000_000
#: Words that are sorted at once when they are counted.
COUNT_WORDS = 1_000_000


@dataclass(frozen=True)
class VectorFacts:
    """What one pass over the word vectors tells: components, largest absolute value, rows, whether 32 bits hold every component."""

    dim: int
    largest: float
    rows: int
    single: bool = field(default=False, repr=False)

    @property
    def exponent(self) -> int:
        """The largest value is under 2 to this power."""
        return max(math.frexp(self.largest)[1], FIXED_BITS - 1000)

    @property
    def fixed_bytes(self) -> int:
        return self.rows * self.dim * 16


def vector_facts(word_vec: DataFrame, col: str = "features") -> VectorFacts:
    """Facts of the word vectors; fails if lengths differ, a component is not a finite number or there are none."""
    size = F.transform(col, lambda x: F.abs(x))
    odd = F.exists(col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    double = F.exists(col, lambda x: x.cast("float").cast("double") != x.cast("double"))
    low, high, largest, rows, n_odd, n_double = word_vec.agg(
        F.min(F.size(col)), F.max(F.size(col)), F.max(F.array_max(size)), F.count(F.lit(1)),
        F.sum((F.col(col).isNull() | odd).cast("long")), F.count_if(double)).first()
    if not rows:
        raise ValueError("word vector table is empty")
    if n_odd:
        raise ValueError(f"{n_odd} word vectors are missing or hold a component that is not a finite number")
    if low != high:
        raise ValueError(f"word vectors have {low} to {high} components")
    return VectorFacts(int(low), float(largest or 0.0), int(rows), not n_double)


def fixed_point(word_vec: DataFrame, facts: VectorFacts) -> DataFrame:
    """(wid, high, low): components as ``(high + low / 2^30) * 2^(exponent - 30)`` with whole ``high`` and ``low``.

    ``fixed_parts`` does the same with numpy where vectors are added.  Scaling by powers of two is exact and the remainder of rounding is exact, so
    a component is off by at most 2^-61 of the largest one's power of two, less
    than its own rounding unless it is 2^8 times smaller than the largest.  Sums
    of both parts fit 63 bits up to 2^33 words.
    """
    scale = 2.0 ** (FIXED_BITS - facts.exponent)
    one = word_vec.groupBy("wid").agg(F.min("features").alias("v"))  # a repeated id counts once
    return one.select(
        "wid",
        F.transform("v", lambda x: F.rint(x * scale).cast("int")).alias("high"),
        F.transform("v", lambda x: F.rint((x * scale - F.rint(x * scale)) * 2.0 ** FIXED_BITS).cast("int")).alias("low"))


def fixed_parts(values: np.ndarray, facts: VectorFacts) -> Iterator[np.ndarray]:
    """The two whole parts of ``fixed_point``, one after the other."""
    scaled = values * 2.0 ** (FIXED_BITS - facts.exponent)
    high = np.rint(scaled)
    yield high.astype(np.int64)
    yield np.rint((scaled - high) * 2.0 ** FIXED_BITS).astype(np.int64)


def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """-> (entries without nulls, the row of each) of a list column."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    entries, rows = lists.flatten(), np.repeat(np.arange(len(lists)), lengths)
    if entries.null_count:
        rows = rows[entries.is_valid().to_numpy(zero_copy_only=False)]
        entries = entries.drop_null()
    return entries.to_numpy(zero_copy_only=False), rows


def listed(entries: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(entries))


def shrunk(numbers: np.ndarray) -> np.ndarray:
    """The same whole numbers in as few bytes each as hold them all."""
    low, high = (numbers.min(), numbers.max()) if len(numbers) else (0, 0)
    return numbers.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def packed(rows: pa.RecordBatch) -> pa.Array:
    """One value that holds these rows, compressed."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression=SCRATCH_CODEC)) as stream:
        stream.write_batch(rows)
    return pa.array([out.getvalue().to_pybytes()], pa.binary())


def unpacked(value: bytes) -> pa.Table:
    return pa.ipc.open_stream(value).read_all().combine_chunks()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, questions) of (g, qid, word_ids): the distinct words of each row and how often each occurs.

    A row for each group in a batch, packed: qid, the distances between the distinct words, counts.
    """
    for batch in batches:
        lengths = pc.fill_null(pc.list_value_length(batch.column("word_ids")), 0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(lengths) // COUNT_WORDS
        ends = [*(np.flatnonzero(np.diff(piece)) + 1), len(lengths)] if len(lengths) else []
        start = 0
        for end in ends:
            part = batch.slice(start, end - start)
            ids, rows = flat(part.column("word_ids"))
            order = np.lexsort((ids, rows))
            ids, rows = ids[order], rows[order]
            new = np.ones(len(ids), bool)
            new[1:] = (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1])
            first = np.flatnonzero(new)
            sizes = np.bincount(rows[first], minlength=end - start)
            apart = np.diff(ids[first].astype(np.int64), prepend=0)
            starts = np.flatnonzero(np.diff(rows[first], prepend=-1))
            apart[starts] = ids[first][starts]
            counted = pa.RecordBatch.from_arrays(
                [part.column("g"), part.column("qid"), listed(shrunk(apart), sizes),
                 listed(shrunk(np.diff(np.append(first, len(ids)))), sizes)], ["g", "qid", "apart", "counts"])
            for of_group in by_group(counted):
                yield pa.RecordBatch.from_arrays([of_group.column("g")[:1], packed(of_group.drop_columns(["g"]))], ["g", "questions"])
            start = end


def by_group(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of each group ``g`` in a batch."""
    group = batch.column("g").to_numpy()
    order = np.argsort(group, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(group[order])) + 1) if len(order) else []:
        yield batch.take(pa.array(part))


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, wid) of (g, word_ids): the distinct words of each group in a partition.

    They are held as one array per group; beyond ``GROUP_WORDS`` of them what is held
    goes out, and a word that comes again is asked for again.
    """
    held: dict[int, pa.Array] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for g, words in held.items():
            words = words.drop_null()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), g, np.int32)), words], ["g", "wid"])
        held.clear()

    for batch in batches:
        for rows in by_group(batch):
            g, words = rows.column("g")[0].as_py(), rows.column("word_ids").flatten().unique()
            held[g] = pa.concat_arrays([held[g], words]).unique() if g in held else words
        if sum(map(len, held.values())) > GROUP_WORDS:
            yield from out()
    yield from out()


def _questions(value: pa.Scalar) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """-> (qid of each question, the question, id and count of each distinct word) of a packed row of ``_counted``."""
    table = unpacked(value.as_buffer())
    apart, row = flat(table["apart"].combine_chunks())
    along = np.cumsum(apart.astype(np.int64))
    start = np.flatnonzero(np.diff(row, prepend=-1))
    wids = along - np.repeat(along[start] - apart[start], np.diff(np.append(start, len(row))))
    return table["qid"].combine_chunks(), row, wids, flat(table["counts"].combine_chunks())[0].astype(np.int64)


def _added(facts: VectorFacts, lists: tuple[str, ...] = (), word_type: type = np.int64):
    """The sums of one group of questions: (counts of its questions, vectors of its words) -> sums and those word lists.

    Questions are unpacked and added up one packed row after the other.
    """
    dim, unit, small = facts.dim, 2.0 ** (facts.exponent - FIXED_BITS), 2.0 ** -FIXED_BITS

    def add(questions: pa.Table, vectors: pa.Table) -> pa.Table:
        known_ids = vectors["wid"].to_numpy()
        order = np.argsort(known_ids)
        vector = vectors["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        return pa.concat_tables(some(*_questions(value), known_ids, order, vector) for value in questions["questions"])

    def some(qids, rows, wids, counts, known_ids, order, vector) -> pa.Table:
        n = len(qids)
        at = np.searchsorted(known_ids, wids, sorter=order)
        known = at < len(order)
        known[known] = known_ids[order[at[known]]] == wids[known]
        used, place = np.unique(order[at[known]], return_inverse=True)
        row, count = rows[known], counts[known]
        sums = []
        for values in fixed_parts(vector[used].astype(np.float64), facts):
            total = np.zeros((n, dim), np.int64)
            for i in range(0, len(place) if values.any() else 0, ADD_WORDS):
                here = row[i:i + ADD_WORDS]
                first = np.flatnonzero(np.append(True, here[1:] != here[:-1]))
                total[here[first]] += np.add.reduceat(values[place[i:i + ADD_WORDS]] * count[i:i + ADD_WORDS, None], first, axis=0)
            sums.append(total.astype(np.float64))
        n_words, n_known = (np.zeros(n, np.int64) for _ in range(2))
        np.add.at(n_words, rows, counts)
        np.add.at(n_known, row, count)
        features = (sums[0] + sums[1] * small) * unit
        out = {"qid": qids, "features": listed(features.ravel(), np.full(n, dim)), "n_words": n_words, "n_missing": n_words - n_known}
        sizes = np.bincount(rows, minlength=n)
        if "words" in lists:
            out["words"] = listed(wids.astype(word_type), sizes)
        if "counts" in lists:
            out["counts"] = listed(counts.astype(np.int32), sizes)
        if "repeats" in lists or "odd_repeats" in lists:
            again = counts - 1
            k = np.arange(again.sum()) - np.repeat(np.cumsum(again) - again, again) + 2
            near, odd = _repeats(np.repeat(wids, again), k, np.repeat(rows, again), n)
            out |= {c: x for c, x in (("repeats", near), ("odd_repeats", odd)) if c in lists}
        return pa.table(out)

    return add


def vector_sums(q: DataFrame, word_vec: DataFrame, facts: VectorFacts, lists: tuple[str, ...] = ()) -> DataFrame:
    """(qid, features, n_words, n_missing) of (qid, word_ids): the exact sum of the vectors of each question's words.

    ``lists``: and these columns of ``word_multisets``, which the counts of its words tell.
    The rows of a group (``group_of``) come from one task.

    A vector is sent once to each group that has its word (again where a group's words
    come from several partitions or are too many to hold), as 32-bit numbers where these
    hold it exactly.
    """
    spark = q.sparkSession
    words, rows, low, high = q.agg(F.sum(F.greatest(F.size("word_ids"), F.lit(0)).cast("bigint")), F.count(F.lit(1)),
                                   F.min(F.array_min("word_ids")), F.max(F.array_max("word_ids"))).first()
    dealt = q.select(sum_group("qid", q, (words or 0) + rows * facts.dim).alias("g"), "qid", F.col("word_ids").cast("array<bigint>").alias("word_ids"))
    vectors = word_vec.groupBy("wid").agg(F.min("features").cast("array<float>" if facts.single else "array<double>").alias("v"))
    limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    asked = dealt.select("g", "word_ids").mapInArrow(_asked, "g int, wid bigint").select("wid", "g")
    if facts.fixed_bytes <= limit:
        vectors = F.broadcast(vectors)
    else:  # made distinct where they meet the vectors, since a group may come from several partitions
        asked = asked.repartition("wid").distinct()
    sent = asked.join(vectors, "wid").select("g", "wid", "v")
    qid = q.schema["qid"].dataType.simpleString()
    counted = dealt.mapInArrow(_counted, "g int, questions binary")
    # Word ids are sent to every pair: as 32-bit numbers where these hold them all and no repeats, made of them, are asked for.
    narrow = "counts" in lists and "repeats" not in lists and -2**31 <= (low or 0) and (high or 0) < 2**31
    types = {"words": "int" if narrow else "bigint", "counts": "int", "repeats": "bigint", "odd_repeats": "string"}
    lists = tuple(c for c in types if c in lists)
    more = "".join(f", {c} array<{types[c]}>" for c in lists)
    return counted.groupBy("g").cogroup(sent.groupBy("g")).applyInArrow(
        _added(facts, lists, np.int32 if narrow else np.int64), f"qid {qid}, features array<double>, n_words bigint, n_missing bigint{more}")


def group_count(df: DataFrame, words: int) -> int:
    """Groups of at most about ``GROUP_WORDS`` words: a multiple of the partitions of a shuffle."""
    n = shuffle_partitions(df)
    return n * max(1, -(-words // (GROUP_WORDS * n)))


def sum_group(key: str, df: DataFrame, words: int) -> Column:
    """The group of a row among groups of at most about ``SUM_WORDS`` words, and enough of them for all cores.

    A group holds whole partitions, or a partition (``group_of``) whole groups.
    """
    n = shuffle_partitions(df)
    wanted = -(-words // SUM_WORDS)
    if wanted >= n:
        return group_of(key, n * -(-wanted // n))
    return F.pmod(group_of(key, n), F.lit(max(wanted, min(n, 2 * df.sparkSession.sparkContext.defaultParallelism)))).cast("int")


def group_of(key: str, groups: int) -> Column:
    """The group of a row by the hash that deals out shuffle partitions and buckets.

    Where rows are laid out by ``key``, each partition therefore holds whole groups,
    and what a group has is made distinct before anything is shuffled.
    """
    return F.pmod(F.hash(key), F.lit(groups)).cast("int")


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def by_question(question: DataFrame, partitions: int | None = None) -> DataFrame:
    """(qid, word_ids), one row per question; a repeated id keeps its smallest word list.

    Questions that are laid out by qid are grouped in place; every later grouping on
    qid (and the pair join on q1) reuses this partitioning instead of shuffling again.
    ``partitions`` asks for a shuffle into that many.
    """
    rows = question.select("qid", "word_ids")
    return (rows.repartition(partitions, "qid") if partitions else rows).groupBy("qid").agg(F.min("word_ids").alias("word_ids"))


def word_counts(q: DataFrame) -> DataFrame:
    """(qid, wid, c): how often each word occurs in each question.

    Runs inside the qid partitions (no shuffle) and shrinks repeated words
    before the vocabulary join.  A question without words keeps one row with
    NULL wid and c = 0, so it is not lost.
    """
    return (q.select("qid", F.explode_outer("word_ids").alias("wid"))
             .groupBy("qid", "wid").agg(F.count("wid").alias("c")))


def distinct_words(q: DataFrame) -> DataFrame:
    """(qid, words): the sorted distinct word ids, row by row."""
    words = F.array_sort(F.array_distinct(F.array_compact("word_ids")))
    return q.select("qid", F.coalesce(words, F.array().cast(q.schema["word_ids"].dataType)).alias("words"))


def word_lists(counts: DataFrame) -> DataFrame:
    """(qid, words, tags) of (qid, wid, c): the sorted distinct word ids, and 'w:1'..'w:c' for a word occurring c times.

    The list of a question is bounded by its distinct words and holds no vectors.
    """
    listed = counts.groupBy("qid").agg(F.array_sort(F.collect_list(
        F.when(F.col("wid").isNotNull(), F.struct("wid", "c")))).alias("_wc"))
    tags = F.flatten(F.transform("_wc", lambda s: F.transform(
        F.sequence(F.lit(1).cast("bigint"), s["c"]),
        lambda j: F.concat(s["wid"].cast("string"), F.lit(":"), j.cast("string")))))
    return listed.select("qid", F.transform("_wc", lambda s: s["wid"]).alias("words"), tags.alias("tags"))


def _repeats(ids: np.ndarray, k: np.ndarray, rows: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
    """The k-th occurrences of words in ``n`` rows as lists of numbers ``word * 2^20 + k``.

    Where an id or k is too large (or an id negative) for that it is the text 'word:k' in the second list.
    """
    small = (ids >= 0) & (ids < 1 << 63 - M.REPEAT_BITS) & (k < 1 << M.REPEAT_BITS)
    odd = ~small
    texts = pc.binary_join_element_wise(pa.array(ids[odd]).cast(pa.string()), pa.array(k[odd]).cast(pa.string()), ":")
    return (listed((ids[small] << M.REPEAT_BITS) | k[small], np.bincount(rows[small], minlength=n)),
            listed(texts, np.bincount(rows[odd], minlength=n)))


def _multisets(word_ids: pa.Array) -> pa.Array:
    """Row by row: the sorted distinct words, how often each occurs, and the second and later occurrences of words (``_repeats``)."""
    ids, rows = flat(word_ids)
    n = len(word_ids)
    order = np.lexsort((ids, rows))
    ids, rows = ids[order].astype(np.int64), rows[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(new)
    k = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids)))) + 1
    sizes = np.bincount(rows[new], minlength=n)
    counts = np.diff(np.append(first, len(ids))).astype(np.int32)
    return pa.StructArray.from_arrays(
        [listed(ids[new], sizes), listed(counts, sizes), *_repeats(ids[~new], k[~new], rows[~new], n)], ["words", *_REPEATS])


def word_multisets(q: DataFrame) -> DataFrame:
    """(qid, words, counts, repeats, odd_repeats) of (qid, word_ids), row by row, so that rows stay where they are (``_multisets``)."""
    multisets = F.arrow_udf(_multisets, "words array<bigint>, counts array<int>, repeats array<bigint>, odd_repeats array<string>")
    return q.select("qid", multisets(F.col("word_ids").cast("array<bigint>")).alias("_m")).select(
        "qid", *[F.col(f"_m.{c}").alias(c) for c in ("words", *_REPEATS)])


#: Columns of ``question_features`` by where they come from.
_FROM_LISTS, _FROM_SUMS = ("words", "tags"), ("features", "n_words", "n_missing", "norm")
_REPEATS = ("counts", "repeats", "odd_repeats")


def question_features(question: DataFrame, word_vec: DataFrame, *, missing: str = "zero",
                      facts: VectorFacts | None = None, partitions: int | None = None,
                      sequence: bool = False, columns: list[str] | None = None) -> DataFrame:
    """One row per question:
    qid, words, tags, features (array<double>), n_words, n_missing, norm
    [, word_ids when ``sequence``], or only qid and those of ``columns``.

    ``words`` is the sorted list of distinct word ids and ``tags`` holds
    'w:1'..'w:c' for a word occurring c times (see
    ``metrics.multiset_intersection_size``).  ``repeats`` and ``odd_repeats``, only on
    request, tell the second and later occurrences alone; ``counts``, only on request,
    tells how often each of ``words`` occurs.  They are made row by row or with the sums,
    and ``words`` with ``counts`` say as much as ``tags`` in the least room, so the pair
    metrics read them.  The ordered ``word_ids`` (edit distance) are joined back only on
    request.  Parts that ``columns`` does not name are not computed.

    ``missing='zero'``: a word without a vector adds nothing; a question with
    no such word (or no word) gets the zero vector.
    ``missing='truncate'``: reproduce the reference, where one missing word
    truncates the whole sum to its first component.

    Equal word multisets give bit-identical vectors whatever the partitioning
    (exact sums); the reference's "euclidean" of two identical questions is then
    Infinity, as there.
    """
    if missing not in MISSING_MODES:
        raise ValueError(f"missing must be one of {MISSING_MODES}")
    wanted = [c for c in (columns or [*_FROM_LISTS, *_FROM_SUMS]) if c not in ("qid", "word_ids")]
    q = by_question(question, partitions)
    parts = []
    if sequence:
        parts.append(q)
    repeats, sums_wanted = (any(c in names for c in wanted) for names in (_REPEATS, _FROM_SUMS))
    with_sums = repeats and sums_wanted and "tags" not in wanted  # word lists come with the sums, not joined to them
    if "tags" in wanted:
        lists = word_lists(word_counts(q))
        parts.append(lists.drop("words") if repeats else lists)
    if repeats and not with_sums:
        parts.append(word_multisets(q))
    elif "words" in wanted and "tags" not in wanted and not with_sums:
        parts.append(distinct_words(q))
    if sums_wanted:
        sums = vector_sums(q, word_vec, facts or vector_facts(word_vec),
                           tuple(c for c in wanted if c in ("words", *_REPEATS)) if with_sums else ())
        if with_sums:
            sums = sums.where(F.col("qid").isNotNull())
        if missing == "truncate":
            sums = sums.withColumn("features", F.when(F.col("n_missing") > 0, F.slice("features", 1, 1)).otherwise(F.col("features")))
        parts.append(sums.withColumn("norm", M.norm("features")))
    out = parts[0] if parts else q.select("qid")
    for part in parts[1:]:
        out = out.join(part, "qid")
    return out.select("qid", *(["word_ids"] if sequence else []), *wanted)


def in_groups(columns: list[str], sequence: bool = False) -> bool:
    """Whether ``question_features`` gives these columns in whole groups (``group_of``), for ``lay_out``."""
    lists = [c for c in columns if c in (*_FROM_LISTS, *_REPEATS)]
    return (any(c in _FROM_SUMS for c in columns) and not sequence and "tags" not in columns
            and (not lists or any(c in _REPEATS for c in lists)))


def fit_basis(word_vec: DataFrame, k: int) -> PCAModel:
    """The first ``k`` principal components of the word vectors.

    The covariance is aggregated on executors; only the d x d eigen-problem runs
    on the driver.
    """
    return PCA(k=k, inputCol="_v", outputCol="_pc").fit(word_vec.select(array_to_vector("features").alias("_v")))


def project(word_vec: DataFrame, basis: PCAModel) -> DataFrame:
    """(wid, features) on the basis.

    Spark's PCA projects without centring, so reducing the word vectors and
    then summing per question equals summing then reducing; reducing first
    is cheaper.
    """
    src = word_vec.select("wid", array_to_vector("features").alias("_v"))
    return basis.transform(src).select("wid", vector_to_array("_pc").alias("features"))


def reduce_word_vectors(word_vec: DataFrame, k: int) -> tuple[DataFrame, PCAModel]:
    """PCA of the word vectors to ``k`` components -> (wid, features), basis."""
    basis = fit_basis(word_vec, k)
    return project(word_vec, basis), basis


def question_vector_rows(qf: DataFrame) -> DataFrame:
    """Flatten to (qid, dim, value): one scalar row per vector component."""
    return (qf.select("qid", F.posexplode("features").alias("dim", "value"))
              .withColumn("dim", F.col("dim").cast("bigint")))
