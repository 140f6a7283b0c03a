"""Vector and sequence metrics as Catalyst column expressions.

Every function maps Columns to a Column, so a whole feature row is one
projection evaluated inside the JVM.  Vectors are ``array<double>``; word
sequences are ``array<bigint>``.

Semantics kept from the reference (see README, "corner cases"):

* ``euclidean`` is ``(sum of squared differences) ** -2`` -- ``Infinity`` for
  identical vectors.  ``euclidean_l2`` is the usual distance.
* cosine of a zero vector is NaN (0/0), not an error.
* Jaccard numerator counts the *multiset* intersection, the denominator the
  *set* union, so the value can exceed 1; ``jaccard_set`` is the bounded one.
* two empty word lists give Jaccard NaN.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _nan() -> Column:
    return F.lit(float("nan"))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v)


def abs_diff(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x - y))


def dot(a, b) -> Column:
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def squared_norm(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda acc, v: acc + v * v)


def norm(a) -> Column:
    """L2 magnitude; compute once per question, not per pair."""
    return F.sqrt(squared_norm(a))


def cosine(a, b, norm_a=None, norm_b=None) -> Column:
    """Cosine similarity; NaN when either vector is all zeros."""
    na = _c(norm_a) if norm_a is not None else norm(a)
    nb = _c(norm_b) if norm_b is not None else norm(b)
    den = na * nb
    return F.when(den == 0, _nan()).otherwise(dot(a, b) / den)


def manhattan(a, b) -> Column:
    return _sum(abs_diff(a, b))


def chebyshev(a, b) -> Column:
    """Largest absolute component difference; NULL for empty vectors."""
    return F.array_max(abs_diff(a, b))


def squared_distance(a, b) -> Column:
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)))


def euclidean(a, b) -> Column:
    """The reference's "euclidean": (sum of squared differences) ** -2."""
    return F.pow(squared_distance(a, b), F.lit(-2.0))


def euclidean_l2(a, b) -> Column:
    return F.sqrt(squared_distance(a, b))


def occurrence_tags(word_ids, occurrences) -> Column:
    """Tag the k-th occurrence of word w as the string 'w:k'.

    ``occurrences`` is a parallel array holding k for each position.  Tags are
    unique within a question, so a hash-based set intersection of two tag
    arrays counts sum_w min(count_a(w), count_b(w)) -- the multiset
    intersection -- in linear time.  Strings keep the encoding exact for any
    id range.
    """
    return F.zip_with(_c(word_ids), _c(occurrences),
                      lambda w, k: F.concat(w.cast("string"), F.lit(":"), k.cast("string")))


def multiset_intersection_size(tags_a, tags_b) -> Column:
    return F.size(F.array_intersect(_c(tags_a), _c(tags_b)))


def union_size(a, b) -> Column:
    """Number of distinct ids in the concatenation of two lists (hash-based)."""
    return F.size(F.array_union(_c(a), _c(b)))


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den == 0, _nan()).otherwise(num.cast("double") / den)


def jaccard(words_a, words_b, tags_a, tags_b) -> Column:
    """Reference Jaccard: multiset intersection over set union."""
    return _ratio(multiset_intersection_size(tags_a, tags_b), union_size(words_a, words_b))


def jaccard_repeats(words_a, words_b, repeats_a, repeats_b, odd_a, odd_b) -> Column:
    """``jaccard`` by the distinct words (the first occurrences) and the second and later occurrences,
    of which some are numbers and the others texts (``vectors.word_multisets``)."""
    again = [F.greatest(multiset_intersection_size(a, b), F.lit(0)) for a, b in ((repeats_a, repeats_b), (odd_a, odd_b))]
    return _ratio(multiset_intersection_size(words_a, words_b) + again[0] + again[1], union_size(words_a, words_b))


#: Ids and occurrences that one number tells as ``word * 2^20 + k``.
REPEAT_BITS = 20


def repeats(words, counts) -> tuple[Column, Column]:
    """The second and later occurrences of words as numbers, and as texts 'word:k' where the id or count is too large (or the id negative)."""
    words = _c(words).cast("array<bigint>")

    def small(w, c):
        return (w >= 0) & (w < 1 << 63 - REPEAT_BITS) & (c < 1 << REPEAT_BITS)

    def again(keep, kind, tell):
        return F.flatten(F.zip_with(words, _c(counts), lambda w, c: F.when(
            (c > 1) & keep(w, c), F.transform(F.sequence(F.lit(2), c), lambda k: tell(w, k))).otherwise(F.array().cast(f"array<{kind}>"))))

    odd = F.exists(F.zip_with(words, _c(counts), lambda w, c: (c > 1) & ~small(w, c)), lambda x: x)
    return (again(small, "bigint", lambda w, k: F.shiftleft(w, REPEAT_BITS).bitwiseOR(k.cast("bigint"))),
            F.when(odd, again(lambda w, c: ~small(w, c), "string", lambda w, k: F.concat(w.cast("string"), F.lit(":"), k.cast("string"))))
            .otherwise(F.array().cast("array<string>")))


def jaccard_counts(words_a, words_b, counts_a, counts_b) -> Column:
    """``jaccard`` by the distinct words and how often each occurs; their repeats are made where the pair is."""
    (near_a, odd_a), (near_b, odd_b) = repeats(words_a, counts_a), repeats(words_b, counts_b)
    return jaccard_repeats(words_a, words_b, near_a, near_b, odd_a, odd_b)


def jaccard_set(words_a, words_b) -> Column:
    """Bounded set Jaccard |A n B| / |A u B|."""
    inter = F.size(F.array_intersect(_c(words_a), _c(words_b)))
    return _ratio(inter, union_size(words_a, words_b))


def length(words) -> Column:
    return F.size(_c(words))
