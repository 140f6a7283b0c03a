"""Levenshtein distance over word-id sequences (unit costs).

Spark's ``levenshtein`` works on strings only, and a dynamic programme by
higher-order functions copies its row for every cell, which is cubic on whole
texts.  Both forms here use the bit-parallel method of Myers (1999) in Hyyro's
formulation, answer equal texts at once and have no length cap:

* ``edit_distance`` is an Arrow-batched pandas UDF: one Python integer holds one
  bit per symbol of the shorter sequence, so a step over all of it is a few
  operations of the interpreter's big numbers;
* ``edit_distance_jvm`` is a column expression without Python workers: the shorter
  sequence is cut into blocks of 62 symbols whose vertical differences are the bits
  of two longs; a block walks over the whole longer sequence and leaves the
  horizontal differences of its last row, again as bits, to the next block.  A
  step costs several microseconds of interpreted lambdas (about sixty times the
  other form for texts of 1,500 words), so it is for plans that must stay in the
  JVM and for short texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Symbols of a block: its sums must not reach the sign of a long.
BITS = 62


def levenshtein_ids(a, b) -> int:
    a = [] if a is None else list(a)
    b = [] if b is None else list(b)
    if len(a) < len(b):
        a, b = b, a
    m = len(b)
    if m == 0:
        return len(a)
    peq: dict = {}
    for i, sym in enumerate(b):
        peq[sym] = peq.get(sym, 0) | (1 << i)
    full = (1 << m) - 1
    top = 1 << (m - 1)
    pv, mv, score = full, 0, m
    for sym in a:
        eq = peq.get(sym, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ((ph << 1) | 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
    return score


def levenshtein_dp(a, b) -> int:
    """Plain quadratic dynamic programme; the test oracle for the above."""
    a = [] if a is None else list(a)
    b = [] if b is None else list(b)
    prev = list(range(len(a) + 1))
    for j, y in enumerate(b, 1):
        cur = [j] + [0] * len(a)
        for i, x in enumerate(a, 1):
            cur[i] = prev[i - 1] if x == y else min(prev[i], cur[i - 1], prev[i - 1]) + 1
        prev = cur
    return prev[-1]


@F.pandas_udf(T.DoubleType())
def _edit_distance_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    out = np.empty(len(a), dtype=np.float64)
    for i, (x, y) in enumerate(zip(a, b)):
        if x is None or y is None:
            out[i] = np.nan
        else:
            out[i] = levenshtein_ids(x.tolist() if hasattr(x, "tolist") else x,
                                     y.tolist() if hasattr(y, "tolist") else y)
    return pd.Series(out)


def edit_distance(words_a, words_b) -> Column:
    a = F.col(words_a) if isinstance(words_a, str) else words_a
    b = F.col(words_b) if isinstance(words_b, str) else words_b
    return (F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(a == b, F.lit(0.0))
            .otherwise(_edit_distance_udf(F.when(a != b, a), b)))


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` in which ``name`` stands for ``value``, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _cut(sequence: str) -> str:
    return f"transform(sequence(0, cast((size({sequence}) - 1) div {BITS} as int)), k -> slice({sequence}, k * {BITS} + 1, {BITS}))"


def _step() -> str:
    """One symbol of the longer sequence against one block.

    ``s`` holds the block's vertical differences (pv, mv) and the bits left so
    far (p, m), ``in`` the bits of the block above, ``i`` the place in the piece.
    """
    bit = lambda side: f"(shiftright(row.{side}, i) & 1L)"
    after = f"""named_struct(
        'pv', ((shiftleft(h.mh, 1) | {bit('m')}) & b.full) | (~(x.xv | ph) & b.full), 'mv', ph & x.xv,
        'p', s.p | if((h.ph & b.top) != 0L, shiftleft(1L, i), 0L), 'm', s.m | if((h.mh & b.top) != 0L, shiftleft(1L, i), 0L))"""
    after = _let("ph", f"(shiftleft(h.ph, 1) | {bit('p')}) & b.full", after)
    after = _let("h", "named_struct('ph', s.mv | (~(xh | s.pv) & b.full), 'mh', s.pv & xh)", after)
    after = _let("xh", "(((x.eq & s.pv) + s.pv) ^ s.pv) | x.eq", after)
    after = _let("x", f"named_struct('xv', eq | s.mv, 'eq', eq | {bit('m')})", after)
    return _let("eq", "coalesce(b.places[row.piece[i]], 0L)", after)


def _blocked(short: str, long: str) -> str:
    """SQL for the distance of two sequences that are not empty, by names of their columns."""
    # Where a block's symbols stand in it, as bits.
    block = _let("w", "size(block)", """named_struct(
        'full', shiftleft(1L, w) - 1L, 'top', shiftleft(1L, w - 1),
        'places', map_from_entries(transform(array_distinct(block), y -> struct(y, aggregate(
            sequence(0, w - 1), 0L, (m, j) -> if(block[j] = y, m | shiftleft(1L, j), m))))))""")
    piece = _let("last", f"""aggregate(sequence(0, size(row.piece) - 1),
        named_struct('pv', t.pv, 'mv', t.mv, 'p', 0L, 'm', 0L), (s, i) -> {_step()})""", """named_struct(
        'pv', last.pv, 'mv', last.mv,
        'rows', concat(t.rows, array(named_struct('piece', row.piece, 'p', last.p, 'm', last.m))))""")
    walk = _let("b", block, f"""aggregate(rows,
        named_struct('pv', b.full, 'mv', 0L, 'rows', cast(array() as array<struct<piece: array<bigint>, p: bigint, m: bigint>>)),
        (t, row) -> {piece}, t -> t.rows)""")
    first = f"transform({_cut(long)}, c -> named_struct('piece', c, 'p', shiftleft(1L, size(c)) - 1L, 'm', 0L))"
    return f"""aggregate(aggregate({_cut(short)}, {first}, (rows, block) -> {walk}),
        cast(size({short}) as bigint), (d, row) -> d + bit_count(row.p) - bit_count(row.m))"""


def edit_distance_jvm(words_a: str, words_b: str) -> Column:
    """Distance of two columns of word ids (array<bigint>), by name; NULL if one of them is."""
    size_a, size_b = f"size({words_a})", f"size({words_b})"
    return F.expr(f"""cast(case when {words_a} is null or {words_b} is null then null
        when {words_a} = {words_b} then 0
        when {size_a} = 0 or {size_b} = 0 then {size_a} + {size_b}
        when {size_a} <= {size_b} then {_blocked(words_a, words_b)}
        else {_blocked(words_b, words_a)} end as double)""")
