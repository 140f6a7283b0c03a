"""Sharding by a minimax contiguous partition (DataFrame functions only).

Atomic groups are never split: rows with equal texts share a hash cell, the
cells are ordered by hash, and consecutive cells are cut into shards.  The
smallest feasible shard capacity is found by binary search; each probe packs
the ordered cells greedily.  All of the search is one SQL expression over one
array with at most ``CELLS`` entries, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairlens.llm.common import stored, text_or_empty

#: Hash cells.  Bounds the array of the search and the cell -> shard broadcast
#: (65,536 rows of two integers), independent of the input.
CELLS = 1 << 16
#: Numbering blocks per shard; bounds the offsets table to shards x blocks rows.
BLOCKS = 1024

# The greedy check: how many shards of capacity `cap` the ordered cells need.
_NEEDED = """aggregate(cells, named_struct('n', 1, 'load', 0L),
  (a, x) -> if(a.load + x.bytes > {cap}, named_struct('n', a.n + 1, 'load', x.bytes),
                                         named_struct('n', a.n, 'load', a.load + x.bytes)),
  a -> a.n)"""

# The cells at which a new shard begins when packing greedily with capacity `cap`.
_CUTS = """aggregate(cells, named_struct('load', 0L, 'cuts', cast(array() as array<int>)),
  (a, x) -> if(a.load + x.bytes > cap,
               named_struct('load', x.bytes, 'cuts', array_append(a.cuts, x.cell)),
               named_struct('load', a.load + x.bytes, 'cuts', a.cuts)),
  a -> a.cuts)"""


def _step(one: DataFrame, *exprs: str) -> DataFrame:
    """Evaluate ``exprs`` on the single row once.

    The generator keeps the optimizer from inlining them into the next
    step's lambdas, where they would run again for every element.
    """
    return one.selectExpr(f"inline(array(struct({', '.join(exprs)})))")


def minimax_cells(cells: DataFrame, n_shards: int) -> DataFrame:
    """(cell, bytes) -> (cell, shard), the partition with the smallest capacity.

    A cell above the mean of what is left gets a shard of its own, largest
    first, so one giant group does not leave the other shards empty; the
    remaining cells are cut in hash order at the smallest feasible capacity.
    """
    one = cells.agg(F.array_sort(F.collect_list(F.struct("cell", "bytes"))).alias("ordered"))
    one = _step(one, "ordered", """slice(array_sort(ordered, (x, y) -> case
        when x.bytes > y.bytes then -1 when x.bytes < y.bytes then 1
        when x.cell < y.cell then -1 when x.cell > y.cell then 1 else 0 end), 1, {k}) as largest""".format(
        k=max(1, n_shards - 1)), "aggregate(ordered, 0L, (s, x) -> s + x.bytes) as total")
    one = _step(one, "ordered", f"""aggregate(largest,
        named_struct('left', total, 'own', cast(array() as array<int>), 'go', true),
        (a, x) -> if(a.go and size(a.own) < {n_shards} - 1
                     and x.bytes * ({n_shards} - size(a.own)) > a.left,
                     named_struct('left', a.left - x.bytes, 'own', array_append(a.own, x.cell), 'go', true),
                     named_struct('left', a.left, 'own', a.own, 'go', false)),
        a -> a.own) as own""")
    one = _step(one, "ordered", "own", "filter(ordered, x -> not array_contains(own, x.cell)) as cells",
                f"{n_shards} - size(own) as n")
    one = _step(one, "ordered", "own", "cells", "n",
                "aggregate(cells, named_struct('lo', 0L, 'hi', 0L), (a, x) -> "
                "named_struct('lo', greatest(a.lo, x.bytes), 'hi', a.hi + x.bytes)) as range")
    halve = f"""aggregate(sequence(1, 63), range, (r, i) -> if(r.lo >= r.hi, r,
        if({_NEEDED.format(cap="((r.lo + r.hi) div 2)")} <= n,
           named_struct('lo', r.lo, 'hi', (r.lo + r.hi) div 2),
           named_struct('lo', (r.lo + r.hi) div 2 + 1, 'hi', r.hi))), r -> r.hi) as cap"""
    one = _step(one, "ordered", "own", "cells", "n", halve)
    one = _step(one, "ordered", "own", f"{_CUTS} as cuts", "n")
    return one.selectExpr("own", "cuts", "n", "explode(ordered) as x").selectExpr(
        "x.cell as cell",
        "cast(if(array_contains(own, x.cell), n + array_position(own, x.cell) - 1, "
        "size(filter(cuts, c -> c <= x.cell))) as int) as shard")


def shard_documents(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Law ``bytes``: shard sizes as equal as whole groups of equal texts allow.
    A null text counts as an empty one (size 8, crc32 0) and shares its group;
    a null doc_id is kept and numbered like any other; rows that repeat
    exactly get one slot each.  Slots are gapless from 0 in each shard: a row's
    place in its numbering block plus the rows of the blocks before it, so no
    task numbers a whole shard.  An empty table gives an empty result.  Other
    columns of ``docs`` are ignored whatever their names.
    """
    text = text_or_empty()
    keys = stored(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(CELLS)).cast("int").alias("cell"),
        F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(BLOCKS)).cast("int").alias("block"),
    ), "shard-keys")
    cells = keys.groupBy("cell").agg(F.sum("size").alias("bytes"))
    # Broadcast bounds: CELLS rows, and n_shards x BLOCKS rows.
    placed = keys.join(F.broadcast(minimax_cells(cells, n_shards)), "cell")
    sizes = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")
    return (placed.withColumn("place", F.row_number().over(inside) - 1)
            .join(F.broadcast(offsets), ["shard", "block"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("offset") + F.col("place")).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
