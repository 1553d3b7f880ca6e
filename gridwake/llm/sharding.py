"""Sharding by a keyed permutation of global row numbers. Native: DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwake.llm.common import numbered

HALF_ROUNDS = 8
MAX_WALK = 64


def permuted(number: Column, total: int, seed: int = 0) -> Column:
    """A bijection of [0, total) as a column expression.

    A Feistel network over Z_a x Z_b with a = ceil(sqrt(total)), b = ceil(total / a): each half round adds a keyed hash
    of one half to the other, which can be undone, so it permutes [0, a*b). Numbers that leave [0, total) walk
    on along their cycle. Fewer than a numbers lie outside, so a walk is at most a - 1 steps long and a single step
    is needed with probability under 1/a; MAX_WALK steps are tried, and a walk that were longer raises an error.
    """
    a = max(1, math.isqrt(max(0, total - 1)) + 1)
    b = max(1, -(-total // a))
    keys = F.array(*[F.struct(F.lit(seed * 1_000_003 + i).cast("long").alias("key"), F.lit(i % 2).alias("side")) for i in range(HALF_ROUNDS)])

    def once(x: Column) -> Column:
        halves = F.struct((x - x % b).cast("long").alias("hi"), (x % b).cast("long").alias("lo"))
        halves = F.struct(F.floor(halves["hi"] / F.lit(b)).cast("long").alias("u"), halves["lo"].alias("v"))

        def half_round(s: Column, k: Column) -> Column:
            u = F.when(k["side"] == 0, F.pmod(s["u"] + F.pmod(F.xxhash64(s["v"], k["key"]), F.lit(a)), F.lit(a))).otherwise(s["u"])
            v = F.when(k["side"] == 1, F.pmod(s["v"] + F.pmod(F.xxhash64(s["u"], k["key"]), F.lit(b)), F.lit(b))).otherwise(s["v"])
            return F.struct(u.cast("long").alias("u"), v.cast("long").alias("v"))

        return F.aggregate(keys, halves, half_round, lambda s: s["u"] * F.lit(b).cast("long") + s["v"])

    excess = a * b - total
    first = once(number.cast("long"))
    if excess <= 0:
        return first
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(min(excess, MAX_WALK))), first, lambda x, _: F.when(x >= total, once(x)).otherwise(x))
    return F.when(walked < total, walked).otherwise(F.raise_error(F.lit("cycle walk longer than MAX_WALK")))


def shard(docs: DataFrame, shards: int = 16, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal every row into one of `shards` shards; the numbers of rows in two shards differ by one at most.

    Rows are numbered by (id, size, digest) over the whole table, the numbers are permuted by a keyed Feistel network,
    and number p goes to shard p mod shards, slot p div shards. The place of a row follows from its row number and
    the table's row count alone. Returns (id, size, text_crc32, shard, slot).

    Null text counts as empty (size 1). A null id is sorted first. Repeated rows are dealt as rows of their own; equal
    texts are not kept together. An empty table gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    placed = numbered(rows, [F.col("doc_id"), F.col("size"), F.col("text_crc32")])
    total = placed.count()
    p = placed.withColumn("_p", permuted(F.col("row_no"), total, seed))
    return p.select(F.col("doc_id").alias(id_col), "size", "text_crc32", F.pmod("_p", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("_p") / shards).cast("long").alias("slot"))
