"""Packing documents into token windows by best-fit decreasing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwake.llm.common import give_back, materialize, numbered
from gridwake.llm.token_count import machine

WINDOW = 2048
END_ID = 1


class OpenWindows:
    """Segment tree over remaining capacities: finds the least capacity of at least `need` for which windows are open."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.tree = [0] * (2 * self.size)
        self.open: list[list[list[int]]] = [[] for _ in range(window + 1)]  # runs [first window, windows]

    def add(self, capacity: int, first: int, n: int) -> None:
        self.open[capacity].append([first, n])
        self._count(capacity, n)

    def take(self, capacity: int, n: int) -> tuple[int, int]:
        """Up to n windows of the oldest run with that capacity."""
        run = self.open[capacity][0]
        k, first = min(n, run[1]), run[0]
        run[0], run[1] = run[0] + k, run[1] - k
        if not run[1]:
            self.open[capacity].pop(0)
        self._count(capacity, -k)
        return first, k

    def _count(self, capacity: int, n: int) -> None:
        at = capacity + self.size
        while at:
            self.tree[at] += n
            at //= 2

    def tightest(self, need: int) -> int:
        """The least capacity >= need with an open window, or -1."""
        at = need + self.size
        if self.tree[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.tree[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return -1


def best_fit_plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths.

    Pieces of one length are alike, so their order doesn't matter and they are placed in runs: a run fills consecutive windows
    with `each` pieces side by side. Returns rows (length, first rank, pieces, first window, each, offset). Both the rows and the steps
    are bounded by the window length, not by the number of pieces: the plan is the one that placing piece by piece gives.
    """
    windows, plan, used = OpenWindows(window), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = windows.tightest(length)
            if capacity < 0:
                capacity, each = window, window // length
                n = -(-left // each)
                first, used = used, used + n
            else:
                # After one piece such a window is the tightest for the next as long as it holds one.
                each = capacity // length
                first, n = windows.take(capacity, -(-left // each))
            pieces = min(left, n * each)
            full, over = divmod(pieces, each)
            plan.append((length, rank, pieces, first, each, window - capacity))
            if full and capacity - each * length:
                windows.add(capacity - each * length, first, full)
            if over:
                windows.add(capacity - over * length, first + full, 1)
            left, rank = left - pieces, rank + pieces
    return plan


def pieces(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text", small: bool = False) -> DataFrame:
    """Tokenize each text, add end_id and cut the ids into full windows and a rest.

    Returns (doc_id, start, length, doc_tokens, ids_crc32) and, with keep_ids, the ids themselves.
    """
    fields = [T.StructField("doc_id", docs.schema[id_col].dataType)] + [T.StructField(n, T.LongType()) for n in ("start", "length", "doc_tokens", "ids_crc32")]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(vocabulary, small)
        for batch in batches:
            counts, ids = m.encode(batch.column(1), want_ids=True)
            total = counts + 1
            past = np.cumsum(total)
            flat = np.full(int(past[-1]) if len(past) else 0, end_id, "<i4")
            inner = np.ones(len(flat), bool)
            inner[past - 1] = False
            flat[inner] = ids
            each = -(-total // window)
            doc = np.repeat(np.arange(len(total)), each)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)) * window
            length = np.minimum(window, total[doc] - start)
            low = (past - total)[doc] + start
            view = memoryview(flat.view(np.uint8))
            crc = np.fromiter((zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(low.tolist(), (low + length).tolist())), np.int64, len(low))
            columns = [batch.column(0).take(pa.array(doc)), *map(pa.array, (start, length, total[doc], crc))]
            if keep_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(low, len(flat)).astype(np.int32)), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])
            give_back()

    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(cut, T.StructType(fields))


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text", small: bool = False) -> DataFrame:
    """Pack all documents into windows of `window` tokens by best-fit decreasing; one row for each piece.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with keep_ids, ids. Each token lies in exactly one
    piece; in a sequence the pieces stand gapless from offset 0. Pieces are numbered by (length, doc_id, start) over the whole table;
    the histogram of lengths, of `window` rows at most, is planned on the driver, and each piece finds its run in the plan.

    Null and empty texts give one piece with end_id alone. Repeated rows and null ids are documents of their own. An empty
    table gives no rows. Other columns are not read. With `small`, workers tokenize in less memory and more time.
    """
    spark = docs.sparkSession
    # Written first: a range shuffle reads its input twice, and texts are to be tokenized once.
    cut = materialize(pieces(docs, vocabulary, window, end_id, keep_ids, id_col, text_col, small))
    placed = numbered(cut, [F.desc("length"), F.asc("doc_id"), F.asc("start"), F.asc("ids_crc32")])
    counts = {r["length"]: r["n"] for r in placed.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `window` rows at most
    plan, before, seen = best_fit_plan(counts, window), {}, 0
    for length in sorted(counts, reverse=True):
        before[length], seen = seen, seen + counts[length]
    rows = [(length, before[length] + rank, before[length] + rank + n, first, each, offset) for length, rank, n, first, each, offset in plan]
    # As an Arrow table: from a list, Spark would start a second set of Python workers in every executor.
    names = ["run_length", "lo", "hi", "first_window", "each", "run_offset"]
    runs = spark.createDataFrame(pa.table(list(np.array(rows, np.int64).reshape(-1, len(names)).T), names=names))
    at = (F.col("length") == F.col("run_length")) & (F.col("row_no") >= F.col("lo")) & (F.col("row_no") < F.col("hi"))
    k = F.col("row_no") - F.col("lo")
    sequence = (F.col("first_window") + F.floor(k / F.col("each"))).cast("long")
    offset = (F.col("run_offset") + F.pmod(k, F.col("each")) * F.col("length")).cast("long")
    # The plan's size depends on the window length alone.
    return placed.join(F.broadcast(runs), at).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", sequence.alias("sequence_id"), offset.alias("offset"), *(["ids"] if keep_ids else []))
