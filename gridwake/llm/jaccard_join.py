"""Jaccard self-join of documents on word shingles by a MinHash LSH forest with exact verification."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwake.llm.common import components, held, materialize, measured

SHINGLE = 5
THRESHOLD = 0.8
TREES = 24
LONGEST_PREFIX = 8
RECALL = 0.9995
BLOCK_ROWS = 1024
BLOCK_CHARS = 6_000_000
STRIP = 4096
HASHED_AT_ONCE = 128
WORDS_KEPT = 150_000

_WORD = re.compile(r"\w+")
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def words(text: str) -> np.ndarray:
    """A 64-bit hash of each lower-case word."""
    found = _WORD.findall(text.lower())
    hashes = held("hashes of words", dict)
    if len(hashes) > WORDS_KEPT:
        hashes.clear()
    try:
        return np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    except KeyError:
        for w in found:
            if w not in hashes:
                hashes[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))


def shingles(w: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """The set of hashes of the runs of `size` words; a shorter text is one run, a text without words has none."""
    if not len(w):
        return w
    size = min(size, len(w))
    h = np.zeros(len(w) - size + 1, np.uint64)
    for j in range(size):
        h = (h + w[j : j + len(h)]) * _M
        h ^= h >> np.uint64(29)
    return np.unique(_mix(h + np.uint64(size)))


def prefix_length(similarity: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, longest: int = LONGEST_PREFIX) -> int:
    """The longest prefix at which a pair of this similarity meets in some tree with the probability `recall`."""
    k = longest
    while k > 1 and 1 - (1 - similarity**k) ** trees < recall:
        k -= 1
    return k


@functools.lru_cache(maxsize=8)
def _hash_functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20250101))
    return rng.integers(1, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def prefixes(s: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """The path of a shingle set's MinHash signature down each tree: row k - 1 holds a hash of its first k levels in every tree."""
    a, b = _hash_functions(trees * depth)
    least = np.full(trees * depth, np.iinfo(np.uint64).max, np.uint64)
    hashed = np.empty((min(len(s), HASHED_AT_ONCE), trees * depth), np.uint64)  # small enough for a core's cache
    for i in range(0, len(s), HASHED_AT_ONCE):
        part = s[i : i + HASHED_AT_ONCE]
        h = np.multiply(part[:, None], a, out=hashed[: len(part)])  # shingles are mixed hashes already: a linear function orders them at random
        h += b
        np.minimum(least, h.min(axis=0), out=least)
    path, acc = np.zeros((depth, trees), np.uint64), np.zeros(trees, np.uint64)
    for k, level in enumerate(least.reshape(trees, depth).T):  # two signatures share a node of the trie if all levels down to it agree
        path[k] = acc = _mix((acc + level) * _M)
    return path.view(np.int64)


def signatures(docs: DataFrame, trees: int, shortest: int, longest: int, size: int) -> DataFrame:
    """(doc_id, k1, k2, chars, bands5 ...): two hashes of the word sequence, null for texts without words, and the nodes in each tree.

    There is a column of nodes for each prefix length from the shortest to the longest, so that a round reads and shuffles its own alone.
    """
    lengths = range(shortest, longest + 1)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            k1, k2, paths = [], [], []
            for text in pdf["text"]:
                w = words(text)
                if len(w):
                    raw = w.tobytes()
                    k1.append(_signed(xxhash.xxh3_64_intdigest(raw)))
                    k2.append(_signed(xxhash.xxh64_intdigest(raw, 9)))
                    paths.append(prefixes(shingles(w, size), trees, longest))
                else:
                    k1.append(None)
                    k2.append(None)
                    paths.append(None)
            bands = {f"bands{k}": [None if p is None else p[k - 1] for p in paths] for k in lengths}
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "k1": pd.array(k1, "Int64"), "k2": pd.array(k2, "Int64"), "chars": pdf["text"].str.len().astype("int64"), **bands})

    return docs.mapInPandas(sign, "doc_id long, k1 long, k2 long, chars long, " + ", ".join(f"bands{k} array<long>" for k in lengths))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _local_roots(near: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id of each row's connected component in a boolean adjacency matrix."""
    low = ids.copy()
    while True:
        nxt = np.minimum(low, np.where(near, low[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max))
        if (nxt == low).all():
            return low
        low = nxt


def verify_block(pdf: pd.DataFrame, size: int, threshold: float) -> pd.DataFrame:
    """Exact links within one block of texts, or between the two sides of a pair of blocks.

    Returns (root, doc_id, links, low, least): the documents linked to, copies counted, the smallest id linked through this block and
    the least similarity of its links, null without any.
    """
    pdf = pdf.drop_duplicates(["doc_id", "side", "text"]).sort_values(["side", "doc_id"], kind="stable").reset_index(drop=True)
    ids, copies, side = (pdf[c].to_numpy(np.int64) for c in ("doc_id", "copies", "side"))
    sets = [shingles(words(t), size) for t in pdf["text"]]
    n = np.array([len(s) for s in sets], np.int64)
    inter = np.zeros((len(sets), len(sets)), np.float32)
    near = np.zeros((len(sets), len(sets)), bool)
    across = side.max() > side.min()

    def enough(inter: np.ndarray, rows: slice, columns: slice) -> np.ndarray:
        union = n[rows, None] + n[None, columns] - inter
        return (inter > 0) & (inter >= threshold * union - 1e-9)

    if len(sets) <= 6:
        for i in range(len(sets)):
            for j in range(i + 1, len(sets)):
                if min(n[i], n[j]) >= threshold * max(n[i], n[j]) - 1e-9 and ids[i] != ids[j]:
                    inter[i, j] = inter[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    near[i, j] = near[j, i] = enough(inter[i : i + 1, j : j + 1], slice(i, i + 1), slice(j, j + 1))[0, 0]
    else:
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), n)
        _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
        shared = times[column] > 1  # a shingle of one text alone adds nothing to an intersection
        _, column = np.unique(column[shared], return_inverse=True)
        owner = owner[shared]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, STRIP):
            a, b = np.searchsorted(column, [start, start + STRIP])
            m = np.zeros((len(sets), STRIP), np.float32)
            m[owner[a:b], column[a:b] - start] = 1
            inter += m @ m.T
        near = enough(inter, slice(None), slice(None))
        near &= ids[:, None] != ids[None, :]
    if across:
        near &= side[:, None] != side[None, :]
    links = near.astype(np.int64) @ copies
    a, b = np.nonzero(near)
    least = np.full(len(ids), np.inf)
    np.minimum.at(least, a, inter[a, b] / (n[a] + n[b] - inter[a, b]))
    return pd.DataFrame({"root": pdf["root"], "doc_id": ids, "links": links, "low": _local_roots(near, ids), "least": pd.array(np.where(np.isinf(least), None, least), "Float64")})


def _groups(nodes: DataFrame, length: int) -> DataFrame:
    """(node, root) of the texts that share trie nodes of this length, directly or through others."""
    of_tree = nodes.select("doc_id", F.posexplode(f"bands{length}").alias("tree", "band"))
    hubs = of_tree.groupBy("tree", "band").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).where("n > 1")
    return components(of_tree.join(hubs, ["tree", "band"]).where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")))


def _verified(x: DataFrame, member: DataFrame, size: int, threshold: float) -> DataFrame:
    """verify_block's rows over all texts of the groups in `member`, in pairs of blocks of bounded size."""
    texts = x.join(member, x["doc_id"] == member["node"]).select("doc_id", "root", "copies", "text")
    sizes = member.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("chars") / BLOCK_CHARS), F.lit(1)).alias("parts"))
    parted = texts.join(sizes, "root").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")))
    pairs = F.when(F.col("parts") == 1, F.array(F.struct(F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q")))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda i: F.struct(F.least(i, F.col("part")).alias("p"), F.greatest(i, F.col("part")).alias("q")))
    )
    blocks = parted.select("doc_id", "root", "copies", "text", "part", "parts", F.explode(pairs).alias("pair"))
    blocks = blocks.select("doc_id", "root", "copies", "text", "pair.p", "pair.q", (F.col("part") == F.col("pair.q")).cast("long").alias("side"))
    return blocks.groupBy("root", "p", "q").applyInPandas(lambda pdf: verify_block(pdf, size, threshold), "root long, doc_id long, links long, low long, least double")


def link_classes(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """Join all documents with similarity of at least `threshold`: one row (doc_id, class_id, n_links) for each document.

    Similarity is Jaccard's on the sets of `size`-word shingles of lower-case words; a shorter text is one shingle. n_links counts the
    other documents linked directly, copies included; class_id is the smallest doc_id that links reach.

    Texts of the same words are one node. Groups of texts that share a node at the longest prefix in some tree are compared exactly
    first, in pairs of blocks of bounded size, so that no pair that shares a group is lost and no pair leaves a task. The least similarity among
    the links found tells the recall of such pairs: while it is under `recall`, prefixes are shortened to the longest ones that reach it and groups
    that grew are compared again. Without any link, pairs at the threshold itself are to reach it. A pair no less similar than the
    least found is missed with a probability of at most 1 - recall.

    Null and wordless texts link with nothing: class_id = doc_id, n_links = 0. Rows with a null doc_id give no row. Rows that repeat a
    doc_id are one node each text, share its class and give a row each. An empty table gives no rows.
    """
    x = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    shortest = prefix_length(threshold, trees, recall)
    signed = materialize(signatures(x, trees, shortest, LONGEST_PREFIX, size))
    reps = materialize(signed.where("k1 is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("chars").alias("chars")))
    nodes = signed.join(reps.select("k1", "k2", F.col("rep").alias("doc_id")), ["k1", "k2", "doc_id"], "left_semi")
    weight = reps.groupBy("rep").agg(F.max("copies").alias("copies"), F.sum("chars").alias("chars"))
    length, before = LONGEST_PREFIX, None
    while True:
        member = materialize(_groups(nodes, length).join(weight, F.col("node") == F.col("rep")).select("node", "root", "copies", "chars"))
        sizes = member.groupBy("root").agg(F.count("*").alias("n"))
        if before is None:
            found = _verified(x, member, size, threshold)
        else:  # groups only grow as prefixes shorten: one of the same root and size is the same
            same = materialize(sizes.join(before[0], ["root", "n"], "left_semi").select("root"))
            found = before[1].join(same, "root", "left_semi").unionByName(_verified(x, member.join(same, "root", "left_anti"), size, threshold))
        found, least = measured(found, F.min("least"))
        shorter = prefix_length(threshold if least is None else max(least, threshold), trees, recall, length)
        if shorter == length:
            break
        length, before = shorter, (sizes, found)
    near = components(found.select(F.col("doc_id").alias("a"), F.col("low").alias("b")))
    linked = found.groupBy("doc_id").agg(F.sum("links").alias("links")).join(near, F.col("doc_id") == F.col("node"), "left").select(F.col("doc_id").alias("rep"), "links", F.coalesce("root", "doc_id").alias("root"))
    per_text = reps.join(linked, "rep", "left").select("k1", "k2", F.coalesce("root", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    return signed.select("doc_id", "k1", "k2").join(per_text, ["k1", "k2"], "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """The documents without those of a class that have a smaller doc_id beside them; rows with a null doc_id stay."""
    classes = link_classes(docs) if classes is None else classes
    gone = classes.where("doc_id <> class_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
