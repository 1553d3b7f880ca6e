"""Canonical exact digests of documents. Native: DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwake.llm.common import materialize, numbered


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC again, and each run of white space as one blank, trimmed. Null counts as empty."""
    nfkc = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    fold = lambda c: F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))
    return F.trim(F.regexp_replace(nfkc(fold(nfkc(F.coalesce(text, F.lit(""))))), r"(?U)\s+", " "))


def bucket(canon: Column) -> Column:
    """128 bits as 32 hexadecimal digits: two xxhash64 values under different prefixes."""
    half = lambda salt: F.lower(F.lpad(F.hex(F.xxhash64(F.lit(salt), canon)), 16, "0"))
    return F.concat(half(1), half(2))


def clashes(texts: DataFrame) -> DataFrame:
    """Of (bucket, canon) rows, the buckets whose canonical texts are not all the same bytes.

    The smallest and the largest text of a bucket are compared; both are combined before the shuffle, so that a
    bucket with a third of all rows sends one pair for each task.
    """
    return texts.groupBy("bucket").agg(F.min("canon").alias("low"), F.max("canon").alias("high")).where("low < high").select("bucket")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (id, fingerprint): equal for two rows exactly if their canonical texts are equal.

    The fingerprint is the bucket's 32 digits. In buckets that hold different texts, a SHA-256 of the canonical text
    follows. Null text counts as empty; repeated rows get equal fingerprints; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col), canonical(F.col(text_col)).alias("canon")).withColumn("bucket", bucket(F.col("canon")))
    bad = clashes(rows.select("bucket", "canon")).withColumn("clash", F.lit(True))
    return rows.withColumn("sha", F.sha2("canon", 256)).drop("canon").join(bad, "bucket", "left").select(id_col, F.when(F.col("clash"), F.concat_ws("-", "bucket", "sha")).otherwise(F.col("bucket")).alias("fingerprint"))


_ROW = ["doc_id", "no_id", "key"]  # what tells documents apart: the id, 0 where there is none, whether there is none, and a hash of the text


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Return (doc_id, no_id, key, copies, text, edited, next_doc_id, next_no_id, next_key): each document with its edited text.

    The last floor(n/3) code points give way to the first as many of the next document in descending doc_id (after the last: the
    first). Documents are told apart by doc_id and a hash of the text; rows that repeat both are `copies` of one document, and those without an
    id come last. Only ids and hashes are numbered; of the texts, each is shuffled once, and the prefixes that move to another document once more.
    """
    no_id = F.col("doc_id").isNull()
    x = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), no_id.alias("no_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    order = numbered(x.select(*_ROW, F.floor(F.length("text") / 3).cast("int").alias("third")).groupBy(*_ROW, "third").agg(F.count("*").alias("copies")), [F.asc("no_id"), F.desc("doc_id"), F.desc("key")])
    total = max(1, order.count())
    after = order.select(F.pmod(F.col("row_no") - 1, F.lit(total)).alias("row_no"), *[F.col(c).alias(f"next_{c}") for c in _ROW])
    links = materialize(order.join(after, "row_no").drop("row_no"))
    x = x.groupBy(*_ROW).agg(F.first("text").alias("text"))  # alike for both its uses, which then share a shuffle
    gives = links.select(*[F.col(f"next_{c}").alias(c) for c in _ROW], *[F.col(c).alias(f"to_{c}") for c in _ROW], "third", "copies")
    heads = x.join(gives, _ROW).select(*[F.col(f"to_{c}").alias(c) for c in _ROW], "third", "copies", F.expr("left(text, third)").alias("head"), *[F.col(c).alias(f"next_{c}") for c in _ROW])
    return x.join(heads, _ROW).select(*_ROW, "copies", "text", F.concat(F.expr("left(text, length(text) - third)"), F.col("head")).alias("edited"), *[f"next_{c}" for c in _ROW])


def _apart(buckets: DataFrame) -> DataFrame:
    """The buckets, so that a join shuffles both its sides anew: adaptive execution can then split the rows of a hot bucket."""
    return buckets.withColumn("bucket", F.concat("bucket", F.lit("")))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """For every document its fingerprint, that of its edited text, and how alike they and the next document's are.

    Exact digests are alike by 1 where equal, else by 0. Null texts count as empty. Documents without an id follow all others in the order; rows
    that repeat doc_id and text are one document there and give a row each; an empty table gives no rows.
    Texts are compared byte by byte only in buckets that hold more than one of them; all uses share the shuffles of the texts.
    """
    both = edited_pairs(docs)
    following = [f"next_{c}" for c in _ROW]
    canon = both.select("*", canonical(F.col("text")).alias("c0"), canonical(F.col("edited")).alias("c1"))
    digests = canon.select(*_ROW, *following, "copies", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), bucket(F.col("c0")).alias("b0"), bucket(F.col("c1")).alias("b1"), F.sha2("c0", 256).alias("s0"), F.sha2("c1", 256).alias("s1"))
    placed = digests.select(*_ROW, F.posexplode(F.array("b0", "b1")).alias("kind", "bucket"))
    shared = placed.groupBy("bucket").count().where("count > 1").select("bucket")
    wanted = placed.join(_apart(shared), "bucket", "left_semi")
    texts = both.join(wanted, _ROW).select("bucket", canonical(F.when(F.col("kind") == 0, F.col("text")).otherwise(F.col("edited"))).alias("canon"))
    bad = _apart(clashes(texts))
    exact = lambda b, s, bad_col: F.when(F.col(bad_col).isNotNull(), F.concat_ws("-", b, s)).otherwise(F.col(b))
    done = digests.join(bad.select(F.col("bucket").alias("b0"), F.lit(1).alias("bad0")), "b0", "left").join(bad.select(F.col("bucket").alias("b1"), F.lit(1).alias("bad1")), "b1", "left")
    done = materialize(done.select(*_ROW, *following, "copies", "n_chars", "edited_sha256", exact("b0", "s0", "bad0").alias("fingerprint"), exact("b1", "s1", "bad1").alias("edited_fingerprint")))
    theirs = done.select(*[F.col(c).alias(f"next_{c}") for c in _ROW], F.col("fingerprint").alias("_next"))
    out = done.join(theirs, following).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    alike = lambda c: (F.col("fingerprint") == F.col(c)).cast("double")
    return out.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", alike("edited_fingerprint").alias("near_edited"), alike("_next").alias("near_next"))
