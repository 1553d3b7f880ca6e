"""Personal data: patterns for protected entities, and terms that the corpus shows to disclose them."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwake.llm.common import materialize

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
DISCLOSURE = 0.9  # share of an entity's information that a term may give away
SUPPORT = 3  # documents from which a co-occurrence is estimated
LEAST_LETTERS, KEPT_LETTERS = 4, 3  # of a term, and of its generalisation
HELD_TERMS = 200_000  # distinct terms that a task counts before it hands them on

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# What follows a repeated class is never of that class, so possessive repeats find what greedy ones do, in linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(rf"[^\W\d_]{{{LEAST_LETTERS},}}")
_NO_DIGIT = re.compile(r"[^0-9]+")

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def emails(text: str) -> list[tuple[int, int]]:
    """Every match holds one @: the longest local part before it and the longest domain behind it."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        before, floor = text[floor:at], at + 1
        start = at - (len(before) - len(before.rstrip(LOCAL)))
        if domain and start < at:
            floor = domain.end()
            out.append((start, floor))
        at = text.find("@", floor)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, entity) by kind as listed, then start; the entity is the match without case or punctuation."""
    out = [("email", a, b, text[a:b].lower()) for a, b in emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            out.append(("ip", *m.span(), ".".join(parts)))
    for m in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span(), digits))
    for m in _PHONE.finditer(text):
        digits = _NO_DIGIT.sub("", m[0])
        if 8 <= len(digits) <= 15:
            out.append(("phone", *m.span(), digits))
    return out


def terms(text: str) -> set[str]:
    """The words of a text in lower case and, as words of their own, their generalisations."""
    words = {w.lower() for w in set(_WORD.findall(text))}
    return words | {general(w) for w in words}


def general(word: str) -> str:
    return word[:KEPT_LETTERS] + "*"


def disclosing_spans(text: str, base: list[tuple[int, int]], flagged: set[str]) -> list[tuple[int, int]]:
    """Flagged words outside the base spans."""
    blocked, i, out = sorted(base), 0, []
    ends = []
    for a, b in blocked:  # spans of different kinds can overlap
        if ends and a <= ends[-1][1]:
            ends[-1] = (ends[-1][0], max(b, ends[-1][1]))
        else:
            ends.append((a, b))
    for m in _WORD.finditer(text):
        while i < len(ends) and ends[i][1] <= m.start():
            i += 1
        if m[0].lower() in flagged and not (i < len(ends) and ends[i][0] < m.end()):
            out.append(m.span())
    return out


def rewrite(text: str, spans: list[tuple[str, int, int]], flagged: set[str]) -> str:
    """The text with entities named by kind, and disclosing words generalised, or removed where the generalisation discloses too."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a < done:
            done = max(done, b)  # overlaps what is out already
            continue
        word = text[a:b].lower()
        out += [text[done:a], f"[{kind.upper()}]" if kind != TERM or general(word) in flagged else general(word)]
        done = b
    return "".join([*out, text[done:]])


def _entity(kind: str, value: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{kind}:{value}".encode(), digest_size=8).digest(), "little", signed=True)


def found_entities(docs: DataFrame, id_col: str, text_col: str, keep_text: bool) -> DataFrame:
    """(id, h1, h2, text, spans, entities) of every document: base spans and digests of the entities; texts without entities only where asked for."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Ids pass the workers as strings: in a column with nulls pandas would round them.
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text"))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [base_spans(t) for t in pdf["text"]]
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b, _ in f] for f in found]
            texts = [t if keep_text or f else None for t, f in zip(pdf["text"], found)]
            yield pdf.assign(text=pd.Series(texts, index=pdf.index, dtype=object), spans=spans, entities=[sorted({_entity(k, v) for k, _, _, v in f}) for f in found])

    return rows.mapInPandas(find, f"id string, h1 long, h2 long, text string, spans array<{SPAN.simpleString()}>, entities array<long>")


def term_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(term, n_t): in how many documents each term occurs; tasks hand on sums."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def out() -> pd.DataFrame:
            full = pd.DataFrame({"term": list(held), "n": list(held.values())}).astype({"n": "int64"})
            held.clear()
            return full

        for pdf in batches:
            for text in pdf["text"]:
                held.update(terms(text))
                if len(held) > HELD_TERMS:
                    yield out()
        if held:
            yield out()

    return docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text")).mapInPandas(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t"))


def flagged_terms(docs: DataFrame, found: DataFrame, text_col: str, disclosure: float, support: int) -> DataFrame:
    """(h1, h2, flagged): for each different text with entities the terms that disclose one of them.

    With n_e, n_t and c the numbers of documents that hold the entity, the term and both of N, a term gives away
    PMI / IC = 1 - log(c / n_t) / log(n_e / N) of the entity's information. Terms in more documents than even full co-occurrence would
    allow are left out before any pair is built, and equal texts count as one with its number of copies.
    """
    total = found.count()
    named = found.where(F.size("entities") > 0).groupBy("h1", "h2").agg(F.first("text").alias("text"), F.first("entities").alias("entities"), F.count("*").alias("copies"))
    named = materialize(named)
    least = F.pow(F.col("n_e") / total, F.lit(1 - disclosure))  # of c / n_t
    each = named.select("h1", "h2", "copies", F.explode("entities").alias("e"))
    known = each.groupBy("e").agg(F.sum("copies").alias("n_e")).where((F.col("n_e") >= support) & (F.col("n_e") < total)).withColumn("least", least)
    holds = materialize(each.join(known, "e"))
    most = holds.agg(F.max(F.col("n_e") / F.col("least"))).first()[0] or 0.0
    counted = term_counts(docs, text_col).where((F.col("n_t") >= support) & (F.col("n_t") <= most))

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for h1, h2, text in zip(pdf["h1"], pdf["h2"], pdf["text"]):
                own = list(terms(text))
                yield pd.DataFrame({"h1": [h1] * len(own), "h2": [h2] * len(own), "term": own}).astype({"h1": "int64", "h2": "int64", "term": object})

    texts = named.select("h1", "h2", "text").join(holds.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi")
    held = materialize(texts.mapInPandas(words, "h1 long, h2 long, term string").join(counted, "term"))
    pairs = held.join(holds, ["h1", "h2"]).where(F.col("n_t") * F.col("least") <= F.col("n_e"))
    strong = pairs.groupBy("term", "e").agg(F.sum("copies").alias("c"), F.first("n_t").alias("n_t"), F.first("least").alias("least"))
    strong = strong.where((F.col("c") >= support) & (F.col("c") >= F.col("n_t") * F.col("least"))).select("term", "e")
    return held.join(strong, "term").join(holds.select("h1", "h2", "e"), ["h1", "h2", "e"]).groupBy("h1", "h2").agg(F.sort_array(F.collect_set("term")).alias("flagged"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = DISCLOSURE, support: int = SUPPORT, keep_text: bool = True) -> DataFrame:
    """(id, spans, sanitised): a row for each document with its personal data and the text without it.

    spans are (kind, start, end) in code points, end exclusive, by kind: emails, addresses, cards and phones by pattern, then terms: words of four
    letters on that stand in at least `support` documents together with an entity that this document holds, and over all documents give away more
    than the share `disclosure` of its information. They are cut to their first three letters where that discloses less, else removed. A
    document without entities has no terms. sanitised is null unless `keep_text`.

    A null text counts as empty, a null id stays null, repeated rows are rows of their own. An empty table gives no rows. Other columns aren't read.
    Entities in every document tell nothing and have no terms. Time is linear in a text's length.
    """
    found = materialize(found_entities(docs, id_col, text_col, keep_text))
    flagged = flagged_terms(docs, found, text_col, disclosure, support)

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            spans, texts = [], []
            for text, base, keys in zip(pdf["text"], pdf["spans"], pdf["flagged"]):
                own = set(keys) if keys is not None else set()
                old = [(s["kind"], int(s["start"]), int(s["end"])) for s in base]
                new = [(TERM, a, b) for a, b in disclosing_spans(text, [s[1:] for s in old], own)] if own else []
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in old + new])
                texts.append(rewrite(text, old + new, own) if keep_text else None)
            yield pd.DataFrame({"id": pdf["id"], "spans": spans, "sanitised": pd.Series(texts, index=pdf.index, dtype=object)})

    some = found.where(F.size("entities") > 0).join(flagged, ["h1", "h2"], "left").select("id", "text", "spans", "flagged").mapInPandas(mark, f"id string, spans array<{SPAN.simpleString()}>, sanitised string")
    none = found.where(F.size("entities") == 0).select("id", "spans", F.col("text").alias("sanitised"))
    return none.unionByName(some).select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "spans", "sanitised")


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, the digest of the base spans and all spans as text, from `sanitise`."""

    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base, n = F.filter("spans", lambda s: s["kind"] != TERM), map(of, KINDS)
    return found.select(id_col, *n, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
