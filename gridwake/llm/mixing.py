"""Mixing to target weights with soft domain membership. Native: DataFrame functions only.

Every document gets a posterior over domains from a classifier trained on labelled rows, and a nonnegative rate. The rates
solve a least-squares problem: the expected tokens of each domain, sum over documents of rate x tokens x posterior, are
to match the domain's target. The gradient of a document's rate depends on the others only through the domains' totals,
so one aggregate of as many numbers as there are domains is all that a step needs.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwake.llm.common import materialize

FIT_ROWS = 1500  # labelled rows from which the strings are chosen
STRINGS = 28  # that the classifier reads
SHARPNESS = 400.0  # the classifier's log odds count as those of so many bytes at most
PENALTY = 1e-3
LEAST_SHARE = 0.5  # of the corpus' tokens that a mix without a set total takes at least
STEPS = 60
TOLERANCE = 1e-3
# A mix of languages that the test tables' domains can give.
TARGETS = {"en": 0.55, "fr": 0.17, "de": 0.15, "es": 0.13}


def telling_strings(docs: DataFrame, labels: DataFrame, domain_col: str, most: int = STRINGS, rows: int = FIT_ROWS) -> list[str]:
    """The pairs of letters that tell the domains of the labelled rows apart best, by their part of the chi-square statistic.

    Learnt from at most `rows` labelled rows, evenly chosen by a hash of the id, over their whole texts. Domains take turns, each with its best pair.
    """
    known = labels.where(F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(6)), "doc_id").limit(rows)
    x = docs.select("doc_id", F.col(domain_col).cast("string").alias("domain"), F.lower("text").alias("t")).where("domain is not null and length(t) > 1").join(F.broadcast(known), "doc_id")
    # A look ahead finds overlapping pairs in one pass; cutting substrings out would take time quadratic in a text's length.
    pairs = x.select("domain", F.explode(F.regexp_extract_all("t", F.lit(r"(?=(\p{L}[\p{L} ]))"), F.lit(1))).alias("pair"))
    counts = materialize(pairs.groupBy("domain", "pair").agg(F.count("*").cast("double").alias("n")))
    by_pair, by_domain, everything = counts.groupBy("pair").agg(F.sum("n").alias("np")), counts.groupBy("domain").agg(F.sum("n").alias("nd")), counts.agg(F.sum("n").alias("all"))
    expected = F.col("np") * F.col("nd") / F.col("all")
    scored = counts.join(by_pair, "pair").join(by_domain, "domain").crossJoin(F.broadcast(everything)).withColumn("gain", F.when(F.col("n") > expected, (F.col("n") - expected) * (F.col("n") - expected) / expected).otherwise(0.0))
    # Pairs of letters are few whatever the table's size; the window holds those of one domain in the sample.
    ranked = scored.withColumn("turn", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("gain"), "pair"))).where(F.col("turn") <= most)
    return [r["pair"] for r in ranked.groupBy("pair").agg(F.min("turn").alias("turn"), F.max("gain").alias("gain")).orderBy("turn", F.desc("gain"), "pair").limit(most).collect()]


def _counts(text: Column, strings: list[str]) -> Column:
    """How often each string occurs and, last, the text's bytes. Lengths in bytes are at hand, so a string costs one replacement."""
    low = F.lower(text)
    found = [(F.octet_length(low) - F.octet_length(F.replace(low, F.lit(s), F.lit("")))) / len(s.encode()) for s in strings]
    return F.array(*[c.cast("double") for c in found], F.octet_length(low).cast("double"))


def row_key(docs: DataFrame) -> Column:
    return F.xxhash64(docs["doc_id"], docs["text"])


def tokens(text: Column) -> Column:
    """Words and marks, as the mix counts them."""
    return F.regexp_count(text, F.lit(r"\w+|[^\w\s]")).cast("double")


def features(docs: DataFrame, domain_col: str, labelled: DataFrame, strings: list[str]) -> DataFrame:
    """(doc_id, row_key, n_tokens, counts, domain), materialised: domain is null where the row has no label."""
    text = F.coalesce(F.col("text"), F.lit(""))
    x = docs.select("doc_id", row_key(docs).alias("row_key"), tokens(text).alias("n_tokens"), _counts(text, strings).alias("counts"), F.col(domain_col).cast("string").alias("_domain"))
    known = labelled.where(F.col("doc_id").isNotNull()).select("doc_id").distinct().withColumn("_known", F.lit(True))
    return materialize(x.join(known, "doc_id", "left").select("doc_id", "row_key", "n_tokens", "counts", F.when(F.col("_known"), F.col("_domain")).alias("domain")))


def posteriors(x: DataFrame, targets: list[str], k: int) -> tuple[DataFrame, list[str]]:
    """Add p, an array of one posterior for each domain that has labelled rows, by naive Bayes with Poisson counts of k strings per byte; and those domains."""
    sums = x.where("domain is not null").groupBy("domain").agg(F.count("*").alias("n"), *[F.sum(F.element_at("counts", i + 1)).alias(f"c{i}") for i in range(k + 1)]).collect()  # a row for each domain
    found = {r["domain"]: r for r in sums}
    domains = sorted(found) or targets
    rows = sum(r["n"] for r in sums)
    size = F.element_at("counts", -1)
    scale = F.least(F.lit(1.0), F.lit(SHARPNESS) / F.greatest(size, F.lit(1.0)))
    logits = []
    for d in domains:
        r = found.get(d)
        rates = [((r[f"c{i}"] if r else 0.0) + 0.5) / ((r[f"c{k}"] if r else 0.0) + 1000.0) for i in range(k)]
        weights = F.array(*[F.lit(math.log(v)) for v in rates], F.lit(-sum(rates)))
        prior = math.log(((r["n"] if r else 0) + 1.0) / (rows + len(domains)))
        logits.append(F.lit(prior) + scale * F.aggregate(F.zip_with("counts", weights, lambda c, w: c * w), F.lit(0.0), lambda a, v: a + v))
    x = x.withColumn("_z", F.array(*logits))
    x = x.withColumn("_e", F.transform("_z", lambda v: F.exp(v - F.array_max("_z"))))
    return x.withColumn("p", F.transform("_e", lambda v: v / F.aggregate("_e", F.lit(0.0), lambda a, w: a + w))).drop("_z", "_e"), domains


def _dot(p: Column, values: Column) -> Column:
    return F.aggregate(F.zip_with(p, values, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)


def _rate(p: Column, start: float, taken: list[float]) -> Column:
    """The rate after projected gradient steps that add up to `taken`, a number for each domain; the projection comes last (dual averaging), so all steps cost one."""
    return F.greatest(F.lit(0.0), F.lit(start) - _dot(p, F.array(*[F.lit(float(v)) for v in taken])))


def fit_rates(x: DataFrame, targets: dict[str, float], total: float | None = None, domains: list[str] | None = None, least_share: float = LEAST_SHARE) -> DataFrame:
    """Add rate, and the largest relative gap to a target that is left, to rows with n_tokens and p so that the domains' expected tokens match their shares of `total`.

    Without a total, the largest is taken at which no domain needs more than its expected tokens once over, but not less than
    least_share of all tokens: rarer domains are then repeated. p follows `domains` (those of the targets by default); one without a target is to have
    no tokens. Targets of domains without any tokens can't be met and are left out of the gap.
    """
    domains = sorted(domains if domains is not None else targets)
    weight = sum(targets.values()) or 1.0
    share = [targets.get(d, 0.0) / weight for d in domains]
    e = [F.sum(F.col("n_tokens") * F.element_at("p", i + 1)).alias(f"e{i}") for i in range(len(domains))]
    cross = [F.sum(F.col("n_tokens") * F.element_at("p", i + 1) * F.element_at("p", j + 1)).alias(f"m{i}_{j}") for i in range(len(domains)) for j in range(len(domains))]
    first = x.agg(*e, *cross).first()
    have = [first[f"e{i}"] or 0.0 for i in range(len(domains))]
    use = [i for i in range(len(domains)) if have[i] > 0 and share[i] > 0]
    if not use:
        return x.withColumn("rate", F.lit(0.0)).withColumn("gap", F.lit(0.0))
    goal = total if total is not None else max(min(have[i] / share[i] for i in use), least_share * sum(have))
    wanted = [goal * share[i] for i in range(len(domains))]
    unit = [have[i] if have[i] > 0 else 1.0 for i in range(len(domains))]
    # Rates are preconditioned by their tokens and totals are measured in what each domain has, so that the step is 1 / the largest row sum.
    row = max(sum((first[f"m{i}_{j}"] or 0.0) / unit[i] for j in range(len(domains))) for i in range(len(domains))) or 1.0
    step = 1.0 / (row * (1 + PENALTY))
    start = goal / max(1.0, sum(have))
    taken = [0.0] * len(domains)

    def left(totals: list[float]) -> float:
        return max(abs(totals[i] - wanted[i]) / max(wanted[i], 1.0) for i in use)

    got = [h * start for h in have]
    for _ in range(STEPS):
        gap = [(got[i] - wanted[i]) / unit[i] for i in range(len(domains))]
        if left(got) < TOLERANCE:
            break
        # The penalty draws rates back to the start: at rest, taken is gap / PENALTY, which is what the least-squares solution has.
        taken = [(1 - step * PENALTY) * t + step * g for t, g in zip(taken, gap)]
        rated = x.select("p", (_rate(F.col("p"), start, taken) * F.col("n_tokens")).alias("_rn"))
        totals = rated.agg(*[F.sum(F.col("_rn") * F.element_at("p", i + 1)).alias(f"e{i}") for i in range(len(domains))]).first()
        got = [totals[f"e{i}"] or 0.0 for i in range(len(domains))]
    return x.withColumn("rate", _rate(F.col("p"), start, taken)).withColumn("gap", F.lit(float(left(got))))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, domain_col: str = "lang", total: float | None = None, seed: int = 0, least_share: float = LEAST_SHARE) -> DataFrame:
    """A rate and a number of copies for every document: (doc_id, row_key, n_tokens, domain, posterior, rate, copies, gap).

    gap is the same in all rows: the largest relative distance to a target after the last step, above TOLERANCE only where STEPS didn't suffice. The classifier learns `domain_col` from the documents that the labelled table lists; domain is the likeliest, posterior its
    probability. copies is the rate rounded up or down by a hash of the row, so that its expectation is the rate.

    Null and empty texts have no tokens and get the starting rate of their prior. Rows with a null doc_id count and get
    rates; repeated rows get equal ones. A labelled domain outside the targets is to have no tokens; targets without labelled rows are left
    out, the others' shares growing in proportion. Tokens are words and marks, as SQL can count them. An empty table gives no rows.
    """
    targets = TARGETS if targets is None else targets
    strings = telling_strings(docs, labels, domain_col)
    x, domains = posteriors(features(docs, domain_col, labels, strings), sorted(targets), len(strings))
    x = materialize(x.drop("counts"))
    r = fit_rates(x, {d: v for d, v in targets.items() if d in domains}, total, domains, least_share)
    r = r.withColumn("posterior", F.array_max("p")).withColumn("domain", F.element_at(F.array(*[F.lit(d) for d in domains]), F.array_position("p", F.col("posterior")).cast("int")))
    chance = F.pmod(F.xxhash64("row_key", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return r.select("doc_id", "row_key", F.col("n_tokens").cast("long").alias("n_tokens"), "domain", "posterior", "rate", (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")).cast("long").alias("copies"), "gap")


def mixed(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The documents as the mix takes them: each as often as its copies say. Columns are those of docs."""
    fit = mix(docs, labels, **settings)
    mark = uuid.uuid4().hex  # the documents may have columns of any name
    row, key, copies, i = (f"{name}_{mark}" for name in ("row", "key", "copies", "i"))
    taken = fit.where("copies > 0").groupBy(F.col("row_key").alias(key)).agg(F.max("copies").alias(copies))
    keyed = docs.withColumn(row, row_key(docs))
    return keyed.join(taken, F.col(row) == F.col(key)).withColumn(i, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)
