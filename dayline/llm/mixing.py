"""Mixing to target weights by soft membership, in DataFrame functions only.

A labelled table trains a multinomial classifier over hashed words, so every document, labelled or not, gets
a posterior over domains. Nonnegative rates, one for each document, are then fitted to the least of

    sum over d of (expected tokens of d under the rates / all tokens - target of d)^2 / 2  +  RIDGE / 2 * mean of (rate - 1)^2,

where a document's expected tokens of a domain are rate x tokens x posterior, and the mean weighs documents by
their tokens. At the least value a document's rate is max(0, 1 - posterior . u), where u, one pull for each domain, is the
residual of the domain over RIDGE. So u is all that is fitted, by Newton steps on the convex dual problem: a step takes
one grouped aggregate over a narrow table, of the expected totals and of products of posteriors. Steps end when the
gradient is small beside each domain's own target or share, however rare the domain.

Words enter training and prediction as hash buckets: a bounded table of weights, joined as a broadcast (BUCKETS x domains
numbers). Log-likelihoods are tempered by length, so that posteriors of long texts stay soft.

Defined results: a document without words has no tokens and the prior as its posterior; a null or unknown label
leaves the document unlabelled; without labels no domain
exists: posteriors are empty, rates are 1; a target for a domain that no row has is an error. Repeated rows are weighed each; ties between domains go to the first by name; an
empty table gives an empty result; columns of the input that are not needed are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayline.llm import common

BUCKETS = 4096
#: Labelled rows that training reads, about: those under a bound on the row hash.
LABELLED = 20_000
#: Words at which the log-likelihood counts half.
SOFT_WORDS = 30.0
RIDGE = 0.001
#: Newton steps end once the gradient of each domain is under this part of its target or share, whichever is more.
NEAR = 1e-6
#: Steps before the fit counts as failed, which is an error.
STEPS = 200
#: Posteriors under this are left out of the products that steer the steps; the totals that decide their end have all.
SLIGHT = 1e-6
#: Exponent on the observed shares in the production target: below 1 it lifts rare domains.
FLATTEN = 0.7
SPAN = 1 << 40


def words_of(text: str = "text") -> Column:
    """The words of a whole text; an empty text has one empty word, which the callers leave out."""
    return F.split(F.lower(common.whole_text(text)), rf"[{common.SPACE_CLASS}]+")


def bucket_of(word: str) -> Column:
    """The bucket of a word; null for the empty word."""
    return F.when(F.col(word) != "", F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int"))


@dataclass
class Membership:
    domains: list[str]
    prior: list[float]
    #: bucket, and the columns w0, w1, ... of log-probabilities by domain; None without labels.
    weights: DataFrame | None


def learned(docs: DataFrame, label: str) -> Membership:
    """Word weights of each domain, from about LABELLED labelled rows. Every label is a domain: domains are columns of one aggregate."""
    rows = docs.where(F.col(label).isNotNull()).select("doc_id", "text", F.col(label).cast("string").alias("domain"))
    counts = rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return Membership([], [], None)
    counts = sorted((r["domain"], r["n"]) for r in counts)
    total = sum(n for _, n in counts)
    domains = [d for d, _ in counts]
    bound = min(SPAN, SPAN * LABELLED // total + 1)
    some = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SPAN)) < bound)
    each = some.select("domain", F.explode(words_of()).alias("w")).select("domain", bucket_of("w").alias("bucket")).where("bucket IS NOT NULL")
    seen = common.saved(each.groupBy("bucket").agg(*(F.sum((F.col("domain") == d).cast("long")).alias(f"n{i}") for i, d in enumerate(domains))), "mixing-words")
    totals = seen.agg(*(F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"n{i}") for i in range(len(domains)))).first()
    weights = seen.select("bucket", *(F.log((F.col(f"n{i}") + 0.5) / (totals[i] + 0.5 * BUCKETS)).alias(f"w{i}") for i in range(len(domains))))
    return Membership(domains, [n / total for _, n in counts], weights)


def membership(docs: DataFrame, model: Membership) -> DataFrame:
    """doc_id, h (the hash of the text), tokens and p, the posterior over model.domains, of each row.

    Words are summed by row where the text is read; one narrow row for each document is shuffled.
    """
    k = len(model.domains)
    rows = docs.select("doc_id", common.row_key()["h"].alias("h"), F.monotonically_increasing_id().alias("at"), words_of().alias("words"))
    each = rows.select("doc_id", "h", "at", F.explode("words").alias("w")).select("doc_id", "h", "at", bucket_of("w").alias("bucket"))
    if not k:
        none = each.groupBy("at", "doc_id", "h").agg(F.count("bucket").alias("tokens"))
        return none.select("doc_id", "h", "tokens", F.array().cast("array<double>").alias("p"))
    sums = each.join(F.broadcast(model.weights), "bucket", "left").groupBy("at", "doc_id", "h").agg(F.count("bucket").alias("tokens"), *(F.coalesce(F.sum(f"w{i}"), F.lit(0.0)).alias(f"w{i}") for i in range(k)))
    soft = 1 + F.col("tokens") / SOFT_WORDS
    logs = sums.select("doc_id", "h", "tokens", F.array(*(F.col(f"w{i}") / soft + math.log(model.prior[i]) for i in range(k))).alias("l"))
    powers = logs.select("doc_id", "h", "tokens", F.transform("l", lambda x: F.exp(x - F.array_max("l"))).alias("e"))
    total = sum((F.col("e")[i] for i in range(1, k)), F.col("e")[0])
    return powers.select("doc_id", "h", "tokens", F.transform("e", lambda x: x / total).alias("p"))


def rate(pulls: np.ndarray) -> Column:
    """The rate under the pulls of the domains, from the column p."""
    if not len(pulls):
        return F.lit(1.0)
    products = F.zip_with("p", F.lit([float(u) for u in pulls]), lambda x, u: x * u)
    return F.greatest(F.lit(0.0), 1.0 - F.aggregate(products, F.lit(0.0), lambda a, x: a + x))


def totals(members: DataFrame, k: int, pulls: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Half the squared rates, the expected tokens of each domain, and the products of posteriors of documents with a rate, all weighed by tokens."""
    one = F.lit(-1)

    def cell(i: Column, j: Column, x: Column) -> Column:
        return F.struct(i.alias("i"), j.alias("j"), (F.col("tokens") * x).alias("x"))

    large = F.filter(F.transform("p", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda a: (a["x"] > SLIGHT) & (F.col("r") > 0))
    products = F.flatten(F.transform("large", lambda a: F.transform(F.filter("large", lambda b: b["i"] >= a["i"]), lambda b: cell(a["i"], b["i"], a["x"] * b["x"]))))
    cells = F.concat(F.array(cell(one, one, F.col("r") * F.col("r") / 2)), F.transform("p", lambda x, i: cell(i, one, F.col("r") * x)), products)
    rows = members.select("tokens", "p", rate(pulls).alias("r")).withColumn("large", large).select(F.inline(cells)).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    half, sums, gram = 0.0, np.zeros(k), np.zeros((k, k))
    for i, j, x in rows:
        if i < 0:
            half = x
        elif j < 0:
            sums[i] = x
        else:
            gram[i, j] = gram[j, i] = x
    return half, sums, gram


def lifted(shares: list[float]) -> list[float]:
    """Production targets as multiples of all tokens: shares to the power FLATTEN, scaled so that no domain has to shrink."""
    raw = [max(s, 0.0) ** FLATTEN for s in shares]
    total = sum(raw) or 1.0
    flat = [x / total for x in raw]
    grow = max((s / f for s, f in zip(shares, flat, strict=True) if f > 0), default=1.0)
    return [grow * f for f in flat]


def fitted(members: DataFrame, model: Membership, targets: dict[str, float] | None) -> np.ndarray:
    """The pull of each domain. targets: of each domain, tokens as a share of all tokens present."""
    k = len(model.domains)
    unknown = sorted(set(targets or {}) - set(model.domains))
    if k and unknown:
        raise ValueError(f"targets for domains that no row is labelled with: {unknown}")
    pulls = np.zeros(k)
    if not k:
        return pulls
    half, sums, gram = totals(members, k, pulls)
    total = sums.sum()
    if not total:
        return pulls
    shares = sums / total
    goal = np.array(lifted(shares.tolist()) if targets is None else [targets.get(d, 0.0) for d in model.domains])
    scale = np.maximum(np.maximum(goal, shares), 1e-12)

    def dual(u: np.ndarray, half: float) -> float:
        return RIDGE / 2 * u @ u + goal @ u + half / total

    for _ in range(STEPS):
        slope = RIDGE * pulls + goal - sums / total
        if (np.abs(slope) <= NEAR * scale).all():
            return pulls
        step = -np.linalg.solve(gram / total + RIDGE * np.eye(k), slope)
        now, part = dual(pulls, half), 1.0
        while True:
            after = pulls + part * step
            half, sums, gram = totals(members, k, after)
            if dual(after, half) <= now + 1e-4 * part * (slope @ step) + 1e-13 * abs(now) or part < 1e-6:
                break
            part /= 2
        pulls = after
    raise RuntimeError(f"the rates of {k} domains did not reach their least value in {STEPS} steps")


def rated(docs: DataFrame, label: str = "lang", targets: dict[str, float] | None = None) -> DataFrame:
    """doc_id, h, tokens, domain (the likeliest), posterior, rate and copies of each row.

    copies is the rate rounded down or up by the row's hash, so that it equals the rate on average.
    """
    model = learned(docs, label)
    members = common.saved(membership(docs, model), "mixing-members")
    pulls = fitted(members, model, targets)
    draw = F.pmod(F.xxhash64("doc_id", "h"), F.lit(SPAN)) / float(SPAN)
    best = F.array_max("p")
    names = F.array(*map(F.lit, model.domains)).cast("array<string>")
    out = members.withColumn("rate", rate(pulls))
    return out.select("doc_id", "h", "tokens", F.get(names, (F.array_position("p", best) - 1).cast("int")).alias("domain"), best.alias("posterior"), "rate", F.floor(F.col("rate") + draw).cast("int").alias("copies"))


def mixed(docs: DataFrame, label: str = "lang", targets: dict[str, float] | None = None) -> DataFrame:
    """The rows of docs, each as often as its copies."""
    copies = rated(docs, label, targets).select(F.struct("doc_id", "h").alias("row"), "copies").dropDuplicates(["row"])
    keyed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("d"), common.row_key().alias("row"))
    out = keyed.join(copies, keyed["row"].eqNullSafe(copies["row"])).where("copies > 0")
    return out.select("d", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*(F.col("d")[c].alias(c) for c in docs.columns))


def op10_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rated(common.documents(spark, sf_dir)).select("doc_id", F.col("tokens").alias("n_tokens"), "domain", "posterior", "rate", "copies")
