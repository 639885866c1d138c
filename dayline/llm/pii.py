"""Personal data by candidate generation and gradient boosting, in DataFrame functions only.

High-recall generators propose spans that may overlap: the four base patterns, and looser forms of each kind
(spelled-out mail addresses, colon-separated addresses, short or badly checked card numbers, phone numbers without a plus). A
candidate carries a few small integers on its format, and evidence that these do not show: a valid number and a word before it
that speaks for its kind, a common last label of an address, or for cards the checksum. Candidates that touch a base span without being one are left out. The rest
are counted by their integers over all documents, a table of at most some ten thousand rows, and boosted trees are fitted to the counts:
candidates with evidence are positive, all else is unlabelled and weighs less. The trees become one SQL expression.
Evidence is seen on a part of the true spans only, a part that passing base matches show; so the share with evidence among
looser candidates over a score, over that part, estimates how many of them are true, and each kind's threshold is
the lowest score down to which it is at least PRECISE. Base spans always stay; other candidates with a valid number are selected if they reach
the threshold.

Positions come from pairing each match with the text before it. Every pattern here consists of plain runs, so that no
text, however long, makes the matcher recurse or start over inside a run; a marker character stands for separators that lie between two digits
or labels, which keeps all positions.

Defined results: a null or empty text has no spans; repeated rows are searched each; positions are code points; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayline.llm import common

KINDS = ("email", "ip", "card", "phone")
MARK, NOT_MARK = "\x01", "\x02"
LOCAL = rf"A-Za-z0-9._%+\x01-"
#: Base patterns over the marked text: a marked dot lies between two label characters, a marked separator between two digits.
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++\x01[A-Za-z0-9\x01-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9\x01])[0-9][0-9\x01]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Looser forms.
SPELLED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[](?:at|AT)[)\]] ?[A-Za-z0-9-]++(?: ?[(\[](?:dot|DOT)[)\]] ?|\.)[A-Za-z0-9-]++"
COLONS = r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){0,4}"
LOCAL_PHONE = r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
#: Words before a span that speak for it.
CUES = {
    "email": "mail|contact|write|reach",
    "ip": "ip|host|server|address|addr",
    "card": "card|visa|credit|pay",
    "phone": "phone|call|tel|fax|mobile",
}
FEATURES = ("kind", "digits", "sign", "groups", "loose", "glued_left", "glued_right", "span")
#: Weight of unlabelled candidates; trees; learning rate.
UNLABELLED, TREES, RATE = 0.5, 24, 0.3
#: Estimated share of true spans among the looser candidates of a kind that are selected, at least.
PRECISE = 0.8
#: Share of true spans taken to have evidence, at least: less could be words that stand there by chance.
LEAST_SHOWN = 0.1
#: Last labels of an address that count as evidence.
ENDINGS = "com|org|net|edu|gov|mil|int|info|biz|io|example|test"
SPAN = "struct<m:string,start:int,end:int,before:string,after:string>"
#: Matches in one fold: appending to an array copies it, so long lists are folded in blocks.
FOLD = 128


def located(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with their places in code points, from 0, end exclusive, and what is around them.

    Each match is paired with the text before it, so all work is in proportion to the text.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    n = F.size(found)
    around = F.zip_with(F.slice(gaps, F.lit(1), n), F.slice(gaps, F.lit(2), n), lambda gap, then: F.struct(F.length(gap).alias("gap"), F.right(gap, F.lit(24)).alias("before"), F.left(then, F.lit(1)).alias("after")))
    pairs = F.zip_with(found, around, lambda m, x: F.struct(m.alias("m"), x["gap"].alias("gap"), x["before"].alias("before"), x["after"].alias("after")))

    def block(rows: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            first = acc["at"] + x["gap"]
            last = first + F.length(x["m"])
            one = F.struct(x["m"].alias("m"), first.cast("int").alias("start"), last.cast("int").alias("end"), x["before"].alias("before"), x["after"].alias("after"))
            return F.struct(last.alias("at"), F.array_append(acc["out"], one).alias("out"))

        return F.aggregate(rows, start, step)

    def joined(folded: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        offsets = F.aggregate(folded, start, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))["out"]
        moved = F.zip_with(
            folded, offsets, lambda x, by: F.transform(x["out"], lambda s: F.struct(s["m"].alias("m"), (s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["before"].alias("before"), s["after"].alias("after")))
        )
        return F.flatten(moved)

    def blocks(rows: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / FOLD).cast("int")), lambda b: block(F.slice(rows, b * FOLD + 1, F.lit(FOLD))))
        return F.when(F.size(rows) == 0, F.array().cast(f"array<{SPAN}>")).otherwise(bound(cut, joined))

    return bound(pairs, blocks)


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def luhn(digits: Column) -> Column:
    values = F.transform(F.filter(F.split(F.reverse(F.left(digits, F.lit(19))), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def checked(kind: str, m: Column) -> Column:
    """Whether a match of a base pattern passes the check of its kind."""
    digits = F.regexp_replace(m, "[^0-9]+", "")
    if kind == "ip":
        def fits(part: Column) -> Column:
            bare = F.regexp_replace(part, "^0+", "")
            return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

        return F.forall(F.split(m, r"\."), fits)
    if kind == "card":
        return F.length(digits).between(16, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def bucketed(value: Column, bounds: tuple[int, ...]) -> Column:
    return sum((value >= b).cast("int") for b in bounds)


def described(kind: int, base: bool, spans: Column) -> Column:
    """Candidates with their features, from spans with their matches."""
    name = KINDS[kind]

    def one(s: Column) -> Column:
        m = s["m"]
        digits = F.length(F.regexp_replace(m, "[^0-9]+", ""))
        ok = checked(name, m) if base or name != "ip" else F.lit(True)
        bare = F.regexp_replace(m, "[^0-9]+", "")
        valid = F.length(bare).between(13, 19) & luhn(bare) if name == "card" else ok
        ends = F.lower(m).rlike(rf"[^a-z0-9-](?:{ENDINGS})$") if name == "email" else F.lit(False)
        cue = F.lower(s["before"]).rlike(rf"\b(?:{CUES[name]})")
        features = (
            F.lit(kind),
            bucketed(digits, (1, 8, 10, 11, 13, 16, 17, 20)),
            m.rlike("^[+]|@").cast("int"),
            F.least(F.size(F.split(m, r"[^0-9A-Za-z]+")), F.lit(6)),
            F.lit(int(not base)),
            s["before"].rlike(r"[\p{L}\p{N}]$").cast("int"),
            s["after"].rlike(r"[\p{L}\p{N}]").cast("int"),
            bucketed(F.length(m), (8, 12, 16, 20, 28)),
        )
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), (F.lit(base) & ok).alias("base"), valid.alias("valid"), (valid if name == "card" else valid & (cue | ends)).alias("seen"), F.array(*(f.cast("int") for f in features)).alias("f"))

    return F.transform(spans, one)


CANDIDATE = "array<struct<kind:int,start:int,end:int,base:boolean,valid:boolean,seen:boolean,f:array<int>>>"


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and the candidates of each row; texts without a digit, an at sign and a spelled one are passed by."""
    plain = docs.select("doc_id", F.translate(common.whole_text(), MARK, NOT_MARK).alias("text"))
    text = F.col("text")
    dots = F.regexp_replace(text, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", MARK)
    joints = F.regexp_replace(text, r"(?<=[0-9])[\x20-](?=[0-9])", MARK)
    none = F.array().cast(CANDIDATE)

    def part(kind: int, base: bool, hint: Column, source: Column, pattern: str) -> Column:
        return F.when(hint, described(kind, base, located(source, pattern))).otherwise(none)

    digit = text.rlike("[0-9]")
    parts = (
        part(0, True, F.contains(text, F.lit("@")), dots, EMAIL),
        part(0, False, F.contains(F.lower(text), F.lit("(at)")) | F.contains(F.lower(text), F.lit("[at]")), text, SPELLED),
        part(1, True, digit & F.contains(text, F.lit(".")), text, IP),
        part(1, False, F.contains(text, F.lit(":")) & text.rlike("[0-9A-Fa-f]:[0-9A-Fa-f]"), text, COLONS),
        part(2, True, digit, joints, CARD),
        part(3, True, F.contains(text, F.lit("+")), text, PHONE),
        part(3, False, digit, text, LOCAL_PHONE),
    )
    found = F.when(text.rlike(r"[0-9@:(\[]"), F.concat(*parts)).otherwise(none)
    long_enough = F.filter(found, lambda c: c["base"] | (c["kind"] != 2) | (c["f"][1] >= 5))
    both = plain.select("doc_id", long_enough.alias("found")).withColumn("base", F.filter("found", lambda c: c["base"]))

    def apart(c: Column) -> Column:
        return c["base"] | ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))

    return both.select("doc_id", F.when(F.size("found") > F.size("base"), F.filter("found", apart)).otherwise(F.col("found")).alias("found"))


class Boosted:
    """Logistic boosting of two-level trees over a table of small integer features with weights."""

    def __init__(self, x: np.ndarray, positive: np.ndarray, other: np.ndarray):
        self.trees: list[tuple] = []
        self.start = 0.0
        weight = positive + UNLABELLED * other
        if not len(x) or weight.sum() == 0:
            return
        share = np.clip(positive.sum() / weight.sum(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        at = np.full(len(x), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-at))
            g, h = positive - weight * p, weight * p * (1 - p)
            tree = self._split(x, g, h, np.ones(len(x), bool), 2)
            if not isinstance(tree, tuple):
                break
            self.trees.append(tree)
            at += RATE * self._value(tree, x)

    def _split(self, x, g, h, rows, depth):
        best = (1e-6, None, None)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        leaf = float(total_g / (total_h + 1.0))
        if not depth:
            return leaf
        for j in range(x.shape[1]):
            for cut in np.unique(x[rows, j])[1:]:
                low = rows & (x[:, j] < cut)
                a, b = g[low].sum(), h[low].sum()
                gain = a * a / (b + 1) + (total_g - a) ** 2 / (total_h - b + 1) - total_g**2 / (total_h + 1)
                if gain > best[0]:
                    best = (gain, j, int(cut))
        _, j, cut = best
        if j is None:
            return leaf
        low = x[:, j] < cut
        return (j, cut, self._split(x, g, h, rows & low, depth - 1), self._split(x, g, h, rows & ~low, depth - 1))

    def _value(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        j, cut, low, high = tree
        return np.where(x[:, j] < cut, self._value(low, x), self._value(high, x))

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.start + RATE * sum((self._value(t, x) for t in self.trees), np.zeros(len(x)))

    def expression(self, f: Column) -> Column:
        """The margin as an SQL expression of the array of features."""

        def of(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(tree)
            j, cut, low, high = tree
            return F.when(f[j] < cut, of(low)).otherwise(of(high))

        return F.lit(self.start) + RATE * sum((of(t) for t in self.trees), F.lit(0.0))


def trained(found: DataFrame) -> tuple[Boosted, list[float]]:
    """The trees and each kind's threshold, from the candidates of all documents, counted by their features."""
    each = found.where(F.size("found") > 0).select(F.explode("found").alias("c"))
    base, seen = F.col("c.base").cast("long"), F.col("c.seen").cast("long")
    rows = each.groupBy("c.f").agg(F.count(F.lit(1)).alias("n"), F.sum(seen).alias("seen"), F.sum(base).alias("base"), F.sum(base * seen).alias("base_seen")).orderBy("f").collect()
    x = np.array([r["f"] for r in rows], dtype=int).reshape(len(rows), len(FEATURES))
    n, seen, base, base_seen = np.array([r[1:] for r in rows], float).reshape(len(rows), 4).T
    model = Boosted(x, seen, n - seen)
    margin = model.margins(x)
    return model, [threshold(*(v[x[:, 0] == kind] for v in (margin, n - base, seen - base_seen, base, base_seen))) for kind in range(len(KINDS))]


def threshold(margin: np.ndarray, loose: np.ndarray, loose_seen: np.ndarray, base: np.ndarray, base_seen: np.ndarray) -> float:
    """The lowest score of one kind down to which looser candidates are true at the rate PRECISE, by evidence; infinite where none is."""
    # of true spans, those with evidence; where base matches never have it, all are asked for it
    shown = max(base_seen.sum() / base.sum(), LEAST_SHOWN) if base_seen.sum() else 1.0
    scores = np.unique(margin[loose > 0])
    for score in scores:
        over = margin >= score
        hits = loose_seen[over].sum()
        if hits and hits >= PRECISE * shown * loose[over].sum():
            return float(score)
    return float("inf")


def spelled(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(spans, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda c: F.concat_ws(":", F.element_at(names, c["kind"] + 1), c["start"].cast("string"), c["end"].cast("string"))), ",")


def detected(docs: DataFrame) -> DataFrame:
    """doc_id, base and more (arrays of kind, start, end, ...): the base spans and those that the trees add."""
    found = common.saved(candidates(docs), "pii-candidates")
    model, thresholds = trained(found)
    limits = F.array(*map(F.lit, thresholds))
    base = F.filter("found", lambda c: c["base"])
    rows = found.select("doc_id", base.alias("base"), "found")

    def added(c: Column) -> Column:
        return ~c["base"] & c["valid"] & (model.expression(c["f"]) >= F.element_at(limits, c["kind"] + 1) - 1e-9)

    return rows.select("doc_id", "base", F.when(F.size("found") > F.size("base"), F.filter("found", added)).otherwise(F.array().cast(CANDIDATE)).alias("more"))


def op2_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = detected(common.documents(spark, sf_dir))
    # a second parameter of a lambda would be taken for the place in the array
    of_kind = lambda kind: F.filter("base", lambda c: c["kind"] == kind)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return spans.select("doc_id", *counts, F.sha2(spelled(F.col("base")).cast("binary"), 256).alias("base_sha256"), spelled(F.concat("base", "more")).alias("spans"))
