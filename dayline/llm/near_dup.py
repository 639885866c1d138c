"""MinHash near-dedup with b-bit signatures.

One pass over the texts gives each document its set size, a 128-bit fingerprint of its shingle set, band keys over
full minima, and the low four bits of each minimum packed into eight words. Documents with equal sets become one
class, represented by the row of its smallest doc_id. Classes that share a band are candidates; a candidate pair's similarity is estimated
from the packed words by bit counts, corrected for chance collisions, and pairs far below the threshold are let go
(six standard deviations). The rest are confirmed on the full sets.

A band never emits all its pairs: in each of a few rounds it pairs its members with two pivots, leaving out
members already in a pivot's component, and links join components. Only then do pairs between different
components of one band that no round has met go through the same estimate and confirmation, so that no link between
components is missed; bands with many members are cut into blocks there, which return links and never their pairs.

Defined results: a null text, or one without words, has an empty set and is linked with nothing; a null doc_id is linked
with nothing, its component_id is null and it is kept; repeated rows are equal sets and share a component, and each of them
is kept if its doc_id is the component's; one doc_id with several texts has a row, and a component, for each of them; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayline.llm import common
from dayline.llm.shingles import Permutations, mixed, shingle_hashes

HASHES, ROWS, BITS = 128, 4, 4
BANDS = HASHES // ROWS
PER_WORD = 64 // BITS
WORDS = HASHES // PER_WORD
#: Candidates whose estimate is lower than the threshold by this much are let go: near six standard deviations at 128 hashes.
MARGIN = 0.2
ROUNDS = 5
#: A round is added while the pairs left for the last step exceed this many times the band members,
#: and while the last round has cut them to this share at least: pivots do not help where they are linked with few.
LEFT_OVER, WORTH = 2, 0.5
#: Members of a band up to which the last step emits candidate pairs; larger bands are compared in blocks, which emit links only.
SMALL = 64
BLOCK = 512
SIGNED = "doc_id long, h long, n long, f1 long, f2 long, sig array<long>, bands array<long>"


def signed(docs: DataFrame, size: int) -> DataFrame:
    """The set size, fingerprint, packed low bits and band keys of each row. docs: doc_id, h (hash of the text), text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashing = Permutations(HASHES)
        shift = np.arange(0, 64, BITS, dtype=np.uint64)
        place = np.arange(BANDS, dtype=np.uint64)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                h = shingle_hashes(text, size)
                if not len(h):
                    rows.append((0, 0, 0, None, None))
                    continue
                low = hashing.minima(h)
                sig = ((low & np.uint64((1 << BITS) - 1)).reshape(WORDS, PER_WORD) << shift).sum(axis=1, dtype=np.uint64)
                with np.errstate(over="ignore"):
                    band = place.copy()
                    for r in range(ROWS):
                        band = mixed(band * np.uint64(0x9E3779B97F4A7C15) + low[r::ROWS])
                    f1, f2 = h.sum(dtype=np.uint64), mixed(h ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                rows.append((len(h), int(f1.astype(np.int64)), int(f2.astype(np.int64)), sig.view(np.int64), band.view(np.int64)))
            out = pd.DataFrame(rows, columns=["n", "f1", "f2", "sig", "bands"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").reset_index(drop=True))
            out.insert(1, "h", batch["h"].to_numpy())
            yield out

    return docs.select("doc_id", "h", "text").mapInPandas(run, SIGNED)


def differing(a: Column, b: Column) -> Column:
    """How many of the packed values of two words differ."""
    x = a.bitwiseXOR(b)
    for step in (1, 2):
        x = x.bitwiseOR(F.shiftrightunsigned(x, step))
    return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))


def estimate(a: str, b: str) -> Column:
    """Similarity from two packed signatures: the share of equal values, corrected for equality by chance."""
    unlike = sum((differing(F.col(a)[i], F.col(b)[i]) for i in range(1, WORDS)), differing(F.col(a)[0], F.col(b)[0]))
    chance = 2.0**-BITS
    return ((1 - unlike / HASHES) - chance) / (1 - chance)


def near(a: str, b: str, sizes: tuple[str, str], percent: int) -> Column:
    """What a candidate must meet before its sets are compared: sizes that allow the threshold, and the estimate."""
    x, y = F.col(sizes[0]), F.col(sizes[1])
    return (100 * F.least(x, y) >= percent * F.greatest(x, y)) & (estimate(a, b) >= percent / 100 - MARGIN)


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold. texts: rep, text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok, last, left = [], None, None
            for a, ta, tb in zip(batch["a"], batch["ta"], batch["tb"], strict=True):
                if last != a:
                    last, left = a, shingle_hashes(ta, size)
                right = shingle_hashes(tb, size)
                both = len(np.intersect1d(left, right, assume_unique=True))
                ok.append(100 * both >= percent * (len(left) + len(right) - both))
            yield batch.loc[ok, ["a", "b"]]

    joined = pairs.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("tb")), "b")
    joined = joined.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("ta")), "a")
    return joined.select("a", "b", "ta", "tb").mapInPandas(run, "a long, b long")


def shingle_sets(members: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """rep and set, its shingle hashes, of each member."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"rep": batch["rep"], "set": [shingle_hashes(t, size).tobytes() for t in batch["text"]]})

    return texts.join(members.select("rep").distinct(), "rep", "left_semi").mapInPandas(hashed, "rep long, set binary")


def blockwise(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components inside large bands. members: key, rep, comp and m, the size of the band.

    A band is cut into blocks of about BLOCK members and each two blocks meet in one group, which counts all
    intersections as a matrix product over the shingles that occur twice there and returns, for a
    document and another component, one link.
    """

    def compared(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rep", kind="stable").reset_index(drop=True)
        sets = [np.frombuffer(x, np.uint64) for x in group["set"]]
        n = np.array([len(x) for x in sets])
        owner = np.repeat(np.arange(len(sets)), n)
        _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = times[code] > 1
        owner, code = owner[shared], np.unique(code[shared], return_inverse=True)[1]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for first in range(0, int(code.max(initial=-1)) + 1, 1 << 14):
            at = (code >= first) & (code < first + (1 << 14))
            here = np.zeros((len(sets), min(1 << 14, int(code.max()) + 1 - first)), np.float32)
            here[owner[at], code[at] - first] = 1
            both += here @ here.T
        comp, part = group["comp"].to_numpy(), group["part"].to_numpy()
        ok = 100 * both >= percent * (n[:, None] + n[None, :] - both)
        ok &= comp[:, None] != comp[None, :]
        if (group["lo"] != group["hi"]).any():
            ok &= part[:, None] != part[None, :]
        i, j = np.nonzero(np.triu(ok, 1))
        rep = group["rep"].to_numpy()
        out = pd.DataFrame({"a": rep[i], "b": rep[j], "c": comp[j]})
        return out.drop_duplicates(["a", "c"])[["a", "b"]]

    parts = F.ceil(F.col("m") / BLOCK).cast("int")
    placed = members.select("key", "rep", "comp", parts.alias("parts"), F.pmod(F.xxhash64("rep"), parts).cast("int").alias("part"))
    placed = placed.select("key", "rep", "comp", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    cells = placed.select("key", "rep", "comp", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    return cells.join(sets, "rep").groupBy("key", "lo", "hi").applyInPandas(compared, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """node and comp, the smallest node that it reaches: smallest labels spread over edges (a, b), then labels of labels."""
    both = common.saved(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "near-edges")
    label = common.saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "near-labels")
    while True:
        around = both.join(label.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        spread = label.join(around, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        spread = common.saved(spread, "near-spread")
        ahead = spread.select(F.col("node").alias("comp"), F.col("comp").alias("ahead"))
        after = common.saved(spread.join(ahead, "comp", "left").select("node", "old", F.coalesce("ahead", "comp").alias("comp")), "near-labels")
        common.dropped(label, spread)
        label = after.select("node", "comp")
        if after.where("comp != old").isEmpty():
            common.dropped(both)
            return label


def relabelled(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after more links: only the links between the components so far are worked through."""
    if label is None:
        return components(links)
    a, b = (label.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab")
    ends = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a != b")
    moved = components(ends)
    old = label.join(moved.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    after = common.saved(old.union(moved.join(label, "node", "left_anti")), "near-components")
    common.dropped(label, moved)
    return after


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, h and text: a row is known by its id and the hash of its text, since one id may have several texts."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(common.whole_text()).alias("h"), "text")


def grouped(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, h, n_shingles, class_id, component_id and kept of each row."""
    docs = keyed(docs)
    sets = common.saved(signed(docs, size), "near-signed", batch=2000)
    by = ["n", "f1", "f2"]
    first = sets.where("n > 0 AND doc_id IS NOT NULL").groupBy(*by).agg(F.min(F.struct("doc_id", "h")).alias("row"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = common.saved(first.withColumn("rep", F.monotonically_increasing_id()), "near-classes")  # written, so that numbers stay
    places = classes.select("rep", F.explode("bands").alias("key"))
    shared = common.saved(places.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key"), "near-shared")
    members = common.saved(places.join(shared, "key"), "near-members")
    named = classes.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "row.doc_id", "row.h")
    texts = common.saved(docs.join(named, ["doc_id", "h"]).select("rep", "text").dropDuplicates(["rep"]), "near-texts")
    sigs = classes.select("rep", "n", "sig")

    def checked(pairs: DataFrame, label: str) -> DataFrame:
        a, b = (sigs.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}")) for x in "ab")
        hopeful = pairs.join(a, "a").join(b, "b").where(near("sa", "sb", ("na", "nb"), percent)).select("a", "b").distinct()
        return common.saved(confirmed(hopeful, texts, size, percent), label, batch=500)

    label, before = None, None
    for r in range(ROUNDS):
        at = members.withColumn("comp", F.col("rep")) if label is None else members.join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        at = common.saved(at, "near-placed")
        sizes = at.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.sum("m").alias("m"), (F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))).alias("pairs"))
        left, all_members = sizes.agg(F.coalesce(F.sum("pairs"), F.lit(0)), F.coalesce(F.sum("m"), F.lit(0))).first()
        if r and (left <= LEFT_OVER * all_members or left > WORTH * before):
            common.dropped(at)
            break
        before = left
        pick = F.struct(F.xxhash64("rep", F.lit(r)), "rep", "comp")
        pivots = common.saved(
            at.groupBy("key").agg(F.min(F.struct("rep", "comp")).alias("low"), F.min(pick).alias("some"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 != c1"), "near-pivots"
        ).select("key", F.explode(F.array(F.struct("low.rep", "low.comp"), F.struct("some.rep", "some.comp"))).alias("p"))
        met = at.join(pivots, "key").where("comp != p.comp").select(F.least("rep", "p.rep").alias("a"), F.greatest("rep", "p.rep").alias("b")).distinct()
        found = checked(met, "near-links")
        common.dropped(at, pivots)
        if found.isEmpty():
            break
        label = relabelled(label, found)
        common.dropped(found)
    at = members.withColumn("comp", F.col("rep")) if label is None else members.join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    several = at.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("m")).where("c0 != c1 AND m > 2").select("key", "m")
    rest = common.saved(at.join(several, "key"), "near-rest")
    if not rest.isEmpty():
        few = rest.where(F.col("m") <= SMALL).join(sigs, "rep")
        a, b = (few.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("rep", "comp", "n", "sig"))) for x in "ab")
        apart = a.join(b, "key").where((F.col("comp_a") < F.col("comp_b")) & near("sig_a", "sig_b", ("n_a", "n_b"), percent))
        apart = apart.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"))
        many = rest.where(F.col("m") > SMALL)
        full = common.saved(shingle_sets(many, texts, size), "near-sets", batch=500)
        found = common.saved(confirmed(apart.union(blockwise(many, full, percent)).distinct(), texts, size, percent), "near-links", batch=500)
        common.dropped(full)
        if not found.isEmpty():
            label = relabelled(label, found)
        common.dropped(found)
    common.dropped(rest, texts, members, shared)
    at = classes.select(*by, "rep", "row.doc_id", F.col("rep").alias("comp")) if label is None else classes.select(*by, "rep", "row.doc_id").join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    at = common.saved(at, "near-labelled")
    least = at.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    facts = at.join(least, "comp").select(*by, F.col("doc_id").alias("class_id"), "component_id")
    out = sets.select("doc_id", "h", *by).join(facts, by, "left")
    component = F.when(F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select(
        "doc_id",
        "h",
        F.col("n").alias("n_shingles"),
        F.coalesce("class_id", "doc_id").alias("class_id"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that are kept, repeated rows once; all columns stay. Rows with a null doc_id are all kept."""
    kept = grouped(docs, size, percent).where("kept AND doc_id IS NOT NULL").select("doc_id", "h").distinct()
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("d"), docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(common.whole_text()).alias("h"))
    found = rows.where("doc_id IS NOT NULL").join(kept.hint("merge"), ["doc_id", "h"], "left_semi").select("d.*")
    return found.dropDuplicates(["doc_id", "text"]).select(*docs.columns).union(docs.where("doc_id IS NULL"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(common.documents(spark, sf_dir), size=4).select("doc_id", "n_shingles", "component_id", "kept", "class_id")
