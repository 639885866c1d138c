"""Exact dedup: group by a 128-bit content hash, keep the smallest id, compare bytes inside groups.

Only DataFrame functions. Two passes read the texts. The first hashes each normalised text and
counts the groups on 16-byte keys; sums are made before the shuffle, so a group holding a third of all
rows costs one row a task. The second takes the texts whose hash occurs more than once and takes the
smallest and largest text of each hash, again partially before the shuffle: a hash whose two extremes
are byte for byte equal holds one text. Hashes that hold several texts are regrouped by the text itself.

Defined results: a null text counts as empty; repeated rows (same doc_id and text) are members of one
group and each gets a row, all of them kept if their doc_id is the smallest; a null doc_id stays only if its
group has no other id; an empty table gives an empty result. Further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayline.llm import common

#: A run of white space other than one plain space.
RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: str = "text") -> Column:
    """Each run of white space becomes one space; single spaces, the usual case, are left alone by the pattern."""
    return F.regexp_replace(common.whole_text(text), RUNS, " ")


def content_hash(norm: Column) -> Column:
    return F.unhex(F.md5(norm.cast("binary")))


def exact_dedup(docs: DataFrame, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of each row. ``hashed`` may be replaced, for tests."""
    norm = docs.select("doc_id", normalised().alias("norm"))
    keyed = common.saved(
        norm.select("doc_id", hashed(F.col("norm")).alias("h"), F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha")),
        "exact-keys",
    )
    groups = common.saved(
        keyed.groupBy("h").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1"),
        "exact-groups",
    )
    again = norm.withColumn("h", hashed(F.col("norm"))).join(groups.select("h"), "h", "left_semi")
    mixed = common.saved(
        again.groupBy("h").agg(F.min("norm").alias("low"), F.max("norm").alias("high")).where("low != high").select("h"),
        "exact-mixed",
    )
    sized = keyed.join(groups, "h", "left")
    if not mixed.isEmpty():
        apart = again.join(mixed, "h", "left_semi")
        texts = apart.groupBy("h", "norm").agg(F.min("doc_id").alias("own_id"), F.count(F.lit(1)).alias("own_size"))
        by_sha = texts.select("h", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha"), "own_id", "own_size")
        sized = sized.join(by_sha, ["h", "sha"], "left").withColumns(
            {"keep_id": F.when(F.col("own_size").isNotNull(), F.col("own_id")).otherwise(F.col("keep_id")), "group_size": F.coalesce("own_size", "group_size")}
        )
    return sized.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(common.documents(spark, sf_dir))


SQL = r"""
WITH n AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
    SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
"""
