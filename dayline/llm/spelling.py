"""Spelling variant grouping by merging the light subtrees of a trie of words.

The trie is a table: a word lies under a node for each of its prefixes, known by a hash of the prefix, and each node's heavy child is the
letter that most of its words take next. Two words one edit apart part at one node, and at least one of them goes on through a light
child there. So it is enough to merge light subtrees: each word under a light child is carried over once for each way of an edit at that
node, as the string at which it would end,

* with its letter replaced by the heavy one, where it may meet a word of the heavy subtree;
* with its letter replaced by none in particular, where it may meet words of other light subtrees (a bucket has one word a letter at most);
* with its letter skipped, where it may meet a word of the node's own subtree;
* with the heavy letter put before it, where a word of the heavy subtree may meet it by skipping that letter;

and coinciding terminals, found by joins, are the pairs. A word is under at most log2(words) light children, since each holds at most half
of its node's words, so the rows of a join are words times their logarithm whatever words look like; no task holds a subtree. A skipped
letter counts at the last place of its run, so that a pair is found once. Any choice of a heavy letter gives the same pairs, so a collision of node
hashes costs at most work. A word of n letters gives n short rows for the nodes and long strings only for its light children.

Defined results: a null text has no words; a null doc_id is written as nothing before the colon; repeated rows count again; words of any length
are compared; equal frequencies are ordered by code points; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayline.llm import common

RUN = re.compile("[A-Za-zÀ-ÿ]+")
SHORTEST, RAREST, TIMES = 5, 3, 2
#: Contract: one run in so many loses a letter.
SPOILED = 97
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
#: Words of an Arrow batch when nodes are listed.
WORDS = 2000


def counted(docs: DataFrame, spoiled: int = SPOILED) -> DataFrame:
    """word and n, over all runs of all texts after the contract's deletions. A task returns sums of its batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total: Counter[str] = Counter()
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                if not text:
                    continue
                start = zlib.crc32(f"{doc_id or ''}:".encode())
                for word, times in Counter(RUN.findall(text.lower().decode("utf-8", "replace"))).items():
                    if spoiled:
                        h = zlib.crc32(word.encode(), start)
                        if h % spoiled == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                    if len(word) >= SHORTEST:
                        total[word] += times
            if total:
                yield pd.DataFrame({"word": list(total), "n": list(total.values())})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= RAREST)


def paths(words: DataFrame) -> DataFrame:
    """id, i, node and letter: the node of the word's first i letters, and the letter that it takes next, as its code (letters end at 255)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths = np.fromiter(map(len, batch["word"]), np.int64, len(batch))
            nodes = np.empty(lengths.sum(), np.int64)
            at = 0
            for word in batch["word"]:
                h = 0
                for letter in word:
                    nodes[at] = h - (h >> 63 << 64)
                    h = ((h ^ ord(letter)) + 1) * _BASE & _MASK
                    h ^= h >> 29
                    at += 1
            row = np.repeat(np.arange(len(batch)), lengths)
            place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            yield pd.DataFrame({"id": batch["id"].to_numpy()[row], "i": place, "node": nodes, "letter": np.frombuffer("".join(batch["word"]).encode("latin-1"), np.uint8).astype(np.int32)})

    return words.select("id", "word").mapInPandas(run, "id long, i int, node long, letter int")


def light(words: DataFrame) -> DataFrame:
    """id, word, n, i and heavy: each place at which the word goes on through another letter than the node's heavy one. words: id, word, n."""
    steps = common.saved(paths(words), "spelling-paths", batch=WORDS)
    children = steps.groupBy("node", "letter").agg(F.count(F.lit(1)).alias("m"))
    branching = children.groupBy("node").agg(F.max(F.struct("m", "letter")).alias("most"), F.count(F.lit(1)).alias("c")).where("c > 1")
    nodes = common.saved(branching.select("node", F.col("most.letter").alias("letter")), "spelling-nodes")
    other = steps.join(nodes.withColumnRenamed("letter", "most"), "node").where("letter != most")
    found = common.saved(other.select("id", "i", F.char("most").alias("heavy")), "spelling-light")
    common.dropped(steps, nodes)
    return found.join(words, "id").select("id", "word", "n", "i", "heavy")


def near(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (word, n, other, m) of one edit between a word and where its light subtree is merged, each once, and
    buckets: rows (word, n, size, best, m) of words that differ in one letter with ``size`` others, of which ``best`` is the most frequent."""
    at = common.saved(light(words), "spelling-edges")
    before, x, after = F.expr("left(word, i)"), F.expr("substring(word, i + 1, 1)"), F.expr("substring(word, i + 2)")
    ends = at.select(
        "word", "n", F.explode(F.array(
            F.concat(before, "heavy", after),
            F.when((after == "") | (F.left(after, F.lit(1)) != x), F.concat(before, after)),
            F.concat(before, "heavy", x, after),
        )).alias("other"),
    )
    # A word whose last letter is heavy may meet its node itself; where it is light, the skip above has done so.
    last = words.join(at.where("i = length(word) - 1").select("id"), "id", "left_anti").select("word", "n", F.expr("left(word, length(word) - 1)").alias("other"))
    terminals = words.select(F.col("word").alias("other"), F.col("n").alias("m"))
    reached = ends.union(last).where(F.length("other") >= SHORTEST).join(terminals, "other").select("word", "n", "other", "m")
    gaps = at.select("id", "word", "n", F.struct("i", F.concat(before, after).alias("rest")).alias("gap"))
    members = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "word")))  # one for each letter at most
    bucket = gaps.groupBy("gap").agg(members.alias("all")).where(F.size("all") > 1)
    each = bucket.select((F.size("all") - 1).cast("long").alias("size"), F.col("all")[0].alias("a"), F.col("all")[1].alias("b"), F.explode("all").alias("own"))
    best = F.when(F.col("own.word") == F.col("a.word"), F.col("b")).otherwise(F.col("a"))
    buckets = each.select(F.col("own.word").alias("word"), (-F.col("own.less")).alias("n"), "size", best.alias("other"))
    return reached, buckets.select("word", "n", "size", F.col("other.word").alias("best"), (-F.col("other.less")).alias("m"))


def rooted(forms: DataFrame) -> DataFrame:
    """word and root: the last form reached. Frequencies at least double from form to form, so the steps are few, and each doubles their length."""
    at = common.saved(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        after = common.saved(at.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "spelling-roots")
        common.dropped(at)
        at = after.select("word", "root")
        if after.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, spoiled: int = SPOILED) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word. ``spoiled`` 0 counts words as they are written."""
    words = common.saved(counted(docs, spoiled).select(F.monotonically_increasing_id().alias("id"), "word", "n"), "spelling-words", batch=2000)
    reached, buckets = near(words)
    one = reached.select("word", "n", F.lit(1).cast("long").alias("size"), F.col("other").alias("best"), "m")
    other = reached.select(F.col("other").alias("word"), F.col("m").alias("n"), F.lit(1).cast("long").alias("size"), F.col("word").alias("best"), F.col("n").alias("m"))
    sides = one.union(other).union(buckets)
    most = F.min(F.struct((-F.col("m")).alias("less"), "best"))
    found = sides.groupBy("word").agg(F.sum("size").alias("n_near"), most.alias("most"))
    found = found.select("word", "n_near", F.col("most.best").alias("best"), (-F.col("most.less")).alias("m"))
    joined = words.select("word", "n").join(found, "word", "left")
    enough = F.col("m") >= TIMES * F.col("n")
    named = common.saved(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best")).alias("form"), F.when(enough, F.col("m")).alias("form_n")), "spelling-forms")
    roots = rooted(named.where("form IS NOT NULL"))
    out = named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    common.dropped(words)
    return out


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(common.documents(spark, sf_dir))
