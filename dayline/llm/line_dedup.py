"""Line dedup by pairwise alignment: shared rare hashes of lines find overlapping documents, patience diff aligns them.

A document is the sequence of its line hashes. A line alone may be as common as a closing brace, so it counts with its neighbours, whose
joint hash is rare: a window is the shortest run of lines, from a line with words on or up to one,
that has ``BLOCK_WORDS`` words; every line with words of a block of that size lies in a window inside the block. Each window that several
documents hold has an owner, the earliest of them, and a later document is paired with the owners of its windows: so every block that it shares with any
earlier document is found, and a window that a third of all rows share makes one pair for each of them with its owner, never all pairs.
Alignment of a pair is patience diff:
lines that occur once in both documents, kept where a longest increasing run orders them alike, then the same in each gap between them,
where equal lines at its ends are paired first. An aligned common block of at least ``BLOCK_WORDS`` words is deleted from the later document. What is left of
the later document is then aligned again, so that blocks which were moved or repeated are found. Blocks whose lines repeat so that no order can be had from them are found
by the windows that begin them, and compared line by line.

Words are runs without white space; a character of a script written without spaces is a word of its own.

Deletions do not hang on each other: a line is deleted if the documents as they came align on it. The earliest
document of a line never loses it.

Defined results: a null text stays null and an empty one empty, with no deletions; earlier means smaller doc_id, nulls first,
then the smaller text hash; repeated rows (same doc_id and text) share one decision and are not earlier than each other;
within one document nothing is deleted; all columns of the input come back, whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayline.llm import common

BLOCK_WORDS = 20
#: Rows with arrays of lines that a Python worker is handed at once.
LONG_ROWS = 500
#: Scripts written without spaces.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
#: Blocks of characters that hold all of these scripts, and others: only texts with such characters go through the slow pattern.
MAY_BE_UNSPACED = r"\u0E00-\u109F\u1780-\u17FF\u19E0-\u19FF\u2E80-\uD7FF\uA9E0-\uAA7F\uF900-\uFFFF\x{10000}-\x{10FFFF}"


def lines_of(text: str = "text") -> Column:
    return F.split(F.col(text), "\n", -1)


def word_counts(text: Column, lines: Column) -> Column:
    """The words of each line. In texts whose words are parted by one space each, spaces are counted; others go through the pattern."""
    pattern = rf"[{UNSPACED}]|[^{common.SPACE_CLASS}{UNSPACED}]++"
    odd_spaces = [F.contains(text, F.lit(x)) for x in ("  ", " \n", "\n ", "\t", "\x0b", "\x0c", "\r")]
    odd = F.startswith(text, F.lit(" ")) | F.endswith(text, F.lit(" ")) | ((F.octet_length(text) != F.length(text)) & text.rlike(rf"[{MAY_BE_UNSPACED}]"))
    for x in odd_spaces:
        odd = x | odd
    by_spaces = F.transform(lines, lambda x: F.when(x == "", 0).otherwise(F.length(x) - F.length(F.replace(x, F.lit(" "))) + 1))
    return F.when(odd, F.transform(lines, lambda x: F.regexp_count(x, F.lit(pattern)))).otherwise(by_spaces)


def outlined(docs: DataFrame) -> DataFrame:
    """row, and the arrays ``h`` (hash of each trimmed line) and ``w`` (its words), of each distinct row with text."""
    lines = docs.where(F.col("text").isNotNull()).select(common.row_key().alias("row"), "text", lines_of().alias("lines"))
    hashes = F.transform("lines", lambda x: F.xxhash64(F.trim(x)))
    return lines.select("row", hashes.alias("h"), word_counts(F.col("text"), F.col("lines")).alias("w"))


def windows(hashes: list[int], words: list[int]) -> dict[tuple[int, int], int]:
    """First and last line of each window, and the hash of its line hashes. A window has at most BLOCK_WORDS lines with words."""
    at = [i for i, n in enumerate(words) if n]
    spans = set()
    low = total = 0
    for high, last in enumerate(at):
        total += words[last]
        fit = -1
        while total >= BLOCK_WORDS:  # at[low] to at[high]: the shortest run from at[low] on
            spans.add((at[low], last))
            fit = low
            total -= words[at[low]]
            low += 1
        if fit < 0 and low and total + words[at[low - 1]] >= BLOCK_WORDS:
            fit = low - 1
        if fit >= 0:  # the shortest run up to this line
            spans.add((at[fit], last))
    return {(i, j): hash(tuple(hashes[i : j + 1])) for i, j in spans}


def overlapping(outline: DataFrame) -> DataFrame:
    """Pairs (first, later) of rows: later holds a window that first owns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = [sorted(set(windows(h.tolist(), w.tolist()).values())) for h, w in zip(batch["h"], batch["w"], strict=True)]
            out = pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "th": batch["th"], "held": held})
            yield out[out["held"].map(len) > 0]

    flat = outline.select("row.doc_id", F.col("row.h").alias("th"), "h", "w").mapInPandas(run, "doc_id long, th long, held array<long>")
    anchors = common.saved(flat.select(F.struct("doc_id", F.col("th").alias("h")).alias("row"), F.explode("held").alias("window")), "lines-windows", batch=LONG_ROWS)
    owners = anchors.groupBy("window").agg(F.min("row").alias("first"), F.max("row").alias("last"))
    owners = common.saved(owners.where("first != last").select("window", "first"), "lines-owners")
    pairs = anchors.join(owners, "window").where("row != first").select("first", F.col("row").alias("later")).distinct()
    pairs = common.saved(pairs, "lines-pairs")
    common.dropped(anchors, owners)
    return pairs


def aligned(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Patience diff of two sequences: the positions that it pairs, in order.

    Equal lines at both ends of a gap are paired. Of the rest, lines that occur once in both parts of the gap, where a longest increasing run
    orders them alike, are paired, and part it into smaller gaps, in which lines are counted anew. In a gap without such lines, the first
    occurrences of a line are held against each other, then the second, and so on.
    """
    out: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        i, m, j, n = gaps.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        once_b = _once(b, j, n)
        run = _increasing(sorted((x, once_b[line]) for line, x in _once(a, i, m).items() if line in once_b))
        if not run:
            again = _counted(b, j, n)
            run = _increasing(sorted((x, again[line]) for line, x in _counted(a, i, m).items() if line in again))
        for x, y in run:
            out.append((x, y))
            gaps.append((i, x, j, y))
            i, j = x + 1, y + 1
        if run:
            gaps.append((i, m, j, n))
    return sorted(out)


def _once(seq: list[int], low: int, high: int) -> dict[int, int]:
    """Place of each line that occurs once from low to high."""
    seen: dict[int, int] = {}
    for i in range(low, high):
        seen[seq[i]] = -1 if seq[i] in seen else i
    return {x: i for x, i in seen.items() if i >= 0}


def _counted(seq: list[int], low: int, high: int) -> dict[tuple[int, int], int]:
    """Place of each line and the number of its occurrence, from low to high."""
    seen: dict[int, int] = {}
    out = {}
    for i in range(low, high):
        seen[seq[i]] = seen.get(seq[i], 0) + 1
        out[seq[i], seen[seq[i]]] = i
    return out


def _increasing(anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of the anchors, sorted by their first place, whose second places increase."""
    tails: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(anchors):
        p = bisect_left(tails, j)
        tails[p : p + 1] = [j]
        at[p : p + 1] = [k]
        before.append(at[p - 1] if p else -1)
    run = []
    k = at[-1] if at else -1
    while k >= 0:
        run.append(anchors[k])
        k = before[k]
    return run[::-1]


def aligned_blocks(a: list[int], b: list[int], words: list[int]) -> set[int]:
    """Lines of b in aligned blocks (runs without a gap in either document) of at least BLOCK_WORDS words of b.

    What an alignment has paired is taken out of b, and what is left is aligned with a again, which finds blocks that were moved or repeated.
    The first alignment of the rest is made in any case, later ones while they find blocks.
    """
    gone: set[int] = set()
    left: list = list(b)
    rounds = 0
    while True:
        pairs = aligned(a, left)
        new: set[int] = set()
        block: list[int] = []
        last = (-2, -2)
        for i, j in [*pairs, (-9, -9)]:
            if (i, j) != (last[0] + 1, last[1] + 1):
                if sum(words[k] for k in block) >= BLOCK_WORDS:
                    new.update(block)
                block = []
            block.append(j)
            last = (i, j)
        gone |= new
        rounds += 1
        if not pairs or (rounds > 1 and not new):
            return gone
        for _, j in pairs:
            left[j] = (j,)  # equal to no line


def common_blocks(a: list[int], b: list[int], words: list[int]) -> list[int]:
    """aligned_blocks, and what alignment cannot order: of lines that repeat in either document, runs that begin like a window of a, compared line by line."""
    gone = aligned_blocks(a, b, words)
    left = {s: h for s, h in windows(b, words).items() if not gone.issuperset(range(s[0], s[1] + 1))}
    if left:
        known = dict(zip(b, words, strict=True))
        place: dict[int, int] = {}
        for (i, _), h in windows(a, [known.get(x, BLOCK_WORDS) for x in a]).items():  # equal lines have equal words; others are in no common window
            place.setdefault(h, i)
        for (i, j), h in left.items():
            at = place.get(h)
            if at is not None and a[at : at + j - i + 1] == b[i : j + 1]:
                gone.update(range(i, j + 1))
    return sorted(gone)


def deletions(docs: DataFrame) -> DataFrame:
    """row and ``gone``, the numbers of the lines to delete, of each row that loses lines."""
    outline = common.saved(outlined(docs).dropDuplicates(["row"]), "lines-outline")
    pairs = overlapping(outline)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            gone = [common_blocks(a.tolist(), b.tolist(), w.tolist()) for a, b, w in zip(batch["ha"], batch["hb"], batch["w"], strict=True)]
            out = pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "th": batch["th"], "gone": gone})
            yield out[out["gone"].map(len) > 0]

    first = outline.select(F.col("row").alias("first"), F.col("h").alias("ha"))
    later = outline.select(F.col("row").alias("later"), F.col("h").alias("hb"), "w")
    joined = pairs.join(later, pairs["later"].eqNullSafe(later["later"])).drop(later["later"])
    joined = joined.join(first, joined["first"].eqNullSafe(first["first"])).select("later.doc_id", F.col("later.h").alias("th"), "ha", "hb", "w")
    found = joined.mapInPandas(run, "doc_id long, th long, gone array<int>")
    rows = found.select(F.struct("doc_id", F.col("th").alias("h")).alias("row"), F.explode("gone").alias("line"))
    gone = common.saved(rows.groupBy("row").agg(F.collect_set("line").alias("gone")), "lines-gone", batch=LONG_ROWS)
    common.dropped(outline, pairs)
    return gone


def deduplicated(docs: DataFrame) -> DataFrame:
    """All columns of docs with the kept lines as text, and ``n_lines``, ``n_removed`` before them as struct ``line_dedup``."""
    gone = deletions(docs)
    keyed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("d"), common.row_key().alias("row"))
    both = keyed.join(gone.hint("merge"), keyed["row"].eqNullSafe(gone["row"]), "left").select("d", "gone")
    lines = F.split(F.col("d.text"), "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("gone"), i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("d.text")).otherwise(kept)
    stats = F.struct(F.when(F.col("d.text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
    stats = F.when(F.col("gone").isNull(), F.struct(stats["n_lines"].alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))).otherwise(stats)
    return both.select("d", text.alias("text"), stats.alias("line_dedup"))


def cleaned(docs: DataFrame) -> DataFrame:
    """docs with the kept lines as text."""
    return deduplicated(docs).select(*(F.col("text").alias("text") if c == "text" else F.col("d")[c].alias(c) for c in docs.columns))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(common.documents(spark, sf_dir))
    return out.select("d.doc_id", "line_dedup.n_lines", "line_dedup.n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))
