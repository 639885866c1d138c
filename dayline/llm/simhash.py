"""SimHash near-dedup by bit-sliced comparison.

One pass over the texts gives each row a 64-bit fingerprint; equal fingerprints become one node. Two fingerprints within the
radius of two bits agree on two of any four blocks of bits, so a node is placed under each pair of its four blocks of 16 bits, and
nodes that share a place are compared. Places with more nodes than LARGE are not compared as a whole: their nodes are placed again
by pairs of four blocks of the bits that may still differ (32, then 16), until at most 2^8 fingerprints can share a place. So no task
meets a large group, and no pair within the radius is lost.

A comparison holds the nodes' bits vertically: plane b has bit b of 64 nodes in a word. Distances of a node to 64 others grow together in
two counters of one word each, to which a carry-save adder adds two planes at a time; a word whose 64 distances all exceed the radius is
abandoned. Places with few nodes are compared together in one sheet of planes, where a link found across places is a link all the same.
A sheet returns, for each of its connected nodes, one link to the smallest, and links join components.

Defined results: a null text, or one without words, has the fingerprint zero, linked like any other; a null doc_id has a fingerprint and
joins links, and its component_id is the smallest doc_id reachable, null if there is none; repeated rows, and one doc_id with several texts, are
rows of their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayline.llm import common
from dayline.llm.near_dup import components

BITS, RADIUS, SEED = 64, 2, 42
#: Nodes of a place up to which they are compared as one; nodes of a sheet that gathers small places; nodes compared at once.
LARGE, SHEET, ROWS = 4096, 512, 512
#: Planes added between two looks at which words are still of use.
LOOK = 4
_U = np.uint64
_FULL = ~_U(0)
#: For each byte value, its bits.
_BIT_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes | None, size: int) -> int:
    """A bit is one if it is set in over half of the hashes of all shingles of ``size`` words; A to Z count as lower case."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    raw = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    k = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    starts = (ends - lengths)[: len(words) - k + 1].tolist()
    hashes = np.array([digest(raw[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], "<u8")
    places = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(places[:, j], minlength=256) @ _BIT_OF for j in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """doc_id and f, the fingerprint as a signed long, of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "f": np.array([fingerprint(t, size) for t in batch["text"]], np.int64)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInPandas(run, "doc_id long, f long")


def near_pairs(nodes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Positions i < j of nodes whose fingerprints differ in at most ``radius`` (two or fewer) bits."""
    n = len(nodes)
    words = -(-n // 64)
    bits = np.unpackbits(nodes.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    order = np.argsort(np.abs(2 * ones - n), kind="stable")
    order = order[(ones[order] > 0) & (ones[order] < n)]  # where all agree nothing differs
    upright = np.zeros((BITS, words * 64), np.uint8)
    upright[:, :n] = bits.T
    planes = np.packbits(upright, axis=1, bitorder="little").view("<u8")
    spread = np.where(bits[:, order] == 1, _FULL, _U(0))
    planes = planes[order]
    found = []
    for first in range(0, n, ROWS):
        q = np.arange(first, min(n, first + ROWS))
        row, word = np.nonzero(np.arange(words)[None, :] >= (q // 64)[:, None])
        row = q[row]
        # What is over from the start: a node itself, those before it, and places beyond the last node.
        shift = np.where(word == row // 64, (row % 64 + 1).astype(_U), _U(0))
        over = np.where(shift == 64, _FULL, (_U(1) << (shift % _U(64))) - _U(1))
        if n % 64:
            over = np.where(word == words - 1, over | (_FULL << _U(n % 64)), over)
        low, high = np.zeros(len(row), _U), np.zeros(len(row), _U)
        for b in range(0, len(order), 2):
            x = planes[b][word] ^ spread[row, b]
            y = planes[b + 1][word] ^ spread[row, b + 1] if b + 1 < len(order) else np.zeros(len(row), _U)
            carry = (low & x) | (low & y) | (x & y)
            low = low ^ x ^ y
            over |= high & carry
            high |= carry
            if b % LOOK == LOOK - 2:
                live = ~(over | past(low, high, radius)) != 0
                if not live.any():
                    row = row[:0]
                    break
                if live.mean() < 0.75:
                    row, word, low, high, over = row[live], word[live], low[live], high[live], over[live]
        if len(row):
            left = ~(over | past(low, high, radius))
            at, place = np.nonzero(np.unpackbits(left.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            found.append((row[at], word[at] * 64 + place))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def past(low: np.ndarray, high: np.ndarray, radius: int) -> np.ndarray:
    """Where a count of at most three, in two words, exceeds the radius."""
    return (low & high, high, low | high)[2 - radius]


def stars(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A link from each connected node of a sheet to the smallest that it reaches there."""
    nodes = np.unique(nodes)
    i, j = near_pairs(nodes.view(_U))
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[i], root[j])
        after = root.copy()
        np.minimum.at(after, i, least)
        np.minimum.at(after, j, least)
        after = after[after]
        if (after == root).all():
            break
        root = after
    moved = root != np.arange(len(nodes))
    return nodes[root[moved]], nodes[moved]


def pair_masks(free: list[int]) -> list[list[int]]:
    """For each pair of the four blocks that ``free`` bits are cut into, the bits of the other two, which may still differ."""
    blocks = [free[i * len(free) // 4 : (i + 1) * len(free) // 4] for i in range(4)]
    return [sorted(blocks[i] + blocks[j]) for i, j in combinations(range(4), 2)]


def of_bits(bits: list[int]) -> int:
    """The mask of the bits, as a signed long."""
    return int(np.array([sum(1 << b for b in bits)], np.uint64).view(np.int64)[0])


def links(nodes: DataFrame) -> DataFrame:
    """a and b, links that connect all of what is within the radius. nodes: f, distinct."""

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sheet: list[np.ndarray] = []
            for at, place in enumerate(batch["nodes"]):
                sheet.append(np.asarray(place, np.int64))
                if sum(map(len, sheet)) >= SHEET or at == len(batch) - 1:
                    a, b = stars(np.concatenate(sheet))
                    yield pd.DataFrame({"a": a, "b": b})
                    sheet = []

    found, level = None, [list(range(BITS))]
    places = nodes.select("f", F.lit(of_bits(level[0])).alias("free"))
    while True:
        after = {of_bits(bits): pair_masks(bits) for bits in level}
        level = [m for masks in after.values() for m in masks]
        parts = F.create_map(*(x for key, masks in after.items() for x in (F.lit(key), F.array(*(F.lit(of_bits(m)) for m in masks)))))
        placed = places.select("f", F.explode(parts[F.col("free")]).alias("free"))
        placed = placed.select("f", "free", F.col("f").bitwiseAND(F.bitwise_not("free")).alias("key"))
        sizes = common.saved(placed.groupBy("free", "key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "simhash-places")
        shared = common.saved(placed.join(sizes, ["free", "key"]), "simhash-placed")
        last = len(level[0]) <= 8
        few = shared if last else shared.where(F.col("m") <= LARGE)
        groups = few.groupBy("free", "key").agg(F.collect_list("f").alias("nodes")).select("nodes")
        here = common.saved(groups.mapInPandas(compared, "a long, b long").distinct(), "simhash-links", batch=256)
        found = here if found is None else found.union(here)
        if last or shared.where(F.col("m") > LARGE).isEmpty():
            return found.distinct()
        places = shared.where(F.col("m") > LARGE).select("f", "free")


def grouped(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, f and component_id of each row."""
    rows = common.saved(fingerprints(docs, size), "simhash-rows", batch=2000)
    nodes = common.saved(rows.groupBy("f").agg(F.min("doc_id").alias("low")), "simhash-nodes")
    label = components(links(nodes))
    joined = nodes.join(label.select(F.col("node").alias("f"), "comp"), "f", "left").select("f", "low", F.coalesce("comp", "f").alias("comp"))
    alone = joined.where("comp = f")  # the root of a component, or a node without links
    least = joined.where("comp != f").groupBy("comp").agg(F.min("low").alias("other"))
    roots = alone.join(least, "comp", "left").select("comp", F.least("low", "other").alias("component_id"))
    named = joined.select("f", "comp").join(roots, "comp").select("f", "component_id")
    return rows.join(named, "f").select("doc_id", "f", "component_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grouped(common.documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id")
