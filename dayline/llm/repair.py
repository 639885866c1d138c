"""Token-id shards compressed by a Re-Pair grammar, with random access to each document.

Rows are dealt to shards by ranges of doc_id. A task turns its documents, in order, into ids and closes a shard at
about ``SHARD_IDS`` ids. In a shard, pairs of neighbouring symbols that occur often are replaced by new symbols, the most
frequent first, round after round, until no rule would save space; overlapping occurrences go to the more frequent pair. A shard is one row of a Parquet table: rules (left, right and expansion length of each new symbol), the
compressed sequence, and the doc_ids and token counts of its documents. A document is decoded alone by the
running expansion lengths of the sequence and its own place in them.

A shard knows the ids before it in its partition; the partitions' totals, one small row each, give the ids before a partition.

Defined results: a null text is the empty text and has the end id only; a null doc_id comes first; rows with one doc_id come in
the order of their text hash; repeated rows are encoded each and may lie in several partitions; an empty table gives no shard and an empty result; further
columns are ignored.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from itertools import compress, islice, pairwise

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dayline.llm import common, presplit

SHARD_IDS = 1 << 19
#: Occurrences from which a rule saves space: each saves one id, and a rule is two symbols and a length.
LEAST = 4
END_ID = 2
#: Words in each of the two generations of a worker's memory.
MEMORY_WORDS = 500_000
#: Plain words that the library is given as one text: a space and letters up to the last that counts as plain.
JOINED, LAST_LATIN = 200, "\u017f"
LETTERS = "[" + "".join(c for c in map(chr, range(ord(LAST_LATIN) + 1)) if c.isalpha()) + "]+"
PLAIN = re.compile(" " + LETTERS)
#: Texts that are not cut at spaces: white space other than space and line feed, or beside a space.
UNCUT = r"[\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|  | \n|\n "
#: Bytes of text that are encoded at once, about.
BUNCH = 8 << 20


def _sorted_pairs(left: np.ndarray, right: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs in order, as left << 32 | right, and their places. One word holds a pair and its place where all three are small enough: words are sorted faster than places by them."""
    a, b = (int(x.max()).bit_length() for x in (right, place))
    if int(left.max()).bit_length() + a + b > 63:
        key = (left << 32) | right
        order = np.argsort(key)
        return key[order], place[order]
    packed = (((left << a) | right) << b) | place
    packed.sort()
    place = packed & ((1 << b) - 1)
    packed >>= b
    return ((packed >> a) << 32) | (packed & ((1 << a) - 1)), place


def repaired(ids: np.ndarray, first_symbol: int) -> tuple[np.ndarray, np.ndarray]:
    """The compressed sequence and the rules (rows of two symbols); rule k defines symbol first_symbol + k.

    Places are a linked list, and each keeps the rank of the pair that starts there. Only places next to a replacement are counted
    anew: a pair of older symbols never becomes more frequent, so a place whose pair is too rare is never looked at again.
    """
    n = len(ids)
    seq = ids.astype(np.int64)
    after, before = np.arange(1, n + 1), np.arange(-1, n)
    pair = np.full(n + 1, -1, np.int32)  # rank of the pair from a place; -1 where no rule can come from it
    keys = np.zeros(0, np.int64)
    none = np.iinfo(np.int32).max
    best = np.full(n + 2, none, np.int32)
    rules: list[np.ndarray] = []
    made, fresh = 0, np.arange(max(n - 1, 0))
    while True:
        if len(fresh):
            key, place = _sorted_pairs(seq[fresh], seq[after[fresh]], fresh)
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            times = np.diff(edge)
            enough = times >= LEAST
            pair[fresh] = -1
            pair[place[np.repeat(enough, times)]] = np.repeat(np.arange(len(keys), len(keys) + np.count_nonzero(enough), dtype=np.int32), times[enough])
            keys = np.concatenate([keys, key[edge[:-1][enough]]])
        at = np.flatnonzero(pair[:n] >= 0)
        p = pair[at]
        free = np.ones(len(at), bool)  # of a run of one pair with itself, every second place
        twin = np.flatnonzero((after[at[:-1]] == at[1:]) & (p[:-1] == p[1:])) + 1
        if len(twin):
            start = np.arange(len(at))
            start[twin] = 0
            free = (np.arange(len(at)) - np.maximum.accumulate(start)) % 2 == 0
        times = np.bincount(p[free], minlength=len(keys))
        often = np.flatnonzero(times >= LEAST)
        often = often[np.lexsort((keys[often], -times[often]))]  # most frequent first
        rank = np.full(len(keys), -1, np.int32)
        rank[often] = np.arange(len(often), dtype=np.int32)
        keys = keys[often]
        pair[at] = p = rank[p]
        free &= p >= 0
        at, p = at[free], p[free]
        if not len(at):
            break
        # of two overlapping occurrences the better ranked is replaced; the best rank loses none
        best[at] = p
        chosen = (p < best[before[at]]) & (p < best[after[at]])
        best[at] = none
        at, p = at[chosen], p[chosen]
        enough = np.bincount(p, minlength=len(keys)) >= LEAST
        at, p = at[enough[p]], p[enough[p]]
        used = keys[enough]
        rules.append(np.stack([used >> 32, used & 0xFFFFFFFF], axis=1))
        right = after[at]
        then = after[right]
        seq[at], seq[right] = first_symbol + made + (np.cumsum(enough) - 1)[p], -1
        after[at], before[then] = then, at
        pair[right] = pair[at] = -1
        made += len(used)
        left = before[at]
        fresh = np.sort(np.concatenate([left[left >= 0], at[then < n]]))
        fresh = fresh[np.append(fresh[:-1] != fresh[1:], True)] if len(fresh) else fresh
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    return seq[seq >= 0].astype(np.uint32), table.astype(np.uint32)


def expansion_lengths(rules: np.ndarray, first_symbol: int) -> np.ndarray:
    """How many ids each rule's symbol stands for; a rule only names symbols before its own."""
    high = rules >= first_symbol
    named = rules.astype(np.int64)[high] - first_symbol
    part = np.ones(rules.shape, np.int64)
    length = part.sum(axis=1)
    while len(named):  # as often as rules are nested
        part[high] = length[named]
        longer = part.sum(axis=1)
        if (longer == length).all():
            break
        length = longer
    return length


def expanded(seq: np.ndarray, rules: np.ndarray, first_symbol: int) -> np.ndarray:
    """The ids that a sequence stands for, all symbols one level down at a time."""
    seq = seq.astype(np.int64)
    pairs = rules.astype(np.int64)
    while True:
        high = seq >= first_symbol
        if not high.any():
            return seq.astype(np.uint32)
        place = np.cumsum(1 + high) - (1 + high)
        out = np.empty(len(seq) + int(high.sum()), np.int64)
        out[place[~high]] = seq[~high]
        rule = pairs[seq[high] - first_symbol]
        out[place[high]] = rule[:, 0]
        out[place[high] + 1] = rule[:, 1]
        seq = out


def whole(seq: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first_symbol: int) -> np.ndarray:
    """The same for a whole shard: every rule is expanded once, and symbols are copied from there by their lengths."""
    table = expanded(first_symbol + np.arange(len(rules)), rules, first_symbol)
    high = seq >= first_symbol
    rule = seq[high].astype(np.int64) - first_symbol
    size = np.ones(len(seq), np.int64)
    size[high] = long = lengths[rule].astype(np.int64)
    place = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint32)
    out[place[~high]] = seq[~high]
    within = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    out[np.repeat(place[high], long) + within] = table[np.repeat(starts[rule], long) + within]
    return out


def part(seq: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first_symbol: int, start: int, count: int) -> np.ndarray:
    """ids start to start + count of a shard: only the symbols that cover them are expanded."""
    size = np.where(seq < first_symbol, 1, lengths[np.maximum(seq.astype(np.int64) - first_symbol, 0)] if len(lengths) else 1)
    ends = np.cumsum(size)
    a = int(np.searchsorted(ends, start, side="right"))
    b = int(np.searchsorted(ends, start + count, side="left"))
    got = expanded(seq[a : b + 1], rules, first_symbol)
    skip = start - (int(ends[a] - size[a]) if a < len(ends) else 0)
    return got[skip : skip + count]


class Words:
    """The library's tokenizer word by word: each pre-split word is encoded once by it and remembered."""

    def __init__(self, file: str):
        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced = np.zeros(self.size, bool)  # ids whose bytes begin with a space, which the vocabulary writes as U+0120
        self.spaced[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith("\u0120")]] = True
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def codes(self, words: list[str]) -> list[bytes]:
        """The ids of each word; those not met before are given to the library together, each as often as it is listed."""
        if len(self.memory) > MEMORY_WORDS:
            self.older, self.memory = self.memory, {}
        out = list(map(self.memory.get, words))
        holes = [i for i, code in enumerate(out) if code is None]
        missing = [words[i] for i in holes]
        found = list(map(self.older.get, missing))
        new = [k for k, code in enumerate(found) if code is None]
        for k, code in zip(new, self._encoded([missing[k] for k in new]), strict=True):
            found[k] = code
        self.memory.update(zip(missing, found, strict=True))
        for i, code in zip(holes, found, strict=True):
            out[i] = code
        return out

    def encode(self, text: str) -> bytes:
        """The ids of one text."""
        if any(s in text for s in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(self.codes(presplit.words(text)))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; the words of all are looked up together."""
        special = [any(s in t for s in self.special) for t in texts]
        words = [[] if alone else presplit.words(t) for t, alone in zip(texts, special, strict=True)]
        distinct = list(dict.fromkeys(w for some in words for w in some))
        known = dict(zip(distinct, self.codes(distinct), strict=True))
        codes = (known[w] for some in words for w in some)
        return [self.encode(t) if alone else b"".join(islice(codes, len(some))) for t, alone, some in zip(texts, special, words, strict=True)]

    def _encoded(self, new: list[str]) -> Iterator[bytes]:
        """The ids of new words. Words of a space and Latin letters are encoded many as one text: the library parts them at the spaces, and only their first ids stand for a space."""
        is_plain = [PLAIN.fullmatch(w) is not None for w in new]
        plain, other = list(compress(new, is_plain)), [w for w, p in zip(new, is_plain, strict=True) if not p]
        joined = ["".join(plain[first : first + JOINED]) for first in range(0, len(plain), JOINED)]
        raw = array("I")
        for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False):
            raw.extend(e.ids)
        ids = np.array(raw, np.uint32)
        cuts = np.append(np.flatnonzero(self.spaced[ids]), len(ids)) * 4
        held = ids.tobytes()
        if len(cuts) != len(plain) + 1:
            raise ValueError("the vocabulary does not mark the first ids of words")
        parted = (held[a:b] for a, b in pairwise(cuts.tolist()))
        others = (array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(other, add_special_tokens=False))
        return (next(parted if p else others) for p in is_plain)


def gathered(table: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """table[start : start + size] of each, in a row."""
    ends = np.cumsum(size)
    return table[np.repeat(start - ends + size, size) + np.arange(int(size.sum()))]


class Pieces:
    """Ids of whole columns of texts. Texts are cut at their spaces, the distinct pieces of a column into words, and ids are gathered.

    A word never goes on over a space between two characters that are not white space, so a piece and the space before it are
    split alone. Texts with other white space beside a space, or with a special token, are one piece each.
    """

    def __init__(self, file: str):
        self.words = Words(file)
        self.uncut = "|".join([UNCUT, *(re.escape(s) for s in self.words.special)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each with its end id, and how many each text has."""
        texts = pc.fill_null(texts, "")
        single = pc.match_substring_regex(texts, self.uncut)
        lists = pc.split_pattern(pc.if_else(single, "", texts), " ")
        flat = lists.flatten()
        first = lists.offsets.to_numpy().astype(np.int64)
        first -= first[0]
        heads = flat.take(pa.array(first[:-1])).to_numpy(zero_copy_only=False).tolist()  # these have no space before them
        for i in np.flatnonzero(single.to_numpy(zero_copy_only=False)).tolist():
            heads[i] = texts[i].as_py()
        later = np.ones(len(flat), bool)
        later[first[:-1]] = False
        coded = flat.filter(pa.array(later)).dictionary_encode()
        table, start, size = self._pieces(coded.dictionary)
        number = np.empty(len(flat), np.int64)
        number[later] = coded.indices.to_numpy(zero_copy_only=False)
        number[first[:-1]] = len(size) + np.arange(len(heads))
        codes = self.words.encode_all(heads)
        more = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
        start = np.concatenate([start, len(table) + np.cumsum(more) - more])
        table = np.concatenate([table, np.frombuffer(b"".join(codes), "<u4")])
        size = np.concatenate([size, more])[number]
        ids = gathered(table, start[number], size)
        ends = np.concatenate([[0], np.cumsum(size)])[first[1:]]
        return np.insert(ids, ends, END_ID), np.diff(ends, prepend=0) + 1

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the place and number of those of each distinct piece, which has a space before it."""
        other = pc.match_substring_regex(pieces, presplit.OTHER).to_numpy(zero_copy_only=False)
        empty = pc.equal(pieces, "").to_numpy(zero_copy_only=False)
        simple = pc.match_substring_regex(pieces, f"^{LETTERS}$").to_numpy(zero_copy_only=False)
        # Latin letters, which are one word; the empty piece; those that the quick pattern can split; the rest
        order = np.argsort(np.where(simple, -2, other.astype(np.int8) - empty), kind="stable")
        alone, quick = (int(x) for x in (simple.sum(), (~other).sum()))
        words: list[str] = []
        for part in (order[alone:quick], order[quick:]):
            if len(part):
                words += presplit.words(" " + " ".join(pieces.take(pa.array(part)).to_numpy(zero_copy_only=False)))
        coded = pa.array(words, pa.string()).dictionary_encode()
        heads = np.concatenate([np.ones(alone, bool), pc.starts_with(coded.dictionary, " ").to_numpy(zero_copy_only=False)])
        number = np.concatenate([np.arange(alone), alone + coded.indices.to_numpy(zero_copy_only=False)])
        single = pc.binary_join_element_wise(" ", pieces.take(pa.array(order[:alone])), "")
        codes = self.words.codes([w for some in (single, coded.dictionary) for w in some.to_numpy(zero_copy_only=False).tolist()])
        lengths = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
        size = lengths[number]
        table = gathered(np.frombuffer(b"".join(codes), "<u4"), (np.cumsum(lengths) - lengths)[number], size)
        begins = (np.cumsum(size) - size)[heads[number]]  # only the first word of a piece has a space
        start = np.empty(len(pieces), np.int64)
        start[order] = begins
        held = np.empty(len(pieces), np.int64)
        held[order] = np.diff(begins, append=len(table))
        return table, start, held


_pieces: dict[str, Pieces] = {}


def pieces_of(file: str) -> Pieces:
    if file not in _pieces:
        _pieces[file] = Pieces(file)
    return _pieces[file]


def bunches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of batches in runs of about BUNCH bytes of text: short batches together, long ones cut."""
    held: list[pa.Table] = []
    room = BUNCH
    for batch in batches:
        table = pa.Table.from_batches([batch])
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = done = 0
        while at < len(ends):
            to = min(int(np.searchsorted(ends, done + room)) + 1, len(ends))
            held.append(table.slice(at, to - at))
            room -= int(ends[to - 1]) - done
            at, done = to, int(ends[to - 1])
            if room <= 0:
                yield pa.concat_tables(held).combine_chunks()
                held, room = [], BUNCH
    if held:
        yield pa.concat_tables(held).combine_chunks()


SHARDS = "place int, number int, before long, base int, n_ids long, doc_ids array<long>, n_tokens array<long>, rules binary, lengths binary, sequence binary"
SHARD_TYPES = pa.schema(
    [(c, pa.int32() if c in ("place", "number", "base") else pa.int64()) for c in ("place", "number", "before", "base", "n_ids")]
    + [(c, pa.list_(pa.int64())) for c in ("doc_ids", "n_tokens")]
    + [(c, pa.binary()) for c in ("rules", "lengths", "sequence")]
)


def written(docs: DataFrame, file: str, label: str = "token-shards") -> DataFrame:
    """Encode docs in order of doc_id into shards, as a table in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        pieces = pieces_of(file)
        base = pieces.words.size
        place, number, before, ids, doc_ids, counts, size = 0, 0, 0, [], [], [], 0

        def closed() -> pa.RecordBatch:
            seq, rules = repaired(np.concatenate(ids), base)
            lengths = expansion_lengths(rules, base)
            row = (place, number, before, base, size, doc_ids, counts, *(x.astype("<u4").tobytes() for x in (rules, lengths, seq)))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, SHARD_TYPES.types, strict=True)], schema=SHARD_TYPES)

        for bunch in bunches(batches):
            found, n_tokens = pieces.encode(bunch["text"].combine_chunks() if bunch.num_rows else pa.array([], pa.string()))
            names, ends, at = bunch["doc_id"].to_pylist(), np.cumsum(n_tokens), 0
            place = bunch["place"][0].as_py()
            while at < len(ends):
                if size >= SHARD_IDS:
                    yield closed()
                    number, before, ids, doc_ids, counts, size = number + 1, before + size, [], [], [], 0
                start = int(ends[at] - n_tokens[at])
                to = min(int(np.searchsorted(ends, start + SHARD_IDS - size)) + 1, len(ends))
                ids.append(found[start : ends[to - 1]])
                doc_ids += names[at:to]
                counts += n_tokens[at:to].tolist()
                size += int(ends[to - 1]) - start
                at = to
        if ids:
            yield closed()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"), F.monotonically_increasing_id().alias("at"))
    dealt = rows.repartitionByRange(parts, "doc_id", "th", "at").sortWithinPartitions("doc_id", "th", "at").select("doc_id", "text", F.spark_partition_id().alias("place"))
    return common.saved(dealt.mapInArrow(run, SHARDS), label, batch=1000)


def read(shards: DataFrame) -> DataFrame:
    """place, doc_id, at (ids before it in its place), n_tokens and ids of each document, from the files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in batch.itertuples(index=False):
                seq, rules = np.frombuffer(s.sequence, "<u4"), np.frombuffer(s.rules, "<u4").reshape(-1, 2)
                ids = whole(seq, rules, np.frombuffer(s.lengths, "<u4"), s.base)
                counts = np.array(s.n_tokens, np.int64)
                starts = np.cumsum(counts) - counts
                raw = ids.astype("<u4").tobytes()
                yield pd.DataFrame(
                    {
                        "place": s.place, "doc_id": pd.array([None if d is None or d != d else int(d) for d in s.doc_ids], dtype="Int64"), "at": s.before + starts, "n_tokens": counts,
                        "ids": [raw[4 * a : 4 * (a + n)] for a, n in zip(starts.tolist(), counts.tolist(), strict=True)],
                    }
                )

    return shards.mapInPandas(run, "place int, doc_id long, at long, n_tokens long, ids binary")


def op4_repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = written(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition that wrote shards
    bases = shards.groupBy("place").agg(F.sum("n_ids").alias("n")).select("place", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    docs = read(shards).select("place", "doc_id", "at", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return docs.join(F.broadcast(bases), "place").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
