"""BPE by automaton: merges compiled by successive gadgets, words encoded by table-driven transitions.

The automaton reads token labels and accepts exactly the token sequences that byte-pair encoding yields. It
starts as one state that loops on every byte. The gadget of a merge (u, v) gives u's target a copy that lacks
the arc v, moves all arcs u to that copy, and adds, to every state with an arc u, an arc uv to v's former
target. So each token has one target state, a state is its parent's arcs up to a time less the arcs that its own
later merges took away, and an arc t leaves a state if no element of t's left spine was taken from it before the
merge that covers that element. The arc of a merge whose pair can no longer occur is never added.

The labels of arcs are byte strings, so over bytes the automaton has many paths at once. It is made deterministic: a state of the table is
the set of (state that an arc leaves, place inside the arc's label) that the bytes so far may have led to, and exactly one token
ends at each byte. The table of transitions is compiled over the labels of all tokens when it is built; a transition that a text needs
beyond them is compiled when it is first met. Encoding steps through the table byte by byte and reads the path back from its end.
Decoding emits the labels of the arcs.

Defined results: a null text is encoded as the empty text: no ids, the hash of nothing. Repeated rows are encoded
each; further columns are ignored; an empty table gives an empty result. Texts of any length are encoded whole: words
go through one at a time, and the table of words met is emptied at a fixed size, as is the table of transitions.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from dayline.llm import common, presplit

#: Words whose ids a worker remembers.
MEMORY_WORDS = 400_000
#: Transitions at which the table is compiled anew.
TRANSITIONS = 1_500_000
#: Bits of a token's number in a member of a state.
TOKEN_BITS = 24
NEVER = 1 << 30


def byte_of_char() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte, and its byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Automaton:
    """States and arcs for a list of merges (left id, right id, merged id) over single-byte tokens."""

    def __init__(self, byte_ids: dict[int, int], merges: list[tuple[int, int, int]], size: int):
        self.label: list[bytes] = [b""] * size
        self.left = [-1] * size
        self.right = [-1] * size
        #: When a token's arc was added.
        self.born = [NEVER] * size
        #: Of a token's target state: the arcs taken from it, and when.
        self.taken: list[dict[int, int]] = [{} for _ in range(size)]
        self.arc: dict[bytes, int] = {}
        for b, t in byte_ids.items():
            self.label[t], self.born[t] = bytes([b]), -1
            self.arc[self.label[t]] = t
        for time, (u, v, merged) in enumerate(merges):
            self.gadget(u, v, merged, time)
        self.spelled()
        self.compiled()

    def gadget(self, u: int, v: int, merged: int, time: int) -> None:
        label = self.label[u] + self.label[v]
        if self.born[u] == NEVER or self.born[v] == NEVER:
            raise ValueError("a merge comes before its parts")
        if not self.has_arc(u, v, time):
            return
        self.taken[u][v] = time
        if self.born[merged] == NEVER:
            self.label[merged], self.left[merged], self.right[merged], self.born[merged] = label, u, v, time
            self.arc[label] = merged

    def has_arc(self, state: int, token: int, now: int = NEVER) -> bool:
        """Whether token's arc leaves state's target at a time: no part of its left spine was taken before it was covered."""
        limit = now
        while state >= 0:
            part, covered = token, now
            taken = self.taken[state]
            while part >= 0:
                when = taken.get(part, NEVER)
                if when < limit and when <= covered and when < now:
                    return False
                covered = self.born[part]
                part = self.left[part]
            limit = min(limit, self.born[state])
            state = self.right[state]
        return True

    def spelled(self) -> None:
        """The labels of all arcs as a tree of bytes: its places, where they lead, and the token that ends there."""
        self.child: dict[int, int] = {}
        self.token, self.inner = [-1], [True]
        for label, token in self.arc.items():
            place = 0
            for b in label:
                self.inner[place] = True
                step = place << 8 | b
                if step not in self.child:
                    self.child[step] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                place = self.child[step]
            self.token[place] = token

    def compiled(self) -> None:
        """The table over the bytes of all labels. State 0 is the start of a word."""
        self.moves: dict[int, int] = {}
        self.members: list[tuple[int, ...]] = [(0,)]
        self.ends = [-1]
        self.numbers = {self.members[0]: 0}
        for label in self.arc:
            self.path(label)

    def move(self, state: int, b: int) -> int:
        """Compile the transition of a state under a byte. A member is a place in the tree and, from 1, the token before it; 0 at the start."""
        members, found = [], -1
        for x in self.members[state]:
            place = self.child.get(x >> TOKEN_BITS << 8 | b)
            if place is None:
                continue
            source = x & ((1 << TOKEN_BITS) - 1)
            token = self.token[place]
            if token >= 0 and found < 0 and self.has_arc(source - 1, token):
                found = token
            if self.inner[place]:
                members.append(place << TOKEN_BITS | source)
        if found < 0:
            raise ValueError(f"no path of the automaton goes on with byte {b}")
        key = (*members, found + 1)
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.members)
            self.members.append(key)
            self.ends.append(found)
        self.moves[state << 8 | b] = number
        return number

    def path(self, word: bytes) -> list[int]:
        """The state of the table after each byte."""
        moves, state, out = self.moves, 0, []
        for b in word:
            then = moves.get(state << 8 | b)
            state = self.move(state, b) if then is None else then
            out.append(state)
        return out

    def encode(self, word: bytes) -> list[int]:
        if len(self.moves) > TRANSITIONS:
            self.compiled()
        states, ends, label = self.path(word), self.ends, self.label
        n, out = len(word), []
        while n:
            token = ends[states[n - 1]]
            out.append(token)
            n -= len(label[token])
        return out[::-1]


class Codec:
    """Splitting, the automaton and the memory of words met; whole texts in, little-endian ids out, and back."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model, byte = spec["model"], byte_of_char()
        vocab = model["vocab"]
        added = {x["content"]: x["id"] for x in spec.get("added_tokens") or []}
        size = max([*vocab.values(), *added.values()]) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.automaton = Automaton({b: vocab[c] for c, b in byte.items() if c in vocab}, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], size)
        self.special = {k: np.uint32(v).tobytes() for k, v in added.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.memory: dict[str, bytes] = {}
        labels = list(self.automaton.label)
        for k, v in added.items():
            labels[v] = k.encode()
        self.labels = labels

    def encode(self, text: str) -> bytes:
        if self.cut and any(s in text for s in self.special):
            return b"".join(self.special.get(part) or self._plain(part) for part in self.cut.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        words, memory = presplit.words(text), self.memory
        try:
            return b"".join([memory[w] for w in words])
        except KeyError:
            pass
        if len(memory) > MEMORY_WORDS:
            memory.clear()
        for w in words:
            if w not in memory:
                memory[w] = np.array(self.automaton.encode(w.encode("utf-8", "replace")), dtype="<u4").tobytes()
        return b"".join([memory[w] for w in words])

    def decode(self, ids: bytes) -> str:
        labels = self.labels
        return b"".join([labels[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")


_loaded: dict[str, Codec] = {}


def codec(file: str) -> Codec:
    """One codec for a file in each Python worker."""
    if file not in _loaded:
        _loaded[file] = Codec(file)
    return _loaded[file]


def default_file() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


CODES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)
DIGESTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)


def encoded(docs: DataFrame, file: str | None = None) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit) of each row."""
    file = file or default_file()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(file)
        for batch in batches:
            ids = [c.encode(t or "") for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_tokens": [len(i) // 4 for i in ids], "ids": ids})

    return docs.select("doc_id", "text").mapInPandas(run, CODES)


def digested(docs: DataFrame, file: str | None = None) -> DataFrame:
    """As encoded(), with hashes in place of the ids and the decoded text: what leaves a worker stays small."""
    file = file or default_file()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(file)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                ids = c.encode(text or "")
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids).encode("utf-8")).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy(dtype=object))
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select("doc_id", "text").mapInPandas(run, DIGESTS)


def op7_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(common.documents(spark, sf_dir))
