"""Faults that a reviewer found, each with a small case that failed before."""

import hashlib
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from dayline.llm import language_id, pii, presplit, repair


def test_kinds_are_counted_wherever_they_stand(spark, tmp_path):
    texts = [None, "a@b.cd and 10.0.0.1 or 10.0.0.2", "10.0.0.1", "call +1 415 555 2671", "4111 1111 1111 1111 x a@b.cd c@d.ef", "no data"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = pii.op2_pii_boosting(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = [s for s in r.spans.split(",") if s]
        kinds = Counter(s.split(":")[0] for s in base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds[k] for k in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
    at = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in rows}
    assert at == {0: (0, 0, 0, 0), 1: (1, 2, 0, 0), 2: (0, 1, 0, 0), 3: (0, 0, 0, 1), 4: (2, 0, 1, 0), 5: (0, 0, 0, 0)}
    assert not re.search("[^0-9a-f]", rows[0].base_sha256)


def test_each_byte_is_read_once_in_each_direction(monkeypatch):
    """Texts that end were read on to the end of a stretch, so that a text of one byte cost 64 steps."""
    steps, read = language_id.GatedNetwork._steps, Counter()

    def counted(net, d, lanes):
        step = steps(net, d, lanes)

        def one(i):
            read[d] += len(i)
            return step(i)

        return one

    monkeypatch.setattr(language_id.GatedNetwork, "_steps", counted)
    rng = np.random.default_rng(4)
    raws = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (1, 300, 0, 64, 2, 129, 65, 1, 63, 300)]
    net = language_id.GatedNetwork(3)
    net.p["bias"] += np.array([0.5, -1, 1], np.float32)
    alone = np.stack([net.pooled([raw])[0] for raw in raws])
    for lanes in (1, 3, 4096):
        monkeypatch.setattr(language_id, "LANES", lanes)
        read.clear()
        np.testing.assert_allclose(net.pooled(raws), alone, atol=1e-6)
        assert read == dict.fromkeys("fb", sum(map(len, raws)))
    assert net.pooled([]).shape == (0, 3) and (net.pooled([b""]) == 0).all()
    net.p["bias"] += np.array([0, 0, 200], np.float32)
    np.testing.assert_allclose(net.pooled([b"far apart"]), [[0, 0, 1]], atol=1e-6)


def test_nested_rules_have_lengths_at_once_and_pairs_one_order():
    """Lengths took a step of Python a rule, and places were sorted by pairs."""
    first = 300
    rules = np.array([[1, 2], [300, 300], [301, 7], [302, 301], [9, 303]], np.uint32)
    assert repair.expansion_lengths(rules, first).tolist() == [2, 4, 5, 9, 10]
    assert repair.expansion_lengths(np.zeros((0, 2), np.uint32), first).tolist() == []
    rng = np.random.default_rng(6)
    for top in (5, 1 << 20, (1 << 31) - 1):  # the last does not fit one word with its place
        left, right = rng.integers(0, top, (2, 3000)).astype(np.int64)
        place = np.arange(0, 9000, 3)
        key, at = repair._sorted_pairs(left, right, place)
        assert (key[1:] >= key[:-1]).all() and sorted(at) == place.tolist()
        assert (key == (left << 32 | right)[at // 3]).all()


def test_new_words_have_the_ids_of_the_library():
    """Words of all kinds, listed twice, met before and not; plain ones are encoded as one text and parted at their spaces."""
    file = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(file)
    rng = np.random.default_rng(8)
    made = ["".join(rng.choice(list("abcdeéßñÀſªº'’ĠŁ漢1_.")) for _ in range(rng.integers(1, 9))) for _ in range(1500)]
    words = [w for text in (" ".join(made), "".join(f" {w}" for w in ("the", "Thé", "xyzzy", "don't"))) for w in presplit.words(text)]
    memory = repair.Words(file)
    steps = []
    fast = memory.tokenizer.encode_batch_fast
    memory.tokenizer = SimpleNamespace(encode_batch_fast=lambda texts, **how: (steps.append(len(texts)), fast(texts, **how))[1])
    for some in (words[:700] * 2, words, []):
        assert [np.frombuffer(c, "<u4").tolist() for c in memory.codes(some)] == [library.encode(w, add_special_tokens=False).ids for w in some]
    assert sum(steps) < len(set(words)) + 700  # one call of the library for many plain words
    texts = pa.array([" ".join(made), None, "", " a  b", "naïve Œuvre ªb 1a", "x\ty", "a<|endoftext|> b", "ab\ncd ef\n"])
    ids, sizes = repair.Pieces(file).encode(texts)
    whole = [[*library.encode(t or "", add_special_tokens=False).ids, repair.END_ID] for t in texts.to_pylist()]
    assert ids.tolist() == [i for some in whole for i in some] and sizes.tolist() == list(map(len, whole))
