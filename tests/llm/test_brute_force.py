"""The training-data operators against brute force, on small tables and on odd ones."""

import random
import re
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from dayline.llm import bpe_automaton, common, exact_dedup, language_id, line_dedup, mixing, near_dup, nn_descent, pii, quality, repair

SF = "/root/testdata/sf0.001"
FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in common.documents(spark, SF).select("doc_id", "text").collect()}


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def components(texts, size, percent=80):
    sets = {i: shingles(t, size) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}, {i: len(s) for i, s in sets.items()}


def test_near_dup_equals_all_pairs(spark, texts):
    comp, n = components(texts, 4)
    rows = near_dup.op8_minhash_near_dedup(spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == {i: (n[i], comp[i], comp[i] == i) for i in texts}


def test_near_dup_in_blocks_equals_all_pairs(spark, monkeypatch):
    """A large band whose members are in many components: links come from blocks."""
    monkeypatch.setattr(near_dup, "SMALL", 3)
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    monkeypatch.setattr(near_dup, "ROUNDS", 1)
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(120)]
    made = {}
    for i in range(60):
        words = list(base)
        for at in rng.choice(120, 1 + i % 5, replace=False):
            words[at] = f"x{i}y{at}"
        made[i] = " ".join(words)
    comp, _ = components(made, 4)
    docs = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dup.grouped(docs, size=4).collect()} == comp


def test_near_dup_of_one_id_with_several_texts(spark):
    for size in (60, 70):
        a, b = (" ".join(f"{x}{i}" for i in range(n)) for x, n in (("a", 60), ("b", size)))
        rows = spark.createDataFrame([(1, a), (1, b), (2, a + " x"), (3, b + " y"), (1, a)], "doc_id long, text string")
        assert sorted((r.doc_id, r.component_id) for r in near_dup.grouped(rows, size=4).collect()) == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 1)]
        assert sorted(map(tuple, near_dup.one_of_each(rows).collect())) == [(1, a), (1, b)]
    rows = spark.createDataFrame([(1, a), (1, b), (0, b + " y")], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_dup.one_of_each(rows).collect()) == [0, 1]


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[ -]?[0-9])+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = True
            if kind == "ip":
                ok = all(int(p) <= 255 for p in m[0].split("."))
            if kind == "phone":
                ok = 8 <= len(digits) <= 15
            if kind == "card":
                v = [int(c) for c in digits[::-1]]
                ok = 16 <= len(v) <= 19 and (sum(v[0::2]) + sum(sum(divmod(2 * x, 10)) for x in v[1::2])) % 10 == 0
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans_equal_plain_patterns(spark, texts):
    rng = np.random.default_rng(3)
    pieces = ["a.b@c.org", "x@y", "@", ".", "-", " ", "10.0.0.1", "1.2.3.4.5", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111-", "+1 (555) 123-4567", "+", "12", "é", "漢", "q@w-.e_f.gh..i", "\n", "\x01", "+49.30.901820", "0"]
    made = {10_000 + i: "".join(rng.choice(pieces, rng.integers(1, 12))) for i in range(1500)} | texts
    docs = spark.createDataFrame([(i, t) for i, t in made.items()], "doc_id long, text string")
    got = {r.doc_id: r.s for r in pii.detected(docs).select("doc_id", pii.spelled(F.col("base")).alias("s")).collect()}
    assert got == {i: plain_spans(t or "") for i, t in made.items()}


def test_line_dedup_of_exact_copies_and_of_scattered_owners(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(12)) for x in "abc")
    rows = [(1, a), (2, b), (3, c), (4, f"{a}\n{b}\n{c}"), (5, f"{a}\n{b}\n{c}\ntail"), (6, f"{a}\n{b}\n{a}\n{b}"), (7, f"{a}\n{b}\n{a}\n{b}")]
    got = {r.doc_id: r.text for r in line_dedup.cleaned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[4] == rows[3][1] and got[5] == "tail" and got[7] == ""
    assert line_dedup.aligned([1, 2, 1, 2], [1, 2, 1, 2]) == [(i, i) for i in range(4)]
    assert line_dedup.aligned([7, 5, 2, 5, 8], [9, 5, 2, 5, 0]) == [(1, 1), (2, 2), (3, 3)]


def test_patience_diff_pairs_what_repeats_between_anchors_and_what_moved():
    """Lines 1 to 9 are unique, 20 has 25 words; alone, without the windows that come after."""
    size = lambda b: [25 if x == 20 else 12 if x in (30, 31) else 1 for x in b]
    a, b = [1, 4, 20, 5, 2, 6, 20, 7, 3], [1, 41, 20, 51, 2, 61, 20, 71, 3]
    assert line_dedup.aligned_blocks(a, b, size(b)) == {2, 6}  # twice in both, once in each gap
    a, b = [1, 2, 3, 4, 30, 31], [30, 31, 1, 2, 3, 4]
    assert line_dedup.aligned_blocks(a, b, size(b)) == {0, 1}  # moved: found when the rest is aligned
    a, b = [30, 31, 5], [30, 31, 6, 30, 31]
    assert line_dedup.aligned_blocks(a, b, size(b)) == {0, 1, 3, 4}  # repeated
    assert line_dedup.aligned_blocks([30, 7, 31], [30, 8, 31], [12, 1, 12]) == set()  # a gap parts it
    rng = np.random.default_rng(0)
    for _ in range(50):
        blocks = [[100 * k + i for i in range(int(rng.integers(1, 6)))] for k in range(6)]
        a = [x for k in range(6) for x in (*blocks[k], 1000 + k)]
        order = rng.permutation(6)
        b = [x for k in order for x in (*blocks[k], 2000 + k)]
        words = [0 if x >= 1000 else -(-20 // len(blocks[x // 100])) for x in b]
        assert line_dedup.aligned_blocks(a, b, words) == {i for i, x in enumerate(b) if x < 1000}


def test_shards_hold_the_ids_of_the_library(spark, texts):
    t = Tokenizer.from_file(FILE)
    t.no_truncation()
    t.no_padding()
    rows = {r.doc_id: r for r in repair.op4_repair_shards(spark, SF).collect()}
    import zlib

    start = 0
    for i in sorted(texts):
        ids = [*t.encode(texts[i] or "", add_special_tokens=False).ids, repair.END_ID]
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def plain_repair(ids, first):
    """The most frequent pair, counted without overlap, replaced from the left until none occurs four times."""
    seq, rules = list(ids), 0
    while True:
        counts, last = {}, {}
        for i in range(len(seq) - 1):
            p = (seq[i], seq[i + 1])
            if last.get(p) != i - 1 or p[0] != p[1]:
                counts[p] = counts.get(p, 0) + 1
                last[p] = i
        if not counts or max(counts.values()) < 4:
            return len(seq) + 2 * rules
        best = min(counts, key=lambda p: (-counts[p], p))
        out, i = [], 0
        while i < len(seq):
            if i + 1 < len(seq) and (seq[i], seq[i + 1]) == best:
                out.append(first + rules)
                i += 2
            else:
                out.append(seq[i])
                i += 1
        seq, rules = out, rules + 1


def test_repair_is_about_as_small_as_one_pair_at_a_time():
    rng = np.random.default_rng(5)
    for x in (rng.zipf(1.5, 3000) % 60, np.tile(rng.integers(0, 50, 90), 30), np.full(500, 3)):
        seq, rules = repair.repaired(x.astype(np.uint32), 100)
        assert len(seq) + 2 * len(rules) <= 1.05 * plain_repair(x.tolist(), 100) + 8


def test_language_gradients_and_held_out_rows(spark):
    net = language_id.GatedNetwork(3, hidden=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(2)
    at, label = rng.integers(97, 101, (7, 5)), rng.integers(0, 3, 5)
    _, grads = net.gradients(at, label, 3)
    for name, g in grads.items():
        place = np.unravel_index(np.abs(g).argmax(), g.shape)
        ends = []
        for step in (1e-3, -2e-3):
            net.p[name][place] += step
            ends.append(net.gradients(at, label, 3)[0])
        net.p[name][place] += 1e-3
        assert abs((ends[0] - ends[1]) / 2e-3 - g[place]) < 2e-2 * abs(g[place]) + 1e-4, name
    docs = common.documents(spark, SF)
    found = language_id.op3_language_gru(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred != 'und'")
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count(F.lit(1))).first()
    assert n > 20 and right >= 0.9


def test_language_takes_every_label_and_reads_whole_texts(spark, monkeypatch):
    """Texts of very different lengths side by side, in stretches, equal each text read alone from end to end."""
    docs = spark.createDataFrame([(i, f"text {i} of {i % 90}", f"l{i % 90}") for i in range(1800)], "doc_id long, text string, lang string")
    assert language_id.sampled(docs).select("lang").distinct().count() == 90
    net = language_id.GatedNetwork(3)
    rng = np.random.default_rng(1)
    raws = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in (3000, 1, 64, 65, 700, 128)] + [b"", b"x" * 500]
    for stretch in (64, 7, 5000):
        monkeypatch.setattr(language_id, "STRETCH", stretch)
        got = net.pooled(raws)
        for raw, p in zip(raws, got, strict=True):
            if not raw:
                assert (p == 0).all()
                continue
            at = np.frombuffer(raw, np.uint8)[:, None]
            y = net.logits(net.states(at, "f")[0], net.states(at, "b")[0])[:, 0]
            e = np.exp(y - y.max(axis=1, keepdims=True))
            np.testing.assert_allclose(p, (e / e.sum(axis=1, keepdims=True)).mean(axis=0), atol=2e-5)


def test_language_results_do_not_depend_on_who_waits(spark, monkeypatch):
    net = language_id.GatedNetwork(2)
    rows = [(i, "word " * (i * i % 700 + 1)) for i in range(60)] + [(None, "nobody"), (7, None), (8, "12 34")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = sorted(map(str, language_id.identified(docs.coalesce(1), ["de", "en"], net).collect()))
    monkeypatch.setattr(language_id, "TOGETHER", 3000)
    monkeypatch.setattr(language_id, "LONG", (100, 900))
    few = [r.asDict() for r in language_id.identified(docs, ["de", "en"], net).collect()]
    assert len(few) == len(rows) and [r["lang_pred"] for r in few if r["doc_id"] in (None, 8)].count("und") == 1
    assert [r.split("score")[0] for r in one] == sorted(str(r).split("score")[0] for r in language_id.identified(docs, ["de", "en"], net).collect())


def test_quality_equals_a_dense_discriminant(spark, texts):
    labels = common.table(spark, SF, "labels")
    got = {r.doc_id: r for r in quality.op9_quality_discriminant(spark, SF).collect()}
    marks = {r.doc_id: r.quality for r in labels.collect()}
    import zlib

    out = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in texts}
    assert all(got[i].held_out == out[i] for i in texts)
    train = [i for i in sorted(texts) if i in marks and not out[i]]
    x, y = np.stack([quality.statistics(texts[i]) for i in train]), np.array([marks[i] for i in train])
    own = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    pooled = sum((y == c).mean() * own[c] for c in (0, 1))
    z = np.stack([quality.statistics(texts[i]) for i in texts])
    density = []
    for c in (0, 1):
        s = (1 - quality.POOL) * own[c] + quality.POOL * pooled
        s = (1 - quality.DIAGONAL) * s + quality.DIAGONAL * np.diag(np.diag(s)) + 1e-4 * np.eye(len(s))
        d = z - x[y == c].mean(axis=0)
        density.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) - 0.5 * np.linalg.slogdet(s)[1])
    at = quality.TEMPER * (density[1] - density[0]) + np.log(y.mean() / (1 - y.mean()))
    want = 1 / (1 + np.exp(-np.clip(at, -30, 30)))
    np.testing.assert_allclose([got[i].score for i in texts], want, atol=1e-6)
    held = [i for i in texts if out[i] and i in marks]
    assert np.mean([got[i].predicted == marks[i] for i in held]) >= 0.85


def test_mixing_equals_a_dense_projected_gradient(spark):
    rng = np.random.default_rng(6)
    p = rng.dirichlet([0.4, 0.4, 0.4], 120)
    tokens = rng.integers(5, 400, 120)
    members = spark.createDataFrame([(i, 0, int(t), [float(v) for v in row]) for i, (t, row) in enumerate(zip(tokens, p, strict=True))], "doc_id long, h long, tokens long, p array<double>")
    goal = {"a": 0.5, "b": 0.1, "c": 0.6}
    pulls = mixing.fitted(members, mixing.Membership(["a", "b", "c"], [0.3, 0.3, 0.4], None), goal)
    got = np.array([r.r for r in members.select("doc_id", mixing.rate(pulls).alias("r")).orderBy("doc_id").collect()])
    w, target, rate = tokens / tokens.sum(), np.array([0.5, 0.1, 0.6]), np.ones(120)
    for _ in range(200_000):
        rate = np.maximum(0, rate - 0.5 * (p @ (p.T @ (w * rate) - target) + mixing.RIDGE * (rate - 1)))
    np.testing.assert_allclose(got, rate, atol=2e-3)
    with pytest.raises(ValueError, match="domains"):
        mixing.fitted(members, mixing.Membership(["a", "b", "c"], [0.3, 0.3, 0.4], None), {"z": 1.0})


def test_nearest_of_few_vectors(spark):
    types = "vec_id long, embedding array<float>"
    rows = [(0, [1.0, 0.0]), (1, [0.6, 0.8]), (2, [0.6, 0.8]), (3, [float("inf"), 1.0]), (4, None), (50, [1.0, 0.0])]
    got = nn_descent.nearest(spark.createDataFrame(rows, types), F.col("vec_id") % 50 == 0).toPandas().sort_values(["query_id", "rank"])
    assert got[got.query_id == 0].vec_id.tolist() == [50, 1, 2] and got[got.query_id == 50].vec_id.tolist() == [0, 1, 2]
    assert abs(got.score.iloc[1] - 0.6) < 1e-7
    assert nn_descent.nearest(spark.createDataFrame([], types), F.col("vec_id") % 50 == 0).count() == 0
    clash = spark.createDataFrame([(i, [float(i), 1.0], i, "x") for i in range(8)], types + ", node long, v string")
    assert nn_descent.nearest(clash, F.col("vec_id") == 0).count() == 5


def test_queries_that_share_a_vector(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-9, 9, 6)]) for i in range(1, 121)]
    rows += [(1000 + i, rows[0][1]) for i in range(80)]
    got = nn_descent.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") >= 60).toPandas()
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sims = x @ x.T
    np.fill_diagonal(sims, -9)
    want = {int(q): set(ids[np.lexsort((ids, -s.round(9)))[:5]].tolist()) for q, s in zip(ids, sims, strict=True) if q >= 60}
    assert sorted(got.groupby("query_id")["rank"].apply(lambda r: sorted(r)).to_dict().items()) == [(q, [1, 2, 3, 4, 5]) for q in sorted(want)]
    found = got.groupby("query_id")["vec_id"].apply(set)
    assert all(found[1000 + i] == want[1000 + i] for i in range(80)) and np.mean([len(found[q] & w) / 5 for q, w in want.items()]) >= 0.9


ODD = [
    (1, None), (2, ""), (3, "ab" * 60_000), (4, " ".join(f"w{i}" for i in range(20_000))), (5, " ".join(f"w{i}" for i in range(20_000)) + " end"), (6, "line of a few words\n" * 4000),
    (7, "same text twice " * 10), (7, "same text twice " * 10), (8, "same text twice " * 10), (None, "nobody's text"), (9, "\x01\x00 \x0b odd"), (10, "+1 555 123 4567 " * 300),
]
ODD_TYPES = "doc_id long, text string, lang string, source string, n_chars long, row_ string, copies_ int, copy_ int, row string, h long, th long, at long, place int, gone string, d string, comp string, rep long, x double, rate double, tokens long, found string, base string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if k % 3 == 2 else "en" if k % 2 else "de", None, None, "r", 1, 2, "w", 3, 4, 5, 6, "g", "d", "c", 7, 0.5, 0.1, 8, "f", "b") for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, ODD_TYPES)


LABELS = [(1, 0), (2, 0), (4, 1), (5, 1), (7, None), (None, 1), (99, 1)]


def test_odd_rows_have_results_everywhere(spark, odd):
    """Nulls in every column, long and repeated texts, one word of 120,000 characters, and columns with clashing names."""
    n, labels = len(ODD), spark.createDataFrame(LABELS, "doc_id long, quality int")
    assert exact_dedup.exact_dedup(odd).count() == n
    assert near_dup.grouped(odd).count() == n
    assert {r.doc_id: r.component_id for r in near_dup.grouped(odd).collect() if r.doc_id}[5] == 4
    assert pii.detected(odd).count() == n
    assert quality.scored(odd, labels).count() == n
    assert language_id.identified(odd, *language_id.learned(odd)).count() == n
    assert mixing.rated(odd).count() == n
    assert repair.read(repair.written(odd, FILE)).count() == n
    assert line_dedup.deduplicated(odd).count() == n
    t = Tokenizer.from_file(FILE)
    for r in bpe_automaton.encoded(odd).where("doc_id IN (3, 9, 10)").collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == t.encode(dict(ODD)[r.doc_id], add_special_tokens=False).ids


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_the_columns_of_odd_and_empty_tables(spark, odd, name, tmp_path):
    stage = dict(corpus_pipeline.STAGES)[name]
    spark.createDataFrame(LABELS, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    out = stage(spark, odd, str(tmp_path))
    assert out.columns == odd.columns
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert ids <= {i for i, _ in ODD}
    none = stage(spark, odd.where("false"), str(tmp_path))
    assert none.columns == odd.columns and none.count() == 0


def test_pipeline_against_brute_force(spark, texts):
    """Each stage on what the one before it kept: rejected documents, deleted lines, one of each component, copies, ids."""
    docs = common.documents(spark, SF)
    columns = docs.columns
    steps = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs = common.saved(docs, "test-stage")
        steps.append(docs)
    assert all(s.columns == columns for s in steps[:-1])
    good, lines, single, repeated, codes = steps
    scores = {r.doc_id: r.predicted for r in quality.op9_quality_discriminant(spark, SF).collect()}
    assert sorted(r.doc_id for r in good.collect()) == sorted(i for i in texts if scores[i])
    before = {r.doc_id: r.text for r in good.collect()}
    after = {r.doc_id: r.text for r in lines.collect()}
    assert before.keys() == after.keys()
    for i, text in after.items():
        kept = iter((before[i] or "").split("\n"))
        assert (text or "") == "" or all(any(line == x for x in kept) for line in text.split("\n"))  # a part of the lines, in order
    comp, _ = components(after, 5)
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i in after if comp[i] == i)
    copies = {r.doc_id: r.copies for r in mixing.rated(single).collect()}
    times = {r.doc_id: r["count"] for r in repeated.groupBy("doc_id").count().collect()}
    assert times == {i: n for i, n in copies.items() if n}
    t = Tokenizer.from_file(FILE)
    rows = codes.collect()
    assert len(rows) == sum(times.values())
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == t.encode(after[r.doc_id] or "", add_special_tokens=False).ids


def test_shard_columns_of_texts_equal_the_library():
    """Whole columns, encoded by pieces: white space of all kinds beside spaces, special tokens, several scripts, nulls, one huge text."""
    draw = random.Random(3)
    parts = ["a", "b é", "'s", " ", "  ", "\n", "\n ", "\t", "\u3000", "x-y", "12 ", "<|endoftext|>", "中文。", "I'm", ".", "\xa0", "\r\n", "\x1c", "\x85", "ǅ ", "", " a"]
    texts = ["".join(draw.choices(parts, k=draw.randrange(12))) for _ in range(4000)] + [None, "", "word " * 30_000, "x" * 50_000]
    pieces = repair.pieces_of(FILE)
    for table in (texts, texts[::-1], [None], []):
        ids, counts = pieces.encode(pa.array(table, pa.string()))
        ends = np.cumsum(counts)
        for text, first, last in zip(table, ends - counts, ends, strict=True):
            assert ids[first:last].tolist() == [*pieces.words.tokenizer.encode(text or "", add_special_tokens=False).ids, repair.END_ID], repr(text)


def test_shard_bunches_keep_all_rows_in_order():
    texts = ["a" * n for n in (5, 0, 20_000_000, 3, 9_000_000)] + [None] * 3
    batches = [pa.RecordBatch.from_pydict({"doc_id": list(range(i, i + 4)), "text": pa.array(texts[i : i + 4], pa.string())}) for i in (0, 4)]
    got = list(repair.bunches(iter(batches)))
    assert [d for b in got for d in b["doc_id"].to_pylist()] == list(range(8)) and len(got) > 1
    assert [t for b in got for t in b["text"].to_pylist()] == texts
