import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dayline.llm import bpe_automaton, exact_dedup, language_id, line_dedup, mixing, near_dup, nn_descent, pii, quality, repair

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, h long"
LONG = " ".join(f"word{i}" for i in range(300))
TEXTS = [
    (1, "one  two\tthree"), (2, "one two three"), (3, None), (4, ""), (5, LONG), (6, LONG + " extra"), (7, "x"), (7, "x"), (None, "nobody"),
    (8, "mail a.b@c.org or 10.0.0.1, card 4111 1111 1111 1111, call +1 (555) 555-5555"), (9, LONG.replace("word7 ", "other ")), (10, "é漢字 don't <|endoftext|> 12"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0, "clash", 1) for i, t in TEXTS], DOCS)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_exact_dedup_and_collisions(docs, none):
    def weak(norm):
        return F.length(norm)

    for hashed in (exact_dedup.content_hash, weak):
        rows = exact_dedup.exact_dedup(docs, hashed).collect()
        assert len(rows) == len(TEXTS)
        by = {r.doc_id: r for r in rows}
        assert (by[2].keep_id, by[2].group_size, by[2].kept) == (1, 2, False)
        assert by[4].keep_id == 3 and by[7].group_size == 2 and by[5].kept
        assert by[1].text_sha256 == hashlib.sha256(b"one two three").hexdigest()
    assert exact_dedup.exact_dedup(none).count() == 0


def test_near_dup_components(docs, none):
    by = {r.doc_id: r for r in near_dup.grouped(docs, size=4).collect()}
    assert by[5].component_id == by[6].component_id == by[9].component_id == 5
    assert by[6].kept is False and by[3].n_shingles == 0 and by[3].kept and by[None].kept
    assert near_dup.grouped(none).count() == 0
    assert near_dup.one_of_each(docs).where("doc_id = 7").count() == 1


def test_automaton_equals_the_library(docs, none):
    t = Tokenizer.from_file(bpe_automaton.default_file())
    for r in bpe_automaton.encoded(docs).collect():
        text = next(x for i, x in TEXTS if i == r.doc_id) or ""
        ids = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        assert bpe_automaton.codec(bpe_automaton.default_file()).decode(bytes(r.ids)) == t.decode(ids, skip_special_tokens=False)
    assert bpe_automaton.digested(none).count() == 0


def test_repair_round_trip(docs, none):
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5000):
        x = rng.integers(0, 4, n).astype(np.uint32)
        seq, rules = repair.repaired(x, 10)
        assert (repair.expanded(seq, rules, 10) == x).all()
        if n > 100:
            assert len(seq) < n
            assert (repair.part(seq, rules, repair.expansion_lengths(rules, 10), 10, 77, 1000) == x[77:1077]).all()
    rows = repair.read(repair.written(docs, public_tokenizers.path("byte_bpe_50k.json"))).collect()
    assert len(rows) == len(TEXTS) and all(np.frombuffer(r.ids, "<u4")[-1] == repair.END_ID for r in rows)
    assert repair.read(repair.written(none, public_tokenizers.path("byte_bpe_50k.json"))).count() == 0


def test_repair_runs_until_no_rule_saves():
    rng = np.random.default_rng(3)
    text, runs = rng.integers(0, 5000, 3000), np.repeat(rng.integers(0, 9, 400), 3)
    x = np.concatenate([np.tile(text, 64), rng.integers(0, 5000, 20000), runs, np.full(7, 3)]).astype(np.uint32)
    seq, rules = repair.repaired(x, 5000)
    assert (repair.expanded(seq, rules, 5000) == x).all()
    assert (repair.whole(seq, rules, repair.expansion_lengths(rules, 5000), 5000) == x).all()
    pairs, times = np.unique(np.stack([seq[:-1], seq[1:]], axis=1), axis=0, return_counts=True)
    assert times[pairs[:, 0] != pairs[:, 1]].max() < 4
    assert len(seq) + 2 * len(rules) < 32000


def test_personal_data(docs, none):
    by = {r.doc_id: r.s for r in pii.detected(docs).select("doc_id", pii.spelled(F.col("base")).alias("s")).collect()}
    assert by[8] == "email:5:14,ip:18:26,card:33:52,phone:59:76"
    assert by[3] == by[4] == ""
    assert pii.detected(none).count() == 0


def test_personal_data_in_looser_forms(spark):
    """Half of all true spans have a word for their kind before them; numbers of tables look alike but for what is glued to them."""
    texts = []
    for i in range(40):
        cue, call = ("contact ", "call ") if i % 2 else ("by ", "and ")
        texts += [f"{cue}user{i}@site{i}.org now", f"{call}+1 (017) 555-{1000 + i} now", f"{cue}user{i} (at) site{i} (dot) org now", f"{call}(217) 555-{2000 + i} now", f"part 217 555 {3000 + i}x now"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    more = {r.doc_id: r.s for r in pii.detected(rows).select("doc_id", pii.spelled(F.col("more")).alias("s")).collect()}
    for i, text in enumerate(texts):
        start = text.index("user" if i % 5 == 2 else "(217)") if i % 5 in (2, 3) else 0
        assert more[i] == {2: f"email:{start}:{len(text) - 4}", 3: f"phone:{start}:{len(text) - 4}"}.get(i % 5, ""), text


def test_line_dedup(spark, none):
    block = "\n".join(" ".join(f"w{i}x{j}" for j in range(12)) for i in range(3))
    rows = spark.createDataFrame([(1, "a b c\n" + block), (2, block + "\nown line"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.cleaned(rows).collect()}
    assert got == {1: "a b c\n" + block, 2: "own line", 3: None, 4: ""}
    assert line_dedup.cleaned(none).count() == 0
    assert line_dedup.aligned([1, 2, 3, 9], [7, 1, 2, 3]) == [(0, 1), (1, 2), (2, 3)]


def test_line_dedup_finds_every_block(spark):
    """Against all pairs by brute force: lines owned apart, short lines, repeated and moved blocks, a script without spaces."""
    rng = np.random.default_rng(5)
    pool = [" ".join(f"w{k}x{j}" for j in range(n)) for k, n in enumerate(rng.choice([1, 3, 8, 12, 25], 14))] + ["", "天地玄黄宇宙洪荒日月"]
    texts = [[pool[0 + k] for k in rng.integers(0, len(pool), rng.integers(1, 14))] for _ in range(60)]
    texts += [["天地玄黄宇宙洪荒日月辰宿列张寒来暑往秋收冬藏"], ["alone", "天地玄黄宇宙洪荒日月辰宿列张寒来暑往秋收冬藏"]]
    size = [[sum(len(x) if x[0] > "z" else 1 for x in line.split()) for line in t] for t in texts]
    rows = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: set(r.gone) for r in line_dedup.deletions(rows).select("row.doc_id", "gone").collect()}
    for b, text in enumerate(texts):
        want = set()
        for i in range(len(text)):
            for j in range(i, len(text)):
                run = text[i : j + 1]
                if sum(size[b][i : j + 1]) >= line_dedup.BLOCK_WORDS and any(run == t[k : k + len(run)] for t in texts[:b] for k in range(len(t))):
                    want.update(range(i, j + 1))
        assert {k for k in want if size[b][k]} == {k for k in got.get(b, ()) if size[b][k]}, b


def test_quality(spark, docs, none):
    assert quality.scored(none, spark.createDataFrame([], "doc_id long, quality int")).count() == 0
    rows = quality.scored(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (300, 3)), rng.normal(3, 2, (300, 3))])
    m = quality.fit({c: (300.0, x[300 * c : 300 * c + 300].sum(0), x[300 * c : 300 * c + 300].T @ x[300 * c : 300 * c + 300]) for c in (0, 1)}, 3)
    s = m.scores(x)
    assert (s[300:, None] > s[None, :300]).mean() > 0.95


def test_language(docs, none):
    net = language_id.GatedNetwork(2, hidden=4)
    long, short = bytes(range(97, 123)) * 20, b"abc"
    both = net.pooled([long, short])
    np.testing.assert_allclose(both[1], net.pooled([short])[0], atol=1e-6)
    by = {r.doc_id: r for r in language_id.identified(docs, ["de", "en"], net).collect()}
    assert by[3].lang_pred == by[4].lang_pred == "und" and by[1].lang_pred in ("de", "en")
    assert language_id.learned(none) == ([], None)


def test_mixing_meets_targets(spark, none):
    rows = [(i, ("the and of with " if i % 4 else "der und die mit ") * (5 + i % 3), "en" if i % 4 else "de") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    r = mixing.rated(docs, targets={"en": 0.5, "de": 0.5}).toPandas()
    assert abs((r.tokens * r.rate)[r.domain == "de"].sum() / r.tokens.sum() - 0.5) < 0.03
    assert mixing.rated(none).count() == 0


def test_mixing_reaches_the_least_value_for_a_rare_domain(spark):
    names = ["a"] * 600 + ["b"] * 300 + ["c"] * 95 + ["d"] * 5
    docs = spark.createDataFrame([(i, " ".join(f"{d}{j}" for j in range(300)), d) for i, d in enumerate(names)], "doc_id long, text string, lang string")
    shares, goal = np.array([0.6, 0.3, 0.095, 0.005]), np.array([0.55, 0.33, 0.1, 0.021])
    r = mixing.rated(docs, targets=dict(zip("abcd", goal.tolist(), strict=True))).toPandas()
    found = r.groupby("domain").rate.mean().reindex(list("abcd")).to_numpy()
    np.testing.assert_allclose(found, (goal + mixing.RIDGE) / (shares + mixing.RIDGE), rtol=0.01)
    none_of_a = mixing.rated(docs, targets={"b": 0.3, "c": 0.095, "d": 0.005}).toPandas().groupby("domain").rate.mean()
    assert none_of_a["a"] < 0.01 and abs(none_of_a["b"] - 1) < 0.01


def test_nearest_with_ties_and_bad_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(1000 + i, rows[50][1]) for i in range(20)] + [(2000, None), (2050, [0.0] * 8), (2100, [float("nan")] * 8)]
    got = nn_descent.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).toPandas()
    assert got[got.query_id == 50].vec_id.tolist() == [1000, 1001, 1002, 1003, 1004]
    ids = np.array([i for i, v in rows[:320]])
    x = np.array([v for _, v in rows[:320]], dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = []
    for q in range(0, 300, 50):
        s = x @ x[q]
        s[q] = -9
        hit.append(len(set(ids[np.lexsort((ids, -s.round(12)))[:5]]) & set(got[got.query_id == q].vec_id)) / 5)
    assert np.mean(hit) >= 0.9
