"""Spelling variants, SimHash links and centroids against brute force, and on odd rows."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from dayline.llm import centroids, common, simhash, spelling

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, word string, f long, node long, n long"
LONG = " ".join(f"word{i}" for i in range(300))


def odd(spark, rows):
    return spark.createDataFrame([(i, t, None, "clash", 1, 2, 3) for i, t in rows], DOCS)


# ---- SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    rows = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in rows]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(keys, prints):
    """The smallest key that each row reaches, over links of two bits or fewer."""
    f = np.array(prints, np.uint64)
    root = list(range(len(keys)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in zip(*np.nonzero(np.triu(np.bitwise_count(f[:, None] ^ f[None, :]) <= 2, 1)), strict=True):
        root[find(b)] = find(a)
    low = defaultdict(list)
    for i, k in enumerate(keys):
        low[find(i)].append(k)
    return [min((k for k in low[find(i)] if k is not None), default=None) for i in range(len(keys))]


def balls(seed, n, centres, flips):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 1 << 63, centres, dtype=np.uint64)[rng.integers(0, centres, n)]
    for _ in range(flips):
        x = np.where(rng.random(n) < 0.7, x ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)), x)
    return np.unique(x)


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 130, 700])
@pytest.mark.parametrize("radius", [0, 1, 2])
def test_bit_slices_equal_all_pairs(n, radius):
    x = balls(n, n, max(1, n // 10), 3)
    i, j = simhash.near_pairs(x, radius)
    a, b = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= radius, 1))
    assert sorted(zip(i, j, strict=True)) == sorted(zip(a, b, strict=True))


def test_blocks_are_abandoned(monkeypatch):
    """Random fingerprints leave no word alive long before the last plane."""
    seen = []
    monkeypatch.setattr(simhash, "past", lambda low, high, radius: seen.append(len(low)) or (low & high))
    simhash.near_pairs(np.unique(np.random.default_rng(3).integers(0, 1 << 63, 2000, dtype=np.uint64)))
    assert len(seen) < 4 * 64 / simhash.LOOK / 2


@pytest.mark.parametrize("large", [4, 4096])
def test_links_through_places_that_are_dealt_anew(spark, monkeypatch, large):
    monkeypatch.setattr(simhash, "LARGE", large)
    x = balls(5, 900, 3, 4).view(np.int64)
    rows = spark.createDataFrame([(int(v),) for v in x], "f long")
    label = {r.node: r.comp for r in simhash.components(simhash.links(rows)).collect()}
    want = plain_components(list(range(len(x))), x.view(np.uint64))
    groups = defaultdict(set)
    for i, w in enumerate(want):
        groups[w].add(label.get(int(x[i]), int(x[i])))
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)


def test_simhash_equals_all_pairs(spark):
    texts = [(r.doc_id, r.text) for r in common.documents(spark, SF).select("doc_id", "text").collect()]
    prints = [plain_fingerprint(t) for _, t in texts]
    want = {i: (f"{f:016x}", c) for (i, _), f, c in zip(texts, prints, plain_components([i for i, _ in texts], prints), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op11_simhash(spark, SF).collect()} == want


def test_simhash_odd_rows(spark):
    rows = [(9, None), (4, " \t\n"), (5, "ONE Two"), (6, "one\x0btwo"), (None, LONG), (7, LONG), (7, LONG), (7, "other text of id seven"), (8, LONG + " end"), (None, "nobody else"), (3, "x" * 120_000), (2, "é漢 " * 20_000)]
    prints = [plain_fingerprint(t) for _, t in rows]
    want = Counter(zip([i for i, _ in rows], prints, plain_components([i for i, _ in rows], prints), strict=True))
    got = simhash.grouped(odd(spark, rows)).collect()
    assert Counter((r.doc_id, r.f % (1 << 64), r.component_id) for r in got) == want
    assert simhash.grouped(odd(spark, rows).where("false")).count() == 0


# ---- spelling variants


def plain_variants(docs, spoiled=97):
    total = Counter()
    for i, text in docs:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), word)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if spoiled and h % spoiled == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            total[word] += 1
    words = {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}
    near, gaps = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            gaps[i, w[:i], w[i + 1 :]].add(w)
            if w[:i] + w[i + 1 :] in words:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    for group in gaps.values():
        for w in group:
            near[w] |= group - {w}
    form = {w: min(near[w], key=lambda x: (-words[x], x), default=None) for w in words}
    form = {w: f if f and words[f] >= 2 * words[w] else None for w, f in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def as_found(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_variants_equal_brute_force(spark):
    docs = common.documents(spark, SF)
    assert as_found(spelling.op12_spelling(spark, SF)) == plain_variants([(r.doc_id, r.text) for r in docs.collect()])


def test_variants_of_dense_words(spark):
    """Runs of one letter, words that are prefixes of others, and every string over two letters."""
    words = ["".join("ab"[i >> k & 1] for k in range(n)) for n in (5, 6, 7) for i in range(1 << n)] + ["a" * n for n in range(5, 12)] + ["ÀÀÀÀÀ", "àÀÀÀÀ", "ÀÀÀÀÀÀ", "zzzzy", "zzzzyzzzz"]
    rng = np.random.default_rng(2)
    docs = [(i, " ".join([w] * int(rng.integers(2, 40)))) for i, w in enumerate(words)]
    assert as_found(spelling.variants(odd(spark, docs))) == plain_variants(docs)


def test_variants_of_odd_rows(spark):
    long = "x" * 6_000
    docs = [(1, None), (2, ""), (None, "North north NORTH nort"), (3, "norths norths norths norths norths norths norths"), (3, "norths"), (4, f"{long} {long} {long}"), (5, f"{long}y {long}y {long}y {long}y {long}y {long}y {long}y"), (6, "12 a b")]
    assert as_found(spelling.variants(odd(spark, docs), 0)) == plain_variants(docs, 0)
    assert spelling.variants(odd(spark, docs).where("false")).count() == 0


def test_words_have_few_light_children(spark):
    words = spark.createDataFrame([(i, "".join("abcd"[i >> 2 * k & 3] for k in range(6)), 3) for i in range(4096)], "id long, word string, n long")
    most = spelling.light(words).groupBy("id").count().agg(F.max("count")).first()[0]
    assert most <= 12 and spelling.light(words).count() < 6 * 4096


# ---- centroids


def vectors(spark, rows):
    return spark.createDataFrame([(i, x, 0, 1) for i, x in rows], "vec_id long, embedding array<float>, cluster int, distance int")


def test_partial_distances_equal_full_ones():
    rng = np.random.default_rng(4)
    x, c = rng.integers(-30, 30, (500, 64)), rng.integers(-30, 30, (40, 64))
    c[7], c[3] = c[9], x[5]
    full = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    order = np.argsort(-x.var(axis=0), kind="stable")
    for guess in (None, np.full(500, 9), rng.integers(0, 40, 500)):
        number, distance, squares = centroids.nearest(x, c, order, guess)
        assert (number == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
        assert squares < 0.9 * full.size * 64


def test_centroids_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.sql(centroids.SQL).fetchall()
    rows = centroids.op13_centroids(spark, SF)
    assert sorted(map(tuple, rows.collect())) == sorted(want) and rows.columns == [d[0] for d in con.sql(centroids.SQL).description]


def test_centroids_of_odd_rows(spark):
    v = lambda *x: [float(y) for y in x] + [0.0] * (64 - len(x))
    good = [(1, v(0.1)), (1, v(0.1)), (1, v(0.2)), (2, v(-0.1)), (None, v(0.1)), (3, v(0.5, -0.5))]
    bad = [(4, None), (5, [1.0]), (6, v(float("nan"))), (7, v(float("inf"))), (8, [None] * 64), (9, [])]
    found, centres = centroids.clustered(vectors(spark, good + bad), k=40, rounds=2)
    rows = found.collect()
    assert len(rows) == len(good) and len(centres) == 5 and all(r.distance == 0 for r in rows)
    assert len({r.cluster for r in rows}) == 4  # equal vectors share the smaller number
    assert centroids.clustered(vectors(spark, bad))[0].count() == 0
    with pytest.raises(Exception, match="too large"):
        centroids.clustered(vectors(spark, [(1, v(1e9))]))
