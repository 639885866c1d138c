import duckdb
import numpy as np
import pytest

from dayline.operators import geometry as G
from dayline.plans import geometry as queries

SF = "/root/testdata/sf0.001"
PRINTS = "subject_id string, fingerprint array<double>"


@pytest.mark.parametrize("name", list(queries.REGISTERED))
def test_queries_equal_sql(spark, name):
    run, sql = queries.REGISTERED[name]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    want = con.sql(sql)
    got = run(spark, SF)
    assert got.columns == want.columns
    rows, others = sorted(map(tuple, got.collect())), sorted(want.fetchall())
    assert len(rows) == len(others) > 0
    for a, b in zip(rows, others, strict=True):
        assert a == b or all(x == y or abs(x - y) < 2e-6 for x, y in zip(a, b, strict=True)), (a, b)


def made(x, copies=()):
    rows = [(f"s{i:04d}", list(map(float, v))) for i, v in enumerate(x)]
    return rows + [(f"t{i:04d}", list(map(float, x[c]))) for i, c in enumerate(copies)]


def nearest(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k], d


def dense(x, w, k, alpha=1.0):
    """The symmetric form of the walk, and its constant eigenvector, from whole matrices."""
    near, d = nearest(x, k)
    link = np.zeros(d.shape, bool)
    link[np.arange(len(x))[:, None], near] = True
    s = np.take_along_axis(d, near, axis=1).max(axis=1)
    with np.errstate(over="ignore"):
        value = np.where(link | link.T, np.exp(-(d**2) / np.outer(s, s)), 0.0)
    np.fill_diagonal(value, 1.0)
    q = value @ w
    value = value / np.outer(q, q) ** alpha
    deg = value @ w
    return value * np.sqrt(np.outer(w, w)) / np.sqrt(np.outer(deg, deg)), np.sqrt(w * deg / (w @ deg))


@pytest.mark.parametrize("shape", ["clusters", "line", "lattice", "even"])
def test_neighbours_are_exact_over_many_cells(spark, shape, monkeypatch):
    """Small cells and blocks: a node must ask other cells, cells are smaller than k, and parts of a cell meet; a lattice has ties."""
    monkeypatch.setattr(G, "PER_CELL", 12)
    monkeypatch.setattr(G, "BLOCK", 9)
    rng = np.random.default_rng(3)
    n, k = 240, 7
    if shape == "clusters":
        x = rng.normal(size=(n, 3)) * 0.1 + rng.integers(0, 5, size=(n, 1)) * 4.0
    elif shape == "line":
        x = np.stack([np.sort(rng.exponential(size=n)) ** 3, np.zeros(n)], axis=1)
    elif shape == "lattice":
        x = np.stack([np.arange(n) // 16, np.arange(n) % 16], axis=1).astype(float)
    else:
        x = rng.uniform(size=(n, 4))
    found = G.neighbours(spark.createDataFrame(made(x), PRINTS).withColumnRenamed("subject_id", "node"), k).toPandas()
    near, d = nearest(x, k)
    assert len(found) == n * k
    got = found.sort_values(["node", "rank"])["other"].str[1:].astype(int).to_numpy().reshape(n, k)
    np.testing.assert_array_equal(got, near)
    np.testing.assert_allclose(found.sort_values(["node", "rank"])["distance"].to_numpy().reshape(n, k), np.take_along_axis(d, near, axis=1), rtol=1e-12)


def test_cells_out_of_reach_are_not_asked(spark, monkeypatch):
    """Far clusters: the second pass compares far fewer pairs than all."""
    monkeypatch.setattr(G, "PER_CELL", 25)
    asked, real = [], G.met
    monkeypatch.setattr(G, "met", lambda a, b, k: (asked.append(a.count()), real(a, b, k))[1])
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 3)) + np.arange(500)[:, None] % 10 * 1000.0
    G.neighbours(spark.createDataFrame(made(x), PRINTS).withColumnRenamed("subject_id", "node"), 5).count()
    assert asked[0] == 500 and asked[1] < 500 * 19 / 3  # of 20 cells


def curve(n=150):
    t = np.random.default_rng(5).uniform(0, 3 * np.pi, size=n)
    return np.stack([t * np.cos(t), t * np.sin(t), 0.2 * t], axis=1)


@pytest.mark.parametrize("columns", [48, 20])
def test_map_equals_dense_eigenvectors(spark, columns, monkeypatch):
    """With 20 columns the search starts anew several times."""
    monkeypatch.setattr(G, "COLUMNS", columns)
    x = curve()
    rows, spectrum = G.diffusion_map(spark.createDataFrame(made(x), PRINTS), components=3, k=10)
    s, known = dense(x, np.ones(len(x)), 10)
    values, vectors = np.linalg.eigh(s)
    np.testing.assert_allclose(spectrum.values, values[::-1][1:4], atol=1e-9)
    assert (spectrum.residuals < 1e-6).all()
    got = np.array([r["coordinates"] for r in rows.orderBy("subject_id").collect()])
    for c in range(3):
        psi = vectors[:, -2 - c] / known * values[-2 - c]
        psi *= np.sign(vectors[np.abs(vectors[:, -2 - c]).argmax(), -2 - c])
        np.testing.assert_allclose(got[:, c], psi, atol=1e-3 * np.abs(psi).max())


def test_first_coordinate_orders_a_curve(spark):
    """A spiral is unrolled: the coordinate follows its parameter, which no linear projection does."""
    t = np.linspace(0, 3 * np.pi, 160)
    x = np.stack([t * np.cos(t), t * np.sin(t)], axis=1)
    rows, _ = G.diffusion_map(spark.createDataFrame(made(x), PRINTS), components=1, k=6)
    got = np.array([r["coordinates"][0] for r in rows.orderBy("subject_id").collect()])
    steps = np.diff(got)
    assert (steps > 0).mean() > 0.98 or (steps < 0).mean() > 0.98


def test_copies_weigh_as_their_number(spark):
    """A third of the subjects share one fingerprint: one node of that weight, and all of them get its coordinates."""
    x = curve(60)
    copies = [7] * 30
    rows, spectrum = G.diffusion_map(spark.createDataFrame(made(x, copies), PRINTS), components=2, k=8)
    w = np.ones(60)
    w[7] += 30
    values = np.linalg.eigvalsh(dense(x, w, 8)[0])[::-1]
    np.testing.assert_allclose(spectrum.values, values[1:3], atol=1e-9)
    got = {r["subject_id"]: r["coordinates"] for r in rows.collect()}
    assert len(got) == 90 and all(got[f"t{i:04d}"] == got["s0007"] for i in range(30))


def test_separate_parts_have_eigenvalue_one_again(spark):
    x = np.random.default_rng(6).normal(size=(60, 2)) + np.repeat([0.0, 500.0, 900.0], 20)[:, None]
    rows, spectrum = G.diffusion_map(spark.createDataFrame(made(x), PRINTS), components=3, k=5)
    np.testing.assert_allclose(spectrum.values[:2], 1.0, atol=1e-9)
    got = np.array([r["coordinates"] for r in rows.orderBy("subject_id").collect()])[:, :2].reshape(3, 20, 2)
    assert np.abs(got - got.mean(axis=1, keepdims=True)).max() < 1e-4  # constant on each part


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_few_and_odd_fingerprints(spark, n):
    """Null, empty and not finite fingerprints take no part; few nodes give few coordinates."""
    odd = [("a", None), ("b", []), ("c", [1.0, None]), ("d", [1.0, float("nan")]), ("e", [float("inf"), 0.0]), (None, [5.0, 5.0])]
    rows, spectrum = G.diffusion_map(spark.createDataFrame(made(np.arange(2.0 * n).reshape(n, 2) ** 2) + odd, PRINTS), components=4)
    got = rows.collect()
    assert len(got) == n and len(spectrum.values) == max(n - 1, 0)
    assert all(len(r["coordinates"]) == max(n - 1, 0) for r in got)
