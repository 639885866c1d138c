import numpy as np
import pytest

from dayline.dataset import CurveSet
from dayline.operators import estimators, sums
from dayline.streaming.fits import ROWS, StreamedFit

SCALES = [0.0, 1.0, 2.0, 4.0, 8.0]


def made(seed=5, subjects=40):
    """Observations with versions: some hours are written again, some of them out of order."""
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(subjects):
        level = rng.normal(size=5)
        for h in rng.choice(24, int(rng.integers(1, 25)), replace=False):
            for version in range(int(rng.integers(1, 4))):
                rows.append((f"s{s}", int(h), version, (level + np.cos(2 * np.pi * h / 24) + rng.normal(size=5)).tolist()))
    return rows


def latest(rows):
    best = {}
    for s, h, v, c in rows:
        if (s, h) not in best or (v, c) > best[s, h]:
            best[s, h] = (v, c)
    return [(s, h, c) for (s, h), (_, c) in best.items()]


def same(model, want):
    np.testing.assert_allclose(model.basis.mean, want.basis.mean, atol=1e-9)
    np.testing.assert_allclose(model.basis.modes, want.basis.modes, atol=1e-9)
    np.testing.assert_allclose(model.noise, want.noise, atol=1e-9)
    np.testing.assert_allclose(model.spectra, want.spectra, atol=1e-9)


@pytest.fixture(scope="module")
def whole(spark):
    return CurveSet(spark.createDataFrame(latest(made()), "subject_id string, hour int, curve array<double>"), SCALES)


def test_one_pass_equals_the_fit_by_steps(whole):
    same(sums.fit_spectral_once(whole, 3), estimators.fit_spectral(whole, 3))
    same(sums.fit_spectral_once(whole, "ev95", 3, 0.0), estimators.fit_spectral(whole, "ev95", 3, 0.0))


@pytest.mark.parametrize("order", [1, 2])
def test_a_stream_in_any_order_gives_the_fit_of_all_rows(spark, whole, tmp_path, order):
    """Files that come one by one, shuffled; the last batch is handed out again; then two more subjects and their removal by newer versions."""
    rows = made()
    np.random.default_rng(order).shuffle(rows)
    source = tmp_path / "in"
    for k in range(4):
        part = [(r[0], int(r[1]), int(r[2]), list(map(float, r[3]))) for r in rows[k::4]]
        spark.createDataFrame(part, ROWS).coalesce(1).write.mode("append").parquet(str(source))
    fit = StreamedFit(str(tmp_path / "state"), SCALES)
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = fit.start(stream, availableNow=True)
    query.awaitTermination(300)
    assert query.exception() is None
    batches = [int(p.name.split("=")[1]) for p in (tmp_path / "state" / "sums").iterdir() if "=" in p.name]
    assert len(batches) == 4
    want = estimators.fit_spectral(whole, 3)
    same(fit.model(spark, 3), want)
    before = fit.sums(spark)
    again = spark.read.schema(ROWS).parquet(f"{tmp_path}/state/days/batch={max(batches)}")
    fit.update(again, max(batches))
    np.testing.assert_allclose(fit.sums(spark), before, atol=1e-9)
    old = spark.createDataFrame([("s0", 3, -1, [9.0] * 5), ("s1", 30, 9, [9.0] * 5), ("s1", 3, 9, [9.0])], ROWS)
    fit.update(old.where("subject_id = 's1'"), max(batches) + 1)  # neither row is valid
    np.testing.assert_allclose(fit.sums(spark), before, atol=1e-9)
    assert fit.layout.parts(fit.sums(spark, min(batches)))["n"] < fit.layout.parts(before)["n"]


def test_a_late_row_of_an_old_version_changes_nothing(spark, tmp_path):
    fit = StreamedFit(str(tmp_path), SCALES)
    row = lambda h, v, x: ("a", h, v, [x] * 5)
    fit.update(spark.createDataFrame([row(1, 5, 1.0), row(2, 5, 2.0)], ROWS), 0)
    before = fit.sums(spark)
    fit.update(spark.createDataFrame([row(1, 4, 7.0)], ROWS), 1)
    np.testing.assert_array_equal(fit.sums(spark), before)
    fit.update(spark.createDataFrame([row(1, 6, 3.0)], ROWS), 2)
    alone = fit.layout.of_days([np.array([1, 2])], [np.array([3.0] * 5 + [2.0] * 5)], np.ones(1))
    np.testing.assert_allclose(fit.sums(spark), alone, atol=1e-12)


def test_lags_are_made_once(spark):
    """The plan of a lag covariance runs its Python pass once."""
    from dayline.plans.queries import QUERIES

    for name in ("lagcov_two_level", "cross_spectra", "power_spectra"):
        df = QUERIES[name](spark, "/root/testdata/sf0.001")
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("MapInPandas") == 1, name


def test_streamed_lags_of_the_embeddings(spark):
    import duckdb

    from dayline.plans import streams

    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    for name, (run, sql) in streams.REGISTERED.items():
        got = run(spark, "/root/testdata/sf0.001")
        assert sorted(map(tuple, got.collect())) == sorted(con.sql(sql).fetchall()), name
        assert got.columns == con.sql(sql).columns
