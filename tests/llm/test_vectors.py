"""Whitening, exact search and hard negatives against brute force, at awkward inputs and with the work they save."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import pivot_search, queries, vectors, vertical_negatives, whitening

SF = "/root/testdata/sf0.001"


def against_sql(spark, name, rows=None):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    ours = queries.queries()[name](spark, SF).toPandas()
    theirs = con.sql(queries.oracle_sql()[name]).df()[list(ours.columns)]
    same = lambda d: sorted(map(tuple, d.itertuples(index=False, name=None)))
    assert len(ours) and same(ours) == same(theirs)


@pytest.mark.parametrize("name", ["op12_pivot_search", "op13_hard_negatives"])
def test_searches_match_sql(spark, name):
    against_sql(spark, name)


def brute_top(rows, asked, k):
    whole = {(i, tuple(v)): np.floor(256 * np.array(v, np.float64)).astype(int) for i, v in rows}
    out = []
    for q in {r for r in whole if asked(r[0])}:
        scored = sorted((-int(whole[q] @ whole[(i, tuple(v))]), i) for i, v in rows if i != q[0])[:k]
        out += [(q[0], n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def brute_negatives(rows, asked, positives=5, negatives=3):
    whole = [(i, label, tuple(np.floor(256 * np.array(v, np.float64)).astype(int).tolist())) for i, v, label in rows]
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a in {r for r in whole if asked(r[0])}:
        near = sorted((-score(a[2], r[2]), r[0]) for r in whole if r[0] != a[0] and r[1] == a[1])[:positives]
        for s, p in near:
            inside = sorted((-score(a[2], r[2]), r[0]) for r in whole if r[0] != a[0] and r[1] != a[1] and 50 * -s <= 100 * score(a[2], r[2]) <= 95 * -s)
            out += [(a[0], p, n + 1, i, -s, -t) for n, (t, i) in enumerate(inside[:negatives])]
    return sorted(out)


def some_rows(seed, n=260, size=6, spread=0.4):
    """Clusters, repeated rows, ties, and two vectors of one id."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(4, size))
    made = [(i, (centres[i % 4] + spread * r.normal(size=size)).astype(np.float32).astype(float).tolist(), int(r.integers(0, 3))) for i in range(n)]
    made += [made[0], made[0], made[5], (300, made[10][1], made[10][2]), (10, made[11][1], 1), (350, [0.0] * size, 0), (400, made[10][1], 2)]
    return made


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_top_k_matches_brute_force_over_many_small_packs(spark, monkeypatch, seed):
    monkeypatch.setattr(pivot_search, "CANDIDATE_PACK", 16)
    monkeypatch.setattr(pivot_search, "QUERY_PACK", 3)
    monkeypatch.setattr(pivot_search, "FIRST", 2)
    monkeypatch.setattr(pivot_search, "SAMPLE", 20)
    rows = [(i, v) for i, v, _ in some_rows(seed)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    for k in (1, 5, 400):
        got = pivot_search.top_k(df, F.col("vec_id") % 10 == 0, k)
        assert sorted(map(tuple, got.collect())) == brute_top(rows, lambda i: i % 10 == 0, k), k


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hard_negatives_match_brute_force_over_many_small_packs(spark, monkeypatch, seed):
    monkeypatch.setattr(vertical_negatives, "COLUMN_PACK", 16)
    monkeypatch.setattr(vertical_negatives, "ANCHOR_PACK", 3)
    monkeypatch.setattr(vertical_negatives, "STEP", 2)
    monkeypatch.setattr(vertical_negatives, "SAMPLE", 20)
    rows = some_rows(seed)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    got = vertical_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, lambda i: i % 10 == 0)


def test_pivots_and_columns_save_work_on_clustered_vectors(spark):
    r = np.random.default_rng(4)
    centres = 3 * r.normal(size=(40, 32))
    rows = [(i, (centres[i % 40] + 0.1 * r.normal(size=32)).tolist()) for i in range(8000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert pivot_search.evaluated_share(df, F.col("vec_id") % 50 == 0) < 0.1
    whole = np.floor(256 * np.array([v for _, v in rows])).T.astype(np.int64)
    query = whole[:, 0]
    scores = query @ whole
    least = np.sort(scores)[-6]
    found, sums, read = vertical_negatives.vertical_scan(whole, whole.min(1), whole.max(1), query, np.ones(8000, bool), least, np.inf)
    assert sorted(found) == np.flatnonzero(scores >= least).tolist() and (sums == scores[found]).all()
    assert read < 0.8 * whole.size


def test_leading_pairs_match_a_full_decomposition():
    r = np.random.default_rng(5)
    basis, _ = np.linalg.qr(r.normal(size=(40, 40)))
    cases = [np.cov(r.normal(size=(40, 300))), basis @ np.diag([9.0] * 7 + [9 - 1e-9] * 3 + [2.0] * 10 + [1e-3] * 20) @ basis.T, np.diag(np.arange(40.0)), np.eye(40), np.ones((40, 40)), np.zeros((40, 40)), np.array([[3.0]]), np.array([[2.0, 1.0], [1.0, 2.0]]), 1e-9 * np.cov(r.normal(size=(12, 90)))]
    for a in cases:
        values, y = whitening.leading_pairs(a, 32)
        want = np.linalg.eigvalsh(a)[::-1]
        k = len(values)
        assert k == min(32, int((want > 1e-12 * max(want[0], 1e-300)).sum()))
        assert np.allclose(values, want[:k], rtol=1e-12, atol=1e-13 * np.abs(want).max())
        assert np.abs(y.T @ y - np.eye(k)).max(initial=0) < 1e-12
        assert np.abs(a @ y - y * values).max(initial=0) <= 1e-12 * max(np.abs(want).max(), 1e-300)


def whitened_by_numpy(x, k):
    n = len(x)
    centred = x - x.mean(0)
    v = centred.T @ centred / n
    values, y = np.linalg.eigh(v)
    values, y = values[::-1], y[:, ::-1]
    k = min(k, int((values > 1e-12 * values[0]).sum()))
    return centred @ y[:, :k] / np.sqrt(values[:k]), values[:k] / np.trace(v)


def test_whitening_matches_numpy(spark):
    got = queries.queries()["op11_whiten"](spark, SF).toPandas().sort_values(["vec_id", "component"])
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.floor(64 * np.stack(table["embedding"]).astype(float)).astype(int) + 1_000_000
    want, explained = whitened_by_numpy(x.astype(float) - 1_000_000, 32)
    n = len(x)
    assert len(got) == 32 * n and set(got["component"]) == set(range(1, 33)) and set(got["n"]) == {n}
    ours = got["whitened"].to_numpy().reshape(n, 32)
    assert np.abs(ours * np.sign((ours * want).sum(0)) - want).max() < 1e-8
    assert np.allclose(got["explained"].to_numpy().reshape(n, 32)[0], explained, rtol=1e-9)
    sums = x.sum(0)
    assert got["deviation"].to_numpy().reshape(n, 32)[:, 0].tolist() == [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    error = got["identity_error"].unique()
    assert len(error) == 1 and 0 <= error[0] < 1e-9


def test_deviation_beyond_a_long_and_flat_directions(spark):
    rows = [(i, [float(i) * 1e6, 5.0, 1e5 * (i % 2)]) for i in range(60)] + [(None, [0.0, 5.0, 1.0]), (3, [3e6, 5.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows]
    n, sums = len(x), np.array(x, object).sum(0)
    assert sorted(int(r["deviation"]) for r in got) == sorted(sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x)
    assert {len(r["whitened"]) for r in got} == {2} and got[0]["identity_error"] < 1e-4
    one = whitening.whiten(df.limit(1)).collect()
    assert len(one) == 1 and one[0]["whitened"] == [] and one[0]["deviation"] == 0


def awkward(spark):
    """Nulls in every column, unusable entries, other lengths, repeats, and clashing names."""
    inf, nan = float("inf"), float("nan")
    rows = [(i, [float(i % 7), float(i % 5) - 2, 1.0], i % 3) for i in range(60)] + [(0, [0.0, -2.0, 1.0], 0)] * 2
    odd = [(100, None, 1), (150, [1.0, None, 2.0], 1), (200, [nan, 1.0, 1.0], 2), (250, [inf, 1.0, 1.0], 0), (300, [1.0, 2.0], 0), (350, [], 0), (400, [-inf, 0.0, 0.0], 1), (None, [1.0, 1.0, 1.0], 1), (450, [1.0, 1.0, 1.0], None)]
    names = "id vector asked hash score rank query_id anchor_id positive_id negative_id windows slot pack n whitened deviation explained identity_error twin place".split()
    df = spark.createDataFrame([(*r, *["clash"] * len(names)) for r in rows + odd], "vec_id long, embedding array<float>, label int, " + ", ".join(f"{x} string" for x in names))
    return df, rows, odd


def test_awkward_vectors(spark):
    df, rows, odd = awkward(spark)
    usable = rows + [r for r in odd if r[0] is None or r[0] == 450]
    named = [r for r in usable if r[0] is not None]
    asked = F.col("vec_id") % 50 == 0
    got = pivot_search.top_k(df, asked)
    assert sorted(map(tuple, got.collect())) == brute_top([r[:2] for r in named], lambda i: i % 50 == 0, 5)
    got = vertical_negatives.hard_negatives(df, asked)
    assert sorted(map(tuple, got.collect())) == brute_negatives([r for r in named if r[2] is not None], lambda i: i % 50 == 0)
    white = whitening.whiten(df).collect()
    assert len(white) == len(usable) and {r["n"] for r in white} == {len(usable)} and white[0]["identity_error"] < 1e-9


def test_empty_vector_tables(spark):
    df, _, odd = awkward(spark)
    for empty in (df.limit(0), df.where("vec_id in (100, 150, 200, 350)")):
        assert pivot_search.top_k(empty, F.col("vec_id") % 50 == 0).count() == 0
        assert vertical_negatives.hard_negatives(empty, F.col("vec_id") % 50 == 0).count() == 0
        assert whitening.whiten(empty).count() == 0
    assert pivot_search.top_k(df, F.lit(False)).count() == 0
    assert vertical_negatives.hard_negatives(df, F.lit(False)).count() == 0


def test_scores_are_exact_or_an_error(spark):
    rows = [(0, [30000.0, 1 / 256]), (1, [30000.0, 3 / 256]), (2, [30000.0, 2 / 256])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = pivot_search.top_k(df, F.col("vec_id") == 0, 2).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(got)] == [(1, 7680000**2 + 3), (2, 7680000**2 + 2)]
    assert vectors.exact_type(np.full((1, 4), 1000), np.full((1, 4), 1000)) is np.float32
    with pytest.raises(OverflowError):
        vectors.floored(np.array([1e9]), 256, 2**31)
