"""Statistics against brute force and known cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import special as S
from tessera.operators import bayes as B
from tessera.operators import contingency as C
from tessera.operators import regression as M
from tessera.operators import series, shares
from tessera.operators.graph import components
from tessera.operators.topics import cophenetic, topic_name


def test_special_functions():
    assert S.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert S.chi2_ppf(0.95, 4) == pytest.approx(9.487729, abs=1e-5)
    assert S.normal_sf(1.959964) == pytest.approx(0.025, abs=1e-7)
    assert S.t_sf(2.570582, 5) == pytest.approx(0.025, abs=1e-6)
    assert S.beta_ppf(0.5, 2, 2) == pytest.approx(0.5, abs=1e-9)
    assert S.fisher_exact(3, 1, 1, 3)[1] == pytest.approx(0.485714, abs=1e-5)
    total = sum(math.exp(S.log_negbin(y, 3.0, 2.0)) for y in range(200))
    assert total == pytest.approx(1, abs=1e-9)
    assert sum(math.exp(S.log_dirichlet_multinomial([k, 3 - k], [1, 1])) * math.comb(3, k) for k in range(4)) == pytest.approx(1)


def test_gini_and_lorenz(spark):
    assert shares.gini(spark.createDataFrame([(1,)] * 4, "x int"), "x").first()[0] == pytest.approx(0)
    x = [1, 2, 2, 7, 9]
    want = 2 * sum((i + 1) * v for i, v in enumerate(sorted(x))) / (5 * sum(x)) - 6 / 5
    assert shares.gini(spark.createDataFrame([(v,) for v in x], "x int"), "x").first()[0] == pytest.approx(want)
    assert shares.gini(spark.createDataFrame([], "x int"), "x").first()[0] is None
    curve = sorted(tuple(r) for r in shares.lorenz(spark.createDataFrame([(v,) for v in x], "x int"), "x").collect())
    assert curve[0] == (0, 0) and curve[-1] == (1, 1)


def test_contingency(spark):
    rows = [("a", "x")] * 10 + [("a", "y")] * 5 + [("b", "x")] * 3 + [("b", "y")] * 12 + [(None, "x")]
    df = spark.createDataFrame(rows, "r string, c string")
    a = C.association(C.counted(df, "r", "c"), "r", "c", p_value=True).first()
    e = np.outer([15, 15], [13, 17]) / 30
    assert a["chi2"] == pytest.approx(((np.array([[10, 5], [3, 12]]) - e) ** 2 / e).sum()) and a["df"] == 1 and a["p"] == pytest.approx(S.chi2_sf(a["chi2"], 1))
    lo, hi = spark.range(1).select(*C.wilson(F.lit(0), F.lit(10))).first()
    assert (lo, round(hi, 4)) == (0, 0.2775)
    one = spark.createDataFrame([(5, 2, 3, 9)], "a int, b int, c int, d int")
    assert C.mantel_haenszel(one).first()["odds_ratio"] == pytest.approx(45 / 6)
    assert C.breslow_day(one).first()["chi2"] == pytest.approx(0, abs=1e-9)
    cube = np.random.default_rng(1).integers(1, 9, (3, 2, 2)).astype(float)
    assert C.deviance(cube, C.cube_fit(cube, [(0, 1, 2)])) == pytest.approx(0, abs=1e-8)
    assert C.permutation_p(spark, np.array([[10, 0], [0, 10]]), 200).first()["p"] < 0.02
    k = C.kruskal(spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", 4.0)], "g string, v double"), "g", "v").first()
    assert k["h"] == pytest.approx(2.4)
    d = C.decomposition(spark.createDataFrame([("p", 0, True), ("q", 0, False), ("p", 1, True), ("p", 1, True)], "g string, t int, f boolean"), F.col("f"), "g", F.col("t") == 1).first()
    assert d["total"] == pytest.approx(0.5) and d["composition"] + d["rate"] == pytest.approx(d["total"])


def test_ranking(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1), (None, 0.5)], "y int, p double")
    r = shares.ranking_metrics(df, "y", "p").first()
    assert r["auc"] == pytest.approx(0.875) and r["average_precision"] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)


def test_regressions():
    rng = np.random.default_rng(3)
    x = np.column_stack([np.ones(400), rng.normal(size=400)])
    y = rng.poisson(np.exp(0.5 + 0.3 * x[:, 1]))
    assert M.poisson(x, y.astype(float)).beta == pytest.approx([0.5, 0.3], abs=0.15)
    k = rng.binomial(5, 1 / (1 + np.exp(-(0.2 - x[:, 1]))))
    two = M.logistic(x, k.astype(float), np.full(400, 5.0))
    many = M.multinomial(x, np.column_stack([5 - k, k]).astype(float), ["a", "b"], ["no", "yes"], 1e-9)
    assert many.beta == pytest.approx(two.beta, abs=1e-5)


def test_chain_matches_conjugate_posterior(spark):
    model = B.HierarchicalRates("pooled", [30, 20], [10.0, 10.0], [0, 0], [0, 0])
    s = B.summary(B.sample(spark, model, model.names, model.start, chains=4, tune=800, draws=1500).cache()).first()
    assert s["mean"] == pytest.approx(math.log(2.5), abs=0.03) and s["rhat"] < 1.02 and s["sd"] == pytest.approx(1 / math.sqrt(50), rel=0.15)
    with pytest.raises(ValueError):
        B.sample(spark, model, ["a", "b"], model.start)


def test_pareto_fit():
    x = np.random.default_rng(1).pareto(2.0, 4000)  # a generalised Pareto with shape 1/2
    assert B.fit_pareto(x)[0] == pytest.approx(0.5, abs=0.1)


def test_change_point_is_found(spark):
    counts = np.array([[9, 1]] * 8 + [[1, 9]] * 8, float)
    best = B.change_points(spark, {"s": counts}).orderBy(F.desc("posterior")).first()
    assert (best["k"], best["first"]) == (1, 8)


def test_series(spark):
    df = spark.createDataFrame([("a", "2001-01-01", 2), ("a", None, 1), ("a", "2000-01-01", 3), (None, "2000-01-01", 4)], "k string, d string, i int")
    assert {r["i"]: r["prior"] for r in series.prior_events(df, "k", "d", "i").collect()} == {3: 0, 2: 1, 1: 2, 4: 0}
    line = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 5, 8, 9, 9.1])], "k int, v double")
    assert series.elbow(line, "k", "v").first()[0] == 3
    assert series.first_peak(line.withColumn("v", F.when(F.col("k") == 3, 2.0).otherwise(F.col("v"))), "k", "v").first()[0] == 2


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a int, b int")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_topics():
    assert topic_name(["robe", "robes", "bath robe", "towel"]) == "robe / towel"
    assert cophenetic([[0, 0], [1, 1]], [2, 1]) == pytest.approx(1)


def plain_cophenetic(labels):
    """Average linkage over single documents."""
    n = len(labels)
    d = np.ones((n, n))
    for i in range(n):
        for j in range(n):
            both = [(a, b) for a, b in zip(labels[i], labels[j]) if a is not None and b is not None]
            d[i, j] = 1 - (np.mean([a == b for a, b in both]) if both else 0)
    groups, height = [[i] for i in range(n)], np.zeros((n, n))
    while len(groups) > 1:
        far = {(a, b): d[np.ix_(groups[a], groups[b])].mean() for a in range(len(groups)) for b in range(a + 1, len(groups))}
        a, b = min(far, key=lambda k: (round(far[k], 12), k))
        for i in groups[a]:
            for j in groups[b]:
                height[i, j] = height[j, i] = far[a, b]
        groups[a] += groups.pop(b)
    upper = np.triu_indices(n, 1)
    return np.corrcoef(d[upper], height[upper])[0, 1]


def test_consensus_of_groups_equals_that_of_documents():
    rows = [([0, 0, 1], 4), ([0, 1, 1], 2), ([1, 1, None], 3), ([1, None, 0], 1)]
    every = [r for r, m in rows for _ in range(m)]
    assert cophenetic([r for r, _ in rows], [m for _, m in rows]) == pytest.approx(plain_cophenetic(every))


def test_factors_find_blocks_of_terms(spark):
    from tessera.operators.topics import Factors, factorise, residual, singular_start

    rng = np.random.default_rng(2)
    rows = [(d, f"{'abc'[d % 3]}{t}", float(rng.integers(1, 5))) for d in range(60) for t in rng.choice(6, 4, replace=False)]
    cells = spark.createDataFrame(rows, "doc int, term string, w double")
    start = singular_start(Factors(cells, "doc", "term", "w"), 3)
    assert start.shape == (3, 18) and (start > 0).all()
    w, h, terms = factorise(cells, "doc", "term", "w", 3, 10)
    kinds = [{terms[j][0] for j in np.argsort(-row)[:6]} for row in h]
    assert sorted(map(sorted, kinds)) == [["a"], ["b"], ["c"]] and w.count() == 60
    x = np.zeros((60, len(terms)))
    for d, t, v in rows:
        x[d, terms.index(t)] = v
    got = {r["doc"]: r["weights"] for r in w.collect()}
    assert residual(cells, "doc", "term", "w", h, terms) == pytest.approx(np.linalg.norm(x - np.array([got[d] for d in range(60)]) @ h), rel=1e-6)
    # the leading singular vectors, up to their sign
    u, s, v = np.linalg.svd(x)
    assert abs(start[0] / np.linalg.norm(start[0]) @ np.abs(v[0])) > 0.9


def test_models_share_their_passes_over_the_documents(spark):
    from __spark_entry__ import queries
    from tessera.operators.topics import Factors, factorise, factorise_each, residual, residuals

    rng = np.random.default_rng(4)
    rows = [(d, f"{'abcd'[d % 4]}{t}", float(rng.integers(1, 5))) for d in range(80) for t in rng.choice(6, 4, replace=False)]
    cells = spark.createDataFrame(rows, "doc int, term string, w double")
    f, ks = Factors(cells, "doc", "term", "w"), [2, 3, 5]
    for start in ("singular", "random"):
        hs = factorise_each(f, ks, 6, start)
        for k, h in zip(ks, hs):
            assert h == pytest.approx(factorise(cells, "doc", "term", "w", k, 6, start)[1], rel=1e-6, abs=1e-9)
    assert residuals(f, hs) == pytest.approx([residual(cells, "doc", "term", "w", h, f.terms) for h in hs])
    jobs = spark._jsc.sc().dagScheduler().numTotalJobs
    before = jobs()
    assert queries()["tx6_topic_count"](spark, "/root/testdata/sf0.001").count() == 6
    assert jobs() - before < 120  # not as many again for each number of topics


def test_partial_sums_are_bounded(spark, monkeypatch):
    from tessera.operators import topics as T

    rows = [(d, f"t{(d * 7 + i) % 11}", 1.0 + i) for d in range(90) for i in range(3)]
    f = T.Factors(spark.createDataFrame(rows, "doc int, term string, w double").repartition(4), "doc", "term", "w")
    want = T.factorise_each(f, [2, 3], 4)
    monkeypatch.setattr(T, "SENT", 1)  # one task
    monkeypatch.setattr(T, "BLOCK", 4)
    for a, b in zip(want, T.factorise_each(f, [2, 3], 4)):
        assert a == pytest.approx(b, rel=1e-6, abs=1e-9)


def test_log_gamma():
    x = np.array([1e-3, 0.5, 1.0, 2.0, 9.99, 10.0, 123.4, 1e6])
    assert S._lgamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-11, abs=1e-11)


def test_rates_by_sorted_values_equal_plain_ones():
    rng = np.random.default_rng(5)
    y, x, g = rng.poisson(4, 60).astype(float), rng.uniform(1, 9, 60), np.arange(60) % 7
    model = B.HierarchicalRates("walk", y, x, g, np.arange(60) % 5)
    p = model.start + rng.normal(size=len(model.start)) * 0.1
    mu, phi = np.exp(model.log_rate(p) + np.log(x)), math.exp(p[2 + model.groups])
    assert model.pointwise(p) == pytest.approx(S.log_negbin(y, mu, phi))
    assert sorted(i for b in model.blocks() for i in b) == list(range(len(model.names)))


def test_topic_trend_follows_shares(spark):
    years = np.arange(2000, 2020)
    up = 1 / (1 + np.exp(-(years - 2010) / 4))
    counts = np.round(np.column_stack([100 * up, 100 * (1 - up)]))
    model = B.TopicTrend(counts, years)
    assert sorted(i for b in model.blocks() for i in b) == list(range(len(model.names)))
    s = {r["param"]: r["mean"] for r in B.summary(B.sample(spark, model, model.names, model.start, chains=2, tune=300, draws=300, blocks=model.blocks()).cache()).collect()}
    assert s["trend_0"] == pytest.approx(2.5, abs=0.6)


def test_resampling():
    cube = np.array([[[5, 5], [8, 2]], [[2, 8], [5, 5]]], float)
    parts = C.split_change(cube)
    assert parts["total"] == pytest.approx(13 / 20 - 7 / 20) and parts["composition"] == pytest.approx(0)
    assert C.gini_of(np.array([1.0, 2.0, 7.0, 9.0]), np.array([1.0, 2.0, 1.0, 1.0])) == pytest.approx(2 * (1 + 4 + 6 + 28 + 45) / (5 * 21) - 6 / 5)


def test_margins_that_are_empty_go(spark):
    df = spark.createDataFrame([("a", "x", 3), ("a", "y", 0), ("b", "x", 0), ("b", "y", 0), ("c", "x", 0), ("c", "y", 0)], "r string, c string, o bigint")
    assert [tuple(r) for r in C.filled(df, "r", "c").collect()] == [("a", "x", 3)]


def test_learning_tools(spark):
    from tessera.operators import learning as L

    df = spark.createDataFrame([(i, float(i % 7), "u" if i % 3 else "v") for i in range(500)], "id int, x double, k string")
    for rows in (500, 10 * L.BUCKET):  # one bucket, and ten
        moved = L.permuted(df, "id", "x", 3, rows)
        assert sorted(r["x"] for r in moved.collect()) == sorted(r["x"] for r in df.collect()) and moved.count() == 500
        assert moved.join(df.select("id", F.col("x").alias("was")), "id").where("x <> was").count() > 300
    assert L.grid_of(df, "k") == ["u", "v"] and L.grid_of(df, "x", 3) == [0.0, 3.0, 6.0]
    assert L.drawn(L.SPACES["forest"], 3) == L.drawn(L.SPACES["forest"], 3) and len(L.drawn(L.SPACES["forest"], 3)) == 3


def test_streams(spark, tmp_path):
    from tessera.streaming.counts import prior_counts, windowed_counts

    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "2024-01-01 00:10:00", 7, 1.0), (2, "2024-01-01 00:20:00", 7, 2.0), (3, "2024-01-01 03:00:00", 8, 5.0)], "event_id int, ts string, user_id int, value double").write.parquet(src)
    stream = spark.readStream.schema("event_id int, ts string, user_id int, value double").parquet(src)
    for name, df, mode in (("counts", windowed_counts(stream, "ts", "user_id"), "complete"), ("prior", prior_counts(stream, "user_id", "event_id"), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert {(r["user_id"], r["n"], r["total"]) for r in spark.table("counts").collect()} == {(7, 2, 3.0), (8, 1, 5.0)}
    assert {(r["event_id"], r["prior"]) for r in spark.table("prior").collect()} == {(1, 0), (2, 1), (3, 0)}
