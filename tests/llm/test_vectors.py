import numpy as np
import pytest

from zenithal.llm import ann, exact_topk, queries


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, rank string")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x[100:400] = x[100]  # a very common vector
    rows = [(i, [float(v) for v in r], "clash", None) for i, r in enumerate(x)]
    rows += [(5000, None, None, None), (5001, [0.0] * 24, None, None), (5002, [float("nan")] + [1.0] * 23, None, None), (5003, [1.0, None] + [1.0] * 22, None, None), (5004, [float("inf")] * 24, None, None), (5005, [], None, None), (5006, [1.0, 2.0], None, None), (None, [1.0] * 24, None, None)]
    return vectors(spark, rows), x


def test_ann_recall_and_exact_scores(spark, data):
    df, x = data
    got = ann.search(df, df.where("vec_id % 50 = 0"), k=5).toPandas()
    x = x.astype(np.float64)
    hits = 0
    for q in range(0, 1500, 50):
        s = (x * x[q]).sum(1) / (np.sqrt((x[q] ** 2).sum()) * np.sqrt((x * x).sum(1)))
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == [1, 2, 3, 4, 5] and q not in set(mine.vec_id)
        assert np.allclose(mine.score, s[mine.vec_id], rtol=0, atol=1e-12)
        s[q] = -9
        hits += len(set(np.lexsort((np.arange(1500), -np.round(s, 12)))[:5]) & set(mine.vec_id))
    assert hits >= 0.9 * 5 * 30
    common = got[got.query_id == 150].sort_values("rank")
    assert list(common.vec_id) == [100, 101, 102, 103, 104]  # ties go to the smaller ids
    assert set(got.query_id) <= set(range(1500))


@pytest.mark.parametrize("a_pass", [16384, 12])
def test_ann_by_cells(spark, monkeypatch, a_pass):
    """Clustered vectors, one cluster with a third of them: a query looks into few cells, whose folders alone are read."""
    monkeypatch.setattr(ann.V, "QUERIES_A_PASS", a_pass)
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(30, 16))
    of = np.where(rng.random(3000) < 1 / 3, 0, rng.integers(0, 30, 3000))
    x = (middles[of] + 0.15 * rng.normal(size=(3000, 16))).astype(np.float32)
    df = vectors(spark, [(i, [float(v) for v in r], "", "") for i, r in enumerate(x)])
    data = ann.V.clean(df, nonzero=True)
    index = ann.Index(data, k=5, rows_a_cell=100)
    cells = index.model.value[16][1]
    assert len(cells.middles) == 30 and cells.look < 15
    asked = data.where("id % 50 = 0")
    got = index.search(asked).toPandas()
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 50):
        s = u @ u[q]
        s[q] = -9
        hits += len(set(np.argsort(-s)[:5]) & set(got[got.query_id == q].vec_id))
    assert len(got) == 300 and hits >= 0.95 * 300
    one = index.search(data.where("id = 50"))
    assert "cell" in one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("]")[0]


@pytest.mark.parametrize("noise", [0.02, 0.3])
def test_ann_among_near_copies(noise):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(8192, 64))
    x[:2730] = x[0] + noise * rng.normal(size=(2730, 64))
    ids, unit = np.arange(8192), x / np.linalg.norm(x, axis=1, keepdims=True)
    asked = np.array([5, 900, 2000, 4000, 8000])
    best = ann.V.Best(5, 5, float)
    quantiser = ann.Quantiser(64).fit(unit[::8], rounds=4)
    ann._scan_block(best, ids, x, *quantiser.packed(unit), quantiser, asked, np.arange(5), x[asked], unit[asked], 64)
    for i, q in enumerate(asked):
        s = unit @ unit[q]
        s[q] = -9
        assert set(best.vec[i]) == set(np.argsort(-s)[:5])


@pytest.mark.parametrize("a_pass", [16384, 9])
def test_exact_topk_is_brute_force(spark, data, monkeypatch, a_pass):
    monkeypatch.setattr(ann.V, "QUERIES_A_PASS", a_pass)
    df, x = data
    got = exact_topk.search(df, df.where("vec_id % 50 = 0"), k=5).toPandas()
    z = np.vstack([np.floor(256 * x.astype(np.float64)), np.zeros((1, 24))]).astype(np.int64)
    ids = np.array([*range(1500), 5001])
    for q in range(0, 1500, 50):
        s = z @ z[q]
        s[q] = -(10**12)
        o = np.lexsort((ids, -s))[:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine.vec_id) == list(ids[o]) and list(mine.score) == list(s[o])


def test_exact_topk_beyond_doubles(spark):
    big = 2.0**22
    df = spark.createDataFrame([(0, [big, 1.0]), (1, [big, 3.0]), (2, [big, 2.0]), (3, [-big, 5.0])], "vec_id long, embedding array<double>")
    got = exact_topk.search(df, df.where("vec_id = 0"), k=5).toPandas().sort_values("rank")
    a = 2**30
    assert list(got.vec_id) == [1, 2, 3] and list(got.score) == [a * a + 256 * 768, a * a + 256 * 512, -a * a + 256 * 1280]
    huge = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 3.0]), (2, [-1e30, 2.0])], "vec_id long, embedding array<double>")
    got = exact_topk.search(huge, huge.where("vec_id = 0"), k=5).toPandas().sort_values("rank")
    assert list(got.vec_id) == [1, 2] and list(got.score) == [2**63 - 1, -(2**63)]


def test_few_and_none(spark):
    df = spark.createDataFrame([(50, [1.0, 0.0]), (7, [0.5, 0.5]), (7, [0.5, 0.5])], "vec_id long, embedding array<float>")
    for f in (ann, exact_topk):
        assert [r.vec_id for r in f.search(df, df.where("vec_id % 50 = 0")).orderBy("rank").collect()] == [7, 7]
        empty = df.limit(0)
        assert f.search(empty, empty).count() == 0


def test_the_largest_id_is_an_id(spark):
    top = 2**63 - 1
    df = spark.createDataFrame([(top, [1.0, 0.5]), (50, [1.0, 0.0]), (3, [0.5, 0.5])], "vec_id long, embedding array<float>")
    for f in (ann, exact_topk):
        assert {r.vec_id for r in f.search(df, df.where("vec_id = 50")).collect()} == {top, 3}


def test_exact_topk_skips_fragments():
    """A cutoff that few rows reach leaves few pairs of later fragments open, and the result exact."""
    rng = np.random.default_rng(8)
    x = np.floor(256 * rng.normal(size=(4000, 32)))
    x[:20] = x[4] + rng.integers(-9, 9, (20, 32))
    ids, own, q = np.arange(4000), np.arange(5), x[:5]
    low, high, scores = [], [], x[:5] @ x.T
    for i in range(5):
        local = np.stack([q[i][c] @ x[:, c].T for c in exact_topk._cuts(32, 4)])
        low.append([int(v) for v in local.min(1)])
        high.append([int(v) for v in np.delete(local, i, axis=1).max(1)])
    np.fill_diagonal(scores, -1e18)
    cutoffs = [(int(np.sort(scores[i])[-5]), low[i], high[i]) for i in range(5)]
    best = ann.V.Best(5, 5, np.int64)
    exact_topk._resolve(best, ids, own, q, ids, x, cutoffs, 5, 4)
    for i in range(5):
        order = np.lexsort((ids, -scores[i]))[:5]
        assert list(best.vec[i]) == list(order) and list(best.score[i]) == list(scores[i][order])


def test_registered(spark):
    got = queries.op1_ann(spark, "/root/testdata/sf0.001")
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and got.count() == 50
