import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsecg.model import Code, EngineError, SolveOptions
from sparsecg.operators import matrix, vectors
from sparsecg.plans import cg

LAP3 = [(0, 0, 2.0), (0, 1, -1.0), (1, 1, 2.0), (1, 2, -1.0), (2, 2, 2.0)]


def mat(spark, rows):
    return spark.createDataFrame(rows, "i long, j long, a double")


def vec(spark, values):
    return spark.createDataFrame(list(enumerate(map(float, values))), "i long, v double")


def values(x):
    return [r.v for r in x.orderBy("i").collect()]


@pytest.mark.parametrize("solve", [cg.classic, cg.pipelined])
def test_laplacian(spark, solve):
    res = solve(mat(spark, LAP3), vec(spark, [1, 1, 1]), 3, SolveOptions(residual_rtol=1e-9))
    assert np.allclose(values(res.x), [1.5, 2, 1.5])
    assert res.iterations <= 3


def test_one_iteration_and_epsilon(spark):
    res = cg.classic(mat(spark, [(0, 0, 4.0)]), vec(spark, [2]), 1)
    assert res.iterations == 1 and values(res.x) == [0.5]
    res = cg.classic(mat(spark, [(0, 0, 3.0)]), vec(spark, [2]), 1, SolveOptions(epsilon=1.0))
    assert values(res.x) == [0.5]


def test_duplicates_add_up_and_missing_diagonal(spark):
    a = mat(spark, LAP3 + [(0, 0, 2.0)])
    y = matrix.dsymv(1.0, matrix.expand(a), vec(spark, [1, 1, 1]), 0.0, vec(spark, [9, 9, 9]), 3)
    assert values(y) == [3, 0, 1]
    f = matrix.expand(mat(spark, [(0, 0, 1.0), (0, 1, 1.0)]), 0.5)
    assert {(r.i, r.j, r.a) for r in f.collect()} == {(0, 0, 1.5), (0, 1, 1.0), (1, 0, 1.0)}


def test_empty_row_gives_zero(spark):
    y = matrix.dsymv(2.0, matrix.expand(mat(spark, [(0, 0, 1.0)])), vec(spark, [3, 4]), 1.0, vec(spark, [1, 1]), 2)
    assert values(y) == [7, 1]


def test_indefinite(spark):
    with pytest.raises(EngineError) as e:
        cg.classic(mat(spark, [(0, 0, 1.0), (1, 1, -1.0)]), vec(spark, [1, 1]), 2)
    assert e.value.code is Code.NOT_CONVERGED_INDEFINITE_MATRIX


def test_zero_residual_at_start(spark):
    with pytest.raises(EngineError) as e:
        cg.classic(mat(spark, LAP3), vec(spark, [0, 0, 0]), 3)
    assert e.value.code is Code.NOT_CONVERGED_INDEFINITE_MATRIX
    free = SolveOptions(maxits=5, residual_rtol=0.0)
    assert cg.classic(mat(spark, LAP3), vec(spark, [0, 0, 0]), 3, free).status == "exact"
    assert cg.pipelined(mat(spark, LAP3), vec(spark, [0, 0, 0]), 3, free).status == "exact"


def test_not_converged_keeps_result(spark):
    with pytest.raises(EngineError) as e:
        cg.classic(mat(spark, LAP3), vec(spark, [1, 2, 5]), 3, SolveOptions(maxits=1))
    assert e.value.code is Code.NOT_CONVERGED and e.value.result.iterations == 1


def test_differences_stop_classic_only(spark):
    res = cg.classic(mat(spark, LAP3), vec(spark, [1, 2, 5]), 3, SolveOptions(residual_rtol=0.0, diff_atol=10.0))
    assert res.iterations == 1
    with pytest.raises(EngineError) as e:
        cg.pipelined(mat(spark, LAP3), vec(spark, [1, 2, 5]), 3, SolveOptions(diff_atol=1.0))
    assert e.value.code is Code.NOT_SUPPORTED


def test_initial_guess(spark):
    x0 = vec(spark, [1.5, 2, 1.5])
    res = cg.classic(mat(spark, LAP3), vec(spark, [1, 1, 1]), 3, SolveOptions(residual_rtol=0.0, residual_atol=1e-12), x0)
    assert res.iterations == 0 and values(res.x) == [1.5, 2, 1.5]


def test_vectors_must_cover_rows(spark):
    with pytest.raises(EngineError) as e:
        cg.classic(mat(spark, LAP3), vec(spark, [1, 1]), 3)
    assert e.value.code is Code.INDEX_OUT_OF_BOUNDS


def test_random_system_agrees_everywhere(spark):
    rng = np.random.default_rng(3)
    n = 30
    m = rng.normal(size=(n, n))
    m = m @ m.T + n * np.eye(n)
    b = rng.normal(size=n)
    a = mat(spark, [(i, j, float(m[i, j])) for i in range(n) for j in range(i, n)])
    want = np.linalg.solve(m, b)
    o = SolveOptions(maxits=80, residual_rtol=1e-11)
    for x in (cg.classic(a, vec(spark, b), n, o).x, cg.pipelined(a, vec(spark, b), n, o).x, cg.one_task(a, vec(spark, b), n, o), cg.one_task(a, vec(spark, b), n, o, True)):
        assert np.allclose(values(x), want, atol=1e-8)
    exact = vec(spark, want)
    res = cg.classic(a, cg.manufactured(a, exact, n), n, o)
    assert cg.error_norm(res.x, exact) < 1e-8
    text = cg.report(res)
    assert "iterations:" in text and "gemv" in text and "GB/s" in text
    k, rows = res.iterations, {op: rest for op, *rest in res.report.rows()}
    assert rows["gemv"] == [k, 2 * k * (n * n + n), k * (12 * n * n + 24 * n)] and rows["axpy"][0] == 2 * k and rows["dot"] == [k, 2 * k * n, 16 * k * n]


@pytest.mark.parametrize("pipeline", [False, True])
def test_one_task_gives_the_same_beyond_its_limit(spark, monkeypatch, pipeline):
    rng = np.random.default_rng(7)
    n = 30
    m = rng.normal(size=(n, n))
    m = m @ m.T + n * np.eye(n)
    b = rng.normal(size=n)
    a = mat(spark, [(i, j, float(m[i, j])) for i in range(n) for j in range(i, n)])
    indefinite = mat(spark, [(0, 0, 1.0), (1, 1, -1.0)])
    cases = [
        (a, b, SolveOptions(maxits=80, residual_rtol=1e-11)),
        (a, b, SolveOptions(maxits=3, residual_rtol=0.0, epsilon=0.5)),
        (a, b, SolveOptions(maxits=3)),  # meets no tolerance
        (a, b, SolveOptions(residual_atol=1e9)),  # met at the start
        (a, 0 * b, SolveOptions()),
        (indefinite, [1, 1], SolveOptions()),
    ]
    inside = [values(cg.one_task(a, vec(spark, b), len(b), o, pipeline)) for a, b, o in cases]
    monkeypatch.setattr(cg, "LOCAL_ENTRIES", 0)
    for (a, b, o), want in zip(cases, inside):
        assert np.allclose(values(cg.one_task(a, vec(spark, b), len(b), o, pipeline)), want, atol=1e-9)
    assert np.allclose(inside[0], np.linalg.solve(m, cases[0][1]), atol=1e-8)


def exchanges(df):
    """Lines of the plan with an exchange, and all lines."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return [x for x in lines if "Exchange" in x], lines


@pytest.mark.parametrize("solve", [cg.classic, cg.pipelined])
def test_long_vectors_leave_the_matrix_where_it_lies(spark, monkeypatch, solve):
    monkeypatch.setattr(matrix, "BROADCAST_ROWS", 0)
    plans = []
    plain = cg._with_product

    def noted(state, f, *args):
        out = plain(state, f, *args)
        plans.append(out)
        return out

    monkeypatch.setattr(cg, "_with_product", noted)
    rng = np.random.default_rng(5)
    n = 40
    m = rng.normal(size=(n, n))
    m = m @ m.T + n * np.eye(n)
    b = rng.normal(size=n)
    a = mat(spark, [(i, j, float(m[i, j])) for i in range(n) for j in range(i, n)])
    o = SolveOptions(maxits=60, residual_rtol=1e-10)
    res = solve(a, vec(spark, b), n, o, vec(spark, rng.normal(size=n)))
    assert np.allclose(values(res.x), np.linalg.solve(m, b), atol=1e-7)
    moved, lines = exchanges(plans[-1])
    assert any("FileScan" in x for x in lines)
    # the partial sums of rows, and nothing else
    assert len(moved) == 1 and "hashpartitioning(i" in moved[0]


def test_places_that_one_side_lacks_are_errors(spark):
    one, two = vec(spark, [1]), vec(spark, [1, 2])
    packed = spark.createDataFrame([(0, 5, 1.0)], "pos long, i long, v double")
    for call in (lambda: vectors.axpy(1, one, two), lambda: vectors.aypx(1, two, one), lambda: vectors.dot(two, one)):
        with pytest.raises(Exception, match="incompatible size"):
            call().collect()
    for call in (lambda: vectors.sparse_dot(packed, two), lambda: vectors.sparse_axpy(1, packed, two), lambda: vectors.gather(packed, two), lambda: vectors.gather_zero(packed, two)[1], lambda: vectors.scatter(two, packed)):
        with pytest.raises(Exception, match="out of bounds"):
            call().collect()
    f = mat(spark, [(0, 3, 1.0)])
    for x, y in ((vec(spark, [1, 2]), vec(spark, [1, 2, 3, 4])), (vec(spark, [1, 2, 3, 4]), one.where("false"))):
        with pytest.raises(Exception, match="incompatible size"):
            matrix.dsymv(1.0, f, x, 0.0, y, 4).collect()
    for call, code in ((lambda: vectors.gather(one, two), Code.VECTOR_EXPECTED_PACKED), (lambda: vectors.scatter(packed, packed), Code.VECTOR_EXPECTED_FULL)):
        with pytest.raises(EngineError) as e:
            call()
        assert e.value.code is code
    assert vectors.sparse_dot(two, two).first().value == 5 and values(vectors.sparse_axpy(2, two, two)) == [3, 6]
    parts = spark.createDataFrame([(0, 0), (1, 1)], "i long, p int")
    assert {(r.p, r.value) for r in vectors.nrm2sqr_by_part(vec(spark, [-3, 4]), parts).collect()} == {(0, 9.0), (1, 16.0)}
    assert {(r.p, r.value) for r in vectors.asum_by_part(vec(spark, [-3, 4]), parts).collect()} == {(0, 3.0), (1, 4.0)}


def test_sparse_vectors(spark):
    y = vec(spark, [10, 20, 30, 40])
    x = spark.createDataFrame([(0, 2, 1.0), (1, 0, 2.0), (2, 2, 3.0)], "pos long, i long, v double")
    assert vectors.sparse_dot(x, y).first().value == 140
    assert values(vectors.sparse_axpy(2.0, x, y)) == [14, 20, 38, 40]
    assert [r.v for r in vectors.gather(x, y).orderBy("pos").collect()] == [30, 10, 30]
    taken, left = vectors.gather_zero(x, y)
    assert [r.v for r in taken.orderBy("pos").collect()] == [30, 10, 0] and values(left) == [0, 20, 0, 40]
    assert values(vectors.scatter(y, x)) == [2, 20, 3, 40]


def test_vector_errors_and_argmax(spark):
    assert vectors.iamax(vec(spark, [-5, 3, 5])).first().i == 0
    assert vectors.iamax(vec(spark, [1]).where("false")).first().i == 0
    assert values(vectors.scal(0, vec(spark, [float("nan"), 1]))) == [0, 0]
    for call, code in (
        (lambda: vectors.swap(vec(spark, [1]), vec(spark, [1, 2])), Code.VECTOR_INCOMPATIBLE_SIZE),
        (lambda: vectors.check_full(vec(spark, [1, 2]).where("i = 1"), 2), Code.VECTOR_EXPECTED_FULL),
        (lambda: vectors.check_packed(vec(spark, [1]), 1), Code.VECTOR_EXPECTED_PACKED),
        (lambda: vectors.check_packed(vec(spark, [1, 2]).withColumn("pos", F.col("i")), 1), Code.INDEX_OUT_OF_BOUNDS),
    ):
        with pytest.raises(EngineError) as e:
            call()
        assert e.value.code is code
