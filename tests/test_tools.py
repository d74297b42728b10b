import numpy as np
import pytest

from sparsecg import cli
from sparsecg.operators import partition
from sparsecg.plans import partitioners
from sparsecg.sources import matrix_market as mm

LAP3 = "%%MatrixMarket matrix coordinate real symmetric\n3 3 5\n1 1 2\n2 1 -1\n2 2 2\n3 2 -1\n3 3 2\n"


def test_partitioners_cover_and_cut_little(spark):
    n = 40
    e = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "u long, v long")
    nodes = spark.range(n).withColumnRenamed("id", "i")
    for labels in (partitioners.bisection(e, n, 4), partitioners.growing(e, nodes, n, 4), partitioners.contiguous(nodes, n, 4), partitioners.hashed(nodes, 4)):
        got = {r.i: r.p for r in labels.collect()}
        assert set(got) == set(range(n)) and set(got.values()) <= set(range(4))
    assert partition.edge_cut(e, partitioners.bisection(e, n, 4)).first().edgecut == 3


def test_kway_balances_and_cuts_less(spark):
    side = 12
    node = lambda x, y: x * side + y
    e = [(node(x, y), node(x + 1, y)) for x in range(side - 1) for y in range(side)] + [(node(x, y), node(x, y + 1)) for x in range(side) for y in range(side - 1)]
    e += [(node(0, 0), k) for k in range(40, 60)]  # a hub
    n = side * side + 9  # and nodes without edges
    edges, nodes = spark.createDataFrame(e, "u long, v long"), spark.range(n).withColumnRenamed("id", "i")
    grown = partitioners.growing(edges, nodes, n, 4)
    labels = partitioners.kway(edges, nodes, n, 4, 4)
    got = {r.i: r.p for r in labels.collect()}
    assert set(got) == set(range(n))
    sizes = np.bincount(list(got.values()), minlength=4)
    assert sizes.max() <= np.ceil(n / 4 * 1.05)
    hashed = partition.edge_cut(edges, partitioners.hashed(nodes, 4)).first().edgecut
    assert partition.edge_cut(edges, labels).first().edgecut < hashed / 2 and grown.count() == n


def test_general_dissection(spark):
    nz = spark.createDataFrame([(i, j, 1.0) for i in range(9) for j in range(i, min(9, i + 3))], "i long, j long, a double")
    for rows, cols in ((9, 9), (9, 11)):
        place = [r.place for r in partitioners.dissection_general(nz, rows, cols).collect()]
        assert sorted(place) == list(range(rows if rows == cols else rows + cols))


def test_standard_input(spark, tmp_path, monkeypatch):
    import io
    import types

    monkeypatch.setattr("sys.stdin", types.SimpleNamespace(buffer=io.BytesIO(LAP3.encode())))
    assert cli.main(["solve", "-", "-o", str(tmp_path / "x.mtx"), "-q"]) == 0
    assert [r.v for r in mm.read(spark, str(tmp_path / "x.mtx"))[1].orderBy("i").collect()] == pytest.approx([1.5, 2, 1.5])


def test_growing_reaches_beyond_fifty_levels(spark):
    n = 130
    e = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "u long, v long")
    e = e.selectExpr(f"(u * 61) % {n} u", f"(v * 61) % {n} v")  # a chain whose order isn't that of the numbers
    nodes = spark.range(n).withColumnRenamed("id", "i")
    got = {r.i: r.p for r in partitioners.growing(e, nodes, n, 2).collect()}
    chain = [got[i * 61 % n] for i in range(n)]
    # two seeds on the chain, each part one stretch of it
    assert sum(a != b for a, b in zip(chain, chain[1:])) == 1


def test_dissection_is_a_permutation_with_separators_last(spark):
    n = 31
    e = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "u long, v long")
    place = {r.i: r.place for r in partitioners.dissection(e, n).collect()}
    assert sorted(place.values()) == list(range(n))
    last = max(place, key=place.get)
    assert 10 < last < 20
    assert sorted(partitioners.dissect(0, np.empty(0, int), np.empty(0, int))) == []


@pytest.mark.parametrize("solver", ["classic", "pipelined", "one-task", "one-task-pipelined"])
def test_solve(spark, tmp_path, solver):
    a, x = tmp_path / "a.mtx", tmp_path / f"x-{solver}.mtx"
    a.write_text(LAP3)
    assert cli.main(["solve", str(a), "--solver", solver, "-o", str(x)]) == 0
    assert [r.v for r in mm.read(spark, str(x))[1].orderBy("i").collect()] == pytest.approx([1.5, 2, 1.5])


def test_manufactured_partition_convert(spark, tmp_path, capsys):
    a = tmp_path / "a.mtx"
    a.write_text(LAP3)
    assert cli.main(["solve", str(a), "--manufactured-solution"]) == 0
    assert float(capsys.readouterr().err.rsplit("error 2-norm: ", 1)[1]) < 1e-8
    assert cli.main(["partition", str(a), str(tmp_path / "p.mtx")]) == 0
    labels = [r.v for r in mm.read(spark, str(tmp_path / "p.mtx"))[1].collect()]
    assert sorted(set(labels)) == [1.0, 2.0]
    assert cli.main(["convert", str(a), str(tmp_path / "b.mtx")]) == 0
    assert mm.read_binary(spark, str(tmp_path / "b.mtx"))[1].count() == 5
    assert cli.main(["solve", str(a), str(a), "--manufactured-solution"]) == 1
