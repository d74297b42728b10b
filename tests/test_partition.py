import pytest

from sparsecg.model import Code, EngineError
from sparsecg.operators import coo, partition


@pytest.fixture(scope="module")
def path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(5)], "u long, v long")
    parts = spark.createDataFrame([(i, int(i > 2)) for i in range(6)], "i long, p int")
    return edges, parts


def test_path_graph(path):
    e, p = path
    assert partition.edge_cut(e, p).first().edgecut == 1
    assert {(r.i, r["class"]) for r in partition.classes(e, p).collect()} == {(0, "inner"), (1, "inner"), (2, "border"), (3, "border"), (4, "inner"), (5, "inner")}
    assert {tuple(r) for r in partition.ghosts(e, p).collect()} == {(0, 1, 3), (1, 0, 2)}
    assert {tuple(r) for r in partition.comm_matrix(partition.halo_send(e, p)).collect()} == {(0, 1, 1), (1, 0, 1)}


def test_counts_agree(path):
    e, p = path
    rows = partition.counts(e, p).collect()
    assert sum(r.owned for r in rows) == 6 and all(r.inner + r.border == r.owned for r in rows)


def test_ghost_values_are_owner_values(spark, path):
    e, p = path
    x = spark.createDataFrame([(i, i * 1.5) for i in range(6)], "i long, v double")
    assert all(r.v == r.i * 1.5 for r in partition.exchange(partition.halo_send(e, p), x).collect())


def test_bad_labels_and_permutations(spark):
    nz = spark.createDataFrame([(0, 0, 0, 1.0), (1, 1, 1, 1.0)], "k long, i long, j long, a double")
    parts = spark.createDataFrame([(0, 0), (1, 7)], "i long, p int")
    with pytest.raises(EngineError) as e:
        coo.label(nz, parts, "i", 4)
    assert e.value.code is Code.INVALID_VALUE
    with pytest.raises(EngineError):
        coo.permute(nz, spark.createDataFrame([(0, 0), (1, 0)], "k long, pos long"))


def test_inverse_permutation(spark):
    keys = spark.createDataFrame([(k, (k * 7) % 5) for k in range(20)], "k long, a long")
    perm = {r.k: r.pos for r in coo.sort_keys(keys, ["a"]).collect()}
    assert sorted(perm.values()) == list(range(20))
    order = sorted(perm, key=perm.get)
    assert order == sorted(range(20), key=lambda k: ((k * 7) % 5, k))
