import gzip

import pytest

from sparsecg.model import Code, EngineError, Header, entry_count
from sparsecg.sources import matrix_market as mm

LAP3 = "%%MatrixMarket matrix coordinate real symmetric\n% made by hand\n3 3 5\n1 1 2\n2 1 -1\n2 2 2\n3 2 -1\n3 3 2\n"
WANT = {(0, 0, 2.0), (1, 0, -1.0), (1, 1, 2.0), (2, 1, -1.0), (2, 2, 2.0)}


def put(tmp_path, text, name="a.mtx"):
    p = tmp_path / name
    p.write_bytes(gzip.compress(text.encode()) if name.endswith(".gz") else text.encode())
    return str(p)


def entries(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("name", ["a.mtx", "a.mtx.gz"])
def test_read(spark, tmp_path, name):
    h, a = mm.read(spark, put(tmp_path, LAP3, name))
    assert (h.nrows, h.ncols, h.nnz, h.comments) == (3, 3, 5, ("% made by hand\n",))
    assert entries(a) == WANT


def test_fields(spark, tmp_path):
    head = "%%MatrixMarket matrix coordinate {} general\n1 2 1\n1 2{}\n"
    assert entries(mm.read(spark, put(tmp_path, head.format("pattern", "")))[1]) == {(0, 1, 1.0)}
    assert entries(mm.read(spark, put(tmp_path, head.format("integer", " 7")))[1]) == {(0, 1, 7.0)}
    r = mm.read(spark, put(tmp_path, head.format("complex", " 1 -2")))[1].first()
    assert (r.a.re, r.a.im) == (1.0, -2.0)


def test_arrays(spark, tmp_path):
    a = mm.read(spark, put(tmp_path, "%%MatrixMarket matrix array real general\n2 3\n1\n2\n3\n4\n5\n6\n"))[1]
    assert entries(a) == {(i, j, 3.0 * i + j + 1) for i in range(2) for j in range(3)}
    s = mm.read(spark, put(tmp_path, "%%MatrixMarket matrix array real symmetric\n2 2\n1\n2\n3\n"))[1]
    assert entries(s) == {(0, 0, 1.0), (1, 0, 2.0), (1, 1, 3.0)}
    v = mm.read(spark, put(tmp_path, "%%MatrixMarket vector array real general\n3\n1\n2\n3\n"))[1]
    assert entries(v) == {(0, 1.0), (1, 2.0), (2, 3.0)}


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ("%%Matrix matrix coordinate real symmetric\n1 1 0\n", Code.EINVAL),
        ("%%MatrixMarket matrix coordinate rational symmetric\n1 1 0\n", Code.EINVAL),
        ("%%MatrixMarket matrix coordinate real symmetric\n1 1\n", Code.EINVAL),
        ("%%MatrixMarket matrix coordinate real symmetric\n", Code.EOF),
        ("%%MatrixMarket matrix coordinate real general\n2 2 2\n1 1 1\n", Code.EOF),
        ("%%MatrixMarket matrix coordinate real general\n2 2 1\n1\t1\t1\n", Code.EINVAL),
        ("%%MatrixMarket matrix coordinate real general\n2 2 1\n3 1 1\n", Code.EINVAL),
        ("%%MatrixMarket vector coordinate real general\n3 1\n1 1\n", Code.NOT_SUPPORTED),
    ],
)
def test_malformed(spark, tmp_path, text, code):
    with pytest.raises(EngineError) as e:
        mm.read(spark, put(tmp_path, text))
    assert e.value.code is code


LONG = LAP3.replace("% made by hand\n", "".join(f"% comment {k} " + "x" * 90 + "\n" for k in range(2000)))


@pytest.mark.parametrize("name", ["a.mtx", "a.mtx.gz"])
def test_long_headers(spark, tmp_path, name):
    h, a = mm.read(spark, put(tmp_path, LONG, name))
    assert len(h.comments) == 2000 and entries(a) == WANT
    with pytest.raises(EngineError) as e:
        mm.read(spark, put(tmp_path, LAP3.replace("made by hand", "x" * (mm.LINE_BYTES + 70_000)), name))
    assert e.value.code is Code.LINE_TOO_LONG


@pytest.mark.parametrize(
    ("line", "code"),
    [("2 x 1", Code.EINVAL), ("2 2 one", Code.EINVAL), ("4 1 1", Code.EINVAL), ("99999999999999999999 1 1", Code.ERANGE), ("1 2", Code.EINVAL)],
)
def test_bad_lines_are_named(spark, tmp_path, line, code):
    with pytest.raises(EngineError) as e:
        mm.read(spark, put(tmp_path, LAP3.replace("3 2 -1", line)))
    assert (e.value.code, e.value.line) == (code, 7)


def test_integers_stay_integers(spark, tmp_path):
    text = "%%MatrixMarket matrix coordinate integer general\n2 2 2\n1 1 9007199254740993\n2 2 -7\n"
    h, a = mm.read(spark, put(tmp_path, text))
    assert entries(a) == {(0, 0, 9007199254740993), (1, 1, -7)} and a.schema["a"].dataType.simpleString() == "bigint"
    mm.write(a, str(tmp_path / "o.mtx"), h)
    assert (tmp_path / "o.mtx").read_text() == text
    with pytest.raises(EngineError) as e:
        mm.read(spark, put(tmp_path, text.replace("9007199254740993", "9223372036854775808")))
    assert e.value.code is Code.ERANGE and e.value.line == 3
    with pytest.raises(EngineError) as e:
        mm.read(spark, put(tmp_path, text.replace("-7", "1.5")))
    assert e.value.code is Code.EINVAL and e.value.line == 4


def test_lines_keep_their_places_over_splits(spark, tmp_path):
    n = 5000
    text = f"%%MatrixMarket vector array real general\n{n}\n" + "".join(f"{k}\n" for k in range(n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        assert entries(mm.read(spark, put(tmp_path, text))[1]) == {(k, float(k)) for k in range(n)}
        with pytest.raises(EngineError) as e:
            mm.read(spark, put(tmp_path, text.replace("\n3000\n", "\nthree\n")))
        assert e.value.line == 3003
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_merging_duplicates(spark, tmp_path):
    h = Header("matrix", "coordinate", "real", "symmetric", 3, 3, 3)
    a = spark.createDataFrame([(0, 1, 1.5), (1, 0, 2.0), (2, 2, 4.0)], "i long, j long, a double")
    assert mm.write(a, str(tmp_path / "o.mtx"), h, merge=True).nnz == 2
    assert entries(mm.read(spark, str(tmp_path / "o.mtx"))[1]) == {(1, 0, 3.5), (2, 2, 4.0)}
    c = spark.createDataFrame([(0, 0, (1.0, 2.0)), (0, 0, (3.0, -1.0))], "i long, j long, a struct<re: double, im: double>")
    mm.write(c, str(tmp_path / "c.mtx"), Header("matrix", "coordinate", "complex", "general", 1, 1, 2), merge=True)
    assert (tmp_path / "c.mtx").read_text().endswith("1 1 1\n1 1 4 1\n")


def test_packed_vectors_are_written_by_position(spark, tmp_path):
    x = spark.createDataFrame([(0, 2, 1.0), (1, 0, 2.0), (2, 2, 3.0)], "pos long, i long, v double")
    mm.write(x, str(tmp_path / "x.mtx"), Header("vector", "coordinate", "real", "general", 4, 1, 3))
    assert (tmp_path / "x.mtx").read_text().splitlines()[1:] == ["4 3", "3 1", "1 2", "3 3"]


@pytest.mark.parametrize(("whole", "kind", "index"), [(1 << 28, "double", 4), (10, "double", 8), (10, "integer", 4)])
def test_binary_by_blocks(spark, tmp_path, monkeypatch, whole, kind, index):
    monkeypatch.setattr(mm, "WHOLE_BYTES", whole)
    monkeypatch.setattr(mm, "STREAM_ROWS", 700)
    rows = [(i, j, i * 3 + j) for i in range(60) for j in range(i % 50 + 1)]
    a = spark.createDataFrame(rows, "i long, j long, a long")
    h = Header("matrix", "coordinate", "integer" if kind == "integer" else "real", "general", 60, 50, len(rows))
    mm.write_binary(a, str(tmp_path / "b.mtx"), h, kind, index)
    got = mm.read_binary(spark, str(tmp_path / "b.mtx"), kind, index)[1]
    assert entries(got) == set(rows) and got.count() == len(rows)
    (tmp_path / "short.mtx").write_bytes((tmp_path / "b.mtx").read_bytes()[:-1])
    with pytest.raises(EngineError) as e:
        mm.read_binary(spark, str(tmp_path / "short.mtx"), kind, index)
    assert e.value.code is Code.EOF


def test_solver_rejects(spark, tmp_path):
    with pytest.raises(EngineError):
        mm.solver_matrix(spark, put(tmp_path, LAP3.replace("symmetric", "general")))


def test_write_and_binary(spark, tmp_path):
    h, a = mm.read(spark, put(tmp_path, LAP3))
    for kwargs in ({}, {"compress": True}, {"numfmt": "%.3e"}):
        path = str(tmp_path / ("o.mtx.gz" if kwargs.get("compress") else "o.mtx"))
        mm.write(a, path, h, **kwargs)
        assert entries(mm.read(spark, path)[1]) == WANT
    mm.write_binary(a, str(tmp_path / "b.mtx"), h)
    assert entries(mm.read_binary(spark, str(tmp_path / "b.mtx"))[1]) == WANT


def test_writer_validation(spark, tmp_path):
    h, a = mm.read(spark, put(tmp_path, LAP3))
    with pytest.raises(EngineError) as e:
        mm.write(a, str(tmp_path / "x"), h, "%*g")
    assert e.value.code is Code.INVALID_FORMAT_SPECIFIER
    with pytest.raises(EngineError) as e:
        mm.write(a, str(tmp_path / "x"), Header(*[getattr(h, f) for f in ("object", "format", "field", "symmetry", "nrows", "ncols", "nnz")], ("no percent\n",)))
    assert e.value.code is Code.MTX_INVALID_COMMENT


def test_entry_count():
    assert entry_count("matrix", "array", "symmetric", 4, 4) == 10
    assert entry_count("matrix", "array", "hermitian", 4, 4) == 10
    assert entry_count("matrix", "array", "skew-symmetric", 4, 4) == 6
    assert entry_count("matrix", "array", "general", 2, 3) == 6
