"""Matrix Market files: text (plain or gzip) and a binary twin, read to relations and written from them.

Data lines are parsed by Spark's own expressions on a file that is split over tasks; the driver reads on in the header,
block by block, until its size line. Lines are put in order by the byte where their split begins and by their place in
it, whatever tasks the splits fall to; only array data, where the place is the index, and errors need that order.

Text is written by tasks as sorted part files, which the file system then appends to the header one after another:
bytes pass from stream to stream, never through Python or a table on the driver. Parts of a gzip file are members of
their own. Binary files hold three columns one after another. Spark has no reader of byte ranges, so files of up to
WHOLE_BYTES are read by a task and larger ones block by block through the driver, in bounded memory either way.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scan import row_rank
from ..functions.scratch import remove, scratch_base, written
from ..model import Code, EngineError, Header, entry_count

#: Fixed by the format.
OBJECTS = ("matrix", "vector")
FORMATS = ("array", "coordinate")
FIELDS = ("real", "integer", "complex", "pattern")
SYMMETRIES = ("general", "symmetric", "skew-symmetric", "hermitian")
#: Longest header line.
LINE_BYTES = 1 << 20


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


#: Bytes read at once from the beginning of a file.
BLOCK = 1 << 16
#: A binary file of up to so many bytes is one row of a task.
WHOLE_BYTES = 1 << 28
#: Entries of a larger one that pass the driver at once.
STREAM_ROWS = 1 << 20


def _blocks(spark: SparkSession, path: str) -> Iterator[bytes]:
    """The bytes of a file in any store that Spark reads, a block at a time, unpacked if they are gzip."""
    p, fs = _fs(spark, path)
    source = fs.open(p)
    try:
        unpack = None
        first = True
        while raw := bytes(source.readNBytes(BLOCK)):
            if first and raw[:2] == b"\x1f\x8b":
                unpack = zlib.decompressobj(31)
            first = False
            if unpack is None:
                yield raw
                continue
            while raw:
                if out := unpack.decompress(raw):
                    yield out
                raw = unpack.unused_data
                if unpack.eof:
                    unpack = zlib.decompressobj(31)  # the next member
    finally:
        source.close()


def parse_header(blocks: Iterator[bytes]) -> tuple[Header, int]:
    """The header and the bytes it takes."""
    raw, at, number, comments = bytearray(), 0, 0, []

    def line() -> str:
        nonlocal at, number
        looked = at
        while (end := raw.find(b"\n", looked)) < 0:
            if len(raw) - at > LINE_BYTES:
                raise EngineError(Code.LINE_TOO_LONG, line=number + 1)
            looked = len(raw)
            more = next(blocks, b"")
            if not more:
                if at >= len(raw):
                    raise EngineError(Code.EOF, line=number + 1)
                end = len(raw)
                break
            raw.extend(more)
        if end - at > LINE_BYTES:
            raise EngineError(Code.LINE_TOO_LONG, line=number + 1)
        text = raw[at:end].decode("utf-8", "replace")
        at, number = end + 1, number + 1
        return text.rstrip("\r")

    banner = line().split(" ")
    if len(banner) != 5 or banner[0] != "%%MatrixMarket":
        raise EngineError(Code.EINVAL, "not a Matrix Market banner", number)
    obj, form, fld, sym = banner[1:]
    sym = "hermitian" if sym == "Hermitian" else sym
    if obj not in OBJECTS or form not in FORMATS or fld not in FIELDS or sym not in SYMMETRIES:
        raise EngineError(Code.EINVAL, "unknown word in the banner", number)
    text = line()
    while text.startswith("%"):
        comments.append(text + "\n")
        text = line()
    need = {("matrix", "coordinate"): 3, ("matrix", "array"): 2, ("vector", "coordinate"): 2, ("vector", "array"): 1}[obj, form]
    parts = text.split(" ")
    if len(parts) != need or not all(re.fullmatch(r"\d+", p) for p in parts):
        raise EngineError(Code.EINVAL, "not a size line", number)
    size = [int(p) for p in parts]
    if max(size) >= 1 << 63:
        raise EngineError(Code.ERANGE, "size line", number)
    rows = size[0]
    cols = size[1] if obj == "matrix" else 1
    nnz = size[-1] if form == "coordinate" else entry_count(obj, form, sym, rows, cols)
    return Header(obj, form, fld, sym, rows, cols, nnz, tuple(comments)), at


def header(spark: SparkSession, path: str) -> Header:
    return parse_header(_blocks(spark, path))[0]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """value, block, at: all lines; (block, at) rises through the file, block being where the line's split begins."""
    return spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def _data_lines(lines: DataFrame) -> DataFrame:
    """The lines after the header. The size line is the first that isn't a comment."""
    lines = lines.where(~F.col("value").startswith("%") & (F.length("value") > 0))
    first = lines.agg(F.min(F.struct("block", "at"))).first()[0]
    return lines.where(~_up_to(first)) if first else lines


def _up_to(row):
    """Whether a line stands no later than row (block, at)."""
    return (F.col("block") < row["block"]) | (F.col("block") == row["block"]) & (F.col("at") <= row["at"])


def _line_number(lines: DataFrame, row) -> int:
    """The number in the file, from 1, of the line that row (block, at) names."""
    return lines.where(_up_to(row)).count()


def _place(i, h: Header):
    """Row and column of the stored entries of an array, row by row; symmetric ones hold the lower triangle."""
    if h.object == "vector" or h.symmetry == "general":
        cols = max(h.ncols, 1)
        return F.floor(i / cols).cast("long"), (i % cols).cast("long")
    shift = 0 if h.symmetry != "skew-symmetric" else 1
    row = F.floor((F.sqrt(8.0 * i + 1.0) - 1.0) / 2.0).cast("long")
    # the root may be one off for large i
    row = F.when(row * (row + 1) / 2 > i, row - 1).when((row + 1) * (row + 2) / 2 <= i, row + 1).otherwise(row)
    return row + shift, (i - (row * (row + 1) / 2)).cast("long")


def _whole(c):
    """A number that fits 64 bits, null for others."""
    return F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast("long"))


def read(spark: SparkSession, path: str) -> tuple[Header, DataFrame]:
    """The header and its entries with 0-based places: (i, j, a) or (i, v).

    Values are doubles, longs in integer files, structs (re, im) in complex ones, and 1.0 in pattern files.
    """
    h = header(spark, path)
    if h.object == "vector" and h.format == "coordinate":
        raise EngineError(Code.NOT_SUPPORTED, "coordinate vectors")
    every = _lines(spark, path)
    f = F.split("value", " ")
    places = 2 if h.format == "coordinate" else 0
    width = places + h.nvalspernz
    field = lambda k: F.get(f, F.lit(k))
    number = _whole if h.field == "integer" else (lambda c: c.try_cast("double"))
    if h.field == "pattern":
        value = F.lit(1.0)
    elif h.field == "complex":
        value = F.struct(number(field(places)).alias("re"), number(field(places + 1)).alias("im"))
    else:
        value = number(field(places))
    index = [(_whole(field(k)) - 1).alias("ij"[k]) for k in range(places)]
    # places, and integer values, that are numbers but don't fit
    whole = [*range(places), *([places] if h.field == "integer" else [])]
    large = F.lit(False)
    for k in whole:
        large = large | F.coalesce(field(k).rlike(r"^[+-]?[0-9]+$") & field(k).try_cast("long").isNull(), F.lit(False))
    typed = _data_lines(every).select("block", "at", F.size(f).alias("w"), large.alias("large"), *index, value.alias("a"))
    bad = (F.col("w") != width) | (F.col("a.re").isNull() | F.col("a.im").isNull() if h.field == "complex" else F.col("a").isNull())
    if places:
        outside = (F.col("i") < 0) | (F.col("i") >= h.nrows) | (F.col("j") < 0) | (F.col("j") >= h.ncols)
        bad = bad | F.col("i").isNull() | F.col("j").isNull() | outside
    place = F.struct("block", "at", "large")
    n, wrong, first = typed.agg(F.count("*"), F.count_if(bad), F.min(F.when(bad, place))).first()
    if wrong:
        raise EngineError(Code.ERANGE if first["large"] else Code.EINVAL, f"{wrong} data lines", _line_number(every, first))
    if n < h.nnz:
        raise EngineError(Code.EOF, f"{n} of {h.nnz} entries")
    if n > h.nnz:
        raise EngineError(Code.EINVAL, f"{n} entries for {h.nnz}")
    if places:
        return h, typed.select("i", "j", "a")
    ranked = row_rank(typed.select("block", "at", "a"), ["block", "at"], "k")
    if h.object == "vector" or h.ncols == 1 and h.symmetry == "general":
        return h, ranked.select(F.col("k").alias("i"), F.col("a").alias("v"))
    i, j = _place(F.col("k"), h)
    return h, ranked.select(i.alias("i"), j.alias("j"), "a")


def _columns(index: list[np.ndarray], values: np.ndarray, first: int) -> pa.RecordBatch:
    v = pa.array(values.astype(np.int64 if values.dtype.kind == "i" else np.float64))
    if index:
        return pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64) - 1) for x in index), v], ["i", "j", "a"])
    return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(values))), v], ["i", "v"])


def read_binary(spark: SparkSession, path: str, values: str = "double", index_bytes: int = 4) -> tuple[Header, DataFrame]:
    """As read() for the binary twin: a text header, then row numbers, column numbers (from 1) and values."""
    h, start = parse_header(_blocks(spark, path))
    if h.field in ("complex", "pattern") or h.object == "matrix" and h.format == "array":
        raise EngineError(Code.NOT_SUPPORTED, "this binary file")
    n, step = h.nnz, STREAM_ROWS
    kinds = [f"<i{index_bytes}"] * (2 if h.format == "coordinate" else 0) + ["<f8" if values == "double" else "<i4"]
    at = [start + n * sum(int(t[-1]) for t in kinds[:k]) for k in range(len(kinds) + 1)]
    p, fs = _fs(spark, path)
    size = fs.getFileStatus(p).getLen()
    if size < at[-1]:
        raise EngineError(Code.EOF, f"{size} of {at[-1]} bytes")
    number = "double" if values == "double" else "long"
    schema = f"i long, j long, a {number}" if len(kinds) > 1 else f"i long, v {number}"
    if size <= WHOLE_BYTES:

        def run(batches):
            for raw in (x.as_py() for b in batches for x in b.column(0)):
                for lo in range(0, n, step):
                    m = min(step, n - lo)
                    cols = [np.frombuffer(raw, t, m, a + lo * int(t[-1])) for t, a in zip(kinds, at, strict=False)]
                    yield _columns(cols[:-1], cols[-1], lo)

        return h, spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)
    folder = f"{scratch_base(spark)}/sparsecg-binary-{uuid.uuid4().hex}"
    sources = [fs.open(p) for _ in kinds]
    try:
        for lo in range(0, n, step):
            m, cols = min(step, n - lo), []
            for source, t, a in zip(sources, kinds, at, strict=False):
                source.seek(a + lo * int(t[-1]))
                cols.append(np.frombuffer(bytes(source.readNBytes(m * int(t[-1]))), t))
            part = pa.Table.from_batches([_columns(cols[:-1], cols[-1], lo)])
            spark.createDataFrame(part, schema).write.mode("append").parquet(folder)
    finally:
        for source in sources:
            source.close()
    return h, spark.read.schema(schema).parquet(folder)


def _check(comments: tuple[str, ...], numfmt: str) -> None:
    for c in comments:
        if not c.startswith("%") or not c.endswith("\n"):
            raise EngineError(Code.MTX_INVALID_COMMENT)
    if not re.fullmatch(r"%[-+ #0]*\d*(\.\d+)?[eEfFgG]", numfmt):
        raise EngineError(Code.INVALID_FORMAT_SPECIFIER, numfmt)


def _banner(h: Header) -> str:
    size = f"{h.nrows} {h.ncols} {h.nnz}" if (h.object, h.format) == ("matrix", "coordinate") else f"{h.nrows} {h.ncols}" if h.object == "matrix" else f"{h.nrows}" if h.format == "array" else f"{h.nrows} {h.nnz}"
    return f"%%MatrixMarket {h.object} {h.format} {h.field} {h.symmetry}\n" + "".join(h.comments) + size + "\n"


def _put(spark: SparkSession, path: str, chunks) -> None:
    """Streams byte chunks into one file of any store."""
    p, fs = _fs(spark, path)
    out = fs.create(p, True)
    try:
        for c in chunks:
            out.write(bytearray(c))
    finally:
        out.close()


def _join_parts(spark: SparkSession, path: str, head: bytes, folder: str) -> None:
    """One file of head and the part files of a folder in their order, copied from stream to stream in the JVM."""
    p, fs = _fs(spark, path)
    q, parts = _fs(spark, folder)
    copy = spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes
    names = sorted(f.getPath().toString() for f in parts.listStatus(q) if f.getPath().getName().startswith("part-"))
    out = fs.create(p, True)
    try:
        out.write(bytearray(head))
        for name in names:
            source = parts.open(spark._jvm.org.apache.hadoop.fs.Path(name))
            try:
                copy(source, out, BLOCK, False)
            finally:
                source.close()
    finally:
        out.close()


def _names(df: DataFrame) -> tuple[list[str], str]:
    return (["i", "j"] if "j" in df.columns else ["i"]), ("a" if "a" in df.columns else "v")


def merged(df: DataFrame) -> DataFrame:
    """df with the values of equal places added up."""
    names, value = _names(df)
    if df.schema[value].dataType.simpleString().startswith("struct"):
        total = F.struct(F.sum(f"{value}.re").alias("re"), F.sum(f"{value}.im").alias("im"))
    else:
        total = F.sum(value)
    return df.groupBy(*names).agg(total.alias(value))


def write(df: DataFrame, path: str, h: Header, numfmt: str = "%.15g", compress: bool = False, merge: bool = False) -> Header:
    """Writes (i, j, a), (i, v) or packed (pos, i, v) as one text file, numbers as C prints them; returns its header.

    Matrices and full vectors are written in row-major order, packed vectors in the order of pos. merge adds up the
    values of equal places first; the header then counts what is left.
    """
    _check(h.comments, numfmt)
    spark = df.sparkSession
    names, value = _names(df)
    order = ["pos"] if "pos" in df.columns else names
    if h.symmetry == "symmetric" and len(names) == 2:
        df = df.select(F.greatest("i", "j").alias("i"), F.least("i", "j").alias("j"), value)
    if merge:
        order = names
        df = written(merged(df), "merged")
        h = Header(h.object, h.format, h.field, h.symmetry, h.nrows, h.ncols, df.count(), h.comments)
    coordinate, integer, pattern = h.format == "coordinate", h.field == "integer", h.field == "pattern"

    def lines(batches):
        for b in batches:
            cols = [b.column(k).to_pylist() for k in range(b.num_columns)]
            out = []
            for row in zip(*cols, strict=True):
                x = row[-1]
                text = [] if pattern else [numfmt % x["re"], numfmt % x["im"]] if isinstance(x, dict) else [str(int(x))] if integer else [numfmt % x]
                out.append(" ".join([str(k + 1) for k in row[:-1] if coordinate] + text))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(["\n".join(out)])], ["block"])

    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).select(*names, value)
    folder = f"{scratch_base(spark)}/sparsecg-parts-{uuid.uuid4().hex}"
    ordered.mapInArrow(lines, "block string").write.option("compression", "gzip" if compress else "none").text(folder)
    head = _banner(h).encode()
    if compress:
        pack = zlib.compressobj(wbits=31)
        head = pack.compress(head) + pack.flush()
    _join_parts(spark, path, head, folder)
    remove(spark, folder)
    return h


def write_binary(df: DataFrame, path: str, h: Header, values: str = "double", index_bytes: int = 4) -> None:
    """The binary twin of a coordinate matrix, or of an integer array vector.

    Entries are sorted once and packed by tasks; the driver passes the three columns on block by block.
    """
    vector = h.object == "vector" or "j" not in df.columns
    if vector and values == "double" or h.field in ("complex", "pattern") or not vector and h.format == "array":
        raise EngineError(Code.NOT_SUPPORTED, "this binary file")
    names, value = ["i"] if vector else ["i", "j"], _names(df)[1]
    kind = "<f8" if values == "double" else "<i4"

    def packed(batches):
        from pyspark import TaskContext

        k = 0
        for b in batches:
            for lo in range(0, b.num_rows, 1 << 17):
                cols = [c.to_numpy(zero_copy_only=False) for c in b.slice(lo, 1 << 17).columns]
                raw = [(c + 1).astype(f"<i{index_bytes}").tobytes() for c in cols[:-1]] + [cols[-1].astype(kind).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([k], pa.int64()), *(pa.array([r], pa.binary()) for r in raw)], ["part", "k", *names, "value"])
                k += 1

    ordered = df.select(*names, value).repartitionByRange(*names).sortWithinPartitions(*names)
    blocks = written(ordered.mapInArrow(packed, f"part long, k long, {', '.join(f'{n} binary' for n in names)}, value binary"), "packed")

    def chunks():
        yield _banner(h).encode()
        for name in [value] if vector else [*names, value]:
            column = "value" if name == value else name
            for r in blocks.orderBy("part", "k").select(column).toLocalIterator():
                yield r[0]

    _put(df.sparkSession, path, chunks())


def solver_matrix(spark: SparkSession, path: str) -> tuple[Header, DataFrame]:
    """As read(), for matrices that a solver takes: symmetric, coordinate, not complex."""
    h, a = read(spark, path)
    if h.object != "matrix" or h.format != "coordinate" or h.symmetry != "symmetric" or h.field == "complex":
        raise EngineError(Code.NOT_SUPPORTED, "a solver takes real symmetric coordinate matrices")
    return h, a.select("i", "j", F.col("a").cast("double").alias("a"))
