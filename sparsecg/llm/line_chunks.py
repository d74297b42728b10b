"""Line dedup over content-defined chunks of lines.

A text is cut into lines at line feeds. A rolling hash over the hashes of the last WINDOW lines decides, by
content alone, after which lines a chunk ends, so a chunk that two documents share is cut alike wherever it
stands. A line of LONG_WORDS words or more is a passage of its own and forms one chunk; other chunks have two
lines at least to count. Besides chunks, passages are taken, whatever chunks they meet: from every line that has
words, the shortest run of lines that starts there, and the shortest that ends there, with LONG_WORDS words. Any
run of lines that a text shares with another and that has LONG_WORDS words is covered by such passages whole,
into however many lines it may be laid out. Chunks and passages, called spans below, of equal 128-bit digest in
two or more places are compared byte by byte (the texts of all places are grouped by their bytes); the first place
by doc_id, then text hash and line stays and the others go, but for those that overlap the first one in its own
text. A line that goes has an equal line at an earlier place, so one copy of each line is left.

Only digests are shuffled for all spans; bytes travel for repeated spans alone. A span that a third of all
documents share is combined before the shuffle and joined as a skewed key; per document only its own spans meet.

Defined results: null text stays null; rows that repeat doc_id and text are one document and get the same result;
rows without doc_id stay as they are; ties in place can't occur, as place is unique within a document; empty
texts have one empty line and lose nothing; an empty table gives an empty result; other columns are carried on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import arrow_map, column, drop, slices, written

WINDOW = 2
#: One line in so many ends a chunk, on average.
DIVISOR = 4
LONG_WORDS = 50
MASK = (1 << 64) - 1
FACTOR = 0x9E3779B97F4A7C15
LEAVING = pow(FACTOR, WINDOW, 1 << 64)


def chunk_lines(lines: list[str]) -> list[tuple[int, int]]:
    """Chunks (first line, line after the last) that can be removed if they repeat."""
    out, start, rolled = [], 0, 0
    hashes = [xxhash.xxh64_intdigest(x.encode("utf-8", "replace")) for x in lines]
    for i, line in enumerate(lines):
        # of the last WINDOW lines: the new one comes in, the one before them goes out
        rolled = (rolled * FACTOR + hashes[i] - (hashes[i - WINDOW] * LEAVING if i >= WINDOW else 0)) & MASK
        if len(line) >= 2 * LONG_WORDS - 1 and len(line.split()) >= LONG_WORDS:
            if i - start > 1:
                out.append((start, i))
            out.append((i, i + 1))
            start = i + 1
            continue
        if (rolled >> 20) % DIVISOR == 0 and i + 1 - start > 1:
            out.append((start, i + 1))
            start = i + 1
    if len(lines) - start > 1:
        out.append((start, len(lines)))
    return out


def passages(lines: list[str]) -> list[tuple[int, int]]:
    """Shortest runs of two lines or more with LONG_WORDS words that start or end at a line with words."""
    words = [len(x.split()) for x in lines]
    at = [i for i, w in enumerate(words) if w]
    if sum(words) < LONG_WORDS:
        return []
    out, end, held = set(), 0, 0
    for k, i in enumerate(at):  # held: words of the lines at[k:end]
        while end < len(at) and held < LONG_WORDS:
            held += words[at[end]]
            end += 1
        if held < LONG_WORDS:
            break
        out.add((i, at[end - 1] + 1))
        held -= words[i]
    start, held = 0, 0
    for i in at:
        held += words[i]
        while held - words[at[start]] >= LONG_WORDS:
            held -= words[at[start]]
            start += 1
        if held >= LONG_WORDS:
            out.add((at[start], i + 1))
    return [(a, z) for a, z in out if z - a > 1]


def spans(lines: list[str]) -> list[tuple[int, int]]:
    """Chunks and passages: all that can be removed if it repeats."""
    return sorted({*chunk_lines(lines), *passages(lines)})


def _digests(batches: Iterator[pa.RecordBatch], cut: Callable[[list[str]], list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, keys = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        texts = b.column(2).to_pylist()
        for lo, hi in slices(texts):
            row, first, last, digest = [], [], [], []
            for i in range(lo, hi):
                lines = texts[i].split("\n")
                for a, z in cut(lines):
                    row.append(i)
                    first.append(a)
                    last.append(z)
                    digest.append(xxhash.xxh3_128_digest("\n".join(lines[a:z]).encode("utf-8", "replace")))
            h = np.frombuffer(b"".join(digest), ">i8").reshape(-1, 2).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(keys[row]), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1])], ["doc_id", "key", "lo", "hi", "h1", "h2"])


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, chunks(lo, hi, h1, h2) -> h1, h2, bytes of each chunk."""
    for b in batches:
        for text, chunks in zip((x.as_py() for x in b.column(0)), (x.as_py() for x in b.column(1)), strict=True):
            lines = text.split("\n")
            yield pa.RecordBatch.from_arrays([pa.array([c["h1"] for c in chunks], pa.int64()), pa.array([c["h2"] for c in chunks], pa.int64()), pa.array(["\n".join(lines[c["lo"] : c["hi"]]).encode("utf-8", "replace") for c in chunks], pa.binary())], ["h1", "h2", "bytes"])


def _joined(batches: Iterator[pa.RecordBatch], size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Fewer, larger batches of _bytes."""
    held, n = [], 0
    for b in _bytes(batches):
        held.append(b)
        n += b.nbytes
        if n > 1 << 20 or len(held) > size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if held and sum(map(len, held)):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, text, removed -> row, text without these lines, number of lines and of removed lines."""
    for b in batches:
        texts, n, gone = [], [], []
        for text, removed in zip((x.as_py() for x in b.column(1)), (x.as_py() for x in b.column(2)), strict=True):
            lines = text.split("\n") if text is not None else []
            n.append(len(lines))
            out = bytearray(len(lines))  # spans may overlap
            for c in removed or ():
                out[c["lo"] : c["hi"]] = b"\1" * (c["hi"] - c["lo"])
            gone.append(sum(out))
            texts.append(None if text is None else "\n".join(x for x, o in zip(lines, out, strict=True) if not o))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], ["row", "text", "n_lines", "n_removed"])


def repeated(docs: DataFrame, cut: Callable[[list[str]], list[tuple[int, int]]]) -> DataFrame:
    """doc_id, key (hash of the text), lo, hi: the runs of lines by cut of docs(doc_id, text) that repeat an earlier place."""
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("key"), F.col("text").cast("string").alias("text"))
    chunks = written(arrow_map(rows, partial(_digests, cut=cut), "doc_id long, key long, lo int, hi int, h1 long, h2 long").dropDuplicates(["doc_id", "key", "lo", "hi"]), "chunks")
    # what joins meet is stored first, so that both sides are plain exchanges and a very common chunk can be split
    twice = written(chunks.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1").drop("n"), "twice")
    places = written(chunks.join(twice, ["h1", "h2"]), "places")
    own = places.groupBy("doc_id", "key").agg(F.collect_list(F.struct("lo", "hi", "h1", "h2")).alias("chunks"))  # a document's own
    texts = rows.join(own.hint("shuffle_hash"), ["doc_id", "key"]).select("text", "chunks")
    same = arrow_map(texts, _joined, "h1 long, h2 long, bytes binary").groupBy("h1", "h2", "bytes").agg(F.count("*").alias("n"))
    sure = same.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n = 1").select("h1", "h2")
    first = places.where("doc_id = first").groupBy("h1", "h2").agg(F.min(F.struct("key", "lo")).alias("at"))
    verdict = written(sure.join(first, ["h1", "h2"]), "verdict")
    gone = places.join(verdict, ["h1", "h2"]).where("not (doc_id = first and key = at.key and lo < at.lo + hi - lo)")
    removed = written(gone.select("doc_id", "key", "lo", "hi"), "removed")
    drop(chunks, twice, places, verdict)
    return removed


def remove_repeated(docs: DataFrame, cut: Callable[[list[str]], list[tuple[int, int]]] = chunk_lines) -> DataFrame:
    """row (all columns of docs but text), text cut to what no earlier place has, n_lines before, n_removed.

    cut says which runs of lines can go: chunks alone by default; cleaned and the query op3 take spans.
    """
    gone = repeated(docs, cut).groupBy("doc_id", "key").agg(F.collect_list(F.struct("lo", "hi")).alias("gone")).hint("shuffle_hash")
    text = docs["text"].cast("string")
    joined = docs.join(gone, (docs["doc_id"].cast("long") == gone["doc_id"]) & (F.xxhash64(text) == gone["key"]), "left")
    row = F.struct(*[column(docs, c) for c in docs.columns if c != "text"])
    packed = joined.select(row.alias("row"), text.alias("text"), gone["gone"].alias("gone"))
    return arrow_map(packed, _cut, StructType([packed.schema["row"], *StructType.fromDDL("text string, n_lines long, n_removed long").fields]))


def cleaned(docs: DataFrame) -> DataFrame:
    """docs with the lines gone, and n_chars, if there, brought up to date where lines went."""
    out = remove_repeated(docs, spans)
    cols = []
    for f in docs.schema:
        c = F.col("text").cast(f.dataType) if f.name == "text" else F.col("row")[f.name]
        if f.name == "n_chars":
            c = F.when(F.col("n_removed") > 0, F.char_length("text").cast(f.dataType)).otherwise(c)
        cols.append(c.alias(f.name))
    return out.select(*cols)
