"""Best-fit packing in bulk-synchronous rounds.

Documents become token ids plus an end id and are cut at the capacity. A piece longer than half the capacity opens a
sequence of its own. The others and the gaps of open sequences are two relations, and a round is:

1. A gap offers slots: as many of the largest piece's length as it holds, the last one with what is left over.
2. Pieces and slots are sorted by length into ranges of about RANGE_ROWS rows. Each range is swept upwards once: a slot
   takes the largest piece below it that no slot has taken yet, so a piece goes to its successor, the smallest slot that
   holds it, and of several that ask for one slot the largest, then the last by rank, gets it. This is the matching of
   brackets, pieces being the opening ones.
3. What a range leaves goes on to the next ones. The ranges' counts of slots and pieces left (a row for each range)
   give every one of them its level on the stack that the sweep carries over the borders; level by level, a slot takes
   the piece before it.
4. Gaps shrink by what their slots took, gaps below the smallest piece left are full, and new sequences are opened: as
   many as the pieces surely need that are longer than any gap, and half of those that the lengths left need beyond all
   gaps (all once they are few), so that pieces meet used gaps before new ones.

Rounds go on until no piece is left; once pieces and gaps fit one range, its task runs the rounds that remain. As a slot takes a piece, a gap's rest falls below the largest piece left, so
rounds grow with the logarithm of capacity and input. The driver sees counts by length (capacity rows at most) and by
range. Every length, however many pieces have it, is spread over ranges, as ranges are cut by piece and not by length.

Defined results: null text is empty and packs as the end id alone; repeated rows are packed each; an empty table
gives no rows; other columns are ignored; the packing depends on how the table is split, its sequences' number
hardly so.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, drop, slices, written

CAPACITY, END_ID = 2048, 0
#: Pieces and slots of a range that one task sweeps, on average.
RANGE_ROWS = 20_000
#: Words whose ids a Python worker remembers.
WORDS_KEPT = 400_000


#: Latin letters without combining marks, ASCII and nothing else.
_PLAIN = re.compile(r"[\t\n\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u02af]*").fullmatch
_MARKS = re.compile(r"[!-/:-@\[-`{-~]+")
_LETTERS = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u02af]+").fullmatch


class _Places(dict):
    """Words with their places; a word that is new gets the next place and is noted."""

    def __init__(self) -> None:
        super().__init__({"": 1})
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self) + 1
        self.new.append(word)
        return at


class WordIds:
    """Token ids of texts for a tokenizer that never joins across white space: each distinct word is encoded once.

    Texts are cut at spaces and line feeds only; any other white space stays inside a word for the tokenizer. Texts of
    Latin letters, ASCII marks and no control string are first put in lower case, as the tokenizer does, and cut before
    runs of marks too, where it always ends a word; so words repeat more often.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        # places 0 and 1: the end id and the empty word
        self.place, self.pool, self.used = _Places(), np.zeros(1 << 16, np.uint32), 1
        self.pool[0] = self.end_id
        self.start, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.start[1], self.size[0] = 1, 1

    def add(self, words: list[str]) -> None:
        """Remembers the ids of words. Plain ones are encoded many in one text and told apart by their end marks."""
        plain = [w for w in words if _LETTERS(w)]
        other = [w for w in words if not _LETTERS(w)]
        for lo in range(0, len(plain), 2_000):
            part = plain[lo : lo + 2_000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(part):
                self._keep(part, ids, np.diff(np.r_[0, ends]))
            else:
                other += part
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        for lo in range(0, len(other), 10_000):
            part = other[lo : lo + 10_000]
            ids = [e.ids for e in encode(part, add_special_tokens=False)]
            self._keep(part, np.fromiter((x for i in ids for x in i), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)))

    def _keep(self, words: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        while len(self.place) + 2 > len(self.size):
            self.size, self.start = (np.concatenate([x, np.zeros_like(x)]) for x in (self.size, self.start))
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        self.size[at], self.start[at] = size, self.used + np.cumsum(size) - size
        self.used += len(ids)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, an end id after each text, and the number of ids of each text."""
        words: list[str] = []
        upto = np.empty(len(texts), np.int64)
        for i, t in enumerate(texts):
            t = t or ""
            if _PLAIN(t) and "<|" not in t:
                t = _MARKS.sub(r" \g<0>", t.lower())
            words += t.replace("\n", " ").split(" ")
            upto[i] = len(words)
        if len(self.place) > WORDS_KEPT:
            self.clear()
        place = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        if self.place.new:
            new, self.place.new = self.place.new, []
            self.add(new)
        place = np.insert(place, upto, 0)
        size, start = self.size[place], self.start[place]
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)
        last = ends[upto + np.arange(len(texts))]
        return self.pool[at], np.diff(np.r_[0, last])


_words: dict[str, WordIds] = {}


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _words:
            _words[path] = WordIds(path, end_id)
        for b in batches:
            doc_ids, texts = b.column(0), b.column(1).to_pylist()
            for lo, hi in slices(texts):
                ids, n = _words[path].encode(texts[lo:hi])
                count = (n + capacity - 1) // capacity
                row = np.repeat(np.arange(hi - lo), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(capacity, n[row] - start)
                at = np.repeat(np.cumsum(n) - n, count) + start
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(lo, hi - lo).take(pa.array(row)).cast(pa.int64()), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of docs(doc_id, text); tokenizer: path of a word-level tokenizers file."""
    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _pieces(tokenizer, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")


def brackets(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pieces and of the slots that took them, as a sweep over sorted pieces and slots matches them."""
    depth = np.cumsum(np.where(kind == PIECE, 1, -1))
    floor = np.minimum.accumulate(np.minimum(depth, 0))
    free = (kind == SLOT) & (depth < np.r_[0, floor[:-1]])  # met an empty stack
    level = depth - floor + (kind == SLOT)
    order = np.argsort(level, kind="stable")
    order = order[~free[order]]
    first, second = order[:-1], order[1:]
    met = (level[first] == level[second]) & (kind[first] == PIECE) & (kind[second] == SLOT)
    return first[met], second[met]


def slots_offered(gap, most: int, pieces: int, gaps: int):
    """How many slots a gap offers (a column or an array): no more rows than a few for each piece and gap."""
    limit = 8 + 2 * pieces // max(gaps, 1)
    whole = F.floor(gap / most) if isinstance(gap, Column) else gap // most
    return F.greatest(F.lit(1), F.least(whole, F.lit(limit))) if isinstance(gap, Column) else np.clip(whole, 1, limit)


def rounds(pid: np.ndarray, length: np.ndarray, seq: np.ndarray, gap: np.ndarray, opened: int, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """pid, sequence, offset: what the rounds of place() do, for pieces and gaps of one range."""
    out = [(pid[:0], seq[:0], gap[:0])]
    order = np.argsort(length, kind="stable")
    pid, length = pid[order], length[order]
    while len(pid):
        most = int(length[-1])
        seq, gap = seq[gap >= length[0]], gap[gap >= length[0]]
        counts = [dict(zip(*(x.tolist() for x in np.unique(v, return_counts=True)), strict=True)) for v in (length, gap)]
        new = sequences_to_open(*counts, opened + len(seq), capacity)
        seq, gap = np.r_[seq, -1 - opened - np.arange(new)], np.r_[gap, np.full(new, capacity)]
        opened += new
        n = slots_offered(gap, most, len(pid), len(gap))
        own = np.repeat(np.arange(len(gap)), n)
        last = np.zeros(len(own), bool)
        last[np.cumsum(n) - 1] = True
        value = np.r_[length, np.where(last, gap[own] - (n[own] - 1) * most, most)]
        kind = np.repeat([PIECE, SLOT], [len(length), len(own)])
        by = np.lexsort((kind, value))
        piece, taker = brackets(kind[by])
        piece, taker = by[piece], by[taker] - len(length)
        by = np.argsort(taker, kind="stable")
        piece, owner = piece[by], own[taker[by]]
        taken = np.bincount(owner, weights=length[piece], minlength=len(gap)).astype(np.int64)
        upto = np.cumsum(length[piece])
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else owner
        before = upto - length[piece] - np.repeat((upto - length[piece])[first], np.diff(np.r_[first, len(owner)]))
        out.append((pid[piece], seq[owner], capacity - gap[owner] + before))
        gap = gap - taken
        stays = np.ones(len(pid), bool)
        stays[piece] = False
        pid, length = pid[stays], length[stays]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _last_range(opened: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kind, id, value of the pieces and gaps that are left, few enough for one range -> pid, sequence_id, offset"""
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        kind, ident, value = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(3))
        p, s = kind == PIECE, kind == SLOT
        out = rounds(ident[p], value[p], ident[s], value[s], opened, capacity)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["pid", "sequence_id", "offset"])

    return run


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of (value, kind, id, slot, gap), sorted: matches, and the slots and pieces that are left.

    kind is PIECE or SLOT on entry and MATCH for a slot that took a piece (pid of `length`). level counts what is left,
    slots and pieces apart, in the order of the range.
    """
    from pyspark import TaskContext

    held = [b for b in batches if b.num_rows]
    if not held:
        return
    value, kind, ident, slot, gap = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(5))
    n = len(value)
    piece, taker = brackets(kind)
    left = np.ones(n, bool)
    left[piece] = left[taker] = False
    slots, pieces = np.flatnonzero(left & (kind == SLOT)), np.flatnonzero(left & (kind == PIECE))
    at = np.concatenate([taker, slots, pieces])
    own = np.repeat([MATCH, SLOT, PIECE], [len(taker), len(slots), len(pieces)])
    pid, length = np.full(len(at), -1), np.zeros(len(at), np.int64)
    pid[: len(taker)], length[: len(taker)] = ident[piece], value[piece]
    place = np.concatenate([np.zeros(len(taker), np.int64), np.arange(len(slots)), np.arange(len(pieces))])
    columns = (value[at], own, ident[at], slot[at], gap[at], pid, length, place, np.full(len(at), TaskContext.get().partitionId()))
    for lo in range(0, len(at), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + (1 << 16)].astype(np.int64)) for c in columns], _SWEPT)


PIECE, SLOT, MATCH = 0, 1, 2
_SWEPT = ["value", "kind", "id", "slot", "gap", "pid", "length", "level", "range"]


def _carried(counts: dict[tuple[int, int], int]) -> list[tuple[int, int, int]]:
    """range, pieces on the stack where it begins, and after its slots left took theirs; counts: left by (range, kind)."""
    out, height = [], 0
    for r in sorted({r for r, _ in counts}):
        after = max(0, height - counts.get((r, SLOT), 0))
        out.append((r, height, after))
        height = after + counts.get((r, PIECE), 0)
    return out


def _across(swept: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The matches between ranges, the pieces that none took, and the stored table behind both, from what _sweep left."""
    left = swept.where(F.col("kind") != MATCH)
    counts = {(r["range"], r["kind"]): r["count"] for r in left.groupBy("range", "kind").count().collect()}  # two rows a range
    carried = swept.sparkSession.createDataFrame(_carried(counts), "range long, height long, after long")
    level = F.when(F.col("kind") == SLOT, F.col("height") - F.col("level")).otherwise(F.col("after") + 1 + F.col("level"))
    stack = left.join(F.broadcast(carried), "range").withColumn("level", level).where("level > 0")
    order = Window.partitionBy("level").orderBy("range", F.col("kind").desc())  # at most one of each kind a range
    near = stack.select("*", *[f(c).over(order).alias(f"{n}_{c}") for n, f in (("before", F.lag), ("after", F.lead)) for c in ("kind", "id", "value")])
    near = written(near, "stack")
    met = near.where((F.col("kind") == SLOT) & (F.col("before_kind") == PIECE))
    alone = near.where((F.col("kind") == PIECE) & ~F.col("after_kind").eqNullSafe(F.lit(SLOT)))
    met = met.select("id", "slot", "gap", F.col("before_id").alias("pid"), F.col("before_value").alias("length"))
    return met, alone.select(F.col("id").alias("pid"), F.col("value").alias("length")), near


def sequences_to_open(lengths: dict[int, int], gaps: dict[int, int], opened: int, capacity: int) -> int:
    """How many sequences a round opens for pieces by length beside gaps by size."""
    largest = max(gaps, default=0)
    rest = max(0, sum(k * n for k, n in lengths.items()) - sum(k * n for k, n in gaps.items()))
    rest = -(-rest // capacity)
    stuck = -(-sum(k * n for k, n in lengths.items() if k > largest) // capacity)
    return max(stuck, rest // 2 if rest > max(50, opened // 100) else rest)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pid, sequence_id, offset for each row of pieces(pid, length); pid tells them apart."""
    spark = pieces.sparkSession
    rows = pieces.select("pid", F.col("length").cast("long").alias("length"))
    alone = F.col("length") * 2 > capacity
    placed = [rows.where(alone).select("pid", F.col("pid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    gaps = rows.where(alone & (F.col("length") < capacity)).select(F.col("pid").alias("id"), (F.lit(capacity) - F.col("length")).cast("long").alias("gap"))
    left, opened, last = rows.where(~alone), 0, []
    while True:
        sizes = left.groupBy(F.lit(PIECE).alias("kind"), F.col("length").alias("k")).count().unionByName(gaps.groupBy(F.lit(SLOT).alias("kind"), F.col("gap").alias("k")).count()).collect()
        lengths = {r["k"]: r["count"] for r in sizes if r["kind"] == PIECE}
        if not lengths:
            break
        least, most = min(lengths), max(lengths)
        open_gaps = {r["k"]: r["count"] for r in sizes if r["kind"] == SLOT and r["k"] >= least}
        new = sequences_to_open(lengths, open_gaps, opened + sum(open_gaps.values()), capacity)
        count = sum(open_gaps.values()) + new
        pieces_left = sum(lengths.values())
        if pieces_left + count <= RANGE_ROWS:
            rest = left.select(F.lit(PIECE).cast("long").alias("kind"), F.col("pid").alias("id"), F.col("length").alias("value"))
            rest = rest.unionByName(gaps.where(F.col("gap") >= least).select(F.lit(SLOT).cast("long").alias("kind"), "id", F.col("gap").alias("value")))
            placed.append(written(arrow_map(rest.repartition(1), _last_range(opened, capacity), "pid long, sequence_id long, offset long"), "last"))
            break
        own = gaps.where(F.col("gap") >= least).unionByName(spark.range(new).select((-F.col("id") - 1 - opened).alias("id"), F.lit(capacity).cast("long").alias("gap")))
        opened += new
        number = slots_offered(F.col("gap"), most, pieces_left, count)
        slots = own.withColumn("n", number).withColumn("slot", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
        value = F.when(F.col("slot") < F.col("n"), F.lit(most)).otherwise(F.col("gap") - (F.col("n") - 1) * most)
        both = slots.select(value.cast("long").alias("value"), F.lit(SLOT).cast("long").alias("kind"), "id", "slot", "gap")
        none = F.lit(0).cast("long")
        both = both.unionByName(left.select(F.col("length").alias("value"), F.lit(PIECE).cast("long").alias("kind"), F.col("pid").alias("id"), none.alias("slot"), none.alias("gap")))
        order = ["value", "kind", "id", "slot"]
        cut = both.repartitionByRange(-(-2 * (pieces_left + count) // RANGE_ROWS), *order)
        swept = written(arrow_map(cut.sortWithinPartitions(*order), _sweep, ", ".join(f"{c} long" for c in _SWEPT)), "swept")
        more, left, stack = _across(swept)
        met = swept.where(F.col("kind") == MATCH).select("id", "slot", "gap", "pid", "length").unionByName(more)
        before = F.sum("length").over(Window.partitionBy("id").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
        met = written(met.select("pid", "id", "length", (F.lit(capacity) - F.col("gap") + before).alias("offset")), "met")
        placed.append(met.select("pid", F.col("id").alias("sequence_id"), "offset"))
        taken = own.withColumn("used", none).unionByName(met.select("id", none.alias("gap"), F.col("length").alias("used")))
        rest = taken.groupBy("id").agg((F.max("gap") - F.sum("used")).alias("gap"))
        gaps = written(rest.where(F.col("gap") >= least), "gaps")
        drop(*last)  # what the round before left is stored anew by now
        last = [swept, stack, gaps]
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece of docs(doc_id, text)."""
    own = written(pieces(docs, tokenizer, capacity, end_id).withColumn("pid", F.monotonically_increasing_id()), "pieces")
    return own.join(place(own, capacity), "pid").drop("pid")
