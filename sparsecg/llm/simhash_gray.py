"""SimHash near-duplicates by a Gray-order hierarchical index.

A fingerprint holds the majority bits of the XXH64 hashes of a text's word shingles. Equal fingerprints are one class
from the start. The distinct fingerprints are sorted by Gray rank into ranges, and a tree stands over each range: a
node holds the bit pattern that all below it share and the mask of those bits, factored out of its children, up to the
range's root. Two nodes are compared on the bits that both masks cover. These differences only grow towards the
leaves, so a pair of nodes with more than `distance` of them is dropped with all below it, from pairs of whole ranges
down to pairs of fingerprints; and a pair whose differences can't exceed `distance` even if all other bits differ is
linked as a whole without going further. Only pairs of ranges whose roots pass are dealt to tasks, which descend from
the two roots to the fingerprints.

Work: neighbours in Gray order share leading bits, so at a level of M nodes about M * C(log2 M, distance) / 2 pairs
remain of M * M / 2; the whole grows little faster than the number of fingerprints. A range is sent to the ranges it
may link with, of R ranges about C(log2 R, distance). Ranges have RANGE_ROWS fingerprints or more (see ranges_for),
of distinct values, so neither equal texts nor a group of near copies makes a range large. Tasks return a spanning
forest of their links, never all pairs; components come from joins on the shared folder (common.components).

Defined results: a null or empty text has fingerprint zero and links like any other; repeated rows and ties
share a fingerprint; an empty table gives an empty result; other columns are ignored; a null doc_id stays a row
and can't be a component's id unless its whole class has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, components, written

SHINGLE, DISTANCE, SEED = 3, 3, 42
#: Fingerprints of a range: RANGE_ROWS while there are at most RANGES ranges, then more, up to RANGE_MOST.
RANGE_ROWS, RANGES, RANGE_MOST = 1 << 15, 1024, 1 << 22
#: Children of a node of the tree.
FAN = 4
#: Node pairs expanded at once.
CHUNK = 1 << 17


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of one text as an unsigned integer."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and \x20 \x09-\x0D only
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        h = np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[: n - shingle] + 1))
        parts = [joined[a:b] for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), np.uint64, len(parts))
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.fromiter(map(fingerprint, (x.as_py() for x in b.column(2))), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(fp.view(np.int64))], ["doc_id", "th", "fp"])


def text_key(text: Column) -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64(text.cast("string"), text.isNull())


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, th (text_key), fp (the fingerprint's 64 bits as a signed long) for each row of docs(doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("th"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, _fingerprints, "doc_id long, th long, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of each word in the sequence of binary-reflected Gray codes."""
    r = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the edges a-b."""
    lab = np.arange(n)
    while len(a):
        la, lb = lab[a], lab[b]
        if (la == lb).all():
            break
        m = np.minimum(la, lb)
        np.minimum.at(lab, la, m)
        np.minimum.at(lab, lb, m)
        while (lab[lab] != lab).any():
            lab = lab[lab]
    return lab


class GrayTree:
    """Fingerprints in Gray order under nodes of FAN children; levels[0] are the fingerprints, levels[-1] is the root."""

    def __init__(self, fp: np.ndarray):
        self.order = np.argsort(gray_rank(fp), kind="stable")
        self.levels = [(fp[self.order], np.full(len(fp), ~np.uint64(0)))]
        while len(self.levels[-1][0]) > 1:
            pattern, mask = self.levels[-1]
            at = np.arange(0, len(pattern), FAN)
            same = ~(np.bitwise_and.reduceat(pattern, at) ^ np.bitwise_or.reduceat(pattern, at))
            mask = np.bitwise_and.reduceat(mask, at) & same
            self.levels.append((pattern[at] & mask, mask))

    def below(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First fingerprint under each node, and the one after its last, in Gray order."""
        size = FAN**level
        return node * size, np.minimum((node + 1) * size, len(self.order))


class Found:
    """Links between places 0..n-1, kept as a forest once they are many."""

    def __init__(self, n: int):
        self.n, self.a, self.b, self.held = n, [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(a)
        self.b.append(b)
        self.held += len(a)
        if self.held > 1 << 20:
            a, b = self.forest()
            self.a, self.b, self.held = [a], [b], len(a)

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.held:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        lab = forest(self.n, np.concatenate(self.a), np.concatenate(self.b))
        at = np.flatnonzero(lab != np.arange(self.n))
        return at, lab[at]


def _groups_linked(found: Found, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> None:
    """Every fingerprint of a left group links with every one of its right group: stars on the first of each."""
    for (first, _), (lo, hi) in ((left, right), (right, left)):
        n = hi - lo
        found.add(np.repeat(first, n), np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n))


def tree_links(x: np.ndarray, y: np.ndarray | None = None, distance: int = DISTANCE, seen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (places a, b) of the links between fingerprints x and y, or inside x if there is no y.

    Places of y come after those of x. seen, if given, gets the number of pairs compared on each level, from the top.
    """
    one = GrayTree(x)
    two = one if y is None else GrayTree(y)
    own, shift = y is None, 0 if y is None else len(x)
    found = Found(len(x) + (0 if own else len(y)))
    stack = [(len(one.levels) - 1, len(two.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        la, lb, a, b = stack.pop()
        if len(a) > CHUNK:
            stack.append((la, lb, a[CHUNK:], b[CHUNK:]))
            a, b = a[:CHUNK], b[:CHUNK]
        (pa_, ma), (pb, mb) = one.levels[la], two.levels[lb]
        shared = ma[a] & mb[b]
        differ = np.bitwise_count((pa_[a] ^ pb[b]) & shared).astype(np.int64)
        if seen is not None:
            seen.append(len(a))
        near = differ <= distance
        a, b = a[near], b[near]
        if la == 0 and lb == 0:
            off = a != b if own else slice(None)
            found.add(a[off], b[off] + shift)
            continue
        sure = differ[near] + 64 - np.bitwise_count(shared[near]) <= distance
        if sure.any():
            _groups_linked(found, one.below(la, a[sure]), tuple(p + shift for p in two.below(lb, b[sure])))
            a, b = a[~sure], b[~sure]
        down_a, down_b = la >= lb and la > 0, lb >= la and lb > 0
        fan_a, fan_b = FAN if down_a else 1, FAN if down_b else 1
        x_, y_ = np.broadcast_arrays((a[:, None] * fan_a + np.arange(fan_a))[:, :, None], (b[:, None] * fan_b + np.arange(fan_b))[:, None, :])
        la, lb = la - down_a, lb - down_b
        ok = (x_ < len(one.levels[la][0])) & (y_ < len(two.levels[lb][0]))
        if own:
            ok &= x_ <= y_
        stack.append((la, lb, x_[ok], y_[ok]))
    a, b = found.forest()
    order = one.order if own else np.concatenate([one.order, two.order + shift])
    return order[a], order[b]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fingerprints of one range as one row: own (the range), fps (their bytes), the bits that all and that any have."""
    from pyspark import TaskContext

    fp = np.concatenate([np.empty(0, np.int64), *(b.column(0).to_numpy(zero_copy_only=False) for b in batches)]).view(np.uint64)
    if len(fp):
        every, some = np.bitwise_and.reduce(fp), np.bitwise_or.reduce(fp)
        columns = [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([fp.tobytes()], pa.binary()), *(pa.array([int(x.view(np.int64))], pa.int64()) for x in (every, some))]
        yield pa.RecordBatch.from_arrays(columns, ["own", "fps", "every", "some"])


def _link_batches(distance: int):
    """i, j, own, fps, sorted by i, j and own -> links between the ranges i and j, or inside i if they are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None  # the range i of a pair whose j is still to come
        for b in batches:
            for i, j, own, raw in zip(*(b.column(k).to_pylist() for k in range(3)), (x.as_py() for x in b.column(3)), strict=True):
                fp = np.frombuffer(raw, np.uint64)
                if i != j and own == i:
                    first = fp
                    continue
                x, y = (fp, None) if i == j else (first, fp)
                a, c = tree_links(x, y, distance)
                both = x if y is None else np.concatenate([x, y])
                yield pa.RecordBatch.from_arrays([pa.array(both[a].view(np.int64)), pa.array(both[c].view(np.int64))], ["a", "b"])

    return run


def ranges_for(n: int) -> int:
    """Ranges for n distinct fingerprints: of RANGE_ROWS up to RANGES of them, then larger ones up to RANGE_MOST rows."""
    return max(1, min(-(-n // RANGE_ROWS), max(RANGES, -(-n // RANGE_MOST))))


def gray_order(fp: Column) -> Column:
    """Sorts like the Gray rank of a fingerprint's 64 bits taken as unsigned."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def range_pairs(roots: list[tuple[int, int, int]], distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Pairs of ranges (own, other), both ways round and with themselves, that may hold a link.

    roots: each range, the bits that all its fingerprints have and the bits that any has.
    """
    if not roots:
        return []
    name, every, some = (np.array([x % (1 << 64) for x in c], np.uint64) for c in zip(*roots, strict=True))
    mask = ~(every ^ some)
    out = []
    for k, n in enumerate(name.tolist()):
        near = np.bitwise_count((every ^ every[k]) & mask & mask[k]) <= distance
        out += [(n, int(m)) for m in name[near]]
    return out


def links(fps: DataFrame, distance: int = DISTANCE, ranges: int | None = None) -> DataFrame:
    """a, b: a forest of the links among the distinct fingerprints fps(fp); every link lies within one of its trees."""
    if ranges is None:
        ranges = ranges_for(fps.count())
    # a range is one row from here on; the cut is stored, as sampling could place it elsewhere next time
    cut = fps.select("fp").repartitionByRange(ranges, gray_order(F.col("fp")))
    cut = written(arrow_map(cut, _packed, "own long, fps binary, every long, some long"), "ranges")
    roots = cut.select("own", "every", "some").collect()  # a row for each range
    pairs = cut.sparkSession.createDataFrame(range_pairs([tuple(r) for r in roots], distance), "own long, other long")
    if len(roots) <= RANGES:
        pairs = F.broadcast(pairs)  # at most the square of RANGES rows of 16 bytes
    dealt = cut.join(pairs, "own").select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fps")
    dealt = dealt.repartition("i", "j").sortWithinPartitions("i", "j", "own")
    return arrow_map(dealt, _link_batches(distance), "a long, b long")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, th, fp, root (a fingerprint that names the component), component_id for each row of docs.

    component_id is the smallest doc_id reachable over links, itself included.
    """
    own = written(fingerprints(docs), "fingerprints")
    classes = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    comp = written(components(links(classes.select("fp"), distance)), "components")
    rooted = classes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # stored, so that the join below meets two plain exchanges and a fingerprint of very many rows can be split
    named = written(rooted.select("fp", "root").join(ids, "root").select("fp", "root", "component_id"), "named")
    return own.join(named, "fp", "left").select("doc_id", "th", "fp", "root", "component_id")


def keep_one(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Of each component the row of docs with the smallest doc_id, then text key; of rows that repeat it, one.

    Rows without a doc_id stay, as nothing tells them apart from the row that should be kept.
    """
    found = written(near_duplicates(docs.where("doc_id is not null"), distance).select("doc_id", "th", "root"), "near")
    kept = found.groupBy("root").agg(F.min(F.struct("doc_id", "th")).alias("k")).select(F.col("k.doc_id").alias("kept_id"), F.col("k.th").alias("kept_th"))
    first = docs.join(kept, (docs["doc_id"].cast("long") == kept["kept_id"]) & (text_key(docs["text"]) == kept["kept_th"]), "left_semi")
    if found.groupBy("doc_id", "th").count().where("count > 1").limit(1).count():
        first = first.dropDuplicates(["doc_id", "text"])
    return first.unionByName(docs.where("doc_id is null"))
