"""Toxic passages by maximum-scoring segments over token log-odds.

Learning: each labelled document counts its words, and their stems of 4 and 5 letters, at most VOTES times each, so
that one long document doesn't speak for a class. A word's odds of standing in a toxic document come from a chain of
Dirichlet priors: the share of toxic documents is the prior of a 4-letter stem, the stem's odds that of the 5-letter
stem, and that one's the word's, each worth PRIOR counts. So a rare word inherits what its stem is known for, and an
unknown one says nothing. The word's score is its log-odds against that share; if positive, less some standard errors of its
stem's log-odds (a level of confidence), if negative, as it is down to FLOOR; and DRIFT less in either case.
Features are named by 64-bit hashes and counted over all training rows by a grouped sum, so what is gathered grows with
the vocabulary and no two words share counts. Tasks are sent the features with evidence: those with LEAST votes of
toxic documents, or RARE of their number if that is more, which bounds them whatever the input; the rest is neutral.

Scoring: one linear scan finds all maximal scoring segments (each is a passage no neighbouring words could improve).
By extreme-value theory the number of segments of score S that n clean words hold by chance is about
K n exp(-lambda S); lambda solves E[exp(lambda s)] = 1 over clean tokens and K makes the expectation right for clean
documents. Segments whose expectation is under SIGNIFICANT are the passages; a document's evidence is the sum of
lambda S - log(K n) over them, which a two-parameter logistic maps to a probability. One fold is scored with log-odds
learned from the other: lambda and K come from all its clean rows, whose word scores and best segments are counted in
bins by the executors; the logistic, and the level of confidence, from about CALIBRATION_ROWS of its rows, half of
them toxic where there are so many, weighted back to the shares of the classes. The log-odds count every distinct text
of the training rows, and every text is scored whole.

Defined results: null or empty texts have no words and get the score of a document without passages; rows
without a label, or with a null or other label, teach nothing; with no toxic or no clean training row all scores
are 0; with one class alone in the calibration fold, slope and intercept are fixed (1 and -3), with a warning; rows
that repeat a text teach once; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import re
import warnings
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import arrow_map, column, drop, slices, written

#: Votes of toxic documents below which a feature is neutral, and the share of toxic documents that stands for as many.
LEAST, RARE = 2, 2**-18
#: Feature counts that a task holds before it adds them up.
HELD = 1 << 21
#: How often a document counts a feature at most, and the counts that the prior of a feature is worth.
VOTES, PRIOR = 3, 4.0
#: Standard errors below the log-odds; the calibration fold chooses one, as what is rare depends on the labels' number.
CONFIDENCES = (1.0, 2.0, 3.0, 4.0)
DRIFT, FLOOR = 1.0, -2.0
SIGNIFICANT = 0.05
CALIBRATION_ROWS = 8_000
#: Bins for the best segments of clean rows: hundredths, beyond which a segment has no weight in K.
BEST_BINS = 20_000
THRESHOLD = 0.7
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_REMEMBER = 400_000


def lower_ascii(text: str) -> str:
    return text.lower() if text.isascii() else text.encode("utf-8", "replace").lower().decode("utf-8")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(lower_ascii(text)) if text else []


@functools.lru_cache(maxsize=200_000)
def features(word: str) -> tuple[int, int, int]:
    """Hashes, as signed numbers, of a word's 4-letter stem, its 5-letter stem and itself."""
    raw = (xxhash.xxh64_intdigest(s.encode("utf-8", "replace"), seed) for s, seed in ((word[:4], 4), (word[:5], 5), (word, 0)))
    return tuple(h - (1 << 64) if h >> 63 else h for h in raw)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in linear time; ends are exclusive.

    Words with a negative score are bridged as one step, so the work follows the number of positive words.
    """
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    total = np.concatenate(([0.0], np.cumsum(scores)))
    left, right = total[at].tolist(), total[at + 1].tolist()
    kept: list[list] = []  # start, end, sum before the start, sum at the end, nearest earlier one with a smaller sum before it
    for i, lo, hi in zip(at.tolist(), left, right, strict=True):
        new = [i, i + 1, lo, hi, -1]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j = kept[j][4]
            new[4] = j
            if j < 0 or kept[j][3] >= new[3]:
                kept.append(new)
                break
            new = [kept[j][0], new[1], kept[j][2], new[3], -1]
            del kept[j:]
    return [(a, b, hi - lo) for a, b, lo, hi, _ in kept]


class Odds:
    """What the training rows say: features with evidence, rising, their votes in toxic and clean rows, the share of toxic rows."""

    def __init__(self, keys: np.ndarray, toxic: np.ndarray, clean: np.ndarray, share: float):
        order = np.argsort(keys)
        self.keys, self.toxic, self.clean, self.share = keys[order], toxic[order].astype(np.int32), clean[order].astype(np.int32), share

    def votes(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Toxic and clean votes of features, 0 for those without evidence."""
        if not len(self.keys):
            return np.zeros(hashes.shape, np.int32), np.zeros(hashes.shape, np.int32)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        known = self.keys[at] == hashes
        return np.where(known, self.toxic[at], 0), np.where(known, self.clean[at], 0)


class Scorer:
    """Word scores at levels of confidence."""

    def __init__(self, odds: Odds, levels: tuple[float, ...]):
        self.odds, self.levels = odds, levels
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.known = np.empty((len(self.levels), 0))

    def scores(self, words: list[str]) -> np.ndarray:
        """A row for each level."""
        if len(self.place) > _REMEMBER:
            self.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.place]
        if new:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            votes = self.odds.votes(np.array([features.__wrapped__(w) for w in new], np.int64))
            own = word_scores(*votes, self.odds.share, self.levels)
            while len(self.place) > self.known.shape[1]:
                self.known = np.concatenate([self.known, np.empty((len(self.levels), max(1024, self.known.shape[1])))], axis=1)
            self.known[:, len(self.place) - len(new) : len(self.place)] = own
        return self.known[:, np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))]


def word_scores(toxic: np.ndarray, clean: np.ndarray, share: float, levels: tuple[float, ...]) -> np.ndarray:
    """Scores by level of words with these counts (a row for each word: 4-letter stem, 5-letter stem, word)."""
    odds = np.full(len(toxic), share)
    for k in range(3):
        odds = (toxic[:, k] + PRIOR * odds) / (toxic[:, k] + clean[:, k] + PRIOR)
    delta = np.log(odds / (1 - odds)) - np.log(share / (1 - share))
    error = np.sqrt(1 / (toxic[:, 0] + 0.5) + 1 / (clean[:, 0] + 0.5))
    return np.stack([np.where(delta > 0, np.maximum(delta - z * error, 0.0), np.maximum(delta, FLOOR)) for z in levels]) - DRIFT


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """toxic, fold, text -> kind (0 and 1 clean by fold, 2 and 3 toxic), feature, its votes; a null feature counts the rows."""
    rows = np.zeros(4, np.int64)
    held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], [], [], []]
    size = 0

    def added_up() -> Iterator[pa.RecordBatch]:
        for k, parts in enumerate(held):
            if parts:
                at, place = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
                votes = np.bincount(place.ravel(), weights=np.concatenate([v for _, v in parts])).astype(np.int64)
                for lo in range(0, len(at), 1 << 17):
                    part = slice(lo, lo + (1 << 17))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at[part]), k, np.int32)), pa.array(at[part]), pa.array(votes[part])], ["kind", "feature", "votes"])
                parts.clear()

    for b in batches:
        kind = (b.column(0).to_numpy(zero_copy_only=False) * 2 + b.column(1).to_numpy(zero_copy_only=False)).astype(int)
        for k, text in zip(kind.tolist(), (x.as_py() for x in b.column(2)), strict=True):
            rows[k] += 1
            found = Counter(words_of(text))
            if found:
                at, place = np.unique(np.array([features(w) for w in found], np.int64), return_inverse=True)
                times = np.repeat(np.fromiter(found.values(), np.int64, len(found)), 3)
                held[k].append((at, np.minimum(np.bincount(place.ravel(), weights=times), VOTES)))
                size += len(at)
                if size > HELD:
                    yield from added_up()
                    size = 0
    yield from added_up()
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(4, dtype=np.int32)), pa.nulls(4, pa.int64()), pa.array(rows)], ["kind", "feature", "votes"])


def _evidence(odds: Odds, level: float, lam: float, k: float):
    """text -> evidence, passages, words and the score of the best segment, for each row; the other columns go on."""
    scorer: list[Scorer] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not scorer:
            scorer.append(Scorer(odds, (level,)))
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            for lo, hi in slices(texts):
                out = [document_evidence(scorer[0].scores(words_of(t))[0], lam, k) for t in texts[lo:hi]]
                cols = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.float64(), _PASSAGES, pa.int64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in b.columns[:-1]), *cols], [*b.schema.names[:-1], "evidence", "passages", "n_words", "best"])

    return run


_PASSAGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
_EVIDENCE = "evidence double, passages array<struct<start: bigint, end: bigint, score: double>>, n_words long, best double"


def document_evidence(scores: np.ndarray, lam: float, k: float) -> tuple[float, list[dict], int, float]:
    found = segments(scores)
    n = len(scores)
    cut = np.log(k * max(n, 1))
    own = [(a, b, s) for a, b, s in found if lam * s - cut > -np.log(SIGNIFICANT)]
    return float(sum(lam * s - cut for _, _, s in own)), [{"start": a, "end": b, "score": s} for a, b, s in own], n, float(max((s for *_, s in found), default=0.0))


def _lambda(share: np.ndarray, score: np.ndarray) -> float:
    """The positive root of sum(share * exp(lambda * score)) = 1."""
    lo, hi = 1e-6, 8.0
    if (share * np.exp(hi * score)).sum() < 1:
        return hi
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (share * np.exp(mid * score)).sum() < 1 else (lo, mid)
    return lo


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by penalised Newton steps over weighted rows."""
    z = np.stack([x, np.ones_like(x)], 1)
    w = np.zeros(2)
    ridge = np.diag([1e-3, 1e-3])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (weight * (p - y)) + ridge @ w)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def held_out(doc_id: Column) -> Column:
    """True for the rows that no label may be learned from."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(3)) == 1


class Model:
    def __init__(self, odds: Odds, level: float, lam: float, k: float, slope: float, intercept: float):
        self.odds, self.level, self.lam, self.k, self.slope, self.intercept = odds, level, lam, k, slope, intercept


def fit(docs: DataFrame, labels: DataFrame, calibration_rows: int = CALIBRATION_ROWS) -> Model:
    """Learns from the rows of docs(doc_id, text) that labels(doc_id, toxic) marks and that aren't held out.

    Rows of one text count once, with the label of the smallest doc_id.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    rows = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("text").cast("string").alias("text"))
    hashed = rows.select("doc_id", F.xxhash64("text", F.col("text").isNull()).alias("th")).join(known, "doc_id")
    first = hashed.groupBy("th").agg(F.min(F.struct("doc_id", "toxic")).alias("f")).select("f.doc_id", "f.toxic")
    fold = (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 2).cast("int").alias("fold")
    train = written(rows.join(first.hint("shuffle_hash"), "doc_id").select("doc_id", "toxic", fold, "text"), "labelled")
    counts = arrow_map(train.select("toxic", "fold", "text"), _count, "kind int, feature long, votes long")
    by_kind = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("votes"))), F.lit(0)).cast("int").alias(c) for k, c in enumerate(("c0", "c1", "t0", "t1"))]
    sums = written(counts.groupBy("feature").agg(*by_kind), "features")
    rows_n = np.array(sums.where("feature is null").select("c0", "c1", "t0", "t1").first() or (0, 0, 0, 0), np.int64)
    least = max(LEAST, math.ceil(RARE * (rows_n[2] + rows_n[3])))
    table = sums.where((F.col("t0") + F.col("t1") >= least) & F.col("feature").isNotNull()).toArrow()
    drop(sums)
    key, *votes = (table.column(c).to_numpy() for c in ("feature", "c0", "c1", "t0", "t1"))
    got = np.stack(votes, 1).astype(np.int64)
    if not (rows_n[0] + rows_n[1] and rows_n[2] + rows_n[3]):
        drop(train)
        return Model(Odds(key[:0], got[:0, 0], got[:0, 0], 0.5), 1.0, 1.0, 1.0, 0.0, -50.0)

    def odds(clean: np.ndarray, toxic: np.ndarray, rows: np.ndarray) -> Odds:
        own = toxic >= LEAST
        return Odds(key[own], toxic[own], clean[own], float(np.clip(rows[1] / max(1, rows.sum()), 1e-6, 1 - 1e-6)))

    half = odds(got[:, 0], got[:, 2], rows_n[[0, 2]])
    whole = odds(got[:, 0] + got[:, 1], got[:, 2] + got[:, 3], np.array([rows_n[0] + rows_n[1], rows_n[2] + rows_n[3]]))
    # rows of each class under a place in the order of a hash, set so that about calibration_rows of them are
    shares = sample_shares(int(rows_n[1]), int(rows_n[3]), calibration_rows)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    sampled = place < F.when(F.col("toxic") == 1, int(1_000_000 * shares[1])).otherwise(int(1_000_000 * shares[0]))
    fold_rows = train.where("fold = 1").select("toxic", sampled.alias("sampled"), "text").where("toxic = 0 or sampled")
    scored = written(arrow_map(fold_rows, _calibration(half), "z int, toxic int, n long, segments array<double>, bin int, weight long"), "calibration")
    found = scored.where("bin is null").select("z", "toxic", "n", "segments").collect()  # rows of the sample
    bins = scored.where("bin is not null").groupBy("z", "bin").agg(F.sum("weight").alias("weight")).collect()  # 256 + BEST_BINS a level at most
    drop(train, scored)
    best = None
    for k, z in enumerate(CONFIDENCES):
        totals = np.zeros(256 + BEST_BINS, np.int64)
        for r in bins:
            if r.z == k:
                totals[r.bin] = r.weight
        fitted = _calibrate([r for r in found if r.z == k], totals, int(rows_n[1]), shares)
        if fitted and (best is None or fitted[0] < best[0]):
            best = (*fitted, z)
    if best is None:  # one class alone in the fold
        warnings.warn("toxicity: the calibration fold has no rows of one class, or they don't differ", stacklevel=2)
        return Model(whole, CONFIDENCES[0], 1.0, 1.0, 1.0, -3.0)
    _, lam, chance, slope, intercept, z = best
    return Model(whole, z, lam, chance, slope, intercept)


def sample_shares(clean: int, toxic: int, rows: int) -> tuple[float, float]:
    """The shares of clean and of toxic rows that are about so many together, half of them toxic where there are so many."""
    some = max(min(toxic, rows // 2), rows - clean)
    return min(1.0, (rows - min(some, toxic)) / max(clean, 1)), min(1.0, some / max(toxic, 1))


def _calibration(odds: Odds):
    """toxic, sampled, text -> for each level of confidence the segments' scores of each sampled text, and a task's

    counts over clean texts by bin: words by score in tenths (bins under 256), and words by the best segment of
    their text in hundredths (bins from 256).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(odds, CONFIDENCES)
        totals = np.zeros((len(CONFIDENCES), 256 + BEST_BINS), np.int64)
        types = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.int32(), pa.int64())
        names = ["z", "toxic", "n", "segments", "bin", "weight"]
        for b in batches:
            out = []
            for toxic, sampled, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), (x.as_py() for x in b.column(2)), strict=True):
                words = words_of(text)
                for k, s in enumerate(scorer.scores(words)):
                    found = [x for *_, x in segments(s)]
                    if toxic == 0:
                        totals[k, :256] += np.bincount(np.minimum(np.rint(np.maximum(s, 0) * 10), 255).astype(int), minlength=256)
                        totals[k, 256 + min(round(100 * max(found, default=0.0)), BEST_BINS - 1)] += max(len(words), 1)
                    if sampled:
                        out.append((k, toxic, len(words), found, None, None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        out = [(k, None, None, None, i, int(totals[k, i])) for k, i in np.argwhere(totals).tolist()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return run


def _calibrate(rows: list, totals: np.ndarray, n_clean: int, shares: tuple[float, float]) -> tuple[float, float, float, float, float] | None:
    """Log loss, lambda, K, slope and intercept at one level of confidence; none if a class is missing.

    totals: counts over all n_clean clean rows by bin; rows: the sample, which holds shares of both classes.
    """
    counts, best = totals[:256], totals[256:]
    y = np.array([r.toxic for r in rows], float)
    if not (y == 1).any() or not (y == 0).any():
        return None
    score = np.where(np.arange(len(counts)) > 0, np.arange(len(counts)) / 10, -DRIFT)
    lam = _lambda(counts / max(counts.sum(), 1), score)
    chance = float((best * np.exp(-lam * np.arange(len(best)) / 100)).sum())
    k = float(np.clip(n_clean / chance, 1e-6, 1.0)) if chance > 0 else 1.0
    x = np.array([_sum_evidence(r.segments, r.n, lam, k) for r in rows])
    weight = np.where(y == 1, 1 / shares[1], 1 / shares[0])
    slope, intercept = _logistic(x, y, weight)
    p = np.clip(1 / (1 + np.exp(-np.clip(slope * x + intercept, -30, 30))), 1e-9, 1 - 1e-9)
    loss = float(-np.average(y * np.log(p) + (1 - y) * np.log(1 - p), weights=weight))
    return (loss, lam, k, slope, intercept) if slope > 0 else None


def _sum_evidence(found: list[float], n: int, lam: float, k: float) -> float:
    cut = np.log(k * max(n, 1))
    return float(sum(lam * s - cut for s in found if lam * s - cut > -np.log(SIGNIFICANT)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, passages (words start to end, with their segment's score) for each row of docs(doc_id, text)."""
    found = arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _evidence(model.odds, model.level, model.lam, model.k), f"doc_id long, {_EVIDENCE}")
    p = 1 / (1 + F.exp(-(F.lit(model.slope) * F.col("evidence") + F.lit(model.intercept))))
    return found.select("doc_id", p.alias("score"), "passages", "n_words")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is under the threshold, with all their columns."""
    model = fit(docs, labels)
    packed = docs.select(F.struct(*[column(docs, c) for c in docs.columns]).alias("row"), docs["text"].cast("string").alias("text"))
    fields = StructType([packed.schema["row"], *StructType.fromDDL(_EVIDENCE).fields])
    found = arrow_map(packed, _evidence(model.odds, model.level, model.lam, model.k), fields)
    p = 1 / (1 + F.exp(-(F.lit(model.slope) * F.col("evidence") + F.lit(model.intercept))))
    return found.where(p < threshold).select("row.*")
