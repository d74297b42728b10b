"""Benchmark decontamination by a distributed positional inverted index, with DataFrame functions only.

The index holds a posting (term, document, position) for each corpus word that some benchmark item has, and one
posting of the empty term per document, at the position after its last word, which gives its length. Postings are
made where the text is read, without a shuffle, and stored in the shared folder.

A phrase is looked up from its rarest terms: the postings of a window's rarest term, shifted by its offset, are
intersected with those of its second-rarest term, and only diagonals (document, item, position - offset) that
both support are compared with the item's other terms, again by postings. Runs of consecutive offsets on a
diagonal are the exact matches. proximity() finds windows whose terms all stand close together in any order.

Windows and terms of the benchmark are broadcast only after a count shows them to be under BROADCAST_TERMS rows;
else the planner joins by shuffle. Lists of a frequent term are never collected: every posting is its own row and
is dealt by document and position.

Defined results: null or empty texts have no words (documents get zeros, items no windows); an item of fewer words
than a window is one window; repeated rows of a document get equal results; repeated items count by item_id;
items without item_id count for hits but name no item; rows without doc_id are looked up too; empty tables give empty results or zeros; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, written

WINDOW = 13
BROADCAST_TERMS = 1_000_000
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """Lower case of A-Z alone; lower() does that to texts of one byte a character."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words(text: Column) -> Column:
    """The words of a text in order; none for null and for texts without any."""
    bare = F.regexp_replace(lower_ascii(text), f"^{_SEPARATORS}|{_SEPARATORS}$", "")
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, _SEPARATORS, -1))


def keys(docs: DataFrame) -> DataFrame:
    """doc_id and text of docs with a key that is never null: (dk, th) tells rows of one doc_id apart by text."""
    text = F.col("text").cast("string")
    doc = F.col("doc_id").cast("long")
    return docs.select(doc.alias("doc_id"), F.coalesce(doc, F.lit(-1)).alias("dk"), F.xxhash64(doc, text).alias("th"), text.alias("text"))


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_TERMS else df


def item_words(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ih, j, term, n: the words of each distinct text of items, named by a hash; and ih, item_id: who has it."""
    rows = items.select("item_id", words(F.col("text").cast("string")).alias("w")).withColumn("ih", F.xxhash64("w"))
    texts = rows.select("ih", "w").distinct().select("ih", F.size("w").alias("n"), F.posexplode("w").alias("j", "term"))
    return texts, rows.where("item_id is not null").select("ih", "item_id").distinct()


class Index:
    """The positional index of a corpus for the vocabulary of a benchmark."""

    def __init__(self, docs: DataFrame, items: DataFrame, window: int = WINDOW):
        self.window = window
        self.scratch: list[DataFrame] = []  # tables behind phrases(), of no use once its result is stored
        texts, names = item_words(items)
        self.items, self.names = written(texts, "items"), written(names, "names")
        vocabulary = self.items.select("term").distinct()
        self.terms = vocabulary.count()
        none = vocabulary.sparkSession.range(1).select(F.lit("").alias("term"))
        vocabulary = small(vocabulary.unionByName(none), self.terms)
        rows = keys(docs)
        rows = rows.select("doc_id", "dk", "th", F.posexplode(F.array_append(words(F.col("text")), F.lit(""))).alias("pos", "term"))
        self.postings = written(rows.join(vocabulary, "term").select("term", "doc_id", "dk", "th", "pos"), "postings")

    def lengths(self) -> DataFrame:
        """doc_id, dk, th, n_words: a row for each row of the corpus."""
        return self.postings.where("term = ''").select("doc_id", "dk", "th", F.col("pos").cast("long").alias("n_words"))

    def windows(self) -> DataFrame:
        """ih, n, j1, t1, j2, t2: the rarest and the second-rarest place of each window, one row for equal ones."""
        frequency = self.postings.where("term <> ''").groupBy("term").agg(F.count("*").alias("cf"))
        known = self.items.join(small(frequency, self.terms), "term", "left").withColumn("cf", F.coalesce("cf", F.lit(0)))
        size = F.least("n", F.lit(self.window))
        starts = known.withColumn("w", F.explode(F.sequence(F.greatest(F.lit(0), F.col("j") - size + 1), F.least(F.col("j"), F.col("n") - size))))
        ordered = starts.withColumn("r", F.row_number().over(Window.partitionBy("ih", "w").orderBy("cf", "j")))
        both = ordered.where("r <= 2").groupBy("ih", "w").agg(F.first("n").alias("n"), *[F.max(F.when(F.col("r") == r, F.col(c))).alias(f"{a}{r}") for r in (1, 2) for c, a in (("j", "j"), ("term", "t"))], F.min("cf").alias("cf"))
        # a window with a term that no document has can't occur; a window of one word stands for itself
        both = both.where("cf > 0").select("ih", "n", "j1", "t1", F.coalesce("j2", "j1").alias("j2"), F.coalesce("t2", "t1").alias("t2"))
        return both.distinct()

    def phrases(self) -> DataFrame:
        """dk, th, ih, start, end: maximal runs of corpus words that follow an item's text for a window or more."""
        windows = written(self.windows(), "windows")
        n = windows.count()
        first = self.postings.join(small(windows, n).withColumnRenamed("t1", "term"), "term")
        first = first.select("dk", "th", "ih", "t2", (F.col("pos") - F.col("j1")).alias("diag"), (F.col("pos") - F.col("j1") + F.col("j2")).alias("pos"))
        second_terms = small(windows.select(F.col("t2").alias("term")).distinct(), n)
        second = self.postings.join(second_terms, "term", "left_semi").select("dk", "th", "pos", F.col("term").alias("t2")).distinct()
        diagonals = written(first.join(second, ["dk", "th", "pos", "t2"]).select("dk", "th", "ih", "diag").distinct(), "diagonals")
        # only postings of documents with a diagonal are compared further
        candidates = written(diagonals.select("dk", "th").distinct(), "candidates")
        self.scratch += [windows, diagonals, candidates]
        there = self.postings.where("term <> ''").join(small(candidates, candidates.count()), ["dk", "th"], "left_semi").select("dk", "th", "pos", "term").distinct()
        wanted = diagonals.join(small(self.items, self.items.count()), "ih").select("dk", "th", "ih", "diag", "n", "j", "term", (F.col("diag") + F.col("j")).alias("pos"))
        met = wanted.join(there, ["dk", "th", "pos", "term"])
        line = ["dk", "th", "ih", "diag"]
        run = met.withColumn("run", F.col("j") - F.row_number().over(Window.partitionBy(*line).orderBy("j")))
        runs = run.groupBy(*line, "run").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.first("n").alias("n"))
        return runs.where(F.col("end") - F.col("start") >= F.least("n", F.lit(self.window))).select("dk", "th", "ih", "start", "end")

    def named(self, found: DataFrame) -> DataFrame:
        """found(ih, ...) with item_id instead of ih, a row for each item of that text; texts without item_id go."""
        return found.join(small(self.names, self.names.count()), "ih").drop("ih")

    def proximity(self, slop: int = 5) -> DataFrame:
        """dk, th, item_id, w, at: windows all of whose distinct terms stand within window + slop words around position at.

        From the rarest term's postings; each other term is sought in the buckets of positions beside it, so no
        list of a frequent term is paired with another as a whole.
        """
        span = self.window + slop
        frequency = self.postings.where("term <> ''").groupBy("term").agg(F.count("*").alias("cf"))
        size = F.least("n", F.lit(self.window))
        known = self.items.join(small(frequency, self.terms), "term")
        starts = known.withColumn("w", F.explode(F.sequence(F.greatest(F.lit(0), F.col("j") - size + 1), F.least(F.col("j"), F.col("n") - size))))
        terms = starts.groupBy("ih", "w", "term").agg(F.first("cf").alias("cf"), F.first("n").alias("n"), F.count("*").alias("c"))
        part = Window.partitionBy("ih", "w")
        terms = terms.withColumn("r", F.row_number().over(part.orderBy("cf", "term"))).withColumn("k", F.count("*").over(part)).withColumn("total", F.sum("c").over(part))
        terms = written(terms.where("total = least(n, %d)" % self.window), "nearterms")
        n = terms.count()
        bucket = F.floor(F.col("pos") / span)
        near = self.postings.where("term <> ''").select("dk", "th", "term", F.col("pos").alias("p"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("b"))
        anchors = self.postings.join(small(terms.where("r = 1"), n), "term").select("dk", "th", "ih", "w", "k", F.col("pos").alias("at"), bucket.alias("b"))
        wanted = anchors.join(small(terms.select("ih", "w", "term", "r"), n), ["ih", "w"])
        found = wanted.join(near, ["dk", "th", "term", "b"]).where(F.abs(F.col("p") - F.col("at")) < span)
        # the anchor lies in the stretch: for each left end, the nearest posting of each term at or after it
        cand = ["dk", "th", "ih", "w", "k", "at"]
        per_term = found.groupBy(*cand, "term").agg(F.collect_set("p").alias("ps"))  # span places at most
        lists = per_term.groupBy(*cand).agg(F.collect_list("ps").alias("lists"))  # window terms at most
        lefts = F.sequence(F.greatest(F.lit(0), F.col("at") - span + 1), F.col("at"))
        holds = F.exists(lefts, lambda a: F.forall("lists", lambda ps: F.exists(ps, lambda p: (p >= a) & (p < a + span))))
        return self.named(lists.where((F.size("lists") == F.col("k")) & holds).select("dk", "th", "ih", "w", "at").distinct()).select("dk", "th", "item_id", "w", "at")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, dk, th, n_words, n_hit (words inside matches), items (ids as sorted strings) for each row of docs."""
    index = Index(docs, items, window)
    found = written(index.phrases(), "phrases")
    drop(*index.scratch)
    doc = ["dk", "th"]
    # words inside matches: intervals of a document by start, each counted from where those before it ended
    before = F.max("end").over(Window.partitionBy(*doc).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    inside = found.select(*doc, "start", "end").distinct().withColumn("from", F.greatest("start", F.coalesce(before, F.lit(0))))
    hit = inside.groupBy(*doc).agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.col("from"))).alias("n_hit"))
    ids = index.named(found.select(*doc, "ih").distinct()).groupBy(*doc).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))  # as many as items
    out = index.lengths().join(hit.join(ids, doc, "left"), doc, "left")
    return out.select("doc_id", *doc, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contaminated(n_words: Column, n_hit: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns."""
    bad = contamination(docs, items, window).where(contaminated(F.col("n_words"), F.col("n_hit")))
    bad = bad.select("dk", "th").distinct()
    doc, text = docs["doc_id"].cast("long"), docs["text"].cast("string")
    return docs.join(bad, (F.coalesce(doc, F.lit(-1)) == bad["dk"]) & (F.xxhash64(doc, text) == bad["th"]), "left_anti")
