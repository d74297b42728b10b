"""Secret scan with multipart credential linking, with DataFrame functions only.

Base kinds (assign, access, hex) are reported wherever their pattern stands. Weak kinds are parts of a credential
that mean little alone: an identifier (id), a random-looking value (value), an endpoint (endpoint). An interval
join finds weak parts whose scope, the part and REACH code points on both sides, meets complementary parts:
an id needs a secret; a value needs an identifier; an endpoint needs both. Secrets are assign, hex and value;
identifiers are access and id. Parts complement each other only if no code point belongs to both; the secret and the
identifier of an endpoint are apart from each other too. The join is on document and buckets of positions. For ids and
values it is a left semi join; for endpoints it keeps, of the parts in scope, the least end and the last start of
either role, which decide whether two of them are apart. So it returns parts and never pairs, and a text with very
many parts is dealt out by bucket.

Matches are placed by cutting the text at them: the lengths of the pieces between matches and of the matches add
up to the positions. A text is matched against a kind's pattern only if it holds what every match has.

Defined results: null text is empty; texts without matches have no spans; repeated rows of a document get equal
results; rows without doc_id are scanned too; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .positional_index import keys

REACH = 200
#: Fixed by the contract: kind, pattern, group whose length counts, its least length.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: No word character of ASCII stands before.
_FRONT = r"(?<![A-Za-z0-9_])"
WEAK = (
    ("id", "(?i)" + _FRONT + r"""(client_?id|access_?key_?id|key_?id|account_?id|user(?:_?name)?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", 2, 3),
    ("value", r"[A-Za-z0-9+/]{32,}={0,2}", 0, 32),
    ("endpoint", _FRONT + r"""(?:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp|jdbc:[a-z]+)://[^\x20\x09-\x0D"'<>]+""", 0, 8),
)
KINDS = [k for k, *_ in BASE + WEAK]
#: What a match of a kind must also hold, wherever in it.
_HOLDS = {"value": ("[A-Z]", "[a-z]", "[0-9]")}
#: A cheap test that any text with a match passes.
_MAYBE = {"assign": r"(?i)pass|secret|token|api_?key", "access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}", "id": r"""(?i)(?:id|user|name|login)["']?\x20*[:=]""", "value": "[A-Za-z0-9+/]{32}", "endpoint": "://"}


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(docs: DataFrame, patterns: tuple = BASE + WEAK) -> DataFrame:
    """dk, th, kind (place in KINDS), start, end: code points of all matches that are long enough."""
    rows = keys(docs)
    found = []
    for kind, pattern, group, least in patterns:
        p = _literal(pattern)
        counted = f"regexp_extract(m, {p}, {group})" if group else "m"
        holds = " and ".join(f"m rlike {_literal(h)}" for h in _HOLDS.get(kind, ())) or "true"
        own = f"transform(regexp_extract_all(text, {p}, 0), m -> struct(char_length(m) as m, char_length({counted}) >= {least} and {holds} as good))"
        gaps = f"transform(split(text, {p}, -1), g -> char_length(g))"  # the piece after the last match has no partner
        fields = f"struct({KINDS.index(kind)} as kind, x['0'].m as m, x['0'].good as good, x['1'] as gap)"
        found.append(f"case when text rlike {_literal(_MAYBE[kind])} then filter(transform(arrays_zip({own}, {gaps}), x -> {fields}), x -> x.m is not null) end")
    each = rows.select("dk", "th", F.explode(F.array(*[F.expr(e) for e in found])).alias("ms")).where("ms is not null")
    placed = each.select("dk", "th", F.posexplode("ms").alias("i", "x")).select("dk", "th", "x.kind", "i", "x.m", "x.good", "x.gap").distinct()
    end = F.sum(F.col("gap") + F.col("m")).over(Window.partitionBy("dk", "th", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("end", end).where("good").select("dk", "th", "kind", (F.col("end") - F.col("m")).alias("start"), "end")


SECRETS, IDENTIFIERS = ("assign", "hex", "value"), ("access", "id")


def _of(parts: DataFrame, *kinds: str) -> DataFrame:
    return parts.where(F.col("kind").isin([KINDS.index(k) for k in kinds]))


def _meeting(weak: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """The rows of weak joined with those of other that their scope meets and that are apart from them."""
    other = other.select(*[F.col(c).alias(f"{c}2") for c in ("dk", "th", "kind", "start", "end")], F.explode(F.sequence(F.floor(F.col("start") / REACH), F.floor((F.col("end") - 1) / REACH))).alias("b2"))
    wide = weak.withColumn("b", F.explode(F.sequence(F.floor(F.greatest(F.lit(0), F.col("start") - REACH) / REACH), F.floor((F.col("end") + REACH) / REACH))))
    near = (F.col("start2") <= F.col("end") + REACH) & (F.col("end2") >= F.col("start") - REACH)
    apart = (F.col("end2") <= F.col("start")) | (F.col("start2") >= F.col("end"))
    on = (F.col("dk") == F.col("dk2")) & (F.col("th") == F.col("th2")) & (F.col("b") == F.col("b2")) & near & apart
    return wide.join(other, on, how)


def linked(parts: DataFrame) -> DataFrame:
    """The weak parts of parts (as matches() gives them) that have their complements within their scope."""
    own = ["dk", "th", "kind", "start", "end"]
    ids = _meeting(_of(parts, "id"), _of(parts, *SECRETS), "left_semi").select(*own).distinct()
    values = _meeting(_of(parts, "value"), _of(parts, *IDENTIFIERS), "left_semi").select(*own).distinct()
    met = _meeting(_of(parts, "endpoint"), _of(parts, *SECRETS, *IDENTIFIERS), "inner")
    secret = F.col("kind2").isin([KINDS.index(k) for k in SECRETS])
    role = lambda f, c, r, name: f(F.when(r, F.col(c))).alias(name)
    ends = met.groupBy(*own).agg(role(F.min, "end2", secret, "s_end"), role(F.max, "start2", secret, "s_start"), role(F.min, "end2", ~secret, "i_end"), role(F.max, "start2", ~secret, "i_start"))
    endpoints = ends.where("s_end <= i_start or i_end <= s_start").select(*own)
    return ids.unionByName(values).unionByName(endpoints)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and, by start and then kind, base and spans: arrays of (start, kind, end), a row for each row of docs."""
    parts = written(matches(docs), "parts")
    weak = linked(parts)
    spans = parts.where(F.col("kind") < len(BASE)).unionByName(weak)
    per_doc = spans.groupBy("dk", "th").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))  # a document's own
    none = F.array().cast("array<struct<start: bigint, kind: int, end: bigint>>")
    out = keys(docs).drop("text").join(per_doc, ["dk", "th"], "left").withColumn("spans", F.coalesce("spans", none))
    return out.select("doc_id", F.filter("spans", lambda s: s["kind"] < len(BASE)).alias("base"), "spans")


def as_text(spans: str):
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
