"""Chat formatting as a prefix tree.

A conversation is a sequence of turns. Turns become segments: a marked header with the role, the text, an end
mark; control strings inside texts and roles are escaped by backslashes, reversibly. A node of the tree stands for
a prefix of turns and is named by the chained digest of its segments, so conversations that share initial turns
share nodes. Each node's tokens are emitted once, in depth-first order (nodes sorted by the path of digests from
the root), at a place in one global stream. Position ids continue those of the ancestors, and the attention
intervals are the stream ranges of the ancestors and the node itself; within the last range attention is causal.

Places in the stream come from a range-sorted prefix sum: sums inside sorted partitions, shifted by the totals of
the partitions before. A first turn that a third of all conversations share is one node, combined before the
shuffle. Reading back goes through the emitted intervals: a leaf's ranges find the nodes by their place.

Tokens are those of a byte-level tokenizer, which loses nothing: header, text and end are encoded apart, so the
loss mask covers exactly the assistant texts.

Defined results: null texts and roles are empty; turns are ordered by turn, then role, then text, so ties and
repeated turns stay, each as a turn; a row without conv_id is a conversation of its own; an empty table gives empty tables;
other columns are ignored. One conversation is one row while it is formed, as one long text would be.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, written

OPEN, BREAK, CLOSE = "<|turn|>", "\n", "<|end|>\n"
_CONTROL = re.compile(r"<(?=\||/?s>)|\[(?=/?INST\])")
LOSS_ROLE = "assistant"
#: Bytes of a digest in a node's path.
STEP = 12
#: Roles whose header tokens a worker remembers.
HEADS = 10_000
#: Tokens of the stream that share a bucket when ranges are read back.
BUCKET = 4096


def escape(text: str) -> str:
    """No control string stands in the result: a backslash goes before each backslash and after the first sign of each."""
    return _CONTROL.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def role_escape(role: str) -> str:
    return escape(role).replace("\n", "\\n").replace("\r", "\\r") if "\n" in role or "\r" in role else escape(role)


def role_unescape(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "r": "\r"}.get(m[1], m[1]), role, flags=re.S)


_tokenizers: dict = {}


def tokenizer(path: str):
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _tokenizers[path] = t
    return _tokenizers[path]


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv, turns -> conv, node, path, depth, role, text, last for each prefix."""
    for b in batches:
        out: list[tuple] = []
        size = 0
        for conv, turns in zip((x.as_py() for x in b.column(0)), (x.as_py() for x in b.column(1)), strict=True):
            digest, path = b"", b""
            for d, t in enumerate(turns):
                role, text = t["role"] or "", t["text"] or ""
                raw = role.encode("utf-8", "replace")
                digest = hashlib.sha256(digest + len(raw).to_bytes(8, "big") + raw + text.encode("utf-8", "replace")).digest()
                path += digest[:STEP]
                out.append((conv, digest, path, d, role, text, d + 1 == len(turns)))
                size += len(text) + len(path)
            if size > 4 << 20:
                yield _batch(out)
                out, size = [], 0
        if out:
            yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [("conv", pa.int64()), ("node", pa.binary()), ("path", pa.binary()), ("depth", pa.int32()), ("role", pa.string()), ("text", pa.string()), ("last", pa.bool_())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), types, strict=True)], [n for n, _ in types])


def _tokens(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """node, path, depth, role, text -> node, path, depth, tokens, loss_lo, loss_hi"""
        t = tokenizer(path)
        encode = getattr(t, "encode_batch_fast", t.encode_batch)
        close = t.encode(CLOSE, add_special_tokens=False).ids
        heads: dict[str, list[int]] = {}
        for b in batches:
            n = b.num_rows
            for lo in range(0, n, 512):
                part = b.slice(lo, 512)
                roles, texts = part.column(3).to_pylist(), part.column(4).to_pylist()
                if len(heads) > HEADS:
                    heads.clear()
                new = [r for r in dict.fromkeys(roles) if r not in heads]
                heads.update(zip(new, (e.ids for e in encode([OPEN + role_escape(r) + BREAK for r in new], add_special_tokens=False)), strict=True))
                said = [e.ids for e in encode([escape(s) for s in texts], add_special_tokens=False)]
                tokens = [heads[r] + x + close for r, x in zip(roles, said, strict=True)]
                start = [len(heads[r]) for r in roles]
                stop = [k + (len(x) if r == LOSS_ROLE else 0) for k, x, r in zip(start, said, roles, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(tokens, pa.list_(pa.int32())), pa.array(start, pa.int32()), pa.array(stop, pa.int32())], ["node", "path", "depth", "tokens", "loss_lo", "loss_hi"])

    return run


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted nodes of one partition: adds the partition, the tokens before each node in it, and its ancestors.

    Ancestors inside the partition are ranges of its own tokens, merged where one follows the other; those before it
    are the first `outer` ancestors of the partition's first node, as a subtree has no gaps in depth-first order.
    """
    from pyspark import TaskContext

    part, seen, outer = TaskContext.get().partitionId(), 0, None
    stack: list[tuple[int, tuple]] = []  # depth and merged ranges of the open nodes of this partition
    for b in batches:
        depths, sizes = b.column(2).to_pylist(), b.column(3).value_lengths().to_pylist()
        before, outers, ranges = [], [], []
        for depth, n in zip(depths, sizes, strict=True):
            while stack and stack[-1][0] >= depth:
                stack.pop()
            outer = depth if outer is None else min(outer, depth)
            above = stack[-1][1] if stack else ()
            if above and above[-1][1] == seen:
                own = (*above[:-1], (above[-1][0], seen + n))
            else:
                own = (*above, (seen, seen + n))
            stack.append((depth, own))
            before.append(seen)
            outers.append(outer)
            ranges.append([{"start": x, "end": y} for x, y in own])
            seen += n
        k = b.num_rows
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(k, part, np.int32)), pa.array(sizes, pa.int64()), pa.array(before, pa.int64()), pa.array(outers, pa.int32()), pa.array(ranges, _RANGES)], [*b.schema.names, "part", "n", "before", "outer", "ranges"])


_RANGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _merged(ranges: Column) -> Column:
    """Sorted ranges with those that follow each other made one."""
    last = lambda acc: F.element_at(acc, -1)
    grown = lambda acc, x: F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last(acc)["start"].alias("start"), x["end"].alias("end"))))
    step = lambda acc, x: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] == x["start"]), grown(acc, x)).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(ranges, F.array().cast("array<struct<start: bigint, end: bigint>>"), step)


class Tree:
    """nodes and leaves of the prefix tree of conversations(conv_id, turn, role, text).

    nodes: node, depth, stream_start, n_tokens, tokens, position_ids, loss_lo, loss_hi (places in tokens under the loss
    mask), attends (merged ranges of the stream, the ancestors' from the root on and its own). leaves: conv_id, node.
    """

    def __init__(self, conversations: DataFrame, tokenizer_path: str):
        self.tokenizer_path = tokenizer_path
        turns = F.array_sort(F.collect_list(F.struct("turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))))
        rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
        # rows without conv_id don't belong together: each is a conversation of its own
        rows = rows.withColumn("alone", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()))
        convs = rows.groupBy("conv_id", "alone").agg(turns.alias("turns")).drop("alone")
        prefixes = written(arrow_map(convs, _prefixes, "conv long, node binary, path binary, depth int, role string, text string, last boolean"), "prefixes")
        self.leaves = prefixes.where("last").select(F.col("conv").alias("conv_id"), "node")
        distinct = prefixes.dropDuplicates(["node"]).select("node", "path", "depth", "role", "text")
        tokens = arrow_map(distinct, _tokens(tokenizer_path), "node binary, path binary, depth int, tokens array<int>, loss_lo int, loss_hi int")
        tokens = written(tokens, "tokens")  # sampled and sorted from one table
        ordered = tokens.repartitionByRange(F.col("path")).sortWithinPartitions("path")
        fields = "node binary, path binary, depth int, tokens array<int>, loss_lo int, loss_hi int, part int, n long, before long, outer int, ranges array<struct<start: bigint, end: bigint>>"
        placed = written(arrow_map(ordered, _running, fields), "placed")
        totals = placed.groupBy("part").agg(F.sum("n").alias("t"), F.min("path").alias("path"))  # a row for each partition
        shift = totals.select("part", "path", (F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("t")).alias("shift"))
        shift = written(shift, "shift")
        spans = placed.join(shift.drop("path"), "part").select("path", (F.col("before") + F.col("shift")).alias("start"), (F.col("before") + F.col("shift") + F.col("n")).alias("end"))
        # the ancestors of each partition's first node
        levels = F.length("path") / STEP
        above = shift.where(levels > 1).select("part", F.explode(F.transform(F.sequence(F.lit(1), (levels - 1).cast("int")), lambda k: F.substring(F.col("path"), F.lit(1), k * STEP))).alias("path"))
        firsts = above.join(spans, "path").groupBy("part").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("above"))
        known = written(shift.drop("path").join(firsts, "part", "left"), "firsts")
        moved = F.transform("ranges", lambda r: F.struct((r["start"] + F.col("shift")).alias("start"), (r["end"] + F.col("shift")).alias("end")))
        attends = F.when(F.col("outer") == 0, moved).otherwise(_merged(F.concat(F.slice("above", F.lit(1), F.col("outer")), moved)))
        out = placed.join(known, "part").withColumn("attends", attends).withColumn("stream_start", F.col("before") + F.col("shift"))
        out = out.withColumn("first", F.aggregate("attends", F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["start"]) - F.col("n"))
        positions = F.when(F.col("n") == 0, F.array().cast("array<bigint>")).otherwise(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1))
        self.nodes = written(out.select("node", "depth", "stream_start", F.col("n").alias("n_tokens"), "tokens", positions.alias("position_ids"), "loss_lo", "loss_hi", "attends"), "nodes")

    def read_back(self) -> DataFrame:
        """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from tokens and intervals alone."""
        ends = self.leaves.select("node").distinct()
        ranges = self.nodes.join(ends, "node").select("node", F.explode("attends").alias("r")).select("node", "r.start", "r.end")
        # nodes that begin inside a range, met by buckets of the stream
        cut = F.sequence(F.floor(F.col("start") / BUCKET), F.floor((F.col("end") - 1) / BUCKET))
        ranges = ranges.where("end > start").withColumn("b", F.explode(cut))
        there = self.nodes.where("n_tokens > 0").select(F.floor(F.col("stream_start") / BUCKET).alias("b"), F.col("stream_start").alias("k"), "tokens", "loss_lo", "loss_hi")
        parts = ranges.join(there, (ranges["b"] == there["b"]) & (there["k"] >= ranges["start"]) & (there["k"] < ranges["end"])).drop("b")
        whole = parts.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("k", "tokens", "loss_lo", "loss_hi"))).alias("parts"))  # as many as turns
        digests = arrow_map(whole, _parse(self.tokenizer_path), "node binary, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
        return self.leaves.join(digests, "node").drop("node")


_TURN = re.compile(re.escape(OPEN) + r"(.*?)" + re.escape(BREAK) + r"(.*?)" + re.escape(CLOSE), re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError("not a formatted conversation")
        out.append((role_unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


#: Nodes whose texts a worker remembers while it reads leaves back, and the tokens of the longest of them.
READ, READ_TOKENS = 20_000, 2_000


def _parse(path: str):
    """node, parts -> what the tokens of a leaf's nodes say; nodes that many leaves share are decoded once in a while."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        known: dict[int, tuple[str, str]] = {}  # by place in the stream: the text, and what of it the loss mask covers
        for b in batches:
            rows = []
            for node, parts in zip(b.column(0).to_pylist(), (x.as_py() for x in b.column(1)), strict=True):
                if len(known) > READ:
                    known.clear()
                parts = sorted(parts, key=lambda p: p["k"])
                new = [p for p in parts if p["k"] not in known]
                texts = t.decode_batch([p["tokens"] for p in new], skip_special_tokens=False)
                masked = t.decode_batch([p["tokens"][p["loss_lo"] : p["loss_hi"]] for p in new], skip_special_tokens=False)
                own = {p["k"]: x for p, *x in zip(new, texts, masked, strict=True)}
                known.update((p["k"], own[p["k"]]) for p in new if len(p["tokens"]) <= READ_TOKENS)
                said = [own.get(p["k"]) or known[p["k"]] for p in parts]
                formatted = "".join(x for x, _ in said)
                loss = "".join(unescape(x) for _, x in said)
                turns = parse(formatted)
                told = "".join(f"{r}\n{x}\n" for r, x in turns)
                rows.append((node, len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t_) for c, t_ in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["node", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return run
