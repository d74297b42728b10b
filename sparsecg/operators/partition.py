"""What a split of a graph's nodes into parts means: cut, classes of nodes, ghosts, interfaces, halo and segments.

Edges are entries (u, v) of one triangle with u <> v; parts(i, p) labels the nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scan import row_rank


def edges(a: DataFrame) -> DataFrame:
    return a.where("i <> j").select(F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v")).distinct()


def symmetrise(nz: DataFrame) -> DataFrame:
    """u, v: the edges of a square matrix and its transpose together, each once."""
    return nz.where("i <> j").select(F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v")).distinct()


def bipartite(nz: DataFrame, nrows: int) -> DataFrame:
    """u, v: rows and columns of a rectangular matrix as nodes, columns after the rows."""
    return nz.select(F.col("i").cast("long").alias("u"), (F.col("j") + nrows).alias("v")).distinct()


def labelled(e: DataFrame, parts: DataFrame) -> DataFrame:
    """u, v, pu, pv"""
    return e.join(parts.select(F.col("i").alias("u"), F.col("p").alias("pu")), "u").join(parts.select(F.col("i").alias("v"), F.col("p").alias("pv")), "v")


def edge_cut(e: DataFrame, parts: DataFrame) -> DataFrame:
    return labelled(e, parts).where("pu <> pv").agg(F.count("*").alias("edgecut"))


def halo_send(e: DataFrame, parts: DataFrame) -> DataFrame:
    """p, q, i: node i of part p has a neighbour in part q, which therefore needs its value."""
    cut = labelled(e, parts).where("pu <> pv")
    return cut.select(F.col("pu").alias("p"), F.col("pv").alias("q"), F.col("u").alias("i")).unionByName(cut.select(F.col("pv").alias("p"), F.col("pu").alias("q"), F.col("v").alias("i"))).distinct()


def classes(e: DataFrame, parts: DataFrame) -> DataFrame:
    """i, p, class: a node is border if a neighbour belongs to another part, else inner."""
    border = halo_send(e, parts).select("i").distinct().withColumn("b", F.lit(True))
    return parts.join(border, "i", "left").select("i", "p", F.when(F.col("b"), "border").otherwise("inner").alias("class"))


def ghosts(e: DataFrame, parts: DataFrame) -> DataFrame:
    """p, owner, i: nodes of other parts that part p sees."""
    return halo_send(e, parts).select(F.col("q").alias("p"), F.col("p").alias("owner"), "i")


def counts(e: DataFrame, parts: DataFrame) -> DataFrame:
    """p and its numbers of owned, inner, border and ghost nodes and of inner and interface edges."""
    nodes = classes(e, parts).groupBy("p").agg(F.count("*").alias("owned"), F.count_if(F.col("class") == "inner").alias("inner"), F.count_if(F.col("class") == "border").alias("border"))
    seen = ghosts(e, parts).groupBy("p").agg(F.count("*").alias("ghost"))
    lab = labelled(e, parts)
    inner = lab.where("pu = pv").groupBy(F.col("pu").alias("p")).agg(F.count("*").alias("inner_edges"))
    face = lab.where("pu <> pv").select(F.explode(F.array("pu", "pv")).alias("p")).groupBy("p").agg(F.count("*").alias("interface_edges"))
    out = nodes.join(seen, "p", "left").join(inner, "p", "left").join(face, "p", "left")
    return out.select("p", "owned", "inner", "border", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("ghost", "inner_edges", "interface_edges")])


def interfaces(e: DataFrame, parts: DataFrame) -> DataFrame:
    """p, q with p < q: cut edges between the two and the nodes on each side."""
    cut = labelled(e, parts).where("pu <> pv")
    low = cut.select(F.least("pu", "pv").alias("p"), F.greatest("pu", "pv").alias("q"), F.when(F.col("pu") < F.col("pv"), F.col("u")).otherwise(F.col("v")).alias("np"), F.when(F.col("pu") < F.col("pv"), F.col("v")).otherwise(F.col("u")).alias("nq"))
    return low.groupBy("p", "q").agg(F.count("*").alias("edges"), F.countDistinct("np").alias("nodes_p"), F.countDistinct("nq").alias("nodes_q"))


def local_ids(e: DataFrame, parts: DataFrame) -> DataFrame:
    """p, i, class, id: numbers inside each part, first inner, then border, then ghost nodes, each in the order of i.

    The rank is global and shifted by each part's first, so a part isn't one task.
    """
    own = classes(e, parts).select("p", "i", "class", F.when(F.col("class") == "inner", 0).otherwise(1).alias("c"))
    seen = ghosts(e, parts).select("p", "i", F.lit("ghost").alias("class"), F.lit(2).alias("c"))
    ranked = row_rank(own.unionByName(seen), ["p", "c", "i"], "rank")
    first = ranked.groupBy("p").agg(F.min("rank").alias("first"))
    return ranked.join(first, "p").select("p", "i", "class", (F.col("rank") - F.col("first")).alias("id"))


def displacements(send: DataFrame) -> DataFrame:
    """p, q, count, start: what p sends to each q and where it begins in p's buffer."""
    n = send.groupBy("p", "q").agg(F.count("*").alias("count"))
    before = F.sum("count").over(Window.partitionBy("p").orderBy("q").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")  # as many rows as parts
    return n.select("p", "q", "count", before.alias("start"))


def comm_matrix(send: DataFrame) -> DataFrame:
    return send.groupBy("p", "q").agg(F.count("*").alias("n"))


def exchange(send: DataFrame, x: DataFrame) -> DataFrame:
    """p, owner, i, v: the values that each part receives for its ghosts."""
    return send.join(x, "i").select(F.col("q").alias("p"), F.col("p").alias("owner"), "i", "v")


def column_segments(nz: DataFrame, rowparts: DataFrame) -> DataFrame:
    """j, p: the parts that have an entry in a column."""
    return nz.join(rowparts, "i").select("j", "p").distinct()


def entry_groups(nz: DataFrame, rowparts: DataFrame, colparts: DataFrame) -> DataFrame:
    """k, p, grp: 0 if the column has entries of one part only, 1 if it is shared and the part owns it, 2 if another does."""
    segments = column_segments(nz, rowparts).groupBy("j").agg(F.count("*").alias("segs"))
    own = colparts.select(F.col("i").alias("j"), F.col("p").alias("cp"))
    grp = F.when(F.col("segs") == 1, 0).when(F.col("p") == F.col("cp"), 1).otherwise(2)
    return nz.join(rowparts, "i").join(segments, "j").join(own, "j").select("k", "p", grp.alias("grp"))


def part_extents(nz: DataFrame, rowparts: DataFrame) -> DataFrame:
    """p and its numbers of entries, non-empty rows and non-empty columns."""
    return nz.join(rowparts, "i").groupBy("p").agg(F.count("*").alias("entries"), F.countDistinct("i").alias("nrows"), F.countDistinct("j").alias("ncols"))


def first_appearance(nz: DataFrame, rowparts: DataFrame) -> DataFrame:
    """p, j, id: each part's columns numbered in the order in which they first appear."""
    first = nz.join(rowparts, "i").groupBy("p", "j").agg(F.min("k").alias("k"))
    ranked = row_rank(first, ["p", "k"], "rank")
    start = ranked.groupBy("p").agg(F.min("rank").alias("first"))
    return ranked.join(start, "p").select("p", "j", (F.col("rank") - F.col("first")).alias("id"))


def shared_owners(nz: DataFrame, rowparts: DataFrame, colparts: DataFrame) -> DataFrame:
    """j, owner, q: columns with entries of more than one part, their owner and the other parts that use them."""
    segments = column_segments(nz, rowparts)
    shared = segments.groupBy("j").agg(F.count("*").alias("c")).where("c > 1").select("j")
    own = colparts.select(F.col("i").alias("j"), F.col("p").alias("owner"))
    return segments.join(shared, "j").join(own, "j").where("p <> owner").select("j", "owner", F.col("p").alias("q"))


def _ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with each row's place in its part p by the order, from 0; the rank is global, so a part isn't one task."""
    ranked = row_rank(df, ["p", *order], "__rank")
    first = ranked.groupBy("p").agg(F.min("__rank").alias("__first"))
    return ranked.join(first, "p").withColumn(name, F.col("__rank") - F.col("__first")).drop("__rank", "__first")


def local_vector(e: DataFrame, parts: DataFrame, x: DataFrame) -> DataFrame:
    """p, id, i, class, v: the vector of each part over its own nodes and its ghosts, by local number."""
    return local_ids(e, parts).join(x.select("i", "v"), "i").select("p", "id", "i", "class", "v")


def dump_halo(send: DataFrame) -> DataFrame:
    """p, way, q, k, i: what p sends to q and receives from q, k being the place in p's buffer of that way."""
    out = _ranked(send.select("p", "q", "i"), ["q", "i"], "k").select("p", F.lit("send").alias("way"), "q", "k", "i")
    back = send.select(F.col("q").alias("p"), F.col("p").alias("q"), "i")
    return out.unionByName(_ranked(back, ["q", "i"], "k").select("p", F.lit("receive").alias("way"), "q", "k", "i"))


def dump_graph(e: DataFrame, parts: DataFrame) -> DataFrame:
    """p, what, k, value: each part's nodes by local number, its neighbours in order, and its counts (k = 0), a row each."""
    nodes = local_ids(e, parts).select("p", F.lit("node").alias("what"), F.col("id").cast("long").alias("k"), F.col("i").cast("long").alias("value"))
    near = _ranked(halo_send(e, parts).select("p", "q").distinct(), ["q"], "k").select("p", F.lit("neighbour").alias("what"), "k", F.col("q").cast("long").alias("value"))
    names = ["owned", "inner", "border", "ghost", "inner_edges", "interface_edges"]
    own = counts(e, parts).select("p", F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).cast("long").alias("value")) for c in names])).alias("x"))
    return nodes.unionByName(near).unionByName(own.select("p", "x.what", F.lit(0).cast("long").alias("k"), "x.value"))
