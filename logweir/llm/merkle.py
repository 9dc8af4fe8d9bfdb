"""Merkle manifest of a table: digests of rows, of groups and of the whole, with each row's path to the root.

A group's rows are leaves, in the order of their identifiers. A level deals nodes to windows by group and parent's
number; a window's ordered list of all its nodes gives both the parent's preimage and each node's siblings, and its first
node alone goes on as the parent. The groups' roots then climb the same levels as nodes of one group. Paths come down
again: a node's path is its siblings, then its parent's path.

No window has more than ARITY nodes. A leaf's number in its group comes from places in a range-sorted order, so a group
that holds most rows is numbered by many tasks. Texts are read once, where they stand, and only digests are exchanged.

Null fields enter as `-`. Null groups are a group of their own, the first; null identifiers come first in theirs, by
digest; rows that agree in all fields stand next to each other. An empty table gives no rows. Columns beside FIELDS are
not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order_index import OrderIndex
from .common import cut

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field_text(value: Column) -> Column:
    """What a field adds to a leaf's preimage: `-` for null, else its size in UTF-8 bytes, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field_text, fields)), 256)


def one_level(nodes: DataFrame) -> DataFrame:
    """Adds to nodes (_group, _n: how many nodes the group has here, _at, node) their parent's number (_parent) and digest
    (_up) and their siblings (step: those before and those after). A group's only node is its root: its step is null."""
    run = Window.partitionBy("_group", "_parent").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = (F.col("_at") % ARITY).cast("int")
    siblings = F.struct(F.array_join(F.slice("_run", F.lit(1), own), "").alias("before"), F.array_join(F.slice("_run", own + 2, F.lit(ARITY)), "").alias("after"))
    whole = nodes.withColumn("_parent", F.floor(F.col("_at") / ARITY)).withColumn("_run", F.collect_list("node").over(run))
    return whole.withColumn("step", F.when(F.col("_n") > 1, siblings)).withColumn("_up", F.sha2(F.array_join("_run", ""), 256)).drop("_run")


def climb(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """All levels, each written, and where groups end: their root (_group, _height, root). most: nodes of the largest group."""
    levels = [cut(one_level(nodes), "merkle")]
    while most > 1:
        firsts = levels[-1].where((F.col("_n") > 1) & (F.col("_at") % ARITY == 0))
        up = firsts.select("_group", F.ceil(F.col("_n") / ARITY).alias("_n"), F.col("_parent").alias("_at"), F.col("_up").alias("node"))
        levels.append(cut(one_level(up), "merkle"))
        most = -(-most // ARITY)
    ends = [x.where("_n = 1").select("_group", F.lit(h).alias("_height"), F.col("node").alias("root")) for h, x in enumerate(levels)]
    return levels, reduce(DataFrame.unionByName, ends)


def descend(levels: list[DataFrame], ends: DataFrame) -> DataFrame:
    """The lowest level's rows with what their group's end has (ends: _group, _height, path and more), path led by their own steps."""
    given = [c for c in ends.columns if c not in ("_group", "_height", "path")]
    paths = None
    for height, level in reversed(list(enumerate(levels))):
        above = ends.where(F.col("_height") == height).select("_group", F.lit(0).cast("bigint").alias("_parent"), F.col("path").alias("_rest"), *given)
        if paths is not None:
            above = above.unionByName(paths.select("_group", F.col("_at").alias("_parent"), F.col("path").alias("_rest"), *given))
        paths = level.join(above, ["_group", "_parent"]).withColumn("path", F.when(F.col("step").isNull(), F.col("_rest")).otherwise(F.concat(F.array("step"), "_rest")))
    return paths


def fold_path(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""
    return F.aggregate(path, leaf, lambda held, step: F.sha2(F.concat(step["before"], held, step["after"]), 256))


def build_manifest(docs: DataFrame, id: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS, **more: Column) -> DataFrame:
    """A row for each document: id, leaf, subroot (its group's root), root, and path, an array of siblings (before, after).

    more: further columns that are computed from the document, such as the digest of another version of it."""
    key = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))  # null first, then by bytes
    rows = docs.select(key.alias("_group"), F.col(id).alias("_id"), leaf_of([F.col(c) for c in fields]).alias("node"), *[v.alias(k) for k, v in more.items()])
    index = OrderIndex.build(cut(rows, "leaves"), [F.col("_group").asc(), F.col("_id").asc_nulls_first(), F.col("node").asc()], "_group")
    placed = index.places()
    groups = cut(placed.groupBy("_group").agg(F.min("place").alias("_first"), F.count(F.lit(1)).alias("_n")), "groups")
    numbered = placed.join(groups, "_group").withColumn("_at", F.col("place") - F.col("_first")).drop("place", "_first")
    sizes = groups.agg(F.max("_n").alias("most"), F.count(F.lit(1)).alias("groups")).first()
    levels, ends = climb(numbered, sizes.most or 1)
    tops = OrderIndex.build(cut(ends.select("_group", "_height", "root"), "subroots"), [F.col("_group").asc()], "_group").places()
    tops = tops.select(F.lit("").alias("_group"), F.lit(sizes.groups).cast("bigint").alias("_n"), F.col("place").alias("_at"), F.col("root").alias("node"), F.col("_group").alias("_of"), F.col("_height").alias("_of_height"))
    upper, end = climb(tops, max(sizes.groups, 1))
    above = descend(upper, end.withColumn("path", F.array().cast("array<struct<before:string,after:string>>")))
    ends = cut(above.select(F.col("_of").alias("_group"), F.col("_of_height").alias("_height"), "path", F.col("node").alias("subroot"), "root"), "tops")
    return descend(levels, ends).select(F.col("_id").alias(id), F.col("node").alias("leaf"), "subroot", "root", "path", *more)


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of documents, and whether each still leads to the root once a half of them has lost its line feeds."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    made = build_manifest(docs, seen=leaf_of([tampered if c == "text" else F.col(c) for c in FIELDS]))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), ""), 256)
    folded = made.withColumn("folded_root", fold_path(F.col("seen"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
