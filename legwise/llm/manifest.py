"""A content-addressed manifest of a dataset: Merkle trees per source under one root.

Every row is a leaf. The leaves of a source ascend by id; runs of ``FANOUT`` nodes become
their digest until one is left, the subroot; the subroots, ordered by source, become the root in the
same way. What is stored is a DAG of records, digest -> children, one per inner node and
addressed by content alone: equal subtrees are one record.

A proof is read off by descent. The request for a leaf carries its place as digits to base
``FANOUT``: of its source among the sources, then of its rank within the source. From the root each digit
selects a child of the current record; the unselected children, left and right of it, are one
segment of the path. Requests with the same leading digits share the way: each level is
one join of the digests reached so far with the records, and only the last one fans out to leaves.
Reversed, the segments lead from the leaf to the root and fold a leaf's digest into the root's.

Ranks come from a range partitioning by (source, id), counted per partition, so a source with
a third of all rows is spread like any other. No step holds more than ``FANOUT`` nodes of a group.

Defined cases: null fields are ``-``, empty ones ``0:``; a null id comes before all others, as a null source
does; rows of one id are ordered by digest, and equal rows are leaves of their own with one digest; a lone
leaf is its source's subroot, a lone subroot the root; the proof of a leaf without siblings is empty;
an empty table has no root and gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legwise.session import settle

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def leaf_digest(values: list[Column]) -> Column:
    """Digest of fields, each written as its byte count and value."""
    texts = [v.cast("string") for v in values]
    return digest(F.concat(*[
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def lower_ascii(text: Column) -> Column:
    """Only A-Z in lower case."""
    return F.translate(text, UPPER, UPPER.lower())


def numbered(rows: DataFrame, tree: list[str], order: list[Column]) -> DataFrame:
    """``rank`` of every row within its tree and ``size`` of the tree, without one task per tree.

    The rows are range-partitioned by tree and order and written once. A row's
    rank is its number within (partition, tree) plus the rows of the tree in earlier partitions.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    # rows that are equal in all of the order may be parted anywhere
    salt = F.xxhash64(F.monotonically_increasing_id())
    keys = [*[F.col(c).asc_nulls_first() for c in tree], *order]
    dealt = rows.withColumn("salt_", salt).repartitionByRange(parts, *keys, F.col("salt_"))
    dealt = settle(dealt.withColumn("slot_", F.spark_partition_id()))
    held = dealt.groupBy("slot_", *tree).agg(F.count("*").alias("held_"))
    earlier = Window.partitionBy(*tree).orderBy("slot_")
    offsets = held.select(
        F.col("slot_"), *[F.col(c).alias(f"{c}_") for c in tree],
        (F.sum("held_").over(earlier) - F.col("held_")).alias("before_"),
        F.sum("held_").over(Window.partitionBy(*tree)).alias("size"))
    inside = Window.partitionBy("slot_", *tree).orderBy(*order, F.col("salt_"))
    placed = dealt.withColumn("place_", F.row_number().over(inside).cast("bigint"))
    same = [placed["slot_"] == offsets["slot_"], *[placed[c].eqNullSafe(offsets[f"{c}_"]) for c in tree]]
    return placed.join(offsets, reduce(lambda a, b: a & b, same)).select(
        *rows.columns, (F.col("before_") + F.col("place_") - 1).alias("rank"), "size")


def build(nodes: DataFrame, tree: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """The tops (tree, digest, height) and, per level, the records (digest, children) of all trees.

    ``nodes`` has the tree columns, rank, size and digest.
    """
    level = nodes.select(*tree, "rank", "size", "digest")
    tops, records, height = [], [], 0
    while True:
        tops.append(level.where("size = 1").select(*tree, "digest", F.lit(height).alias("height")))
        runs = level.where("size > 1").groupBy(*tree, F.floor(F.col("rank") / FANOUT).alias("rank"), "size").agg(
            F.array_sort(F.collect_list(F.struct("rank", "digest"))).alias("run"))
        children = F.transform("run", lambda n: n["digest"])
        runs = settle(runs.select(*tree, "rank", F.ceil(F.col("size") / FANOUT).alias("size"),
                                  digest(F.array_join(children, "")).alias("digest"), children.alias("children")))
        if runs.isEmpty():
            break
        records.append(runs.groupBy("digest").agg(F.first("children").alias("children")))
        level = runs.drop("children")
        height += 1
    return reduce(DataFrame.unionByName, tops), records


def _selected(children: Column, digit: Column) -> Column:
    """The children left and right of the selected one, as one segment of a path."""
    return F.struct(
        F.array_join(F.slice(children, 1, digit), "").alias("left"),
        F.array_join(F.slice(children, digit + 2, FANOUT), "").alias("right"))


def descend(start: DataFrame, records: list[DataFrame], carry: list[str], last: int) -> DataFrame:
    """Follow the records from ``start`` down to ``last`` levels above the leaves.

    ``start`` has the columns ``carry``, digest, height, prefix (the digits so far) and segments (from the
    root down).
    """
    ahead = start
    for height in range(len(records), last, -1):
        # at this level: what starts here and what has come down to it; lower trees wait
        here = ahead.where(F.col("height") == height).join(records[height - 1], "digest")
        below = here.select(
            *carry, "prefix", "segments", F.col("children"), F.posexplode("children").alias("digit", "child")).select(
            *carry, F.col("child").alias("digest"), F.lit(height - 1).alias("height"),
            (F.col("prefix") * FANOUT + F.col("digit")).alias("prefix"),
            F.concat("segments", F.array(_selected(F.col("children"), F.col("digit")))).alias("segments"))
        ahead = settle(below.unionByName(ahead.where(F.col("height") < height)))
    return ahead


def fold(leaf: Column, segments: Column) -> Column:
    """The root that a leaf's digest and the segments from the leaf upwards give."""
    return F.aggregate(segments, leaf, lambda node, s: digest(F.concat(s["left"], node, s["right"])))


def prove(leaves: DataFrame, requests: list[str]) -> DataFrame:
    """Every leaf with its proof.

    ``leaves`` has source, doc_id, leaf and the ``requests`` columns, which are handed on.
    Returns these with subroot, root and segments (left and right siblings, from the leaf up to the root).
    """
    ranked = settle(numbered(leaves, ["source"], [F.col("doc_id").asc_nulls_first(), F.col("leaf")]))
    tops, records = build(ranked.withColumnRenamed("leaf", "digest"), ["source"])
    tops = settle(tops)
    subroots = settle(numbered(tops, [], [F.col("source").asc_nulls_first()]))
    crown, crown_records = build(subroots.select("rank", "size", "digest"), [])
    # the first digits choose the source
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    root = crown.select("digest", "height", F.lit(0).cast("bigint").alias("prefix"), nothing.alias("segments"),
                        F.col("digest").alias("root"))
    at_source = descend(root, crown_records, ["root"], 0)
    entered = subroots.select(F.col("rank").alias("prefix"), "source", F.col("height").alias("tall"), F.col("digest").alias("subroot")).join(
        at_source, "prefix").select(
        "source", "root", "subroot", F.col("subroot").alias("digest"), F.col("tall").alias("height"),
        F.lit(0).cast("bigint").alias("prefix"), "segments")
    # the next ones a run of leaves
    at_run = descend(settle(entered), records, ["source", "root", "subroot"], 1)
    if records:
        run = at_run.join(records[0], "digest", "left")
    else:
        run = at_run.withColumn("children", F.lit(None).cast("array<string>"))
    run = run.select(F.col("source").alias("source_"), F.col("prefix").alias("run_"), "root", "subroot", "height", "children", "segments")
    asked = ranked.groupBy("source", F.floor(F.col("rank") / FANOUT).alias("run")).agg(
        F.collect_list(F.struct(F.pmod("rank", F.lit(FANOUT)).cast("int").alias("digit"), "doc_id", "leaf", *requests)).alias("asked"))
    met = asked.join(run, F.col("source").eqNullSafe(F.col("source_")) & (F.col("run") == F.col("run_")))
    one = met.select("source", "root", "subroot", "height", "children", "segments", F.explode("asked").alias("a"))
    whole = F.when(F.col("height") > 0, F.concat("segments", F.array(_selected(F.col("children"), F.col("a.digit"))))).otherwise(
        F.col("segments"))
    return one.select("source", F.col("a.doc_id").alias("doc_id"), F.col("a.leaf").alias("leaf"),
                      *[F.col(f"a.{c}").alias(c) for c in requests], "subroot", "root", F.reverse(whole).alias("segments"))


def audit(docs: DataFrame, changed: Column) -> DataFrame:
    """Every row's leaf, proof and whether its text, lower-cased where ``changed`` holds, still proves the root.

    (doc_id, source, leaf, subroot, root, siblings, proof_sha256, folded_root, verified)
    """
    fields = [F.col(c) for c in FIELDS]
    altered = leaf_digest([*fields[:-1], lower_ascii(F.col("text"))])
    # texts are read once; from here on rows are narrow
    leaves = settle(docs.select(
        "source", "doc_id", leaf_digest(fields).alias("leaf"), F.when(changed, altered).alias("altered")))
    proved = prove(leaves, ["altered"])
    siblings = F.array_join(F.transform("segments", lambda s: F.concat(s["left"], s["right"])), "")
    shown = proved.withColumn("siblings", siblings).withColumn(
        "folded_root", fold(F.coalesce("altered", "leaf"), F.col("segments")))
    return shown.select("doc_id", "source", "leaf", "subroot", "root", "siblings",
                        digest(F.col("siblings")).alias("proof_sha256"), "folded_root",
                        (F.col("folded_root") == F.col("root")).alias("verified"))
