"""Sources mixed to target weights by temperature, with DataFrame functions only.

A source with token share p gets the weight p^a / sum(p^a). The exponent a is the
largest in [0, 1] whose weights reach ``target`` of the highest possible entropy,
raised where a source would otherwise be repeated more than ``most_repeats``
times. Both conditions are monotone in a and are met by bisection.

The budget defaults to the smallest one that shows every document: the least
repeated source is shown exactly once. Each source's share of the budget is then
realised in epochs. Its documents are dealt to blocks by a hash; an epoch is a
permutation of the blocks with a permutation inside each block. The last epoch
ends where the share is used up, which is one block and one place in it. So the
decision for a document needs its own hashes and a handful of values of its
source: no text is shuffled and no order is laid over a whole source.

Defined cases: a null source is a source of its own; a null or blank text has no
tokens and is repeated with the full epochs; repeated rows have the same place and
are taken together; with no tokens at all every document is shown once; an
empty table gives no rows; all columns are kept as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legwise.llm.text import BLANK
from legwise.session import settle

TARGET = 0.9
MOST_REPEATS = 2.0
BLOCK_DOCS = 4096
STEPS_A_PASS = 4
PASSES = 5
SEED = "mix"


def _digest(*parts: Column | str) -> Column:
    """32 hexadecimal digits that order things like a random permutation."""
    return F.md5(F.concat_ws(":", F.lit(SEED), *[
        F.coalesce(p.cast("string") if isinstance(p, Column) else F.lit(p), F.lit("")) for p in parts]).cast("binary"))


def _measured(docs: DataFrame) -> DataFrame:
    """Names and token counts of the documents, without their texts."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(
        docs["doc_id"].alias("doc"), docs["source"].cast("string").alias("origin"),
        F.regexp_count(text, F.lit(f"[^{BLANK}]+")).cast("bigint").alias("tokens"))


def source_shares(measured: DataFrame) -> DataFrame:
    """(origin, docs, tokens, share) of each source."""
    per = measured.groupBy("origin").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
    whole = per.agg(F.sum("tokens")).scalar()
    return per.withColumn("share", F.col("tokens") / F.nullif(whole, F.lit(0)))


def entropy(exponent: float) -> Column:
    """Entropy of the tempered weights, as an aggregate of the column ``share``."""
    power = F.pow(F.col("share"), F.lit(exponent))
    return F.log(F.sum(power)) - exponent * F.sum(power * F.log("share")) / F.sum(power)


def fit_exponent(shares: DataFrame, target: float = TARGET, most_repeats: float = MOST_REPEATS) -> float:
    """The exponent, on a grid of 2^-20, by bisection; a few numbers come back for each pass."""
    live = shares.where("share > 0")
    sources, least, most = live.agg(F.count("*"), F.min("share"), F.max("share")).first()
    if not sources or least == most:
        return 1.0
    goal, size = target * math.log(sources), 1 << STEPS_A_PASS
    low, unit = 0, 1 << (STEPS_A_PASS * PASSES)
    whole = unit
    for _ in range(PASSES):  # the sources are read once for the next STEPS_A_PASS halvings
        unit //= size
        found = live.agg(*[entropy((low + i * unit) / whole) for i in range(1, size + 1)]).first()
        low += max((i for i in range(1, size + 1) if found[i - 1] >= goal), default=0) * unit
        if low >= whole:
            break
    below, above = 0, whole
    while below < above:
        middle = (below + above) // 2
        if (most / least) ** (1 - middle / whole) <= most_repeats:
            above = middle
        else:
            below = middle + 1
    return max(low, above) / whole


def plan(measured: DataFrame, target: float = TARGET, most_repeats: float = MOST_REPEATS,
         budget: int | None = None) -> DataFrame:
    """One row per source: weight, whole epochs, blocks, and where its last epoch ends.

    Rows: origin, docs, tokens, share, weight, epochs, blocks, last_block (digest), last_doc
    (digest): in the last epoch all blocks before last_block are shown, and of that block the
    documents up to last_doc.
    """
    shares = settle(source_shares(measured))
    exponent = fit_exponent(shares, target, most_repeats)
    power = F.when(F.col("share") > 0, F.pow("share", F.lit(exponent)))
    raised = shares.withColumn("power", power)
    power_sum = raised.agg(F.sum("power")).scalar()
    widest = raised.agg(F.max(F.col("tokens") / F.col("power"))).scalar()
    quota = F.col("power") * (widest if budget is None else F.lit(float(budget)) / power_sum)
    # a share of one epoch less a rounding error is one epoch
    rounded = F.floor(quota + F.lit(1e-6) * F.col("tokens"))
    sized = raised.select(
        "origin", "docs", "tokens", "share", (F.col("power") / power_sum).alias("weight"),
        F.coalesce(rounded, F.lit(0)).cast("bigint").alias("quota"),
        F.ceil(F.col("docs") / F.lit(BLOCK_DOCS)).cast("bigint").alias("blocks"))
    epochs = F.when(F.col("tokens") > 0, F.expr("quota div tokens")).otherwise(F.lit(1))
    return settle(sized.withColumn("epochs", epochs).withColumn(
        "rest", F.greatest(F.col("quota") - F.col("epochs") * F.col("tokens"), F.lit(0))))


def _placed(measured: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with their source's plan, their block, and their digests in the last epoch."""
    # the plan has one short row per source; Spark broadcasts it if its written size allows, else splits a hot source
    joined = measured.join(sources.withColumnRenamed("origin", "of"), F.col("origin").eqNullSafe(F.col("of")))
    number = F.conv(F.substring(_digest(F.col("doc"), "block"), 1, 8), 16, 10).cast("bigint")
    return joined.withColumn("block", number % F.col("blocks")).withColumn(
        "block_order", block_order(F.col("origin"), F.col("epochs"), F.col("block"))).withColumn(
        "doc_order", doc_order(F.col("doc"), F.col("epochs")))


def block_order(origin: Column, epoch: Column, block: Column) -> Column:
    return _digest(F.coalesce(origin, F.lit("?")), epoch, block)


def doc_order(doc: Column, epoch: Column) -> Column:
    return _digest(doc, epoch)


def last_epoch_ends(measured: DataFrame, sources: DataFrame) -> DataFrame:
    """(of, end_block, end_doc) of every source whose share ends inside an epoch."""
    short = ["of", "rest", "block", "block_order"]
    placed = _placed(measured, sources.where("rest > 0").select("origin", "epochs", "blocks", "rest"))
    blocks = placed.groupBy(*short).agg(F.sum("tokens").alias("held"))
    so_far = Window.partitionBy("of").orderBy("block_order", "block").rowsBetween(Window.unboundedPreceding, 0)
    cut = blocks.withColumn("upto", F.sum("held").over(so_far)).where("upto > rest").groupBy("of").agg(
        F.min(F.struct("block_order", "block", "upto", "held", "rest")).alias("c")).select(
        F.col("of").alias("cut_of"), F.col("c.block").alias("cut_block"), F.col("c.block_order").alias("end_block"),
        (F.col("c.rest") - (F.col("c.upto") - F.col("c.held"))).alias("left"))
    same = F.col("of").eqNullSafe(F.col("cut_of")) & (F.col("block") == F.col("cut_block"))
    inside = Window.partitionBy("of").orderBy("doc_order").rangeBetween(Window.unboundedPreceding, 0)
    docs = placed.join(cut, same).withColumn("upto", F.sum("tokens").over(inside))
    return docs.groupBy("of", "end_block").agg(
        F.max(F.when(F.col("upto") <= F.col("left"), F.col("doc_order"))).alias("end_doc"))


def mix(docs: DataFrame, target: float = TARGET, most_repeats: float = MOST_REPEATS,
        budget: int | None = None, order: bool = False) -> DataFrame:
    """The rows of ``docs``, each as often as its source's weight asks.

    ``order`` adds the columns n_tokens, epoch, block_order and doc_order: a source is read
    by them in that order.
    """
    measured = settle(_measured(docs))
    sources = plan(measured, target, most_repeats, budget)
    ends = last_epoch_ends(measured, sources)
    rule = settle(sources.join(ends, F.col("origin").eqNullSafe(F.col("of")), "left").select(
        F.col("origin").alias("of"), "epochs", "blocks", "rest", "end_block", "end_doc"))
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("doc"),
        docs["source"].cast("string").alias("origin"),
        *([F.regexp_count(text, F.lit(f"[^{BLANK}]+")).cast("bigint").alias("tokens")] if order else []))
    placed = _placed(rows, rule.withColumnRenamed("of", "origin"))
    before = F.col("block_order") < F.col("end_block")
    at_end = (F.col("block_order") == F.col("end_block")) & (F.col("doc_order") <= F.col("end_doc"))
    shown = F.coalesce((F.col("rest") > 0) & (before | at_end), F.lit(False))
    copies = F.col("epochs") + shown.cast("bigint")
    each = placed.where(copies > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), (copies - 1).cast("int"))))
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    if order:
        kept += [F.col("tokens").alias("n_tokens"), F.col("epoch"),
                 block_order(F.col("origin"), F.col("epoch"), F.col("block")).alias("block_order"),
                 doc_order(F.col("doc"), F.col("epoch")).alias("doc_order")]
    return each.select(*kept)
