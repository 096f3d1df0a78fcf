"""Quality rules whose thresholds follow the distribution of each language and source.

Every text gets exact counts, and from them four integer rates. The rates of a
(language, source) group are summarised by quantile sketches: counts over bins of
equal width, which merge by addition, so a group is summed before any shuffle. To each group's
sketch those of its language and of all rows are added, each with the weight of ``PRIOR_DOCS`` texts, which steadies small
groups and fades in large ones. Most texts have a rate of zero, so the limit is read off the rest: its
median and ``WIDTH`` times the distance between its quartiles, at least a bin.

DataFrame functions only. The repeated windows of a text are found by sorting its
window hashes inside the row: no word leaves its row.

Defined cases: a null or blank text has no words and fails the base rules; a null
language or source is a group of its own; repeated rows count each time; other columns
are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legwise.llm.text import BLANK
from legwise.session import settle

#: rate -> (numerator, denominator, bins for one whole, rules: +1 too high, -1 too low)
RATES = {
    "symbol_rate": ("n_symbols", "word_chars", 1000, (1,)),
    "line_rate": ("n_dup_lines", "n_lines", 1000, (1,)),
    "repeat_rate": ("n_repeat_words", "n_words", 1000, (1,)),
    "word_length": ("word_chars", "n_words", 10, (1, -1)),
}
WIDTH = 6
TOP_BIN = 2000
PRIOR_DOCS = 50
#: One text in the fixed-point weights of the merged sketch.
UNIT = 1_000_000
MIN_WORDS = 50
MOST_REPEATED = 50


def _repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more, from ``windows`` sorted by hash."""
    spots = F.filter("windows", lambda w, i: (
        w["h"].eqNullSafe(F.get(F.col("windows"), i - 1)["h"])
        | w["h"].eqNullSafe(F.get(F.col("windows"), i + 1)["h"])))
    places = F.sort_array(F.transform(spots, lambda w: w["i"]))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("last"))
    return F.aggregate(places, start, lambda a, i: F.struct(
        (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source) and the counts of every text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{BLANK}]"))
    cut = base.select(
        "doc_id", "lang", "source", F.regexp_extract_all("text", F.lit(f"[^{BLANK}]+"), F.lit(0)).alias("words"),
        lines.alias("lines"),
        (F.char_length("text") - F.regexp_count("text", F.lit(f"[{BLANK}]"))).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"))
    spots = F.when(F.size("words") >= 3, F.sequence(F.lit(0), F.size("words") - 3))
    window = F.transform(spots, lambda i: F.struct(
        F.xxhash64(*[F.get(F.col("words"), i + j) for j in range(3)]).alias("h"), i.alias("i")))
    counted = cut.select(
        "doc_id", "lang", "source", F.size("words").cast("bigint").alias("n_words"), "word_chars", "n_symbols",
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.sort_array(window).alias("windows"))
    return counted.select(
        *[c for c in counted.columns if c != "windows"],
        F.coalesce(_repeat_words(F.col("windows")), F.lit(0)).cast("bigint").alias("n_repeat_words"))


def _bins(measured: DataFrame) -> DataFrame:
    """``measured`` with the bin of each rate."""
    return measured.withColumns({
        rate: F.least(F.expr(f"{top} * {scale} div greatest({below}, 1)"), F.lit(TOP_BIN))
        for rate, (top, below, scale, _) in RATES.items()})


def sketches(binned: DataFrame) -> DataFrame:
    """(lang, source, rate, bin, n): the mergeable sketch of each group."""
    pairs = F.array(*[F.struct(F.lit(r).alias("rate"), F.col(r).alias("bin")) for r in RATES])
    return binned.select("lang", "source", F.inline(pairs)).groupBy("lang", "source", "rate", "bin").agg(
        F.count("*").alias("n"))


def _shares(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Weights of the bins of each group of a sketch, ``PRIOR_DOCS`` texts in all."""
    merged = sketch.groupBy(*keys, "rate", "bin").agg(F.sum("n").alias("n"))
    docs = F.sum("n").over(Window.partitionBy(*keys, "rate"))  # at most TOP_BIN + 1 rows
    return merged.select(*keys, "rate", "bin", F.floor(F.col("n") / docs * (PRIOR_DOCS * UNIT)).cast("bigint").alias("w"))


def merged_sketches(sketch: DataFrame) -> DataFrame:
    """(lang, source, rate, bin, w): each group's sketch with those of its language and of all rows."""
    columns = ["lang", "source", "rate", "bin", "w"]
    own = sketch.select("lang", "source", "rate", "bin", (F.col("n") * UNIT).alias("w"))
    groups = sketch.select("lang", "source").distinct()
    tongue, whole = _shares(sketch, ["lang"]).withColumnRenamed("lang", "of"), _shares(sketch, [])
    lent = groups.join(tongue, F.col("lang").eqNullSafe(F.col("of"))).select(*columns)
    # every group takes all bins of the whole, at most (TOP_BIN + 1) x rates
    bins = whole.agg(F.collect_list(F.struct("rate", "bin", "w")).alias("b"))
    common = groups.withColumn("b", bins.scalar()).select("lang", "source", F.inline("b")).select(*columns)
    return own.unionByName(lent).unionByName(common).groupBy("lang", "source", "rate", "bin").agg(F.sum("w").alias("w"))


def limits(sketch: DataFrame) -> DataFrame:
    """(lang, source) and the highest and lowest allowed bin of each rate."""
    keys = ["lang", "source", "rate"]
    group = Window.partitionBy(*keys)  # at most TOP_BIN rows
    upto = merged_sketches(sketch).where(F.col("bin") > 0).withColumn("all", F.sum("w").over(group)).withColumn(
        "upto", F.sum("w").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
    quartiles = upto.groupBy(*keys).agg(*[
        F.min(F.when(F.col("upto") * 4 >= F.col("all") * q, F.col("bin"))).alias(f"q{q}") for q in (1, 2, 3)])
    reach = F.lit(WIDTH) * F.greatest(F.col("q3") - F.col("q1"), F.lit(1))
    found = quartiles.groupBy("lang", "source").agg(*[
        F.max(F.when(F.col("rate") == r, F.col("q2") + sign * reach)).alias(f"{r}_{'high' if sign > 0 else 'low'}")
        for r, (*_, signs) in RATES.items() for sign in signs])
    # a rate that is zero in all rows
    none = {f"{r}_high": F.coalesce(F.col(f"{r}_high"), F.lit(WIDTH)) for r in RATES}
    groups = sketch.select(F.col("lang").alias("l"), F.col("source").alias("s")).distinct()
    return groups.join(found, F.col("l").eqNullSafe(F.col("lang")) & F.col("s").eqNullSafe(F.col("source")), "left").withColumns(
        none | {"word_length_low": F.coalesce("word_length_low", F.lit(-WIDTH))}).drop("lang", "source").withColumnsRenamed(
        {"l": "lang", "s": "source"})


def judge(docs: DataFrame) -> DataFrame:
    """The counts of every text with base_failed and kept."""
    measured = settle(measure(docs))
    binned = _bins(measured)
    bounds = settle(limits(sketches(binned))).withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    joined = binned.join(bounds, F.col("lang").eqNullSafe(F.col("of_lang"))
                         & F.col("source").eqNullSafe(F.col("of_source")), "left")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    inside = [F.col(r) <= F.col(f"{r}_high") if sign > 0 else F.col(r) >= F.col(f"{r}_low")
              for r, (*_, signs) in RATES.items() for sign in signs]
    fine = inside[0]
    for rule in inside[1:]:
        fine = fine & rule
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & fine).alias("kept"))
