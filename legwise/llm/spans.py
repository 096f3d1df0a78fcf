"""Repeated passages removed by hashing every run of consecutive sentences.

A text is cut into sentences without losing a character: a sentence ends after
its end marks or line ends and the blanks behind them. A run from a sentence is this one and the next
if both have ``RUN_WORDS`` words, else the shortest run of consecutive sentences with ``LONG_WORDS`` words; a
single sentence of ``LONE_WORDS`` words is a run too. Runs found more than once in the whole table are
repeated passages. The first occurrence, by doc_id and then by place, stays; every sentence
covered by another occurrence goes.

Texts are cut and hashed once, into a written table of runs with two 64-bit hashes, the halves of one of 128 bits. A sample
of its rows names the frequent runs, which travel by broadcast. The table is dealt once, by its hashes, and ranked within each
group; a frequent run is dealt in ``SPOTS`` parts, so a passage in a third of all rows is no hot group, and the first rows of
its parts are ranked once more. The frequent runs are fewer than about twice ``HOT_RUNS``, as each holds more than about
half that share of all occurrences. The sample only decides which way a run goes, both ways find the same.

Defined cases: a null text stays null and an empty one empty; a text shorter than
a run is never changed; words are what blanks divide, so in scripts without blanks a run is
``LONG_WORDS`` sentences; rows that agree in doc_id and text are one document; rows
without doc_id come last, in the order of their texts' hashes; all columns are
kept as they are, apart from the text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from legwise.llm.text import BLANK, slices, table_batch, utf8
from legwise.session import settle

RUN_WORDS = 10
LONG_WORDS = 30
LONE_WORDS = 25
HOT_ROWS = 2_000
HOT_RUNS = 5_000
SPOTS = 200  # parts of a frequent run
SAMPLED = 200  # expected rows of a run in the sample from which it counts as frequent
TEXTS = 500
NAMES = ["doc", "version", "place", "size", "h", "h2"]
ENDS = ".!?\\n\u2026\u3002\uff01\uff1f\u0964\u061f\u06d4"
SENTENCE = rf"[^{ENDS}]*[{ENDS}]+[{BLANK}]*|[^{ENDS}]+"


def _key(docs: DataFrame, text: str) -> DataFrame:
    """The rows as one column, with the names of their document."""
    return docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        F.coalesce(docs["doc_id"].cast("bigint"), F.lit((1 << 63) - 1)).alias("doc"),
        F.coalesce(F.xxhash64(docs[text]), F.lit(0)).alias("version"))


def _spots(n: list[int]) -> list[tuple[int, int]]:
    """(place, size) of the runs in a text whose sentences have ``n`` words."""
    found = []
    for i, words in enumerate(n):
        if words >= LONE_WORDS:
            found.append((i, 1))
        if i + 1 < len(n) and words + n[i + 1] >= RUN_WORDS:
            found.append((i, 2))
            continue
        # every sentence but a blank first one has a word, which bounds how far a run can reach
        total = 0
        for j in range(i, min(len(n), i + LONG_WORDS + 1)):
            total += n[j]
            if total >= LONG_WORDS:
                found.append((i, j + 1 - i))
                break
    return found


def runs(keyed: DataFrame, text: str) -> DataFrame:
    """(doc, version, place, size, h, h2) of every run: its first sentence, number of sentences and two hashes."""
    out = "doc bigint, version bigint, place int, size int, h bigint, h2 bigint"

    def run(batches):
        # made here, so that tasks need nothing of the driver's session
        cut, even = re.compile(SENTENCE), bytes.maketrans(b"\t\n\x0b\f\r", b"     ")
        schema = pa.schema([(c, pa.int32() if c in ("place", "size") else pa.int64()) for c in NAMES])
        for batch in slices(batches, TEXTS):
            rows, places, sizes, hashes = [], [], [], []
            for row, words in enumerate(utf8(batch.column(2))):
                if not words:
                    continue
                s = [x.encode().translate(even).strip(b" ") for x in cut.findall(words.decode(errors="replace"))]
                spots = _spots([len(x.split()) for x in s])
                rows.append((row, len(spots)))
                places += [i for i, _ in spots]
                sizes += [size for _, size in spots]
                # no sentence holds a line end any more, so it divides them
                hashes += [xxhash.xxh3_128_digest(b"\n".join(s[i:i + size])) for i, size in spots]
            row = pa.array(np.repeat(*np.array(rows, np.int64).reshape(-1, 2).T))
            halves = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            yield table_batch(schema, doc=batch.column(0).take(row), version=batch.column(1).take(row), place=places, size=sizes,
                              h=halves[:, 0], h2=halves[:, 1])

    return keyed.select("doc", "version", F.col(f"row.`{text}`").cast("string").alias("text")).mapInArrow(run, out)


def _ranked(found: DataFrame, named: DataFrame) -> DataFrame:
    """Every run with its rank within its group; a group of ``named`` is cut into ``SPOTS`` parts, ranked each by itself."""
    often = F.broadcast(named.select("h", "h2", F.lit(True).alias("often")))
    spot = F.when(F.col("often"), F.pmod(F.xxhash64("doc", "version", "place"), F.lit(SPOTS)))
    return found.join(often, ["h", "h2"], "left").withColumn("spot", spot).drop("often").withColumn(
        "rank", F.rank().over(Window.partitionBy("h", "h2", "spot").orderBy("doc", "version", "place")))


def covered(keyed: DataFrame, text: str = "text") -> DataFrame:
    """(doc, version, gone): places of the sentences that non-first repeated runs cover."""
    found = settle(runs(keyed, text))
    full = max(HOT_ROWS, found.count() // HOT_RUNS)
    share = min(1.0, SAMPLED / full)
    named = found.sample(share, seed=42).groupBy("h", "h2").agg(F.count("*").alias("times")).where(
        F.col("times") > full * share)
    kept = settle(_ranked(found, settle(named)).where((F.col("rank") > 1) | F.col("spot").isNotNull()))
    # the first rows of the parts: of each frequent run all but one go too
    heads = kept.where("rank = 1").withColumn(
        "rank", F.rank().over(Window.partitionBy("h", "h2").orderBy("doc", "version", "place")))
    later = kept.unionByName(heads).where("rank > 1")
    places = F.sequence(F.col("place"), F.col("place") + F.col("size") - 1)
    return later.select("doc", "version", F.explode(places).alias("place")).groupBy("doc", "version").agg(
        F.collect_set("place").alias("gone"))


def _cutter():
    """Of a text and the places that go: the text without them (null if none go) and its number of sentences."""
    def cut(text: pa.Array, gone: pa.Array) -> pa.Array:
        split, rest, n = re.compile(SENTENCE), [], []
        for words, places in zip(utf8(text), gone):
            found = split.findall(words.decode(errors="replace")) if words else []
            out = set(places.as_py() or ())
            rest.append("".join(s for i, s in enumerate(found) if i not in out) if out else None)
            n.append(len(found))
        return pa.StructArray.from_arrays([pa.array(rest, pa.string()), pa.array(n, pa.int64())], ["rest", "n"])

    return F.arrow_udf(cut, "struct<rest string, n bigint>")


def drop_repeated(docs: DataFrame, text: str = "text", counts: bool = False) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``.

    ``counts`` adds n_sentences and n_removed at the end.
    """
    keyed = _key(docs, text)
    joined = keyed.join(covered(keyed, text), ["doc", "version"], "left")
    words, changed = F.col(f"row.`{text}`").cast("string"), F.col("gone").isNotNull()
    cut = joined.withColumn("cut", _cutter()(words if counts else F.when(changed, words), "gone"))
    shown = [
        (F.when(changed, F.col("cut")["rest"]).otherwise(words) if c == text
         else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    if counts:
        shown += [F.coalesce(F.col("cut")["n"], F.lit(0)).cast("bigint").alias("n_sentences"),
                  F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed")]
    return cut.select(*shown)
