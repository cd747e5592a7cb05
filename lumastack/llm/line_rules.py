"""Quality rules on text statistics and on how often lines recur across the documents of a host.

Only DataFrame functions run here. Word statistics and repeated windows are computed inside a row with array functions,
so no word ever passes a shuffle; what is dealt out are one hash and one word count for each line.

Line rule: a line is normalised (A-Z and other capitals lowered, runs of white space to one space, trimmed, digit runs
to one 0) and hashed. Its frequency is the number of distinct texts of its host that hold it, so that exact copies of one
document count once. A line is removed when more than ``min_docs`` texts hold it, and these are more than ``line_share``
percent of the host's distinct texts (it belongs to the host's pages) or more than ``max_docs`` (no author writes the same
line so often, however large the host is). A document is depleted, and rejected, when more than ``max_removed`` percent of
its words stand in removed lines, or fewer than ``min_words`` words, which the base rule asks for, are left.

Cases: a null or empty text has zero words and fails the base rule; a null host is a host of its own; repeated rows give
one result row each; a frequency equal to a limit is within it, and two lines of one normal form are one line; a text of any
length is one row, whose lines are counted as hashes; an empty table gives an empty result; columns other than id, text and
host are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import shared_dir, stored

GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
SALTS = 16


def text_rules(docs: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """``docs`` (doc_id, text, host) with word and repetition counts, a text key and its lines (hash, words)."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.concat(F.lit("="), F.col("host").cast("string")), F.lit("")).alias("host"))
    d = d.withColumn("words", F.array_remove(F.split("text", GAP), ""))
    d = d.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumn("n_words", F.size("words").cast("long"))
    d = d.select(
        "doc_id", "host", "words", "n_words",
        F.md5("text").alias("text_key"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("lines", lambda x: F.struct(
            F.xxhash64(F.regexp_replace(F.trim(F.regexp_replace(F.lower(x), GAP, " ")), "[0-9]+", "0")).alias("line"),
            F.size(F.array_remove(F.split(x, GAP), "")).cast("long").alias("words"),
        )).alias("lines"),
    )
    at = F.sequence(F.lit(0), F.col("n_words").cast("int") - window)
    d = d.withColumn("hashes", F.when(F.col("n_words") >= window, F.transform(at, lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(window)]))))
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    d = d.withColumn("places", F.when(repeats, F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter("places", lambda p, j: (p["h"] == F.get("places", j - 1)["h"]) | F.coalesce(p["h"] == F.get("places", j + 1)["h"], F.lit(False)))
    d = d.withColumn("again", F.sort_array(F.transform(twice, lambda p: p["i"])))
    covered = F.aggregate(
        "again",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + i + window - F.greatest(a["end"], i)).cast("long").alias("n"), (i + window).alias("end")),
        lambda a: a["n"],
    )
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("words", "hashes", "places", "again")


def line_rules(docs: DataFrame, *, line_share: int = 8, min_docs: int = 5, max_docs: int = 1000, max_removed: int = 70, min_words: int = 10, max_repeat: int = 20) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, host): its statistics, removed_words, base_failed and kept."""
    spark = docs.sparkSession
    path = shared_dir(spark)
    rows = stored(text_rules(docs), path)
    texts = rows.groupBy("host", "text_key").agg(F.first("lines").alias("lines"))
    sizes = texts.groupBy("host").agg(F.count(F.lit(1)).alias("n_texts"))
    lines = texts.select("host", "text_key", F.explode("lines").alias("x")).select("host", "text_key", "x.line", "x.words")
    single = texts.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    counted = single.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min_docs)
    counted = counted.join(sizes, "host").where((100 * F.col("n") > line_share * F.col("n_texts")) | (F.col("n") > max_docs)).select("host", "line")
    salt = F.pmod(F.xxhash64("text_key"), F.lit(SALTS))
    spread = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    cut = lines.withColumn("salt", salt).join(counted.withColumn("salt", spread), ["host", "line", "salt"])
    cut = cut.groupBy("host", "text_key").agg(F.sum("words").alias("removed_words")).withColumn("salt", spread)
    out = rows.drop("lines").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).join(cut, ["host", "text_key", "salt"], "left")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    gone = F.coalesce("removed_words", F.lit(0).cast("long"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (100 * gone <= max_removed * F.col("n_words")) & (F.col("n_words") - gone >= min_words)).alias("kept"), gone.alias("removed_words"),
    )
