"""Quality rules: line frequencies across documents, with built-in functions only.

Normalised lines are hashed, distinct documents are counted for each host and line, lines above the limit are
taken out, and documents of which too little is left are rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantstar.llm.common import WHITE, stored, words


@dataclass(frozen=True)
class LineLimits:
    """A line is boilerplate of its host if more than ``share`` of the host's documents hold it and at
    least ``least`` do, or if ``most`` do, on a host of any size; and only if at least ``least`` different texts do, so that
    copies of one document do not make its own lines boilerplate. A document is depleted if less than ``left_share`` of its
    words are left, or fewer than ``left_words``."""

    share: float = 0.05
    least: int = 20
    most: int = 10_000
    left_share: float = 0.5
    left_words: int = 20


#: Limits under which many lines go and some documents with them, also in small tables.
STRICT = LineLimits(share=0.02, least=3, most=1000, left_share=0.9)


def normalised_line(line: Column) -> Column:
    """Lower case, all white space as spaces, none at the ends."""
    for white in WHITE.replace(" ", ""):
        line = F.replace(line, F.lit(white), F.lit(" "))
    return F.trim(F.lower(line))


def _hashed_lines(lines: Column) -> Column:
    """Each line as (hash, number of words)."""
    normal = F.transform(lines, normalised_line)
    return F.transform(
        normal,
        lambda x: F.struct(
            F.xxhash64(x).alias("line"), F.size(F.array_remove(F.split(x, " "), "")).alias("n")
        ),
    )


def _repeated_windows(w: str) -> dict[str, Column]:
    """Expressions by column, each to be added in its own step; the last holds the sorted places of all
    windows of three words that occur twice or more.

    Sorting plain longs is cheap: 33 bits of the hash in front of the place bring windows that may be equal
    side by side. Only those are sorted by their whole hash.
    """
    last = F.size(w) - 3
    hashes = F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
    )
    packed = F.transform(
        "h", lambda x, i: x.bitwiseAND(F.lit(-1 << 31)).bitwiseOR(i.cast("long"))
    )
    near = lambda x, y: F.shiftright(x.bitwiseXOR(y), 31) == 0
    beside = F.filter(
        "packed",
        lambda x, k: near(x, F.get("packed", k + 1)) | near(x, F.when(k > 0, F.get("packed", k - 1))),
    )
    places = F.transform(beside, lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))
    whole = F.sort_array(F.transform(places, lambda i: F.struct(F.get("h", i).alias("h"), i.alias("i"))))
    twice = F.filter(
        "runs",
        lambda x, k: (F.get("runs", k + 1)["h"] == x["h"])
        | (F.when(k > 0, F.get("runs", k - 1))["h"] == x["h"]),
    )
    return {
        "h": F.when(last >= 1, hashes),
        "packed": F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(packed)),
        "runs": whole,
        "at": F.sort_array(F.transform(twice, lambda x: x["i"])),
    }


def _covered(at: str) -> Column:
    """Words under windows of three that begin at the given sorted places."""
    steps = F.transform(at, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - i, F.lit(3))))
    return F.coalesce(F.aggregate(steps, F.lit(0), lambda a, b: a + b), F.lit(0))


def text_measures(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, a hash of the text, the measures, and the distinct
    normalised lines as (hash, words of all such lines)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", "source", text.alias("text")).withColumn("w", words(F.col("text")))
    df = df.withColumn(
        "lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    )
    for name, column in _repeated_windows("w").items():
        df = df.withColumn(name, column)
    return df.select(
        "doc_id",
        "source",
        F.xxhash64("text").alias("text_hash"),
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _covered("at").cast("long").alias("n_repeat_words"),
        _hashed_lines(F.col("lines")).alias("lines"),
    )


def frequent_lines(measures: DataFrame, limits: LineLimits) -> DataFrame:
    """(source, line, docs, texts) of the lines above the limits: the documents and the different texts that hold it.

    Rows are counted by host, line and text before they are shuffled, so a line that a third of all documents hold
    is spread over all tasks.
    """
    hosts = measures.groupBy(F.col("source").alias("host")).agg(F.count("*").alias("of"))
    held = measures.select("source", "text_hash", F.explode(F.array_distinct(F.col("lines.line"))).alias("line"))
    counts = held.groupBy("source", "line").agg(
        F.count("*").alias("docs"), F.countDistinct("text_hash").alias("texts")
    )
    counts = counts.where(F.col("texts") >= limits.least)
    above = counts.join(hosts, F.col("source").eqNullSafe(F.col("host")))
    often = (F.col("docs") > limits.share * F.col("of")) | (F.col("docs") >= limits.most)
    return above.where(often).select("source", "line", "docs", "texts")


def line_quality(docs: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, removed_words.

    The host is the source; null is a host of its own. Every row is a document of its host. A null text has no words and
    fails, like any text below 50 words; a text of any length is measured as a whole. Lines without a word are not counted. ``removed_words`` are the words of frequent lines,
    every occurrence counted; what is left decides if the document is depleted. An empty table gives no rows.
    Rows that agree in id, source and text get the same result. Only doc_id, source and text are looked at.
    """
    measures = stored(text_measures(docs), "measures")
    frequent = stored(frequent_lines(measures, limits).select("source", "line"), "frequent").select(
        F.col("source").alias("host"), F.col("line").alias("known")
    )
    key = ["doc_id", "source", "text_hash"]
    once = measures.select(*key, F.explode("lines").alias("x")).select(*key, "x.line", "x.n")
    hits = once.join(frequent, F.col("source").eqNullSafe(F.col("host")) & (F.col("line") == F.col("known")))
    # Rows that agree in the key have the same lines: the sum over them is shared evenly.
    removed = hits.groupBy(*key).agg(F.sum("n").alias("hit_words"))
    copies = measures.groupBy(*key).agg(F.count("*").alias("rows"))
    same = [F.col(f"m.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key]
    removed = removed.alias("m").join(copies.alias("r"), same[0] & same[1] & same[2]).select(
        *(F.col(f"m.{k}").alias(f"of_{k}") for k in key),
        (F.col("hit_words") / F.col("rows")).cast("long").alias("hit_words"),
    )
    on = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in key]
    out = measures.drop("lines").join(removed, on[0] & on[1] & on[2], "left")
    out = out.withColumn("removed_words", F.coalesce("hit_words", F.lit(0).cast("long")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    rest = (left >= limits.left_words) & (left >= limits.left_share * F.col("n_words"))
    return out.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & rest).alias("kept"),
        "removed_words",
    )
