"""Substring search through a stored index of the trigrams of a text column."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grantstar.operators.ranking import HINTED_ROWS, short_list

#: Characters of a gram; shorter terms cannot be looked up.
WIDTH = 3
#: Texts in one bucket of the text table, on average.
BUCKET_ROWS = 50_000
#: Grams of a term whose lists are intersected: the rarest ones. More would read longer lists to drop few texts.
GRAMS = 4
#: A term whose rarest gram is in more than one text of so many is not worth looking up: the scan reads less.
SELECTIVE = 20


def grams(text: Column) -> Column:
    """The distinct trigrams of a text in lower case."""
    lower = F.lower(text)
    at = F.sequence(F.lit(1), F.length(lower) - WIDTH + 1)
    return F.when(F.length(lower) >= WIDTH, F.array_distinct(F.transform(at, lambda i: F.substring(lower, i, F.lit(WIDTH)))))


@dataclass(frozen=True)
class TextIndex:
    """``postings`` (gram, key, bucket and the columns to filter by), in order of gram; ``counts`` (gram, texts); and
    ``texts`` (the indexed rows by bucket), where a bucket is a folder of its own."""

    key: str
    postings: DataFrame
    counts: DataFrame
    texts: DataFrame

    def rarest(self, term: str) -> list[tuple[str, int]]:
        """The rarest grams of a term, with the number of texts that hold each."""
        own = self.counts.sparkSession.range(1).select(F.explode(grams(F.lit(term))).alias("gram"))
        found = own.join(self.counts, "gram", "left").select("gram", F.coalesce("texts", F.lit(0)).alias("n"))
        return [(r.gram, r.n) for r in found.orderBy("n", "gram").limit(GRAMS).collect()]

    def candidates(self, term: str, condition: Column | None = None) -> DataFrame | None:
        """(key, bucket) of the texts that hold the rarest grams of a term, None for a term too short or too common to
        look up.

        The lists are read by gram, and ``condition`` on the posting's own columns cuts them first. No list is longer than the
        count of its gram, so where the rarest is short the result may be broadcast, and the texts of all other
        buckets are never opened.
        """
        wanted = self.rarest(term)
        if not wanted:
            return None
        fewest = wanted[0][1]
        if fewest > HINTED_ROWS and fewest * SELECTIVE > self.texts.count():
            return None
        names = [gram for gram, _ in wanted]
        lists = self.postings.where(F.col("gram").isin(names))
        if condition is not None:
            lists = lists.where(condition)
        if len(names) == 1:
            found = lists.select(self.key, "bucket")
        else:
            held = lists.groupBy(self.key, "bucket").agg(F.count(F.lit(1)).alias("held"))
            found = held.where(F.col("held") == len(names)).select(self.key, "bucket")
        return short_list(found, fewest) if fewest <= HINTED_ROWS else found


def write_text_index(
    rows: DataFrame, folder: str, key: str, text: str, carry: Sequence[str] = (), bucket_rows: int = BUCKET_ROWS
) -> None:
    """Indexes ``text`` of rows with a unique ``key``; the columns ``carry`` are kept with the postings, all columns with the
    texts. Postings are dealt out by range of gram and key, so the list of a gram that most texts hold is spread
    over many files."""
    buckets = max(1, rows.count() // bucket_rows)
    placed = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/texts")
    held = placed.select(F.explode(grams(F.col(text))).alias("gram"), key, "bucket", *carry)
    held = held.repartitionByRange("gram", key).sortWithinPartitions("gram", key)
    held.write.mode("overwrite").parquet(f"{folder}/postings")
    counts = rows.sparkSession.read.parquet(f"{folder}/postings").groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{folder}/counts")


def read_text_index(spark: SparkSession, folder: str, key: str) -> TextIndex:
    return TextIndex(key, *(spark.read.parquet(f"{folder}/{name}") for name in ("postings", "counts", "texts")))
