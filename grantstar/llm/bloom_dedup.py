"""Exact deduplication behind a two-pass Bloom filter, with built-in functions only.

Pass one hashes every text to two bit positions and keeps the positions that were hit at least twice, as
a table of 4 KB bitmaps. Pass two looks every hash up: a text with a position that was hit once has no copy
and passes straight through. Only texts that may be repeated are shuffled, by their full digest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantstar.llm.common import ascii_lower, stored
from grantstar.session import scratch_folder

#: Bits of the filter for each row and hash position: a unique text is taken for a possible copy in about
#: (1 / BITS_PER_ROW) ** 2 of all cases.
BITS_PER_ROW = 16
#: One bitmap holds so many bits (the size Spark's bitmap functions use).
BITMAP_BITS = 32768
#: The filter is broadcast, so it is never larger than this. ``exact_copies`` goes through more rows than one filter
#: can tell apart in slices of the hashes, each with a filter of its own.
BROADCAST_BYTES = 32 << 20


@dataclass(frozen=True)
class RepeatFilter:
    """Bitmaps (``bucket``, ``bits``) of the positions that at least two rows share."""

    table: DataFrame
    positions: int

    def tests(self, df: DataFrame, digest: str, flag: str) -> DataFrame:
        """``df`` with ``flag``: false if no other row can have this digest."""
        for plane in (0, 1):
            at, bucket, bits = f"{flag}_at{plane}", f"{flag}_bucket{plane}", f"{flag}_bits{plane}"
            side = F.broadcast(self.table.select(F.col("bucket").alias(bucket), F.col("bits").alias(bits)))
            df = df.withColumn(at, _position(F.col(digest), plane, self.positions))
            df = df.join(side, F.bitmap_bucket_number(F.col(at)) == F.col(bucket), "left")
            df = df.withColumn(f"{flag}{plane}", _bit_is_set(F.col(bits), F.col(at)))
            df = df.drop(at, bucket, bits)
        hit = F.coalesce(F.col(f"{flag}0") & F.col(f"{flag}1"), F.lit(False))
        return df.withColumn(flag, hit).drop(f"{flag}0", f"{flag}1")


def _position(digest: Column, plane: int, positions: int) -> Column:
    """A bit position, from 1 on; the planes have separate ranges."""
    return F.pmod(F.xxhash64(digest, F.lit(plane)), F.lit(positions)) + F.lit(1 + plane * positions)


def _bit_is_set(bits: Column, position: Column) -> Column:
    at = F.bitmap_bit_position(position)
    byte = F.conv(F.hex(F.substring(bits, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(1) == 1


def repeat_filter(digests: DataFrame, digest: str, rows: int) -> RepeatFilter:
    """Pass one: counts of bit positions, added up before the shuffle, then bitmaps of those above one."""
    # Two planes of positions / 8 bytes.
    most = 4 * BROADCAST_BYTES
    positions = max(BITMAP_BITS, min(most, 1 << (max(1, rows) * BITS_PER_ROW - 1).bit_length()))
    both = F.array(*(_position(F.col(digest), plane, positions) for plane in (0, 1)))
    hits = digests.select(F.explode(both).alias("at")).groupBy("at").count().where("count > 1")
    table = hits.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")
    )
    return RepeatFilter(stored(table, "repeats"), positions)


def slices_for(rows: int) -> int:
    """Slices of the hashes, so that a filter within BROADCAST_BYTES has BITS_PER_ROW for each row of a slice and plane."""
    return max(1, -(-2 * rows * BITS_PER_ROW // (8 * max(1, BROADCAST_BYTES))))


def possible_copies(keys: DataFrame) -> DataFrame:
    """``keys`` (stored; doc_id, digest) with ``maybe``: false where no other row can have the digest.

    At any size fewer than one in 100 unique digests is taken for a possible copy. Many rows are written once more in slices by
    their hash, without a shuffle, and slice after slice is tested by its own filter.
    """
    rows = keys.count()
    n = slices_for(rows)
    if n == 1:
        return repeat_filter(keys, "digest", rows).tests(keys, "digest", "maybe")
    spark, folder = keys.sparkSession, f"{scratch_folder(keys.sparkSession, 'llm')}/slices"
    own = keys.withColumn("slice", F.pmod(F.xxhash64("digest", F.lit(2)), F.lit(n)).cast("int"))
    own.write.partitionBy("slice").parquet(folder)
    for k in range(n):
        part = spark.read.schema(keys.schema).parquet(f"{folder}/slice={k}")
        tested = repeat_filter(part, "digest", part.count()).tests(part, "digest", "maybe")
        tested.write.mode("append").parquet(f"{folder}-tested")
    return spark.read.parquet(f"{folder}-tested")


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with A-Z in lower case; null counts as empty."""
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256))


def _keepers(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of one id and digest with their number, and for each digest the id that stays.

    Both are counted before they are shuffled; the second is stored, so that the planner can split
    the join of a digest which a third of all rows share.
    """
    rows = stored(candidates.groupBy("digest", "doc_id").agg(F.count("*").alias("copies")), "rows")
    groups = rows.groupBy("digest").agg(
        F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")
    )
    return rows, stored(groups, "groups")


def exact_copies(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays, null being the smallest; of rows that agree in
    id and text exactly one stays. Null and empty texts are equal; a text of any length is hashed as a whole. An empty
    table gives no rows. Only the columns doc_id and text are looked at.
    """
    keys = stored(docs.select("doc_id", text_digest(F.col("text")).alias("digest")), "digests")
    tested = possible_copies(keys)
    single = tested.where(~F.col("maybe")).select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "digest",
    )
    rows, groups = _keepers(tested.where("maybe").select("doc_id", "digest"))
    nth = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    several = rows.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size", "digest", nth.alias("nth")
    )
    several = several.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        "digest",
    )
    out = single.unionByName(several)
    return out.withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are.

    Same choice as ``exact_copies``. Rows that the filter clears are never shuffled. It is one filter over all rows: beyond
    about 8 million of them it has fewer bits for each, so more unique texts are taken for possible copies and
    shuffled, with the same results. If several rows agree in id and text, any one of them stays.
    """
    mark, digest = "__exact_maybe", "__exact_digest"
    keys = stored(docs.select("doc_id", text_digest(F.col("text")).alias("digest")), "digests")
    seen = repeat_filter(keys, "digest", keys.count())
    rows, groups = _keepers(seen.tests(keys, "digest", "maybe").where("maybe").select("doc_id", "digest"))
    one_of = rows.join(groups, "digest").where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    keep = one_of.select(
        F.col("digest").alias(digest),
        F.col("keep_id").alias("__exact_keep"),
        F.col("copies").alias("__exact_rows"),
    )
    keep = stored(keep, "keep")
    tested = seen.tests(docs.withColumn(digest, text_digest(F.col("text"))), digest, mark)
    passed = tested.where(~F.col(mark)).select(docs.columns)
    same = [digest], F.col("doc_id").eqNullSafe(F.col("__exact_keep"))
    chosen = tested.where(F.col(mark)).join(keep, same[0]).where(same[1])
    once = chosen.where("__exact_rows = 1").select(docs.columns)
    tied = chosen.where("__exact_rows > 1").dropDuplicates([digest]).select(docs.columns)
    return passed.unionByName(once).unionByName(tied)
