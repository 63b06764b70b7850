"""Token counts from an exact histogram of encoded lengths.

Documents are counted by their number of tokens; prefix and suffix sums over the lengths then answer totals,
quantiles and truncated totals for every context limit, without a look at the documents.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grantstar.llm.common import stored
from grantstar.llm.tasks import map_slices

#: Lengths summed by one window; blocks of them are summed before.
BLOCK = 1024
#: Runs of white space from this length on are cut out of a text: the library looks at one with a stack that
#: grows with it.
LONG_RUN = 4096

#: The white space of Unicode.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def token_counter(ranks: dict[bytes, int], pattern: str) -> Callable[[str], int]:
    """The number of tokens of a text, as the library encodes it.

    The pattern makes a run of white space, its last character aside unless the text ends there, a piece of its own. So a
    long run is encoded as such a piece, and the text before and after it, that character in front, by itself.
    """
    import tiktoken

    encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    piece = tiktoken.Encoding("run", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    long_run = re.compile(f"[{_WHITE}]{{{LONG_RUN},}}")

    def count(text: str) -> int:
        at, total = 0, 0
        for run in long_run.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            total += len(encode(text[at : run.start()])) + len(piece(text[run.start() : end]))
            at = end
        return total + len(encode(text[at:]))

    return count


def length_histogram(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """length, docs: how many rows of ``docs`` encode to so many tokens. Null and empty texts have none; a text of any
    length is encoded as a whole. Every row counts, repeated ones and those without an id, too; an empty table gives
    no rows. Only text is looked at.

    The rank file of the byte-level BPE vocabulary is read on the driver and travels with the tasks. Slices
    of rows are counted inside the task and added up before the shuffle.
    """
    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    schema = T.StructType(
        [T.StructField("length", T.LongType(), False), T.StructField("docs", T.LongType(), False)]
    )

    def make():
        tokens = token_counter(ranks, pattern)

        def work(columns):
            counts = Counter(tokens(t) if t else 0 for t in columns[0])
            return [list(counts), list(counts.values())]

        return work

    return map_slices(docs.select("text"), make, schema).groupBy("length").agg(F.sum("docs").alias("docs"))


def context_limits(histogram: DataFrame) -> DataFrame:
    """One row for each length that occurs, as a context limit.

    length, docs (of this length), tokens (theirs), docs_upto, tokens_upto (at most so long), docs_over (longer:
    truncated at this limit), tokens_kept (all tokens if every document is cut to this length), tokens_lost,
    quantile (share of documents at most so long). An empty histogram gives no rows.
    """
    table = stored(histogram, "lengths").withColumn("block", F.floor(F.col("length") / BLOCK))
    table = table.withColumn("tokens", F.col("length") * F.col("docs"))
    blocks = table.groupBy("block").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("docs", "tokens")),
        *(F.sum(c).over(whole).alias(f"{c}_all") for c in ("docs", "tokens")),
    )
    within = Window.partitionBy("block").orderBy("length")
    df = table.join(blocks, "block")
    for c in ("docs", "tokens"):
        df = df.withColumn(f"{c}_upto", F.col(f"{c}_before") + F.sum(c).over(within))
    df = df.withColumn("docs_over", F.col("docs_all") - F.col("docs_upto"))
    df = df.withColumn("tokens_kept", F.col("tokens_upto") + F.col("length") * F.col("docs_over"))
    return df.select(
        "length",
        "docs",
        "tokens",
        "docs_upto",
        "tokens_upto",
        "docs_over",
        "tokens_kept",
        (F.col("tokens_all") - F.col("tokens_kept")).alias("tokens_lost"),
        (F.col("docs_upto") / F.col("docs_all")).alias("quantile"),
    )


def at_limit(limits: DataFrame, limit: int) -> DataFrame:
    """docs_over, tokens_kept for any ``limit``, also one that no document has: from the longest length
    at most so long. One row; none if every document is longer, or there are none."""
    best = limits.where(F.col("length") <= limit).orderBy(F.desc("length")).limit(1)
    kept = F.col("tokens_upto") + F.lit(limit) * F.col("docs_over")
    return best.select(F.lit(limit).alias("limit"), "docs_over", kept.alias("tokens_kept"))


def length_quantile(limits: DataFrame, share: float) -> DataFrame:
    """The smallest length that at least ``share`` of all documents do not exceed. One row, null without documents."""
    return limits.where(F.col("quantile") >= share).agg(F.min("length").alias("length"))
