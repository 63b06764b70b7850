"""Runs: stretches of words that repeat with a period, found with a dictionary of basic factors.

Factors of 1, 2, 4, ... words are numbered, so that equal ones have equal numbers; those of twice the length get theirs
from two halves. For each length the next occurrence of a factor within twice that length proposes its
distance as a period. Neighbouring places that propose the same distance, an arithmetic progression of
occurrences, count once. Each proposal is extended to both sides by the dictionary, and equal stretches are
merged under their smallest period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grantstar.llm.common import words

#: A run has at least this many words, and at least this many times its period.
LEAST_WORDS, LEAST_POWERS = 6, 4
#: Words of short documents that go through the dictionary together; a longer document goes alone.
BATCH_WORDS = 1 << 17

RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])


def _named(at: np.ndarray, keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``size`` places the number of its key, -1 where the key is there once or there is none,
    and the distance to the next place with the same key, 0 if there is none. ``at`` ascends."""
    order = np.argsort(keys, kind="stable")
    ordered, places = keys[order], at[order]
    same = ordered[1:] == ordered[:-1]
    often = np.append(same, False) | np.append(False, same)
    number = np.cumsum(np.append(True, ~same))
    names, ahead = np.full(size, -1, np.int32), np.zeros(size, np.int32)
    names[places[often]] = number[often]
    ahead[places[:-1][same]] = (places[1:] - places[:-1])[same]
    return names, ahead


class BasicFactors:
    """``names[k]`` numbers the factors of 2**k words by place. A factor that is there once has no number, so the work
    shrinks with each length. ``ahead[k]`` is the distance to the next occurrence."""

    def __init__(self, words: np.ndarray):
        size = len(words)
        self.names, self.ahead = [], []
        at, keys = np.arange(size), words.astype(np.int64)
        while len(at):
            names, ahead = _named(at, keys, size)
            half = 1 << len(self.names)
            self.names.append(names)
            self.ahead.append(ahead)
            at = np.flatnonzero(names[: max(0, size - half)] >= 0)
            at = at[names[at + half] >= 0]
            keys = names[at].astype(np.int64) << 32 | names[at + half]

    def proposals(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and periods."""
        places, periods = [], []
        for k, ahead in enumerate(self.ahead):
            near = np.where(ahead <= 2 << k, ahead, 0)
            first = np.flatnonzero((near > 0) & (near != np.append(0, near[:-1])))
            places.append(first)
            periods.append(near[first])
        return np.concatenate(places or [np.zeros(0, int)]), np.concatenate(periods or [np.zeros(0, int)])

    def equal_after(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on are equal; i before j."""
        total, size = np.zeros(len(i), np.int64), len(self.names[0]) if self.names else 0
        for k in range(len(self.names) - 1, -1, -1):
            b = j + total
            inside = b < size
            one = self.names[k][np.where(inside, i + total, 0)]
            total += ((one >= 0) & inside & (one == self.names[k][np.where(inside, b, 0)])).astype(np.int64) << k
        return total

    def equal_before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i and before j are equal; i before j."""
        total = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            a = i - total - (1 << k)
            inside = a >= 0
            one = self.names[k][np.where(inside, a, 0)]
            other = self.names[k][np.where(inside, j - total - (1 << k), 0)]
            total += ((one >= 0) & inside & (one == other)).astype(np.int64) << k
        return total


def runs(
    words: np.ndarray, least: int = LEAST_WORDS, powers: int = LEAST_POWERS
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs of a sequence of word numbers, by start, then period.

    The first 2**k words of a run of period q, for the least 2**k >= q, come again after q words and not
    earlier, so that length proposes q. A stretch found with a multiple of its period has the same ends, so
    the smallest period is the one to keep. ``powers`` must be 4 or more: a shorter run may end before the factor
    has come again.
    """
    factors = BasicFactors(words)
    at, period = factors.proposals()
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none
    before = factors.equal_before(at, at + period)
    length = before + period + factors.equal_after(at, at + period)
    start = at - before
    long = length >= np.maximum(least, powers * period)
    start, length, period = start[long], length[long], period[long].astype(np.int64)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _batch_runs(texts: list[list[bytes]], least: int, powers: int) -> Iterator[tuple[list[dict], bytes]]:
    """The runs and the collapsed text of each document. Words of different documents have different numbers, so
    no factor comes again in another document."""
    numbers, ends, base = [], [], 0
    for words in texts:
        own: dict[bytes, int] = {}
        numbers.extend([base + own.setdefault(w, len(own)) for w in words])
        base += len(own)
        ends.append(len(numbers))
    start, length, period = runs(np.array(numbers, np.int64), least, powers)
    drop = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(drop, start + period, 1)
    np.add.at(drop, start + length, -1)
    dropped = np.cumsum(drop) > 0
    of = np.searchsorted(start, [0, *ends])
    begin = 0
    for k, (words, end) in enumerate(zip(texts, ends)):
        own = slice(of[k], of[k + 1])
        found = zip((start[own] - begin).tolist(), length[own].tolist(), period[own].tolist())
        gone = dropped[begin:end]
        kept = [w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words
        yield [dict(zip(("start", "length", "period"), run)) for run in found], b" ".join(kept)
        begin = end


def periodic_runs(docs: DataFrame, least: int = LEAST_WORDS, powers: int = LEAST_POWERS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, runs (start, length, period by start, then period) and the
    collapsed text.

    Words are numbered from 0. A run has at least ``least`` words and ``powers`` periods, and no neighbouring word
    goes on with its period. Of each run the words after the first period go; the rest is joined by single
    spaces. A null or empty text has no runs and collapses to ''. Rows are looked at one by one, so repeated ids
    and null ids do not matter; a text of any length is one row's work, about a hundred bytes of memory for each
    word. Only doc_id and text are looked at.
    """
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("runs", T.ArrayType(RUN, False), False),
            T.StructField("collapsed", T.BinaryType(), False),
        ]
    )
    bound = BATCH_WORDS

    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)

        def out(ids, texts):
            found, collapsed = zip(*_batch_runs(texts, least, powers))
            columns = zip((ids, found, collapsed), arrow)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in columns], schema=arrow)

        for batch in batches:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(*batch.columns):
                words = (text.as_py() or b"").split()
                if ids and size + len(words) > bound:
                    yield out(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(doc_id.as_py())
                texts.append(words)
                size += len(words)
            if ids:
                yield out(ids, texts)

    found = docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, schema)
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def greatest_power(found: Column) -> Column:
    """Of an array of runs the one with the greatest length by period, compared exactly; ties go to the smallest
    start, then period. Null without runs."""
    return F.get(
        F.array_sort(
            found,
            lambda x, y: F.when(x["length"] * y["period"] > y["length"] * x["period"], -1)
            .when(x["length"] * y["period"] < y["length"] * x["period"], 1)
            .when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1))
            .otherwise(F.when(x["period"] < y["period"], -1).when(x["period"] > y["period"], 1).otherwise(0)),
        ),
        0,
    )


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the greatest power as start, length, period and exponent_milli, runs_sha256 and
    collapsed_sha256 of what ``periodic_runs`` gives."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.withColumn("best", greatest_power(F.col("runs")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The documents, those whose crc32 of the decimal doc_id is a multiple of ten with their words made periodic
    from one place on. Documents without an id stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, words(F.col("text"))).alias("w"), g.alias("g"))
    n = F.size("w")
    at = chosen.withColumn("a", (F.col("g") % F.greatest(n, F.lit(1))).cast("int"))
    p = 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)).cast("int")
    at = at.withColumn("p", F.greatest(p, F.lit(1)))
    times = F.ceil((n - F.col("a")) / F.col("p")).cast("int")
    cycle = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), times))
    planted = F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(cycle, F.lit(1), n - F.col("a")))
    return at.select("doc_id", F.when(n > 0, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))
