"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of a text, and a cut is wherever it is the least of some MOST_BYTES places side by
side. So a cut depends on the bytes near it only, and there is no way for two texts that share a passage to miss
each other's cuts inside it. Chunks are deduplicated by digest; runs of chunks that occur elsewhere too become
repeated spans.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grantstar.llm.common import stored
from grantstar.llm.tasks import map_slices

#: A cut is the least hash of so many places (a power of two), and no chunk is longer; half of it on average.
MOST_BYTES = 64
#: The hash at a cut looks back so many bytes; the digest of a chunk covers them, too, so a short one is no chance match.
CONTEXT_BYTES = 32
#: Repeated chunks side by side are a repeated span from so many shared bytes on, the context of the first included.
#: At most MOST_BYTES - 1 bytes at each end of a shared passage are outside, so any of SPAN_BYTES + 2 * (MOST_BYTES - 1)
#: bytes is found, unless it repeats its own bytes within MOST_BYTES.
SPAN_BYTES = 128

#: One random number for each byte value, from a fixed seed.
GEAR = np.array(random.Random(20).sample(range(1 << 32), 256), dtype=np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: h = (h << 1) + GEAR[byte] in 32 bits, so older bytes drop out.

    Worked out for all places at once: sums over 2, 4, ... 32 bytes from sums over half as many.
    """
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        older = h[:-k] << np.uint32(k)
        h = h.copy()
        h[k:] += older
    return h


def _sliding(of, values: np.ndarray) -> np.ndarray:
    """The least or largest of each MOST_BYTES values side by side, from those of half as many."""
    size = 1
    while size < MOST_BYTES:
        values = of(values[:-size], values[size:])
        size *= 2
    return values


def cuts(text: bytes) -> list[int]:
    """Ends of the chunks of a text."""
    data = np.frombuffer(text, np.uint8)
    if not len(data):
        return []
    out, last = [], None
    if len(data) > MOST_BYTES:
        h = gear_hashes(data)
        least = _sliding(np.minimum, h)
        at = np.flatnonzero(h == _sliding(np.maximum, np.pad(least, MOST_BYTES - 1)))
        for end, value in zip((at + 1).tolist(), h[at].tolist()):
            # Of equal hashes, as in a run of one byte, one in MOST_BYTES places is enough.
            if not out or value != last or end - out[-1] >= MOST_BYTES:
                out.append(end)
                last = value
    if not out or out[-1] < len(text):
        out.append(len(text))
    return out


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text) and the chunks of each text in UTF-8: digest, start, end, and whether it is
    the first with this digest in the text. Null texts have none."""
    chunk = T.StructType(
        [
            T.StructField("digest", T.LongType(), False),
            T.StructField("start", T.IntegerType(), False),
            T.StructField("end", T.IntegerType(), False),
            T.StructField("first", T.BooleanType(), False),
        ]
    )
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("text_key", T.LongType()),
            T.StructField("chunks", T.ArrayType(chunk, False), False),
        ]
    )

    def make():
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        kinds = pa.struct([("digest", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("first", pa.bool_())])

        def work(columns):
            sizes, hashes, starts, ends, firsts = [0], [], [], [], []
            for text in columns[2]:
                data = (text or "").encode("utf-8", "replace")
                last, seen = 0, set()
                for end in cuts(data):
                    h = digest(data[max(0, last - CONTEXT_BYTES) : end])
                    hashes.append(h)
                    starts.append(last)
                    ends.append(end)
                    firsts.append(h not in seen)
                    seen.add(h)
                    last = end
                sizes.append(len(hashes))
            values = pa.StructArray.from_arrays(
                [
                    pa.array(np.array(hashes, np.uint64).view(np.int64)),
                    pa.array(starts, pa.int32()),
                    pa.array(ends, pa.int32()),
                    pa.array(firsts, pa.bool_()),
                ],
                fields=list(kinds),
            )
            return [columns[0], columns[1], pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values)]

        return work

    return map_slices(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text"), make, schema)


def spans_by_text(docs: DataFrame, span_bytes: int = SPAN_BYTES) -> DataFrame:
    """What ``repeated_spans`` gives, with text_key: offsets belong to one text, whatever else has its id."""
    held = stored(chunks(docs), "chunks")
    each = held.select("doc_id", "text_key", F.explode("chunks").alias("c")).select("doc_id", "text_key", "c.*")
    # The smallest id, any id before none.
    owner = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    counts = each.groupBy("digest").agg(F.count("*").alias("n"), F.min(owner).alias("keeper"))
    twice = stored(counts.where("n > 1").select("digest", "keeper"), "twice")
    stays = owner.eqNullSafe(F.col("keeper")) & F.col("first")
    key = ["doc_id", "text_key"]
    hits = each.join(twice, "digest").select(*key, "start", "end", (~stays).alias("goes")).distinct()

    def islands(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        by = Window.partitionBy(*keys).orderBy("start", "end")
        new = F.coalesce(F.col("start") > F.lag("end").over(by), F.lit(True)).cast("int")
        return df.withColumn("new", new).withColumn(name, F.sum("new").over(by)).drop("new")

    runs = islands(hits, key, "run")
    of_run = Window.partitionBy(*key, "run")
    runs = runs.withColumn("from", F.min("start").over(of_run)).withColumn("to", F.max("end").over(of_run))
    shared = F.col("to") - F.greatest(F.lit(0), F.col("from") - CONTEXT_BYTES)
    runs = runs.where(shared >= span_bytes)
    span = F.struct(F.col("from").alias("start"), F.col("to").alias("end"))
    gone = F.when(F.col("goes"), F.struct("start", "end"))
    out = runs.groupBy(*key).agg(
        F.array_sort(F.collect_set(span)).alias("spans"), F.array_sort(F.collect_set(gone)).alias("cuts")
    )

    def total(column: str):
        return F.aggregate(
            column, F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"]).cast("long")
        )

    return out.select(
        *key,
        F.size("spans").cast("long").alias("n_spans"),
        total("spans").alias("repeated_bytes"),
        total("cuts").alias("removed_bytes"),
        "spans",
        "cuts",
    )


def repeated_spans(docs: DataFrame, span_bytes: int = SPAN_BYTES) -> DataFrame:
    """One row for each document with a repeated span: doc_id, n_spans, repeated_bytes, removed_bytes, spans
    (array of start, end) and cuts (array of start, end: what goes, so that one occurrence stays).

    Offsets are bytes of the text in UTF-8. A span begins and ends at cuts, so it can be shorter than the shared passage
    by CONTEXT_BYTES + MOST_BYTES at its start and MOST_BYTES at its end. Of the chunks with one digest the first in the document with
    the smallest doc_id stays. A document without repeats, with an empty or a null text, gives no row.
    Rows that share a doc_id (null included) but not the text are documents of their own, each with its row; rows that
    agree in both give one. Only doc_id and text are looked at.

    Occurrences of a digest are counted before they are shuffled, and the join that finds them again can be
    split, so a passage that a third of all documents hold is spread over tasks. All chunks of one
    document are gathered in one place, never those of one digest; so a very long text is one task's work.
    """
    return spans_by_text(docs, span_bytes).drop("text_key")


def without_repeats(docs: DataFrame, span_bytes: int = SPAN_BYTES) -> DataFrame:
    """``docs`` with the cuts of ``repeated_spans`` taken out of the texts; all else as it is.

    A cut inside a character takes the whole character. Cuts belong to an id and a text: rows that share an id, or have none,
    lose what their own text repeats and no more. Null and empty texts stay as they are; an empty table gives no
    rows. Names that begin with ``__cut_`` are reserved.
    """
    found = spans_by_text(docs, span_bytes).where(F.size("cuts") > 0)
    found = found.select(
        F.col("doc_id").alias("__cut_id"), F.col("text_key").alias("__cut_key"), F.col("cuts").alias("__cut_spans")
    )
    same = F.col("doc_id").eqNullSafe(F.col("__cut_id")) & (F.xxhash64("text") == F.col("__cut_key"))

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, own in zip(texts.to_pylist(), spans.to_pylist()):
            if text is not None and own:
                data, at, parts = text.encode(), 0, []
                for span in own:
                    parts.append(data[at : span["start"]])
                    at = max(at, span["end"])
                text = b"".join([*parts, data[at:]]).decode("utf-8", "ignore")
            out.append(text)
        return pa.array(out, pa.string())

    return docs.join(found, same, "left").withColumn("text", cut("text", "__cut_spans")).select(docs.columns)
