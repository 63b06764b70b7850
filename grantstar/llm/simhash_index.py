"""SimHash near-deduplication through an inverted index of fingerprint bytes.

Two 64-bit fingerprints that differ in at most four bits differ in at most four of their eight bytes, so they
share at least four (position, byte) postings. A single posting holds one in 256 of all fingerprints, and
tallying its pairs would grow with the square of the corpus. The index therefore posts the sets of four
positions that such a tally must reach at least once, with their four bytes: a pair is found under the
first four positions it shares, which is where its count of shared bytes reaches the minimum. Pairs found are
verified bit by bit.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grantstar.llm.common import stored
from grantstar.llm.components import connected_components
from grantstar.llm.tasks import map_slices

SHINGLE_WORDS = 4
SEED = 42
MOST_BITS = 4
#: Shared positional bytes that two linked fingerprints have at least.
LEAST_SHARED = 8 - MOST_BITS
#: A posting list up to this length is joined with itself; the members of a longer one go to the ball index.
LIST_LENGTH = 64
#: Shingles whose bits are added up at once.
_BLOCK = 1 << 14

_SETS = list(combinations(range(8), LEAST_SHARED))


def fingerprint(text: str | None) -> int:
    """The SimHash of a text as an unsigned integer; zero without words.

    A-Z in lower case, words parted by ASCII white space, shingles of four words with repeats, XXH64.
    """
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    last = max(0, len(words) - SHINGLE_WORDS)
    ends = (ends - 1)[-1 - last :].tolist()
    digest, total, count = xxhash.xxh64_intdigest, np.zeros(64, np.int64), last + 1
    for at in range(0, count, _BLOCK):
        part = zip(starts[at : min(at + _BLOCK, count)].tolist(), ends[at : at + _BLOCK])
        hashes = np.array([digest(joined[a:b], SEED) for a, b in part], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > count, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text) and fingerprint (signed) of each row."""
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("text_key", T.LongType()),
            T.StructField("fingerprint", T.LongType(), False),
        ]
    )

    def make():
        def work(columns):
            unsigned = np.array([fingerprint(t) for t in columns[2]], np.uint64)
            return [columns[0], columns[1], unsigned.view(np.int64)]

        return work

    return map_slices(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text"), make, schema)


def _byte(value: Column, position: int) -> Column:
    return F.shiftrightunsigned(value, 8 * position).bitwiseAND(255)


def _posting(value: Column, number: int) -> Column:
    """The four bytes of a set of positions, behind the number of the set."""
    out = F.lit(number).cast("long")
    for position in _SETS[number]:
        out = F.shiftleft(out, 8).bitwiseOR(_byte(value, position))
    return out


def _first_shared(differing: Column) -> Column:
    """The number of the set of the first four positions at which two fingerprints agree."""
    bits = F.lit(0)
    for position in range(8):
        bits = bits + F.when(_byte(differing, position) == 0, 1 << position).otherwise(0)
    first = []
    for pattern in range(256):
        shared = tuple(p for p in range(8) if pattern >> p & 1)[:LEAST_SHARED]
        first.append(_SETS.index(shared) if len(shared) == LEAST_SHARED else -1)
    return F.element_at(F.array(*map(F.lit, first)), bits + 1)


def _dealt(prints: DataFrame) -> DataFrame:
    """Over all shuffle partitions: few bytes now, but each row is about to become many."""
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return prints.repartition(n, "fingerprint")


def _beside(posts: DataFrame, at: str, kept: DataFrame) -> DataFrame:
    """``posts``, all of them, with what ``kept`` has under the ``of`` that equals their column ``at``.

    The planner takes posts to be as small as the fingerprints they were made of, and would broadcast them, 70 or 2,081 rows
    for each. Of an outer join it can broadcast the right side only. What filters the rows must name columns of both
    sides in each condition, or the planner makes it an inner join.
    """
    return posts.join(kept, F.col(at) == F.col("of"), "left")


def links(prints: DataFrame, list_length: int = LIST_LENGTH) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints of ``prints`` (fingerprint) as all pairs that differ
    in at most four bits would.

    Pairs under short posting lists are all there. A fingerprint under any longer list (many near copies
    of one text) is dense: dense ones are linked through the ball index. So no list emits more than
    ``list_length`` / 2 pairs for each member, and no link is lost: a pair whose first shared set has a long
    list is a pair of dense fingerprints.
    """
    value = F.col("fingerprint")
    posts = _dealt(prints).select(
        value, F.explode(F.array(*(_posting(value, k) for k in range(len(_SETS))))).alias("post")
    )
    lists = posts.groupBy("post").agg(
        F.count("*").alias("n"), F.min("fingerprint").alias("a"), F.max("fingerprint").alias("b")
    )
    lists = stored(lists.where("n > 1"), "lists")
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= MOST_BITS
    two = lists.where("n = 2").where(near(F.col("a"), F.col("b"))).select("a", "b")
    more = _beside(posts, "post", lists.where("n > 2").select(F.col("post").alias("of"), "n"))
    more = stored(more.where(F.coalesce("of", F.bitwise_not("post")) == F.col("post")).drop("of"), "members")
    short = more.where(F.col("n") <= list_length)
    left = short.select("post", F.col("fingerprint").alias("a"))
    right = short.select(F.col("post").alias("of"), F.col("fingerprint").alias("b"))
    differing = F.col("a").bitwiseXOR(F.col("b"))
    number = F.shiftrightunsigned(F.col("post"), 8 * LEAST_SHARED).cast("int")
    pairs = left.join(
        right,
        (F.col("post") == F.col("of"))
        & (F.col("a") < F.col("b"))
        & (_first_shared(differing) == number)
        & near(F.col("a"), F.col("b")),
    ).select("a", "b")
    dense = more.where(F.col("n") > list_length).select("fingerprint").distinct()
    return two.union(pairs).union(ball_links(stored(dense, "dense")))


def ball_links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) that connect ``prints`` as all pairs at most four bits apart would, in linear work.

    Each fingerprint is posted under the 2,081 values at most two bits away. Those under one value are at most
    four bits apart, and two that are at most four apart meet under some value; so each is linked to the
    smallest one under the value.
    """
    bit = lambda n: F.when(n < 64, F.call_function("shiftleft", F.lit(1).cast("long"), n)).otherwise(0)
    one = _dealt(prints).select("fingerprint", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("i"))
    # i = 64 flips nothing, alone or as the partner of another bit.
    other = F.explode(F.sequence(F.col("i") + 1, F.greatest(F.lit(64), F.col("i") + 1)))
    two = one.withColumn("j", other)
    at = F.col("fingerprint").bitwiseXOR(bit(F.col("i"))).bitwiseXOR(bit(F.col("j")))
    posts = two.select("fingerprint", at.alias("at"))
    least = posts.groupBy("at").agg(F.min("fingerprint").alias("a"), F.max("fingerprint").alias("most"))
    least = least.where("a < most").select(F.col("at").alias("of"), "a")
    met = _beside(posts, "at", stored(least, "balls")).where("coalesce(a, fingerprint) < fingerprint")
    return met.select("a", F.col("fingerprint").alias("b")).distinct()


def _with_components(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, fingerprint and more) with component_id."""
    prints = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"))
    prints = stored(prints, "prints")
    roots = connected_components(stored(links(prints), "links"))
    linked = prints.join(roots, F.col("fingerprint") == F.col("node"), "left")
    linked = stored(linked.withColumn("root", F.coalesce("root", "fingerprint")).drop("node"), "roots")
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = stored(linked.join(least, "root").select(F.col("fingerprint").alias("print"), "component_id"), "named")
    return rows.join(named, F.col("fingerprint") == F.col("print")).drop("print")


def near_copies(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 lower-case hex digits), component_id.

    component_id is the smallest doc_id that links of at most four differing bits reach, null if no row of the
    component has an id. Null texts and texts without words have fingerprint zero and are linked like any
    other. Repeated rows each get a row. An empty table gives no rows. Only doc_id and text are looked at.
    """
    rows = stored(fingerprints(docs), "fingerprints")
    out = _with_components(rows)
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return out.select("doc_id", digits.alias("fingerprint"), "component_id")


#: Keys of dropped rows that may be broadcast: 141 bytes each on the driver, measured with 44,736 keys, so about 150 MB at most.
BROADCAST_KEYS = 1 << 20


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without near copies: of each component the document with the smallest doc_id stays, all
    columns as they are. Of rows that share this id one stays, the one with the smallest text hash.

    The keys of the rows that go, which are counted, are taken out of ``docs``. Up to BROADCAST_KEYS of them no text
    is shuffled. Null and empty texts have fingerprint zero, and are copies of each other. An empty table gives no
    rows. Names that begin with ``__near_`` are reserved.
    """
    rows = stored(fingerprints(docs), "fingerprints")
    found = _with_components(rows).groupBy("component_id", "doc_id", "text_key").agg(F.count("*").alias("n"))
    best = found.groupBy("component_id", "doc_id").agg(F.min("text_key").alias("best_key"))
    best = best.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("component_id").alias("of"), "best_key"
    )
    joined = found.join(best, F.col("component_id").eqNullSafe(F.col("of")), "left")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("text_key").eqNullSafe(F.col("best_key"))
    marked = joined.select(
        F.col("doc_id").alias("__near_id"), F.col("text_key").alias("__near_key"), (stays & (F.col("n") > 1)).alias("tied"),
        stays.alias("stays"),
    )
    gone = stored(marked.where("tied or not stays"), "gone")
    tied = gone.where("tied").select("__near_id", "__near_key")
    keys = gone.select("__near_id", "__near_key")
    few = gone.count() <= BROADCAST_KEYS
    same = F.col("doc_id").eqNullSafe(F.col("__near_id")) & F.xxhash64("text").eqNullSafe(F.col("__near_key"))
    alone = docs.join(F.broadcast(keys) if few else keys, same, "left_anti")
    several = docs.join(F.broadcast(tied) if few else tied, same).dropDuplicates(["__near_id", "__near_key"])
    return alone.unionByName(several.select(docs.columns))
