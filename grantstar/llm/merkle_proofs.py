"""A Merkle manifest of a dataset, and a proof for each row, by pointer jumping.

Leaves are numbered inside their group over range partitions, so a group of any size is spread over all tasks. The tree
is built four levels a shuffle. Every node then holds the siblings on the way to its parent and a pointer to
that parent; in each round it takes over its target's siblings and pointer, so the distance doubles until every
leaf points at the root.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantstar.llm.common import stored

#: Nodes that become one, and levels built in one shuffle.
FAN, LEVELS = 3, 4
#: Ancestors are broadcast up to this size, which follows from their number; beyond it they are joined by shuffle.
BROADCAST_BYTES = 4 << 20

#: Number of the tree over the subroots, and of the tree that finished pointers name.
TOP, DONE = -1, -2


def _empty() -> Column:
    return F.lit(b"")


def _hash(digests: Column) -> Column:
    """The digest (32 bytes) of the lowercase hex texts of some digests, one after the other."""
    return F.unhex(F.sha2(F.lower(F.hex(digests)), 256))


def leaf_digest(columns: Sequence[Column]) -> Column:
    """The digest of a row: each value as its number of UTF-8 bytes, a colon and itself; null as ``-``."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def folded(leaf: Column, path: Column) -> Column:
    """The digest at the end of a path, from a leaf and its siblings."""
    return F.aggregate(path, leaf, lambda at, step: _hash(F.concat(step["left"], at, step["right"])))


def path_digest(path: Column) -> Column:
    """sha256 in hex over the hex texts of all siblings of a path, left to right."""
    sides = F.transform(path, lambda step: F.concat(step["left"], step["right"]))
    return F.sha2(F.lower(F.hex(F.aggregate(sides, _empty(), lambda a, b: F.concat(a, b)))), 256)


@dataclass(frozen=True)
class Numbered:
    """``rows``: the leaves with tree, index and height; ``trees``: tree and height of each group."""

    rows: DataFrame
    trees: DataFrame


def _height(n: Column) -> Column:
    """Levels above ``n`` leaves."""
    return F.size(F.filter(F.array(*(F.lit(FAN**k) for k in range(39))), lambda x: x < n))


def numbered(leaves: DataFrame) -> Numbered:
    """Numbers trees by group and leaves inside their group by key, then digest.

    Rows are dealt out by range of group, key and digest, so what follows needs one row for each partition and
    group only. Rows that agree in all three are spread, too: any order of them gives the same tree.
    """
    order = ["group", "key", "leaf", "tie"]
    spread = leaves.withColumn("tie", F.monotonically_increasing_id())
    ordered = spread.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    rows = stored(ordered.withColumn("place", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("place", 33)
    held = rows.groupBy("group", part.alias("part")).agg(F.min("place").alias("first"), F.count("*").alias("n"))
    held = stored(held, "held")
    groups = held.groupBy("group").agg(F.sum("n").alias("n"), F.min("first").alias("at"))
    begins = groups.withColumn("part", F.shiftright("at", 33))
    # Trees by partition of their first leaf: two windows that hold a partition's groups, or the partitions.
    parts = begins.groupBy("part").agg(F.count("*").alias("trees"))
    parts = parts.select(
        F.col("part").alias("of"), F.expr("sum(trees) over (order by part) - trees").alias("earlier")
    )
    begins = begins.withColumn("turn", F.expr("row_number() over (partition by part order by at) - 1"))
    trees = begins.join(parts, F.col("part") == F.col("of")).select(
        "group", (F.col("earlier") + F.col("turn")).alias("tree"), _height(F.col("n")).alias("height")
    )
    trees = stored(trees, "trees")
    offset = F.expr("sum(n) over (partition by group order by part) - n - first").alias("offset")
    own = held.select(F.col("group").alias("g"), F.col("part").alias("of"), offset)
    own = own.join(trees, F.col("g").eqNullSafe(F.col("group"))).drop("group")
    same = (F.col("of") == part) & F.col("g").eqNullSafe(F.col("group"))
    rows = rows.join(own, same).withColumn("index", F.col("place") + F.col("offset"))
    return Numbered(rows.drop("place", "of", "g", "offset", "key", "group"), trees)


def _level_up(digests: str) -> Column:
    """The next level of a list of digests."""
    at = lambda j: F.get(digests, j)
    runs = F.sequence(F.lit(0), F.floor((F.size(digests) - 1) / FAN).cast("int"))
    rest = lambda j: F.coalesce(at(j), _empty())
    return F.transform(runs, lambda j: _hash(F.concat(at(FAN * j), *(rest(FAN * j + k) for k in range(1, FAN)))))


def _entries(digests: str, level: int, first: Column, extra: Callable[[Column], Column]) -> Column:
    """An entry for each node of a level: where it is, and its siblings to the left and right."""

    def entry(j):
        at = lambda k: F.coalesce(F.get(digests, k), _empty())
        left = [F.when(j % FAN >= k, at(j - k)).otherwise(_empty()) for k in range(FAN - 1, 0, -1)]
        right = [F.when(j % FAN + k < FAN, at(j + k)).otherwise(_empty()) for k in range(1, FAN)]
        step = F.struct(F.concat(*left).alias("left"), F.concat(*right).alias("right"))
        place = F.lit(level).alias("level"), (first + j).alias("index")
        return F.struct(*place, step.alias("step"), extra(j).alias("extra"))

    return F.transform(F.sequence(F.lit(0), F.size(digests) - 1), entry)


def _levels(nodes: DataFrame, base: int) -> DataFrame:
    """One row for each run of FAN**LEVELS nodes of a level: tree, chunk, height, the entries of all nodes
    below its end, and ``up``, the digest there. nodes: tree, height, index, leaf, extra."""
    chunk = F.expr(f"index div {FAN**LEVELS}")
    none = F.lit(None).cast(nodes.schema["extra"].dataType)
    held = F.struct("index", "leaf", "extra")
    df = nodes.groupBy("tree", "height", chunk.alias("chunk")).agg(F.array_sort(F.collect_list(held)).alias("run"))
    df = df.select("*", F.col("run.leaf").alias("d0"), F.col("run.extra").alias("extras"))
    entries, up = [], F.col("d0")
    for k in range(LEVELS):
        inside = F.col("height") > base + k
        df = df.withColumn(f"d{k + 1}", F.when(inside, _level_up(f"d{k}")))
        first = F.col("chunk") * FAN ** (LEVELS - k)
        own = (lambda j: none) if base or k else (lambda j: F.get("extras", j))
        entries.append(F.when(inside, _entries(f"d{k}", base + k, first, own)))
        up = F.when(inside, F.col(f"d{k + 1}")).otherwise(up)
    every = F.flatten(F.array_compact(F.array(*entries)))
    return df.select("tree", "height", "chunk", every.alias("entries"), F.get(up, 0).alias("up"))


def _tree(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All entries (tree, height, level, index, step, extra) and the subroots (tree, height, up) of all trees. The
    driver counts levels only."""
    tallest = leaves.agg(F.max("height")).first()[0]
    done, nodes, base = [], leaves, 0
    while True:
        held = stored(_levels(nodes, base), f"levels{base}")
        done.append(held)
        base += LEVELS
        if tallest is None or tallest <= base:
            break
        none = F.lit(None).cast(leaves.schema["extra"].dataType).alias("extra")
        higher = held.where(F.col("height") > base)
        nodes = higher.select("tree", "height", F.col("chunk").alias("index"), F.col("up").alias("leaf"), none)
    entries, subroots = None, None
    for k, held in enumerate(done):
        own = held.select("tree", "height", F.explode("entries").alias("e")).select("tree", "height", "e.*")
        top = held.where(F.col("height") <= (k + 1) * LEVELS).select("tree", "height", "up")
        entries = own if entries is None else entries.unionByName(own)
        subroots = top if subroots is None else subroots.unionByName(top)
    return entries, subroots


def _spread() -> list[Column]:
    """The pointer of a finished path. It meets no node, and no two rows need to meet for it."""
    return [F.lit(DONE).cast("long"), F.lit(0), F.xxhash64("tree", "level", "index")]


def _jump(paths: DataFrame, ancestors: DataFrame, rows: int, distance: int) -> DataFrame:
    """One round: the paths of some nodes, each prolonged by the path of the node it points at."""
    names = {n: f"a_{n}" for n in ("tree", "level", "index", "to_tree", "to_level", "to_index", "path")}
    own = ancestors.select(*(F.col(n).alias(a) for n, a in names.items()))
    if rows * (80 * distance + 100) <= BROADCAST_BYTES:
        own = F.broadcast(own)
    same = [F.col(f"to_{n}") == F.col(f"a_{n}") for n in ("tree", "level", "index")]
    joined = paths.join(own, same[0] & same[1] & same[2], "left")
    finished = F.col("a_to_tree") == DONE
    to = [
        F.when(finished, free).otherwise(F.coalesce(f"a_to_{n}", f"to_{n}")).alias(f"to_{n}")
        for n, free in zip(("tree", "level", "index"), _spread())
    ]
    grown = F.when(F.col("a_path").isNull(), F.col("path")).otherwise(F.concat("path", "a_path")).alias("path")
    return joined.select("tree", "level", "index", *to, grown, "extra")


@dataclass(frozen=True)
class Manifest:
    """``proofs``: a row for each leaf with extra, path (left and right siblings of each step) and subroot;
    ``root``: the digest over all, None for an empty dataset."""

    proofs: DataFrame
    root: bytes | None


def manifest(leaves: DataFrame) -> Manifest:
    """The trees over ``leaves`` (group, key, leaf, extra) and a proof for each.

    Inside a group leaves ascend by key (null first, ties by digest); while there are several nodes, every three
    consecutive ones become their hash, also where fewer are left at the end. The subroots of the groups, by
    group (null first), become the root in the same way. ``extra`` is handed through. Repeated
    rows are leaves of their own. No rows give no proofs and no root.
    """
    held = numbered(leaves)
    entries, subroots = _tree(held.rows)
    subroots = stored(subroots, "subroots")
    count = subroots.count()
    own = F.struct(F.col("tree"), F.col("height").alias("h"))
    tops = subroots.select(
        F.lit(TOP).cast("long").alias("tree"), _height(F.lit(count)).alias("height"), F.col("tree").alias("index"),
        F.col("up").alias("leaf"), own.alias("extra"),
    )
    above, last = _tree(tops)
    above_height = next(h for h in range(64) if FAN**h >= count)
    root = last.first()
    up_level, up_index = F.col("level") + 1, F.expr(f"index div {FAN}")
    kind = held.rows.schema["extra"].dataType

    def pointing(df: DataFrame, at: list[Column], ends: Column, extra: Column) -> DataFrame:
        to = [F.when(ends, free).otherwise(p) for p, free in zip((F.col("tree"), up_level, up_index), _spread())]
        to = [c.alias(f"to_{n}") for n, c in zip(("tree", "level", "index"), to)]
        return df.select(*at, *to, F.array("step").alias("path"), extra.alias("extra"))

    place = [F.col(n) for n in ("tree", "level", "index")]
    # A subroot goes by its place in its own tree and points into the tree above.
    sub = [
        F.when(F.col("level") == 0, a).otherwise(b).alias(n)
        for n, a, b in zip(
            ("tree", "level", "index"), (F.col("extra.tree"), F.col("extra.h"), F.lit(0).cast("long")), place
        )
    ]
    upper = pointing(above, sub, up_level == above_height, F.lit(None).cast(kind))
    lower = pointing(entries, place, (F.lit(count) == 1) & (up_level == F.col("height")), F.col("extra"))
    inner = stored(lower.unionByName(upper).where("level > 0"), "pointers0")
    paths = lower.where("level = 0")
    single = held.rows.where("height = 0").select("tree", F.lit(0).alias("level"), "index", "extra")
    if not single.isEmpty():
        # The leaf of a group of one row is its subroot: it begins with the entry of that one.
        ends = upper.where("level = 0").select(F.col("tree").alias("t"), "to_tree", "to_level", "to_index", "path")
        joined = single.join(ends, F.col("tree") == F.col("t"), "left")
        to = [F.coalesce(f"to_{n}", x).alias(f"to_{n}") for n, x in zip(("tree", "level", "index"), _spread())]
        path = F.coalesce("path", F.array().cast(paths.schema["path"].dataType)).alias("path")
        paths = paths.unionByName(joined.select("tree", "level", "index", *to, path, "extra"))
    depth, distance = (held.trees.agg(F.max("height")).first()[0] or 0) + above_height, 1
    while distance < depth:
        inner_rows = inner.count()
        paths = _jump(paths, inner, inner_rows, distance)
        distance *= 2
        if distance < depth:
            needed = (F.col("level") % distance == 0) | (F.col("tree") == TOP)
            inner = stored(_jump(inner.where(needed), inner, inner_rows, distance // 2), f"pointers{distance}")
    ups = subroots.select(F.col("tree").alias("t"), F.col("up").alias("subroot"))
    proofs = paths.join(ups, F.col("tree") == F.col("t")).select("extra", "path", "subroot")
    return Manifest(proofs, bytes(root["up"]) if root else None)


def _row_digest(text: Column) -> Column:
    return leaf_digest([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text])


def verified_manifest(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves are rows of documents, grouped by source and ordered by doc_id. To try the proofs, line ends are deleted
    from the texts whose crc32 of the decimal doc_id is even (null texts and rows without an id stay): the
    changed leaf is folded with the original proof. Empty texts are values, not nulls; texts of any length are
    hashed in one go. Other columns than those of documents are not looked at. An empty table gives no rows.
    """
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.col("text")
    leaf = _row_digest(text)
    tampered = F.when(changed & text.contains("\n"), _row_digest(F.replace(text, F.lit("\n"), F.lit(""))))
    leaves = docs.select(
        F.col("source").alias("group"), F.col("doc_id").alias("key"), leaf.alias("leaf"), tampered.alias("tampered")
    )
    extra = F.struct(F.col("key").alias("doc_id"), "leaf", "tampered").alias("extra")
    found = manifest(leaves.select("group", "key", "leaf", extra))
    proofs = found.proofs.select("extra.*", "path", "subroot")
    proofs = proofs.withColumn("folded", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    hexed = lambda c: F.lower(F.hex(c))
    root = F.lit(found.root).cast("binary")
    return proofs.select(
        "doc_id",
        hexed("leaf").alias("leaf"),
        hexed("subroot").alias("subroot"),
        hexed(root).alias("root"),
        path_digest(F.col("path")).alias("proof_sha256"),
        hexed("folded").alias("folded_root"),
        (F.col("folded") == root).alias("verified"),
    )
