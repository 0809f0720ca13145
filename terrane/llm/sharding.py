"""Sharding by a hierarchical tree of weighted hash draws: region, rack, shard.

At each level a row draws ln(u) / weight for every child of the node it is at, u hashed from its id and the child's name
alone, and descends to the highest draw; so children are hit in proportion to their weights. A draw does not depend on the
other children: where a weight grows, rows only move into that subtree, where it shrinks, only out of it, and below a node
whose weights all stay, no row moves. A shard that is added as a region of its own therefore takes rows only into itself.

Slots number a shard's rows from 0 in the order of id, size and checksum. No shard is gathered: rows are sorted by ranges of
(shard, id, ..., their place in a written table), so even one id that holds a third of all rows is dealt to many tasks, and
each sorted file's run of a shard starts where the runs before it end.

Defined results: the law is ``key``, the id and the tree decide, so equal ids share a shard; rows of a null id are one key;
a null text has size 1 and checksum 0; repeated rows are rows each; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.tables import unused, written

#: Bits of a hash that make the number u.
BITS = 52
#: Runs (at most one a file and shard more than there are files) that are sent to all tasks; a shuffle join beyond it.
MOST_RUNS = 200_000


@dataclass(frozen=True)
class Leaf:
    """A shard, the rack and the region it stands in, and its weight (0: it takes no rows)."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0


@dataclass(frozen=True)
class Tree:
    """A cluster's shards. It describes machines, so it does not grow with the rows."""

    leaves: tuple[Leaf, ...]

    def __post_init__(self) -> None:
        if len({leaf.shard for leaf in self.leaves}) < len(self.leaves):
            raise ValueError("a shard stands in the tree twice")
        if any(not 0 <= leaf.weight < float("inf") for leaf in self.leaves) or not any(leaf.weight for leaf in self.leaves):
            raise ValueError("weights must be finite, not negative and not all 0")

    def children(self) -> dict[str, list[tuple[str, float, int]]]:
        """For each node its children that have a weight: name, weight, number (the shard's at the last level)."""
        found: dict[str, dict[str, list]] = {}
        for leaf in self.leaves:
            path = ["", leaf.region, f"{leaf.region}/{leaf.rack}", f"{leaf.region}/{leaf.rack}/{leaf.shard}"]
            for node, child in zip(path, path[1:], strict=False):
                entry = found.setdefault(node, {}).setdefault(child, [child, 0.0, leaf.shard])
                entry[1] += leaf.weight
        return {node: kept for node, group in found.items() if (kept := [tuple(c) for c in group.values() if c[1] > 0])}

    def grown(self, shard: int, weight: float = 1.0) -> Tree:
        """The tree with one more shard, in a region of its own: it takes rows only into itself."""
        taken = {leaf.region for leaf in self.leaves}
        region = next(str(i) for i in range(len(taken) + 1) if str(i) not in taken)
        return Tree((*self.leaves, Leaf(region, "0", shard, weight)))

    def shard_of(self, key: Column) -> Column:
        """The shard of a string key."""
        children = self.children()
        entry = lambda c: F.struct(F.lit(c[0]).alias("name"), F.lit(c[1]).alias("weight"), F.lit(c[2]).alias("shard"))
        nodes = F.create_map(*[x for node, group in children.items() for x in (F.lit(node), F.array(*[entry(c) for c in group]))])
        node = F.lit("")
        for _ in range(3):
            # The highest draw; equal ones, if two 52-bit hashes should ever agree, go to the smaller shard.
            drawn = F.transform(F.element_at(nodes, node), lambda c: F.struct(draw(key, c["name"], c["weight"]).alias("d"), (-c["shard"]).alias("s"), c["name"].alias("name")))
            best = F.array_max(drawn)
            node = best["name"]
        return (-best["s"]).cast("int")


def balanced(shards: int, rack: int = 4, region: int = 2) -> Tree:
    """Shards of weight 1, ``rack`` to a rack and ``region`` racks to a region."""
    if shards < 1:
        raise ValueError("there must be a shard")
    return Tree(tuple(Leaf(str(s // rack // region), str(s // rack % region), s) for s in range(shards)))


def draw(key: Column, name: Column, weight: Column) -> Column:
    """ln(u) / weight: the highest of several draws is a given one with a chance in proportion to its weight."""
    number = F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), name)), 1, BITS // 4), 16, 10).cast("double")
    return F.ln((number + 0.5) / float(1 << BITS)) / weight


def key_of(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def place(rows: DataFrame, tree: Tree, id_col: str = "doc_id", column: str = "shard") -> DataFrame:
    """The rows with their shard (in place of a column of that name): an expression, without a shuffle."""
    return rows.withColumn(column, tree.shard_of(key_of(id_col)))


def numbered(rows: DataFrame, group: str, order: list[str], column: str = "slot") -> DataFrame:
    """The rows with a gapless number from 0 within their group, by ``order``; equal rows in the order of a written table."""
    file, place_ = unused([*rows.columns, column], "_file"), unused([*rows.columns, column], "_place")
    kept = [F.col(f"`{c}`") for c in rows.columns if c != column]
    stored, _ = written(rows.select(*kept))
    meta = stored.metadataColumn("_metadata")
    total = [group, *order, file, place_]
    marked = stored.select(*kept, meta["file_path"].alias(file), meta["row_index"].alias(place_))
    ranged, _ = written(marked.repartitionByRange(*total).sortWithinPartitions(*total).select(*kept))
    meta = ranged.metadataColumn("_metadata")
    ranged = ranged.select(*kept, meta["file_name"].alias(file), meta["row_index"].alias(place_))
    part = lambda i: F.regexp_extract(file, r"part-(\d+)-.*?(?:-c(\d+))?\.", i).try_cast("long")
    before = Window.partitionBy(group).orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    runs = ranged.groupBy(group, file).agg(F.min(place_).alias("first"), F.count("*").alias("n")).withColumns({"part": part(1), "piece": part(2)})
    runs, _ = written(runs.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).select(F.col(group).alias("_group"), F.col(file).alias("_run"), "start"))
    few = runs.count() <= MOST_RUNS
    both = ranged.join(F.broadcast(runs) if few else runs, F.col(group).eqNullSafe(F.col("_group")) & (F.col(file) == F.col("_run")))
    return both.select(*kept, (F.col(place_) + F.col("start")).alias(column))


def shard_documents(docs: DataFrame, shards: int = 16, tree: Tree | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document: the shard by the tree (balanced if none is
    given), its row's number there, and where the row would be with one shard more."""
    tree = tree or balanced(shards)
    text = F.col(f"`{text_col}`")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    crc = F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long")
    key = key_of(id_col)
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), F.lit("key").alias("law"), tree.shard_of(key).alias("shard"), tree.grown(shards).shard_of(key).alias("grown_shard"))
    return numbered(narrow, "shard", ["doc_id", "size", "text_crc32"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(rows: DataFrame, folder: str, shard: str = "shard", slot: str = "slot") -> None:
    """Whole rows as one folder a shard, each file a run of slots in order; a large shard is written by many tasks."""
    rows.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(folder)
