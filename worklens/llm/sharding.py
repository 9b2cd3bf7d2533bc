"""Shards of near equal size by a k-d tree, in DataFrame operations only.

A row is a point: its metadata columns as whole numbers. A node of the tree that is to become k shards is cut along its widest
dimension (its extent against that of the whole table) at the weighted median: the place where floor(k / 2) / k of its bytes
are below. Rows with the same value there are ordered by the other dimensions, then by a hash of id and text, then by a row
number, so a hot value, or one row repeated a million times, is cut too and the halves differ by less than one row.

The medians of all nodes of a level are found together and distributed: each pass cuts every node's open range into
histogram cells, adds up bytes per cell where the rows are, and goes on inside the one cell that holds the median. A pass moves
at most ``CELLS`` sums and brings one row a node to the driver. Texts are read once, for their size and CRC; after that
only the narrow points are read.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from worklens.llm.common import fresh
from worklens.sources.staging import settle

SHARDS = 16
DIMENSIONS = ("lang", "source", "n_chars")
#: Histogram cells of one pass, shared by the nodes of a level.
CELLS = 1 << 16
#: Rows numbered together in one task, about.
SLOT_ROWS = 50_000
#: Levels of the tree that a row passes between two stage tables.
LEVELS = 4

_MOST = (1 << 63) - 1


@dataclass
class Node:
    """An open node: k shards from ``first`` on. ``prefix``: settled parts of the cut, the open part lies in lo..hi."""

    node: int
    first: int
    k: int
    dim: int = 0
    target: int = 0
    before: int = 0
    prefix: list[int] = field(default_factory=list)
    lo: int = 0
    hi: int = 0
    cut: list[int] | None = None


def _coordinate(docs: DataFrame, name: str) -> Column:
    """A column as a whole number from 0 to 2^62. Numbers keep their order on a logarithmic scale; null and NaN come lowest;
    other values are hashed, so that equal ones share a place."""
    column, kind = F.col(f"`{name}`"), docs.schema[name].dataType
    if not isinstance(kind, NumericType):
        text = column if isinstance(kind, StringType) else column.cast("string")
        return F.shiftrightunsigned(F.xxhash64(text), 2)
    x = F.nanvl(column.cast("double"), F.lit(None).cast("double"))
    size = F.least(F.log2(F.abs(x) + 1), F.lit(1024.0)) * float(1 << 40)
    return F.coalesce((F.signum(x) * size).cast("long") + F.lit((1 << 50) + 1), F.lit(0))


def points(docs: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """The documents with three more columns: size, text_crc32 and ``at``: coordinates, a hash of id and text, a row number."""
    text = F.col("text").cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
    dims = [_coordinate(docs, d) for d in dimensions]
    at = F.array(*dims, F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), crc, size), 2), F.monotonically_increasing_id())
    names = fresh(docs, "size", "text_crc32", "at")
    return docs.select("*", *[c.alias(n) for n, c in zip(names, (size, crc, at))])


def _local(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of a few rows, bounded by the number of shards."""
    return F.broadcast(spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>"))))


def _step(rows: DataFrame, cuts: list[Node]) -> DataFrame:
    """Rows moved from cut nodes to their halves; others stay."""
    table = [{"node": n.node, "c_dim": n.dim, "c_first": n.cut[0], "c_rest": n.cut[1:]} for n in cuts]
    splits = _local(rows.sparkSession, table, "node long, c_dim int, c_first long, c_rest array<long>")
    own = F.get("at", F.col("c_dim"))
    left = (own < F.col("c_first")) | ((own == F.col("c_first")) & (F.col("at") <= F.col("c_rest")))
    node = F.when(F.col("c_dim").isNull(), F.col("node")).when(left, F.col("node") * 2).otherwise(F.col("node") * 2 + 1)
    return rows.join(splits, "node", "left").withColumn("node", node).drop("c_dim", "c_first", "c_rest")


def _narrow(rows: DataFrame, nodes: list[Node], width: int) -> list[Node]:
    """One pass: every node's open range shrinks to the cell that holds its median, or its cut is found. Gives those still open."""
    cells = max(2, CELLS // len(nodes))
    table = [{"node": n.node, "dim": n.dim, "prefix": n.prefix, "depth": len(n.prefix), "lo": n.lo, "hi": n.hi, "target": n.target, "before": n.before} for n in nodes]
    state = _local(rows.sparkSession, table, "node long, dim int, prefix array<long>, depth int, lo long, hi long, target long, before long")
    own, depth = F.get("at", F.col("dim")), F.col("depth")
    part = F.when(depth == 0, own).otherwise(F.get("at", depth - 1))
    after = F.get("at", depth)  # the part behind, of which the range is needed next
    settled = (depth == 0) | ((own == F.get("prefix", F.lit(0))) & (F.slice("at", 1, depth - 1) == F.slice("prefix", 2, depth - 1)))
    open_ = rows.join(state, "node").where(settled & part.between(F.col("lo"), F.col("hi")))
    share = (part - F.col("lo")).cast("double") / (F.col("hi") - F.col("lo") + 1).cast("double")
    open_ = open_.select("node", "target", "before", "size", part.alias("part"), after.alias("after"), F.floor(share * cells).alias("cell"))
    sums = open_.groupBy("node", "target", "before", "cell").agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("part").alias("lo"), F.max("part").alias("hi"), F.min("after").alias("a_lo"), F.max("after").alias("a_hi")
    )
    upto = F.sum("bytes").over(Window.partitionBy("node").orderBy("cell")) + F.col("before")
    sums = sums.withColumn("upto", upto).withColumn("under", F.col("upto") - F.col("bytes"))
    median = {r["node"]: r for r in sums.where("under < target AND target <= upto").collect()}  # one row a node
    rest = []
    for n in nodes:
        r = median[n.node]
        single = r["lo"] == r["hi"]
        last = r["n"] == 1 or (single and len(n.prefix) == width)
        if r["upto"] == n.target or last:
            with_it = r["upto"] - n.target <= n.target - r["under"]
            parts = [*n.prefix, r["hi"] if with_it else r["lo"] - 1]
            n.cut = parts + [_MOST] * (width + 1 - len(parts))
            continue
        n.before = r["under"]
        if single:
            n.prefix, n.lo, n.hi = [*n.prefix, r["lo"]], r["a_lo"], r["a_hi"]
        else:
            n.lo, n.hi = r["lo"], r["hi"]
        rest.append(n)
    return rest


def _extents(rows: DataFrame, dims: int) -> dict[int, tuple]:
    """Per node: bytes, rows, and the lowest and highest coordinate in each dimension and in the hash behind them."""
    ends = [f(F.get("at", F.lit(i))).alias(f"{f.__name__}{i}") for i in range(dims + 1) for f in (F.min, F.max)]
    out = rows.groupBy("node").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), *ends).collect()  # one row a node
    return {r["node"]: (r["bytes"], r["n"], [(r[f"min{i}"], r[f"max{i}"]) for i in range(dims + 1)]) for r in out}


def grow(rows: DataFrame, shards: int, dims: int) -> tuple[DataFrame, list[list[Node]], dict[int, int]]:
    """The tree over points (size, at): the rows with their ``node``, the cut nodes level by level, and node to shard.

    The driver holds the tree, at most ``shards`` nodes; a shard may stay empty if there are fewer rows.
    """
    rows = rows.withColumn("node", F.lit(1).cast("long"))
    width = dims + 2
    open_, levels, shard = [Node(1, 0, shards)], [], {}
    scale: list[float] = []
    while open_:
        boxes = _extents(rows, dims)
        todo = []
        for n in open_:
            size, count, ends = boxes.get(n.node, (0, 0, []))
            if n.k == 1 or count == 0:
                shard[n.node] = n.first
                continue
            scale = scale or [max(1.0, float(hi - lo)) for lo, hi in ends]
            widths = [(hi - lo) / s for (lo, hi), s in zip(ends, scale)]
            widest = max(range(dims), key=lambda i: (widths[i], -i), default=dims)
            n.dim = widest if dims and widths[widest] > 0 else dims  # one point only: by the hash
            n.target, (n.lo, n.hi) = max(1, size * (n.k // 2) // n.k), ends[n.dim]
            todo.append(n)
        work = list(todo)
        while work:
            work = _narrow(rows, work, width)
        if todo:
            rows = _step(rows, todo)
            levels.append(todo)
            if len(levels) % LEVELS == 0 and any(n.k > 3 for n in todo):
                rows = settle(rows, "shard-nodes")
        open_ = [half for n in todo for half in (Node(2 * n.node, n.first, n.k // 2), Node(2 * n.node + 1, n.first + n.k // 2, n.k - n.k // 2))]
    return rows, levels, shard


def _shard_of(rows: DataFrame, shard: dict[int, int]) -> DataFrame:
    table = [{"node": n, "shard": s} for n, s in shard.items()]
    return rows.join(_local(rows.sparkSession, table, "node long, shard int"), "node").drop("node")


def assignments(docs: DataFrame, shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot.

    ``size`` is the text's UTF-8 bytes plus 1, a null text counts as empty. Shards have near equal sizes: each cut of the tree
    is off by less than one row. Slots of a shard run from 0 without a gap, in hashed order. Null ids and null metadata are
    values like any other; equal rows, even the same row many times, are divided like different ones; an empty table gives no
    rows; a shard is empty only if rows are fewer than shards or single texts are larger than a shard. Other columns, also
    of the names used here, are ignored.
    """
    named = points(docs.select("doc_id", "text", *[F.col(f"`{d}`").alias(f"d{i}") for i, d in enumerate(dimensions)]), tuple(f"d{i}" for i in range(len(dimensions))))
    rows = settle(named.select("doc_id", "size", "text_crc32", "at"), "points")
    placed, _, shard = grow(rows, shards, len(dimensions))
    placed = _shard_of(placed, shard) if shard else placed.withColumn("shard", F.lit(0)).drop("node")
    number = F.element_at("at", -1)
    spread = F.xxhash64("doc_id", "text_crc32", number)
    parts = -(-rows.count() // SLOT_ROWS) or 1
    placed = placed.select("doc_id", "size", "text_crc32", "shard", spread.alias("spread"), number.alias("number"), F.pmod(spread, F.lit(parts)).alias("part"))
    placed = settle(placed, "sharded")
    counts = placed.groupBy("shard", "part").count()
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("spread", "number")) - 1
    out = placed.withColumn("place", place).join(offsets, ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("place")).alias("slot"))


def with_shard(docs: DataFrame, shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS, column: str = "shard") -> DataFrame:
    """The documents, all columns, and the shard of each. Whole texts don't move: the tree is applied where they are read."""
    names = fresh(docs, "size", "text_crc32", "at", "node")
    rows = points(docs, dimensions)
    narrow = settle(rows.select(F.col(names[0]).alias("size"), F.col(names[2]).alias("at")), "points")
    _, levels, shard = grow(narrow, shards, len(dimensions))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    placed = rows.select(whole, F.col(names[2]).alias("at"), F.lit(1).cast("long").alias("node"))
    for cuts in levels:
        placed = _step(placed, cuts)
    placed = _shard_of(placed, shard) if shard else placed.withColumn("shard", F.lit(0))
    return placed.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns], F.col("shard").alias(column))


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS) -> None:
    """One subfolder of Parquet files a shard."""
    (own,) = fresh(docs, "shard")
    with_shard(docs, shards, dimensions, own).write.partitionBy(own).parquet(folder)


def shards_for(docs: DataFrame, target_bytes: int) -> int:
    """How many shards make leaves of at most about the target."""
    total = docs.agg(F.sum(F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long") + 1)).first()[0] or 0
    return max(1, -(-total // target_bytes))
