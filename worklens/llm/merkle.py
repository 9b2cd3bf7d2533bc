"""Merkle manifest of a dataset by time-forward processing.

A tree node is labelled (level, number). Nodes are handled in the order of their labels; a node sends its digest as a message
to its parent's label, and a priority queue ordered by label holds the messages until the parent's turn comes. Then the sweep
runs backwards, from the root: a node that knows its proof (the siblings on its way to the root) sends each child the other
child's digest followed by its own proof, and so proof suffixes reach the leaves.

The queue is external: trees are cut into blocks of ``BLOCK_LEVELS`` levels, a task keeps the queue of one block, at
most 2 ** BLOCK_LEVELS messages, in a heap, and messages that leave a block go through an exchange sorted by label, which
spills to disk where it must. A tree of n leaves takes log(n) / BLOCK_LEVELS exchanges each way, and the driver sees numbers
of levels only.

One tree per group over its leaves in order, and one tree over the groups' roots. While more than one node remains, every two
consecutive ones, or a last one alone, become the hash of their digests.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce
from hashlib import sha256
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worklens.llm.common import fresh, whole_groups
from worklens.sources.staging import settle

BLOCK_LEVELS = 12


def _height(n: int) -> int:
    return (n - 1).bit_length()


def forward(base: int, top: int, nodes: list[tuple[int, bytes]]) -> dict[tuple[int, int], bytes]:
    """Digests by label of a block's nodes, from ``nodes`` (number, digest) at level ``base`` up to level ``top``."""
    known = {(base, i): d for i, d in nodes}
    if base == top:
        return known
    queue = [(base + 1, i >> 1, i & 1, d) for i, d in nodes]  # to the parent, by its label
    heapq.heapify(queue)
    while queue:
        level, i, _, digest = heapq.heappop(queue)
        if queue and queue[0][:2] == (level, i):
            digest += heapq.heappop(queue)[3]
        digest = sha256(digest).hexdigest().encode()
        known[level, i] = digest
        if level < top:
            heapq.heappush(queue, (level + 1, i >> 1, i & 1, digest))
    return known


def backward(base: int, top: int, known: dict[tuple[int, int], bytes], sides: str, proof: bytes) -> dict[int, tuple[str, bytes]]:
    """Proofs of the nodes at level ``base`` by number, from the proof of the one node at level ``top``."""
    out, queue = {}, [(-level, i, sides, proof) for level, i in known if level == top]
    while queue:
        level, i, sides, proof = heapq.heappop(queue)
        level = -level
        if level == base:
            out[i] = sides, proof
            continue
        left, right = known[level - 1, 2 * i], known.get((level - 1, 2 * i + 1))
        if right is None:
            heapq.heappush(queue, (1 - level, 2 * i, "-" + sides, proof))
        else:
            heapq.heappush(queue, (1 - level, 2 * i, "R" + sides, right + proof))
            heapq.heappush(queue, (1 - level, 2 * i + 1, "L" + sides, left + proof))
    return out


def fold(leaf: str, sides: str, proof: str) -> str:
    """The root that a leaf's digest and its siblings give. ``sides``: per level, where the sibling stands, - for none."""
    digest, rest, at = leaf.encode(), proof.encode(), 0
    for side in sides:
        if side != "-":
            sibling, at = rest[at : at + 64], at + 64
            digest = digest + sibling if side == "R" else sibling + digest
        digest = sha256(digest).hexdigest().encode()
    return digest.decode()


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The rows with ``pos``, their place in their group from 0, and ``n``, the group's size; groups are numbered in ``tree``.

    Rows are dealt by ranges of (group, order, row number), so a large group, or one row repeated, goes to many tasks; a task
    counts its own rows, and offsets come from the counts per task and group.
    """
    part, place, tree, n, pos, number = fresh(rows, "part", "place", "tree", "n", "pos", "number")
    rows = rows.withColumn(number, F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(group, *order, number).sortWithinPartitions(group, *order, number).drop(number)
    schema = dealt.withColumns({part: F.lit(0), place: F.lit(0).cast("long")}).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me, last, seen = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            places = []
            for key in batch.column(group).to_pylist():
                seen = seen + 1 if key == last else 0
                last = key
                places.append(seen)
            columns = [*batch.columns, pa.array([me] * len(places), pa.int32()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, part, place])

    dealt = settle(dealt.mapInArrow(count, schema), "numbered")
    counts = dealt.groupBy(group, part).agg(F.count(F.lit(1)).alias(n))  # at most tasks + groups rows
    earlier = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(group).alias("o_group"), F.col(part).alias("o_part"), F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias("o_offset"), F.sum(n).over(Window.partitionBy(group)).alias(n)
    )
    offsets = settle(offsets, "offsets")
    found = dealt.join(offsets, dealt[group].eqNullSafe(offsets["o_group"]) & (dealt[part] == offsets["o_part"]))
    return found.withColumn(pos, F.col("o_offset") + F.col(place)).drop("o_group", "o_part", "o_offset", part, place)


_NODE = "tree long, n long, pos long, digest string"


def _climb(nodes: DataFrame, base: int, step: int) -> DataFrame:
    """The roots of the blocks over nodes (tree, n, pos, digest) at level ``base``; ``pos`` counts within the tree's level."""

    def up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, ["tree", "block"]):
            out = []
            for (tree, n, _), rows in groupby(zip(frame["tree"], frame["n"], frame["block"], frame["pos"], frame["digest"]), key=lambda r: r[:3]):
                top = min(_height(n), base + step)
                known = forward(base, top, [(r[3], r[4].encode()) for r in rows])
                out += [(tree, n, i, d.decode()) for (level, i), d in known.items() if level == top]
            yield pd.DataFrame(out, columns=["tree", "n", "pos", "digest"])

    rows = nodes.select("tree", "n", F.shiftright("pos", step).alias("block"), "pos", "digest")
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos").mapInPandas(up, _NODE)


_PROOF = "tree long, pos long, digest string, sides string, proof string, subroot string, root string"


def _descend(nodes: DataFrame, messages: DataFrame, base: int, step: int) -> DataFrame:
    """Proofs of the nodes at level ``base`` from those of their blocks' roots. ``messages``: tree, pos (the block), sides,
    proof, subroot, root."""
    none = F.lit(None).cast("string")
    rows = nodes.select("tree", "n", "pos", F.shiftright("pos", step).alias("block"), "digest", none.alias("sides"), none.alias("proof"), none.alias("subroot"), none.alias("root"))
    sent = messages.select("tree", F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("pos"), F.col("pos").alias("block"), none.alias("digest"), "sides", "proof", "subroot", "root")
    rows = rows.unionByName(sent).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")

    def down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, ["tree", "block"]):
            columns = [frame[c] for c in ("tree", "block", "n", "pos", "digest", "sides", "proof", "subroot", "root")]
            for (tree, _), rows in groupby(zip(*columns), key=lambda r: r[:2]):
                message, *block = rows  # the message has the lowest place
                top = min(_height(block[0][2]), base + step)
                known = forward(base, top, [(r[3], r[4].encode()) for r in block])
                proofs = backward(base, top, known, message[5], message[6].encode())
                out = [(tree, r[3], r[4], proofs[r[3]][0], proofs[r[3]][1].decode(), message[7], message[8]) for r in block]
                yield pd.DataFrame(out, columns=["tree", "pos", "digest", "sides", "proof", "subroot", "root"])

    return rows.mapInPandas(down, _PROOF)


def _height_of(n: str) -> Column:
    return F.when(F.col(n) > 1, F.length(F.bin(F.col(n) - 1))).otherwise(0)


def _levels(nodes: DataFrame, step: int) -> list[DataFrame]:
    """Nodes at levels 0, step, 2 * step and so on, and at last every tree's root."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, roots, base = [nodes], [], 0
    while True:
        above = settle(_climb(levels[-1], base, step), "tree-level")
        base += step
        roots.append(above.where(_height_of("n") <= base))
        if _height(max(1, most)) <= base:
            return [*levels, reduce(DataFrame.unionByName, roots)]
        levels.append(above.where(_height_of("n") > base))


def _deliver(levels: list[DataFrame], sent: DataFrame, step: int) -> DataFrame:
    """Proofs of the nodes at level 0. ``sent``: tree, sides, proof, subroot, root of every tree's root."""
    inner = None
    for r in range(len(levels) - 2, -1, -1):
        here = levels[r].select("tree").distinct() if r else None
        ends = levels[r + 1].select("tree").distinct() if r + 2 < len(levels) else None
        # Trees that end in this round get their message from above all trees, others from the round before.
        first = sent if ends is None else sent.join(ends, "tree", "left_anti")
        first = (first if here is None else first.join(here, "tree", "left_semi")).withColumn("pos", F.lit(0).cast("long"))
        messages = first if inner is None else first.unionByName(inner.select(*first.columns))
        inner = _descend(levels[r], messages, r * step, step)
        if r:
            inner = settle(inner, "proofs")
    return inner


def manifest(leaves: DataFrame, group: str, order: list[str], block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """The leaves with their proofs.

    ``leaves`` has a ``leaf`` digest (hex), the column ``group``, and the columns ``order``; one tree per group with its leaves by
    ``order`` and then by digest, one tree over the groups' roots, null group first, strings bytewise. Adds subroot,
    root, ``proof`` (siblings' digests up to the root, left to right) and ``sides`` (for each level where the sibling stands, L or R,
    or - if there is none). Rows that are equal get equal digests and places of their own. No rows give no rows.
    """
    rows = numbered(leaves, group, [*order, "leaf"])
    groups = settle(numbered(rows.select(group, F.col("n").alias("size")).distinct().withColumn("all", F.lit(0)), "all", [group]), "groups")
    trees = groups.select(F.col(group).alias("t_group"), F.col("pos").alias("tree"))
    rows = rows.join(trees, rows[group].eqNullSafe(trees["t_group"])).drop("t_group")
    rows = settle(rows, "leaves")
    levels = _levels(rows.select("tree", "n", "pos", F.col("leaf").alias("digest")), block_levels)
    count = groups.count()
    over = levels[-1].select(F.lit(0).cast("long").alias("tree"), F.lit(count).cast("long").alias("n"), F.col("tree").alias("pos"), "digest")
    upper = _levels(over, block_levels)
    none = F.lit("")
    start = upper[-1].select("tree", none.alias("sides"), none.alias("proof"), none.alias("subroot"), F.col("digest").alias("root"))
    tops = _deliver(upper, start, block_levels).select(F.col("pos").alias("tree"), "sides", "proof", F.col("digest").alias("subroot"), "root")
    proofs = _deliver(levels, settle(tops, "group-proofs"), block_levels).select("tree", "pos", "sides", "proof", "subroot", "root")
    return rows.join(proofs, ["tree", "pos"]).drop("tree", "pos", "n")


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(fields: tuple[str, ...] = FIELDS, **changed: Column) -> Column:
    """SHA-256 over the fields, each - if null, else its length in bytes, a colon and its value."""
    return F.sha2(F.concat(*[_field(changed.get(f, F.col(f"`{f}`"))) for f in fields]), 256)


def document_manifest(docs: DataFrame, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof, sides, and ``tampered``, the leaf digest after one
    was added to n_chars where 7 divides the CRC-32 of the id, else null.

    One tree per lang, null first, its leaves by doc_id (null first) and then by digest. Null fields have a form of their own, so a null and
    an empty text differ. Rows without an id aren't tampered with; a null n_chars stays null. Repeated rows each are a leaf.
    Other columns are ignored; an empty table gives no rows.
    """
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = F.col("n_chars").cast("decimal(38,0)") + 1
    leaves = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), leaf_digest().alias("leaf"), F.when(hit, leaf_digest(n_chars=more)).alias("tampered"))
    return manifest(settle(leaves, "leaf-digests"), "lang", ["doc_id"], block_levels).drop("lang")


def verified(manifest: DataFrame) -> DataFrame:
    """The manifest with the root that each leaf, tampered with or not, gives with its proof, and whether it is the root."""

    @F.pandas_udf("string")
    def folded(leaf: pd.Series, sides: pd.Series, proof: pd.Series) -> pd.Series:
        return pd.Series([fold(*r) for r in zip(leaf, sides, proof)], dtype=object)

    root = folded(F.coalesce("tampered", "leaf"), F.col("sides"), F.col("proof"))
    return manifest.withColumn("folded_root", root).withColumn("verified", F.col("folded_root") == F.col("root"))
