"""Exact cosine matching of term vectors by cells with impact bounds, without comparing all pairs of a group.

The base vectors of a block are dealt into cells of about ``CELL`` vectors whose heaviest terms are alike; a cell that
is a whole block is the usual case. A cell is an inverted index, and the largest weight of each of its terms bounds what it
can give a probe: the sum over the probe's terms of weight times largest weight. A probe is sent to the cell with the highest bound
first (one of the base itself to its own), which gives it a floor, its k-th best score so far, and then to those cells only whose
bound reaches the floor. Bounds are taken against a table of the cells' largest weights, so no probe's terms are joined to cells.

Inside a cell a probe goes through its terms from rare to frequent. Once what the remaining terms can add, the smaller of
their bound and of the norm of the probe's rest, stays below the floor, no new match can come up: only matches found so far that
can still reach the floor, by the norm of their own rest as well, are completed, from their own terms. With a fixed floor, a threshold, this is a join by
rare leading terms; with a floor of 0 all terms are added up. Terms that many vectors of a cell have are kept as columns as
well, so that they are added up without their lists. Probes of a cell are dealt in parts of ``PROBES``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worklens.functions.scalars import rounded
from worklens.sources.staging import settle

# Ship this module's functions to the workers themselves, so that workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Vectors of a cell, about, and probes that are looked up in a copy of it.
CELL = 8192
PROBES = 8192
#: Cells whose bounds a task holds at a time, and the share of a cell's vectors from which a term has a column.
CELLS = 1024
OFTEN = 0.1
SLACK = 1e-9


class CellIndex:
    """An inverted index over the vectors of a cell: ids, tie keys, and terms with weights, one vector after the other."""

    def __init__(self, ids: np.ndarray, ties: np.ndarray, sizes: np.ndarray, terms: np.ndarray, weights: np.ndarray):
        self.ids, self.ties, self.weights = ids, ties, weights
        self.row_at = np.concatenate([[0], np.cumsum(sizes)])
        self.terms, slot = np.unique(terms, return_inverse=True)
        self.slot = slot
        rows = np.repeat(np.arange(len(sizes)), sizes)
        self.place = rows * np.int64(len(self.terms)) + slot  # ascending: by row, then rare terms first
        self.square = np.concatenate([[0.0], np.cumsum(weights * weights)])
        order = np.argsort(slot, kind="stable")
        self.post_at = np.concatenate([[0], np.cumsum(np.bincount(slot, minlength=len(self.terms)))])
        self.post_row = rows[order]
        self.post_weight = weights[order]
        self.most = np.maximum.reduceat(self.post_weight, self.post_at[:-1]) if len(terms) else np.zeros(0)
        self.asked = np.zeros(len(self.terms))
        often = np.flatnonzero(np.diff(self.post_at) > OFTEN * len(sizes))
        self.column_of = np.full(len(self.terms), -1)
        self.column_of[often] = np.arange(len(often))
        self.columns = np.zeros((len(often), len(sizes)))
        for column, (a, z) in enumerate(zip(self.post_at[often], self.post_at[often + 1])):
            self.columns[column, self.post_row[a:z]] = self.post_weight[a:z]

    @staticmethod
    def _spans(at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers inside the given spans one after the other, and their sizes."""
        sizes = at[which + 1] - at[which]
        return np.repeat(at[which] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum()), sizes

    def scores(self, terms: np.ndarray, weights: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, score) of all rows that share a term with the probe and score at least ``floor``. Terms ascend, rare first."""
        slot = np.searchsorted(self.terms, terms)
        known = np.flatnonzero(slot < len(self.terms))
        known = known[self.terms[slot[known]] == terms[known]]
        slot, weights = slot[known], weights[known]
        if not len(slot):
            return slot, weights
        # What the terms from each place on can add at most.
        norm = np.sqrt(np.cumsum((weights * weights)[::-1])[::-1])
        bound = np.minimum(np.cumsum((weights * self.most[slot])[::-1])[::-1], norm)
        needed = int(np.searchsorted(-bound, -(floor - SLACK), side="right")) if floor > 0 else len(slot)
        column = self.column_of[slot]
        listed, whole = np.flatnonzero(column[:needed] < 0), np.flatnonzero(column[:needed] >= 0)
        at, sizes = self._spans(self.post_at, slot[listed])
        found = np.bincount(self.post_row[at], np.repeat(weights[listed], sizes) * self.post_weight[at], minlength=len(self.ids))
        if len(whole):
            found = found + weights[whole] @ self.columns[column[whole]]
        rows = np.flatnonzero(found > 0)
        if needed < len(slot) and len(rows):
            # A row's own rest behind the last term looked up bounds it, too.
            begin = np.searchsorted(self.place, rows * np.int64(len(self.terms)) + slot[needed - 1], side="right")
            own = np.sqrt(np.maximum(0.0, self.square[self.row_at[rows + 1]] - self.square[begin]))
            rest = np.minimum(bound[needed], norm[needed] * own)
            rows = rows[found[rows] + rest >= floor - SLACK]
        else:
            rows = rows[found[rows] >= floor - SLACK]
        score = found[rows]
        if needed < len(slot) and len(rows):
            if (column[needed:] >= 0).all():
                score = score + weights[needed:] @ self.columns[column[needed:, None], rows]
            else:
                self.asked[slot[needed:]] = weights[needed:]
                at, sizes = self._spans(self.row_at, rows)
                score = score + np.bincount(np.repeat(np.arange(len(rows)), sizes), self.asked[self.slot[at]] * self.weights[at], minlength=len(rows))
                self.asked[slot[needed:]] = 0.0
            enough = score >= floor - SLACK
            rows, score = rows[enough], score[enough]
        return rows, score


FOUND = "q long, d long, tie long, score double"


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of arrays one after the other, and their numbers."""
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _lookup(k: int | None, not_self: bool):
    """Looks up probes in their cells. Rows come sorted by (cell, part, kind), a cell's vectors (kind 0) before its probes.

    Probes of kind 2 take only vectors with a smaller id than their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, index = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, part, kind, ids, ties, floors = (batch.column(c).to_numpy() for c in ("cell", "part", "kind", "id", "tie", "floor"))
            terms, sizes = _lists(batch, "ts")
            weights, _ = _lists(batch, "ws")
            at = np.concatenate([[0], np.cumsum(sizes)])
            cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1
            out: list[tuple[np.ndarray, ...]] = []
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cell)]):
                if unit != (cell[a], part[a]):
                    unit, held, index = (cell[a], part[a]), [], None
                if kind[a] == 0:
                    held.append((ids[a:z], ties[a:z], sizes[a:z], terms[at[a] : at[z]], weights[at[a] : at[z]]))
                    continue
                if index is None:
                    if not held:
                        continue
                    index, held = CellIndex(*(np.concatenate(c) for c in zip(*held))), []
                for i in range(a, z):
                    rows, score = index.scores(terms[at[i] : at[i + 1]], weights[at[i] : at[i + 1]], floors[i])
                    if not_self:
                        other = index.ids[rows] != ids[i]
                        rows, score = rows[other], score[other]
                    if kind[a] == 2:
                        other = index.ids[rows] < ids[i]
                        rows, score = rows[other], score[other]
                    if k is not None and len(rows) > k:
                        shown = np.round(score, 9)
                        worst = np.partition(shown, len(shown) - k)[len(shown) - k]
                        rows, score, shown = (c[shown >= worst] for c in (rows, score, shown))
                        best = np.lexsort((index.ids[rows], index.ties[rows], -shown))[:k]
                        rows, score = rows[best], score[best]
                    if len(rows):
                        out.append((np.full(len(rows), ids[i]), index.ids[rows], index.ties[rows], score))
            columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["q", "d", "tie", "score"])

    return run


def _flat(vectors: DataFrame, *columns: str | Column) -> DataFrame:
    """Terms and scaled weights as two arrays, rare terms first."""
    ts = F.transform("terms", lambda x: x["t"]).cast("array<int>").alias("ts")
    ws = F.transform("terms", lambda x: x["raw"] / F.col("norm")).alias("ws")
    return vectors.select(*columns, ts, ws)


def _heaviest(place: int) -> Column:
    """The term of a vector's heaviest weight, or second heaviest; 0 where there is none."""
    heavy = F.reverse(F.array_sort(F.transform("terms", lambda x: F.struct((x["raw"] / F.col("norm")).alias("w"), x["t"].alias("t")))))
    return F.coalesce(F.get(heavy, F.lit(place))["t"], F.lit(0))


def _celled(base: DataFrame, block: str) -> DataFrame:
    """The base (block, id, tie, terms, norm) with ``cell``: a block, or a part of it with like heaviest terms."""
    counts = settle(base.groupBy(block).agg(F.count(F.lit(1)).alias("size")), "block-sizes")
    large = counts.where(F.col("size") > CELL)
    if large.isEmpty():
        return base.withColumn("cell", F.xxhash64(block))
    rows = base.join(large, block).select(block, "id", "size", _heaviest(0).alias("lead"), _heaviest(1).alias("second"))
    rows = settle(rows, "heaviest-terms")
    leads = rows.groupBy(block, "lead", "size").agg(F.count(F.lit(1)).alias("n"))
    # A lead with more than a cell's vectors has cells of its own, others share.
    own = F.ceil(F.col("n") / CELL)
    leads = leads.select(block, "lead", F.when(F.col("n") > CELL, own).alias("own"), F.ceil(F.col("size") / CELL).alias("cells"))
    shared = F.xxhash64(block, F.pmod(F.xxhash64("lead"), F.col("cells")))
    apart = F.xxhash64(block, "lead", F.pmod(F.xxhash64("second", F.floor(F.pmod(F.xxhash64("id"), 4 * F.col("own")) / 4)), F.col("own")))
    placed = rows.drop("size").join(settle(leads, "lead-terms"), [block, "lead"])
    # Names of their own: a column of ``placed`` must not be taken for the one of ``base`` it comes from, null for a row of a small block.
    placed = placed.select(F.col("id").alias("own_id"), F.col(block).alias("own_block"), F.when(F.col("own").isNull(), shared).otherwise(apart).alias("own_cell"))
    same = (F.col("id") == F.col("own_id")) & (F.col(block) == F.col("own_block"))
    return base.join(placed, same, "left").withColumn("cell", F.coalesce("own_cell", F.xxhash64(block))).drop("own_id", "own_block", "own_cell")


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells that share a term with a probe, and what each can give at most.

    Rows come sorted by (block, group, part, kind), a group of a block's cells with the largest weights of their terms (kind 0) before the probes.
    """
    unit, held, most = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        units = list(zip(*(batch.column(c).to_pylist() for c in ("block", "group", "part"))))
        kind, ids = (batch.column(c).to_numpy() for c in ("kind", "id"))
        terms, sizes = _lists(batch, "ts")
        weights, _ = _lists(batch, "ws")
        at = np.concatenate([[0], np.cumsum(sizes)])
        out: list[tuple[np.ndarray, ...]] = []
        for i, of in enumerate(units):
            if of != unit:
                unit, held, most = of, [], None
            t, w = terms[at[i] : at[i + 1]], weights[at[i] : at[i + 1]]
            if kind[i] == 0:
                held.append((ids[i], t, w))
                continue
            if most is None:
                cells = np.array([cell for cell, _, _ in held], np.int64)
                most = np.zeros((1 + max((x.max() for _, x, _ in held if len(x)), default=0), len(held)))
                for place, (_, x, y) in enumerate(held):
                    most[x, place] = y
                held = []
            known = t < len(most)
            rows, w = most[t[known]], w[known]
            square = (w * w) @ (rows > 0)
            near = np.flatnonzero(square > 0)
            if len(near):
                out.append((np.full(len(near), i), np.full(len(near), ids[i]), cells[near], np.minimum(w @ rows, np.sqrt(square))[near]))
        row, q, cell, bound = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        yield pa.RecordBatch.from_arrays([pa.array(q), batch.column("block").take(pa.array(row)), pa.array(cell), pa.array(bound)], names=["id", "block", "cell", "bound"])


def _routes(probe: DataFrame, base: DataFrame, block: str) -> DataFrame:
    """(id, block, cell, bound): the cells of a probe's block that share a term with it, and what each can give at most."""
    cells = base.select(block, "cell").distinct().groupBy(block).agg(F.count(F.lit(1)).alias("cells"), F.min("cell").alias("cell"))
    cells = settle(cells, "cells")
    single = probe.join(cells.where("cells = 1"), block).select("id", block, "cell", F.lit(1.0).alias("bound"))
    asked = probe.join(cells.where("cells > 1").select(block, "cells"), block)
    loads = settle(asked.groupBy(block, "cells").agg(F.ceil(F.count(F.lit(1)) / PROBES).cast("int").alias("parts")), "block-loads")
    if loads.isEmpty():
        return single
    loads = loads.select(block, F.ceil(F.col("cells") / CELLS).cast("int").alias("groups"), "parts")
    weight = F.explode(F.transform("terms", lambda x: F.struct(x["t"].alias("t"), (x["raw"] / F.col("norm")).alias("w"))))
    most = base.join(loads, block).select(block, "cell", "groups", "parts", weight.alias("x")).groupBy(block, "cell", "groups", "parts", F.col("x.t").alias("t")).agg(F.max("x.w").alias("most"))
    most = most.groupBy(block, "cell", "groups", "parts").agg(F.sort_array(F.collect_list(F.struct("t", "most"))).alias("x"))
    held = most.select(
        F.col(block).alias("block"), F.pmod(F.xxhash64("cell"), F.col("groups")).cast("int").alias("group"), F.explode(F.expr("sequence(0, parts - 1)")).alias("part"),
        F.lit(0).alias("kind"), F.col("cell").alias("id"), F.col("x.t").alias("ts"), F.col("x.most").alias("ws"),
    )
    sent = probe.join(loads, block).withColumn("group", F.explode(F.expr("sequence(0, groups - 1)")))
    sent = _flat(sent, F.col(block).alias("block"), "group", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), "id")
    rows = held.unionByName(sent).repartition("block", "group", "part").sortWithinPartitions("block", "group", "part", "kind")
    found = rows.mapInArrow(_bounds, f"id long, block {probe.schema[block].dataType.simpleString()}, cell long, bound double")
    return single.unionByName(found.withColumnRenamed("block", block))


def _search(probe: DataFrame, base: DataFrame, routes: DataFrame, block: str, k: int | None, not_self: bool) -> DataFrame:
    """Matches (q, d, tie, score) of probes along their routes (id, block, cell, floor, kind)."""
    loads = settle(routes.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PROBES).cast("int").alias("parts")), "cell-loads")
    held = base.join(loads, "cell").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    held = _flat(held, "cell", "part", F.lit(0).alias("kind"), "id", F.coalesce("tie", F.lit(-1).cast("long")).alias("tie"), F.lit(0.0).alias("floor"))
    sent = probe.join(routes.select(F.col("id").alias("r_id"), F.col(block).alias("r_block"), "cell", "floor", "kind"), (F.col("id") == F.col("r_id")) & (F.col(block) == F.col("r_block")))
    sent = sent.join(loads, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    sent = _flat(sent, "cell", "part", "kind", "id", F.lit(0).cast("long").alias("tie"), "floor")
    rows = held.unionByName(sent).repartition("cell", "part").sortWithinPartitions("cell", "part", "kind")
    return rows.mapInArrow(_lookup(k, not_self), FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc(rounded(F.col("score"), 9)), "tie", "d")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _own(base: DataFrame, block: str) -> DataFrame:
    return base.select("id", block, F.col("cell").alias("own"))


def best_matches(probe: DataFrame, base: DataFrame, block: str, k: int, exclude_self: bool) -> DataFrame:
    """Rows (q, d, score, rank): the k base vectors of a probe's block with the highest scores above 0; ties by ``tie``, then id.

    ``probe`` has (block, id, terms, norm), ``base`` (block, id, tie, terms, norm); an id stands for one vector of one block.
    """
    base = settle(_celled(base, block), "celled")
    routes = _routes(probe, base, block).withColumn("kind", F.lit(1))
    best_first = [F.desc("bound"), F.col("cell")]
    if exclude_self:
        routes = routes.join(_own(base, block), ["id", block], "left")
        best_first = [F.desc(F.coalesce(F.col("cell") == F.col("own"), F.lit(False))), *best_first]
    routes = settle(routes, "routes")
    ranked = routes.withColumn("place", F.row_number().over(Window.partitionBy("id", block).orderBy(*best_first)))
    found = _search(probe, base, ranked.where("place = 1").withColumn("floor", F.lit(0.0)), block, k, exclude_self)
    others = settle(ranked.where("place > 1"), "other-routes")
    if not others.isEmpty():
        found = settle(found, "first-matches")
        floors = found.groupBy("q").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(0.0).alias("floor"))
        rest = others.join(floors, others["id"] == floors["q"], "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
        rest = settle(rest.where(F.col("bound") + SLACK >= F.col("floor")).select("id", block, "cell", "floor", "kind"), "open-routes")
        found = found.unionByName(_search(probe, base, rest, block, k, exclude_self))
    return _top(found, k).select("q", "d", "score", "rank")


def matches_above(probe: DataFrame, base: DataFrame, block: str, threshold: float, later_only: bool = False) -> DataFrame:
    """(q, d, score): all base vectors of a probe's block with cosine >= threshold. ``later_only``, for a table with itself: each pair
    once, so a probe goes to no cell behind its own."""
    base = settle(_celled(base.withColumn("tie", F.lit(0).cast("long")), block), "celled")
    routes = _routes(probe, base, block).where(F.col("bound") + SLACK >= threshold).withColumns({"floor": F.lit(float(threshold)), "kind": F.lit(1)})
    if later_only:
        routes = routes.join(_own(base, block), ["id", block]).where("cell <= own").withColumn("kind", F.when(F.col("cell") == F.col("own"), 2).otherwise(1))
    found = _search(probe, base, settle(routes, "routes"), block, None, False)
    return found.where(F.col("score") >= threshold).select("q", "d", "score")


def pairs_above(members: DataFrame, block: str, threshold: float) -> DataFrame:
    """Pairs (block, s1 < s2, score) of distinct signatures in one block with cosine >= threshold.

    ``members`` has (block, signature, terms, norm), settled.
    """
    named = settle(members.select(block, "signature", "terms", "norm", F.monotonically_increasing_id().alias("id")), "named")
    found = settle(matches_above(named, named, block, threshold, later_only=True), "pairs-above")
    one = named.select(F.col("id").alias("q"), block, F.col("signature").alias("sq"))
    two = named.select(F.col("id").alias("d"), F.col("signature").alias("sd"))
    return found.join(one, "q").join(two, "d").select(block, F.least("sq", "sd").alias("s1"), F.greatest("sq", "sd").alias("s2"), "score")
