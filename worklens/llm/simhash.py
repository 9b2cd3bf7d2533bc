"""SimHash near-duplicates with a Gray-order hierarchical index.

A fingerprint's partners are searched in trees over fingerprints sorted by Gray rank, so that neighbours share most bits.
An upper node holds the bits that all fingerprints below it share, as a mask and a pattern, without what its parent already
holds. A search adds up a node's differences on its own bits to those of its ancestors and drops the whole group once they
exceed the limit.

The uppermost nodes are the groups that Spark deals out: the bits are cut into ``max_bits + 1`` interleaved masks, and two
fingerprints within the limit agree on at least one mask, so it is enough to search the trees whose root pattern is matched
without a difference. Copies of a fingerprint enter once. A root with more than ``root_rows`` fingerprints is cut into parts
by a hash, and every two parts are searched in a task of their own; no link is left out. Tasks give back a spanning forest of
the links that they find, so their output is bounded by their input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.llm.common import fresh
from worklens.llm.components import components
from worklens.sources.staging import settle

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
FAN_OUT = 4
#: Fingerprints searched together in one task at most; larger roots are cut.
ROOT_ROWS = 20_000
#: (query, node) pairs in memory at once.
FRONTIER = 1 << 20

_LANES = np.uint64(0x0101010101010101)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits, lowest first. Eight counters a word, folded before they overflow."""
    counts = np.zeros(64, dtype=np.int64)
    blocks = np.arange(0, len(hashes), 255)
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, blocks)
        counts[bit::8] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return counts


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS, chunk: int = 1 << 16) -> int:
    """64-bit SimHash: a bit is set if more than half of the shingles' XXH64 have it. Zero without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(shingle_words, len(words))
    starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), chunk):
        pairs = zip(starts[at : at + chunk].tolist(), ends[at : at + chunk].tolist())
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in pairs], dtype=np.uint64)
        counts += _bit_counts(hashes)
    return sum(1 << int(bit) for bit in np.flatnonzero(2 * counts > len(starts)))


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, written (a hash of the text as it is), fp (the fingerprint as a signed long). Whole texts; a null text has no words."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle_words) for t in batch["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "written": batch["written"], "fp": fps.view(np.int64)})

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("written"), text.alias("text"))
    return rows.mapInPandas(hashed, "doc_id long, written long, fp long")


def root_masks(max_bits: int = MAX_BITS) -> list[int]:
    """Interleaved bit masks; fingerprints within ``max_bits`` differences agree on at least one."""
    parts = max_bits + 1
    return [sum(1 << b for b in range(m, 64, parts)) for m in range(parts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def gray_rank(fp: F.Column) -> F.Column:
    """Place of the fingerprint in Gray order, as a signed long of the same order."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


class GrayIndex:
    """Trees over fingerprints that come sorted by (root, Gray rank); ``root``: running number of each one's root."""

    def __init__(self, root: np.ndarray, fp: np.ndarray):
        self.fp = fp
        _, first, size = np.unique(root, return_index=True, return_counts=True)
        place = np.arange(len(fp)) - np.repeat(first, size)
        ones = fp.copy()  # bits that all below have set
        zeros = ~fp  # bits that none below has set
        owner = root
        self.levels = [(ones, zeros, None, None)]
        while len(owner) > len(first):
            starts = np.flatnonzero(place % FAN_OUT == 0)
            count = np.diff(np.append(starts, len(place)))
            ones, zeros = np.bitwise_and.reduceat(ones, starts), np.bitwise_and.reduceat(zeros, starts)
            self.levels.append((ones, zeros, starts, count))
            owner, place = owner[starts], place[starts] // FAN_OUT
        self.root_of = dict(zip(owner.tolist(), range(len(owner))))

    def links(self, query_root: np.ndarray, query: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (query number, fingerprint number) within ``max_bits`` differences, in the same root."""
        top = len(self.levels) - 1
        node = np.array([self.root_of.get(r, -1) for r in query_root.tolist()], dtype=np.int64)
        at = np.flatnonzero(node >= 0)
        node = node[at]
        none = np.zeros(len(at), dtype=np.uint64)
        todo = [(top, at, node, none, np.zeros(len(at), dtype=np.uint8))]
        while todo:
            level, at, node, above, far = todo.pop()
            if len(at) > FRONTIER:
                half = len(at) // 2
                todo += [(level, at[:half], node[:half], above[:half], far[:half]), (level, at[half:], node[half:], above[half:], far[half:])]
                continue
            ones, zeros, starts, count = self.levels[level]
            shared = ones[node] | zeros[node]
            own = shared & ~above  # bits that this node adds to its parent's pattern
            far = far + np.bitwise_count((query[at] ^ ones[node]) & own)
            near = far <= max_bits
            at, node, shared, far = at[near], node[near], shared[near], far[near]
            if level == 0:
                yield at, node
                continue
            n = count[node]
            below = np.repeat(starts[node] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else node
            todo.append((level - 1, np.repeat(at, n), below, np.repeat(shared, n), np.repeat(far, n)))


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Components after adding links a-b; ``label`` names each one's smallest member."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        label = parent[label]


def _forest(unit: np.ndarray, fp: np.ndarray, rep: np.ndarray, stored: np.ndarray, asks: np.ndarray, max_bits: int) -> pd.DataFrame:
    """Links of whole units: the stored fingerprints against those that ask, as a forest."""
    label = np.arange(len(fp))
    index = GrayIndex(unit[stored], fp[stored])
    store, ask = np.flatnonzero(stored), np.flatnonzero(asks)
    for q, hit in index.links(unit[ask], fp[ask], max_bits):
        label = _merge(label, ask[q], store[hit])
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return pd.DataFrame({"u": rep[moved], "v": rep[label[moved]]})


def links(reps: DataFrame, max_bits: int = MAX_BITS, root_rows: int = ROOT_ROWS) -> DataFrame:
    """(u, v): a spanning forest per task of all links between fingerprints. ``reps``: fp, rep (an id, unique per fp)."""
    masks = F.array(*[F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("pattern")) for i, m in enumerate(root_masks(max_bits))])
    rows = reps.select("fp", "rep", F.inline(masks))
    large = rows.groupBy("band", "pattern").count().where(F.col("count") > root_rows)
    large = large.select("band", "pattern", F.ceil(F.col("count") / root_rows).cast("int").alias("parts"))
    rows = rows.join(settle(large, "large-roots"), ["band", "pattern"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    rows = rows.select("*", F.explode(F.expr("sequence(0, parts - 1)")).alias("other"))
    rows = rows.withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")})
    rows = rows.withColumns({"stored": F.col("part") == F.col("lo"), "asks": F.col("part") == F.col("hi")})
    unit = ["band", "pattern", "lo", "hi"]
    rows = rows.withColumn("gray", gray_rank(F.col("fp"))).repartition(*unit).sortWithinPartitions(*unit, "gray")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(part: pd.DataFrame) -> pd.DataFrame:
            key = part[unit].to_numpy()
            number = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]).any(axis=1))])
            fp = part["fp"].to_numpy(np.int64).view(np.uint64)
            return _forest(number, fp, part["rep"].to_numpy(np.int64), part["stored"].to_numpy(bool), part["asks"].to_numpy(bool), max_bits)

        rest: list[pd.DataFrame] = []  # rows of the unit that the last batch ended in
        for batch in batches:
            if not len(batch):
                continue
            key = batch[unit].to_numpy()
            cut = np.flatnonzero((key != key[-1]).any(axis=1))
            if rest and (rest[-1][unit].to_numpy()[-1] != key[0]).any():
                yield done(pd.concat(rest))
                rest = []
            if len(cut):
                yield done(pd.concat([*rest, batch.iloc[: cut[-1] + 1]]))
                rest = []
            rest.append(batch.iloc[cut[-1] + 1 :] if len(cut) else batch)
        if rest:
            yield done(pd.concat(rest))

    return rows.select(*unit, "fp", "rep", "stored", "asks").mapInPandas(search, "u long, v long")


def _classes(docs: DataFrame, shingle_words: int, max_bits: int) -> DataFrame:
    """One row per document: doc_id, written, fp, component_id."""
    fps = settle(fingerprints(docs, shingle_words), "fingerprints")
    reps = settle(fps.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    roots = components(links(reps, max_bits))
    classes = reps.join(roots, reps["rep"] == roots["u"], "left").select("fp", F.coalesce("v", "rep").alias("component_id"))
    return fps.join(classes, "fp", "left")


def near_groups(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id it reaches).

    Documents link if their fingerprints differ in at most ``max_bits`` bits. Null and wordless texts have fingerprint zero
    and link like any other. A row without an id gets the component of its fingerprint, null if no row with an id has that
    fingerprint, and it links nothing. Repeated rows give repeated results; other columns are ignored; an empty table gives
    no rows.
    """
    out = _classes(docs, shingle_words, max_bits)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents whose id is the smallest of their component, with all their columns; rows without an id stay.

    A row is judged by its own text: where an id is repeated with different texts, each row goes or stays on its own. Null and
    wordless texts are near copies of each other, so one of them stays. An empty table gives an empty table.
    """
    own, written = fresh(docs, "near_copy_id", "near_copy_text")
    gone = _classes(docs, shingle_words, max_bits).where("doc_id <> component_id").select(F.col("doc_id").alias(own), F.col("written").alias(written)).distinct()
    text = F.xxhash64(F.col("text").cast("string"))
    return docs.join(gone, (docs["doc_id"] == gone[own]) & (text == gone[written]), "left_anti")
