"""Runs of repeated words (maximal repetitions) by scale-tiled distribution.

Periods are taken by octave: P to 2P - 1. For each octave a document is cut into tiles, each a core with margins of 2P words
before and 4P behind, so that a run of a period of the octave shows at least two whole periods in some tile. A tile is
solved on its own: boundaries stand every few words of its core, and Z-functions forwards and backwards from a boundary tell, for
all periods of the octave at once, how far the words go on repeating. Fragments of runs, as intervals, are shuffled
by document and period and those that overlap by a period or more are stitched: they are parts of one run.

Only tiles with a boundary whose ``GRAM`` words come again at a distance of the octave are sent: the spacing of boundaries
is such that every run has one, so that nothing is missed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worklens.sources.staging import settle

MIN_LENGTH = 12
#: Words that come again one period later at a boundary inside a run: a run of ``MIN_LENGTH`` words and two periods has this many.
GRAM = 6
#: Words of a tile's core at least.
CORE = 1024
#: Words looked through together in one step.
CHUNK_WORDS = 1 << 20


def spacing(octave: int) -> int:
    """Words between boundaries. A run of period q in P to 2P - 1 has at least max(MIN_LENGTH - q, q) matches one period on; a
    boundary among its first ``spacing`` words still has GRAM of them."""
    return {1: 4, 2: 4, 4: 1, 8: 2}.get(octave, octave // 2)


def core(octave: int) -> int:
    return max(4 * octave, CORE)


def _grams(words: np.ndarray) -> np.ndarray:
    """A hash of the GRAM words from each place on. Equal grams have equal hashes."""
    mixed = words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    n = len(words) - GRAM + 1
    out = np.zeros(max(0, n), np.uint64)
    for i in range(GRAM):
        out = (out + mixed[i : i + len(out)]) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def boundaries(words: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(octave, places) of boundaries whose gram comes again at a distance of the octave in the same document.

    ``words`` holds the documents one after the other, ``begins`` where each starts and, at last, where all end.
    """
    sizes = np.diff(begins)
    longest = int(sizes.max(initial=0))
    grams = _grams(words)
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(grams)]
    inside = np.arange(len(grams)) + GRAM <= begins[owner + 1]
    places = np.flatnonzero(inside)
    if not len(places):
        return
    grams = (grams[places] + owner[places].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ (owner[places].astype(np.uint64) << np.uint64(40))
    order = np.argsort(grams, kind="stable")
    sorted_, places = grams[order], places[order]
    same = sorted_[1:] == sorted_[:-1]
    repeated = np.append(same, False) | np.append(False, same)
    sorted_, places = sorted_[repeated], places[repeated]
    if not len(places):
        return
    group = np.cumsum(np.append(True, sorted_[1:] != sorted_[:-1]))
    key = group * np.int64(len(words) + 1) + places  # ascending: by gram, then by place
    local = places - begins[owner[places]]
    octave = 1
    while 2 * octave <= longest:
        at = np.flatnonzero(local % spacing(octave) == 0)
        after = np.searchsorted(key, key[at] + octave)
        # The key of a later gram is larger by more than any distance inside a document.
        found = after < len(key)
        found[found] = (key[after[found]] < key[at[found]] + 2 * octave) & (group[after[found]] == group[at[found]])
        if found.any():
            yield octave, np.sort(places[at[found]])
        octave *= 2


def z_function(x: list[int], upto: int) -> list[int]:
    """For each place below ``upto``, how many items from there on equal those at the start."""
    n, upto = len(x), min(upto, len(x))
    z = [n] + [0] * (upto - 1) if upto else []
    left = right = 0
    for i in range(1, upto):
        k = min(z[i - left], right - i) if i < right else 0
        if i + k >= right:
            while i + k < n and x[k] == x[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


def _primitive(q: int, z: list[int]) -> bool:
    """Whether the first q items aren't a repetition of fewer; ``z``: their Z-function, up to q / 2 at least."""
    rest, f = q, 2
    while rest > 1:
        if f * f > rest:
            f = rest
        if rest % f == 0:
            while rest % f == 0:
                rest //= f
            if z[q // f] >= q - q // f:
                return False
        f += 1
    return True


def fragments(words: np.ndarray, marks: list[int], octave: int) -> Iterator[tuple[int, int, int]]:
    """(period, start, end) of stretches of a tile with at least two periods of the octave, from its boundaries ``marks``.

    Smallest periods only: a stretch of two periods q has a smaller one only if that divides q.
    """
    grams = _grams(words)
    order = np.argsort(grams, kind="stable")
    rank = np.empty(len(grams), np.int64)
    rank[order] = np.cumsum(np.append(True, grams[order[1:]] != grams[order[:-1]]))
    key = rank[order] * np.int64(len(words) + 1) + order  # ascending: by gram, then by place
    at = np.asarray(marks, np.int64)
    own = rank[at] * np.int64(len(words) + 1) + at
    lows = np.searchsorted(key, own + octave).tolist()
    highs = np.searchsorted(key, np.minimum(own + 2 * octave, (rank[at] + 1) * np.int64(len(words) + 1))).tolist()
    plain = words.tolist()
    covered: dict[int, tuple[int, int]] = {}
    for b, low, high in zip(marks, lows, highs):
        again = order[low:high] - b
        if len(again) == 1:
            q = int(again[0])
            x, y = covered.get(q, (0, 0))
            if x <= b and b + q <= y:
                continue
            open_ = [q]
        else:
            open_ = [q for q in again.tolist() if not (q in covered and covered[q][0] <= b and b + q <= covered[q][1])]
        if not open_:
            continue
        ahead = z_function(plain[b:], max(open_) + 1)
        back = max(2 * octave, 8)
        pattern = plain[max(0, b - back) : b][::-1]
        end = b + max(open_)
        text = plain[max(0, b - back) : end][::-1]
        behind = z_function([*pattern, -1, *text], len(pattern) + 2 + end - b - min(open_))
        for q in open_:
            x, y = b - behind[len(pattern) + 1 + end - b - q], b + q + ahead[q]
            covered[q] = x, y  # with less than two periods, too: another boundary in it shows the same
            if y - x >= 2 * q and _primitive(q, ahead):
                yield q, x, y


_EXPLODED = "row long, doc_id string, n long, plain string, words string, octave int, start int, size int, marks binary, codes binary"


def explode(docs: DataFrame, whole: bool = False) -> DataFrame:
    """Rows of documents (octave null: row, doc_id, n, the digest of its words, and the words if it has tiles, or of all
    documents if ``whole``) and their tiles."""

    # Ids go through pandas as text: a column of whole numbers with a null would become doubles.
    def chunk(ids: list, texts: list[tuple[int, bytes]]) -> pd.DataFrame:
        vocabulary: defaultdict = defaultdict()
        vocabulary.default_factory = vocabulary.__len__
        cut = [t.split() for _, t in texts]
        codes = [np.fromiter(map(vocabulary.__getitem__, w), np.int32, len(w)) for w in cut]
        begins = np.concatenate([[0], np.cumsum([len(c) for c in codes])]).astype(np.int64)
        words = np.concatenate(codes) if codes else np.zeros(0, np.int32)
        out, tiled = [], set()
        for octave, places in boundaries(words, begins):
            doc = np.searchsorted(begins, places, side="right") - 1
            tile = (places - begins[doc]) // core(octave)
            starts = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (tile[1:] != tile[:-1])))
            for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(doc)]):
                d, first = int(doc[a]), int(tile[a]) * core(octave)
                lo, hi = max(0, first - 2 * octave), min(len(codes[d]), first + core(octave) + 4 * octave)
                marks = (places[a:z] - begins[d] - lo).astype(np.int32)
                out.append((texts[d][0], None, None, None, None, octave, lo, hi - lo, marks.tobytes(), codes[d][lo:hi].tobytes()))
                tiled.add(d)
        for d, ((row, _), w) in enumerate(zip(texts, cut)):
            joined = b" ".join(w)
            shown = joined.decode("utf-8", "surrogatepass") if whole or d in tiled else None
            out.append((row, ids[d], len(w), sha256(joined).hexdigest(), shown, None, None, None, None, None))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in _EXPLODED.split(", ")])
        return frame.astype({"n": "Int64", "octave": "Int32", "start": "Int32", "size": "Int32"})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for row, doc_id, text in zip(batch["row"].tolist(), batch["doc_id"].tolist(), batch["text"].tolist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                ids.append(doc_id)
                texts.append((row, raw))
                size += len(raw)
                if size > 4 * CHUNK_WORDS:
                    yield chunk(ids, texts)
                    ids, texts, size = [], [], 0
        if texts:
            yield chunk(ids, texts)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(cut, _EXPLODED)


def solve(tiles: DataFrame) -> DataFrame:
    """(row, period, start, finish) of fragments, places counted in the document."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, octave, start, marks, codes in zip(batch["row"], batch["octave"], batch["start"], batch["marks"], batch["codes"]):
                words = np.frombuffer(codes, np.int32)
                for q, x, y in fragments(words, np.frombuffer(marks, np.int32).tolist(), int(octave)):
                    out.append((row, q, start + x, start + y))
            yield pd.DataFrame(out, columns=["row", "period", "start", "finish"])

    spread = tiles.select("row", "octave", "start", "marks", "codes").repartition(F.xxhash64("row", "octave", "start"))
    return spread.mapInPandas(each, "row long, period long, start long, finish long")


def stitch(parts: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """Runs (row, start, length, period) from fragments: those of one document and period that overlap by a period are one."""
    by = Window.partitionBy("row", "period").orderBy("start", "finish")
    reach = F.max("finish").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = (reach.isNull() | (reach - F.col("start") < F.col("period"))).cast("long")
    parts = parts.withColumn("new", new).withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = parts.groupBy("row", "period", "run").agg(F.min("start").alias("start"), F.max("finish").alias("finish"))
    length = F.col("finish") - F.col("start")
    return runs.where(length >= F.greatest(F.lit(min_length), 2 * F.col("period"))).select("row", "start", length.alias("length"), "period")


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """One row per document: doc_id, n_words, runs (an array of start, length, period, by start and period), text (its words
    joined by one space without those that a run repeats).

    A run is a stretch of words with smallest period q, at least ``min_length`` words and two periods, that can't be made longer
    on either side. Words are cut at ASCII white space and compared as they are. A word goes if a run contains it after that run's
    first period. Null texts and texts without words have no runs and an empty text. Repeated rows are documents of their
    own; a null id stays null; other columns are ignored; an empty table gives no rows.
    """
    out = _with_runs(docs, min_length, whole=True)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["text"] = [collapsed(w, r) for w, r in zip(batch["words"], batch["runs"])]
            yield batch.drop(columns="words")

    out = out.select("doc_id", "n_words", "runs", "words").mapInPandas(finish, "doc_id string, n_words long, runs array<struct<start:long,length:long,period:long>>, text string")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def collapsed(words: str, runs) -> str:
    """The words that no run repeats, joined by one space."""
    raw = words.encode("utf-8", "surrogatepass").split()
    change = np.zeros(len(raw) + 1, np.int64)
    for r in runs:
        change[r["start"] + r["period"]] += 1
        change[r["start"] + r["length"]] -= 1
    gone = np.cumsum(change[:-1]) > 0
    return b" ".join(raw[i] for i in np.flatnonzero(~gone).tolist()).decode("utf-8", "surrogatepass")


def _with_runs(docs: DataFrame, min_length: int, whole: bool = False) -> DataFrame:
    """row, doc_id, n_words, runs, plain (digest of all words), words (joined, where the document has tiles or if ``whole``)."""
    if min_length < 2 * GRAM:
        raise ValueError(f"runs have at least {2 * GRAM} words")
    exploded = settle(explode(docs, whole), "tiles")
    runs = stitch(solve(exploded.where("octave IS NOT NULL")), min_length)
    runs = runs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    runs = runs.withColumn("runs", F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))))
    rows = exploded.where("octave IS NULL").select("row", "doc_id", F.col("n").alias("n_words"), "plain", "words")
    none = F.array().cast("array<struct<start:bigint,length:bigint,period:bigint>>")
    return rows.join(runs, "row", "left").withColumn("runs", F.coalesce("runs", none))


def digests(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """One row per document: doc_id, n_runs, the longest run (start, length, period, exponent_milli; ties by start, then period;
    null without a run), runs_sha256 and collapsed_sha256. Rows as in ``periodic_runs``; texts without a tile aren't read again."""

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            shown = []
            for plain, words, runs in zip(batch["plain"], batch["words"], batch["runs"]):
                shown.append(sha256(collapsed(words, runs).encode("utf-8", "surrogatepass")).hexdigest() if len(runs) else plain)
            batch["collapsed_sha256"] = shown
            yield batch[["doc_id", "runs", "collapsed_sha256"]]

    rows = _with_runs(docs, min_length).select("doc_id", "runs", "plain", "words")
    out = rows.mapInPandas(finish, "doc_id string, runs array<struct<start:long,length:long,period:long>>, collapsed_sha256 string")
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    out = out.withColumn("best", best)
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        "collapsed_sha256",
    )


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, with a repetition to its end in a tenth of the documents, chosen by h, the CRC-32 of the id: from word a =
    h / 10 % n on, the p = 1 + (n - a) / (3 + h / 10 % 8) words from there come again and again. Null ids and null texts stay."""
    text, h = F.col("text").cast("string"), F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, g = "size(w)", "(h div 10)"
    first = f"(({g}) % {n})"
    period = f"(1 + ({n} - {first}) div (3 + {g} % 8))"
    shown = F.expr(f"transform(w, (x, i) -> IF(i < {first}, x, w[CAST({first} + (i - {first}) % {period} AS INT)]))")
    rows = docs.select("doc_id", text.alias("text"), h.alias("h"))
    chosen = F.when((F.col("h") % 10 == 0) & (F.octet_length("text") > 0), words).alias("w")
    rows = rows.select("doc_id", "text", "h", chosen)
    return rows.select("doc_id", F.when(F.expr("size(w) > 0"), F.array_join(shown, " ")).otherwise(F.col("text")).alias("text"))
