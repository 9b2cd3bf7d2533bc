"""Benchmark decontamination by winnowing, in DataFrame operations only.

A text's fingerprints are the minima of its k-gram hashes over sliding windows of ``WINDOW_WORDS - K + 1`` k-grams, so any
``WINDOW_WORDS`` consecutive words hold at least one, and it depends on those words alone: texts that share such a span share
a fingerprint. Documents that share one with the benchmark are candidates. In these, the k-grams that matched are extended to
every window of words around them, and the windows are joined with the benchmark's by their words. Benchmark items of fewer
words are one window each; for their few lengths every n-gram is a fingerprint.

The same text is looked at once however often it occurs. Long texts are cut into overlapping segments before words are
extended, so no row outgrows ``SEGMENT_WORDS``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worklens.llm.common import ascii_lower, fresh, whole_text
from worklens.sources.staging import settle

WINDOW_WORDS = 13
K = 4
SEGMENT_WORDS = 2000
#: Everything that is no part of a word, after lower-casing A-Z.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str = "text") -> Column:
    """Words of the whole text, lower-cased A-Z; none for null."""
    return F.filter(F.split(ascii_lower(whole_text(text)), _BETWEEN), lambda w: w != "")


def _runs(df: DataFrame, source: str, length: int, merge: str, into: str) -> DataFrame:
    """Column ``into``: SQL function ``merge`` of each ``length`` neighbouring values; empty if there are fewer."""
    starts = f"IF(size({source}) >= {length}, sequence(0, size({source}) - {length}), CAST(array() AS array<int>))"
    values = ", ".join(f"{source}[i + {j}]" for j in range(length))
    return df.withColumn(into, F.expr(f"transform({starts}, i -> {merge}({values}))"))


def _with_grams(df: DataFrame, n: int, into: str) -> DataFrame:
    """Column ``into``: hash of each n-gram of the column ``words``; empty if there are fewer words."""
    df = df.withColumn("__h", F.transform("words", lambda w: F.xxhash64(w)))
    return _runs(df, "__h", n, "xxhash64", into).drop("__h")


def _with_fingerprints(df: DataFrame, short: list[int]) -> DataFrame:
    """Column ``prints``: distinct winnowed k-gram hashes, and all n-gram hashes for the lengths in ``short``."""
    df = _with_grams(df, K, "__k")
    df = _runs(df, "__k", WINDOW_WORDS - K + 1, "least", "__m").drop("__k")
    parts = ["__m"]
    for n in short:
        df = _with_grams(df, n, f"__n{n}")
        parts.append(f"__n{n}")
    return df.withColumn("prints", F.array_distinct(F.concat(*parts))).drop(*parts)


def _window(words: str, start: Column, length: int) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def _benchmark_windows(items: DataFrame, lengths: list[int]) -> DataFrame:
    """(window, item_id), distinct; the window is its words with spaces between."""
    out = []
    for n in lengths:
        fits = F.size("words") >= n if n == WINDOW_WORDS else F.size("words") == n
        starts = F.expr(f"sequence(1, size(words) - {n} + 1)")
        rows = items.where(fits).withColumn("start", F.explode(starts))
        out.append(rows.select(_window("words", F.col("start"), n).alias("window"), "item_id"))
    return reduce(DataFrame.unionByName, out).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is 13 consecutive words of an item, or all its words if it has fewer; words of a document inside an occurrence
    of a window are hit; a document is contaminated if at least a twentieth of its words, and at least one, are hit. Null and
    wordless texts have no words and no hits, wordless items no windows. Items without an id hit words but aren't counted;
    repeated items count once. Repeated document rows give repeated results; other columns are ignored; empty tables give no
    rows and no hits.
    """
    return _judged(docs, benchmark).drop("digest")


def _judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The result, with each text's digest."""
    items = settle(benchmark.select("item_id", words().alias("words")).where("size(words) > 0"), "benchmark-words")
    # At most WINDOW_WORDS - 1 lengths.
    short = sorted(r[0] for r in items.where(F.size("words") < WINDOW_WORDS).select(F.size("words")).distinct().collect())
    lengths = [*short, WINDOW_WORDS]

    # explode_outer: a plain explode filters on its input first, and the optimizer would compute the input twice for that.
    prints = _with_fingerprints(items.select("words"), []).select(F.explode_outer("prints").alias("print"))
    for n in short:
        grams = _with_grams(items.where(F.size("words") == n).select("words"), n, "grams")
        prints = prints.unionByName(grams.select(F.explode_outer("grams").alias("print")))
    prints = settle(prints.where("print IS NOT NULL").distinct(), "benchmark-prints")
    windows = settle(_benchmark_windows(items, lengths), "benchmark-windows")

    parsed = docs.select("doc_id", F.sha2(whole_text(), 256).alias("digest"), words().alias("words"))
    parsed = _with_fingerprints(parsed, short).select("doc_id", "digest", F.size("words").cast("long").alias("n_words"), "prints")
    parsed = settle(parsed, "document-prints")

    matched = parsed.select("doc_id", "digest", F.explode("prints").alias("print")).join(prints, "print")
    matched = matched.groupBy("digest").agg(F.min("doc_id").alias("of"), F.collect_set("print").alias("matched"))
    # A text with no id at all can't be fetched by id; it is fetched by its digest alone.
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    named = texts.join(matched, F.col("doc_id") == F.col("of")).where(F.sha2(whole_text(), 256) == F.col("digest"))
    nameless = texts.where("doc_id IS NULL").withColumn("own", F.sha2(whole_text(), 256)).join(matched.where("of IS NULL"), F.col("own") == F.col("digest"))
    found = named.select("digest", "matched", words().alias("words")).unionByName(nameless.select("digest", "matched", words().alias("words")))

    overlap = WINDOW_WORDS - 1
    found = found.select("digest", "matched", "words", F.explode(F.expr(f"sequence(0, size(words) - 1, {SEGMENT_WORDS})")).alias("base"))
    found = found.withColumn("words", F.slice("words", F.col("base") + 1, SEGMENT_WORDS + overlap))
    starts = []
    for n in lengths:
        size = K if n == WINDOW_WORDS else n
        rows = _with_grams(found, size, "grams")
        at = F.expr("IF(size(grams) > 0, filter(sequence(1, size(grams)), i -> array_contains(matched, grams[i - 1])), NULL)")
        rows = rows.withColumn("start", F.explode_outer(at)).where("start IS NOT NULL")
        if n == WINDOW_WORDS:  # every window that holds the k-gram
            rows = rows.withColumn("near", F.expr(f"sequence(greatest(start - {n - K}, 1), least(start, size(words) - {n} + 1))"))
            rows = rows.where(f"greatest(start - {n - K}, 1) <= least(start, size(words) - {n} + 1)")
            rows = rows.select("digest", "words", "base", F.explode("near").alias("start"))
        rows = rows.where(F.col("start") <= SEGMENT_WORDS)
        starts.append(rows.select("digest", (F.col("base") + F.col("start")).alias("start"), F.lit(n).alias("length"), _window("words", F.col("start"), n).alias("window")))
    hits = reduce(DataFrame.unionByName, starts).join(windows, "window").select("digest", "start", "length", "item_id")
    hits = settle(hits, "benchmark-hits")

    spans = hits.groupBy("digest", "start").agg(F.max("length").alias("length"))
    before = Window.partitionBy("digest").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("end", F.col("start") + F.col("length"))
    spans = spans.withColumn("covered", F.coalesce(F.max("end").over(before), F.lit(0)))
    n_hit = spans.groupBy("digest").agg(F.sum(F.greatest(F.col("end") - F.greatest("start", "covered"), F.lit(0))).cast("long").alias("n_hit"))
    named_items = hits.groupBy("digest").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    out = parsed.drop("prints").join(n_hit.join(named_items, "digest"), "digest", "left")
    n_hit, listed = F.coalesce("n_hit", F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "digest",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with all their columns; rows without an id stay.

    A row is judged by its own text, also where its id is repeated. Null and wordless texts stay. Without benchmark items all stay.
    """
    own, digest = fresh(docs, "contaminated_id", "contaminated_text")
    gone = _judged(docs, benchmark).where("contaminated AND doc_id IS NOT NULL").select(F.col("doc_id").alias(own), F.col("digest").alias(digest)).distinct()
    return docs.join(gone, (docs["doc_id"] == gone[own]) & (F.sha2(whole_text(), 256) == gone[digest]), "left_anti")
