"""Exact duplicates by skew-safe combining, in DataFrame operations only.

Digests are counted first, on narrow rows. A text whose digest occurs once has no company, so only texts of repeated digests
travel. They meet in three steps: each task combines its own copies before the exchange, copies of a text are dealt by
(digest, salt) so that a text with a third of all rows is spread over ``SALTS`` groups, and the winners of the salts, at
most ``SALTS`` rows a text, are combined globally. Every step groups by the whole text next to its digest, so two texts
with one digest stay apart.

Texts of repeated digests are picked out where they are read, by their second hashes: up to ``BROADCAST_KEYS`` numbers are
broadcast, beyond that the rows are joined with them by shuffle. Rows find their group by digest. Groups of more than a thousandth of all rows, at most a thousand, are broadcast, and their
rows are dealt anywhere; others are joined, by shuffle where they are many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklens.llm.common import ascii_lower, find, fresh, whole_text
from worklens.sources.staging import settle

SALTS = 63
#: A group is large if it has more than one in this many of all rows; so many groups are large at most.
LARGE = 1000
#: Hashes broadcast at most, 8 bytes each.
BROADCAST_KEYS = 4_000_000


def salt_winners(texts: DataFrame) -> DataFrame:
    """(digest, text, salt) with the largest id and the number of rows. ``texts``: doc_id, text, digest, salt."""
    return texts.groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))


def combine(winners: DataFrame) -> DataFrame:
    """One row per text: digest, text, keep_id, group_size."""
    return winners.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def _keys(low: Column) -> Column:
    """Digest and second hash of a text."""
    return F.struct(F.unhex(F.sha2(low, 256)).alias("digest"), F.xxhash64(low).alias("second"))


def _split(rows: DataFrame, second: str, groups: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """Rows that surely have no group, and the others; None and all rows where the hashes are too many to broadcast."""
    if groups.count() > BROADCAST_KEYS:
        return None, rows
    hashes = F.broadcast(groups.select(F.col("key.second").alias(second)).distinct())
    return rows.join(hashes, second, "left_anti"), rows.join(hashes, second, "left_semi")


def _digests(docs: DataFrame) -> DataFrame:
    low = ascii_lower(whole_text())
    rows = docs.select("doc_id", F.xxhash64("text").alias("written"), _keys(low).alias("key"), F.monotonically_increasing_id().alias("number"))
    return settle(rows, "digests")


def repeated_texts(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """One row per text that occurs twice or more: key, n, keep_id, keep_written, ties (rows with both of these) and
    keep_number, one of the ties."""
    rows = digests.groupBy("key", "doc_id", "written").agg(F.count(F.lit(1)).alias("m"), F.min("number").alias("number"))
    # Of equal ids the row whose text as written hashes lowest.
    best = F.max(F.struct("doc_id", F.bitwise_not("written").alias("unwritten"), F.col("m").alias("ties"), "number"))
    narrow = rows.groupBy("key").agg(F.sum("m").alias("n"), best.alias("best")).where("n > 1")
    narrow = settle(narrow, "repeated-digests")

    low = ascii_lower(whole_text())
    texts = docs.select("doc_id", low.alias("text"), F.xxhash64(low).alias("second"), F.monotonically_increasing_id().alias("number"))
    _, texts = _split(texts, "second", narrow)
    texts = texts.withColumn("key", F.struct(F.unhex(F.sha2("text", 256)).alias("digest"), "second"))
    if narrow.count() > BROADCAST_KEYS:
        texts = find(texts, ["key"], narrow, max(digests.count() // LARGE, 1), "found").where("found IS NOT NULL")
    salt = F.pmod(F.xxhash64("number"), F.lit(SALTS)).cast("int").alias("salt")
    whole = combine(salt_winners(texts.select("doc_id", "text", F.col("key").alias("digest"), salt)))
    whole = whole.groupBy(F.col("digest").alias("key")).agg(F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("size"))
    size = F.when(F.col("texts") == 1, F.col("size")).otherwise(F.raise_error(F.lit("two texts share both digests")).cast("long"))
    out = narrow.join(whole, "key").select(
        "key", size.alias("n"), "keep_id", F.bitwise_not("best.unwritten").alias("keep_written"), F.col("best.ties").alias("ties"), F.col("best.number").alias("keep_number")
    )
    return settle(out, "repeated-texts")


def assignments(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; the largest id of equal texts stays. A null text counts as
    empty. Rows with a null id are members too and are kept only if no equal text has an id. If the row that stays is
    repeated (same id, equal text), one of the repetitions is kept, the one whose text as written hashes lowest. Should two
    texts ever share both a SHA-256 and a second hash, the query ends with an error instead of a wrong group. Other
    columns are ignored. An empty table gives no rows.
    """
    digests = _digests(docs)
    out = find(digests, ["key"], repeated_texts(docs, digests), max(digests.count() // LARGE, 1), "found")
    alone = F.col("found").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("found.keep_id")).alias("keep_id"),
        F.coalesce("found.n", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("number") == F.col("found.keep_number"))).alias("kept"),
        F.lower(F.hex("key.digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents that ``assignments`` keeps, with all their columns.

    Null texts count as empty, so one of all null and empty texts stays; rows without an id go if an equal text has one;
    of rows that repeat id and text one stays, any if only other columns differ. Columns of any name are kept as they
    are; an empty table gives an empty table.
    """
    digests = _digests(docs)
    groups = repeated_texts(docs, digests)
    key, second, number, found, salt, doc = fresh(docs, "text_key", "text_second", "text_number", "text_group", "text_salt", "doc")
    low = ascii_lower(whole_text())
    columns = [F.col(f"`{c}`") for c in docs.columns]
    alone, rows = _split(docs.withColumn(second, F.xxhash64(low)), second, groups)
    rows = rows.withColumns({key: F.struct(F.unhex(F.sha2(low, 256)).alias("digest"), F.col(second).alias("second")), number: F.monotonically_increasing_id()})
    rows = find(rows, [key], groups.withColumnRenamed("key", key), max(digests.count() // LARGE, 1), found)
    own = F.col("doc_id").eqNullSafe(F.col(found)["keep_id"]) & (F.xxhash64("text") == F.col(found)["keep_written"])
    rows = rows.where(F.col(found).isNull() | own)
    once = F.col(found).isNull() | (F.col(found)["ties"] == 1)
    out = rows.where(once).select(*columns)
    if alone is not None:
        out = out.unionByName(alone.select(*columns))
    if groups.where("ties > 1").isEmpty():
        return out
    # Repetitions of the row that stays: one of them by salt, then one of all.
    more = rows.where(~once).select(F.col(key).alias(key), F.pmod(F.xxhash64(number), F.lit(SALTS)).alias(salt), F.struct(*columns).alias(doc))
    more = more.groupBy(key, salt).agg(F.any_value(doc).alias(doc)).groupBy(key).agg(F.any_value(doc).alias(doc))
    return out.unionByName(more.select(*[F.col(doc)[c].alias(c) for c in docs.columns]))
