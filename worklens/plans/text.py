"""Text features of works and the similarity results built on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.functions.scalars import block_key, char_count, clean_text, rounded, word_count
from worklens.operators.similarity import best_matches, pairs_above
from worklens.operators.vectors import Vocabulary, by_text, distinct_texts, fit_vocabulary, signatures, text_key, weigh
from worklens.params import Params
from worklens.sources.staging import settle

TEXT_COLUMNS = [
    "work_id", "project_status", "state", "constituency", "description_length", "word_count", "tfidf_mean",
    "tfidf_max", "nearest_similarity_score", "similar_project_count",
]


@dataclass(frozen=True)
class Corpus:
    """Settled text tables of a set of works."""

    vocabulary: Vocabulary
    weighed: DataFrame  # text_key, terms, norm, tfidf_mean, tfidf_max, signature
    vectors: DataFrame  # signature, terms, norm
    members: DataFrame  # block, signature, copies, first_id
    places: DataFrame  # block, text_key, copies, first_id


def keyed(works: DataFrame) -> DataFrame:
    return works.withColumns(
        {
            "text_key": text_key(clean_text(F.col("work_description"))),
            "block": block_key(F.col("state"), F.col("constituency")),
        }
    )


def build_corpus(works: DataFrame, p: Params = Params()) -> Corpus:
    texts = settle(distinct_texts(works, "work_description"), "texts")
    vocabulary = fit_vocabulary(texts, p)
    weighed = settle(weigh(texts, vocabulary), "weighed")
    vectors = settle(signatures(weighed), "vectors")
    places = keyed(works).groupBy("block", "text_key").agg(
        F.count(F.lit(1)).alias("copies"), F.min("work_id").alias("first_id")
    )
    places = settle(places, "places")
    members = (
        places.join(weighed.select("text_key", "signature"), "text_key")
        .groupBy("block", "signature")
        .agg(F.sum("copies").alias("copies"), F.min("first_id").alias("first_id"))
    )
    return Corpus(vocabulary, weighed, vectors, settle(members, "members"), places)


def block_vectors(corpus: Corpus) -> DataFrame:
    return corpus.members.join(corpus.vectors, "signature")


def nearest_in_block(corpus: Corpus, p: Params = Params()) -> DataFrame:
    """Highest similarity to another work of the block, per (block, signature). Copies have 1."""
    base = settle(block_vectors(corpus).withColumns({"id": F.monotonically_increasing_id(), "tie": F.lit(0).cast("long")}), "block-vectors")
    best = best_matches(base.where(F.col("copies") == 1), base, "block", 1, exclude_self=True)
    named = best.join(base.select(F.col("id").alias("q"), "block", "signature"), "q")
    return (
        corpus.members.join(named.select("block", "signature", "score"), ["block", "signature"], "left")
        .select(
            "block",
            "signature",
            F.when(F.col("copies") > 1, 1.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("nearest_similarity_score"),
        )
    )


def similar_groups(corpus: Corpus, p: Params = Params()) -> DataFrame:
    """Pairs of different texts of a block at or above the threshold, with the copies of each side.

    With the members of each side this is every similar pair, without writing out the pairs of copies.
    """
    pairs = pairs_above(block_vectors(corpus), "block", p.similar_at)
    size = corpus.members
    return pairs.join(
        size.select("block", F.col("signature").alias("s1"), F.col("copies").alias("copies_1")), ["block", "s1"]
    ).join(size.select("block", F.col("signature").alias("s2"), F.col("copies").alias("copies_2")), ["block", "s2"])


def similar_counts(corpus: Corpus, groups: DataFrame) -> DataFrame:
    """Number of other works of the block at or above the threshold, per (block, signature)."""
    sides = groups.select("block", F.col("s1").alias("signature"), F.col("copies_2").alias("n")).unionByName(
        groups.select("block", F.col("s2").alias("signature"), F.col("copies_1").alias("n"))
    )
    own = corpus.members.select("block", "signature", (F.col("copies") - 1).alias("n"))
    return sides.unionByName(own).groupBy("block", "signature").agg(F.sum("n").cast("int").alias("similar_project_count"))


def similar_pair_totals(corpus: Corpus, groups: DataFrame) -> DataFrame:
    """Number of similar pairs of works per block, counted without writing them out."""
    across = groups.select("block", (F.col("copies_1") * F.col("copies_2")).alias("pairs"))
    n = F.col("copies")
    inside = corpus.members.where(n > 1).select("block", F.floor(n * (n - 1) / 2).alias("pairs"))
    return across.unionByName(inside).groupBy("block").agg(F.sum("pairs").alias("pairs"))


def with_text(works: DataFrame, p: Params = Params(), corpus: Corpus | None = None, source: DataFrame | None = None) -> DataFrame:
    corpus = corpus or build_corpus(works if source is None else source, p)
    per_block = settle(
        nearest_in_block(corpus, p).join(
            similar_counts(corpus, similar_groups(corpus, p)), ["block", "signature"], "left"
        ),
        "text-matches",
    )
    df = keyed(works).join(corpus.weighed.select("text_key", "signature", "tfidf_mean", "tfidf_max"), "text_key", "left")
    df = df.join(per_block, ["block", "signature"], "left")
    return df.withColumns(
        {
            "description_length": char_count(F.col("work_description")),
            "word_count": word_count(F.col("work_description")),
            "tfidf_mean": F.coalesce("tfidf_mean", F.lit(0.0)),
            "tfidf_max": F.coalesce("tfidf_max", F.lit(0.0)),
            "nearest_similarity_score": F.coalesce("nearest_similarity_score", F.lit(0.0)),
            "similar_project_count": F.coalesce("similar_project_count", F.lit(0)),
        }
    ).drop("text_key", "signature", "block")


def text_features(works: DataFrame, p: Params = Params()) -> DataFrame:
    return with_text(works, p).select(*TEXT_COLUMNS)


def similar_text_pairs(works: DataFrame, corpus: Corpus, groups: DataFrame) -> DataFrame:
    """Similar pairs of works in a block, complete without writing out the pairs of copies.

    Works of a block whose texts have one vector are represented by the one with the lowest id. ``relation`` is ``similar`` for pairs of
    representatives (``copies_1``, ``copies_2``: how many works each stands for), and ``member`` for a representative and each
    other work it stands for, with a score of 1. Any two works behind a similar pair, and any two members, are similar.
    """
    shown = ["work_id", "work_description", "mp_name", "state", "constituency"]
    placed = keyed(works).join(corpus.weighed.select("text_key", "signature"), "text_key").select("block", "signature", F.struct(*shown).alias("f"))
    placed = settle(placed, "placed-works")
    faces = placed.groupBy("block", "signature").agg(F.min("f").alias("f"), F.count(F.lit(1)).alias("copies"))
    faces = settle(faces, "representatives")
    left = faces.select("block", F.col("signature").alias("s1"), F.col("f").alias("f1"))
    right = faces.select("block", F.col("signature").alias("s2"), F.col("f").alias("f2"))
    both = groups.join(left, ["block", "s1"]).join(right, ["block", "s2"])
    swap = F.col("f1.work_id") > F.col("f2.work_id")
    similar = both.select(
        F.lit("similar").alias("relation"),
        F.when(swap, F.col("f2")).otherwise(F.col("f1")).alias("a"),
        F.when(swap, F.col("f1")).otherwise(F.col("f2")).alias("b"),
        "score",
        F.when(swap, F.col("copies_2")).otherwise(F.col("copies_1")).alias("copies_1"),
        F.when(swap, F.col("copies_1")).otherwise(F.col("copies_2")).alias("copies_2"),
    )
    heads = faces.where("copies > 1").select("block", "signature", F.col("f").alias("a"), "copies")
    members = placed.join(heads, ["block", "signature"]).where(F.col("f.work_id") != F.col("a.work_id"))
    members = members.select(F.lit("member").alias("relation"), "a", F.col("f").alias("b"), F.lit(1.0).alias("score"), F.col("copies").alias("copies_1"), F.col("copies").alias("copies_2"))
    return similar.unionByName(members).select(
        "relation",
        F.col("a.work_id").alias("work_id_1"),
        F.col("b.work_id").alias("work_id_2"),
        F.col("a.constituency").alias("constituency"),
        F.col("a.state").alias("state"),
        F.col("a.mp_name").alias("mp_name"),
        F.col("a.work_description").alias("description_1"),
        F.col("b.work_description").alias("description_2"),
        rounded(F.col("score"), 4).alias("similarity_score"),
        "copies_1",
        "copies_2",
    )


def similar_to(works: DataFrame, asked: DataFrame, corpus: Corpus, groups: DataFrame) -> DataFrame:
    """All similar works of the asked works (column ``work_id``), one row per match."""
    placed = keyed(works).join(corpus.weighed.select("text_key", "signature"), "text_key")
    of = placed.join(asked.select("work_id").distinct(), "work_id", "left_semi").select(
        F.col("work_id").alias("asked_id"), "block", "signature"
    )
    either = groups.select("block", F.col("s1").alias("signature"), F.col("s2").alias("other"), "score").unionByName(
        groups.select("block", F.col("s2").alias("signature"), F.col("s1").alias("other"), "score")
    )
    own = of.select("block", "signature", F.col("signature").alias("other"), F.lit(1.0).alias("score")).distinct()
    links = either.unionByName(own)
    found = of.join(links, ["block", "signature"]).select("asked_id", "block", F.col("other").alias("signature"), "score")
    return (
        found.join(placed.select("block", "signature", "work_id", "work_description"), ["block", "signature"])
        .where(F.col("asked_id") != F.col("work_id"))
        .select("asked_id", "work_id", "work_description", rounded(F.col("score"), 4).alias("similarity_score"))
    )


def match_texts(asked: DataFrame, key: str, text: str, corpus: Corpus, k: int, p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """Score new texts with the stored vocabulary.

    Returns (``key``, signature, tfidf_mean, tfidf_max) of the asked rows and, per asked signature, its k
    best corpus signatures. Asked texts are collapsed to distinct ones first.
    """
    texts = by_text(distinct_texts(asked, text))
    weighed = settle(weigh(texts, corpus.vocabulary), "asked-weighed")
    of = asked.select(key, text_key(clean_text(F.col(text))).alias("text_key")).join(
        weighed.select("text_key", "signature", "tfidf_mean", "tfidf_max"), "text_key", "left"
    )
    probe = settle(signatures(weighed).select("*", F.lit(0).alias("block"), F.monotonically_increasing_id().alias("id")), "asked-vectors")
    base = history_vectors(corpus)
    best = best_matches(probe, base, "block", k, exclude_self=False)
    best = best.join(probe.select(F.col("id").alias("q"), "signature"), "q").join(base.select(F.col("id").alias("d"), F.col("signature").alias("match")), "d")
    return of.drop("text_key"), best.select("signature", "match", "score", "rank")


def history_vectors(corpus: Corpus) -> DataFrame:
    """All vectors of the corpus as one block; ``tie``: equal scores go to the text with the lowest work id."""
    first = corpus.members.groupBy("signature").agg(F.min("first_id").alias("tie"))
    base = corpus.vectors.join(first, "signature").select("*", F.lit(0).alias("block"), F.monotonically_increasing_id().alias("id"))
    return settle(base, "history-vectors")
