"""Weighted term vectors of texts: tokens, vocabulary, TF-IDF.

Texts are collapsed to distinct ones first, so a text copied a billion times is weighed once.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worklens.functions.scalars import clean_text
from worklens.functions.stopwords import ENGLISH
from worklens.params import Params
from worklens.sources.staging import settle

# Ship this module's functions to the workers themselves, so that workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def terms_of(cleaned: Column, stop_words: Sequence[str] = ENGLISH) -> Column:
    """Words of two or more characters without stop words, then the pairs of neighbours."""
    kept = F.filter(F.split(cleaned, " "), lambda w: (F.length(w) >= 2) & ~w.isin(list(stop_words)))
    pairs = F.when(
        F.size(kept) >= 2,
        F.zip_with(F.slice(kept, 1, F.size(kept) - 1), F.slice(kept, 2, F.size(kept) - 1), lambda a, b: F.concat_ws(" ", a, b)),
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(kept, pairs)


def text_key(cleaned: Column) -> Column:
    return F.unhex(F.md5(cleaned))


def distinct_texts(df: DataFrame, text: str) -> DataFrame:
    """One row per distinct cleaned text with its number of copies."""
    cleaned = clean_text(F.col(text))
    return (
        df.select(cleaned.alias("cleaned"))
        .groupBy(text_key(F.col("cleaned")).alias("text_key"), "cleaned")
        .agg(F.count(F.lit(1)).alias("copies"))
    )


def by_text(texts: DataFrame) -> DataFrame:
    """Texts spread by their key, so that counting and weighing their terms needs no further shuffle."""
    return texts.repartition("text_key")


def term_counts(texts: DataFrame, stop_words: Sequence[str] = ENGLISH) -> DataFrame:
    """(text_key, copies, term, tf). A text's terms are counted inside its row, so a task holds one text at a time."""
    ordered = texts.select("text_key", "copies", F.array_sort(terms_of(F.col("cleaned"), stop_words)).alias("_terms"))
    # Places, from 1, of each term's last one in order: a term's count is the way from the place before.
    size = F.size("_terms")
    places = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    last = F.zip_with("_terms", F.slice("_terms", 2, size), lambda a, b: b.isNull() | (a != b))
    marked = F.filter(F.zip_with(places, last, lambda i, end: F.struct(i.alias("i"), end.alias("end"))), lambda x: x["end"])
    ends = ordered.withColumn("_ends", F.transform(marked, lambda x: x["i"]))
    before = F.concat(F.array(F.lit(0)), F.slice("_ends", 1, F.size("_ends")))
    spans = F.filter(F.zip_with("_ends", before, lambda e, b: F.struct(e.alias("e"), (e - b).cast("long").alias("tf"))), lambda x: x["e"].isNotNull())
    counted = ends.select("text_key", "copies", "_terms", F.inline(spans))
    return counted.select("text_key", "copies", F.element_at("_terms", F.col("e")).alias("term"), "tf")


@dataclass(frozen=True)
class Vocabulary:
    """Terms with idf, numbered from rare to frequent; at most ``Params.vocabulary`` rows."""

    terms: DataFrame
    size: int
    documents: int


#: Characters of texts that a task counts or weighs at a time, about, and unknown words it remembers while weighing.
CHARACTERS = 4_000_000
REMEMBERED = 500_000


class Numbers(dict):
    """Numbers of words: those of ``known``, -1 for those that are no terms (short ones and stop words), ``new()`` for others."""

    def __init__(self, known: dict[str, int], stop: frozenset[str], new: Callable[[], int], most: float = math.inf):
        super().__init__(known)
        self.stop, self.new, self.most = stop, new, len(known) + most

    def __missing__(self, word: str) -> int:
        number = -1 if len(word) < 2 or word in self.stop else self.new()
        if len(self) < self.most:
            self[word] = number
        return number


def _numbered(texts: list[str], numbers: Numbers) -> tuple[np.ndarray, np.ndarray]:
    """The words of ``terms_of`` as numbers, text after text, and the place of each one's text."""
    words = " ".join(texts).split(" ")
    found = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    of = np.repeat(np.arange(len(texts)), [t.count(" ") + 1 for t in texts])
    return found[found >= 0], of[found >= 0]


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for two neighbours, larger than any word's: the first one's, from 1, stands above the second's."""
    return (a + 1 << 32) + b


def _parts(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[list[list]]:
    """The values of some columns, the first one a text, in lists with about ``CHARACTERS`` of it."""
    held, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(c) for c in columns)):
            held.append([x.as_py() for x in row])
            size += len(held[-1][0])
            if size > CHARACTERS:
                yield [list(x) for x in zip(*held)]
                held, size = [], 0
    if held:
        yield [list(x) for x in zip(*held)]


def _tally(stop: frozenset[str]):
    """Terms with (df, cf), each part of the texts on its own, so that a term may come more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, copies in _parts(batches, "cleaned", "copies"):
            numbers = Numbers({}, stop, itertools.count().__next__)
            word, of = _numbered(texts, numbers)
            names = [w for w, number in numbers.items() if number >= 0]
            near = np.flatnonzero(of[1:] == of[:-1])
            code, place = np.unique(np.concatenate([word, _pair(word[near], word[near + 1])]), return_inverse=True)
            each, tf = np.unique(place * len(texts) + np.concatenate([of, of[near]]), return_counts=True)
            term, n = each // len(texts), np.array(copies)[each % len(texts)]
            df, cf = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
            np.add.at(df, term, n)
            np.add.at(cf, term, n * tf)
            spelt = [names[b] if a == 0 else f"{names[a - 1]} {names[b]}" for a, b in zip((code >> 32).tolist(), (code & 0xFFFFFFFF).tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(spelt, pa.string()), pa.array(df), pa.array(cf)], names=["term", "df", "cf"])

    return run


def fit_vocabulary(texts: DataFrame, p: Params = Params(), stop_words: Sequence[str] = ENGLISH) -> Vocabulary:
    documents = texts.agg(F.sum("copies")).first()[0] or 0
    kept = (
        texts.select("copies", "cleaned")
        .mapInArrow(_tally(frozenset(stop_words)), "term string, df long, cf long")
        .groupBy("term")
        .agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        .where(F.col("df") >= p.min_df)
        .orderBy(F.desc("cf"), "term")
        .limit(p.vocabulary)
    )
    numbered = kept.select(
        "term",
        "df",
        "cf",
        F.row_number().over(Window.orderBy("df", "term")).alias("t"),  # bounded by the vocabulary size
        (F.log((F.lit(1.0) + F.lit(float(documents))) / (F.col("df") + 1.0)) + 1.0).alias("idf"),
    )
    terms = settle(numbered.coalesce(1), "vocabulary")
    return Vocabulary(terms, terms.count(), int(documents))


WEIGHED = "text_key binary, terms array<struct<t: int, tf: int, raw: double>>, norm double, tfidf_mean double, tfidf_max double, signature binary"


def _weigher(known: dict[str, int], idf: np.ndarray, size: float, stop: frozenset[str]):
    # Words that are terms or stand in one have a number from 1; all other words share 0, so that pairs with them are unknown.
    spelt = {term: [*term.split(" ")] for term in known}
    numbers = {word: i for i, word in enumerate(dict.fromkeys(w for words in spelt.values() for w in words), 1)}
    codes = np.array([numbers[w[0]] if len(w) == 1 else _pair(*(np.int64(numbers[x]) for x in w)) for w in spelt.values()], np.int64)
    order = np.argsort(codes)
    codes, at = codes[order], np.array([*known.values()], np.int64)[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Numbers(numbers, stop, int, REMEMBERED)
        for texts, keys in _parts(batches, "cleaned", "text_key"):
            word, of = _numbered(texts, mine)
            near = np.flatnonzero(of[1:] == of[:-1])
            code, of = np.concatenate([word, _pair(word[near], word[near + 1])]), np.concatenate([of, of[near]])
            place = np.searchsorted(codes, code)
            hit = np.flatnonzero(place < len(codes))
            hit = hit[codes[place[hit]] == code[hit]]
            each, tf = np.unique(of[hit] * len(idf) + at[place[hit]], return_counts=True)
            of, t = each // len(idf), each % len(idf)
            raw = tf * idf[t]
            begin = np.flatnonzero(np.diff(of, prepend=-1))
            ends = np.append(begin, len(of))
            rows = []
            for a, z in zip(begin.tolist(), ends[1:].tolist()):
                # Added up one after the other, from rare to frequent terms.
                norm, total = math.sqrt(np.cumsum(raw[a:z] * raw[a:z])[-1]), np.cumsum(raw[a:z])[-1]
                name = ",".join([f"{x}:{y}" for x, y in zip(t[a:z].tolist(), tf[a:z].tolist())])
                rows.append((keys[of[a]], norm, total / norm / size, raw[a:z].max() / norm, hashlib.md5(name.encode()).digest()))
            if rows:
                key, norms, means, largest, names = zip(*rows)
                terms = pa.StructArray.from_arrays([pa.array(t, pa.int32()), pa.array(tf, pa.int32()), pa.array(raw)], ["t", "tf", "raw"])
                columns = [pa.array(key, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), terms), *(pa.array(c, pa.float64()) for c in (norms, means, largest)), pa.array(names, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["text_key", "terms", "norm", "tfidf_mean", "tfidf_max", "signature"])

    return run


def weigh(texts: DataFrame, vocabulary: Vocabulary, stop_words: Sequence[str] = ENGLISH) -> DataFrame:
    """Per distinct text: terms as (t, tf, raw weight) from rare to frequent, norm, mean and max weight, signature.

    A text is weighed inside its row. The vocabulary is bounded, so sending it to the tasks is safe. Texts whose terms are equal
    share a signature; texts without a known term are left out.
    """
    rows = vocabulary.terms.select("term", "t", "idf").collect()
    idf = np.zeros(len(rows) + 1)
    for row in rows:
        idf[row["t"]] = row["idf"]
    known = {row["term"]: row["t"] for row in rows}
    run = _weigher(known, idf, float(max(vocabulary.size, 1)), frozenset(stop_words))
    return texts.select("text_key", "cleaned").mapInArrow(run, WEIGHED)


def signatures(weighed: DataFrame) -> DataFrame:
    """One vector per signature."""
    return weighed.groupBy("signature").agg(F.any_value("terms").alias("terms"), F.any_value("norm").alias("norm"))
