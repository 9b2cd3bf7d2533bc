"""Toxicity from subword bags.

A word is the bag of its character n-grams, with marks at its ends. The n-grams' vectors are averaged and go through a linear
softmax; vectors and softmax are trained jointly in numpy in one task, so a misspelt or unseen word scores by the n-grams it
shares. A text's evidence is that of its most toxic word: one insult in a long text counts as much as in a short one. In
training the words of a text are pooled by a softmax that sharpens from epoch to epoch. A logistic fit on texts left out of
training turns the evidence into a probability.

Training uses about ``train_toxic`` and ``train_clean`` labelled documents, those with the lowest hash of their id outside
the held-out fold. Scoring needs one number per n-gram bucket, so a task carries a table of ``BUCKETS`` floats.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.llm.common import held_out, lowest_hashes

BUCKETS = 1 << 18
SIZES = (3, 4, 5)
DIMENSIONS = 8
TRAIN_TOXIC = 1500
TRAIN_CLEAN = 2500
#: Code points hashed at once.
CHUNK = 1 << 20


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """The whole text in pieces of about ``size`` code points, cut at spaces where there are any."""
    at = 0
    while at < len(text):
        end = len(text) if len(text) - at <= size else text.rfind(" ", at + 1, at + size) + 1 or at + size
        yield text[at:end]
        at = end


def word_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams, the number of the word that each belongs to, and the text that each word belongs to.

    Words are runs of letters, lower-cased; the mark between two words takes part in the n-grams at their ends.
    """
    lower = [text.lower() for text in texts]
    codes = np.frombuffer(f" {' '.join(lower)} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_letters()[codes], codes, np.uint32(0))
    begins = (codes[1:] != 0) & (codes[:-1] == 0)
    ends = np.cumsum([len(t) + 1 for t in lower])
    words = np.diff(np.concatenate([[0], np.cumsum(begins)[ends - 1]]))
    codes = codes[(codes != 0) | np.append(True, codes[:-1] != 0)]  # one mark between words
    gap = np.cumsum(codes == 0)
    grams, owner = [], []
    key = codes * np.uint32(0x9E3779B1)
    rolled = key[:-1] * np.uint32(31) + key[1:]
    for n in range(3, max(SIZES) + 1):
        rolled = rolled[: max(len(codes) - n + 1, 0)] * np.uint32(31) + key[n - 1 :]
        if n in SIZES and len(rolled):
            whole = gap[n - 2 : len(codes) - 1] == gap[: len(codes) - n + 1]  # no mark inside
            grams.append((((rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x85EBCA77)) >> np.uint32(14))[whole] % np.uint32(BUCKETS))
            owner.append(gap[: len(codes) - n + 1][whole] - 1)
    text_of = np.repeat(np.arange(len(texts)), words)
    if not grams:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), text_of
    return np.concatenate(grams), np.concatenate(owner), text_of


@dataclass
class ToxicityModel:
    gram_margin: np.ndarray  #: toxic minus clean logit of each n-gram's vector
    bias: float
    slope: float  #: of the logistic fit
    offset: float

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """Margin of each text's most toxic word; minus infinity without words."""
        best = np.full(len(texts), -np.inf)
        pieces = [(i, part) for i, text in enumerate(texts) for part in chunks(text or "")]
        at = 0
        while at < len(pieces):
            end, size = at + 1, len(pieces[at][1])
            while end < len(pieces) and size + len(pieces[end][1]) <= CHUNK:
                size += len(pieces[end][1])
                end += 1
            grams, owner, text_of = word_grams([part for _, part in pieces[at:end]])
            if len(grams):
                margin = np.bincount(owner, self.gram_margin[grams]) / np.bincount(owner)
                np.maximum.at(best, np.array([i for i, _ in pieces[at:end]])[text_of], margin + self.bias)
            at = end
        return best

    def probability(self, texts: list[str | None]) -> np.ndarray:
        z = self.evidence(texts)
        return 1 / (1 + np.exp(-np.clip((self.slope * z if self.slope else np.zeros(len(z))) + self.offset, -700, 700)))


def _numbered(texts: Iterator[str]) -> tuple[list[str], list[np.ndarray]]:
    """The different words of all texts, and each text as numbers of its words."""
    number: dict[str, int] = {}
    rows = [np.array([number.setdefault(w, len(number)) for w in text.split()], np.int32) for text in texts]
    return list(number), rows


def _bags(words: list[str], at_once: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' n-grams one word after the other, and how many each word has."""
    grams, sizes = [], []
    for at in range(0, len(words), at_once):
        part = words[at : at + at_once]
        bucket, owner, _ = word_grams(part)
        grams.append(bucket[np.argsort(owner, kind="stable")].astype(np.int32))
        sizes.append(np.bincount(owner, minlength=len(part)).astype(np.int32))
    return np.concatenate(grams), np.concatenate(sizes)


def fit(texts: list[str], toxic: np.ndarray, clean_weight: float = 1.0, epochs: int = 6, batch: int = 128, rate: float = 0.3) -> ToxicityModel:
    """Train on the distinct words of each text, given with spaces between. ``clean_weight``: how many clean texts each one of the sample stands for."""
    kept = [i for i, words in enumerate(texts) if words]
    texts, toxic = [texts[i] for i in kept], toxic[kept].astype(float)
    if not len(toxic) or toxic.min() == toxic.max():  # nothing to tell apart
        share = float(toxic.mean()) if len(toxic) else 0.0
        return ToxicityModel(np.zeros(BUCKETS), 0.0, 0.0, 10 * (2 * share - 1) if len(toxic) else 0.0)
    rng = np.random.default_rng(0)
    vocabulary, rows = _numbered(texts)
    grams, n_grams = _bags(vocabulary)
    del vocabulary
    first = np.concatenate([[0], np.cumsum(n_grams)[:-1]])
    vectors = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    softmax = rng.normal(0, 0.1, (DIMENSIONS, 2))
    bias = np.zeros(2)
    seen_v, seen_s, seen_b = np.full((BUCKETS, 1), 1e-6), np.full_like(softmax, 1e-6), np.full(2, 1e-6)
    balance = (toxic == 0).sum() / (toxic == 1).sum()
    learn = np.flatnonzero(np.arange(len(toxic)) % 5 != 0)  # a fifth is left for the logistic fit

    def word_vectors(used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = n_grams[used]
        at = np.repeat(first[used] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        return grams[at], n, np.add.reduceat(vectors[grams[at]], starts, axis=0) / n[:, None]

    for epoch in range(epochs):
        sharp = 0.5 * 2.0 ** min(epoch, 4)
        for part in np.array_split(rng.permutation(learn), max(1, len(learn) // batch)):
            used, place = np.unique(np.concatenate([rows[i] for i in part]), return_inverse=True)
            text = np.repeat(np.arange(len(part)), [len(rows[i]) for i in part])
            starts = np.concatenate([[0], np.cumsum([len(rows[i]) for i in part])[:-1]])
            bucket, n, vector = word_vectors(used)
            logits = vector @ softmax + bias
            margin = (logits[:, 1] - logits[:, 0])[place]
            pull = np.exp(sharp * (margin - np.maximum.reduceat(margin, starts)[text]))
            pull /= np.add.reduceat(pull, starts)[text]
            pooled = np.add.reduceat(pull * margin, starts)
            y = toxic[part]
            error = (1 / (1 + np.exp(-pooled)) - y) * np.where(y == 1, balance, 1.0) / len(part)
            word_error = np.bincount(place, pull * error[text], minlength=len(used))
            both = np.stack([-word_error, word_error], axis=1)
            step_s, step_b = vector.T @ both, both.sum(axis=0)
            step = np.repeat((both @ softmax.T) / n[:, None], n, axis=0)
            hit, where = np.unique(bucket, return_inverse=True)
            total = np.stack([np.bincount(where, step[:, d], minlength=len(hit)) for d in range(DIMENSIONS)], axis=1)
            seen_v[hit] += (total**2).sum(axis=1, keepdims=True)
            vectors[hit] -= rate * total / np.sqrt(seen_v[hit])
            seen_s += step_s**2
            seen_b += step_b**2
            softmax -= 0.1 * rate * step_s / np.sqrt(seen_s)
            bias -= 0.1 * rate * step_b / np.sqrt(seen_b)
    model = ToxicityModel(vectors @ (softmax[:, 1] - softmax[:, 0]), float(bias[1] - bias[0]), 1.0, 0.0)
    model.slope, model.offset = _calibrate(model, texts, toxic, np.setdiff1d(np.arange(len(toxic)), learn), clean_weight)
    return model


def _calibrate(model: ToxicityModel, texts: list[str], toxic: np.ndarray, left: np.ndarray, clean_weight: float) -> tuple[float, float]:
    """Slope and offset of a logistic fit of the label on the evidence, by damped Newton steps."""
    x = model.evidence([texts[i] for i in left])
    y = toxic[left]
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    weight = np.where(y == 1, 1.0, clean_weight)
    mean, spread = x.mean(), x.std() + 1e-9
    design = np.stack([(x - mean) / spread, np.ones(len(x))], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        slope = design.T @ (weight * (p - y)) + 1e-2 * beta
        curve = (design * (weight * p * (1 - p) + 1e-9)[:, None]).T @ design + 1e-2 * np.eye(2)
        move = np.linalg.solve(curve, slope)
        beta -= move / max(1.0, np.abs(move).max())
    return float(beta[0] / spread), float(beta[1] - beta[0] * mean / spread)


def _distinct_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        words = [" ".join(sorted({w for w in "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()})) for t in batch["text"]]
        yield pd.DataFrame({"toxic": batch["toxic"], "words": words})


def train(docs: DataFrame, labels: DataFrame, train_toxic: int = TRAIN_TOXIC, train_clean: int = TRAIN_CLEAN) -> ToxicityModel:
    """Fit on a bounded sample of the labelled documents outside the held-out fold.

    Of each label those ids are taken whose hash lies below the share that gives the wanted number. Labels without a value and
    documents without an id teach nothing. Contradicting labels of a document all count.
    """
    marked = docs.select("doc_id").where("doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    marked = marked.join(labels.where("toxic IN (0, 1)").select("doc_id", "toxic"), "doc_id")
    size = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    most = {1: train_toxic, 0: train_clean}
    wanted = [lowest_hashes(F.col("doc_id"), size.get(v, 0), most[v]) & (F.col("toxic") == v) for v in most]
    # About train_toxic + train_clean rows, and never twice as many.
    chosen = marked.where(wanted[0] | wanted[1]).distinct().limit(2 * (train_toxic + train_clean))
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    words = sample.select("text", "toxic").mapInPandas(_distinct_words, "toxic int, words string")
    weight = max(1.0, size.get(0, 0) / train_clean)

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"toxic": [], "words": []}), *batches])
        rows = rows.sort_values(["toxic", "words"], ignore_index=True).sample(frac=1.0, random_state=1)
        m = fit(rows["words"].tolist(), rows["toxic"].to_numpy(), weight)
        yield pd.DataFrame({"margin": [m.gram_margin.astype("<f4").tobytes()], "bias": [m.bias], "slope": [m.slope], "offset": [m.offset]})

    # The bounded sample is fitted in one task; a number per bucket comes back.
    m = words.repartition(1).mapInPandas(fitted, "margin binary, bias double, slope double, offset double").first()
    if m is None:  # no labelled row reached the task
        return fit([], np.zeros(0))
    return ToxicityModel(np.frombuffer(bytes(m["margin"]), "<f4"), m["bias"], m["slope"], m["offset"])


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, predicted of each document. Null, empty and letterless texts score as clean as can be: 0."""

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p = model.probability(batch["text"].tolist())
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": p, "predicted": (p >= 0.5).astype("int32")})

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInPandas(scored, "doc_id long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 if score >= 0.5).

    Repeated rows give repeated results. Without labels of both kinds the score is that of the only kind, 0.5 without any.
    Other columns are ignored; an empty table gives no rows.
    """
    return score(docs, train(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't predicted toxic, with all their columns.

    Null, empty and letterless texts stay; rows that repeat an id are judged each by its own text; without labels of both kinds
    all have the score of the only kind, and an empty table gives an empty table.
    """
    model = train(docs, labels)
    judged = F.pandas_udf(lambda texts: pd.Series(model.probability(texts.tolist()) >= 0.5), "boolean")
    return docs.where(~judged(F.col("text").cast("string")))
