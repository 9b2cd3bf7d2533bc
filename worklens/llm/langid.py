"""Language by cross-parsing entropy.

For each language a suffix automaton holds every substring of its labelled text. A text is cut, from left to right, into the
longest phrases that the automaton holds; the fewer phrases it needs, the closer it is to the language. Counts are normalised
by the bits that name a phrase, the logarithm of the length of the language's text, and the least sum wins.

Every letter of a language's text counts; letters that only other languages have are unseen there.

Texts are parsed side by side in numpy: whole texts are cut into segments, a step advances all segments of a batch by one
letter through a language's table of states and letters, and a phrase that is open at the end of a segment ends there, alike for all
languages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worklens.llm.common import held_out
from worklens.sources.staging import settle

#: The labelled text of a language: so many documents, those of the lowest hash, and so many letters and gaps of them.
TRAIN_DOCS = 64
TRAIN_LETTERS = 20_000
#: Cells of a language's table of states and letters at most; beyond that its transitions are looked up in order.
DENSE_CELLS = 1 << 24
SEGMENT = 512
BATCH_LETTERS = 1 << 21
UNKNOWN = "und"

_WORDS = re.compile(r"[^\W\d_]+")


def letters_only(text: str | None) -> str:
    """The words of the text in lower case with a gap around each."""
    words = _WORDS.findall((text or "").lower())
    return f" {' '.join(words)} " if words else ""


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts every substring of ``codes``."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


class Automaton:
    """Steps through the substrings of one language's text for many texts at once.

    A step gives the next state times two, plus one if the letter begins a phrase. Letters are numbered among all
    languages; 0 is a gap between words, the last number pads texts and leads to the start.
    """

    def __init__(self, codes: np.ndarray, numbers: int):
        moves = suffix_automaton(codes.tolist())
        mine = np.unique(codes)
        width = len(mine) + 2  # and one for letters unseen here, one for padding
        self.own = np.full(numbers, len(mine), np.int32)
        self.own[mine] = np.arange(len(mine))
        self.own[-1] = width - 1
        self.width = width
        begin = np.ones(width, np.int32)
        for c, to in moves[0].items():
            begin[self.own[c]] = to * 2 + 1
        begin[-1] = 0
        at = np.array([state * width + int(self.own[c]) for state, out in enumerate(moves) if state for c in out], np.int64)
        to = np.array([to * 2 for state, out in enumerate(moves) if state for to in out.values()], np.int32)
        self.table = None
        if len(moves) * width <= DENSE_CELLS:
            self.table = np.tile(begin, len(moves))
            self.table[at] = to
        else:
            order = np.argsort(at)
            self.begin, self.at, self.to = begin, at[order], to[order]

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[state * self.width + code]
        key = state.astype(np.int64) * self.width + code
        place = np.minimum(np.searchsorted(self.at, key), len(self.at) - 1)
        return np.where(self.at[place] == key, self.to[place], self.begin[code])


class Parser:
    """Phrase counts of texts in each language. ``samples``: (language, its labelled text as words with gaps)."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.languages = [name for name, _ in samples]
        letters = sorted(set("".join(text for _, text in samples)) - {" "})
        self.unseen, self.pad = len(letters) + 1, len(letters) + 2
        self.code = np.full(0x110000, self.unseen, np.int32)
        self.code[ord(" ")] = 0
        for i, c in enumerate(letters):
            self.code[ord(c)] = i + 1
        self.automata = [Automaton(self.codes(text), self.pad + 1) for _, text in samples]
        self.bits = [float(np.log2(max(2, len(text)))) for _, text in samples]

    def codes(self, text: str) -> np.ndarray:
        return self.code[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Number of phrases per text (rows) and language (columns). Texts are as ``letters_only`` gives them."""
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        at = 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) <= BATCH_LETTERS:
                size += len(texts[end])
                end += 1
            self._parse("".join(texts[at:end]), np.array([len(t) for t in texts[at:end]]), out[at:end])
            at = end
        return out

    def _parse(self, joined: str, sizes: np.ndarray, out: np.ndarray) -> None:
        segments = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(sizes)), segments)
        if not len(owner):
            return
        number = np.arange(len(owner)) - np.repeat(np.cumsum(segments) - segments, segments)
        start = np.repeat(np.cumsum(sizes) - sizes, segments) + number * SEGMENT
        size = np.minimum(SEGMENT, np.repeat(sizes, segments) - number * SEGMENT)
        order = np.argsort(-size, kind="stable")  # the longest first, so that those still running are a prefix
        start, size, owner = start[order], size[order], owner[order]
        codes = np.append(self.codes(joined), np.full(SEGMENT, self.pad, np.int32))
        running = len(size) - np.searchsorted(size[::-1], np.arange(SEGMENT), side="right")
        for i, automaton in enumerate(self.automata):
            own = automaton.own[codes]
            state, count = np.zeros(len(size), np.int32), np.zeros(len(size), np.int32)
            for t in range(int(size[0])):
                n = running[t]
                step = automaton.step(state[:n], own[start[:n] + t])
                count[:n] += step & 1
                state[:n] = step >> 1
            out[:, i] += np.bincount(owner, count, minlength=len(sizes)).astype(np.int64)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text, and a score: the runner-up's share of the best two sums, 1 if there is one language."""
        words = [letters_only(t) for t in texts]
        cost = self.phrases(words) * np.array(self.bits)
        best = np.argmin(cost, axis=1)
        low = cost[np.arange(len(cost)), best]
        cost[np.arange(len(cost)), best] = np.inf
        second = cost.min(axis=1)
        score = np.where(np.isinf(second), 1.0, second / np.maximum(np.where(np.isinf(second), 1.0, second) + low, 1e-9))
        some = np.array([bool(w) for w in words])
        return [self.languages[b] if s else UNKNOWN for b, s in zip(best, some)], np.where(some, score, 0.0)


@lru_cache(2)
def _parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    """The worker's parser for these samples, built once: the samples travel, not the tables."""
    return Parser(samples)


def _pieces(text: str | None, key: int, most: int) -> str:
    """At most ``most`` letters and gaps of a text, whole words from a place that the key chooses."""
    words = letters_only(text)
    if len(words) <= most:
        return words
    begin = words.index(" ", key % (len(words) - most))
    end = words.rindex(" ", 0, begin + most)
    return words[begin : end + 1] if end > begin else words[begin : begin + most]


def learn(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_letters: int = TRAIN_LETTERS) -> tuple[tuple[str, str], ...]:
    """Labelled text per language: of at most ``train_docs`` documents outside the held-out fold, equal shares of ``train_letters``.

    Documents are taken by the hash of their id; an id counts once, with one of its texts. From a long document a piece at a
    hashed place is taken; what short documents leave of their share goes to the others. Documents without an id, language or
    letter teach nothing. The driver gets ``train_docs`` pieces of ``train_letters`` for each language at most.
    """
    usable = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL").where(~held_out(F.col("doc_id"))).where(F.col("text").cast("string").rlike(r"\p{L}"))
    ids = usable.select("lang", F.col("doc_id").cast("long").alias("doc_id")).distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    # Each task sends its own first rows of a language only, so a language with most of the rows is no burden.
    chosen = settle(ids.withColumn("rank", rank).where(F.col("rank") <= train_docs), "language-samples")
    text = F.col("text").cast("string")
    named = usable.select("lang", F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("written"))
    # A text per id: an id that is repeated a million times comes in once.
    wanted = named.join(F.broadcast(chosen), ["lang", "doc_id"])
    least = wanted.groupBy("lang", "doc_id", "rank").agg(F.min(F.struct("written", "text")).alias("one"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["text"] = [_pieces(t, abs(int(k)), train_letters) for t, k in zip(batch["text"], batch["written"])]
            yield batch[["lang", "rank", "text"]]

    pieces = least.select("lang", "rank", "one.written", "one.text").mapInPandas(cut, "lang string, rank int, text string")
    texts: dict[str, list[tuple[int, str]]] = {}
    for r in pieces.collect():
        if r["text"]:
            texts.setdefault(r["lang"], []).append((r["rank"], r["text"]))
    samples = []
    for lang, rows in sorted(texts.items()):
        rest, shares = train_letters, {}
        for left, (k, t) in zip(range(len(rows), 0, -1), sorted(rows, key=lambda r: (len(r[1]), r[0]))):
            shares[k] = _pieces(t, 0, max(2, rest // left))
            rest -= len(shares[k])
        samples.append((lang, "".join(shares[k] for k in sorted(shares)).replace("  ", " ")))
    return tuple(samples)


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Null and letterless texts are ``und`` with score 0, as is everything if nothing could be learnt. Ties go to the first
    language by name. Repeated rows give repeated results, other columns are ignored, an empty table gives no rows.
    """
    samples = learn(docs) if samples is None else samples

    def predicted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if samples:
                names, score = _parser(samples).predict(batch["text"].tolist())
            else:
                names, score = [UNKNOWN] * len(batch), np.zeros(len(batch))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "lang_pred": names, "score": score})

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = rows.mapInPandas(predicted, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
