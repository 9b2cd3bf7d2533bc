"""Packing token sequences by vector bin packing.

An example asks for tokens, one segment, and loss-bearing tokens; a sequence offers ``limit``, ``max_segments`` and
``max_loss`` of them. A task holds a buffer of examples and fills one sequence after the other: of the examples that fit it
takes the one whose demand has the largest dot product with what is left of the sequence, all as shares of the sequence's
capacity. With ``split`` examples may be cut: when none fits, the best one is cut to what is left, and a sequence that can't be
filled is trimmed to a power of two and the rest goes back, so nothing is padded. Documents longer than a sequence fill whole
ones first.

No exchange is needed: each task packs the rows that it reads, and its few last sequences are trimmed as above.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

LIMIT = 2048
MAX_SEGMENTS = 128
#: Examples that a task chooses from.
BUFFER = 1024
#: Token ids of this many different pieces are kept in a worker.
PIECES_KEPT = 400_000
END_OF_DOCUMENT = 1

# The vocabulary's own way to cut a text, for texts in which it can be applied before the tokenizer: printable ASCII and Latin
# letters up to U+017E that neither composition nor context-dependent lower-casing touches. Fixed values of the vocabulary:
# contractions, runs of letters, single digits, runs of the rest.
_LATIN = re.compile("[\\t\\n\\r\\x20-\\x7e\\u00a1-\\u012f\\u0131-\\u0148\\u014a-\\u017e]*")
_LETTERS, _DIGITS = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u017e", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_PIECE = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[{_DIGITS}]|[^\\s{_LETTERS}{_DIGITS}]+")
# How the vocabulary writes bytes: printable ones as themselves, the others as letters from U+0100 on.
_PLAIN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
#: The vocabulary's white space. It is never part of a token and nothing composes with it, so texts are cut there.
_GAP = re.compile("[\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
#: Code points encoded at once, or as many more as it takes to the next white space.
PART = 1 << 18
_BYTES = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}


def parts_of(text: str, size: int = PART) -> Iterator[str]:
    """The whole text in pieces of at least ``size`` code points, cut after white space only."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + size - 1)
        end = gap.end() if gap else len(text)
        yield text[at:end]
        at = end


class WordTokenizer(dict):
    """Token ids of texts. A dict of the pieces met so far, each with its place in the table of ids.

    A piece of a Latin text is encoded once and looked up from then on; other texts go to the tokenizer as they are.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.flat, self.start, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.used = 0

    def __missing__(self, piece: str) -> int:
        written = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTES)
        ids = [token.id for token in self.tokenizer.model.tokenize(written)]
        number = len(self)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        if number == len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[number], self.size[number] = self.used, len(ids)
        self.used += len(ids)
        self[piece] = number
        return number

    def _ids(self, text: str) -> np.ndarray:
        if not _LATIN.fullmatch(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        if len(self) > PIECES_KEPT:
            self.clear()
        place = np.fromiter(map(self.__getitem__, _PIECE.findall(text.lower())), np.int64)
        if not len(place):
            return np.zeros(0, np.uint32)
        size = self.size[place]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.start[place] - ends + size, size) + np.arange(ends[-1])]

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of the whole text and the end of the document."""
        parts = [self._ids(part) for part in parts_of(text or "")]
        return np.concatenate([*parts, np.array([END_OF_DOCUMENT], np.uint32)])


_KEPT: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer, made once."""
    if path not in _KEPT:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _KEPT[path] = WordTokenizer(path)
    return _KEPT[path]


class Example:
    """What is left to place of a document: ids[start:]. The first ``no_loss`` ids of the document bear no loss."""

    __slots__ = ("doc_id", "ids", "start", "no_loss")

    def __init__(self, doc_id, ids: np.ndarray, no_loss: int):
        self.doc_id, self.ids, self.start, self.no_loss = doc_id, ids, 0, no_loss

    def loss(self, length: int) -> int:
        return max(0, self.start + length - max(self.start, self.no_loss))

    def demand(self) -> tuple[int, int, int]:
        n = len(self.ids) - self.start
        return n, 1, self.loss(n)

    def prefix(self, tokens: int, loss: int) -> int:
        """The longest prefix within both limits."""
        return min(tokens, len(self.ids) - self.start, max(0, self.no_loss - self.start) + loss)


class Packer:
    """Fills sequences from a buffer of examples; ``pieces`` gives what is placed."""

    def __init__(self, limit: int, max_segments: int, max_loss: int, split: bool, buffer: int, first_id: int):
        self.room = np.array([limit, max_segments, max_loss], np.int64)
        self.limit, self.split, self.buffer, self.next_id = limit, split, buffer, first_id
        self.examples: list[Example] = []
        self.demand = np.zeros((0, 3), np.int64)
        self.waiting: list[Example] = []

    def add(self, example: Example) -> Iterator[tuple]:
        while (n := len(example.ids) - example.start) > self.limit or (example.loss(n) > self.room[2]):
            yield from self._whole(example)
        self.waiting.append(example)
        if len(self.waiting) + len(self.examples) > self.buffer:
            self._settle()
            while len(self.examples) > self.buffer // 2:
                yield from self._fill()

    def end(self) -> Iterator[tuple]:
        self._settle()
        while self.examples:
            yield from self._fill()

    def _whole(self, example: Example) -> Iterator[tuple]:
        """A sequence of its own for the first part of a long example."""
        n = example.prefix(self.limit, int(self.room[2]))
        if n < self.limit and self.split:
            n = 1 << (n.bit_length() - 1)
        yield self._piece(example, n, 0)
        self.next_id += 1

    def _settle(self) -> None:
        if self.waiting:
            self.examples += self.waiting
            self.demand = np.concatenate([self.demand, [e.demand() for e in self.waiting]])
            self.waiting = []

    def _piece(self, example: Example, n: int, offset: int) -> tuple:
        piece = (example.doc_id, example.start, n, example.ids[example.start : example.start + n].astype("<u4").tobytes(), len(example.ids), self.next_id, offset, example.loss(n))
        example.start += n
        return piece

    def _fill(self) -> Iterator[tuple]:
        left = self.room.copy()
        open_ = np.ones(len(self.examples), bool)
        chosen: list[tuple[int, int]] = []
        while open_.any() and left[0] > 0 and left[1] > 0:
            worth = self.demand @ (left / self.room**2)
            fits = open_ & (self.demand <= left).all(axis=1)
            if fits.any():
                i = int(np.argmax(np.where(fits, worth, -1)))
                n = int(self.demand[i, 0])
            elif self.split:
                i = int(np.argmax(np.where(open_, worth, -1)))
                n = self.examples[i].prefix(int(left[0]), int(left[2]))
                if n <= 0:
                    break
            else:
                break
            chosen.append((i, n))
            open_[i] = False
            left -= (n, 1, self.examples[i].loss(n))
        size = int(self.limit - left[0])
        if self.split and size < self.limit:
            size = 1 << (size.bit_length() - 1)
        offset = 0
        for i, n in chosen:
            n = min(n, size - offset)
            if n > 0:
                yield self._piece(self.examples[i], n, offset)
                offset += n
        self.next_id += 1
        touched = [i for i, _ in chosen]
        self.demand[touched] = [self.examples[i].demand() for i in touched]
        kept = np.flatnonzero(self.demand[:, 0] > 0)
        if len(kept) < len(self.examples):
            self.examples, self.demand = [self.examples[i] for i in kept], self.demand[kept]


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def pack(
    docs: DataFrame,
    tokenizer: str,
    limit: int = LIMIT,
    max_segments: int = MAX_SEGMENTS,
    max_loss: int = LIMIT,
    prompt_tokens: str | None = None,
    split: bool = True,
    buffer: int = BUFFER,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32 bits), doc_tokens, sequence_id, offset, loss_tokens.

    ``tokenizer``: path of the vocabulary file on every machine. A document is its ids and an end mark; a null text is the mark
    alone. ``prompt_tokens``: a column with how many of the first ids bear no loss; the first id never does, as nothing comes
    before it. With ``split=False`` only documents beyond a sequence's limits are cut. A document's pieces are numbered by
    ``start``; ids of sequences are unique but not gapless. Repeated rows are packed as often as they occur, null ids are
    carried along, other columns are ignored, an empty table gives no rows.
    """
    if min(limit, max_segments, max_loss) < 1:
        raise ValueError("limits must be positive")
    prompt = F.col(prompt_tokens) if prompt_tokens else F.lit(0)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.greatest(F.coalesce(prompt.cast("long"), F.lit(0)), F.lit(1)).alias("no_loss"))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = word_tokenizer(tokenizer)
        packer = Packer(limit, max_segments, max_loss, split, buffer, TaskContext.get().partitionId() << 33)
        names = [x.split()[0] for x in PIECES.split(", ")]
        out: list[tuple] = []

        def frame() -> pd.DataFrame:
            made = pd.DataFrame(out, columns=names)
            made["doc_id"] = made["doc_id"].astype("Int64")
            out.clear()
            return made

        for batch in batches:
            for doc_id, text, no_loss in zip(batch["doc_id"].astype("Int64"), batch["text"], batch["no_loss"]):
                out.extend(packer.add(Example(doc_id, words.ids(text), int(no_loss))))
                if len(out) >= 2000:
                    yield frame()
        out.extend(packer.end())
        if out:
            yield frame()

    return rows.mapInPandas(packed, PIECES)


def with_checksum(pieces: DataFrame) -> DataFrame:
    """The pieces with ``ids_crc32`` in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")
