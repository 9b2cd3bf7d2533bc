"""Chat formatting by incremental rendering of a template that is treated as a black box.

A template is a function from a list of messages to a string. For each turn the prefix that ends before it and the prefix that
ends with it are rendered; if the later output starts with the earlier one, what it adds is the turn's span, and the place of
the text inside it is found by rendering the turn once more with a mark for its text. If not, the template rewrites history at
that turn, and the turn is reported so.

A template may say how many turns it looks back. Then prefixes start that many turns before the turn, so the work for a
conversation grows with its length and not with its square; without that, prefixes start with the first turn. Rows stream
through a task in the order of conversation and turn, and only the turns that the template looks back to are held.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Message = dict[str, str]


@dataclass(frozen=True)
class Template:
    render: Callable[[list[Message]], str]
    escape: Callable[[str], str]  #: how a text appears in the output
    look_back: int | None = None  #: turns before a turn that its output depends on; None: all


# -- the template of the registered query ---------------------------------------------------------------------------------

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: str) -> str:
    r"""No ``<|`` is left: ``<``, any backslashes, ``|`` get one backslash more."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def _render(messages: list[Message]) -> str:
    return "".join(f"{START}{escape_role(m['role'])}\n{escape(m['text'])}{END}\n" for m in messages)


MARKED = Template(_render, escape, look_back=1)


class Reader:
    """Reads turns back from formatted text that comes in pieces."""

    def __init__(self) -> None:
        self.rest = ""

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        self.rest += piece
        while (end := self.rest.find(END + "\n")) >= 0:
            turn, self.rest = self.rest[:end], self.rest[end + len(END) + 1 :]
            if not turn.startswith(START) or "\n" not in turn:
                raise ValueError("not the output of this template")
            role, text = turn[len(START) :].split("\n", 1)
            yield unescape_role(role), unescape(text)


# -- the operator -----------------------------------------------------------------------------------------------------------


def _text_place(template: Template, before: list[Message], turn: Message, prefix: str, piece: str) -> tuple[int, int] | None:
    """Where the turn's text stands in its piece. The turn is rendered with a mark in place of its text, whose ends show
    how much comes before and after it. None if the template shows the text in another way."""
    shown = template.escape(turn["text"])
    mark = "mark"
    probe = template.render([*before, turn | {"text": mark}])
    at = probe.find(mark, len(prefix)) - len(prefix) if probe.startswith(prefix) else -1
    if at >= 0 and piece[at : at + len(shown)] == shown:
        return at, at + len(shown)
    return None


def turn_spans(template: Template, turns: Iterator[Message], loss_roles: tuple[str, ...]) -> Iterator[dict]:
    """One dict per turn: its piece of the output, its offsets in the whole, and whether it bears loss."""
    held: list[Message] = []
    offset = len(template.render([]))
    for position, turn in enumerate(turns):
        before = held if template.look_back is None else held[len(held) - min(template.look_back, len(held)) :]
        earlier, later = template.render(before), template.render([*before, turn])
        rewrites = not later.startswith(earlier)
        if rewrites:  # what both outputs share is kept, the rest is this turn's
            same = next((i for i, (a, b) in enumerate(zip(earlier, later)) if a != b), min(len(earlier), len(later)))
            earlier = later[:same]
        piece = later[len(earlier) :]
        place = None if rewrites else _text_place(template, before, turn, earlier, piece)
        bears = place is not None and turn["role"] in loss_roles
        yield {
            "position": position,
            "role": turn["role"],
            "formatted": piece,
            "span_start": offset,
            "span_end": offset + len(piece),
            "loss_start": offset + place[0] if bears else None,
            "loss_end": offset + place[1] if bears else None,
            "rewrites_history": rewrites,
        }
        offset += len(piece)
        held = [*before, turn]


TURNS = (
    "conv_id long, position long, role string, formatted string, span_start long, span_end long, "
    "loss_start long, loss_end long, rewrites_history boolean"
)


def _by_conversation(batches: Iterator[pd.DataFrame], key: str = "conv_id") -> Iterator[tuple]:
    """(key, rows as an iterator of named tuples) for sorted batches; rows are read only as they are asked for."""
    rows = (r for b in batches for r in b.astype({key: "Int64"}).itertuples(index=False))
    pending = next(rows, None)
    while pending is not None:
        name = getattr(pending, key)
        is_null = pd.isna(name)

        def same(r) -> bool:
            other = getattr(r, key)
            return pd.isna(other) if is_null else not pd.isna(other) and other == name

        box = [pending]

        def group():
            while box[0] is not None and same(box[0]):
                yield box[0]
                box[0] = next(rows, None)

        yield (None if is_null else int(name)), group()
        pending = box[0]


def format_conversations(turns: DataFrame, template: Template = MARKED, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per turn, in order within a partition: conv_id, position, role, formatted, span and loss offsets, rewrites_history.

    A conversation's formatted text is its pieces in the order of ``position``; ``rewrites_history`` marks turns at which the
    template changed what it had given before, and these bear no loss. Turns are ordered by turn, role and text, nulls first,
    so repeated and tied turns have a defined place. Null texts and roles count as empty; rows with a null conv_id form one
    conversation. Other columns are ignored; an empty table gives no rows.
    """
    rows = turns.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def formatted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[dict] = []
        for conv_id, group in _by_conversation(batches):
            for span in turn_spans(template, ({"role": r.role, "text": r.text} for r in group), loss_roles):
                out.append({"conv_id": conv_id, **span})
                if len(out) >= 1000:
                    yield _frame(out)
                    out = []
        if out:
            yield _frame(out)

    return rows.select("conv_id", "role", "text").mapInPandas(formatted, TURNS)


def _frame(out: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(out).astype({"conv_id": "Int64", "loss_start": "Int64", "loss_end": "Int64"})


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewriting_turns long"


def digests(pieces: DataFrame) -> DataFrame:
    """One row per conversation, read back from the output of ``format_conversations`` with the template ``MARKED``."""

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for conv_id, group in _by_conversation(batches):
            reader, whole, loss = Reader(), hashlib.sha256(), hashlib.sha256()
            n = chars = loss_chars = rewriting = 0
            for r in group:
                chars += len(r.formatted)
                rewriting += bool(r.rewrites_history)
                for role, text in reader.feed(r.formatted):
                    whole.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    n += 1
                if not pd.isna(r.loss_start):
                    masked = unescape(r.formatted[int(r.loss_start - r.span_start) : int(r.loss_end - r.span_start)])
                    loss.update(masked.encode("utf-8", "surrogatepass"))
                    loss_chars += len(masked)
            out.append((conv_id, n, whole.hexdigest(), loss_chars, loss.hexdigest(), chars, rewriting))
            if len(out) >= 1000:
                yield pd.DataFrame(out, columns=_DIGEST_NAMES).astype({"conv_id": "Int64"})
                out = []
        if out:
            yield pd.DataFrame(out, columns=_DIGEST_NAMES).astype({"conv_id": "Int64"})

    return pieces.mapInPandas(folded, DIGESTS)


_DIGEST_NAMES = [x.split()[0] for x in DIGESTS.split(", ")]
