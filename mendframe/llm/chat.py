"""Chat formatting with loss spans, by rendering a black-box template step by step.

The template is any function from a list of (role, text) to a string.  For each
turn the conversation so far is rendered with it and without it: what was
added is the turn's span, and a template that changed what stood before has
rewritten history.  Rendering the turn with two different one-letter texts
tells where its content begins and how long its footer is.

Rendering every prefix whole takes quadratic time, and most templates mark each
turn by itself.  So a turn's span is first taken from rendering it behind the
``lookback`` turns ahead of it only, and the whole conversation so far is rendered
after 1, 2, 4, 8 ... turns and at its end and compared with the joined spans.  Where
they differ, the template looks farther: every prefix since the last agreement, and
from there on, is rendered whole.  Time is linear for local templates, whatever
``lookback`` says, and the result is that of rendering every prefix, but for a
template that rewrites history at some length and takes it back before the next
comparison (``lookback=None`` renders every prefix from the start).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template's control strings.
START, END = "<|im_start|>", "<|im_end|>"
TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)
Turn = tuple[str, str]


def escape(text: str) -> str:
    """No control string is left; :func:`unescape` reads it back."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S) if "\\" in text else text


def marked(turns: Sequence[Turn]) -> str:
    """The template of the registered query: each turn between control strings."""
    return "".join(f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n{escape(text)}{END}\n" for role, text in turns)


Span = tuple[Turn, str, int, int, bool, bool]


def _common(a: str, b: str) -> int:
    """How many characters two strings begin with alike."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


def _step(context: Sequence[Turn], turn: Turn, before: str, render: Callable[[Sequence[Turn]], str]) -> tuple[str, Span]:
    """The rendering of ``context`` with ``turn``, and the turn's span, if without it is ``before``."""
    now = render([*context, turn])
    rewrites = not now.startswith(before)
    at = _common(before, now) if rewrites else len(before)
    one, two = (render([*context, (turn[0], probe)]) for probe in "ab")
    start = next((i for i, (a, b) in enumerate(zip(one[at:], two[at:], strict=False)) if a != b), None)
    end = len(now) - at - (len(one) - at - start - 1 if start is not None else 0)
    return now, (turn, now[at:], start if start is not None else end, end, rewrites, True)


def _whole(turns: Sequence[Turn], known: int, render: Callable[[Sequence[Turn]], str]) -> Iterator[Span]:
    """The spans of all turns but the first ``known``, by rendering every prefix."""
    before = render(turns[:known])
    for k in range(known, len(turns)):
        before, span = _step(turns[:k], turns[k], before, render)
        yield span


def spans(turns: Iterator[Turn], render: Callable[[Sequence[Turn]], str], lookback: int | None = 1, most_chars: int | None = None) -> Iterator[Span]:
    """For each turn: (turn, what it adds, start and end of its content therein,
    whether it rewrote what stood before, whether it was compared with the whole).
    If it did, what it adds is all that follows the common beginning.

    A conversation is held whole, however long it is.  Only if ``most_chars`` is given,
    one of more rendered characters is held no longer: its later turns are rendered
    behind ``lookback`` turns only and given as not compared, unless the template was
    found to look farther."""
    held: list[Turn] = []
    most = math.inf if most_chars is None else most_chars
    agreed, known, pending, chars, far, lost = render([]), 0, [], 0, lookback is None, False

    def settle() -> Iterator[Span]:
        """Compare what is pending with the whole; where it differs, do it over."""
        nonlocal agreed, known, pending, far
        joined = agreed + "".join(p[1] for p in pending)
        whole = render(held)
        far = far or whole != joined or any(p[4] for p in pending)
        yield from _whole(held, known, render) if far else pending
        agreed, known, pending = whole, len(held), []

    for turn in turns:
        if far and not lost:
            agreed, span = _step(held, turn, agreed, render)
            held.append(turn)
            yield span
            continue
        near = held[-lookback:] if lookback else []
        _, span = _step(near, turn, render(near), render)
        if lost:
            held = [*near, turn]
            yield (*span[:5], False)
            continue
        held.append(turn)
        pending.append(span)
        chars += len(span[1])
        if len(held) & (len(held) - 1) == 0 or chars > most:
            yield from settle()
            if chars > most and not far:
                lost, agreed, held = True, "", held[-lookback:] if lookback else []
    if pending:
        yield from settle()


def format_conversations(turns: DataFrame, render: Callable[[Sequence[Turn]], str] = marked, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: Sequence[str] = ("assistant",), lookback: int | None = 1, most_chars: int | None = None) -> DataFrame:
    """One row a turn, dealt by conversation and in order: (conv, turn, formatted,
    loss_start, loss_end, rewrites, checked).

    ``formatted`` is what the turn adds; joined in order they are the
    conversation (unless a turn rewrites history).  The loss span, in code
    points of ``formatted``, is the content of turns whose role is in ``learn``
    and empty for others.  ``lookback`` and ``most_chars`` are as in :func:`spans`; ``checked``
    is false only for turns that lie beyond a given ``most_chars`` of one conversation.  Null roles and texts are empty; null turns come
    first, ties by role and text, repeated rows are turns of their own; turns
    under a null conversation form one; an empty table gives an empty one;
    other columns are not looked at.
    """
    learnt = frozenset(learn)
    rows = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    names = ["conv", "turn", "formatted", "loss_start", "loss_end", "rewrites", "checked"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True))
        out, size = [], 0
        ahead = next(stream, None)
        while ahead is not None:
            conv, numbers = ahead[0], deque()

            def one() -> Iterator[Turn]:
                nonlocal ahead
                while ahead is not None and ahead[0] == conv:  # noqa: B023
                    numbers.append(ahead[1])  # noqa: B023
                    here = ahead
                    ahead = next(stream, None)
                    yield here[2], here[3]

            for (role, _), formatted, start, end, rewrites, checked in spans(one(), render, lookback, most_chars):
                out.append((conv, numbers.popleft(), formatted, start if role in learnt else 0, end if role in learnt else 0, rewrites, checked))
                size += len(formatted)
                if size > 1 << 23:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), KINDS, strict=True)], names=names)
                    out, size = [], 0
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), KINDS, strict=True)], names=names)

    return rows.mapInArrow(run, "conv long, turn long, formatted string, loss_start long, loss_end long, rewrites boolean, checked boolean")


KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of
    each conversation, parsed from the output of :func:`format_conversations`
    with the template :func:`marked`; must follow it without a shuffle between."""
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now = [], None

        def close():
            if now:
                out.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))

        for batch in batches:
            for conv, formatted, start, end in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if now is None or now[0] != conv:
                    close()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for m in TURN.finditer(formatted):
                    now[1] += 1
                    now[2].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                loss = unescape(formatted[start:end])
                now[3] += len(loss)
                now[4].update(loss.encode())
                now[5] += len(formatted)
            if len(out) > 10_000:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []
        close()
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return formatted.mapInArrow(run, "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
