"""Typed partial values over a stream of text fragments (keyed state)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from mendframe.kernel import coerce as C
from mendframe.schema import Kind, dumps

OUTPUT = "stream_id string, value_json string, flags string, score int, is_final boolean, error string"


def read(buffer: str, kind: Kind, final: bool) -> tuple[str | None, str | None, int | None, str | None]:
    """(value, flags, score, error) of what has arrived so far."""
    try:
        s = C.parse(buffer, kind if final else kind.partial(), is_done=final, partial=not final)
    except (ValueError, RecursionError) as e:
        return None, None, None, str(e)
    return dumps(s.value), ",".join(s.flags), s.score, None


def parse_stream(fragments: DataFrame, kind: Kind, max_buffer_chars: int | None = None, idle_ms: int | None = None) -> DataFrame:
    """Fragments (stream_id, seq, chunk, is_final) to one row a stream and
    micro-batch: the partial value, or the final one, after which the state goes.
    Only the last ``max_buffer_chars`` characters are kept.  A stream that gets
    nothing for ``idle_ms`` (processing time) is read as final and forgotten, so
    that abandoned streams don't stay in the state; by default none is."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        buffer, final = state.get[0] if state.exists else "", state.hasTimedOut
        if not final:
            rows = pd.concat(list(frames)).sort_values("seq")
            buffer += "".join(rows["chunk"].fillna(""))
            if max_buffer_chars:
                buffer = buffer[-max_buffer_chars:]
            final = bool(rows["is_final"].any())
        value, flags, score, error = read(buffer, kind, final)
        if final:
            state.remove()
        else:
            state.update((buffer,))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"stream_id": [key[0]], "value_json": [value], "flags": [flags], "score": pd.array([score], dtype="Int32"), "is_final": [final], "error": [error]})

    return fragments.groupBy("stream_id").applyInPandasWithState(step, OUTPUT, "buffer string", "update", "ProcessingTimeTimeout" if idle_ms else "NoTimeout")
