"""SQL names for the kernels: scalar functions and table functions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf, udtf

from mendframe.kernel import coerce as C
from mendframe.kernel import text as X
from mendframe.kernel.candidates import blocks, regions, strict
from mendframe.schema import Kind, dumps, from_ddl


class ParseDebug:
    """parse_debug(text, ddl): every candidate of a text and what became of it."""

    def eval(self, text: str, ddl: str) -> Iterator[tuple]:
        if text is not None:
            for r in C.trace(text, from_ddl(ddl)):
                yield r["idx"], r["value_json"], ",".join(r["flags"]), r["score"], r["error"]


class Chunks:
    def eval(self, text: str, max_chars: int, overlap: int) -> Iterator[tuple]:
        for k, (c, a, b) in enumerate(X.chunks(text or "", max_chars, overlap)):
            yield k, c, a, b


class Tokens:
    def eval(self, text: str) -> Iterator[tuple]:
        yield from X.tokens(text or "")


class Leaves:
    def eval(self, value_json: str) -> Iterator[tuple]:
        if value_json is not None:
            yield from X.leaves(json.loads(value_json))


class JsonObjects:
    def eval(self, text: str) -> Iterator[tuple]:
        yield from ((r,) for r in regions(text or "") if strict(r)[0])


class MarkdownBlocks:
    def eval(self, text: str) -> Iterator[tuple]:
        yield from ((b,) for b in blocks(text or "")[0])


TABLES = {
    "parse_debug": (ParseDebug, "idx int, value_json string, flags string, score int, error string"),
    "text_chunks": (Chunks, "chunk_index int, text string, start int, `end` int"),
    "text_tokens": (Tokens, "text string, start int, `end` int, first_after_newline boolean"),
    "json_leaves": (Leaves, "path string, text string"),
    "json_objects": (JsonObjects, "object_json string"),
    "markdown_blocks": (MarkdownBlocks, "block string"),
}


def schema_parse(text: pa.Array, ddl: pa.Array) -> pa.Array:
    """The values as JSON, or null; one call a batch."""
    kinds: dict[str, Kind] = {}

    def one(x: str | None, d: str) -> str | None:
        if x is None or d is None:
            return None
        if d not in kinds:
            kinds[d] = from_ddl(d)
        try:
            return dumps(C.parse(x, kinds[d]).value)
        except (ValueError, RecursionError):
            return None

    return pa.array([one(x, d) for x, d in zip(text.to_pylist(), ddl.to_pylist(), strict=True)], pa.string())


def normalize_key(key: pa.Array) -> pa.Array:
    return pa.array([None if x is None else C.normalize_key(x) for x in key.to_pylist()], pa.string())


def parse_number(text: pa.Array) -> pa.Array:
    return pa.array([None if x is None else C.parse_float(x) for x in text.to_pylist()], pa.float64())


SCALARS = ((schema_parse, "string"), (normalize_key, "string"), (parse_number, "double"))


def register(spark: SparkSession) -> None:
    """Make the functions known to ``spark.sql``."""
    for name, (table, kind) in TABLES.items():
        spark.udtf.register(name, udtf(table, returnType=kind))
    for function, kind in SCALARS:
        spark.udf.register(function.__name__, arrow_udf(function, kind))
