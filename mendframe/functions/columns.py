"""Column functions over the kernels: one Arrow-batched call a row.

Every function takes and returns columns, never fails a job on bad content (an
``error`` field or null says why), and gives null for null.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from mendframe.kernel import coerce as C
from mendframe.kernel import patch as P
from mendframe.kernel import text as X
from mendframe.kernel.candidates import ParseOptions, blocks, candidates, regions, strict
from mendframe.kernel.candidates import completion as overall
from mendframe.schema import Kind, dumps, error_paths, validate

STRINGS = T.ArrayType(T.StringType())
PERMISSIVE, FAILFAST = "PERMISSIVE", "FAILFAST"


def ready(value: Any, kind: Kind) -> Any:
    """A value of ``kind`` as Arrow takes it (maps as pairs, 'any' as JSON)."""
    if value is None:
        return None
    if kind.name in ("any", "union"):
        return dumps(value)
    if kind.name == "list":
        return [ready(v, kind.item) for v in value]
    if kind.name == "dict":
        return [(k, ready(v, kind.item)) for k, v in value.items()]
    if kind.name == "tuple":
        return {f"_{n + 1}": ready(v, k) for n, (v, k) in enumerate(zip(value, kind.variants, strict=True))}
    if kind.name == "struct":
        return {f.name: ready(value.get(f.name), f.kind) for f in kind.fields}
    return value


def batched(fn: Callable[..., Any], kind: T.DataType | str, *cols: Column | str) -> Column:
    """``fn`` over the rows of Arrow batches; null first argument, null result."""
    returns = kind if isinstance(kind, T.DataType) else T._parse_datatype_string(kind)
    arrow = to_arrow_type(returns)

    def run(*arrays: pa.Array) -> pa.Array:
        rows = zip(*(a.to_pylist() for a in arrays), strict=True)
        return pa.array([None if r[0] is None else fn(*r) for r in rows], type=arrow)

    if len(cols) == 1:

        def call(a: pa.Array) -> pa.Array:
            return run(a)
    elif len(cols) == 2:

        def call(a: pa.Array, b: pa.Array) -> pa.Array:
            return run(a, b)
    else:

        def call(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
            return run(a, b, c)

    return F.arrow_udf(call, returns)(*cols)


def result(kind: Kind) -> T.StructType:
    return T.StructType([T.StructField("value", kind.spark()), T.StructField("flags", STRINGS), T.StructField("score", T.IntegerType()), T.StructField("error", T.StringType())])


def _guarded(fn: Callable[[], C.Scored], kind: Kind, mode: str) -> dict:
    try:
        s = fn()
    except (ValueError, RecursionError, OverflowError) as e:
        if mode == FAILFAST:
            raise
        return {"value": None, "flags": None, "score": None, "error": str(e)}
    return {"value": ready(s.value, kind), "flags": list(s.flags), "score": s.score, "error": None}


def parse(text: Column | str, kind: Kind, options: ParseOptions = ParseOptions(), coerce: C.CoerceOptions = C.CoerceOptions(), is_done: bool = True, partial: bool = False, mode: str = PERMISSIVE) -> Column:
    """struct(value, flags, score, error) of the least edited reading."""
    out = kind.partial() if partial else kind
    return batched(lambda x: _guarded(lambda: C.parse(x, out, is_done, options, coerce, partial), out, mode), result(out), text)


def coerce(value_json: Column | str, kind: Kind, options: C.CoerceOptions = C.CoerceOptions(), mode: str = PERMISSIVE) -> Column:
    """The same for a value that is parsed already, as JSON."""
    return batched(lambda x: _guarded(lambda: C.coerce_value(json.loads(x), kind, options), kind, mode), result(kind), value_json)


TRACE = "array<struct<idx:int,value_json:string,completion:string,fixes:array<string>,result_json:string,flags:array<string>,score:int,error:string>>"


def parse_candidates(text: Column | str, kind: Kind, options: ParseOptions = ParseOptions(), coerce: C.CoerceOptions = C.CoerceOptions()) -> Column:
    """Every candidate: array of (idx, value_json, completion, fixes, result_json,
    flags, score, error); ``F.inline`` makes it a table.  Number -1 is the text as
    it stands, and a score of -1 a failure."""

    returns = T._parse_datatype_string(TRACE)
    arrow = to_arrow_type(returns)

    def call(texts: pa.Array) -> pa.Array:
        return _trace_array(texts, lambda x: C.traced(x, kind, options, coerce), arrow)

    return F.arrow_udf(call, returns)(text)


def _trace_array(texts: pa.Array, run: Callable[[str], list], arrow: pa.ListType) -> pa.Array:
    """The traces of some texts; rows that candidates of a text share are converted once."""
    numbers, which, rows, ends = [], [], [], [0]
    for x in texts.to_pylist():
        try:
            found = () if x is None else run(x)
        except (ValueError, RecursionError):
            found = ()
        places: dict[int, int] = {}
        for k, row in found:
            if (at := places.get(id(row))) is None:
                at = places[id(row)] = len(rows)
                rows.append(row)
            numbers.append(k)
            which.append(at)
        ends.append(len(which))
    every = pa.array(rows, type=arrow.value_type).take(pa.array(which, pa.int64())).flatten()
    items = pa.StructArray.from_arrays([pa.array(numbers, pa.int32()), *every[1:]], fields=list(arrow.value_type))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items, type=arrow, mask=texts.is_null())


def coerce_candidates(value_json: Column | str, kind: Kind, options: C.CoerceOptions = C.CoerceOptions()) -> Column:
    """The same for a value that is parsed already: as it stands, then coerced."""
    return batched(lambda x: C.trace_value(json.loads(x), kind, options), TRACE, value_json)


def completion(text: Column | str, options: ParseOptions = ParseOptions(), is_done: bool = True) -> Column:
    """Whether all readings of a text are complete."""

    def run(x):
        try:
            return overall(candidates(x, options, is_done))
        except (ValueError, RecursionError):
            return None

    return batched(run, "string", text)


def schema_errors(value_json: Column | str, kind: Kind) -> Column:
    """JSON Pointers to every place where a value doesn't fit its schema."""
    return batched(lambda x: error_paths(json.loads(x), kind), STRINGS, value_json)


def normalize_key(key: Column | str) -> Column:
    return batched(C.normalize_key, "string", key)


def match_enum(value: Column | str, domain: tuple[str, ...], allow_substring: bool = False) -> Column:
    options = C.CoerceOptions(allow_substring_enum_match=allow_substring)

    def run(x):
        hit = C.match_enum(x, domain, options)
        return hit and {"value": hit[0], "flags": list(hit[1])}

    return batched(run, "struct<value:string,flags:array<string>>", value)


def parse_number(text: Column | str) -> Column:
    return batched(C.parse_float, "double", text)


def json_objects(text: Column | str) -> Column:
    """The balanced regions of a text that are JSON, in order."""
    return batched(lambda x: [r for r in regions(x) if strict(r)[0]], STRINGS, text)


def markdown_blocks(text: Column | str) -> Column:
    return batched(lambda x: blocks(x)[0], STRINGS, text)


TOKENS = "array<struct<text:string,start:int,end:int,first_after_newline:boolean>>"
#: The most rows and, but for the last row, tokens that are given back at once.
TOKEN_ROWS, TOKENS_AT_ONCE = 256, 1 << 17


def _token_array(found: list, kind: pa.ListType) -> pa.Array:
    """The columns of :func:`X.token_columns` of some rows as one array."""
    some = [x for x in found if x is not None]
    sizes, starts, ends, lines = (np.concatenate([x[k] for x in some]) if some else np.empty(0, np.int64) for k in (1, 2, 3, 4))
    places = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    texts = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(places), pa.py_buffer(b"".join(x[0] for x in some)))
    columns = [texts, pa.array(starts.astype(np.int32)), pa.array(ends.astype(np.int32)), pa.array(lines.astype(bool))]
    rows = np.concatenate([[0], np.cumsum([0 if x is None else len(x[1]) for x in found])]).astype(np.int32)
    items = pa.StructArray.from_arrays(columns, fields=list(kind.value_type))
    return pa.ListArray.from_arrays(pa.array(rows), items, type=kind, mask=pa.array([x is None for x in found], pa.bool_()))


def _token_arrays(arrays: Iterator[pa.Array], unicode: bool, kind: pa.ListType) -> Iterator[pa.Array]:
    for array in arrays:
        for at in range(0, max(1, len(array)), TOKEN_ROWS):
            found, size = [], 0
            for x in array.slice(at, TOKEN_ROWS).to_pylist():
                found.append(None if x is None else X.token_columns(x, unicode))
                size += 0 if x is None else len(found[-1][1])
                if size >= TOKENS_AT_ONCE:
                    yield _token_array(found, kind)
                    found, size = [], 0
            if found or not len(array):
                yield _token_array(found, kind)


def tokens(text: Column | str, unicode: bool = False) -> Column:
    """Every token of a text.  A text makes many: they are given back a bounded
    number at a time, not for all rows of an Arrow batch at once."""
    returns = T._parse_datatype_string(TOKENS)
    kind = to_arrow_type(returns)

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _token_arrays(arrays, unicode, kind)

    return F.arrow_udf(run, returns)(text)


def chunks(text: Column | str, max_chars: int | None = None, overlap: int = 0, unicode: bool = False) -> Column:
    return batched(lambda x: [{"chunk_index": k, "text": c, "start": a, "end": b} for k, (c, a, b) in enumerate(X.chunks(x, max_chars, overlap, unicode))], "array<struct<chunk_index:int,text:string,start:int,end:int>>", text)


def leaves(value_json: Column | str) -> Column:
    return batched(lambda x: [{"path": p, "text": t} for p, t in X.leaves(json.loads(x))], "array<struct<path:string,text:string>>", value_json)


SPAN = "struct<status:string,start:int,end:int>"
EVIDENCE = "array<struct<path:string,value_preview:string,status:string,start:int,end:int,token_start:int,token_end:int>>"


def align(text: Column | str, value: Column | str, fuzzy: bool = True, threshold: float = 0.75, lesser: bool = True, in_order: bool = False) -> Column:
    return batched(lambda x, v: None if v is None else dict(zip(("status", "start", "end"), X.align(x, v, fuzzy, threshold, lesser, in_order=in_order), strict=True)), SPAN, text, value)


def ground(text: str, value: Any, offset: int = 0, unicode: bool = False, **options) -> list[dict]:
    """Evidence of each leaf of ``value`` in ``text``; characters are shifted by
    ``offset``, token numbers are the text's own."""
    found, out = X.tokens(text, unicode), []
    for path, v in X.leaves(value):
        status, a, b = X.align(text, v, known=found, unicode=unicode, **options)
        first, last = X.token_span(found, a, b)
        out.append({"path": path, "value_preview": v[:100], "status": status, "start": None if a is None else a + offset, "end": None if b is None else b + offset, "token_start": first, "token_end": last})
    return out


def apply_patch(doc_json: Column | str, ops: Column | str, policy: P.Policy = P.Policy()) -> Column:
    """struct(value_json, error); ``ops`` is an ordered array of (op, path, value_json)."""

    def run(x, todo):
        try:
            every = [P.Op(o["op"], o["path"], None if o["value_json"] is None else json.loads(o["value_json"])) for o in todo or ()]
            return {"value_json": json.dumps(P.apply_patch(json.loads(x), every, policy), ensure_ascii=False), "error": None}
        except ValueError as e:
            return {"value_json": None, "error": str(e)}

    return batched(run, "struct<value_json:string,error:string>", doc_json, ops)


def apply_patch_and_validate(doc_json: Column | str, ops: Column | str, kind: Kind, policy: P.Policy = P.Policy()) -> Column:
    """struct(value, flags, score, error): the patched document if it is valid as
    it is (nothing is coerced, so there are no flags)."""

    def run(x, todo):
        try:
            every = [P.Op(o["op"], o["path"], None if o["value_json"] is None else json.loads(o["value_json"])) for o in todo or ()]
            value = validate(P.apply_patch(json.loads(x), every, policy), kind, by_name=False)
        except ValueError as e:
            return {"value": None, "flags": None, "score": None, "error": str(e)}
        return {"value": ready(value, kind), "flags": [], "score": 0, "error": None}

    return batched(run, result(kind), doc_json, ops)


def normalize_patches(raw: Column | str) -> Column:
    """struct(ops, error) of a text that holds patch operations in some shape."""

    def run(x):
        try:
            return {"ops": [{"op": o.op, "path": o.path, "value_json": json.dumps(o.value, ensure_ascii=False)} for o in P.normalize_patches(x)], "error": None}
        except ValueError as e:
            return {"ops": None, "error": str(e)}

    return batched(run, "struct<ops:array<struct<op:string,path:string,value_json:string>>,error:string>", raw)


def slice_schema(schema_text: Column | str, paths: Column | str) -> Column:
    return batched(lambda x, p: P.slice_schema(x, p or []), "string", schema_text, paths)


def token_span(text: Column | str, start: Column | str, end: Column | str) -> Column:
    """struct(start, end) of the tokens that a stretch of characters touches."""

    def run(x, a, b):
        first, last = X.token_span(X.tokens(x), a, b)
        return {"start": first, "end": last}

    return batched(run, "struct<start:int,end:int>", text, start, end)


def slice_doc(doc_json: Column | str, paths: Column | str) -> Column:
    return batched(lambda x, p: json.dumps(P.slice_doc(json.loads(x), p or []), ensure_ascii=False), "string", doc_json, paths)


def merge_values(values: Column | str, strategy: str = "prefer_non_null") -> Column:
    """An ordered array of JSON values folded into one."""

    def run(every):
        out = None
        for v in every:
            out = X.merge(out, None if v is None else json.loads(v), strategy)
        return json.dumps(out, ensure_ascii=False)

    return batched(run, "string", values)


def merge_evidence(passes: Column | str) -> Column:
    """An ordered array of passes' span arrays: the first whole, later spans
    where they overlap nothing kept so far."""

    def run(every):
        out = list(every[0] or []) if every else []
        for more in every[1:]:
            out = X.merge_spans(out, more or [])
        return out

    return batched(run, "array<struct<start:int,end:int>>", passes)
