"""Texts that fail their schema, mended by asking for patches of what was read."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from mendframe.kernel import coerce as C
from mendframe.kernel import patch as P
from mendframe.kernel.candidates import candidates
from mendframe.plans.extract import ask
from mendframe.schema import Kind, dumps, error_paths
from mendframe.sources.providers import Provider


def patch_prompt(kind: Kind, doc: object, paths: list[str], error: str) -> str:
    """What is asked: the error, and only the parts of schema and document it concerns."""
    schema = P.slice_schema(kind.json_schema(), paths)
    return "\n".join([f"The document doesn't fit its schema: {error}", f"Schema: {json.dumps(schema)}", f"Document: {json.dumps(P.slice_doc(doc, paths), ensure_ascii=False)}", f"Wrong: {', '.join(paths)}", "Answer with JSON patch operations (add, replace)."])


def repair_all(texts: list[str | None], provider: Provider, kind: Kind, policy: P.Policy, max_attempts: int, batch_length: int) -> list[dict]:
    """{value, attempts, error} of each text: parse; while it fails, ask (about all
    that failed together), and take an answer as patches of what was read, or else
    as the value itself."""
    rows = []
    for text in texts:
        row = {"value": None, "attempts": 0, "error": None, "doc": {}}
        rows.append(row)
        if text is None:
            row["error"] = "no text"
            continue
        try:
            row["value"] = C.parse(text, kind)
            continue
        except (ValueError, RecursionError) as e:
            row["error"] = str(e)
        try:
            row["doc"] = candidates(text)[0].value
        except (ValueError, RecursionError):
            pass
    open_ = [r for r, t in zip(rows, texts, strict=True) if t is not None and r["value"] is None]
    for _ in range(max_attempts):
        said = ask(provider, [patch_prompt(kind, r["doc"], error_paths(r["doc"], kind), r["error"]) for r in open_], batch_length)
        for r, x in zip(open_, said, strict=True):
            r["attempts"] += 1
            try:
                r["doc"] = P.apply_patch(r["doc"], P.normalize_patches(x), policy)
                r["value"] = C.coerce_value(r["doc"], kind)
            except ValueError as e:
                r["error"] = str(e)
                try:
                    r["value"] = C.parse(x, kind)
                except (ValueError, RecursionError):
                    continue
            r["error"] = None
        open_ = [r for r in open_ if r["value"] is None]
    return rows


def repair(df: DataFrame, provider: Provider, kind: Kind, id_col: str = "id", text_col: str = "text", policy: P.Policy = P.Policy(), max_attempts: int = 3, batch_length: int = 4) -> DataFrame:
    """(id, value_json, flags, score, attempts, error) of each row; rows that
    parse cost nothing, the others a bounded number of questions."""
    more = T._parse_datatype_string("value_json string, flags array<string>, score int, attempts int, error string")

    def run(batches):
        for batch in batches:
            rows = repair_all(batch.column(1).to_pylist(), provider, kind, policy, max_attempts, batch_length)
            values = [r["value"] for r in rows]
            columns = [
                pa.array([v and dumps(v.value) for v in values], pa.string()),
                pa.array([v and list(v.flags) for v in values], pa.list_(pa.string())),
                pa.array([v and v.score for v in values], pa.int32()),
                pa.array([r["attempts"] for r in rows], pa.int32()),
                pa.array([r["error"] for r in rows], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, *more.names])

    return df.select(id_col, text_col).mapInArrow(run, T.StructType([df.schema[id_col], *more.fields]))
