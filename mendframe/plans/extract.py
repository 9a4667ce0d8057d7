"""Extraction over documents, and updates in bounded rounds, as DataFrame plans.

docs -> chunks -> prompts -> provider -> parse and ground (one kernel call a
chunk) -> one shuffle by document -> ordered fold.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendframe.functions import columns as M
from mendframe.kernel import coerce as C
from mendframe.kernel import patch as P
from mendframe.kernel import text as X
from mendframe.schema import Invalid, Kind, dumps, validate
from mendframe.sources.providers import Provider


@dataclass(frozen=True)
class ExtractOptions:
    max_char_buffer: int | None = None
    overlap_chars: int = 0
    batch_length: int = 4
    passes: int = 1
    merge_strategy: str = "prefer_non_null"
    fuzzy: bool = True
    fuzzy_threshold: float = 0.75
    accept_match_lesser: bool = True
    unicode_tokens: bool = False
    description: str = "Extract the fields."
    context: str | None = None
    examples: tuple[tuple[str, str], ...] = field(default=())
    check: str = "off"  # or "warning", "error"
    format: str = "json"  # or "yaml"
    use_fences: bool = True
    wrapper_key: str | None = None
    debug: bool = False


def shown(value: object, options: ExtractOptions) -> str:
    """An example's answer as the prompt shows it: a list under the wrapper key,
    as JSON or YAML, fenced."""
    if options.wrapper_key and isinstance(value, list):
        value = {options.wrapper_key: value}
    if options.format == "yaml":
        import yaml  # only this format needs it

        text = yaml.safe_dump(value, default_flow_style=False, sort_keys=False, allow_unicode=True)
    elif options.format == "json":
        text = json.dumps(value, indent=2, ensure_ascii=False)
    else:
        raise ValueError(f"no such format: {options.format!r}")
    return f"```{options.format}\n{text.strip()}\n```" if options.use_fences else text


def prompt(kind: Kind, options: ExtractOptions) -> str:
    """The constant head of each prompt."""
    wanted = "array" if kind.name == "list" else "object"
    lines = [options.description.strip()]
    lines += [f"Context: {options.context.strip()}"] if options.context else []
    lines += [f"Answer with one {options.format.upper()} {wanted} of this schema:", json.dumps(kind.json_schema())]
    lines += [f"Lists stand under the key {options.wrapper_key!r}."] if options.wrapper_key else []
    for question, answer in options.examples:
        try:
            answer = shown(json.loads(answer), options)
        except ValueError:
            pass  # as it is; check_examples says so
        lines.append(f"Q: {question}\nA: {answer}")
    return "\n".join(lines)


def check_examples(kind: Kind, options: ExtractOptions) -> list[str]:
    """What is wrong with the examples: answers off the schema or the question."""
    wrong = []
    for q, a in options.examples:
        try:
            value = validate(json.loads(a), kind)
        except ValueError as e:
            wrong.append(f"{q!r}: {e}")
            continue
        wrong += [f"{q!r}: {p} isn't in the text" for p, v in X.leaves(value) if X.align(q, v)[0] == X.UNMATCHED]
    if wrong and options.check == "error":
        raise ValueError("; ".join(wrong))
    if wrong and options.check == "warning":
        warnings.warn("; ".join(wrong), stacklevel=2)
    return wrong


def ask(provider: Provider, prompts: Sequence[str | None], batch_length: int) -> list[str | None]:
    """Answers in order, asked for in batches; null prompts aren't asked."""
    wanted = [k for k, p in enumerate(prompts) if p is not None]
    out: list[str | None] = [None] * len(prompts)
    for k in range(0, len(wanted), batch_length):
        some = wanted[k : k + batch_length]
        for at, said in zip(some, provider.infer([prompts[i] for i in some]), strict=True):
            out[at] = said
    return out


def infer(df: DataFrame, provider: Provider, text: str, out: str, batch_length: int = 4) -> DataFrame:
    """``df`` with a column of the provider's outputs, in batches inside each task."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(batches):
        for batch in batches:
            said = ask(provider, batch.column(batch.schema.get_field_index(text)).to_pylist(), batch_length)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string())], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


DEBUG = "array<struct<pass:int,chunk_index:int,text_preview:string,raw:string,flags:array<string>,score:int>>"


def extract(docs: DataFrame, provider: Provider, kind: Kind, options: ExtractOptions = ExtractOptions(), id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """(id, value_json, flags, score, evidence, raw_text, error[, debug, prompt_preview]),
    one row a document, whatever its id: null and repeated ids stay rows of their
    own.  A null text isn't asked about and gives an error."""
    check_examples(kind, options)
    head = prompt(kind, options)
    parts = M.chunks(F.col("__mf_text"), options.max_char_buffer, options.overlap_chars, options.unicode_tokens)
    # numbered before the chunks are made, so that a document's chunks share its number
    cut = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("__mf_text")).select("row", "id", F.inline_outer(parts))
    asked = cut.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(options.passes - 1)))).withColumn("prompt", F.concat(F.lit(head + "\nQ: "), "text", F.lit("\nA: ")))
    said = infer(asked, provider, "prompt", "raw", options.batch_length)
    how = {"fuzzy": options.fuzzy, "threshold": options.fuzzy_threshold, "lesser": options.accept_match_lesser, "unicode": options.unicode_tokens}

    def read(raw, text, start):
        nothing = {"value_json": None, "flags": [], "score": 0, "evidence": [], "error": None}
        if not raw:  # an empty answer is passed over
            return nothing
        try:
            try:
                s = C.parse(raw, kind)
            except (ValueError, RecursionError):  # once more, with looser domains
                s = C.parse(raw, kind, coerce=C.CoerceOptions(allow_substring_enum_match=True))
        except (ValueError, RecursionError) as e:
            return nothing | {"error": str(e)}
        plain = json.loads(dumps(s.value))
        return {"value_json": dumps(s.value), "flags": list(s.flags), "score": s.score, "evidence": M.ground(text, plain, start, **how), "error": None}

    row = f"struct<value_json:string,flags:array<string>,score:int,evidence:{M.EVIDENCE},error:string>"
    parsed = said.withColumn("r", M.batched(read, row, F.coalesce("raw", F.lit("")), "text", "start")).select("row", "id", "pass", "chunk_index", "raw", "prompt", F.left("text", F.lit(100)).alias("text_preview"), "r.*")
    folded = parsed.groupBy("row").agg(
        F.first("id").alias("id"),
        F.array_sort(F.collect_list(F.struct("pass", "chunk_index", "value_json", "evidence"))).alias("parts"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("flags")))).alias("flags"),
        F.max("score").alias("score"),
        F.max_by(F.nullif("raw", F.lit("")), F.when(F.col("raw") != "", F.struct("pass", "chunk_index"))).alias("raw_text"),
        F.first("error", ignorenulls=True).alias("error"),
        *([F.array_sort(F.collect_list(F.struct("pass", "chunk_index", "text_preview", "raw", "flags", "score"))).cast(DEBUG).alias("debug"), F.left(F.min_by("prompt", F.struct("pass", "chunk_index")), F.lit(500)).alias("prompt_preview")] if options.debug else []),
    )

    def fold(parts):
        if all(p["chunk_index"] is None for p in parts):
            return {"value_json": None, "evidence": [], "error": "no text"}
        value, kept, last = None, [], 0
        of_pass: dict[int, list] = {}
        for p in parts:
            value = X.merge(value, None if p["value_json"] is None else json.loads(p["value_json"]), options.merge_strategy)
            of_pass.setdefault(p["pass"], []).extend(p["evidence"] or [])
            last = max(last, p["pass"])
        for k in range(last + 1):
            kept = of_pass.get(k, []) if not k else X.merge_spans(kept, of_pass.get(k, []))
        try:
            value, error = validate({} if value is None else value, kind), None
        except Invalid as e:
            value, error = None, str(e)
        return {"value_json": None if error else dumps(value), "evidence": kept, "error": error}

    done = M.batched(fold, f"struct<value_json:string,evidence:{M.EVIDENCE},error:string>", "parts")
    more = ["debug", "prompt_preview"] if options.debug else []
    return folded.withColumn("f", done).select(F.col("id").alias(id_col), "f.value_json", "flags", "score", "f.evidence", "raw_text", F.coalesce("error", "f.error").alias("error"), *more)


@dataclass(frozen=True)
class Extractor:
    """An extraction to be run on several tables."""

    provider: Provider
    kind: Kind
    options: ExtractOptions = ExtractOptions()

    def extract(self, docs: DataFrame, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
        return extract(docs, self.provider, self.kind, self.options, id_col, text_col)


def parsed(df: DataFrame, text_col: str, kind: Kind, out: str = "value", mode: str = M.PERMISSIVE, **options) -> DataFrame:
    """``df`` with a parsed column as Spark's readers make it: ``PERMISSIVE`` gives
    null for what can't be read, ``DROPMALFORMED`` leaves its rows out (also those of
    null texts), ``FAILFAST`` fails."""
    found = df.withColumn("__mf_r", M.parse(F.col(text_col), kind, mode=M.FAILFAST if mode == M.FAILFAST else M.PERMISSIVE, **options))
    if mode == "DROPMALFORMED":
        found = found.where("__mf_r is not null and __mf_r.error is null")
    return found.withColumn(out, F.col("__mf_r.value")).drop("__mf_r")


def update(docs: DataFrame, instruction: str, provider: Provider, kind: Kind, policy: P.Policy = P.Policy(), max_retries: int = 2, id_col: str = "doc_id", doc_col: str = "doc_json", batch_length: int = 4) -> DataFrame:
    """(id, before, value_json, patches, raw, attempts, error): each document patched
    as the provider says; the rows of a batch that failed are asked about again,
    together and with their errors, a bounded number of times."""
    schema = json.dumps(kind.json_schema())

    def question(doc, error):
        failed = f"The last answer failed: {error}\n" if error else ""
        return f"{instruction}\nSchema: {schema}\nDocument: {json.dumps(doc, ensure_ascii=False)}\n{failed}Answer with JSON patch operations."

    def one(row, said):
        """A round of one row; True if its document is valid now."""
        row["raw"], row["attempts"] = said, row["attempts"] + 1
        try:
            ops = P.normalize_patches(said)
            row["doc"] = P.apply_patch(row["doc"], ops, policy)  # stays, even if what comes out is invalid
            row["patches"] += ops
            row["value"], row["error"] = dumps(C.coerce_value(row["doc"], kind).value), None
        except ValueError as e:
            row["error"] = str(e)
        return row["error"] is None

    def run(batches):
        for batch in batches:
            before = batch.column(1).to_pylist()
            rows = [{"doc": None if d is None else json.loads(d), "patches": [], "raw": None, "attempts": 0, "value": None, "error": "no document" if d is None else None} for d in before]
            open_ = [r for r, d in zip(rows, before, strict=True) if d is not None]
            for _ in range(max_retries + 1):
                said = ask(provider, [question(r["doc"], r["error"]) for r in open_], batch_length)
                open_ = [r for r, x in zip(open_, said, strict=True) if not one(r, x)]
            patches = [json.dumps([o.__dict__ for o in r["patches"]], ensure_ascii=False) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r["value"] for r in rows], pa.string()), pa.array(patches, pa.string()), pa.array([r["raw"] for r in rows], pa.string()), pa.array([r["attempts"] for r in rows], pa.int32()), pa.array([r["error"] for r in rows], pa.string())], names=[id_col, "before", "value_json", "patches", "raw", "attempts", "error"])

    more = T._parse_datatype_string("before string, value_json string, patches string, raw string, attempts int, error string")
    kinds = T.StructType([docs.schema[id_col], *more.fields])
    return docs.select(id_col, F.col(doc_col).cast("string")).mapInArrow(run, kinds)


def apply_patches(docs: DataFrame, ops: DataFrame, policy: P.Policy = P.Policy(), id_col: str = "doc_id", doc_col: str = "doc_json") -> DataFrame:
    """Documents joined to their operations (id, op_index, op, path, value_json),
    applied in order, all or nothing: (id, value_json, error)."""
    listed = ops.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("op_index", "op", "path", "value_json"))), lambda o: F.struct(o["op"].alias("op"), o["path"].alias("path"), o["value_json"].alias("value_json"))).alias("ops"))
    joined = docs.select(id_col, doc_col).join(listed, id_col, "left")
    return joined.select(id_col, M.apply_patch(F.col(doc_col), F.coalesce("ops", F.array().cast("array<struct<op:string,path:string,value_json:string>>")), policy).alias("r")).select(id_col, "r.*")


def merged(parts: DataFrame, key: str, order: Sequence[str], value: str, strategy: str = "prefer_non_null") -> DataFrame:
    """Values (JSON) folded by key in order."""
    listed = parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda s: s[value]).alias("parts"))
    return listed.select(key, M.merge_values("parts", strategy).alias(value))
