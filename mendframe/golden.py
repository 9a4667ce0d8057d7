"""Registered queries with stated expected values: each operator's rules on texts
made from the tables, and a list of cases whose results are fixed."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mendframe import functions as M
from mendframe.functions.columns import batched
from mendframe.kernel.candidates import ParseOptions
from mendframe.kernel.coerce import CoerceOptions
from mendframe.kernel.patch import Policy
from mendframe.operators import native
from mendframe.plans import extract as E
from mendframe.plans.repair import patch_prompt, repair
from mendframe.queries import flat, query, table, wide
from mendframe.schema import ANY, DATETIME, DECIMAL, FLOAT, INT, STR, STRICT_INT, Field, dict_of, enum, list_of, struct, tuple_of, union
from mendframe.sources import evals
from mendframe.sources.providers import Calling, Registry, Static

STATUS, PRICE = "o_orderstatus", "o_totalprice"
ITEM = struct(Field("id", INT), Field("status", STR))


def text(template: str, *columns: str) -> Column:
    return F.format_string(template, *(F.col(c).cast("string") for c in columns))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(spark, sf_dir, "orders")


def quoted(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


# --- fixed cases

#: Texts and the one number in them.
NUMBERS = (
    ("3,14", 314.0), ("1.234,56", None), ("1.234.567,89", None), ("€1.234,56", None), ("-€1.234,56", None), ("€1.234", 1.234), ("1.234€", 1.234),
    ("€1,234.56", 1234.56), ("3,000", 3000.0), ("3,100.00", 3100.0), ("1,234.56", 1234.56), ("1,234,567.89", 1234567.89), ("$1,234.56", 1234.56),
    ("-$1,234.56", -1234.56), ("$1,234", 1234.0), ("1,234$", 1234.0), ("+$1,234.56", 1234.56), ("$9,999,999,999", 9999999999.0), ("$1.23.456", None),
    ("$1.234.567.890", None), ("$314", 314.0), ("$1,23,456", 123456.0), ("50%", 50.0), ("3.15%", 3.15), (".009%", 0.009), ("1.234,56%", None),
    ("$1,234.56%", 1234.56), ("The answer is 10,000", 10000.0), ("The total is €1.234,56 today", None), ("You owe $3,000 for the service", 3000.0),
    ("Save up to 20% on your purchase", 20.0), ("Revenue grew by 1,234.56 this quarter", 1234.56), ("Profit is -€1.234,56 in the last month", None),
    ("The answer is 10,000 and $3,000", None), ("We earned €1.234,56 and $2,345.67 this year", None), ("Increase of 5% and a profit of $1,000", None),
    ("Loss of -€500 and a gain of 1,200.50", None), ("Targets: 2,000 units and €3.000,75 revenue", None), ("12,111,123.", 12111123.0), ("12,111,123,", 12111123.0),
    ("- 42", 42.0), ("total - 5", 5.0), ("-€500", 500.0), ("no. 5", 5.0),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"({quoted(t)}, CAST({'NULL' if n is None else n} AS DOUBLE), CAST({'NULL' if n is None else n} AS DOUBLE))" for t, n in NUMBERS) + ") v(said, kernel, plain)")
def golden_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(t,) for t, _ in NUMBERS], "said string")
    return df.select("said", M.parse_number("said").alias("kernel"), native.number(F.col("said")).alias("plain"))


COLORS = {"Color": enum("red", "green", "blue"), "Dessert": enum("icecream", "pie"), "Accented": enum("café", "thé"), "Dotted": enum("a.b", "c"), "Item": struct(Field("name", STR), Field("n", INT)), "One": struct(Field("v", INT)), "Aliased": struct(Field("v", INT, aliases=("Value",))), "Open": struct(Field("v", INT), extra=True), "Two": struct(Field("a_b", INT, 0), Field("ab", INT, 0))}
#: Fixed values: (text, target, expected value as JSON or null for an error, flags, score).
COERCED = (
    ('"42"', "StrictInt", "42", "string_to_int", 1), ('"3.0"', "StrictInt", "3", "string_to_int", 1), ('"-7"', "StrictInt", "-7", "string_to_int", 1),
    ('"1.4"', "StrictInt", None, None, None), ('"$5"', "StrictInt", None, None, None), ('"6/2"', "StrictInt", None, None, None),
    ('"$5"', "int", "5", "string_to_float", 1), ('"6/2"', "int", "3", "string_to_float", 1), ('"no. 5"', "int", "5", "string_to_float", 1), ('"- 42"', "int", "42", "string_to_float", 1),
    ('"2.5"', "StrictFloat", "2.5", "string_to_float", 1), ('"1/2"', "StrictFloat", "0.5", "string_to_float", 1), ('"$1,234.50"', "StrictFloat", "1234.5", "string_to_float", 1), ('"7"', "StrictFloat", "7.0", "string_to_int", 1),
    ('"yes"', "StrictBool", "true", "string_to_bool", 1), ('"No"', "StrictBool", "false", "string_to_bool", 1), ("true", "StrictBool", "true", "", 0), ('"on"', "bool", "true", "", 0), ('"t"', "StrictBool", None, None, None),
    ("1", "list[int]", "[1]", "single_to_array", 1), ('"1"', "list[int]", "[1]", "single_to_array", 1), ('["1", "2"]', "list[int]", "[1, 2]", "", 0),
    ('"RED"', "Color", '"red"', "case_insensitive", 3), ('"ice-cream"', "Dessert", '"icecream"', "strip_punct", 3), ('"cafe"', "Accented", '"café"', "accent_insensitive", 2), ('" red "', "Color", None, None, None), ('"xaby"', "Dotted", None, None, None),
    ('{"Name": "x", "N": "3"}', "Item", '{"name": "x", "n": 3}', "key_normalized,key_normalized", 6), ('{"name": "x", "n": 3, "z": 1}', "Item", '{"name": "x", "n": 3}', "", 0), ('{"Name": "x", "n": 3, "z": 1}', "Item", '{"name": "x", "n": 3}', "key_normalized,extra_key", 4),
    ('{"name": "x", "Name": "y", "N": 1}', "Item", '{"name": "x", "n": 1}', "key_collision,key_normalized", 8), ('{"A-B": 1, "z": 2}', "Two", '{"a_b": 0, "ab": 0}', "", 0),
    ("7", "One", '{"v": 7}', "implied_key", 2), ("7", "Aliased", None, None, None), ('{"V": 1, "w": 2}', "Open", '{"v": 1, "w": 2}', "key_normalized", 3),
    ("5", "str", '"5"', "object_to_string", 2), ("true", "str", '"true"', "object_to_string", 2), ('{"a":1}', "str", '"{\\"a\\":1}"', "object_to_string", 2), ("plain", "str", '"plain"', "fixed_json,closed_unclosed", 0),
    ('{"a": "1", "b": 2}', "dict[str, int]", '{"a": 1, "b": 2}', "", 0), ('{"1": "x"}', "dict[int, str]", '{"1": "x"}', "", 0),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"({quoted(t)}, {quoted(k)}, {quoted(v)}, {quoted(f)}, CAST({'NULL' if n is None else n} AS INTEGER))" for t, k, v, f, n in COERCED) + ") v(said, target, value, flags, score)")
def golden_coercions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mendframe.kernel.coerce import parse
    from mendframe.schema import dumps

    kinds = {name: evals.target(name, COLORS) for _, name, *_ in COERCED}

    def run(said, name):
        try:
            s = parse(said, kinds[name])
        except ValueError:
            return {"value": None, "flags": None, "score": None}
        return {"value": dumps(s.value), "flags": ",".join(s.flags), "score": s.score}

    df = spark.createDataFrame([(t, k) for t, k, *_ in COERCED], "said string, target string")
    return df.select("said", "target", batched(run, "struct<value:string,flags:string,score:int>", "said", "target").alias("r")).select("said", "target", "r.*")


#: Fixed values: (text, whether it is all, options, fixes of the readings in order, the value of one of them as JSON).
READ = (
    ('{"a": 1,}', True, {}, "fixed_json|as_string", '{"a": 1}'), ("[1, 2, 3,]", True, {}, "fixed_json|as_string", "[1, 2, 3]"), ("{a: 1, b: 2}", True, {}, "fixed_json|as_string", '{"a": 1, "b": 2}'),
    ("{'k': 'v'}", True, {}, "fixed_json|as_string", '{"k": "v"}'), ('{"a": 1 "b": 2}', True, {}, "fixed_json|as_string", '{"a": 1, "b": 2}'), ("{c: 1/2, d: 3}", True, {}, "fixed_json|as_string", '{"c": "1/2", "d": 3}'),
    ('{ /* x */ "a": 1, // y\n "b": [1 2] # z\n}', True, {}, "fixed_json|as_string", '{"a": 1, "b": ["1 2"]}'),
    ('```json\n{"a": 1}\n```', True, {}, "markdown|grepped_json|fixed_json|as_string", '{"a": 1}'), ('~~~\n{"x": 42}\n~~~', True, {}, "markdown|grepped_json|fixed_json|as_string", '{"x": 42}'),
    ('```json\n{"a": 1}\n```\n\n```json\n{"b": 2}\n```\n', True, {}, "markdown|markdown|markdown_array|grepped_json|grepped_json|grepped_array|fixed_json,inferred_array,closed_unclosed|as_string", '[{"a": 1}, {"b": 2}]'),
    ('```\n[1]\n```\nand more', True, {"allow_find_all_json_objects": False, "allow_fixes": False}, "markdown|markdown_tail|as_string", '"and more"'),
    ('```json\n{"a": 1,}\n```', True, {"allow_fixes": False, "allow_find_all_json_objects": False, "allow_as_string": False}, "markdown,fixed_json|markdown,as_string|markdown_array", '{"a": 1}'),
    ('one {"a": 1} two {"b": 2} end', True, {"allow_fixes": False}, "grepped_json|grepped_json|grepped_array|as_string", '[{"a": 1}, {"b": 2}]'),
    ('say {"a": 1', False, {"allow_fixes": False}, "", '"say {\\"a\\": 1"'), ("[12", False, {}, "fixed_json,closed_unclosed|as_string", "[12]"), ('{"a": 11, "b": 22', False, {}, "fixed_json,closed_unclosed|as_string", '{"a": 11, "b": 22}'),
    ("{a: 1} {b: 2}", True, {}, "fixed_json|fixed_json|fixed_array|as_string", '[{"a": 1}, {"b": 2}]'), ('"a", "b"', True, {}, "fixed_json,inferred_array,closed_unclosed|as_string", '["a", ", \\"b\\""]'),
    ('{a: """\n  one\n  two\n"""}', True, {}, "fixed_json|as_string", '{"a": "one\\ntwo"}'), ("[a, 1_000, TRUE, null, nope no]", True, {}, "fixed_json|as_string", '["a", 1000, true, null, "nope", "no"]'),
    ("5", True, {}, "", "5"), ('"say "hi', True, {"allow_fixes": False}, "", '"\\"say \\"hi"'),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}, {quoted(f)}, true)" for k, (_, _, _, f, _) in enumerate(READ)) + ") v(case_id, fixes, held)")
def golden_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which readings a text has, in order, and that one of them is the value."""
    from mendframe.kernel.candidates import candidates

    def run(said, done, options, value):
        found = candidates(said, ParseOptions(**json.loads(options)), done)
        return {"fixes": "|".join(",".join(c.fixes) for c in found), "held": any(evals.same(c.value, json.loads(value)) for c in found)}

    df = spark.createDataFrame([(k, json.dumps([t, d, o, v])) for k, (t, d, o, _, v) in enumerate(READ)], "case_id int, c string")
    out = batched(lambda c: (lambda t, d, o, v: run(t, d, json.dumps(o), v))(*json.loads(c)), "struct<fixes:string,held:boolean>", "c")
    return df.select("case_id", out.alias("r")).select("case_id", "r.*")


#: Cases as a dataset has them; every evaluator occurs.
CASES = (
    {"name": "two objects", "inputs": {"text": 'see {"a": 1} and {"a": 2}'}, "expected_output": [{"a": 1}, {"a": 2}], "evaluators": [{"HasCandidates": True}, "MatchesExpected", {"CandidateCountAtLeast": 4}, {"CompletionIs": "incomplete"}]},
    {"name": "a number may go on", "inputs": {"text": "12"}, "expected_output": 12, "evaluators": ["MatchesExpected", {"CompletionIs": "INCOMPLETE"}]},
    {"name": "one is not true", "inputs": {"text": "true"}, "expected_output": 1, "evaluators": ["MatchesExpected"]},
    {"name": "flags and score", "inputs": {"text": '"BLUE"', "target": "Color"}, "expected_output": "blue", "evaluators": ["MatchesExpected", {"FlagsInclude": ["case_insensitive"]}, {"FlagsExclude": "strip_punct"}, {"ScoreMax": 3}]},
    {"name": "too dear", "inputs": {"text": '"BLUE"', "target": "Color"}, "expected_output": "blue", "evaluators": [{"ScoreMax": 2}, {"FlagsInclude": "substring_match"}, "NoSuch"]},
    {"name": "by option", "inputs": {"text": '"blu"', "target": "Color", "coerce_options": {"allow_substring_enum_match": True}}, "expected_output": "blue", "evaluators": ["MatchesExpected", {"FlagsInclude": "substring_match"}]},
)


@query("SELECT * FROM (VALUES ('two objects', ''), ('a number may go on', ''), ('one is not true', 'MatchesExpected'), ('flags and score', ''), ('too dear', 'ScoreMax,FlagsInclude,no such evaluator: NoSuch'), ('by option', '')) v(name, failed)")
def evaluated_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(c["name"], json.dumps(c)) for c in CASES], "name string, c string")
    return df.select("name", batched(lambda c: ",".join(evals.check(json.loads(c), COLORS)), "string", "c").alias("failed"))


# --- reading


@query("SELECT o_orderkey, 'one,two' AS parts, 'fixed_json' AS flags, CAST(2 AS BIGINT) AS blocks, 'markdown_array' AS both, 'fixed_array' AS two FROM orders")
def readings_of_several_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays, triple quotes, comments; several fenced blocks; several bare objects."""
    bare = text('[one /* %s */ , """\n  two\n"""]', "o_orderkey")
    fenced = text("```\n[%s]\n```\ntext\n~~~json\n[2]\n~~~\n", "o_orderkey")
    several = text("{a: %s} {a: 2}", "o_orderkey")
    numbers = list_of(list_of(INT))
    only = ParseOptions(allow_find_all_json_objects=False, allow_fixes=False)
    df = orders(spark, sf_dir).select("o_orderkey", M.parse(bare, list_of(STR)).alias("b"), F.size(M.markdown_blocks(fenced)).cast("long").alias("blocks"), M.parse(fenced, numbers, only).alias("f"), M.parse(several, list_of(struct(Field("a", INT)))).alias("s"))
    array = F.when(F.get("f.value", F.lit(0))[0] == F.col("o_orderkey"), flat("f.flags"))
    return df.select("o_orderkey", F.array_join("b.value", ",").alias("parts"), flat("b.flags").alias("flags"), "blocks", array.alias("both"), F.when(F.size("s.value") == 2, F.element_at(F.split(flat("s.flags"), ","), -1)).alias("two"))


@query("SELECT o_orderkey, CAST(64 AS BIGINT) AS kept, true AS failed, 'incomplete' AS cut_off, 'complete' AS whole, CAST(0 AS BIGINT) AS none FROM orders")
def limits_and_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 64 readings; a depth beyond the limit is no reading; completion;
    an unterminated region isn't found."""
    many = F.concat(text("k%s ", "o_orderkey"), F.repeat(F.lit("{a: 1} "), 70))
    deep = F.concat(F.repeat(F.lit("["), 5), F.col("o_orderkey").cast("string"))
    shallow = M.parse(text("```\n%s\n```", "o_orderkey"), list_of(STRICT_INT), ParseOptions(depth_limit=1, allow_as_string=False, allow_fixes=False))
    df = orders(spark, sf_dir).select("o_orderkey", F.size(F.filter(M.parse_candidates(many, list_of(ANY)), lambda c: c["idx"] >= 0)).cast("long").alias("kept"), shallow["error"].isNotNull().alias("failed"), M.completion(deep).alias("cut_off"), M.completion(text('{"a": %s}', "o_orderkey")).alias("whole"))
    return df.withColumn("none", F.size(M.json_objects(text('see {"a": %s', "o_orderkey"))).cast("long"))


@query("SELECT o_orderkey, 'object_to_string' AS flags, CAST(o_orderkey AS VARCHAR) AS number, '{\"a\":' || o_orderkey || '}' AS object, CAST(o_orderkey AS BIGINT) AS v, CAST(NULL AS VARCHAR) AS lost FROM orders")
def raw_text_as_a_last_resort(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = orders(spark, sf_dir).select("o_orderkey", M.parse(text("%s", "o_orderkey"), STR).alias("n"), M.parse(text('{"a":%s}', "o_orderkey"), STR).alias("o"), M.parse(text("{v: %s, w: {x: 1}}", "o_orderkey"), struct(Field("v", INT), Field("w", STR, None))).alias("f"), M.parse(text('"%s"', STATUS), INT).alias("e"))
    return df.select("o_orderkey", flat("n.flags").alias("flags"), F.col("n.value").alias("number"), F.col("o.value").alias("object"), F.col("f.value.v").alias("v"), F.col("e.value").cast("string").alias("lost"))


@query("SELECT o_orderkey, o_orderkey AS variant, o_orderstatus AS word, o_orderkey AS first, o_orderstatus AS second, o_orderstatus AS by_key, CAST(o_orderdate AS DATE) AS day, round(o_totalprice, 2) AS price FROM orders")
def unions_tuples_and_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = struct(Field("u", union(INT, STR)), Field("w", union(INT, enum("F", "O", "P"))), Field("t", tuple_of(STRICT_INT, enum("F", "O", "P"))), Field("m", dict_of(STR, INT)), Field("at", DATETIME), Field("p", DECIMAL))
    said = F.format_string('{"u": %s, "w": "%s", "t": ["%s", "%s"], "m": {"%s": "%s"}, "at": "%s", "p": "%s"}', F.col("o_orderkey").cast("string"), F.lower(STATUS), F.col("o_orderkey").cast("string"), F.lower(STATUS), F.col("o_orderkey").cast("string"), STATUS, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.round(PRICE, 2).cast("decimal(18,2)").cast("string"))
    v = orders(spark, sf_dir).select("o_orderkey", M.parse(said, kind, coerce=CoerceOptions(deep_coercion=True)).alias("r")).select("o_orderkey", "r.value.*")
    return v.select("o_orderkey", F.col("u").cast("long").alias("variant"), F.get_json_object(F.concat(F.lit('{"v": '), "w", F.lit("}")), "$.v").alias("word"), F.col("t._1").alias("first"), F.col("t._2").alias("second"), F.col("m")[F.col("o_orderkey")].alias("by_key"), F.to_date("at").alias("day"), F.col("p").cast("double").alias("price"))


@query("SELECT o_orderkey, CAST(2 AS BIGINT) AS rows, CAST(-1 AS BIGINT) AS direct, 'case_insensitive' AS flags, CAST(1 AS BIGINT) AS plain FROM orders")
def coercion_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = struct(Field("s", enum("F", "O", "P")))
    df = orders(spark, sf_dir).select("o_orderkey", M.coerce_candidates(F.format_string('{"s": "%s"}', F.lower(STATUS)), kind).alias("c"), M.coerce_candidates(text('{"s": "%s"}', STATUS), kind).alias("p"))
    return df.select("o_orderkey", F.size("c").cast("long").alias("rows"), F.col("c")[0]["score"].cast("long").alias("direct"), flat(F.col("c")[1]["flags"]).alias("flags"), F.size("p").cast("long").alias("plain"))


@query("SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS price FROM orders WHERE o_orderkey % 3 > 0")
def malformed_rows_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("o_orderkey") % 3 == 0, F.lit("nothing here")).otherwise(text("{price: %s}", PRICE))
    out = E.parsed(orders(spark, sf_dir).select("o_orderkey", said.alias("t")), "t", struct(Field("price", FLOAT), Field("more", STR, None)), mode="DROPMALFORMED")
    return out.select("o_orderkey", F.col("value.price").alias("price"))


@query("SELECT o_orderkey, o_orderstatus AS status, 'partial_model' AS flags, CAST(1 AS BIGINT) AS score, CAST(NULL AS BIGINT) AS id, o_orderstatus || '...' AS tail FROM orders")
def partial_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream has so far: fields still to come are null, the last one is cut off."""
    said = text('{"status": "%s", "id": "soon', STATUS)
    df = orders(spark, sf_dir).select("o_orderkey", STATUS, M.parse(said, ITEM, is_done=False, partial=True).alias("r"))
    return df.select("o_orderkey", F.col("r.value.status").alias("status"), F.element_at("r.flags", -1).alias("flags"), F.col("r.score").cast("long").alias("score"), F.col("r.value.id").alias("id"), F.concat("r.value.status", F.lit("...")).alias("tail"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, length(props) AS kept FROM events")
def stream_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bounded buffer keeps the end of what came: junk in front is pushed out."""
    from mendframe.streaming.parser import read

    def run(props):
        buffer = ""
        for chunk in ("x" * 50, props[:3], props[3:]):
            buffer = (buffer + chunk)[-len(props) :]
        return {"value_json": read(buffer, struct(Field("k", INT)), True)[0], "n": len(buffer)}

    df = wide(spark, sf_dir, "events").select("event_id", batched(run, "struct<value_json:string,n:long>", "props").alias("r"))
    return df.select("event_id", F.get_json_object("r.value_json", "$.k").cast("long").alias("k"), F.col("r.n").alias("kept"))


# --- patches


@query("""SELECT o_orderkey, '{"n": ' || o_orderkey || ', "list": [0, 1], "new": [{"k": "v"}]}' AS kept, 'no key' AS missing, 'no such' AS other, true AS depth FROM orders""")
def patch_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers made on the way, insertion, removal; what must fail."""
    kind = "array<struct<op:string,path:string,value_json:string>>"

    def ops(*every: tuple[str, str, str | None]) -> Column:
        return F.from_json(F.lit(json.dumps([{"op": o, "path": p, "value_json": v} for o, p, v in every])), kind)

    doc = text('{"n": %s, "list": [1], "old": true}', "o_orderkey")
    good = ops(("add", "/list/0", "0"), ("remove", "/old", None), ("add", "/new/0/k", '"v"'))
    allowed = Policy(allow_remove=True)
    df = orders(spark, sf_dir).select("o_orderkey", M.apply_patch(doc, good, allowed)["value_json"].alias("kept"), F.left(M.apply_patch(doc, ops(("replace", "/gone", "1")))["error"], F.lit(6)).alias("missing"), F.left(M.apply_patch(doc, ops(("move", "/n", None)))["error"], F.lit(7)).alias("other"), M.apply_patch(doc, ops(("add", "/a/b/c", "1")), Policy(max_path_depth=2))["error"].contains("deep").alias("depth"))
    return df


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey + 1 END AS id, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 0 END AS BIGINT) AS score, o_orderkey % 2 = 1 AS failed FROM orders")
def patch_and_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validated, not coerced: a price in words fails."""
    value = F.when(F.col("o_orderkey") % 2 == 0, (F.col("o_orderkey") + 1).cast("string")).otherwise(F.lit('"no. 5"'))
    ops = F.array(F.struct(F.lit("replace").alias("op"), F.lit("/id").alias("path"), value.alias("value_json")))
    r = M.apply_patch_and_validate(text('{"id": 1, "status": "%s"}', STATUS), ops, ITEM)
    return orders(spark, sf_dir).select("o_orderkey", r.alias("r")).select("o_orderkey", F.col("r.value.id").alias("id"), F.col("r.score").cast("long").alias("score"), F.col("r.error").isNotNull().alias("failed"))


@query("""SELECT o_orderkey, '/id,/status' AS paths, '/a/' || o_orderkey || '/c,/a/' || o_orderkey || ',/a' AS parents, '{"type": "object", "properties": {"id": {"type": "integer"}}, "required": ["id"]}' AS slice, 'id: int' AS lines FROM orders""")
def error_paths_and_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = orders(spark, sf_dir).select("o_orderkey", M.schema_errors(text('{"id": "%s", "n": 1}', STATUS), ITEM).alias("e"), native.parent_paths(text("/a/%s/c", "o_orderkey")).alias("p"))
    schema, lines = F.lit(json.dumps(ITEM.json_schema())), F.lit("id: int\nstatus: str")
    first = F.slice("e", 1, 1)
    one_line = F.regexp_replace(F.regexp_replace(M.slice_schema(schema, first), r"\n\s*", " "), r"([{\[]) | ([}\]])", "$1$2")
    return df.select("o_orderkey", F.array_join("e", ",").alias("paths"), F.array_join("p", ",").alias("parents"), one_line.alias("slice"), M.slice_schema(lines, first).alias("lines"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END AS attempts, o_orderkey AS id, o_orderstatus AS status FROM orders")
def repair_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that don't parse are asked about, with the parts that are wrong."""

    def answer(asked: str) -> str:
        known = json.loads(asked.split("Document: ")[1].split("\n")[0])
        right = "Wrong: /status" in asked and "status" in asked.split("Schema: ")[1].split("\n")[0] and known == {"status": None}
        return '[{"op": "add", "path": "/status", "value": "?"}]' if right else "[]"

    said = F.when(F.col("o_orderkey") % 2 == 0, text('{"id": %s, "status": "%s"}', "o_orderkey", STATUS)).otherwise(text('{"id": %s, "stat": 1}', "o_orderkey"))
    out = repair(orders(spark, sf_dir).select("o_orderkey", STATUS, said.alias("t")), Calling(answer), ITEM, "o_orderkey", "t")
    known = table(spark, sf_dir, "orders").select("o_orderkey", STATUS)
    get = lambda p: F.get_json_object("value_json", p)
    return out.join(known, "o_orderkey").select("o_orderkey", "attempts", get("$.id").cast("long").alias("id"), F.when(get("$.status") == "?", F.col(STATUS)).otherwise(get("$.status")).alias("status"))


@query("""SELECT * FROM (VALUES (true, true, true)) v(schema, document, paths)""")
def repair_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question holds the sliced schema, the sliced document and the paths."""
    asked = patch_prompt(ITEM, {"id": "x", "status": "F"}, ["/id"], "bad")
    return spark.createDataFrame([('"status"' not in asked.split("Schema: ")[1].split("\n")[0], 'Document: {"id": "x"}\n' in asked, "Wrong: /id\n" in asked)], "schema boolean, document boolean, paths boolean")


# --- texts


@query("SELECT o_orderkey, CAST(3 AS BIGINT) AS chunks, 'Order ' || o_orderkey || '.' AS first, 'It is ' || o_orderstatus AS second, CAST(length('Order ' || o_orderkey || '.') + 1 AS BIGINT) AS start, 'donaudampfschiff' AS alone FROM orders")
def chunk_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts after a sentence and at a line; a token that is too long stands alone."""
    said = text("Order %s. It is %s\ndonaudampfschiff", "o_orderkey", STATUS)
    c = orders(spark, sf_dir).select("o_orderkey", M.chunks(said, 15).alias("c"))
    at = lambda k: F.get("c", F.lit(k))
    return c.select("o_orderkey", F.size("c").cast("long").alias("chunks"), at(0)["text"].alias("first"), at(1)["text"].alias("second"), at(1)["start"].cast("long").alias("start"), at(2)["text"].alias("alone"))


@query("SELECT o_orderkey, CAST(3 AS BIGINT) AS first, CAST(4 AS BIGINT) AS behind, CAST(6 AS BIGINT) AS graphemes FROM orders")
def spans_and_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters to tokens; the second tokenizer counts graphemes."""
    said = text("a key: %s here", "o_orderkey")
    end = F.lit(7) + F.length(F.col("o_orderkey").cast("string"))
    df = orders(spark, sf_dir).select("o_orderkey", M.token_span(said, F.lit(7), end).alias("s"), F.size(M.tokens(F.concat(F.lit("é x\U0001f469‍\U0001f469‍\U0001f467 y"), F.lower(STATUS), F.lit("!")), unicode=True)).cast("long").alias("graphemes"))
    return df.select("o_orderkey", F.col("s.start").cast("long").alias("first"), F.col("s.end").cast("long").alias("behind"), "graphemes")


@query("SELECT o_custkey AS k, CAST(count(*) + 1 AS BIGINT) AS kept, true AS first_whole FROM orders GROUP BY 1")
def evidence_of_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second pass adds what overlaps nothing kept: its first far span, not the next."""
    at = (F.col("o_orderkey") % 97).cast("int")
    one = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.sort_array(F.collect_list(F.struct(at.alias("start"), (at + 5).alias("end")))).alias("p"))
    far = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((1000, 1010), (1005, 1020))))
    near = F.slice("p", 1, 1)
    kept = M.merge_evidence(F.array("p", F.concat(near, far)))
    return one.select("k", F.size(kept).cast("long").alias("kept"), (F.slice(kept, 1, F.size("p")) == F.col("p")).alias("first_whole"))


# --- extraction


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN o_orderstatus ELSE o_orderstatus END AS status, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'case_insensitive,fixed_json' ELSE 'fixed_json,substring_match' END AS flags, CAST(CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 2 END AS BIGINT) AS score, CASE o_orderkey % 3 WHEN 0 THEN NULL ELSE true END AS raw, o_orderkey % 3 = 0 AS failed FROM orders")
def extraction_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty answers are passed over, looser domains are tried once more, flags,
    score and the last answer are kept, and the merged value is validated."""

    def answer(asked: str) -> str:
        words = asked.rsplit("\nQ: ", 1)[1].split()
        kind, status = int(words[0]) % 3, words[1]
        return "" if kind == 0 else f"{{status: {status.lower()}}}" if kind == 1 else f"{{status: {status}zz}}"

    said = text("%s %s", "o_orderkey", STATUS)
    out = E.extract(orders(spark, sf_dir).select("o_orderkey", said.alias("text")), Calling(answer), struct(Field("status", enum("F", "O", "P"))), E.ExtractOptions(batch_length=16), "o_orderkey")
    return out.select("o_orderkey", F.get_json_object("value_json", "$.status").alias("status"), flat("flags").alias("flags"), F.col("score").cast("long").alias("score"), F.when(F.col("raw_text").isNotNull(), F.col("raw_text").contains("status")).alias("raw"), F.col("error").isNotNull().alias("failed"))


@query("SELECT o_orderkey, 'fast' AS said, 'first' AS by_class FROM orders")
def provider_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priority decides among patterns; few outputs repeat the last."""
    known = Registry()
    known.register("^mod", lambda: Static(("slow",)))
    known.register("^model-", lambda: Static(("fast",)), priority=1)
    other = Registry()
    other.register("x", lambda: Static(("first",)))
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("q").alias("p"))
    return E.infer(E.infer(df, known.resolve("model-7"), "p", "said"), other.by_class("static"), "p", "by_class").drop("p")


@query("""SELECT * FROM (VALUES (true, true, true, true)) v(yaml, wrapped, schema, examples)""")
def extraction_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = E.ExtractOptions(format="yaml", wrapper_key="rows", examples=(("Ann is 3", '[{"id": 3, "status": "Ann"}]'),))
    asked = E.prompt(list_of(ITEM), options)
    return spark.createDataFrame([("```yaml\n" in asked, "rows:\n- id: 3" in asked, '"type": "array"' in asked, E.check_examples(list_of(ITEM), options) == [])], "yaml boolean, wrapped boolean, schema boolean, examples boolean")


@query("SELECT o_orderkey, o_orderkey AS id, CAST(4 AS BIGINT) AS rows, 'x y' AS key, 7.5 AS number FROM orders")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names in SQL: scalar and table functions."""
    from mendframe.functions.sql import register

    register(spark)
    table(spark, sf_dir, "orders").createOrReplaceTempView("mendframe_orders")
    return spark.sql("""SELECT o_orderkey, first(CAST(get_json_object(schema_parse(concat('see {"id": ', o_orderkey, '} ok'), 'id BIGINT'), '$.id') AS BIGINT)) AS id, count(*) AS rows,
        concat(substr(first(normalize_key('X ')), 1, 1), ' ', first(normalize_key(' Y-'))) AS key, CAST(first(parse_number('$7.5 only')) AS DECIMAL(2,1)) AS number
        FROM mendframe_orders, LATERAL parse_debug(concat('see {"id": ', o_orderkey, '} ok'), 'id BIGINT') GROUP BY o_orderkey""")

