"""The DataFrame surface: columns, SQL functions, plans, streaming, providers."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from mendframe import functions as M
from mendframe import queries
from mendframe.functions.sql import register
from mendframe.kernel.patch import Policy
from mendframe.plans import extract as E
from mendframe.plans.repair import repair
from mendframe.schema import DECIMAL, FLOAT, INT, STR, Field, dict_of, enum, from_ddl, list_of, struct, tuple_of, union
from mendframe.sources.providers import Calling, Registry, Static
from mendframe.streaming.parser import parse_stream

ITEM = struct(Field("name", STR), Field("n", INT, 0))


def test_parse_column_survives_anything(spark):
    df = spark.createDataFrame([("{name: x, n: 2}",), (None,), ("",), ("no",), ('{"name": 5}',)], "t string")
    rows = [r[0] for r in df.select(M.parse("t", ITEM)).collect()]
    assert rows[0].value.asDict() == {"name": "x", "n": 2} and rows[1] is None
    assert rows[4].value is None and rows[4].error
    with pytest.raises(Exception, match="string"):
        df.where("t like '%5%'").select(M.parse("t", ITEM, mode="FAILFAST")).collect()


def test_nested_values(spark):
    kind = struct(Field("m", dict_of(FLOAT)), Field("l", list_of(ITEM)))
    df = spark.createDataFrame([('{m: {a: "1.5"}, l: [{name: q}, {Name: r, n: "3"}]}',)], "t string")
    v = df.select(M.parse("t", kind).alias("r")).first().r.value
    assert v.m == {"a": 1.5} and [(x.name, x.n) for x in v.l] == [("q", 0), ("r", 3)]


def test_sql_functions(spark):
    register(spark)
    spark.createDataFrame([(1, 'see {"a": 1} ok')], "id int, t string").createOrReplaceTempView("texts")
    assert spark.sql("SELECT idx, score FROM texts, LATERAL parse_debug(t, 'a INT')").count() == 4
    assert spark.sql("SELECT schema_parse(t, 'a INT') FROM texts").first()[0] == '{"a": 1}'
    assert spark.sql("SELECT * FROM texts, LATERAL text_tokens(t)").count() == 7
    assert spark.sql("SELECT * FROM texts, LATERAL text_chunks(t, 4, 0)").count() >= 3
    assert spark.sql("SELECT path FROM json_leaves('{\"x\": [1]}')").first()[0] == "/x/0"
    assert spark.sql("SELECT * FROM texts, LATERAL json_objects(t)").count() == 1


def test_extraction(spark):
    docs = spark.createDataFrame([("d1", "Ann has 3 cats.\nBob has 4 dogs."), ("d2", ""), ("d3", None)], "document_id string, text string")

    def answer(asked):
        line = asked.rsplit("\nQ: ", 1)[1].split("\n")[0]
        w = line.split()
        return f"[{{name: {w[0]}, n: {w[2]}}}]" if len(w) > 2 else ""

    out = {r.document_id: r for r in E.extract(docs, Calling(answer), list_of(ITEM), E.ExtractOptions(max_char_buffer=16, passes=2)).collect()}
    assert out["d1"].value_json == '[{"name": "Ann", "n": 3}, {"name": "Bob", "n": 4}]'
    assert [(e.value_preview, e.start, e.end) for e in out["d1"].evidence] == [("Ann", 0, 3), ("3", 8, 9), ("Bob", 16, 19), ("4", 24, 25)]
    assert out["d2"].value_json is None and set(out) == {"d1", "d2", "d3"}
    assert out["d1"].raw_text == "[{name: Bob, n: 4}]" and out["d3"].error == "no text"


def test_extraction_keeps_repeated_and_null_ids_apart(spark):
    docs = spark.createDataFrame([(1, "Ann has 3 cats."), (1, "Bob has 4 dogs."), (None, "Cid has 5 cows."), (None, None)], "document_id int, text string")

    def answer(asked):
        w = asked.rsplit("\nQ: ", 1)[1].split()
        return f"{{name: {w[0]}, n: {w[2]}}}"

    options = E.ExtractOptions(passes=2, debug=True, format="yaml", wrapper_key="rows", context="pets", examples=(("Zoe has 1 pig", '[{"name": "Zoe", "n": 1}]'),))
    rows = E.Extractor(Calling(answer), ITEM, options).extract(docs).collect()
    assert sorted((str(r.document_id), str(r.value_json)) for r in rows) == [("1", '{"name": "Ann", "n": 3}'), ("1", '{"name": "Bob", "n": 4}'), ("None", "None"), ("None", '{"name": "Cid", "n": 5}')]
    one = next(r for r in rows if r.value_json and "Ann" in r.value_json)
    assert [(d["pass"], d.text_preview) for d in one.debug] == [(0, "Ann has 3 cats."), (1, "Ann has 3 cats.")] and "```yaml\nrows:\n- name: Zoe" in one.prompt_preview and "Context: pets" in one.prompt_preview


def test_examples_are_checked():
    good, bad = ("Ann is 3", '{"name": "Ann", "n": 3}'), ("Ann", '{"name": "Zoe"}')
    assert E.check_examples(ITEM, E.ExtractOptions(examples=(good,))) == []
    assert len(E.check_examples(ITEM, E.ExtractOptions(examples=(bad, ("x", "{}"))))) == 3
    assert "Q: Ann is 3" in E.prompt(ITEM, E.ExtractOptions(examples=(good,)))
    with pytest.raises(ValueError, match="text"):
        E.check_examples(ITEM, E.ExtractOptions(examples=(bad,), check="error"))
    with pytest.warns(UserWarning, match="text"):
        E.check_examples(ITEM, E.ExtractOptions(examples=(bad,), check="warning"))


def test_rows_of_an_update_are_asked_about_together(spark):
    asked = []

    class Counting:
        def infer(self, prompts):
            asked.append(len(prompts))
            return [('[{"op": "add", "path": "/n", "value": 2}]' if "failed" in p else "nothing") for p in prompts]

    from mendframe.plans.repair import repair_all

    rows = repair_all(['{"name": "a"}', '{"n": 1}', None, '{"n": 2}', "x"], Static(('[{"op": "add", "path": "/name", "value": "y"}]',)), ITEM, Policy(), 2, 8)
    assert [r["attempts"] for r in rows] == [0, 1, 0, 1, 2] and rows[2]["error"] == "no text" and rows[4]["value"] is None and rows[1]["error"] is None
    docs = spark.createDataFrame([(k, '{"name": "a"}') for k in range(5)] + [(9, None)], "doc_id int, doc_json string").coalesce(1)
    out = E.update(docs, "x", Counting(), ITEM, batch_length=5).collect()
    assert [(r.attempts, r.value_json) for r in out] == [(2, '{"name": "a", "n": 2}')] * 5 + [(0, None)] and {r.before for r in out} == {'{"name": "a"}', None}


def test_malformed_rows(spark):
    df = spark.createDataFrame([(1, "{name: x}"), (2, "{n: 1}"), (3, None)], "id int, t string")
    assert [r.id for r in E.parsed(df, "t", ITEM, mode="DROPMALFORMED").collect()] == [1]
    assert [(r.id, r.value and r.value.name) for r in E.parsed(df, "t", ITEM).collect()] == [(1, "x"), (2, None), (3, None)]
    with pytest.raises(Exception, match="name"):
        E.parsed(df, "t", ITEM, mode="FAILFAST").collect()


def test_times_unions_tuples_and_exact_numbers(spark):
    import datetime as dt
    import decimal

    kind = from_ddl("at TIMESTAMP, day DATE, price DECIMAL(10,2), raw BINARY, n MAP<INT, STRING>")
    df = spark.createDataFrame([('{at: "2024-05-06T07:08:09Z", day: "2024-05-06", price: "12.34", raw: "ab", n: {"1": "x"}}',), ('{"at": "soon"}',)], "t string")
    a, b = (r.r for r in df.select(M.parse("t", kind).alias("r")).collect())
    assert (a.value.at.astimezone(dt.UTC), a.value.day, a.value.price, bytes(a.value.raw), a.value.n) == (dt.datetime(2024, 5, 6, 7, 8, 9, tzinfo=dt.UTC), dt.date(2024, 5, 6), decimal.Decimal("12.34"), b"ab", {1: "x"})
    assert b.value is None and b.error
    kind = struct(Field("v", union(INT, STR)), Field("p", tuple_of(INT, enum("a", "b"))))
    df = spark.createDataFrame([('{"v": "42", "p": [1, "a"]}',), ('{"v": 42, "p": ["2", "b"]}',)], "t string")
    assert [(r.r.value.v, r.r.value.p._1, r.r.value.p._2) for r in df.select(M.parse("t", kind).alias("r")).collect()] == [('"42"', 1, "a"), ("42", 2, "b")]


def test_update_and_repair(spark):
    docs = spark.createDataFrame([(1, '{"name": "a", "n": 1}')], "doc_id int, doc_json string")
    out = E.update(docs, "rename", Static(('{"op": "replace", "path": "/name", "value": "b"}',)), ITEM).first()
    assert out.value_json == '{"name": "b", "n": 1}' and out.attempts == 1
    failed = E.update(docs, "x", Static(('[{"op": "remove", "path": "/name"}]',)), ITEM, max_retries=1).first()
    assert failed.value_json is None and failed.attempts == 2 and "remove" in failed.error
    texts = spark.createDataFrame([(1, '{"name": "x"}'), (2, '{"nom": 1}'), (3, None)], "id int, text string")
    mended = {r.id: r for r in repair(texts, Static(('[{"op": "add", "path": "/name", "value": "y"}]',)), ITEM).collect()}
    assert (mended[1].attempts, mended[2].attempts) == (0, 1) and mended[2].value_json == '{"name": "y", "n": 0}' and mended[3].error


def test_patches_join_in_order(spark):
    docs = spark.createDataFrame([(1, '{"l": []}'), (2, '{"l": []}')], "doc_id int, doc_json string")
    ops = spark.createDataFrame([(1, k, "add", "/l/-", str(k)) for k in (2, 0, 1)], "doc_id int, op_index int, op string, path string, value_json string")
    assert {r.doc_id: r.value_json for r in E.apply_patches(docs, ops, Policy()).collect()} == {1: '{"l": [0, 1, 2]}', 2: '{"l": []}'}


def test_stream(spark, tmp_path):
    rows = [("a", 0, '{"name": "x', False), ("b", 0, '{"name"', False), ("a", 1, 'y", "n": 4', False), ("a", 2, "}", True)]
    schema = "stream_id string, seq long, chunk string, is_final boolean"
    for k, row in enumerate(rows):
        spark.createDataFrame([row], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p={k}"))
    frames = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = parse_stream(frames, struct(Field("name", STR), Field("n", INT))).writeStream.outputMode("update").format("memory").queryName("parsed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    out = [(r.stream_id, r.value_json, r.is_final) for r in spark.table("parsed").collect()]
    assert ("a", '{"name": "xy", "n": 4}', True) in out
    assert ("a", '{"name": "x", "n": null}', False) in out and len(out) == 4


def test_providers():
    assert Static(("a", "b")).infer([1, 2, 3]) == ["a", "b", "b"] and Static().infer(["x"]) == [""]
    r = Registry()
    r.register("^m", lambda: Static(("low",)))
    r.register("^m", lambda: Static(("high",)), priority=2)
    assert r.resolve("model").outputs == ("high",)
    with pytest.raises(KeyError):
        r.resolve("x")


def test_every_query_and_its_sql_are_registered(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(queries.QUERIES) == set(queries.ORACLES)
    assert __spark_entry__.entry(spark).count() == 3


@pytest.mark.parametrize("name", ["number_coerce_native", "enum_match_native", "token_stats_by_lang", "patch_policy_violations", "evidence_overlap"])
def test_native_queries_run_no_python(spark, name):
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    assert F


def test_alignment_of_all_documents_reaches_every_status(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    rows = queries.QUERIES["align_all_values"](spark, folder).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.execute(queries.ORACLES["align_all_values"]).fetchall()
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str) and len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert {r.cased for r in rows} | {r.lesser for r in rows} | {r.fuzzy for r in rows} | {r.foreign_word for r in rows} >= {"exact", "lesser", "fuzzy", "unmatched"}
    assert len({r.cased_token for r in rows}) > 1 or len({r.lesser_token for r in rows}) > 1


def test_alignment_of_documents_with_repeated_tokens(spark, tmp_path):
    import random

    import duckdb

    rng = random.Random(5)
    texts = ["of the , the the in the the the x y , z", *(" ".join(rng.choices("ab,", k=rng.randrange(1, 14))) for _ in range(300)), "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.ORACLES["align_all_values"]).fetchall()
    assert sorted(map(tuple, queries.QUERIES["align_all_values"](spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)


def test_tokens_of_a_batch_are_given_back_in_parts(spark):
    import pyarrow as pa

    from mendframe.functions import columns

    kind = columns.to_arrow_type(columns.T._parse_datatype_string(columns.TOKENS))
    one = {"text": "a", "start": 0, "end": 1, "first_after_newline": False}
    other = {"text": "\u00e9", "start": 2, "end": 3, "first_after_newline": True}
    texts = ["a\n\u00e9", None, "", *("x" * 50_000 if k % 3 == 0 else None if k % 3 == 1 else f"{k} \u00e9" for k in range(900))]
    parts = list(columns._token_arrays(iter([pa.array(texts), pa.array([], pa.string())]), True, kind))
    assert max(len(p.values) for p in parts) < columns.TOKENS_AT_ONCE + 50_000 and [x for p in parts for x in p.to_pylist()][:3] == [[one, other], None, []]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").coalesce(1)
    got = {r.k: r.n for r in df.select("k", F.when(F.col("t").isNotNull(), F.size(columns.tokens("t", unicode=True))).alias("n")).collect()}
    assert got == {k: None if t is None else len("".join(t.split())) for k, t in enumerate(texts)}


def test_short_items_are_found_verbatim(spark, tmp_path):
    import duckdb

    words = "the quick brown fox jumps over the lazy dog and runs off into a wide green field"
    docs = [(1, words), (2, "a quick brown"), (3, "fox"), (4, "x " + words.replace(" ", "  ")), (5, "")]
    items = [(n * 100 + k, " ".join(words.split()[k : k + n])) for n in range(1, 13) for k in range(4)]
    items += [(k + 5000, x[1:-1]) for k, x in items if len(x) > 5] + [(9000, "brown fox "), (9001, " over the lazy dog "), (9002, "not there"), (9003, "dog over the")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(queries.ORACLES["align_exact"]).fetchall()
    assert sorted(map(tuple, queries.QUERIES["align_exact"](spark, str(tmp_path)).collect())) == sorted(want) and len(want) > 90


def test_enum_domain_metadata():
    from pyspark.sql import types as T

    from mendframe.schema import from_spark

    kind = from_spark(T.StructType([T.StructField("a", T.StringType(), metadata={"domain": ["x"], "aliases": ["b"], "default": "x"})]))
    assert kind == struct(Field("a", enum("x"), "x", ("b",)))


def test_ddl():
    assert from_ddl("a INT, `b` ARRAY<STRUCT<c: STRING, d: MAP<STRING, DOUBLE>>>, e DECIMAL(10,2)") == struct(Field("a", INT), Field("b", list_of(struct(Field("c", STR), Field("d", dict_of(FLOAT))))), Field("e", DECIMAL))
