"""The registered queries of the extraction engine and their SQL.

The tables hold no model output, so known columns are corrupted in Spark, then
repaired by the operator under test; the SQL returns the columns themselves and
the flags that the corruption must cost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mendframe import functions as M
from mendframe.functions.columns import batched
from mendframe.kernel.candidates import ParseOptions
from mendframe.kernel.coerce import CoerceOptions
from mendframe.kernel.patch import Policy
from mendframe.operators import native
from mendframe.plans import extract as E
from mendframe.plans.layout import spread
from mendframe.schema import BOOL, FLOAT, INT, STR, STRICT_BOOL, STRICT_INT, Field, dict_of, enum, list_of, struct
from mendframe.sources.providers import Calling

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
ORDER = struct(Field("id", INT), Field("price", FLOAT), Field("status", enum("F", "O", "P")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(table(spark, sf_dir, name))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def flat(flags: Column | str) -> Column:
    return F.array_join(flags, ",")


# --- repair (A1-A7, B1, B13-B15)

PARTS = ("o_orderkey", "o_totalprice", "o_orderstatus")
#: name -> (template of id, price and status, flags, score)
CORRUPTIONS = {
    "strict": ('{"id": %s, "price": %s, "status": "%s"}', "", 0),
    "trailing_comma": ('{"id": %s, "price": %s, "status": "%s",}', "fixed_json", 0),
    "unquoted": ("{id: %s, price: %s, status: %s}", "fixed_json", 0),
    "single_quote": ("{'id': %s, 'price': %s, 'status': '%s'}", "fixed_json", 0),
    "comments": ('{"id": %s, // the key\n "price": %s /* as sold */, # more\n "status": "%s"}', "fixed_json", 0),
    "missing_comma": ('{"id": %s "price": %s "status": "%s"}', "fixed_json", 0),
    "truncated": ('{"id": %s, "price": %s, "status": "%s"', "fixed_json,closed_unclosed", 0),
    "fenced": ('Here it is:\n```json\n{"id": %s, "price": %s, "status": "%s"}\n```', "markdown", 0),
    "prose": ('The order is {"id": %s, "price": %s, "status": "%s"} as you asked.', "grepped_json", 0),
    "wrong_case": ('{"ID": %s, "Price": %s, "status": "%s"}', "key_normalized,key_normalized", 6),
    "strings": ('{"id": "no. %s", "price": "$%s", "status": "%s"}', "string_to_float,string_to_float", 2),
}


def corrupted(name: str) -> Column:
    return F.format_string(CORRUPTIONS[name][0], *(F.col(c).cast("string") for c in PARTS))


def repaired(df: DataFrame, name: str) -> DataFrame:
    return df.select("o_orderkey", M.parse(corrupted(name), ORDER).alias("r")).select("o_orderkey", F.col("r.value.id").alias("id"), F.col("r.value.price").alias("price"), F.col("r.value.status").alias("status"), flat("r.flags").alias("flags"), F.col("r.score").cast("long").alias("score"))


def _register(name: str) -> None:
    _, flags, score = CORRUPTIONS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return repaired(wide(spark, sf_dir, "orders"), name)

    QUERIES[f"repair_orders_{name}"] = run
    ORACLES[f"repair_orders_{name}"] = f"SELECT o_orderkey, o_orderkey AS id, o_totalprice AS price, o_orderstatus AS status, '{flags}' AS flags, CAST({score} AS BIGINT) AS score FROM orders"


for _name in CORRUPTIONS:
    _register(_name)

_CASE = " ".join(f"WHEN {k} THEN '{v[1]}'" for k, v in enumerate(CORRUPTIONS.values()))
_SCORE = " ".join(f"WHEN {k} THEN {v[2]}" for k, v in enumerate(CORRUPTIONS.values()))


@query(f"""SELECT CAST(o_orderkey % {len(CORRUPTIONS)} AS BIGINT) AS variant, CASE o_orderkey % {len(CORRUPTIONS)} {_CASE} END AS flags, count(*) AS n, CAST(sum(CASE o_orderkey % {len(CORRUPTIONS)} {_SCORE} END) AS BIGINT) AS score, CAST(sum(o_custkey) AS BIGINT) AS customers
FROM orders GROUP BY 1, 2""")
def repair_flag_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mixed column of all corruptions, profiled by flags."""
    variant, text = F.col("o_orderkey") % len(CORRUPTIONS), None
    for k, name in enumerate(CORRUPTIONS):
        text = F.when(variant == k, corrupted(name)) if text is None else text.when(variant == k, corrupted(name))
    parsed = wide(spark, sf_dir, "orders").select(variant.alias("variant"), "o_custkey", M.parse(text, ORDER).alias("r"))
    return parsed.groupBy("variant", flat("r.flags").alias("flags")).agg(F.count("*").alias("n"), F.sum("r.score").alias("score"), F.sum(F.when(F.col("r.error").isNull(), F.col("o_custkey"))).alias("customers"))


@query("""SELECT p_partkey, p_name AS name, p_brand AS brand, CAST(p_size AS BIGINT) AS size, 'key_normalized,key_normalized,key_normalized,extra_key' AS flags, CAST(10 AS BIGINT) AS score FROM part""")
def key_normalize_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = struct(Field("p_name", STR), Field("p_brand", STR), Field("p_size", INT))
    text = F.format_string('{"P Name": %s, "p-brand": %s, "PSize": %s, "other": 1}', F.concat(F.lit('"'), "p_name", F.lit('"')), F.concat(F.lit('"'), "p_brand", F.lit('"')), F.col("p_size").cast("string"))
    return wide(spark, sf_dir, "part").select("p_partkey", M.parse(text, kind).alias("r")).select("p_partkey", F.col("r.value.p_name").alias("name"), F.col("r.value.p_brand").alias("brand"), F.col("r.value.p_size").alias("size"), flat("r.flags").alias("flags"), F.col("r.score").cast("long").alias("score"))


_ENUM = "SELECT o_orderkey, o_orderpriority AS priority, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'case_insensitive' ELSE 'strip_punct' END AS flags FROM orders"


def _said(df: DataFrame) -> DataFrame:
    p, k = F.col("o_orderpriority"), F.col("o_orderkey") % 3
    return df.select("o_orderkey", F.when(k == 0, p).when(k == 1, F.lower(p)).otherwise(F.replace(F.lower(p), F.lit("-"), F.lit(""))).alias("said"))


@query(_ENUM)
def enum_match_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(wide(spark, sf_dir, "orders")).select("o_orderkey", M.match_enum("said", PRIORITIES).alias("m")).select("o_orderkey", F.col("m.value").alias("priority"), flat("m.flags").alias("flags"))


@query(_ENUM)
def enum_match_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(table(spark, sf_dir, "orders")).select("o_orderkey", native.enum(F.col("said"), PRIORITIES).alias("m")).select("o_orderkey", F.col("m.value").alias("priority"), flat("m.flags").alias("flags"))


_NUMBERS = "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS quantity, round(l_extendedprice, 2) AS price, round(l_discount * 100, 0) AS discount, l_quantity / 4 AS quarter FROM lineitem"


def _numbers(df: DataFrame) -> DataFrame:
    return df.select("l_orderkey", "l_linenumber", F.format_string("%.1f", "l_quantity").alias("q"), F.concat(F.lit("$"), F.format_number("l_extendedprice", 2)).alias("p"), F.format_string("%.0f%%", F.round(F.col("l_discount") * 100, 0)).alias("d"), F.format_string("%.0f/4", "l_quantity").alias("f"))


@query(_NUMBERS)
def number_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _numbers(wide(spark, sf_dir, "lineitem"))
    return n.select("l_orderkey", "l_linenumber", M.parse_number("q").cast("long").alias("quantity"), M.parse_number("p").alias("price"), M.parse_number("d").alias("discount"), M.parse_number("f").alias("quarter"))


@query(_NUMBERS)
def number_coerce_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _numbers(table(spark, sf_dir, "lineitem"))
    return n.select("l_orderkey", "l_linenumber", native.integer(F.col("q")).alias("quantity"), native.number(F.col("p")).alias("price"), native.number(F.col("d")).alias("discount"), native.number(F.col("f")).alias("quarter"))


@query("SELECT doc_id, toxic = 1 AS kernel, toxic = 1 AS plain, 'string_to_bool' AS flags FROM labels")
def bool_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.when(F.col("toxic") == 1, F.when(F.col("doc_id") % 2 == 0, " Yes").otherwise("TRUE ")).otherwise(F.when(F.col("doc_id") % 2 == 0, "n").otherwise("no"))
    df = wide(spark, sf_dir, "labels").select("doc_id", word.alias("w"))
    return df.select("doc_id", M.coerce(F.concat(F.lit('"'), "w", F.lit('"')), STRICT_BOOL).alias("r"), native.boolean(F.col("w")).alias("plain")).select("doc_id", F.col("r.value").alias("kernel"), "plain", flat("r.flags").alias("flags"))


@query("SELECT s_suppkey, s_acctbal AS first, CAST(1 AS BIGINT) AS n, 'single_to_array' AS flags FROM supplier")
def single_to_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = M.parse(F.format_string('{"v": %s}', F.col("s_acctbal").cast("string")), list_of(struct(Field("v", FLOAT))))
    return wide(spark, sf_dir, "supplier").select("s_suppkey", r.alias("r")).select("s_suppkey", F.get("r.value", F.lit(0))["v"].alias("first"), F.size("r.value").cast("long").alias("n"), flat("r.flags").alias("flags"))


@query("SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS n, 'implied_key' AS flags FROM customer")
def implied_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = M.parse(F.col("c_nationkey").cast("string"), struct(Field("n", INT)))
    return wide(spark, sf_dir, "customer").select("c_custkey", r.alias("r")).select("c_custkey", F.col("r.value.n").alias("n"), flat("r.flags").alias("flags"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '' AS flags FROM events")
def strict_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(spark, sf_dir, "events").select("event_id", M.parse("props", struct(Field("k", INT))).alias("r")).select("event_id", F.col("r.value.k").alias("k"), flat("r.flags").alias("flags"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def dict_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(spark, sf_dir, "events").select("event_id", M.parse("props", dict_of(INT)).alias("r")).select("event_id", F.col("r.value")["k"].alias("k"))


@query("SELECT l_orderkey, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts, CASE WHEN count(*) > 1 THEN 'grepped_array' ELSE 'grepped_json,single_to_array' END AS flags FROM lineitem GROUP BY l_orderkey")
def grep_multi_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list(F.format_string('line {"n": %s, "part": %s}', F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")))), " and ").alias("t"))
    r = lines.select("l_orderkey", M.parse("t", list_of(struct(Field("n", INT), Field("part", INT)))).alias("r"))
    return r.select("l_orderkey", F.size("r.value").cast("long").alias("n"), F.aggregate("r.value", F.lit(0).cast("long"), lambda a, x: a + x["part"]).alias("parts"), flat("r.flags").alias("flags"))


@query("SELECT o_orderkey, CAST(1 AS BIGINT) AS objects, CAST(1 AS BIGINT) AS blocks FROM orders")
def json_objects_and_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(spark, sf_dir, "orders").select("o_orderkey", F.size(M.json_objects(corrupted("prose"))).cast("long").alias("objects"), F.size(M.markdown_blocks(corrupted("fenced"))).cast("long").alias("blocks"))


@query("SELECT o_orderkey, o_totalprice AS price, CAST(0 AS BIGINT) AS score, true AS same FROM orders")
def best_candidate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best row of the candidate table is the kernel's choice."""
    df = wide(spark, sf_dir, "orders").select("o_orderkey", corrupted("fenced").alias("t"))
    rows = df.select("o_orderkey", F.inline(M.parse_candidates("t", ORDER))).where("error is null")
    best = native.best_candidate(rows, "o_orderkey", "result_json")
    kernel = df.select("o_orderkey", M.parse("t", ORDER).alias("r"))
    price = F.get_json_object("result_json", "$.price").cast("double")
    return best.join(kernel, "o_orderkey").select("o_orderkey", price.alias("price"), best["score"].cast("long").alias("score"), ((price == F.col("r.value.price")) & (best["score"] == F.col("r.score"))).alias("same"))


@query("SELECT o_orderkey, CAST(count(*) AS BIGINT) AS n FROM orders, (VALUES (1), (2), (3), (4)) t GROUP BY o_orderkey")
def candidate_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose with one object is no JSON itself; it reads as the object, its repair, and a string."""
    df = wide(spark, sf_dir, "orders").select("o_orderkey", F.explode(M.parse_candidates(corrupted("prose"), ORDER)).alias("c"))
    return df.groupBy("o_orderkey").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_orderstatus AS status, true AS failed FROM orders")
def options_and_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring domains are opt-in; without them the row has an error."""
    text = F.format_string('{"status": "status %s."}', "o_orderstatus")
    kind = struct(Field("status", enum("F", "O", "P")), Field("n", INT, 0))
    loose = M.parse(F.format_string('{"status": "%s!"}', "o_orderstatus"), kind, coerce=CoerceOptions(allow_substring_enum_match=True))
    df = wide(spark, sf_dir, "orders").select("o_orderkey", loose.alias("r"), M.parse(text, kind, options=ParseOptions(allow_as_string=False)).alias("e"))
    return df.select("o_orderkey", F.col("r.value.status").alias("status"), F.col("e.error").isNotNull().alias("failed"))


@query("SELECT o_orderkey, o_totalprice AS price FROM orders")
def partial_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string('{"id": %s, "price": %s, "sta', *(F.col(c).cast("string") for c in PARTS[:2]))
    return wide(spark, sf_dir, "orders").select("o_orderkey", M.parse(text, ORDER, is_done=False, partial=True).alias("r")).select("o_orderkey", F.col("r.value.price").alias("price"))


@query("SELECT l_orderkey, l_linenumber, l_partkey AS a, l_suppkey AS b FROM lineitem")
def deep_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string('["%s ", " %s,"]', F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    r = M.parse(text, list_of(STRICT_INT), coerce=CoerceOptions(deep_coercion=True))
    return wide(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r.alias("r")).select("l_orderkey", "l_linenumber", F.get("r.value", F.lit(0)).alias("a"), F.get("r.value", F.lit(1)).alias("b"))


# --- patches (E, F)

def doc_text() -> Column:
    return F.format_string('{"status": "%s", "tags": ["a"], "note": "n", "deep": {"x": 1}}', "o_orderstatus")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'Z' ELSE o_orderstatus END AS status, 'a,b' AS tags, 'n+' || o_orderkey AS note, CAST(NULL AS VARCHAR) AS error FROM orders""")
def patch_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = wide(spark, sf_dir, "orders")
    docs = orders.select("o_orderkey", doc_text().alias("doc_json"))
    steps = F.array(
        F.struct(F.lit(2).alias("op_index"), F.lit("replace").alias("op"), F.lit("/note/-").alias("path"), F.concat(F.lit('"+'), F.col("o_orderkey").cast("string"), F.lit('"')).alias("value_json")),
        F.struct(F.lit(0).alias("op_index"), F.lit("replace").alias("op"), F.lit("/status").alias("path"), F.when(F.col("o_orderkey") % 2 == 0, F.lit('"Z"')).otherwise(F.concat(F.lit('"'), "o_orderstatus", F.lit('"'))).alias("value_json")),
        F.struct(F.lit(1).alias("op_index"), F.lit("add").alias("op"), F.lit("/tags/-").alias("path"), F.lit('"b"').alias("value_json")),
    )
    ops = orders.select("o_orderkey", F.inline(steps))
    out = E.apply_patches(docs, ops, id_col="o_orderkey")
    get = lambda p: F.get_json_object("value_json", p)
    return out.select("o_orderkey", get("$.status").alias("status"), F.concat_ws(",", get("$.tags[0]"), get("$.tags[1]")).alias("tags"), get("$.note").alias("note"), "error")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'remove' WHEN 1 THEN 'append' ELSE 'depth' END AS violation FROM orders WHERE o_orderkey % 4 < 3""")
def patch_policy_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    op = F.when(k == 0, "remove").otherwise("add")
    path = F.when(k == 0, "/a").when(k == 1, "/a/-").when(k == 2, F.repeat(F.lit("/x"), 40)).otherwise("/a~1b")
    ops = table(spark, sf_dir, "orders").select("o_orderkey", F.lit(0).alias("op_index"), op.alias("op"), path.alias("path"))
    return native.policy_violations(ops, Policy(allow_append=False), "o_orderkey")


@query("SELECT o_orderkey, CAST(2 AS BIGINT) AS n, '/status' AS path FROM orders")
def patch_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string('Sure:\n```json\n{"patches": [{"op": "replace", "path": "/status", "value": "%s"}, {"op": "add", "path": "/n", "value": 1},]}\n```', "o_orderstatus")
    df = wide(spark, sf_dir, "orders").select("o_orderkey", M.normalize_patches(text).alias("p"))
    return df.select("o_orderkey", F.size("p.ops").cast("long").alias("n"), F.get("p.ops", F.lit(0))["path"].alias("path"))


@query("""SELECT o_orderkey, '{"status": "' || o_orderstatus || '", "deep": {"x": 1}, "none": null}' AS part FROM orders""")
def slice_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = F.array(F.lit("/status"), F.lit("/deep/x"), F.lit("/none"))
    return wide(spark, sf_dir, "orders").select("o_orderkey", M.slice_doc(doc_text(), paths).alias("part"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS attempts, 'Q' AS status, CAST(NULL AS VARCHAR) AS error FROM orders")
def update_retry_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    def answer(asked: str) -> str:
        good = '[{"op": "replace", "path": "/status", "value": "Q"}]'
        even = '"even": true' in asked
        return '[{"op": "remove", "path": "/status"}]' if even and "failed" not in asked else good

    doc = F.format_string('{"status": "%s", "even": %s}', F.col("o_orderstatus"), (F.col("o_orderkey") % 2 == 0).cast("string"))
    out = E.update(wide(spark, sf_dir, "orders").select("o_orderkey", doc.alias("doc_json")), "Set the status to Q.", Calling(answer), struct(Field("status", STR), Field("even", BOOL)), id_col="o_orderkey")
    return out.select("o_orderkey", "attempts", F.get_json_object("value_json", "$.status").alias("status"), "error")


# --- tokens, chunks, leaves, alignment (H)

_TOKENS = r"regexp_extract_all(text, '([\p{L}\p{N}_'']+|[^\p{L}\p{N}_\s]+)')"


@query(f"SELECT doc_id, CAST(len({_TOKENS}) AS BIGINT) AS n FROM documents")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(spark, sf_dir, "documents").select("doc_id", F.size(M.tokens("text")).cast("long").alias("n"))


@query(f"SELECT lang, count(*) AS docs, CAST(sum(len({_TOKENS})) AS BIGINT) AS n, CAST(max(len({_TOKENS})) AS BIGINT) AS most FROM documents GROUP BY lang")
def token_stats_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("lang", F.size(native.token_texts(F.col("text"))).cast("long").alias("n"))
    return df.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n").alias("n"), F.max("n").alias("most"))


@query("SELECT page_id, CAST(length(regexp_replace(html, '\\s', '', 'g')) AS BIGINT) AS chars FROM pages")
def unicode_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grapheme tokens cover all that isn't white space."""
    solid = F.regexp_replace(F.array_join(M.tokens("html", unicode=True)["text"], ""), r"\s", "")
    return wide(spark, sf_dir, "pages").select("page_id", F.length(solid).cast("long").alias("chars"))


@query(r"SELECT doc_id, CAST(length(regexp_replace(text, '[\s]', '', 'g')) AS BIGINT) AS solid FROM documents")
def chunk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks hold every visible character once (chunks are exploded rows)."""
    rows = wide(spark, sf_dir, "documents").select("doc_id", F.inline(M.chunks("text", 400)))
    return rows.groupBy("doc_id").agg(F.sum(F.length(F.regexp_replace("text", r"\s", ""))).alias("solid"))


@query("SELECT item_id, doc_id, CAST(strpos(d.text, b.text) - 1 AS BIGINT) AS start, CAST(strpos(d.text, b.text) - 1 + length(b.text) AS BIGINT) AS \"end\" FROM benchmark b JOIN documents d ON strpos(d.text, b.text) > 0")
def align_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where test passages stand verbatim: candidates share up to eight of the
    passage's inner words (an equi-join), and only those texts are searched;
    passages without inner words are searched in every text."""
    # a passage may begin or end inside a document's word: its inner words decide
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("value"), F.split("text", r"\s+").alias("w")).withColumn("n", F.least(F.lit(8), F.size("w") - 2))
    keyed = items.where("n > 0").select("item_id", "n", F.xxhash64(F.expr("slice(w, 2, n)")).alias("g"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.split("text", r"\s+").alias("w"))
    lengths = F.broadcast(keyed.agg(F.collect_set("n").alias("lengths")))  # one row
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.xxhash64(F.slice("w", i, n)))
    every = F.flatten(F.transform(F.filter("lengths", lambda n: n <= F.size("w")), grams))
    near = docs.crossJoin(lengths).select("doc_id", F.explode(F.array_distinct(every)).alias("g")).join(keyed.select("item_id", "g"), "g").select("doc_id", "item_id")
    short = docs.select("doc_id").crossJoin(F.broadcast(items.where("n <= 0 and length(value) > 0").select("item_id")))
    near = near.unionByName(short).distinct()
    found = near.join(docs.select("doc_id", "text"), "doc_id").join(items.select("item_id", "value"), "item_id")
    return found.select("item_id", "doc_id", native.exact_align(F.col("text"), F.col("value")).alias("s")).where("s is not null").select("item_id", "doc_id", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


@query("SELECT doc_id, CASE WHEN word <> '' THEN 'exact' END AS verbatim, CAST(CASE WHEN word <> '' THEN strpos(text, word) - 1 END AS BIGINT) AS start FROM (SELECT *, split_part(text, ' ', 2) AS word FROM documents)")
def align_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second word of every document in its text (null where there is none)."""
    df = wide(spark, sf_dir, "documents").select("doc_id", M.align("text", F.nullif(F.split_part("text", F.lit(" "), F.lit(2)), F.lit(""))).alias("a"))
    return df.select("doc_id", F.col("a.status").alias("verbatim"), F.col("a.start").cast("long").alias("start"))


#: Stands in no document.
FOREIGN = "zzqxzz"
_LOWERED = f"list_transform({_TOKENS}, lambda x: lower(x))"
_ALIGN_ALL = f"""
WITH t AS (SELECT doc_id, text, {_TOKENS} AS own, {_LOWERED} AS low, nullif(split_part(text, ' ', 2), '') AS word FROM documents),
m AS (SELECT *, len(low) // 2 AS i, len(low) >= 4 AS able FROM t),
v AS (SELECT *, low[i] AS a, low[i + 1] AS b, low[i + 2] AS c, translate(own[i] || ' ' || own[i + 1] || ' ' || own[i + 2], '{LOWER}', '{UPPER}') AS cased FROM m),
w AS (SELECT *,
  list_filter(range(len(low) - 2), lambda k: low[k + 1] = a AND low[k + 2] = b AND low[k + 3] = c)[1] AS run,
  list_filter(range(len(low) - 1), lambda k: low[k + 1] = a AND low[k + 2] = b)[1] AS block,
  list_filter(range(len(low) - 3), lambda k: (low[k + 1] = a AND low[k + 2] = b AND (low[k + 3] = c OR low[k + 4] = c)) OR (low[k + 3] = b AND low[k + 4] = c AND (low[k + 1] = a OR low[k + 2] = a)))[1] AS near
FROM v)
SELECT doc_id,
  CASE WHEN word IS NOT NULL THEN 'exact' END AS verbatim, CAST(CASE WHEN word IS NOT NULL THEN strpos(text, word) - 1 END AS BIGINT) AS verbatim_start,
  CASE WHEN able THEN 'exact' END AS cased, CAST(CASE WHEN able THEN CASE WHEN strpos(text, cased) > 0 THEN len({_TOKENS.replace("text", "substr(text, 1, strpos(text, cased) - 1)")}) ELSE run END END AS BIGINT) AS cased_token,
  CASE WHEN able THEN 'lesser' END AS lesser, CAST(CASE WHEN able THEN block END AS BIGINT) AS lesser_token,
  CASE WHEN able THEN 'fuzzy' END AS fuzzy, CAST(CASE WHEN able THEN near END AS BIGINT) AS fuzzy_token,
  CASE WHEN text IS NOT NULL THEN 'unmatched' END AS foreign_word
FROM w"""


@query(_ALIGN_ALL)
def align_all_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, whatever its words: its second word, and three tokens of
    its middle in capitals, with a foreign word among them and behind them (null
    in documents of fewer than four tokens).  A fuzzy window counts the tokens that
    stand in the same order, as the SQL does, also where tokens repeat."""
    df = wide(spark, sf_dir, "documents").withColumn("own", native.token_texts(F.col("text")))
    df = df.withColumn("t", F.when(F.size("own") >= 4, F.slice("own", F.greatest(F.lit(1), F.floor(F.size("own") / 2).cast("int")), 3)))
    cased = F.translate(F.array_join("t", " "), LOWER, UPPER)
    mixed = F.when(F.col("t").isNotNull(), F.concat_ws(" ", F.col("t")[0], F.col("t")[1], F.lit(FOREIGN), F.col("t")[2]))
    values = {"word": F.nullif(F.split_part("text", F.lit(" "), F.lit(2)), F.lit("")), "cased": cased, "mixed": F.translate(mixed, LOWER, UPPER), "behind": F.concat(cased, F.lit(f" {FOREIGN}")), "foreign": F.lit(FOREIGN)}
    df = df.select("doc_id", "text", *(v.alias(k) for k, v in values.items()))
    df = df.select("doc_id", "text", M.align("text", "word").alias("w"), M.align("text", "cased").alias("c"), M.align("text", "mixed").alias("m"), M.align("text", "behind", lesser=False, in_order=True).alias("b"), M.align("text", "foreign").alias("f"))

    def token(a: str) -> Column:
        return F.when(F.col(a)["start"].isNotNull(), F.size(native.token_texts(F.col("text").substr(F.lit(1), F.col(a)["start"])))).cast("long")

    found = [x for a, name in (("c", "cased"), ("m", "lesser"), ("b", "fuzzy")) for x in (F.col(a)["status"].alias(name), token(a).alias(f"{name}_token"))]
    return df.select("doc_id", F.col("w.status").alias("verbatim"), F.col("w.start").cast("long").alias("verbatim_start"), *found, F.col("f.status").alias("foreign_word"))


@query("SELECT o_orderkey, '/id,/price,/tags/0,/tags/1' AS paths, CAST(o_orderkey AS VARCHAR) AS first FROM orders")
def leaf_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string('{"id": %s, "price": %s, "none": null, "tags": ["a", "b"]}', *(F.col(c).cast("string") for c in PARTS[:2]))
    df = wide(spark, sf_dir, "orders").select("o_orderkey", M.leaves(text).alias("l"))
    return df.select("o_orderkey", F.array_join(F.transform("l", lambda x: x["path"]), ",").alias("paths"), F.get("l", F.lit(0))["text"].alias("first"))


@query("SELECT DISTINCT o_orderpriority AS raw, regexp_replace(lower(o_orderpriority), '[^a-z0-9]', '', 'g') AS k FROM orders")
def normalized_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderpriority").distinct().select(F.col("o_orderpriority").alias("raw"), M.normalize_key("o_orderpriority").alias("k"))


# --- merging (H17, H18) and the whole extraction



def _folded(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    value = F.to_json(F.struct(F.col("role"), F.array("role").alias("roles"), F.when(F.col("turn") == 0, F.lit("")).otherwise(F.col("role")).alias("later")))
    out = E.merged(table(spark, sf_dir, "conversations").select("conv_id", "turn", value.alias("value")), "conv_id", ["turn"], "value", strategy)
    get = lambda p: F.get_json_object("value", p)
    return out.select("conv_id", get("$.role").alias("role"), F.size(F.from_json(get("$.roles"), "array<string>")).cast("long").alias("roles"), get("$.later").alias("later"))


_ROLES = "CAST(count(DISTINCT role) AS BIGINT) AS roles"


@query(f"SELECT conv_id, arg_min(role, turn) AS role, {_ROLES}, '' AS later FROM conversations GROUP BY conv_id")
def merge_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folded(spark, sf_dir, "first_wins")


@query(f"SELECT conv_id, arg_max(role, turn) AS role, {_ROLES}, CASE WHEN max(turn) = 0 THEN '' ELSE arg_max(role, turn) END AS later FROM conversations GROUP BY conv_id")
def merge_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folded(spark, sf_dir, "last_wins")


@query(f"SELECT conv_id, arg_min(role, turn) AS role, {_ROLES}, coalesce(arg_min(role, turn) FILTER (turn > 0), '') AS later FROM conversations GROUP BY conv_id")
def merge_prefer_non_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folded(spark, sf_dir, "prefer_non_null")


_SPANS = "(SELECT o_custkey AS k, o_orderkey AS i, CAST(o_orderkey % 97 AS INTEGER) AS s, CAST(o_orderkey % 97 + 5 AS INTEGER) AS e FROM orders)"


@query(f"SELECT i FROM {_SPANS} a WHERE i % 2 = 1 AND NOT EXISTS (SELECT 1 FROM {_SPANS} b WHERE b.i % 2 = 0 AND a.k = b.k AND a.s < b.e AND b.s < a.e)")
def evidence_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("o_orderkey") % 97
    spans = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("i"), at.alias("start"), (at + 5).alias("end"))
    return native.clear_of(spans.where("i % 2 = 1"), spans.where("i % 2 = 0"), "k").select("i")


@query("SELECT o_custkey AS k, CAST(count(*) AS BIGINT) AS kept FROM orders GROUP BY 1")
def evidence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pass whole; a second pass of the same spans adds nothing."""
    at = (F.col("o_orderkey") % 97).cast("int")
    span = F.struct(at.alias("start"), (at + 5).cast("int").alias("end"))
    one = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_list(span).alias("p"))
    return one.select("k", F.size(M.merge_evidence(F.array("p", "p"))).cast("long").alias("kept"))


@query("SELECT o_orderkey, o_orderkey AS id, o_orderstatus AS status, 'exact,exact' AS grounded, CAST(9 AS BIGINT) AS start FROM orders")
def extract_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks, a provider, parsing, grounding and merging in one plan."""

    def answer(asked: str) -> str:
        line = asked.rsplit("\nQ: ", 1)[1]
        words = line.split()
        return f'{{Id: {words[2]}, status: "{words[5].lower()}"}}' if "status" in words else "{}"

    docs = wide(spark, sf_dir, "orders").select("o_orderkey", F.format_string("Order no %s has status %s now.", F.col("o_orderkey").cast("string"), "o_orderstatus").alias("text"))
    out = E.extract(docs, Calling(answer), struct(Field("id", INT), Field("status", enum("F", "O", "P"))), E.ExtractOptions(max_char_buffer=200, passes=2), "o_orderkey")
    get = lambda p: F.get_json_object("value_json", p)
    return out.select("o_orderkey", get("$.id").cast("long").alias("id"), get("$.status").alias("status"), F.array_join(F.transform("evidence", lambda e: e["status"]), ",").alias("grounded"), F.get("evidence", F.lit(0))["start"].cast("long").alias("start"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '' AS flags FROM events")
def stream_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buffers as a stream leaves them: three fragments put together in order,
    then read as final (the streaming operator's own kernel, in a batch)."""
    from mendframe.streaming.parser import read

    third = F.floor(F.length("props") / 3).cast("int")
    e = table(spark, sf_dir, "events").select("event_id", F.inline(F.array(F.struct(F.lit(2).alias("seq"), F.expr("substring(props, 2 * cast(floor(length(props) / 3) as int) + 1)").alias("c")), F.struct(F.lit(0).alias("seq"), F.substring("props", F.lit(1), third).alias("c")), F.struct(F.lit(1).alias("seq"), F.substring("props", third + 1, third).alias("c")))))
    whole = e.groupBy("event_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "c"))), lambda x: x["c"]), "").alias("buffer"))
    kind = struct(Field("k", INT))
    got = batched(lambda x: dict(zip(("value_json", "flags"), read(x, kind, True)[:2], strict=True)), "struct<value_json:string,flags:string>", "buffer")
    return whole.select("event_id", got.alias("r")).select("event_id", F.get_json_object("r.value_json", "$.k").cast("long").alias("k"), F.col("r.flags").alias("flags"))


@query("SELECT region, count(*) AS n, CAST(sum(price) AS DOUBLE) AS total FROM (SELECT o_orderstatus AS region, round(o_totalprice, 0) AS price FROM orders) GROUP BY region")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixed model output repaired and aggregated."""
    text = F.when(F.col("o_orderkey") % 2 == 0, corrupted("fenced")).otherwise(corrupted("unquoted"))
    r = wide(spark, sf_dir, "orders").select(M.parse(text, ORDER).alias("r")).select("r.value.*")
    return r.groupBy(F.col("status").alias("region")).agg(F.count("*").alias("n"), F.sum(F.round("price", 0)).alias("total"))


