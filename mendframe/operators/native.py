"""Operators that Catalyst can express: no Python runs on the executors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendframe.kernel.coerce import UNKNOWN_WEIGHT, WEIGHTS
from mendframe.kernel.patch import Policy

#: Fixed value: a number in prose; only a dollar sign may stand between its sign and its digits.
NUMBER = r"[-+]?\$?(?:[0-9]+(?:,[0-9]+)*(?:\.[0-9]+)?|\.[0-9]+)(?:e[-+]?[0-9]+)?"
FRACTION = r"^\s*([-+]?[0-9]+(?:\.[0-9]+)?)\s*/\s*([-+]?[0-9]+(?:\.[0-9]+)?)\s*$"
TOKEN = r"[\p{L}\p{N}_']+|[^\p{L}\p{N}_\s]+"


def _plain(text: Column) -> Column:
    return F.rtrim(F.trim(text), F.lit(","))


def number(text: Column) -> Column:
    """A double from plain, fraction, grouped, dollar or percent notation; each
    notation is looked at only where those before it don't apply."""
    plain = _plain(text)
    amounts = F.regexp_extract_all(plain, F.lit(NUMBER), 0)
    part = [F.regexp_extract(plain, FRACTION, k) for k in (1, 2)]
    fraction = F.try_divide(part[0].try_cast("double"), part[1].try_cast("double"))
    amount = F.get(F.transform(F.array(amounts), lambda a: F.when(F.size(a) == 1, F.regexp_replace(F.get(a, F.lit(0)), "[,$]", "").try_cast("double"))), F.lit(0))
    return F.coalesce(plain.try_cast("double"), F.when(plain.rlike(FRACTION), fraction).otherwise(amount))


def integer(text: Column) -> Column:
    """A long from a plain number, if it is whole to within 1e-9."""
    x = _plain(text).try_cast("double")
    return F.when(F.abs(x - F.round(x)) < 1e-9, F.round(x).try_cast("long"))


def boolean(text: Column) -> Column:
    word = F.lower(F.trim(text))
    return F.when(word.isin("true", "yes", "y", "1"), True).when(word.isin("false", "no", "n", "0"), False)


def enum(text: Column, domain: Sequence[str]) -> Column:
    """struct(value, flags): exact, any case, then without punctuation."""

    def bare(x):
        return F.lower(F.regexp_replace(x, r"[^\p{L}\p{N}_\s]", ""))

    members = F.array_sort(F.array(*map(F.lit, domain)))
    levels = [(F.filter(members, lambda d: d == text), ""), (F.filter(members, lambda d: F.lower(d) == F.lower(text)), "case_insensitive"), (F.filter(members, lambda d: bare(d) == bare(text)), "strip_punct")]
    out = None
    for hits, flag in levels:
        flags = F.filter(F.array(F.lit(flag), F.when(F.size(hits) > 1, "ambiguous_enum")), lambda f: f.isNotNull() & (f != ""))
        found = F.struct(F.get(hits, F.lit(0)).alias("value"), flags.alias("flags"))
        out = F.when(F.size(hits) > 0, found) if out is None else out.when(F.size(hits) > 0, found)
    return out


def pointer(path: Column) -> Column:
    """The unescaped parts of a JSON Pointer."""
    parts = F.transform(F.split(F.substring(path, 2, 1 << 30), "/"), lambda x: F.replace(F.replace(x, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))
    return F.when(path == "", F.array().cast("array<string>")).otherwise(parts)


def parent_paths(path: Column) -> Column:
    """A pointer and those of all that it lies in, the innermost first."""
    raw = F.split(path, "/")
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.size(raw) - 1, F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(raw, 1, n + 1), "/")))


def score(flags: Column) -> Column:
    weights = F.create_map(*(F.lit(x) for pair in WEIGHTS.items() for x in pair))
    return F.aggregate(flags, F.lit(0), lambda a, f: a + F.coalesce(weights[f], F.lit(UNKNOWN_WEIGHT)))


def best_candidate(df: DataFrame, key: str, value: str, flags: str = "flags", idx: str = "idx") -> DataFrame:
    """The least scored candidate of each key (then fewest flags, then first)."""
    order = F.struct(score(F.col(flags)).alias("score"), F.size(flags).alias("n"), F.col(idx).alias("idx"))
    return df.groupBy(key).agg(F.min_by(F.col(value), order).alias(value), F.min(order)["score"].alias("score"))


def exact_align(text: Column, value: Column) -> Column:
    """struct(start, end) of the first verbatim occurrence, or null."""
    at = F.instr(text, value)
    return F.when((at > 0) & (F.length(value) > 0), F.struct((at - 1).alias("start"), (at - 1 + F.length(value)).alias("end")))


def token_texts(text: Column) -> Column:
    # marked and split: one linear pass, however many tokens
    return F.filter(F.split(F.regexp_replace(text, TOKEN, "￿$0￿"), "[\\s￿]+", -1), lambda x: x != "")


def policy_violations(ops: DataFrame, policy: Policy = Policy(), key: str = "doc_id") -> DataFrame:
    """(key, violation): the first rule that each document's operations break."""
    o = ops.select(key, "op_index", "op", "path")
    broken = F.when((F.col("op") == "remove") & F.lit(not policy.allow_remove), F.lit("remove")).when(F.col("path").endswith("/-") & F.lit(not policy.allow_append), F.lit("append")).when(F.size(pointer(F.col("path"))) > policy.max_path_depth, F.lit("depth"))
    each = o.withColumn("broken", broken).groupBy(key).agg(F.count("*").alias("n"), F.min(F.when(F.col("broken").isNotNull(), F.struct("op_index", "broken")))["broken"].alias("first"))
    return each.select(key, F.when(F.col("n") > policy.max_ops, F.lit("max_ops")).otherwise(F.col("first")).alias("violation")).where("violation is not null")


def clear_of(secondary: DataFrame, primary: DataFrame, key: str) -> DataFrame:
    """Spans of ``secondary`` that overlap no span of ``primary`` under the key."""
    a, b = secondary.alias("a"), primary.alias("b")
    hit = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end"))
    return a.join(b, hit, "left_anti")
