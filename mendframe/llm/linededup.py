"""Corpus-wide removal of repeated lines, with built-in expressions only.

Lines are exploded as 96 bits of hash (their texts never leave the row),
aggregated to the documents that hold each key, and the positions to drop come
back to each document, whose lines are put together again in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendframe.llm.common import ascii_lower, cut, known_id

SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """A line as it is compared: ASCII white space off both ends, A-Z lower-cased."""
    return F.btrim(ascii_lower(line), F.lit(SPACE))


def _numbered(text: Column, min_chars: int) -> Column:
    """Array of (pos, h, g) of the lines long enough to count."""
    keys = F.transform(F.split(ascii_lower(text), "\n", -1), lambda x, i: F.struct(i.alias("pos"), F.btrim(x, F.lit(SPACE)).alias("key")))
    return F.transform(F.filter(keys, lambda x: F.length(x["key"]) >= min_chars), lambda x: F.struct(x["pos"].alias("pos"), F.xxhash64(x["key"]).alias("h"), F.hash(x["key"]).alias("g")))


def _marked(docs: DataFrame, id_col: str, text_col: str, min_docs: int, min_chars: int) -> DataFrame:
    """``docs`` with ``__mf_total``, ``__mf_dropped`` and ``__mf_kept``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.withColumns({"__mf_id": known_id(id_col), "__mf_row": F.xxhash64(text)})
    lines = rows.select("__mf_id", "__mf_row", F.explode(_numbered(text, min_chars)).alias("line")).select("__mf_id", "__mf_row", "line.*")
    if min_docs <= 2:  # two different ids: the least is not the greatest
        held = lines.groupBy("h", "g").agg(F.min("__mf_id").alias("keeper"), F.max("__mf_id").alias("last"))
        held = held.where(F.lit(min_docs <= 1) | (F.col("keeper") < F.col("last")))
    else:
        held = lines.select("h", "g", "__mf_id").distinct().groupBy("h", "g").agg(F.min("__mf_id").alias("keeper"), F.count("*").alias("n")).where(F.col("n") >= min_docs)
    # a table, so that both sides of the join are plain exchanges and a line that
    # very many documents hold can be split over tasks
    gone = lines.join(cut(held.select("h", "g", "keeper"), "lines"), ["h", "g"]).where("__mf_id <> keeper")
    gone = gone.groupBy("__mf_id", "__mf_row").agg(F.collect_set("pos").alias("__mf_gone"))
    found = rows.join(gone, ["__mf_id", "__mf_row"], "left").withColumn("__mf_lines", F.split(text, "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size("__mf_lines") - 1), F.col("__mf_gone"))
    kept = F.when(F.col("__mf_gone").isNull(), text).otherwise(F.array_join(F.transform(left, lambda i: F.get("__mf_lines", i)), "\n"))
    total, dropped = F.size("__mf_lines"), F.size(F.coalesce("__mf_gone", F.array().cast("array<int>")))
    found = found.withColumns({"__mf_total": total.cast("long"), "__mf_dropped": dropped.cast("long"), "__mf_kept": kept})
    return found.drop("__mf_id", "__mf_row", "__mf_gone", "__mf_lines")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, min_chars: int = 10) -> DataFrame:
    """``docs`` with three columns more: ``n_lines`` (before dropping),
    ``n_dropped`` and ``kept_text``.

    A line whose key has at least ``min_chars`` code points and occurs in at
    least ``min_docs`` different ids goes, in every id but the least.  A null or
    empty text is one empty line.  Null ids count as one id that precedes all
    others.  Repeated rows are kept and treated alike; an empty table gives an
    empty one; texts and lines of any length are read whole.  Columns that already have one of these three names are replaced.
    """
    found = _marked(docs.drop("n_lines", "n_dropped", "kept_text"), id_col, text_col, min_docs, min_chars)
    return found.withColumnsRenamed({"__mf_total": "n_lines", "__mf_dropped": "n_dropped", "__mf_kept": "kept_text"})


def rewrite_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars", min_docs: int = 2, min_chars: int = 10) -> DataFrame:
    """``docs`` with the same columns, texts without their repeated lines (as
    :func:`drop_repeated_lines` finds them) and ``count_col``, if it is there,
    the code points of texts that changed.  Null texts stay null."""
    found = _marked(docs, id_col, text_col, min_docs, min_chars)
    changed = F.col("__mf_dropped") > 0
    new = {text_col: F.when(changed, F.col("__mf_kept")).otherwise(F.col(text_col))}
    if count_col in docs.columns:
        new[count_col] = F.when(changed, F.length("__mf_kept").cast(docs.schema[count_col].dataType)).otherwise(F.col(count_col))
    return found.withColumns(new).select(*docs.columns)
