"""Benchmark decontamination by word n-grams, with built-in expressions only.

The test items' n-grams form a hash table that is broadcast when its measured
size, the lists of items included, is under a bound.  Documents are scanned
once: each becomes a row for itself and one for each window's hash, the join
keeps the first and the verified hits, and only those are aggregated.  Beyond
the bound only hashes and places are shuffled to meet the table, and what they
meet goes back to the document to be compared there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendframe.llm.common import ascii_lower, known_id

#: What stands between words (of lower-cased text).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = "struct<start:int,len:int,s:bigint>"
#: Bytes of n-gram text up to which the hash table is broadcast.
BROADCAST_BYTES = 32 << 20


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words: runs of digits, letters and non-ASCII characters."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), GAP, -1), "")


def item_grams(items: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = 13) -> DataFrame:
    """(gram_hash, gram_len, gram, items), ``gram_hash`` as :func:`sketch` has it:
    each different window of the test
    items and the sorted ids (as strings) of the items that hold it.  An item
    of fewer words, but not none, is one window.  A null id is written ''."""
    split = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    windows = F.when(F.size("w") <= n, F.array(F.col("w"))).otherwise(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice("w", i, n)))
    grams = split.select("item", F.explode(windows).alias("g"))
    hashed = F.transform("g", lambda x: F.xxhash64(x))
    grams = grams.select("item", "g", hashed.alias("h"), F.size("g").alias("gram_len"))
    grams = grams.select("item", F.xxhash64(F.get("h", F.lit(0)), F.get("h", F.floor(F.col("gram_len") / 2).cast("int")), F.get("h", F.col("gram_len") - 1), F.col("gram_len")).alias("gram_hash"), "gram_len", F.array_join("g", " ").alias("gram"))
    return grams.groupBy("gram_hash", "gram_len", "gram").agg(F.array_sort(F.collect_set("item")).alias("items"))


def sketch(k: int, i: Column) -> Column:
    """A hash of the window of ``k`` words at ``i``: of its first, middle and last
    word's hashes (array ``h``) and ``k``.  It finds candidates, which are then
    compared word by word."""
    return F.xxhash64(F.get("h", i), F.get("h", i + k // 2), F.get("h", i + (k - 1)), F.lit(k))


def _windows(k: int) -> Column:
    """(start, len, s) of each window of ``k`` words of the array with hashes ``h``."""
    every = F.transform(F.sequence(F.lit(0), F.size("h") - k), lambda i: F.struct(i.alias("start"), F.lit(k).alias("len"), sketch(k, i).alias("s")))
    return F.when(F.size("h") >= k, every).otherwise(F.array().cast(f"array<{WINDOW}>"))


def _met_by_broadcast(hashed: DataFrame, windows: list[Column], grams: DataFrame) -> DataFrame:
    """(id, row, n_words, times, hits, items) of each different row of ``hashed``."""
    scan = hashed.select("id", "row", "w", F.explode(F.concat(*windows)).alias("x"))
    held = F.array_join(F.slice("w", F.col("x.start") + 1, F.col("x.len")), " ")
    # equality, put so that it isn't a join key: keys are computed for every window
    meet = (F.col("x.s") == F.col("gram_hash")) & F.startswith(held, F.col("gram")) & F.startswith(F.col("gram"), held)
    found = scan.join(F.broadcast(grams), meet, "left").where(F.col("x").isNull() | F.col("gram").isNotNull())
    hit = F.when(F.col("x").isNotNull(), F.struct(F.col("x.start").alias("start"), F.col("x.len").alias("len")))
    each = found.select("id", "row", F.when(F.col("x").isNull(), F.size("w")).alias("n"), hit.alias("hit"), "items")
    # sets of lists: windows of one passage have one list
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_set("items"))))
    return each.groupBy("id", "row").agg(F.max("n").cast("long").alias("n_words"), F.count("n").cast("int").alias("times"), F.array_sort(F.collect_set("hit")).alias("hits"), items.alias("items"))


def _met_by_shuffle(hashed: DataFrame, windows: list[Column], grams: DataFrame) -> DataFrame:
    """The same, with no words in the exchange of windows."""
    every = F.filter(F.concat(*windows), lambda x: x.isNotNull())
    met = hashed.select("id", "row", F.inline(every)).distinct().join(grams.select("gram_hash", "gram", "items"), F.col("s") == F.col("gram_hash"))
    met = met.groupBy("id", "row").agg(F.collect_set(F.struct("start", "len", "gram", "items")).alias("met"))
    rows = hashed.groupBy("id", "row").agg(F.first("w").alias("w"), F.count("*").cast("int").alias("times")).join(met, ["id", "row"], "left")
    real = F.filter(F.coalesce("met", F.array()), lambda m: F.array_join(F.slice("w", m["start"] + 1, m["len"]), " ") == m["gram"])
    rows = rows.withColumn("real", real)
    hits = F.array_sort(F.array_distinct(F.transform("real", lambda m: F.struct(m["start"].alias("start"), m["len"].alias("len")))))
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("real", lambda m: m["items"]))))
    return rows.select("id", "row", F.size("w").cast("long").alias("n_words"), "times", hits.alias("hits"), items.alias("items"))


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", n: int = 13) -> DataFrame:
    """One row a row of ``docs``: (id, row, n_words, hits, n_hit, items).

    ``row`` is the hash of the text, ``hits`` the sorted (start, len) of windows
    that a test item holds, ``n_hit`` the words inside any of them, ``items``
    the sorted ids (strings) of the items concerned.  Null or wordless texts
    have no words.  ``id`` is null-safe (see ``known_id``).  Repeated rows give
    repeated rows; empty tables on either side give the plain result; other columns
    are not looked at; texts of any length are read whole.
    """
    grams = item_grams(items, item_id_col, item_text_col, n)
    listed = F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x) + 16)
    size = grams.groupBy("gram_len").agg(F.sum(F.octet_length("gram") + listed + 64).alias("bytes")).collect()  # n rows at most
    small = sum(r["bytes"] for r in size) <= BROADCAST_BYTES
    text = F.col(text_col).cast("string")
    base = docs.select(known_id(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("row"), words(text).alias("w"))
    windows = [F.array(F.lit(None).cast(WINDOW)), *(_windows(r["gram_len"]) for r in sorted(size))]
    hashed = base.select("id", "row", "w", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    per_doc = (_met_by_broadcast if small else _met_by_shuffle)(hashed, windows, grams)
    start = F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n"))

    def cover(a, x):
        to = x["start"] + x["len"]
        return F.struct(F.greatest(a["to"], to).alias("to"), (a["n"] + F.greatest(F.lit(0), to - F.greatest(a["to"], x["start"]))).alias("n"))

    return per_doc.select("id", "row", "n_words", "hits", F.aggregate("hits", start, cover, lambda a: a["n"]).alias("n_hit"), "items", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_")).drop("_")


def is_contaminated(per_mille: int = 50) -> Column:
    """At least ``per_mille`` thousandths of the words (and one) lie in hits."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 1000 >= F.col("n_words") * per_mille)


def remove_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 13, per_mille: int = 50) -> DataFrame:
    """``docs`` without the rows that :func:`is_contaminated` marks.  Null and
    wordless texts stay; null ids are ids like any other; of repeated rows all or
    none go; an empty table gives an empty one; the columns are those of ``docs``."""
    bad = overlaps(docs, items, id_col, text_col, n=n).where(is_contaminated(per_mille)).select(F.col("id").alias("__mf_id"), F.col("row").alias("__mf_row")).distinct()
    keyed = docs.withColumns({"__mf_id": known_id(id_col), "__mf_row": F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))})
    return keyed.join(bad, ["__mf_id", "__mf_row"], "left_anti").drop("__mf_id", "__mf_row")


def remove_spans(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 13) -> DataFrame:
    """``docs`` with hit words blanked out: runs of hit words (and what stands
    between them) become one space; the rest of the text is left as it is.  Null
    texts stay null; repeated rows are all changed; an empty table gives an empty
    one; the columns are those of ``docs``; texts of any length are read whole."""
    keyed = docs.withColumns({"__mf_id": known_id(id_col), "__mf_row": F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))})
    hits = overlaps(docs, items, id_col, text_col, n=n).where("n_hit > 0").select(F.col("id").alias("__mf_id"), F.col("row").alias("__mf_row"), F.col("hits").alias("__mf_hits")).dropDuplicates(["__mf_id", "__mf_row"])
    joined = keyed.join(hits, ["__mf_id", "__mf_row"], "left")
    # pieces[i] stands before word i; words and pieces alternate, in their own case
    edge = r"(?<=[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])(?=[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])|(?<=[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])(?=[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])"
    inside = r"^[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    both = F.split(F.col(text_col).cast("string"), edge, -1)
    hit_at = F.array_distinct(F.flatten(F.transform("__mf_hits", lambda h: F.sequence(h["start"], h["start"] + h["len"] - 1))))
    joined = joined.withColumns({"__mf_both": F.when(F.col("__mf_hits").isNotNull(), both), "__mf_at": hit_at})
    joined = joined.withColumn("__mf_w", F.filter("__mf_both", lambda x: x.rlike(inside)))
    gaps = F.filter("__mf_both", lambda x: (x != "") & ~x.rlike(inside))
    gaps = F.when(F.get("__mf_both", F.lit(0)).rlike(inside), F.concat(F.array(F.lit("")), gaps)).otherwise(gaps)
    joined = joined.withColumn("__mf_p", F.concat(gaps, F.array(F.lit(""))))
    joined = joined.withColumn("__mf_left", F.array_except(F.sequence(F.lit(0), F.size("__mf_w") - 1), F.col("__mf_at")))
    joined = joined.withColumn("__mf_left", F.concat(F.array(F.lit(-1)), F.col("__mf_left")))
    last = F.size("__mf_w") - 1

    def piece(p, i):
        after = F.when(F.get("__mf_left", i + 1).isNotNull(), F.get("__mf_left", i + 1)).otherwise(last + 1)
        gap = F.when(after == p + 1, F.get("__mf_p", p + 1)).otherwise(F.concat(F.when(p >= 0, F.lit(" ")).otherwise(F.lit("")), F.when(after > last, F.get("__mf_p", last + 1)).otherwise(F.lit(""))))
        return F.concat(F.when(p >= 0, F.get("__mf_w", p)).otherwise(F.lit("")), gap)

    clean = F.array_join(F.transform("__mf_left", piece), "")
    return joined.withColumn(text_col, F.when(F.col("__mf_hits").isNotNull(), clean).otherwise(F.col(text_col))).drop("__mf_id", "__mf_row", "__mf_hits", "__mf_both", "__mf_w", "__mf_p", "__mf_at", "__mf_left")
