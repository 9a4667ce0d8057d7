"""Near copies of a stated similarity, with SimHash keys and more than those.

Two texts are linked if their sets of ``shingle``-word shingles have a Jaccard
similarity of at least ``similarity``.  At 0.8 their 64-bit SimHash fingerprints
differ in some ten bits, far beyond the four that Golay keys can hold, so the
fingerprints' links are joined by candidates from bands of least shingle hashes,
and every candidate is verified on the whole sets.

1. Texts of the same words are one: the least id stands for them.
2. Texts that share a band are a bucket.  Each member is held against the bucket's
   least id only, texts of one fingerprint against the least of them, and those least
   ones against each other along the fingerprints' links (operator 1's, which connect
   all that is linked at a row each); what passes is one component.
3. A bucket of several parts gets a hub, a text that meets most others.  Its members
   are held against the hub, and parts are joined again.
4. Pairs of members that lie in different parts by then are candidates if what sets
   each apart from the hub is alike enough (:func:`_by_difference`): copies of one
   text with edits of their own share what they have of the hub, but not their edits,
   so that they meet no one, and a pair that is similar enough is never passed over.
   Pairs inside a part need not be held: however many near copies a text has, they
   cost a row each, not a row a pair, and no link between candidates that would join
   two components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mendframe.llm.common import by_batch, cut, forget, given_id, known_id
from mendframe.llm.components import components
from mendframe.llm.simhash import majority, shingle_hashes, wide_links

#: A pair of similarity s shares a band with probability 1 - (1 - s**ROWS)**BANDS: 0.996 at 0.8, 0.9999 at 0.85.
BANDS, ROWS = 24, 7
#: Odd multipliers, one for each least hash, derived by rule.
SPREAD = np.array([xxhash.xxh32_intdigest(str(k)) | 1 for k in range(BANDS * ROWS)], dtype=np.uint32)
#: Shingles at a time: the products of one step stay in the processor's cache.
STEP = 512


def band_keys(hashes: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band of the least multiplied hashes."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(SPREAD), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(short), STEP):
        np.minimum(least, (SPREAD[:, None] * short[None, at : at + STEP]).min(axis=1), out=least)
    raw = least.tobytes()
    size = 4 * ROWS
    return [xxhash.xxh3_64_intdigest(raw[k * size : (k + 1) * size], k) - (1 << 63) for k in range(BANDS)]


def node_of(text: str) -> int:
    """The number of a text: a signed 64-bit digest of its words."""
    return xxhash.xxh3_64_intdigest(b" ".join(text.encode().lower().split())) - (1 << 63)


def _sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, row, node, fp, bands) of each (id, row, text)."""

    def make():
        def turn(batch: pa.RecordBatch) -> pa.RecordBatch:
            nodes, fps, bands = [], [], []
            for text in batch.column(2):
                text = text.as_py()
                nodes.append(node_of(text))
                hashes = shingle_hashes(text, shingle)
                fps.append(majority(hashes))
                bands.append(band_keys(hashes))
            fps = np.array(fps, dtype=np.uint64).view(np.int64)
            return pa.record_batch([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(fps), pa.array(bands, pa.list_(pa.int64()))], names=["id", "row", "node", "fp", "bands"])

        return turn

    return docs.mapInArrow(by_batch(make), "id long, row long, node long, fp long, bands array<long>")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles): the distinct shingle hashes of each (node, text)."""

    def make():
        def turn(batch: pa.RecordBatch) -> pa.RecordBatch:
            every = [np.unique(shingle_hashes(text.as_py(), shingle)).view(np.int64) for text in batch.column(1)]
            return pa.record_batch([batch.column(0), pa.array(every, pa.list_(pa.int64()))], names=["node", "shingles"])

        return turn

    return texts.mapInArrow(by_batch(make), "node long, shingles array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The (u, v) of ``pairs`` whose sets are similar enough."""
    a, b = (sets.select(F.col("node").alias(k), F.col("shingles").alias(f"{k}_set")) for k in "uv")
    both = F.size(F.array_intersect("u_set", "v_set"))
    held = pairs.join(a, "u").join(b, "v").select("u", "v", both.alias("n"), (F.size("u_set") + F.size("v_set") - both).alias("all"))
    return held.where(F.col("n") >= F.col("all") * F.lit(similarity) - F.lit(1e-9)).select("u", "v")


def _mixed(placed: DataFrame, by: str) -> DataFrame:
    """The rows of ``placed`` whose ``by`` has several parts, with its ``members``."""
    sizes = placed.groupBy(by).agg(F.count("*").alias("members"), F.min("part").alias("first"), F.max("part").alias("last"))
    return placed.join(sizes.where("first < last").select(by, "members"), by)


def _hubbed(placed: DataFrame, hops: int = 1) -> DataFrame:
    """(key, hub, node) of each bucket of several parts.  The hub is, of its members
    and of those of the buckets that ``hops`` members in a row lead to, the one that
    meets most others: buckets of one group so have few hubs, and a member few rows."""
    rows = cut(_mixed(placed, "key").select("key", "node", "members"), "mixed")
    hubs = rows.groupBy("node").agg(F.struct(F.sum("members").alias("weight"), F.col("node").alias("hub")).alias("hub"))
    for _ in range(hops):
        best = rows.join(hubs, "node").groupBy("key").agg(F.max("hub").alias("hub"))
        hubs = cut(rows.join(best, "key").groupBy("node").agg(F.max("hub").alias("hub")), "hubs")
    best = rows.join(hubs, "node").groupBy("key").agg(F.max("hub").alias("hub"))
    return rows.join(best, "key").select("key", "hub.hub", "node")


def _by_difference(led: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): among the (hub, node, part) of ``led``, pairs of one hub and of
    different parts; all that are similar enough are there.  A part holds all of a
    hub's nodes that are similar enough to it.

    Let D(u) be the shingles that one of u and the hub has and the other has not.
    u and v are similar enough if they differ in at most c (|u| + |v|) shingles, c =
    (1 - s) / (1 + s), that is if |D(u) & D(v)| is t = (x(u) + x(v)) / 2 at least, for
    x(u) = |D(u)| - c |u|.  Then the |D(u)| - t + 1 rarest of D(u) and as many of D(v)
    as that gives for v have a shingle in common.  Let x(u) <= x(v).  Of two parts one
    is not the hub's, so x(v) > c |hub| and t is positive; t >= x(u) too.  u and v have
    at most c (|u| + |v|) between D(u) and D(v), and |u| <= |v| / s, so t >= x(v) - c |v| / s.
    """
    c = (1 - similarity) / (1 + similarity)
    hubs = sets.select(F.col("node").alias("hub"), F.col("shingles").alias("hub_set"))
    apart = F.concat(F.array_except("hub_set", "shingles"), F.array_except("shingles", "hub_set"))
    held = led.join(hubs, "hub").join(sets, "node").select("hub", "node", "part", F.size("shingles").alias("n"), (F.lit(c) * F.size("hub_set")).alias("far"), apart.alias("apart"))
    held = held.withColumn("x", F.size("apart") - F.lit(c) * F.col("n"))

    def rarest(least):
        return F.size("apart") + 1 - F.greatest(F.lit(1), F.ceil(least - F.lit(1e-9)))

    low = rarest((F.col("x") + F.greatest("x", "far")) / 2)
    high = F.when(F.col("x") > F.col("far") - F.lit(1e-9), rarest(F.col("x") - F.lit(c / similarity) * F.col("n"))).otherwise(0)
    shown = cut(held.select("hub", "node", "part", "n", "x", low.alias("low"), high.alias("high"), F.explode("apart").alias("shingle")), "apart")
    counts = shown.groupBy("hub", "shingle").agg(F.count("*").alias("times")).where("times > 1")
    order = Window.partitionBy("hub", "node").orderBy(F.coalesce("times", F.lit(1)), "shingle")
    ranked = shown.join(counts, ["hub", "shingle"], "left").withColumn("rank", F.row_number().over(order)).where("times > 1 and rank <= greatest(low, high)")
    ranked = cut(ranked, "ranked")
    one, two = (ranked.where(f"rank <= {most}").select("hub", "shingle", *(F.col(c).alias(f"{c}_{k}") for c in ("node", "part", "n", "x"))) for most, k in (("low", "u"), ("high", "v")))
    sized = (F.col("n_u") >= F.col("n_v") * F.lit(similarity) - F.lit(1e-9)) & (F.col("n_v") >= F.col("n_u") * F.lit(similarity) - F.lit(1e-9))
    met = one.join(two, ["hub", "shingle"]).where((F.col("part_u") != F.col("part_v")) & (F.col("x_u") <= F.col("x_v")) & sized)
    return met.select(F.least("node_u", "node_v").alias("u"), F.greatest("node_u", "node_v").alias("v")).distinct()


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(known_id(id_col).alias("id"), F.xxhash64(text).alias("row"), text.alias("text"))


def _classes(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """(id, row, root): the class of each row; ``row`` is the hash of its text."""
    base = _rows(docs, id_col, text_col)
    sketches = cut(_sketches(base, shingle), "sketches")
    texts = cut(sketches.groupBy("node").agg(F.min(F.struct("id", "row")).alias("one"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "texts")

    keyed = texts.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("last")).where("least < last").select("key", "least")
    buckets = cut(keyed.join(cut(shared, "keys"), "key"), "buckets")

    heads = cut(texts.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    alike = texts.join(heads, "fp").where("node <> head").select(F.col("head").alias("u"), F.col("node").alias("v"))
    of = [heads.select(F.col("fp").alias(f), F.col("head").alias(k)) for f, k in (("u", "a"), ("v", "b"))]
    near = wide_links(heads.select("fp")).join(of[0], "u").join(of[1], "v").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    led = buckets.where("node <> least").select(F.col("least").alias("u"), F.col("node").alias("v"))
    led = cut(led.unionByName(alike).unionByName(near).distinct(), "candidates")

    wanted = buckets.select("node").unionByName(led.select(F.col("u").alias("node"))).unionByName(led.select(F.col("v").alias("node"))).distinct()
    chosen = texts.join(wanted, "node", "left_semi").select("node", "one.*")
    sets = _sets(base.join(chosen, ["id", "row"]).select("node", "text"), shingle)
    sets = cut(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")

    def parted(rows: DataFrame, passed: DataFrame) -> DataFrame:
        """``rows`` with the part of each node."""
        part = texts.select("node").join(components(passed), "node", "left").select("node", F.coalesce("root", "node").alias("part"))
        return cut(rows.join(part, "node"), "placed")

    passed = cut(_verified(led, sets, similarity), "led")
    placed = parted(buckets.select("key", "node"), passed)
    hubbed = cut(_hubbed(placed), "hubbed")
    met = cut(hubbed.where("hub <> node").select(F.least("hub", "node").alias("u"), F.greatest("hub", "node").alias("v")).distinct(), "met")
    passed = cut(passed.unionByName(_verified(met.join(led, ["u", "v"], "left_anti"), sets, similarity)), "passed")
    again = parted(hubbed.select("hub", "node").distinct(), passed)
    members = cut(_mixed(again, "hub").select("hub", "node", "part"), "members")

    rest = _by_difference(members, sets, similarity).join(led.unionByName(met), ["u", "v"], "left_anti")
    roots = components(passed.unionByName(_verified(rest, sets, similarity)))
    classes = cut(texts.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "classes")
    for table in (texts, buckets, heads, led, sets, met, passed, placed, hubbed, again, members):
        forget(table)
    return sketches.select("id", "row", "node").join(classes, "node").select("id", "row", "root")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component): every row of ``docs`` with the least id that links reach.

    Words are as in operator 1, and texts of the same words (by a 64-bit digest)
    are one; a text of fewer than ``shingle`` words is one shingle, and wordless
    and null texts are copies of each other.  Null ids count as one id that
    precedes all others (and come back as null); repeated rows give repeated
    rows; an empty table gives an empty one; other columns are not looked at.
    """
    marked = _classes(docs, id_col, text_col, shingle, similarity)
    least = cut(marked.groupBy("root").agg(F.min("id").alias("component")), "least")
    return marked.join(least, "root").select(given_id("id").alias("id"), given_id("component").alias("component"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each class of :func:`near_copies`: that of the
    least id (under that id, of the least hash of the text)."""
    first = _classes(docs, id_col, text_col, shingle, similarity).groupBy("root").agg(F.min(F.struct(F.col("id").alias("__mf_id"), F.col("row").alias("__mf_row"))).alias("one")).select("one.*")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.withColumns({"__mf_id": known_id(id_col), "__mf_row": F.xxhash64(text)})
    return keyed.join(first, ["__mf_id", "__mf_row"], "left_semi").dropDuplicates(["__mf_id", "__mf_row"]).drop("__mf_id", "__mf_row")
