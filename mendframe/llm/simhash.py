"""Near-duplicate documents by SimHash fingerprints and Golay fuzzy hashing.

A document's fingerprint has 64 bits, each the majority of that bit over the
XXH64 digests of its word shingles.  Fingerprints within ``radius`` = 4 bits are
linked.  Candidates come from blocking keys that lose no such pair:

The fingerprint is cut into three segments (22, 21, 21 bits); the errors of a
pair are pigeonholed over them.

* Some segment ``i`` has no error.  One other segment ``j`` has at most two, so
  the sets of Golay indices of segment ``j`` meet: key (i's bits, an index of j).
* Every segment has an error: (1, 1, 2) or (1, 1, 1) in some order.  With ``i``,
  ``j`` at one error and ``k`` at one or two, one of three parts of ``k`` is
  equal, one side's own index of ``i`` is among the other side's indices of
  ``i``, and the same the other way round for ``j``: key (index of i, index of
  j, a part of k).

A key has 31 to 33 bits, so candidates stay few.  Only distinct fingerprints have
keys: copies of a text, however many, are one row.  The fingerprints that share a
key are a bucket.  The keys are dealt and sorted once, and each bucket is searched
as a graph: a fingerprint is held against those of the bucket that nothing has
reached yet, and what it reaches is a link.  A link between two that are reached
joins nothing that isn't joined, so no link is lost to the classes, and a bucket
gives fewer rows than it has.  Only members that are not linked are compared in
pairs, in blocks of words, at some nanoseconds each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendframe.llm.common import by_batch, cut, forget, given_id, known_id
from mendframe.llm.components import across, components
from mendframe.llm.golay import fuzzy_indices, index

SEED, RADIUS = 42, 4
#: (offset, width) of the segments, and of the three parts of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PARTS = (((0, 8), (8, 7), (15, 7)), ((0, 7), (7, 7), (14, 7)), ((0, 7), (7, 7), (14, 7)))


def shingle_hashes(text: str | None, shingle: int = 4) -> np.ndarray:
    """Unsigned XXH64 of each shingle of a text, repeats included; fewer words
    are one shingle, and no words none."""
    words = (text or "").encode().lower().split()  # bytes: ASCII case and white space only
    n, digest = len(words), xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if n <= shingle:
        return np.array([digest(joined, SEED)] if n else [], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = [0, *(ends[:-shingle] + 1).tolist()]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Each bit that over half the hashes have; 0 without hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The unsigned SimHash of one text; 0 without words."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): one row a document; ``fp`` is the fingerprint as a signed long."""

    def make():
        def turn(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.fromiter((fingerprint(x, shingle) for x in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            return pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

        return turn

    return docs.select(known_id(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(by_batch(make), "id long, fp long")


def blocking_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of each (unsigned) fingerprint."""
    bits = [(fps >> np.uint64(at)).astype(np.int64) & ((1 << width) - 1) for at, width in SEGMENTS]
    own, near = [index(b) for b in bits], [fuzzy_indices(b) for b in bits]
    rows, keys = [], []

    def put(row, tag, high, low):
        rows.append(row)
        keys.append(np.int64(tag) << 50 | high << 12 | low)

    every = np.arange(len(fps))
    for i in range(3):
        for j in range(3):
            if i != j:
                row, idx = near[j]
                put(row, 3 * i + j, bits[i][row], idx)
    for k, (i, j) in enumerate(((1, 2), (0, 2), (0, 1))):
        for p, (at, width) in enumerate(PARTS[k]):
            part = bits[k][every] >> at & ((1 << width) - 1)
            row, idx = near[j]
            put(row, 9 + 3 * k + p, part[row] << 12 | own[i][row], idx)
            row, idx = near[i]
            put(row, 9 + 3 * k + p, part[row] << 12 | idx, own[j][row])
    return np.concatenate(rows), np.concatenate(keys)


def _keys(fps: DataFrame) -> DataFrame:
    """(key, fp): every key of the fingerprints of ``fps``."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):  # so that 128 keys a row stay within a few tens of MB
                fp = batch.column(0).slice(at, 4096).to_numpy()
                row, key = blocking_keys(fp.view(np.uint64))
                yield pa.record_batch([pa.array(key), pa.array(fp[row])], names=["key", "fp"])

    # a row becomes 128: dealt out first, however few bytes the fingerprints are
    # (by a hash, since a deal by the column itself is taken to be there already)
    dealt = fps.select("fp").repartition(_partitions(fps), F.xxhash64("fp"))
    return dealt.mapInArrow(run, "key long, fp long")


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within ``radius`` bits that connect whatever is linked among ``fps``
    (signed, distinct), fewer than there are fingerprints: each is held against
    those that nothing has reached yet."""
    u, v = [], []
    rest = np.sort(fps)
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count((rest ^ x).view(np.uint64)) <= radius
            if near.any():
                reached, rest = rest[near], rest[~near]
                u.append(np.full(len(reached), x))
                v.append(reached)
                queue.extend(reached)
    empty = [np.empty(0, dtype=np.int64)]
    return np.concatenate(u or empty), np.concatenate(v or empty)


def _linked(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The forests of whole buckets, given as rows in the order of their keys (one or more)."""
    fresh = np.concatenate([[True], key[1:] != key[:-1]])
    shared = ~(fresh & np.concatenate([fresh[1:], [True]]))  # not alone under its key
    key, fp = key[shared], fp[shared]
    order = np.lexsort((fp, key))
    key, fp = key[order], fp[order]
    once = np.ones(len(key), dtype=bool)  # a fingerprint may have a key twice
    once[1:] = (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])
    key, fp = key[once], fp[once]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, dtype=np.int64)
    sizes = np.diff(starts, append=len(key))
    two = starts[sizes == 2]
    two = two[np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= radius]
    found = [(fp[two], fp[two + 1]), *(forest(fp[at : at + n], radius) for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True))]
    u, v = (np.concatenate([x[k] for x in found]) for k in (0, 1))
    pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0)  # a pair shares many keys
    return pairs[:, 0], pairs[:, 1]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): pairs of different fingerprints of ``fps`` (one column ``fp``,
    distinct) within ``radius`` <= 4 bits; not all, but so many that whatever is
    linked is connected by them: a forest of each bucket."""
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"the keys cover a radius of 0 to {RADIUS} bits")

    def found(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key, fp = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        if len(key):
            yield pa.record_batch([pa.array(x) for x in _linked(key, fp, radius)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None  # the last bucket so far, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            key, fp = (batch.column(k).to_numpy().copy() for k in (0, 1))
            if key[-1] == last:
                held.append((key, fp))
                continue
            last = key[-1]
            at = int(np.searchsorted(key, last))
            yield from found([*held, (key[:at], fp[:at])])
            held = [(key[at:], fp[at:])]
        if held:
            yield from found(held)

    # one shuffle of the keys, at every size
    dealt = _keys(fps).repartition(_partitions(fps), "key").sortWithinPartitions("key")
    return cut(dealt.mapInArrow(run, "u long, v long").distinct(), "links")


def wide_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """:func:`links` for those who verify them otherwise: all pairs to the least of
    a bucket, and all pairs of a bucket that these leave in different parts, whose
    number grows with the square of such a bucket."""
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius
    keys = _keys(fps)
    shared = keys.groupBy("key").agg(F.min("fp").alias("least"), F.max("fp").alias("last")).where("least < last").select("key", "least")
    shared = cut(shared, "shared")  # few: its size is known now, so the keys need not be shuffled again if it is small
    buckets = cut(keys.join(shared, "key"), "buckets")
    led = cut(buckets.where("fp <> least").select(F.col("least").alias("u"), F.col("fp").alias("v")).where(near).distinct(), "led")
    part = components(led).withColumnsRenamed({"node": "fp", "root": "part"})
    placed = cut(buckets.select("key", "fp").join(part, "fp", "left").select("key", F.coalesce("part", "fp").alias("part"), F.col("fp").alias("node")), "placed")
    found = cut(led.unionByName(across(placed).where(near).distinct()), "links")
    for table in (buckets, led, placed):
        forget(table)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = RADIUS) -> DataFrame:
    """(id, fp, component): every row of ``docs`` with its fingerprint and the
    least id reachable over links.

    Null ids count as one id that precedes all others (and come back as null);
    null or wordless texts have fingerprint 0 and are linked like any other;
    repeated rows give repeated rows; an empty table gives an empty one; other
    columns are not looked at; a text is read whole and hashed in blocks.
    """
    marked = cut(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    first = marked.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links(first.select("fp"), radius))
    linked = first.join(roots.withColumnRenamed("node", "fp"), "fp")
    lowest = linked.groupBy("root").agg(F.min("least").alias("lowest"))
    moved = linked.join(lowest, "root").select("fp", "lowest")
    classes = first.join(moved, "fp", "left").select("fp", F.coalesce("lowest", "least").alias("component"))
    classes = cut(classes, "classes")  # a plain side, so that a text with very many copies can be split over tasks
    return marked.join(classes, "fp").select(given_id("id").alias("id"), "fp", given_id("component").alias("component"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each near-duplicate class: that of the least id
    (of rows repeated under that id, one).  Nulls, ties, empty and long texts are as
    in :func:`near_duplicates`; the columns are those of ``docs``, whatever their names."""
    name = "__mf_id"
    first = near_duplicates(docs, id_col, text_col, shingle, radius).where(F.col("id").eqNullSafe(F.col("component")))
    first = first.select(known_id("id").alias(name)).distinct()
    return docs.withColumn(name, known_id(id_col)).join(first, name, "left_semi").dropDuplicates([name]).drop(name)
