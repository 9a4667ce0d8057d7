"""Document fingerprints as invertible Bloom lookup sketches.

A text is cut into short content-defined paragraphs (at line ends, and inside a
line after words whose last bytes say so); of its runs of five bytes, the
thirty-two of least hash stand for one more paragraph each, so that a text of few
paragraphs has something to compare as well.  Each 64-bit digest is put into three
cells of a sketch, a cell holding a count, the sum of its digests and the sum of
their check sums.  Sketches of two versions subtract cell by cell, and peeling
cells that hold a single digest recovers exactly the paragraphs that only one
version has.  If peeling gets stuck, the sketches are made again larger, until it
succeeds.  Many sketches are built, subtracted and peeled at a time.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendframe.llm.common import given_id, known_id

#: Cells in each of the three tables of the stored sketch.
CELLS = 8
#: One word in so many ends a paragraph; so many runs of so many bytes are paragraphs too.
WORDS_A_PARAGRAPH, GRAMS, GRAM = 6, 32, 5
#: Odd multipliers that derive cells and check sums from a digest (fixed values; any odd numbers do).
SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
CHECK = np.uint64(0xD6E8FEB86659FD93)
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Bytes of text to a range of ids, of text that are worked on at a time, and of a long text that are hashed at a time.
RANGE_BYTES, GROUP_BYTES, BLOCK = 128 << 20, 1 << 20, 1 << 20
#: Rounds of peeling after which a sketch counts as stuck (a round empties every cell that holds one digest).
ROUNDS = 500


class Digests(NamedTuple):
    """The digests of several texts: those of text i are ``keys[at[i]:at[i + 1]]``."""

    keys: np.ndarray
    at: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1

    def take(self, rows: np.ndarray) -> Digests:
        sizes = self.at[rows + 1] - self.at[rows]
        at = np.concatenate([[0], np.cumsum(sizes)])
        return Digests(self.keys[np.arange(at[-1]) + np.repeat(self.at[rows] - at[:-1], sizes)], at)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.at))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * SPREAD[0]
    return (x ^ x >> np.uint64(29)) * SPREAD[1]


def paragraphs(raw: bytes) -> list[bytes]:
    """The paragraphs of a text (UTF-8), without white space at their ends."""
    b = np.frombuffer(raw, np.uint8)
    space = SPACE[b]
    ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    tail = b[ends - 1].astype(np.uint32)
    for k in (2, 3):
        tail = tail << np.uint32(8) | b[np.maximum(ends - k, 0)]
    last = b == 10
    last[ends[(tail * np.uint32(0x9E3779B1) >> np.uint32(12)) % np.uint32(WORDS_A_PARAGRAPH) == 0]] = True
    cuts = [0, *np.flatnonzero(last).tolist(), len(raw)]
    return [p for p in map(bytes.strip, map(raw.__getitem__, map(slice, cuts, cuts[1:]))) if p]


def least_grams(raw: bytes) -> np.ndarray:
    """Hashes of the GRAMS runs of GRAM bytes that hash least."""
    best = np.empty(0, dtype=np.uint64)
    for at in range(0, len(raw) - GRAM + 1, BLOCK):
        b = np.frombuffer(raw, np.uint8, min(BLOCK + GRAM - 1, len(raw) - at), at).astype(np.uint64)
        n = len(b) - GRAM + 1
        packed = b[:n]
        for k in range(1, GRAM):
            packed = packed << np.uint64(8) | b[k : k + n]
        best = np.concatenate([best, _mixed(packed)])
        if len(best) > GRAMS:
            best = np.partition(best, GRAMS)[:GRAMS]
    return best


def digests(texts: Sequence[str]) -> Digests:
    """Distinct digests of each text, a function of that text alone: of a
    paragraph that occurs again, one for each time."""
    digest, keys, sizes = xxhash.xxh3_64_intdigest, [], []
    for text in texts:
        raw = text.encode()
        every = paragraphs(raw)
        keys += [np.fromiter(map(digest, every), np.uint64, len(every)), least_grams(raw)]
        sizes.append(len(keys[-2]) + len(keys[-1]))
    found = np.concatenate([np.empty(0, dtype=np.uint64), *keys])
    out = Digests(found, np.concatenate([[0], np.cumsum(np.array(sizes, dtype=np.int64))]))
    row = out.rows()
    order = np.lexsort((found, row))
    found, row = found[order], row[order]
    fresh = np.ones(len(found), dtype=bool)
    fresh[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
    place = np.arange(len(found))
    time = place - np.maximum.accumulate(np.where(fresh, place, 0))
    return Digests(np.where(fresh, found, _mixed(found + time.astype(np.uint64) * SPREAD[2])), out.at)


def _checks(keys: np.ndarray) -> np.ndarray:
    x = keys * CHECK
    return (((x ^ x >> np.uint64(31)) * CHECK) >> np.uint64(32)).astype(np.uint32)


class Sketches:
    """Counts, digest sums and check sums of 3 * ``cells`` cells, one row a sketch."""

    def __init__(self, rows: int, cells: int):
        self.cells = cells
        self.count = np.zeros((rows, 3 * cells), dtype=np.int32)
        self.key = np.zeros((rows, 3 * cells), dtype=np.uint64)
        self.check = np.zeros((rows, 3 * cells), dtype=np.uint32)

    @classmethod
    def of(cls, found: Digests, cells: int = CELLS) -> Sketches:
        out = cls(len(found), cells)
        out._put(found.rows(), found.keys, np.ones(len(found.keys), dtype=np.int32))
        return out

    def _put(self, row: np.ndarray, keys: np.ndarray, sign: np.ndarray) -> None:
        x = keys ^ keys >> np.uint64(32)
        checks = _checks(keys)
        for table in range(3):
            at = ((x * SPREAD[table] >> np.uint64(33)) % np.uint64(self.cells)).astype(np.int64) + (row * 3 + table) * self.cells
            np.add.at(self.count.reshape(-1), at, sign)
            np.add.at(self.key.reshape(-1), at, keys * sign.astype(np.uint64))
            np.add.at(self.check.reshape(-1), at, checks * sign.astype(np.uint32))

    def __sub__(self, other: Sketches) -> Sketches:
        out = Sketches(0, self.cells)
        out.count, out.key, out.check = self.count - other.count, self.key - other.key, self.check - other.check
        return out

    def take(self, rows: np.ndarray) -> Sketches:
        out = Sketches(0, self.cells)
        out.count, out.key, out.check = self.count[rows], self.key[rows], self.check[rows]
        return out

    def written(self) -> list[str]:
        """Of each row, the cells as base64 of little-endian (count, check, digest) columns."""
        parts = (self.count.astype("<i4"), self.check.astype("<u4"), self.key.astype("<u8"))
        return [base64.b64encode(b"".join(p[k].tobytes() for p in parts)).decode() for k in range(len(self.count))]

    @classmethod
    def read(cls, written: Sequence[str]) -> Sketches:
        """Sketches of one size, as :meth:`written` gave them."""
        raw = [base64.b64decode(x) for x in written]
        n = len(raw[0]) // 16 if raw else 0
        out = cls(len(raw), n // 3)
        for k, x in enumerate(raw):
            out.count[k], out.check[k], out.key[k] = np.frombuffer(x, "<i4", n), np.frombuffer(x, "<u4", n, 4 * n), np.frombuffer(x, "<u8", n, 8 * n)
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, digest, sign) of the digests held more often on the left (1) or
        on the right (-1), and whether each row was resolved.  Empties the sketches."""
        rows, keys, signs = [], [], []
        count, key, check = (x.reshape(-1) for x in (self.count, self.key, self.check))
        for _ in range(ROUNDS):
            single = np.flatnonzero(np.abs(count) == 1)
            found = key[single] * count[single].astype(np.uint64)
            good = _checks(found) * count[single].astype(np.uint32) == check[single]
            single, found = single[good], found[good]
            if not len(single):
                break
            row, sign = single // (3 * self.cells), count[single]
            order = np.lexsort((found, row))
            row, found, sign = row[order], found[order], sign[order]
            fresh = np.ones(len(row), dtype=bool)
            fresh[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
            for out, x in ((rows, row), (keys, found), (signs, sign)):
                out.append(x[fresh])
            self._put(rows[-1], keys[-1], -signs[-1])
        done = ~(self.count.any(axis=1) | self.key.any(axis=1))
        row = np.concatenate([np.empty(0, dtype=np.int64), *rows])
        return row, np.concatenate([np.empty(0, dtype=np.uint64), *keys]), np.concatenate([np.empty(0, dtype=np.int32), *signs]), done


def differences(a: Digests, b: Digests, stored: tuple[Sketches, Sketches] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, digest, sign): the digests only in row i of ``a`` (sign 1) or of ``b``
    (-1), by sketches that grow until peeling succeeds.  A sketch with hardly an
    empty cell is not peeled; it grows at once to what may hold everything."""
    cells = np.full(len(a), CELLS)
    most = np.maximum(1, (np.diff(a.at) + np.diff(b.at)) // 2)
    left = np.arange(len(a))
    out: list[tuple[np.ndarray, ...]] = []
    while len(left):
        again, now = [], cells[left]
        for size in np.unique(now).tolist():
            rows = left[now == size]
            if stored and size == CELLS:
                rest = stored[0].take(rows) - stored[1].take(rows)
            else:
                rest = Sketches.of(a.take(rows), size) - Sketches.of(b.take(rows), size)
            full = np.count_nonzero(rest.key, axis=1) >= 0.95 * 3 * size
            cells[rows[full]] = np.maximum(2 * size, 1 << np.ceil(np.log2(most[rows[full]])).astype(np.int64))
            open_ = rows[~full]
            row, key, sign, done = rest.take(np.flatnonzero(~full)).peel()
            kept = done[row]
            out.append((open_[row[kept]], key[kept], sign[kept]))
            cells[open_[~done]] *= 2
            again += [rows[full], open_[~done]]
        left = np.concatenate(again)
    none = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int32))
    row, key, sign = (np.concatenate(x) for x in zip(none, *out, strict=True))
    return row, key, sign


def likenesses(a: Digests, b: Digests, stored: tuple[Sketches, Sketches] | None = None) -> np.ndarray:
    """Of each row: shared digests over all digests of both (1 if neither has any)."""
    row, _, sign = differences(a, b, stored)
    n, m = np.diff(a.at), np.diff(b.at)
    shared = n - np.bincount(row[sign > 0], minlength=len(n))
    every = n + m - shared
    return np.where(every > 0, shared / np.maximum(every, 1), 1.0)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS) -> DataFrame:
    """(id, fingerprint, digests): the written sketch and the paragraph digests
    of each row.  A null text is empty; ids pass through as they are; repeated rows
    give repeated rows; an empty table gives an empty one; other columns are not
    looked at; a text is hashed in blocks, whatever its length."""
    names = ["id", "fingerprint", "digests"]

    def run(batches):
        for batch in batches:
            for rows in _groups([batch], 1):
                found = digests([x or "" for _, x in rows])
                every = pa.ListArray.from_arrays(pa.array(found.at.astype(np.int32)), pa.array(found.keys.view(np.int64)))
                yield pa.record_batch([pa.array([i for i, _ in rows], pa.int64()), pa.array(Sketches.of(found, cells).written(), pa.string()), every], names=names)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fingerprint string, digests array<long>")


def _groups(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[list[tuple]]:
    """Rows in groups of about GROUP_BYTES of the column ``text``."""
    rows, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.append(row)
            size += len(row[text] or "")
            if size > GROUP_BYTES:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def _range_of(firsts: list[tuple[int, int]]) -> Column:
    """The number of the range, of those that begin with ``firsts`` (sorted), that
    the key (``rid``, ``hash``) lies in: a binary search in one folded literal."""
    ids, hashes = (F.split(F.lit(",".join(str(x[k]) for x in firsts)), ",").cast("array<bigint>") for k in (0, 1))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(max(1, (len(firsts) - 1).bit_length())))))

    def step(at, jump):
        to = at + jump
        i, h = F.get(ids, to), F.get(hashes, to)
        return F.when((i < F.col("rid")) | ((i == F.col("rid")) & (h <= F.col("hash"))), to).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(range, head, id, text), dealt and sorted so that each row's follower in
    its partition is the document next by descending id (null ids last, ties by the
    hash of the text), and the first after the last.

    A range exchange of (id, hash) alone deals the keys to about equal ranges, and
    their first keys, 16 bytes a range (as many as the exchange itself holds as its
    bounds), place the texts, which move once.  Each range gets one more row, marked
    ``head``: the first document of the range that follows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # ~id sorts in reverse and can't overflow
    base = docs.select(known_id(id_col).alias("id"), F.bitwise_not(known_id(id_col)).alias("rid"), F.xxhash64(text).alias("hash"), text.alias("text"))
    total = base.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    ranges = max(-(-total // RANGE_BYTES), 4 * docs.sparkSession.sparkContext.defaultParallelism)
    keys = base.select("rid", "hash").repartitionByRange(ranges, "rid", "hash")
    heads = keys.groupBy(F.spark_partition_id()).agg(F.min(F.struct("rid", "hash")).alias("first")).collect()
    firsts = sorted(tuple(r["first"]) for r in heads) or [(0, 0)]
    place, last = F.col("range"), len(firsts) - 1
    ids, hashes = (F.split(F.lit(",".join(str(x[k]) for x in firsts)), ",").cast("array<bigint>") for k in (0, 1))
    is_first = (F.get(ids, place) == F.col("rid")) & (F.get(hashes, place) == F.col("hash"))
    here = F.struct(place.alias("range"), F.lit(False).alias("head"))
    before = F.struct(F.when(place == 0, last).otherwise(place - 1).alias("range"), F.lit(True).alias("head"))
    dealt = base.withColumn("range", _range_of(firsts)).withColumn("to", F.explode(F.when(is_first, F.array(here, before)).otherwise(F.array(here))))
    rows = dealt.select("to.range", "to.head", "id", "rid", "hash", "text")
    return rows.repartitionById(len(firsts), "range").sortWithinPartitions("range", "head", "rid", "hash").select("range", "head", "id", "text")


def edited(text: str, following: str) -> str:
    """The last third (rounded down) replaced by as much of the next document's start."""
    cut_at = len(text) // 3
    return text[: len(text) - cut_at] + following[:cut_at]


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, edited, fingerprint, edited_fingerprint, near_edited,
    near_next) of each row, where the edit takes from the next document.

    Null texts are empty; null ids come last; equal ids are ordered by the hash of
    the text; repeated rows follow each other; a single document follows itself; an
    empty table gives an empty one; other columns are not looked at; texts of any
    length are read whole and worked on in groups of about a megabyte.
    """
    names = ["id", "text", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: list[tuple] = []  # the last row, whose follower is in the next group
        for group in _groups(batches, 3):
            rows = carried + group
            carried = rows[-1:]
            at = np.array([k for k in range(len(rows) - 1) if not rows[k][1] and rows[k][0] == rows[k + 1][0]], dtype=np.int64)
            every = digests([r[3] for r in rows])
            new = [edited(rows[k][3], rows[k + 1][3]) for k in at.tolist()]
            one, two = every.take(at), digests(new)
            stored = Sketches.of(every)
            mine, theirs, edits = stored.take(at), stored.take(at + 1), Sketches.of(two)
            near_edited, near_next = likenesses(one, two, (mine, edits)), likenesses(one, every.take(at + 1), (mine, theirs))
            ids, texts = ([rows[k][c] for k in at.tolist()] for c in (2, 3))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(new, pa.string()), pa.array(mine.written(), pa.string()), pa.array(edits.written(), pa.string()), pa.array(near_edited), pa.array(near_next)], names=names)

    kind = "id long, text string, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, id_col, text_col).mapInArrow(run, kind).withColumn("id", given_id("id"))
