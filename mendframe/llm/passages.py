"""Removal of passages that recur: every window of ``width`` consecutive words
whose word sequence starts anywhere else takes its words with it.

1. *Candidates.*  Winnowing picks, in every window, the least-hashed phrase of
   ``phrase`` words; equal windows pick the same one, and about one word in
   fourteen begins a picked phrase.  A pick owns a run of windows.  Only picks
   are shuffled, and phrases picked at least twice recur.
2. *Passages.*  A pick whose whole run of windows (one hash) occurs again is
   settled: all its windows are repeats.  That is the inside of every recurring
   passage, at one row for some fourteen windows.
3. *Automata.*  What is left are the picks at the edges, and one representative
   of each settled run of the same phrase.  Each shard of the documents that hold
   such picks compiles its phrases into an Aho-Corasick automaton over coded words
   and streams its documents through it.  The hits choose the windows: every window
   that holds a hit is hashed whole (128 bits) and counted over the corpus.
4. *Removal.*  The repeats' runs come back to their documents.

A window's words decide which phrase is picked in it, so equal windows anywhere
hold the same phrase, and a window that holds no recurring phrase is no repeat.
Hashes of phrases only ever add candidates.  A passage that very many documents
hold is one hot key: counts are aggregated before they are shuffled, and both
sides of the joins are written tables, so that its rows can be split over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendframe.llm.common import by_batch, cut, given_id, known_id

WIDTH, PHRASE = 35, 8
#: Odd multipliers of the rolling hashes (fixed values; any odd numbers do).
MIX, MIX_HIGH, MIX_LOW = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
#: Words of text that share an automaton.
SHARD_WORDS = 200_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # bytes: ASCII white space only


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words))


def rolling(h: np.ndarray, width: int, mix: int) -> np.ndarray:
    """A 64-bit polynomial hash of each run of ``width`` values, scrambled;
    built by doubling, so it takes a few passes over the array."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total, at, block, size, power = None, 0, h, 1, mix
    for bit in range(width.bit_length()):
        if width >> bit & 1:
            piece = block[at : at + n]
            total = piece.copy() if total is None else total * np.uint64(power) + piece
            at += size
        if width >> (bit + 1):
            block = block[:-size] * np.uint64(power) + block[size:]
            size, power = size * 2, power * power & 0xFFFFFFFFFFFFFFFF
    total ^= total >> np.uint64(29)
    total *= np.uint64(MIX)
    return total ^ total >> np.uint64(32)


def owners(phrases: np.ndarray, reach: int) -> np.ndarray:
    """For each ``reach`` consecutive values, the position of the last least one."""
    n = len(phrases) - reach + 1
    out = np.empty(max(n, 0), dtype=np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for any text
        views = np.lib.stride_tricks.sliding_window_view(phrases[at : min(n, at + (1 << 16)) + reach - 1], reach)
        out[at : at + len(views)] = reach - 1 - np.argmin(views[:, ::-1], axis=1) + np.arange(len(views)) + at
    return out


def stretches(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of values from ``starts`` to ``ends``: prefix
    sums with falling powers of an odd number, scaled back to the run's start."""
    powers = np.full(len(h) + 1, MIX_HIGH, dtype=np.uint64)
    falling = np.full(len(h), pow(MIX_HIGH, -1, 1 << 64), dtype=np.uint64)
    powers[0] = 1
    if len(h):
        falling[0] = 1
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(h * np.cumprod(falling))])
    total = (sums[ends] - sums[starts]) * np.cumprod(powers)[starts] + (ends - starts).astype(np.uint64)
    total ^= total >> np.uint64(29)
    total *= np.uint64(MIX)
    return total ^ total >> np.uint64(32)


def _picks(docs: DataFrame, width: int, phrase: int) -> DataFrame:
    """(id, row, phrase, run, start, windows, at): each pick of each text; it owns
    ``windows`` windows from ``start`` on, ``run`` is the hash of all their words,
    and the phrase itself begins ``at`` words behind ``start``."""

    def make():
        def turn(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns: list[list[np.ndarray]] = [[], [], [], [], []]
            sizes = []
            for text in batch.column(2).to_pylist():
                h = word_hashes(words_of(text))
                if len(h) < width:
                    sizes.append(0)
                    continue
                grams = rolling(h, phrase, MIX)
                own = owners(grams, width - phrase + 1)
                starts = np.concatenate([[0], np.nonzero(np.diff(own))[0] + 1])
                windows = np.diff(np.concatenate([starts, [len(own)]]))
                for c, x in zip(columns, (grams[own[starts]].view(np.int64), stretches(h, starts, starts + windows + width - 1).view(np.int64), starts.astype(np.int32), windows.astype(np.int32), (own[starts] - starts).astype(np.int32)), strict=True):
                    c.append(x)
                sizes.append(len(starts))
            row = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            kinds = (np.int64, np.int64, np.int32, np.int32, np.int32)
            return pa.record_batch([batch.column(0).take(row), batch.column(1).take(row), *(pa.array(np.concatenate([np.empty(0, k), *c])) for c, k in zip(columns, kinds, strict=True))], names=["id", "row", "phrase", "run", "start", "windows", "at"])

        return turn

    return docs.mapInArrow(_in_parts(make), "id long, row long, phrase long, run long, start int, windows int, at int")


#: Rows of an Arrow batch that are made Python objects at a time.
ROWS_AT_ONCE = 256


def _records(lists: pa.ListArray) -> list[np.ndarray]:
    """Lists of structs of integers as an array of records for each row, empty for null."""
    items = lists.flatten()
    every = np.empty(len(items), dtype=[(f.name, np.int32) for f in items.type])
    for k, column in zip(every.dtype.names, items.flatten(), strict=True):
        every[k] = column.to_numpy()
    ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy()).tolist()
    return [every[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _in_parts(make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> Callable:
    """:func:`by_batch` over a few rows of a batch at a time: they hold many picks or runs."""
    run = by_batch(make)
    return lambda batches: run(b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, list[bytes], np.ndarray]]]:
    """Bounded groups of (id, row, words, picks); a repeated row is taken once."""
    shard, size, last = [], 0, None
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            for id_, row, text, picks in zip(*(part.column(k).to_pylist() for k in range(3)), _records(part.column(3)), strict=True):
                if (id_, row) == last:
                    continue
                last = (id_, row)
                w = words_of(text)
                shard.append((id_, row, w, picks))
                size += len(w)
                if size >= SHARD_WORDS:
                    yield shard
                    shard, size = [], 0
    if shard:
        yield shard


class Phrases:
    """An automaton that finds phrases of words.  A word is a code of ``CODE``
    letters out of 256, since a node's children are searched one by one."""

    CODE = 3

    def __init__(self, phrases: Iterator[list[bytes]]):
        self.codes: dict[bytes, str] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for p in phrases:
            self.automaton.add_word("".join([self._code(w) for w in p]))
        self.automaton.make_automaton()

    def _code(self, word: bytes) -> str:
        code = self.codes.get(word)
        if code is None:
            n = len(self.codes) + 1
            code = self.codes[word] = "".join(chr(n >> 8 * k & 255) for k in range(self.CODE))
        return code

    def ends(self, words: list[bytes]) -> np.ndarray:
        """The places of the words that a phrase ends with."""
        if not self.automaton:
            return np.empty(0, dtype=np.int64)
        code, unknown = self.codes.get, chr(0) * self.CODE
        found = np.fromiter((end for end, _ in self.automaton.iter("".join([code(w, unknown) for w in words]))), np.int64)
        return found[found % self.CODE == self.CODE - 1] // self.CODE  # others begin inside a word's code


def _located(shard: list, width: int, phrase: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(id, row, word hashes, starts of windows, their votes) of each document:
    the windows that hold a hit of the shard's automaton.  Those of a settled run
    vote twice."""
    automaton = Phrases(w[at : at + phrase] for _, _, w, picks in shard for p in picks for at in [p["start"] + p["at"]])
    for id_, row, w, picks in shard:
        n = len(w) - width + 1
        ends = automaton.ends(w)
        marks = np.zeros(n + 1, dtype=np.int32)
        np.add.at(marks, np.clip(ends - width + 1, 0, n), 1)  # windows that hold the phrase whole
        np.add.at(marks, np.clip(ends - phrase + 2, 0, n), -1)
        votes = np.ones(n, dtype=np.int32)
        for p in picks:
            votes[p["start"] : p["start"] + p["windows"]] = p["votes"]
        starts = np.flatnonzero(np.cumsum(marks[:n]) > 0)
        yield id_, row, word_hashes(w), starts, votes[starts]


def _windows(joined: DataFrame, width: int, phrase: int) -> DataFrame:
    """(high, low, id, row, start, votes) of each window to be counted."""

    def run(batches):
        for shard in _shards(batches):
            for id_, row, h, starts, votes in _located(shard, width, phrase):
                for at in range(0, len(starts), 1 << 18):
                    part = starts[at : at + (1 << 18)]
                    high, low = (rolling(h[part[0] : part[-1] + width], width, m)[part - part[0]] for m in (MIX_HIGH, MIX_LOW))
                    yield pa.record_batch([pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), pa.array(np.full(len(part), id_)), pa.array(np.full(len(part), row)), pa.array(part.astype(np.int32)), pa.array(votes[at : at + len(part)])], names=["high", "low", "id", "row", "start", "votes"])

    return joined.mapInArrow(run, "high long, low long, id long, row long, start int, votes int")


def _kept(joined: DataFrame, width: int) -> DataFrame:
    def make():
        def turn(batch: pa.RecordBatch) -> pa.RecordBatch:
            totals, removed, kept = [], [], []
            for text, runs in zip(batch.column(1).to_pylist(), _records(batch.column(2)), strict=True):
                w = words_of(text)
                totals.append(len(w))
                if len(runs):
                    marks = np.zeros(len(w) + 1, dtype=np.int32)
                    np.add.at(marks, runs["start"], 1)
                    np.add.at(marks, runs["start"] + runs["windows"] + width - 1, -1)
                    w = [w[k] for k in np.nonzero(np.cumsum(marks[:-1]) == 0)[0].tolist()]
                removed.append(totals[-1] - len(w))
                kept.append(b" ".join(w).decode())
            return pa.record_batch([batch.column(0), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept_text"])

        return turn

    return joined.select("id", "text", "runs").mapInArrow(_in_parts(make), "id long, n_words long, n_removed long, kept_text string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, phrase: int = PHRASE) -> DataFrame:
    """(id, n_words, n_removed, kept_text): one row a row of ``docs``.

    Words are runs without ASCII white space, compared as they are; a window is
    ``width`` consecutive words.  Null texts have no words; null ids are ids
    like any other; a repeated row is another occurrence of its windows; an
    empty table gives an empty one; other columns are not looked at; a text is
    read whole, whatever its length.
    """
    if not 1 <= phrase <= width:
        raise ValueError("a phrase must fit into a window")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(known_id(id_col).alias("id"), F.xxhash64(text).alias("row"), text.alias("text"))
    picks = cut(_picks(base, width, phrase), "picks")
    recurring = cut(picks.groupBy("phrase").agg(F.count("*").alias("n")).where("n > 1").select("phrase"), "phrases")
    again = cut(picks.join(recurring, "phrase"), "recurring")
    # a run that occurs again is settled; one of its picks votes for it, twice
    first = F.min(F.struct("id", "row", "start", "windows", "at")).alias("one")
    runs = cut(again.groupBy("phrase", "run").agg(F.count("*").alias("n"), first), "runs")
    open_ = cut(runs.where("n = 1").select("phrase").distinct(), "open")
    voters = runs.join(open_, "phrase", "left_semi").select("phrase", "one.*", F.when(F.col("n") > 1, 2).otherwise(1).alias("votes"))
    voters = voters.groupBy("id", "row").agg(F.collect_list(F.struct("start", "windows", "at", "votes")).alias("picks"))
    windows = cut(_windows(base.join(voters, ["id", "row"]).select("id", "row", "text", "picks"), width, phrase), "windows")
    repeats = cut(windows.groupBy("high", "low").agg(F.sum("votes").alias("n")).where("n > 1").select("high", "low"), "repeats")
    edges = windows.where("votes = 1").join(repeats, ["high", "low"]).select("id", "row", "start", F.lit(1).alias("windows"))
    settled = again.join(runs.where("n > 1").select("phrase", "run"), ["phrase", "run"], "left_semi").select("id", "row", "start", "windows")
    # sets, since every copy of a repeated row reports the same runs
    found = settled.unionByName(edges).groupBy("id", "row").agg(F.collect_set(F.struct("start", "windows")).alias("runs"))
    return _kept(base.join(found, ["id", "row"], "left"), width).withColumn("id", given_id("id"))
