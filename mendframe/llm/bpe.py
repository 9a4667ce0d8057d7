"""Byte-level BPE encoding and decoding.

A text is cut at added special tokens, then into pieces by the pre-tokenizer's
pattern; each piece becomes bytes, and adjacent pairs are merged in the order
of their ranks.  The ranks of a piece's adjacent pairs are the leaves of a
segment tree of minima: the root is the leftmost lowest-ranked merge, a merge
updates three leaves in logarithmic time, and the piece is done when no leaf
holds a rank.  A piece without white space of a megabyte costs n log n steps.

Pieces repeat, so each worker keeps the encodings of short ones in a table of
bounded size.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendframe.llm.common import by_batch

#: Fixed value: the pre-tokenizer's pattern.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
NO_RANK = 1 << 62
#: Pieces of at most this many bytes are remembered, and so many of them.
SHORT, REMEMBERED = 48, 500_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary:
    itself where it is a visible Latin-1 character, else the next of U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, extra = [], 0x100
    for b in range(256):
        letters.append(chr(b if b in visible else extra))
        extra += b not in visible
    return letters


def merge(symbols: list[int], pairs: dict[int, tuple[int, int]], width: int) -> list[int]:
    """Apply merges to ``symbols``; ``pairs[a * width + b]`` is (rank, merged id).

    ``tree[size + i]`` holds rank * 2**32 + i for the pair that starts at symbol
    i; inner nodes hold the lesser of their two children.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1 << (n - 1).bit_length()
    tree = [NO_RANK] * (2 * size)
    get = pairs.get
    for i in range(n - 1):
        if found := get(symbols[i] * width + symbols[i + 1]):
            tree[size + i] = found[0] << 32 | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        while k > 1:
            other = tree[k ^ 1]
            k >>= 1
            if other < value:
                value = other
            if tree[k] == value:
                return
            tree[k] = value

    def rank(i: int) -> int:
        j = after[i]
        found = get(symbols[i] * width + symbols[j]) if j < n else None
        return found[0] << 32 | i if found else NO_RANK

    while (best := tree[1]) != NO_RANK:
        i = best & 0xFFFFFFFF
        j = after[i]
        symbols[i] = pairs[symbols[i] * width + symbols[j]][1]
        symbols[j] = -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
        put(j, NO_RANK)
        put(i, rank(i))
        if (h := before[i]) >= 0:
            put(h, rank(h))
    return [s for s in symbols if s >= 0]


class Codec:
    """Encoder and decoder of one tokenizer file (byte-level BPE as JSON)."""

    def __init__(self, spec: dict):
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        of_letter = {c: b for b, c in enumerate(letters)}
        self.width = max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))]) + 1
        self.of_byte = [vocab[c] for c in letters]
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.pairs.setdefault(vocab[a] * self.width + vocab[b], (rank, vocab[a + b]))
        self.bytes_of = [b""] * self.width
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(of_letter[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pieces = regex.compile(PIECE).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def piece(self, piece: str) -> list[int]:
        raw = piece.encode()
        ids = merge([self.of_byte[b] for b in raw], self.pairs, self.width)
        if len(raw) <= SHORT:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = tuple(ids)
        return ids

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        if not text:
            return ids
        at, known = 0, self.known.get
        marks = [(m.start(), m.end(), self.special[m[0]]) for m in self.cut.finditer(text)] if self.cut else []
        for start, end, special in [*marks, (len(text), len(text), None)]:
            for p in self.pieces(text[at:start] if marks else text):
                ids += known(p) or self.piece(p)
            if special is not None:
                ids.append(special)
            at = end
        return ids

    def decode(self, ids) -> str:
        """Bytes of the ids as UTF-8, with U+FFFD for what isn't."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str, shipped: bool = False) -> Codec:
    """The codec of a tokenizer file, once in each process."""
    with open(SparkFiles.get(path) if shipped else path, encoding="utf-8") as f:
        return Codec(json.load(f))


def _ship(docs: DataFrame, path: str) -> str:
    """Send the tokenizer file to the executors; its name there."""
    docs.sparkSession.sparkContext.addFile(path)
    return path.rpartition("/")[2]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids array<int>[, decoded string]) of each row of ``docs``.

    ``path`` is a local tokenizer file on the driver.  A null text is empty;
    ids and repeated rows are passed through as they are; an empty table gives
    an empty one; other columns are not looked at.  ``decoded`` adds the text
    that the ids decode to.
    """
    name = _ship(docs, path)

    def make():
        c = codec(name, True)

        def turn(batch: pa.RecordBatch) -> pa.RecordBatch:
            every = [c.encode(x.as_py()) for x in batch.column(1)]
            ends = np.cumsum([0, *map(len, every)], dtype=np.int32)
            flat = array("i")
            for ids in every:
                flat.fromlist(ids)
            columns = [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(flat, np.int32)))]
            if decoded:
                columns.append(pa.array(map(c.decode, every), pa.string()))
            return pa.record_batch(columns, names=["id", "ids", "decoded"][: len(columns)])

        return turn

    kind = "id long, ids array<int>" + ", decoded string" * decoded
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(by_batch(make), kind)


def decode(encoded: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text): ids back to text; a null array is empty; null ids stay null;
    repeated rows give repeated rows; an empty table gives an empty one; other
    columns are not looked at; a sequence of any length is decoded whole."""
    name = _ship(encoded, path)

    def make():
        c = codec(name, True)

        def turn(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.record_batch([batch.column(0), pa.array((c.decode(x or ()) for x in batch.column(1).to_pylist()), pa.string())], names=["id", "text"])

        return turn

    return encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(by_batch(make), "id long, text string")
