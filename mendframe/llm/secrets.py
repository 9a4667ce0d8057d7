"""Secrets in text: fixed patterns, and random strings by token efficiency.

Prose spends one token on several characters; a random string spends one on
little more than one.  Candidate strings are encoded with a tiktoken
vocabulary, and a low characters-per-token ratio marks them, unless they are
known digests (listed, of nothing, or named as digests by the words in front of
them; the length of a digest alone says nothing) or identifiers.  A candidate is a whole run, a stretch of it
between words, or a part between separators, so that words glued on do not
average a random string away.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Collection
from functools import lru_cache
from itertools import permutations

import pyarrow as pa
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendframe.llm.common import by_batch


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The names that a secret is assigned to, and the base kinds in their order.
NAMES = ("password", "passwd", "secret", "token", "api_?key")
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(rf"""({"|".join(map(either_case, NAMES))})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
#: A start of a long run only: shorter runs can't pass, so they needn't be matched one by one.
HEX_LONG = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
#: Least characters of a random string, by how many of a-z, A-Z and 0-9 it draws on (70 to 95 bits).
LEAST = {0: 20, 1: 20, 2: 16, 3: 12}
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{min(LEAST.values())},}}")
PART = re.compile("[A-Za-z0-9]+")
#: Letters and a few digits behind them, or a number: the shape of a part of an identifier.
NAMELIKE = re.compile("([A-Za-z]+)[0-9]{0,4}|[0-9]+")
TIME = re.compile("[0-9]{4}-?[0-9]{2}-?[0-9]{2}[Tt_-]?(?:[0-9]{2}-?){2,3}[0-9]*[Zz]?(?:[+-][0-9]{2,4})?")
ALPHABETS = tuple(a + b + c for a, b, c in permutations(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789")))
UUID = re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}")
#: Lengths in hexadecimal of the usual digests (64, 128, 160, 224, 256, 384, 512 bits).
DIGESTS = (16, 32, 40, 56, 64, 96, 128)
#: Words in front of a digest that say what it is.
NAMED = re.compile(r"(?:sha-?[0-9]{0,3}|md5|blake[0-9a-z]*|crc(?:32|64)?|digest|checksum|hash|commit|revision|etag|integrity|fingerprint|objects)[^A-Za-z0-9\n]{1,8}\Z", re.ASCII | re.IGNORECASE)
#: Digests of nothing, which stand for no secret.
OF_NOTHING = frozenset(hashlib.new(name, b"").hexdigest() for name in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"))
#: Code points in which such a word is looked for.
AHEAD = 24
#: A digest or UUID between separators.
WHOLE = re.compile(rf"(?<![A-Za-z0-9])(?:{UUID.pattern}|{'|'.join(f'[0-9a-f]{{{n}}}|[0-9A-F]{{{n}}}' for n in DIGESTS)})(?![A-Za-z0-9])")
#: Characters a token under which a string counts as random (prose has 4, code 3).
RATIO = 2.0
#: Characters a token from which a part counts as a word that ends a stretch.
WORD = 3.0
#: Fixed value: the pre-tokenizer's pattern of the vocabulary.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def vocabulary(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PIECE, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by start, then kind as listed."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8] if ":" in text or "=" in text else []
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16] if "AKIA" in text else []
    found += [("hex", *m.span()) for m in HEX_LONG.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def tokens(x: str, encoding: tiktoken.Encoding) -> int:
    """Token count; that of a very long string is taken block by block, so time is linear."""
    return sum(len(encoding.encode_ordinary(x[i : i + 1024])) for i in range(0, len(x), 1024))


def is_known(x: str, encoding: tiktoken.Encoding, ratio: float = RATIO) -> bool:
    """A UUID, a time, a number, an alphabet, or an identifier: parts of a name's
    shape whose letters, if more than three stand together, are words."""
    if UUID.fullmatch(x) or TIME.fullmatch(x):
        return True
    if len(x) <= 66 and any(x.rstrip("+/_=-") in a for a in ALPHABETS):
        return True
    parts = [NAMELIKE.fullmatch(p) for p in PART.findall(x)]
    if not all(parts):
        return False
    words = [p[1] for p in parts if p[1] and len(p[1]) > 3]
    return sum(map(len, words)) >= ratio * sum(tokens(w, encoding) for w in words)


def is_random(x: str, encoding: tiktoken.Encoding, ratio: float = RATIO) -> bool:
    lower = re.search("[a-z]", x)
    kinds = (lower, re.search("[A-Z]", x[1:] if lower else x), re.search("[0-9]", x))  # a capital in front is no second kind
    return len(x) >= LEAST[sum(map(bool, kinds))] and not is_known(x, encoding, ratio) and len(x) < ratio * tokens(x, encoding)


def is_word(x: str, encoding: tiktoken.Encoding) -> bool:
    m = NAMELIKE.fullmatch(x)
    return bool(m and m[1]) and len(m[1]) > 3 and len(m[1]) >= WORD * tokens(m[1], encoding)


def random_in(x: str, encoding: tiktoken.Encoding, ratio: float = RATIO) -> list[tuple[int, int]]:
    """Where a run without digests is random: all of it, else stretches without words, else parts."""
    if is_random(x, encoding, ratio):
        return [(0, len(x))]
    stretches, last = [], False
    for m in PART.finditer(x):
        word = is_word(m[0], encoding)
        if not word:
            if last:
                stretches[-1].append(m.span())
            else:
                stretches.append([m.span()])
        last = not word
    out = []
    for parts in stretches:
        whole = (parts[0][0], parts[-1][1])
        if is_random(x[whole[0] : whole[1]], encoding, ratio):
            out.append(whole)
        elif len(parts) > 1:
            out += [(a, b) for a, b in parts if is_random(x[a:b], encoding, ratio)]
    return out


def is_digest(text: str, start: int, end: int, known: Collection[str] = ()) -> bool:
    """Whether the digest or UUID that stands there is known as one."""
    x = text[start:end].lower()
    return "-" in x or x in known or x in OF_NOTHING or bool(NAMED.search(text, max(0, start - AHEAD), start))


def random_strings(text: str, encoding: tiktoken.Encoding, ratio: float = RATIO, known: Collection[str] = ()) -> list[tuple[str, int, int]]:
    """Spans of candidates that the vocabulary compresses badly; known digests and
    UUIDs end a candidate."""
    out = []
    for m in CANDIDATE.finditer(text):
        at = m.start()
        for a, b in [*(k.span() for k in WHOLE.finditer(text, *m.span()) if is_digest(text, *k.span(), known)), (m.end(), 0)]:
            if a - at >= min(LEAST.values()):
                out += [("random", at + c, at + d) for c, d in random_in(text[at:a], encoding, ratio)]
            at = b
    return out


def spans(text: str | None, encoding: tiktoken.Encoding, ratio: float = RATIO, known: Collection[str] = ()) -> list[tuple[str, int, int]]:
    """Base spans and added ones (kind ``random``), by start, then kind."""
    text = text or ""
    return sorted(base_spans(text) + random_strings(text, encoding, ratio, known), key=lambda s: (s[1], (*KINDS, "random").index(s[0])))


def secrets(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ratio: float = RATIO, known: Collection[str] = ()) -> DataFrame:
    """(id, spans array<struct<kind, start, end, hit>>): code points, end exclusive.

    ``path`` is a local file of tiktoken ranks on the driver; ``known`` are digests
    (lower-case hexadecimal) that are no secrets.  A null text is empty; ids and
    repeated rows pass through as they are; an empty table gives an empty one;
    other columns are not looked at; texts of any length are read whole.
    """
    docs.sparkSession.sparkContext.addFile(path)
    name, listed = path.rpartition("/")[2], frozenset(known)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("hit", pa.string())]))

    def make():
        encoding = vocabulary(SparkFiles.get(name))

        def turn(batch: pa.RecordBatch) -> pa.RecordBatch:
            every = [[{"kind": k, "start": a, "end": b, "hit": x[a:b]} for k, a, b in spans(x, encoding, ratio, listed)] for x in batch.column(1).to_pylist()]
            return pa.record_batch([batch.column(0), pa.array(every, kind)], names=["id", "spans"])

        return turn

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(by_batch(make), "id long, spans array<struct<kind:string,start:long,end:long,hit:string>>")
