"""Toxicity scores by a counterfactually regularised linear classifier.

A text's features are its words and their beginnings, each present or not.  A
logistic model is fitted on a bounded sample of labelled rows (``max_rows``);
besides the usual loss it pays for every labelled text whose score changes when
its identity terms are swapped for those of another group, so that naming a
group is not by itself evidence.  The sample is turned into feature numbers on
the executors, and every text is then scored where it lies.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendframe.llm.common import by_batch, cut

WORD = re.compile(r"[^\W\d_]+")
#: Groups of interchangeable identity terms; each is swapped for the next.
IDENTITY = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("girl", "boy"),
    ("female", "male"),
    ("muslims", "christians", "jews", "hindus", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "atheist"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("transgender", "cisgender"),
    ("immigrants", "natives"),
    ("immigrant", "native"),
    ("disabled", "abled"),
    ("old", "young"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)
SWAP = {a: b for group in IDENTITY for a, b in zip(group, (*group[1:], group[0]), strict=True)}
SPACE = 1 << 24
LEAST_PREFIX, LONGEST_PREFIX = 3, 7
#: Rows of the sample, features of the model, least documents of a feature.
MAX_ROWS, MAX_FEATURES, MIN_DOCS = 8000, 4096, 3
#: Weight of the squared norm, and of the squared score changes under swaps.
RIDGE, FAIRNESS, STEPS = 0.02, 1.0, 300
REMEMBERED = 150_000


def words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def numbers(word: str) -> list[int]:
    """Feature numbers of one word: itself, and its beginnings."""
    digest = xxhash.xxh32_intdigest
    out = [digest(word.encode()) % SPACE]
    for k in range(LEAST_PREFIX, min(LONGEST_PREFIX, len(word) - 1) + 1):
        out.append(digest(f"{word[:k]}^".encode()) % SPACE)
    return out


def features(found: set[str]) -> list[int]:
    return sorted({n for w in found for n in numbers(w)})


def swapped(found: set[str]) -> set[str]:
    """The words with each identity term replaced by its group's next one."""
    return {SWAP.get(w, w) for w in found}


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[int, float] = field(repr=False)

    def scorer(self) -> Callable[[str | None], float]:
        known: dict[str, tuple[int, ...]] = {}
        weights = self.weights

        def score(text: str | None) -> float:
            active: set[int] = set()
            for w in words(text):
                f = known.get(w)
                if f is None:
                    f = tuple(n for n in numbers(w) if n in weights)
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[w] = f
                if f:
                    active.update(f)
            z = self.bias + sum(weights[n] for n in sorted(active))
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score


def _sparse(rows: list[np.ndarray], place: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the chosen features of each row."""
    r, c = [], []
    for k, ids in enumerate(rows):
        at = [place[n] for n in ids.tolist() if n in place]
        r.append(np.full(len(at), k))
        c.append(np.array(at, dtype=np.int64))
    return (np.concatenate(r), np.concatenate(c)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64))


def train(x: list[np.ndarray], y: np.ndarray, swaps: list[tuple[int, np.ndarray]], chosen: list[int], fairness: float = FAIRNESS, ridge: float = RIDGE) -> Model:
    """Fit on the ``chosen`` of the feature numbers ``x``, labels ``y`` of both
    kinds and the (row, feature numbers) of texts with identity terms swapped."""
    share = y.mean()
    place = {n: k for k, n in enumerate(sorted(chosen))}
    rows, columns = _sparse(x, place)
    pair_of = np.array([k for k, _ in swaps], dtype=np.int64)
    s_rows, s_columns = _sparse([v for _, v in swaps], place)
    w, b = np.zeros(len(place)), float(np.log(share / (1 - share)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, STEPS + 1):  # Adam on the whole sample
        z = np.bincount(rows, w[columns], len(y))
        e = (1 / (1 + np.exp(-(z + b))) - y) / len(y)
        g = np.bincount(columns, e[rows], len(w)) + ridge * w / len(y)
        if len(swaps):
            d = 2 * fairness * (z[pair_of] - np.bincount(s_rows, w[s_columns], len(swaps))) / len(swaps)
            back = np.bincount(pair_of, d, len(y))
            g += np.bincount(columns, back[rows], len(w)) - np.bincount(s_columns, d[s_rows], len(w))
        gb = e.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w -= 0.05 * (m / c1) / (np.sqrt(v / c2) + 1e-9)
        b -= 0.05 * (mb / c1) / (np.sqrt(vb / c2) + 1e-9)
    return Model(b, {n: float(w[k]) for n, k in place.items() if w[k]})


def held_out(id_col: str = "doc_id") -> F.Column:
    """Rows that no model may learn from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, fairness: float = FAIRNESS, max_features: int = MAX_FEATURES) -> Model:
    """Fit on at most ``max_rows`` labelled rows of at most ``max_features``
    features, those with the least hashed ids, none of them held out.

    Null ids, labels and texts teach nothing; an id labelled twice counts as
    toxic if either says so; of several rows under one id, that whose text hashes
    least teaches.  Without labels of both kinds, as in empty tables, the model is
    constant.  Texts are read whole; other columns are not looked at.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    each = usable.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    sample = each.orderBy(F.xxhash64("id"), "id").limit(max_rows)  # at most max_rows * 12 bytes: safe to broadcast

    def make():
        def turn(batch: pa.RecordBatch) -> pa.RecordBatch:
            own, other = [], []
            for text in batch.column(0).to_pylist():
                found = words(text)
                own.append(features(found))
                other.append(features(swapped(found)) if not found.isdisjoint(SWAP) else None)
            kind = pa.list_(pa.int32())
            return pa.record_batch([batch.column(1), batch.column(2), pa.array(own, kind), pa.array(other, kind)], names=["id", "y", "own", "other"])

        return turn

    texts = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("id")).where("text is not null")
    # one row an id, however often it is repeated: no more than max_rows reach the driver
    one = texts.join(F.broadcast(sample), "id").groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = cut(one.select("text", "id", "y").mapInArrow(by_batch(make), "id long, y int, own array<int>, other array<int>"), "sample")
    total = rows.agg(F.sum("y").alias("bad"), F.count("*").alias("n")).first()
    n, bad = total["n"], total["bad"] or 0
    if not n or bad in (0, n):
        return Model(0.0 if not n else (4.0 if bad else -4.0), {})
    chosen = choose(rows, n, bad, max_features)

    def narrow(batches):
        wanted = set(chosen)
        for batch in batches:
            out = []
            for k in (2, 3):
                out.append(pa.array([None if x is None else sorted(wanted.intersection(x)) for x in batch.column(k).to_pylist()], pa.list_(pa.int32())))
            yield pa.record_batch([batch.column(0), batch.column(1), *out], names=["id", "y", "own", "other"])

    few = rows.mapInArrow(narrow, rows.schema).toArrow()
    order = np.lexsort((few["y"].to_numpy(), few["id"].to_numpy()))
    own, other, y = few["own"].to_pylist(), few["other"].to_pylist(), few["y"].to_numpy()
    x = [np.array(own[k], dtype=np.int64) for k in order]
    swaps = [(k, np.array(other[j], dtype=np.int64)) for k, j in enumerate(order) if other[j] is not None]
    return train(x, y[order].astype(float), swaps, chosen, fairness)


def choose(rows: DataFrame, n: int, bad: int, max_features: int = MAX_FEATURES, min_docs: int = MIN_DOCS) -> list[int]:
    """The features that the labels depend on most (chi-square), of those in at
    least ``min_docs`` rows: counted on the executors, ``max_features`` come back."""
    held = rows.select("y", F.explode("own").alias("f")).groupBy("f").agg(F.sum("y").alias("n1"), F.count("*").alias("n"))
    gap, share = F.col("n1") / bad - (F.col("n") - F.col("n1")) / (n - bad), bad / n
    chi = gap * gap * (n * share * (1 - share)) / F.greatest(F.col("n") / n * (1 - F.col("n") / n), F.lit(1e-9))
    best = held.where(F.col("n") >= min(min_docs, bad)).select("f", chi.alias("chi")).where("chi > 6.6").orderBy(F.desc("chi"), "f").limit(max_features)
    return sorted(r["f"] for r in best.collect())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row's whole text, whatever its length; empty and null
    texts get the score of no evidence; null ids stay null; repeated rows give
    repeated rows; an empty table gives an empty one; other columns are not looked at."""

    def make():
        of = model.scorer()

        def turn(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.record_batch([batch.column(0), pa.array(map(of, batch.column(1).to_pylist()), pa.float64())], names=["id", "score"])

        return turn

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(by_batch(make), "id long, score double")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more.  Null and empty
    texts have the score of no evidence; of repeated rows all or none go; an empty
    table gives an empty one; the columns are those of ``docs``, whatever their names."""

    scorers: list = []  # one in each process that runs this

    def toxic(texts: pa.Array) -> pa.Array:
        if not scorers:
            scorers.append(model.scorer())
        # a few texts at a time are Python strings
        parts = (texts.slice(k, 500).to_pylist() for k in range(0, len(texts), 500))
        return pa.array([scorers[0](x) >= threshold for part in parts for x in part], pa.bool_())

    return docs.where(~F.arrow_udf(toxic, "boolean")(F.col(text_col).cast("string")))
