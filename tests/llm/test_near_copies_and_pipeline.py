"""Near copies against brute force, and the pipeline against brute-force stages."""

import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from corpora import corpus, prose, table
from mendframe.llm import nearcopies, toxicity
from test_text_operators import brute_lines, brute_overlap, by_row, lowered, rank
from tokenizers import Tokenizer


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def brute_classes(pairs, similarity=0.8):
    """The least id (null first) of each row's class."""
    sets, parent = [shingles(t) for _, t in pairs], list(range(len(pairs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(pairs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(pairs):
        least[root(k)] = min(least.get(root(k), rank(i)), rank(i))
    return [None if least[root(k)] == rank(None) else least[root(k)] for k in range(len(pairs))]


def edits(seed=8):
    """Texts with copies in which more and more words are replaced."""
    rng, pairs = random.Random(seed), []
    for family in range(12):
        words = prose(rng, 400).split(" ")
        for k in range(10):
            copy = list(words)
            for at in rng.sample(range(len(copy)), k):
                copy[at] = f"other{rng.randrange(10**6)}"
            pairs.append((1000 * family + k, " ".join(copy)))
    return pairs


@pytest.mark.parametrize("pairs", [corpus(), edits()], ids=["corpus", "edits"])
def test_near_copies(spark, pairs):
    got = [(r.id, r.component) for r in nearcopies.near_copies(table(spark, pairs)).collect()]
    assert by_row(got) == by_row((i, c) for (i, _), c in zip(pairs, brute_classes(pairs), strict=True))


def test_keep_one_near_copy(spark):
    pairs = corpus()
    docs = table(spark, pairs)
    kept = nearcopies.keep_one(docs)
    assert kept.columns == docs.columns
    want = [i for (i, _), c in zip(pairs, brute_classes(pairs), strict=True) if i == c]
    got = kept.collect()
    assert sorted(rank(r.doc_id) for r in got) == sorted({rank(i) for i in want})
    assert {(r.doc_id, r.text) for r in got} <= set(pairs)
    assert nearcopies.keep_one(table(spark, [])).count() == 0


@pytest.mark.parametrize("similarity", [0.6, 0.8, 0.9])
def test_differences_from_a_hub_lose_no_pair(spark, similarity):
    rng = random.Random(7)
    hub = set(rng.sample(range(10**6), 120))
    sets = {0: hub, 1: set(rng.sample(sorted(hub), 100)), 2: set(range(10**6, 10**6 + 50)), 3: hub | {5 * 10**6}}
    for k in range(4, 160):  # copies of the hub, of a copy, and of a text of its own, of many sizes
        base = sorted(sets[rng.choice([0, 0, 1, 2, max(4, k // 2) if k > 8 else 0])])
        kept = rng.sample(base, rng.randrange(len(base) * 3 // 4, len(base) + 1))
        sets[k] = set(kept) | set(rng.sample(range(2 * 10**6, 2 * 10**6 + 400), rng.randrange(25)))

    def alike(a, b):
        both = len(sets[a] & sets[b])
        return both >= similarity * (len(sets[a]) + len(sets[b]) - both) - 1e-9

    part = {k: 0 if alike(0, k) else k for k in sets}
    led = spark.createDataFrame([(0, k, p) for k, p in part.items()], "hub long, node long, part long")
    table_ = spark.createDataFrame([(k, sorted(s)) for k, s in sets.items()], "node long, shingles array<long>")
    found = [(r.u, r.v) for r in nearcopies._by_difference(led, table_, similarity).collect()]
    wanted = {(a, b) for a in sets for b in sets if a < b and part[a] != part[b] and alike(a, b)}
    assert len(found) == len(set(found)) and wanted and wanted <= set(found)


def test_copies_with_edits_of_their_own_meet_no_one(spark):
    rng = random.Random(5)
    hub = rng.sample(range(10**6), 130)
    sets = {0: hub} | {k: rng.sample(hub, 112) + [k * 10**6 + n for n in range(25)] for k in range(1, 401)}
    led = spark.createDataFrame([(0, k, k) for k in sets], "hub long, node long, part long")
    table_ = spark.createDataFrame([(k, sorted(s)) for k, s in sets.items()], "node long, shingles array<long>")
    assert nearcopies._by_difference(led, table_, 0.8).count() == 0


def test_near_copies_of_one_text_cost_a_row_each(spark):
    rng = random.Random(3)
    words = prose(rng, 300).split(" ")
    pairs = [(k, " ".join([*words[: k % 290], f"new{k}", *words[k % 290 + 1 :]])) for k in range(600)] + [(-1, prose(rng, 300))]
    found = {r.id: r.component for r in nearcopies.near_copies(table(spark, pairs)).collect()}
    assert found == {**{k: 0 for k in range(600)}, -1: -1}


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Every stage by brute force, on what brute force left of the one before."""
    rng = random.Random(4)
    insults = ["grobnak", "vuldrit", "smerch"]
    pairs, labels = [], []
    for k in range(160):
        w = prose(rng, rng.choice([20, 60, 150])).split(" ")
        if k % 4 == 0:
            w[rng.randrange(len(w))] = rng.choice(insults)
        pairs.append((k, " ".join(w)))
        labels.append((k, 0, int(k % 4 == 0)))
    line = "a licence line that documents share"
    pairs += [(200 + k, f"{pairs[4 * k + 1][1]}\n{line}") for k in range(5)]
    near = prose(rng, 300).split(" ")
    pairs += [(210 + k, " ".join([*near[: 30 * k], f"edit{k}", *near[30 * k + 1 :]])) for k in range(5)]
    items = [(1, prose(rng, 20)), (2, "two words")]
    shouted = "".join(c.upper() if c.isascii() else c for c in items[0][1])
    pairs += [(220, f"{prose(rng, 60)} {shouted}"), (221, f"{prose(rng, 900)} {items[0][1]}"), (222, None), (223, ""), (224, "naïve 漢字 🙂\t<|endoftext|>  x")]
    table(spark, pairs).select("doc_id", "text", "lang", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    found = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    model = toxicity.fit(table(spark, pairs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    score = model.scorer()
    left = [(i, t) for i, t in pairs if score(t) < 0.3]
    toxic = {i for i, _, bad in labels if bad}
    assert Counter(i in toxic for i, _ in left)[True] <= 2 and len(left) >= len(pairs) - len(toxic) - 2
    left = [(i, None if t is None else kept) for (i, t), (_, _, _, kept) in zip(left, brute_lines(left), strict=True)]
    left = [(i, t) for (i, t), c in zip(left, brute_classes(left), strict=True) if i == c]
    left = [(i, t) for (i, t), (_, n, hit, _) in zip(left, brute_overlap(left, items), strict=True) if not (hit and 20 * hit >= n)]
    assert 220 not in dict(left) and 221 in dict(left) and 210 in dict(left) and 211 not in dict(left)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in left}
    assert {i: r.ids for i, r in found.items()} == want
    for i, ids in want.items():
        r, back = found[i], tokenizer.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
