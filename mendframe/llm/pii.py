"""Personal data: fixed patterns, then bootstrapped contextual extraction.

Everything is built from DataFrame expressions.  One scan of the texts finds
the base spans (email, ip, card, phone) and all runs of identifier-like tokens,
each with the words around it; it is written without the texts.  On that small
table the base spans are seeds, what they leave of the runs are the candidates.
A context (words around an instance) or a context with a shape (a word beside it,
and how it is made of digits and letters) is a lexical pattern.  Patterns and
instances are a graph that is scored in generations: a pattern by the share of
its instances that are trusted, an instance by the noisy-or of its accepted
patterns; an instance that scores enough is trusted from then on, and so lends
its own contexts to the patterns of the next generation, until nothing changes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendframe.llm.common import cut, given_id, known_id

#: Fixed order of the base kinds.
KINDS = ("email", "ip", "card", "phone")
# Possessive, and anchored to where a run starts (or the last match ended), so
# that a long run is read once: the matches are those of the plain patterns.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SPACES = r"[\x00-\x20\x7F]+"
#: Code points on either side in which the words around a token are looked for, by default.
CONTEXT = 120
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Code points up to which neighbouring tokens are one candidate, by default.
LONGEST = 64
TOKEN = r"[^\x00-\x20\x7F0-9@]*+[0-9@][^\x00-\x20\x7F]*+"
SPAN = "array<struct<start:int,end:int,hit:string>>"
SEEN = "array<struct<start:int,end:int,hit:string,ahead:array<string>,behind:string>>"
PLACED = "array<struct<start:int,end:int,hit:string,before:string,after:string>>"
MARK = "\uffff"
#: Matches that are placed at a time.
BLOCK = 512


def runs_of(longest: int) -> str:
    """Tokens with a digit or @, one space apart; as many as ``longest`` can hold."""
    return rf"(?<![^\x00-\x20\x7F]){TOKEN}(?:\x20{TOKEN}){{0,{max(0, longest // 2 - 1)}}}+"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` evaluated once, though used inside lambdas."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def parted(text: Column, pattern: str) -> Column:
    """What stands between matches and the matches, in turn: an odd number of
    strings.  One linear pass marks the matches; a text that holds the mark
    itself (a noncharacter) takes the slower way."""
    marked = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)
    hits = F.concat(F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda h: F.array(h)), F.array(F.array().cast("array<string>")))
    slow = F.flatten(F.zip_with(F.split(text, pattern, -1), hits, lambda g, h: F.concat(F.array(g), h)))
    return F.when(F.contains(text, F.lit(MARK)), slow).otherwise(marked)


def located(text: Column, pattern: str, context: int = CONTEXT) -> Column:
    """Array of (start, end, hit, before, after) of all matches, in code points, end
    exclusive; ``before`` and ``after`` are up to ``context`` code points of what
    stands on either side, the neighbouring match included."""
    def extent(x):
        return F.length(x["gap"]) + F.length(x["hit"])

    def step(a, x):
        start = a["at"] + F.length(x["gap"])
        end = a["at"] + extent(x)
        return F.struct(end.alias("at"), F.concat(a["spans"], F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"), x["before"].alias("before"), x["after"].alias("after")))).alias("spans"))

    def run(at, pairs):
        return F.aggregate(pairs, F.struct(at.alias("at"), F.array().cast(PLACED).alias("spans")), step, lambda a: a["spans"])

    def in_blocks(pairs):
        # an array that grows by one costs its length: in blocks, growing stays cheap in texts of very many matches
        blocks = F.transform(F.sequence(F.lit(1), F.size(pairs), F.lit(BLOCK)), lambda k: F.slice(pairs, k, BLOCK))
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))

        def after(a, block):
            return F.struct((a["at"] + F.aggregate(block, F.lit(0), lambda n, x: n + extent(x))).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all"))

        return let(blocks, lambda every: F.flatten(F.zip_with(F.aggregate(every, none, after, lambda a: a["all"]), every, run)))

    def place(parts):
        def part(k):
            return F.coalesce(F.get(parts, k), F.lit(""))

        def pair(k):
            before = F.substring(F.concat(*(F.substring(part(k - n), -context, context) for n in (3, 2, 1))), -context, context)
            after = F.substring(F.concat(*(F.substring(part(k + n), 1, context) for n in (1, 2, 3))), 1, context)
            return F.struct(part(k - 1).alias("gap"), part(k).alias("hit"), before.alias("before"), after.alias("after"))

        pairs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1, F.lit(2)), pair)
        placed = let(pairs, lambda every: F.when(F.size(every) > BLOCK, in_blocks(every)).otherwise(run(F.lit(0), every)))
        return F.when(F.size(parts) > 1, placed).otherwise(F.array().cast(PLACED))

    return let(parted(text, pattern), place)


def plain(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("hit")))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(card: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(card), ""), lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise(F.when(d.try_cast("int") > 4, d.try_cast("int") * 2 - 9).otherwise(d.try_cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def base_spans(text: Column, context: int = CONTEXT) -> Column:
    """struct of the four kinds' arrays of spans with the words around them; a
    cheap test guards each scan."""
    none, numeric = F.array().cast(SEEN), text.rlike("[0-9]")

    def count(x, low, high):
        return F.length(digits(x["hit"])).between(low, high)

    def found(when, pattern, test=None):
        spans = located(text, pattern, context)
        return F.when(when, F.transform(F.filter(spans, test) if test else spans, _seen)).otherwise(none).cast(SEEN)

    return F.struct(
        found(F.contains(text, F.lit("@")), EMAIL).alias("email"),
        found(numeric, IP, lambda x: x["hit"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")).alias("ip"),
        found(numeric, r"(?<![0-9])" + CARD, lambda x: F.when(count(x, 13, 19), luhn(digits(x["hit"]))).otherwise(F.lit(False))).alias("card"),
        found(F.contains(text, F.lit("+")), PHONE, lambda x: count(x, 9, 15)).alias("phone"),
    )


def _word(x: Column) -> Column:
    """A word of a context: what is an identifier itself counts by its shape."""
    bare = F.regexp_replace(F.lower(x), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return F.when(F.contains(x, F.lit("@")), F.lit("@")).otherwise(F.regexp_replace(bare, "[0-9]+", "0"))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES, -1), "")


def _seen(x: Column) -> Column:
    """A match with the two words ahead (nearest last) and the one behind; the
    rest of a token that it begins or ends in is no word."""
    ahead = _words(F.regexp_replace(x["before"], r"[^\x00-\x20\x7F]+\z", ""))
    behind = _words(F.regexp_replace(x["after"], r"^[^\x00-\x20\x7F]+", ""))
    return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("hit"), let(ahead, _last_two).alias("ahead"), F.coalesce(F.get(behind, F.lit(0)), F.lit("")).alias("behind"))


def _last_two(words: Column) -> Column:
    return F.slice(words, F.greatest(F.lit(1), F.size(words) - 1), 2)


def _may_identify(hit: Column) -> Column:
    return (F.length(digits(hit)) >= 4) | F.contains(hit, F.lit("@"))


def _runs(text: Column, context: int, longest: int) -> Column:
    """Runs of identifier-like tokens, with the words around them."""
    return F.when(text.rlike("[0-9@]"), F.transform(F.filter(located(text, runs_of(longest), context), lambda x: _may_identify(x["hit"])), _seen)).otherwise(F.array().cast(SEEN)).cast(SEEN)


def _free(run: Column, taken: Column, longest: int) -> Column:
    """What base spans leave of a run: pieces of neighbouring tokens, of ``longest``
    code points or one token, each with the words around it."""
    kind = "array<struct<start:int,end:int,i:int,j:int>>"

    def step(a, token):
        end = a["at"] + F.length(token)
        held = F.exists(taken, lambda t: (t["start"] < end) & (t["end"] > a["at"]))
        last = F.get(a["all"], F.size(a["all"]) - 1)
        more = (last["j"] == a["n"] - 1) & (end - last["start"] <= longest)
        begun = F.concat(a["all"], F.array(F.struct(a["at"].alias("start"), end.alias("end"), a["n"].alias("i"), a["n"].alias("j"))).cast(kind))
        longer = F.concat(F.slice(a["all"], 1, F.greatest(F.lit(0), F.size(a["all"]) - 1)), F.array(F.struct(last["start"].alias("start"), end.alias("end"), last["i"].alias("i"), a["n"].alias("j"))).cast(kind))
        every = F.when(held, a["all"]).when(F.coalesce(more, F.lit(False)), longer).otherwise(begun)
        return F.struct((end + 1).alias("at"), (a["n"] + 1).alias("n"), every.alias("all"))

    def pieces(tokens):
        def piece(p):
            ahead = F.concat(run["ahead"], F.slice(tokens, 1, p["i"]))
            behind = F.concat(F.slice(tokens, p["j"] + 2, 1), F.array(run["behind"]))
            hit = F.array_join(F.slice(tokens, p["i"] + 1, p["j"] - p["i"] + 1), " ")
            return F.struct(p["start"].alias("start"), p["end"].alias("end"), hit.alias("hit"), let(ahead, _last_two).alias("ahead"), F.get(behind, F.lit(0)).alias("behind"))

        start = F.struct(run["start"].alias("at"), F.lit(0).alias("n"), F.array().cast(kind).alias("all"))
        return F.transform(F.aggregate(tokens, start, step, lambda a: a["all"]), piece)

    return F.filter(let(F.split(run["hit"], " ", -1), pieces), lambda x: _may_identify(x["hit"]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", context: int = CONTEXT, longest: int = LONGEST) -> DataFrame:
    """(id, row, base, runs) of every row; ``row`` is the text's hash."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(known_id(id_col).alias("id"), F.xxhash64(text).alias("row"), base_spans(text, context).alias("base"), _runs(text, context, longest).alias("runs"))


def candidates(scanned: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(id, row, start, end, hit, before, after, seed): each base span (one that
    lies over a shorter one stands for it) and each free piece of a run, with
    the normalised words ahead and behind."""
    taken = F.flatten(F.array(*(F.col(f"base.{k}") for k in KINDS)))
    seeds = F.filter("taken", lambda x: ~F.exists("taken", lambda t: (t["start"] < x["end"]) & (t["end"] > x["start"]) & (t["end"] - t["start"] > x["end"] - x["start"])))

    def marked(spans, seed):
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("hit"), F.array_join(F.transform(x["ahead"], _word), " ").alias("before"), _word(x["behind"]).alias("after"), F.lit(seed).alias("seed")))

    rows = scanned.select("id", "row", taken.alias("taken"), "runs").where("size(taken) + size(runs) > 0")
    free = F.flatten(F.transform("runs", lambda run: _free(run, F.col("taken"), longest)))
    return rows.select("id", "row", F.explode(F.concat(marked(seeds, True), marked(free, False))).alias("c")).select("id", "row", "c.*")


def shape(hit: Column) -> Column:
    """Digits as 0, each; letters as a, a run of them; the rest (but punctuation at the ends) as it is."""
    bare = F.regexp_replace(hit, r"^[^\p{L}\p{N}+(]+|[^\p{L}\p{N})]+$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\p{L}+", "a"), "[0-9]", "0")


def patterns() -> Column:
    """The patterns of a candidate: the words before it, or around it; where the
    farther word is an identifier itself, also the nearest words around; and its
    shape with the nearest word before or behind."""
    near = F.substring_index("before", " ", -1)
    ahead, behind = F.length("before") > 0, F.length("after") > 0
    beyond = F.col("before").rlike(r"^\S*[0-9@]\S* [^0-9@]+$")
    every = (
        (F.contains("before", F.lit(" ")), (F.col("before"), F.lit(" _"))),
        (ahead & behind, (F.col("before"), F.lit(" _ "), F.col("after"))),
        (ahead & behind & beyond, (near, F.lit(" _ "), F.col("after"))),
        (ahead, (near, F.lit(" <"), F.col("shape"), F.lit(">"))),
        (behind, (F.lit("<"), F.col("shape"), F.lit("> "), F.col("after"))),
    )
    return F.filter(F.array(*(F.when(when, F.concat(*parts)) for when, parts in every)), lambda p: p.isNotNull())


def bootstrap(scanned: DataFrame, generations: int | None = None, min_seeds: int = 3, accept: float = 0.4, longest: int = LONGEST) -> DataFrame:
    """(id, row, found): the spans that learnt patterns add, off the base spans.

    Base spans are trusted.  In each generation a pattern is accepted if at least
    ``min_seeds`` different trusted instances stand in it and they are at least
    ``accept`` of all its instances and one more; an instance is trusted too once
    the noisy-or of its accepted patterns' shares reaches ``accept``.  Trust only
    grows, so it ends: when no instance is new, or after ``generations``.
    """
    each = candidates(scanned, longest).withColumns({"instance": F.xxhash64("hit"), "shape": shape(F.col("hit"))})
    spread = cut(each.select("id", "row", "start", "end", "hit", "seed", "instance", F.explode(F.transform(patterns(), lambda p: F.xxhash64(p))).alias("pattern")), "patterns")
    edges = cut(spread.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "graph")
    trusted = cut(edges.where("seed").select("instance").distinct(), "trusted")
    before, k = trusted.count(), 0
    while True:
        seen = edges.join(trusted.withColumn("known", F.lit(1)), "instance", "left")
        rated = seen.groupBy("pattern").agg(F.count("known").alias("known"), F.count("*").alias("n")).where(F.col("known") >= min_seeds)
        rated = cut(rated.select("pattern", (F.col("known") / (F.col("n") + 1)).alias("r")).where(F.col("r") >= accept), "rated")
        k += 1
        if k == generations:
            break
        believed = edges.join(rated, "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log1p(-F.col("r"))))).alias("s")).where(F.col("s") >= accept)
        trusted = cut(trusted.unionByName(believed.select("instance")).distinct(), "trusted")
        after = trusted.count()
        if after == before:
            break
        before = after
    found = spread.where(~F.col("seed")).join(rated, "pattern", "left_semi").select("id", "row", F.struct("start", "end", "hit").alias("x"))
    return found.groupBy("id", "row").agg(F.array_sort(F.collect_set("x")).alias("found"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generations: int | None = None, min_seeds: int = 3, accept: float = 0.4, context: int = CONTEXT, longest: int = LONGEST) -> DataFrame:
    """(id, base, found): the base spans of each row by kind and the spans that
    context adds (kind ``context``), in code points, end exclusive.

    The words of a context are looked for within ``context`` code points; tokens
    one space apart are one candidate up to ``longest`` code points, beyond them
    the next begins, and a longer token is one by itself.  ``generations``,
    ``min_seeds`` and ``accept`` are those of :func:`bootstrap`.

    Null texts are empty; null ids come back null; repeated rows give repeated
    rows (a repeated text under the same id has one vote); an empty table gives
    an empty one; other columns are not looked at; texts of any length are read whole.
    """
    scanned = cut(scan(docs, id_col, text_col, context, longest), "pii")
    added = bootstrap(scanned, generations, min_seeds, accept, longest)
    base = F.struct(*(plain(F.col(f"base.{k}")).alias(k) for k in KINDS))
    return scanned.join(added, ["id", "row"], "left").select(given_id("id").alias("id"), base.alias("base"), F.coalesce("found", F.array().cast(SPAN)).alias("found"))


def written(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat(F.lit(f"{kind}:"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string")))
