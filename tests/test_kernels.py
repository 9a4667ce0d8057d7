"""The kernels on inputs of our own."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mendframe.kernel import coerce as C
from mendframe.kernel import patch as P
from mendframe.kernel import text as X
from mendframe.kernel.candidates import ParseOptions, candidates, regions
from mendframe.kernel.repair import COMPLETE, INCOMPLETE, repair
from mendframe.schema import ANY, BOOL, FLOAT, INT, STR, STRICT_INT, Field, Invalid, dict_of, enum, error_paths, from_pydantic, list_of, optional, struct, validate

TASK = struct(Field("title", STR), Field("level", enum("low", "mid", "high")), Field("days", INT), Field("done", BOOL, False))
WANT = {"title": "Fix it", "level": "mid", "days": 3, "done": False}


@pytest.mark.parametrize(
    ("text", "flags", "score"),
    [
        ('{"title": "Fix it", "level": "mid", "days": 3}', (), 0),
        ('{"title": "Fix it", "level": "mid", "days": 3,}', ("fixed_json",), 0),
        ("{title: Fix it, level: mid, days: 3}", ("fixed_json",), 0),
        ("{'title': 'Fix it', 'level': 'mid', 'days': 3}", ("fixed_json",), 0),
        ('{"title": "Fix it" "level": "mid" "days": 3}', ("fixed_json",), None),
        ('{"title": "Fix it", "level": "mid", "days": 3', ("fixed_json", "closed_unclosed"), 0),
        ('Well: {"title": "Fix it", "level": "mid", "days": 3} so', ("grepped_json",), 0),
        ('```json\n{"title": "Fix it", "level": "mid", "days": 3}\n```', ("markdown",), 0),
        ('~~~\n{"title": "Fix it", "level": "mid", "days": 3,}\n~~~', ("markdown", "fixed_json"), 0),
        ('{"TITLE": "Fix it", "level": "MID", "Days": "3"}', ("key_normalized", "key_normalized", "case_insensitive"), 9),
        ('{"title": "Fix it", "level": "mid", "days": 3, "x": 1, "Title": "no"}', ("extra_key", "key_collision"), None),
    ],
)
def test_repairs_cost_what_they_should(text, flags, score):
    try:
        got = C.parse(text, TASK)
    except ValueError:
        assert score is None  # quotes with no comma between belong to the string
        return
    assert got.value == WANT
    if score is not None:
        assert (got.flags, got.score) == (flags, score)


def test_readme_like_example_prefers_fewer_flags():
    text = 'Sure!\n```json\n{\n  "Title": "Fix it", // soon\n  "Level": "MID",\n  "days": 3,\n}\n```\n'
    got = C.parse(text, TASK)
    assert got.value == WANT and got.score == 9 and got.flags == ("fixed_json", "key_normalized", "key_normalized", "case_insensitive")


@pytest.mark.parametrize(
    ("text", "value", "state"),
    [
        ("[1, 2, 3", [1, 2, 3], INCOMPLETE),
        ("{a: 1/2 // half\n, b: 1_000}", {"a": "1/2", "b": 1000}, COMPLETE),
        ('{a: "say "hi" now", b: `x`}', {"a": 'say "hi" now', "b": "x"}, COMPLETE),
        ('{a: """\n  one\n  two\n""", b: null}', {"a": "one\ntwo", "b": None}, COMPLETE),
        ('{"a": "x\\ny\\q\\u0041"}', {"a": "x\ny\\q\\u0041"}, COMPLETE),
        ("{a: one, two and three, b: [x y, z]}", {"a": "one, two and three", "b": ["x", "y", "z"]}, COMPLETE),
        ("{path: /usr/bin, # c\n n: -1.5e3}", {"path": "/usr/bin", "n": -1500.0}, COMPLETE),
        ('{a: 1, a: 2, "dangling"', {"a": 2}, INCOMPLETE),
        ("[1 /* x */ true, b c]", [1, True, "b", "c"], COMPLETE),
    ],
)
def test_repair(text, value, state):
    assert repair(text) == [(value, state, ())]


def test_top_level_values():
    assert repair('"a" , "b"')[0][2] == ("inferred_array",)
    assert [v for v, _, _ in repair("x {a: 1} y [2]")] == [{"a": 1}, [2]]
    assert repair("   ") == []


def test_candidates_and_options():
    assert [c.fixes for c in candidates('a {"x": 1} b {"x": 2}')][:3] == [("grepped_json",), ("grepped_json",), ("grepped_array",)]
    assert candidates("5")[0].completion == INCOMPLETE and len(candidates('{"a": 1}')) == 1
    with pytest.raises(ValueError, match="reading"):
        candidates("   ", ParseOptions(allow_as_string=False))
    with pytest.raises(ValueError, match="depth"):
        candidates("x", ParseOptions(depth_limit=0))
    many = " ".join(f'{{"k": {k}}}' for k in range(200))
    assert len(candidates(many)) == 64
    assert regions('{"a": "}"} ] [1] {[}') == ['{"a": "}"}', "[1]"]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet='{}[]",:\'`/*# \n\\a1.-e', max_size=60))
def test_repair_never_fails(text):
    repair(text)
    candidates(text)


@settings(max_examples=100, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=8))
def test_strict_json_is_itself(value):
    assert C.parse(json.dumps(value), ANY).value == value


def test_long_texts_take_linear_time():
    rng = random.Random(1)
    body = ", ".join(f"key{k}: word{rng.randrange(9)} and more" for k in range(20_000))
    assert len(C.parse("{" + body + "}", dict_of(STR)).value) == 20_000
    assert C.parse("x " * 200_000 + '{"a": 1}', struct(Field("a", INT))).value == {"a": 1}


@pytest.mark.parametrize(
    ("text", "value"),
    [("1,234.5", 1234.5), ("$1,234", 1234), ("€ 5", 5), ("total - 5", 5), ("- 42", 42), ("-42 left", -42), ("50%", 50), ("3/4", 0.75), ("1/0", None), ("€1.234,56", None), ("3,14", 314), ("1 or 2", None), ("7,", 7), ("1e3", 1000), ("", None)],
)
def test_numbers(text, value):
    assert C.parse_float(text) == value


def test_ints_and_bools():
    assert C.parse_int("3.0000000001") == 3 and C.parse_int("1.4") is None and C.parse_int("$1,000") is None and C.parse_int("6/2") is None
    assert C.parse('"yes"', BOOL).flags == () and C.parse('" Yes "', BOOL).flags == ("string_to_bool",)
    assert C.parse('"42"', STRICT_INT) == C.Scored(42, ("string_to_int",), 1)


def test_enums():
    d = ("café", "naïve", "red", "Red-ish")
    assert C.match_enum("CAFÉ", d) == ("café", ("case_insensitive",))
    assert C.match_enum("cafe!", d) == ("café", ("accent_insensitive",))
    assert C.match_enum("redish", d) == ("Red-ish", ("strip_punct",))
    assert C.match_enum("bright red", d) is None
    assert C.match_enum("bright red", d, C.CoerceOptions(allow_substring_enum_match=True)) == ("red", ("substring_match",))
    assert C.match_enum("AB", ("ab", "Ab")) == ("Ab", ("case_insensitive", "ambiguous_enum"))


def test_keys():
    assert [C.normalize_key(k) for k in (" Hair-Color ", "Straße", "København", "Œuvre", "né_e")] == ["haircolor", "strasse", "kobenhavn", "oeuvre", "nee"]
    kind = struct(Field("a_b", INT, 0, ("alpha",)), Field("ab", INT, 0))
    assert C.map_keys({"A-B": 1, "alpha": 2, "zz": 3}, kind) == ({"a_b": 2}, ("ambiguous_key", "key_normalized", "extra_key"))


def test_structures():
    item = struct(Field("v", INT))
    assert C.parse('{"v": 1}', list_of(item)) == C.Scored([{"v": 1}], ("single_to_array",), 1)
    assert C.parse("7", item) == C.Scored({"v": 7}, ("implied_key",), 2)
    assert C.parse('{"V": "7 apples"}', item).value == {"v": 7}
    with pytest.raises(Invalid):
        C.parse('["a"]', list_of(STRICT_INT))
    assert C.parse('["1"]', list_of(STRICT_INT), coerce=C.CoerceOptions(deep_coercion=True)).value == [1]
    assert C.parse('{"title": "x", "days": "soon"', TASK.partial(), is_done=False, partial=True).value["title"] == "x"
    assert C.coerce_value({"Title": "x", "level": "LOW", "days": 1}, TASK).score == 6
    assert [r["score"] for r in C.trace('see {"v": 1}', item)] == [-1, 0, 0, -1]


def test_lax_and_strict_validation():
    for value, kind, want in ((" 42 ", INT, 42), ("1_000", INT, 1000), ("3.0", INT, 3), (True, INT, 1), ("on", BOOL, True), (1, FLOAT, 1.0)):
        assert validate(value, kind) == want
    for value, kind in ((1.5, INT), (1, STR), (None, STR), (2, BOOL), ("4", STRICT_INT), (10**30, INT)):
        with pytest.raises(Invalid):
            validate(value, kind)
    assert validate(None, optional(INT)) is None
    assert error_paths({"title": 1, "days": "x"}, TASK) == ["/title", "/level", "/days"]


def test_models_as_schemas():
    import enum as stdlib
    from typing import Literal

    import pydantic

    class Level(stdlib.Enum):
        LOW = "low"
        HIGH = "high"

    class Inner(pydantic.BaseModel):
        x: pydantic.StrictInt

    class Model(pydantic.BaseModel):
        name: str = pydantic.Field(alias="fullName")
        level: Level = Level.LOW
        kind: Literal["a", "b"] | None = None
        inner: list[Inner] = []

    kind = from_pydantic(Model)
    assert C.parse('{"fullName": "n", "level": "HIGH", "inner": {"x": "5"}}', kind).value == {"name": "n", "level": "high", "kind": None, "inner": [{"x": 5}]}


# --- patches


DOC = {"name": "n", "tags": ["a"], "bio": "x", "deep": {"y": 1}}


@pytest.mark.parametrize(
    ("op", "path", "value", "want"),
    [
        ("add", "/tags/-", "b", {**DOC, "tags": ["a", "b"]}),
        ("add", "/tags/0", "b", {**DOC, "tags": ["b", "a"]}),
        ("replace", "/tags/0", "b", {**DOC, "tags": ["b"]}),
        ("add", "/bio/-", "y", {**DOC, "bio": "xy"}),
        ("add", "/new/0/k", 1, {**DOC, "new": [{"k": 1}]}),
        ("replace", "/deep/y", 2, {**DOC, "deep": {"y": 2}}),
        ("remove", "/deep/y", None, {**DOC, "deep": {}}),
        ("add", "/a~1b~0c", 1, {**DOC, "a/b~c": 1}),
    ],
)
def test_patches(op, path, value, want):
    before = json.dumps(DOC)
    assert P.apply_patch(DOC, [P.Op(op, path, value)], P.Policy(allow_remove=True)) == want
    assert json.dumps(DOC) == before


@pytest.mark.parametrize("op", [P.Op("replace", "/no", 1), P.Op("add", "/tags/5", 1), P.Op("add", "", 1), P.Op("add", "x", 1), P.Op("remove", "/name"), P.Op("move", "/name"), P.Op("add", "/x" * 33, 1), P.Op("add", "/tags/-1", 1), P.Op("replace", "/name/z", 1)])
def test_patches_that_fail(op):
    with pytest.raises(P.PatchError):
        P.apply_patch(DOC, [op])


def test_patch_shapes_and_slices():
    one = [P.Op("add", "/a", 1)]
    for raw in ('[{"op": "add", "path": "/a", "value": 1}]', {"op": "add", "path": "/a", "value": 1}, '```\n{"patches": [{"op": "add", "path": "/a", "value": 1}]}\n```'):
        assert P.normalize_patches(raw) == one
    with pytest.raises(P.PatchError):
        P.normalize_patches("nothing here")
    assert P.slice_doc(DOC, ["/deep/y", "/tags/0", "/none"]) == {"deep": {"y": 1}, "tags": ["a"], "none": None}
    assert P.slice_doc(DOC, []) == DOC
    assert P.slice_schema(TASK.json_schema(), ["/title"])["required"] == ["title"]


# --- text


def test_chunks_cut_at_sentences_and_lines():
    text = "One two. Three four\nfive six seven. Eight"
    assert [c for c, _, _ in X.chunks(text, 20)] == ["One two.", "Three four", "five six seven.", "Eight"]
    assert X.chunks("abcdefgh ij", 3) == [("abcdefgh", 0, 8), ("ij", 9, 11)]
    assert X.chunks("", 5) == [("", 0, 0)]
    assert X.chunks("aa bb cc", 5, overlap=2)[1] == ("b cc", 4, 8)
    rng = random.Random(2)
    for _ in range(50):
        text = "".join(rng.choice("ab .\n!é") for _ in range(80))
        kept = X.chunks(text, 12)
        assert "".join(c for c, _, _ in kept).replace(" ", "").replace("\n", "") == text.replace(" ", "").replace("\n", "")
        assert all(text[a:b] == c for c, a, b in kept)


def test_alignment():
    text = "The Quick brown fox, it jumps."
    assert X.align(text, "brown fox") == ("exact", 10, 19)
    assert X.align(text, "the quick") == ("exact", 0, 9)
    assert X.align(text, "brown cat fox")[0] == "lesser"
    assert X.align(text, "quick brown cat", lesser=False, threshold=0.6)[0] == "fuzzy"
    assert X.align(text, "zebra") == ("unmatched", None, None) == X.align(text, "")
    found = X.tokens(text)
    assert X.token_span(found, 10, 19) == (2, 4) and X.token_span(found, None, None) == (None, None)
    assert X.leaves({"a": [1, None, True], "b/c": "x"}) == [("/a/0", "1"), ("/a/2", "True"), ("/b~1c", "x")] and X.leaves(5) == [("/", "5")]


def test_merging():
    assert X.merge({"a": 1, "l": [1, 1]}, {"a": 2, "l": [1, 2], "b": 3}, "first_wins") == {"a": 1, "l": [1, 1, 2], "b": 3}
    assert X.merge("", "x") == "x" and X.merge("a", "b", "last_wins") == "b" and X.merge(None, 0) == 0
    span = lambda a, b: {"start": a, "end": b}
    assert X.merge_spans([span(0, 5)], [span(3, 6), span(5, 7), span(6, 9), span(None, None)]) == [span(0, 5), span(5, 7), span(None, None)]


def test_best_window_is_that_of_comparing_all():
    import random
    from difflib import SequenceMatcher

    rng = random.Random(11)
    for _ in range(500):
        source, target = (rng.choices("abcdef", k=rng.randrange(1, n)) for n in (25, 7))
        n, threshold = len(target), rng.choice([0.3, 0.5, 0.75])
        rated = [(sum(b.size for b in SequenceMatcher(None, source[k : k + n], target, autojunk=False).get_matching_blocks()) / n, -k) for k in range(len(source) - n + 1)]
        want = -max(rated)[1] if rated and max(rated)[0] >= threshold else None
        assert X.most_alike(source, target, threshold) == want


def test_columns_of_tokens_are_the_tokens():
    import random

    single = [chr(k) for k in range(0x110000) if X.SINGLE.fullmatch(chr(k))]
    assert {c for c in single if c.isspace()} == set(map(chr, X.SINGLE_SPACES.tolist()))
    rng = random.Random(3)
    joining = ["e\u0301", "\u200d", "\U0001f468\u200d\U0001f469", "\U0001f1e9\U0001f1ea", "\uac00\u11a8", "\u0600", "\r\n", "\ufe0f"]
    texts = ["", " ", "\r\n\r", *("".join(rng.choices([*"ab \n\r\u00a9\u00ad\u3030", rng.choice(single)], k=40)) for _ in range(300))]
    texts += ["".join(rng.sample(single, 3000)), *("".join(rng.choices([*joining, *"a \n"], k=30)) for _ in range(100))]
    for text in texts:
        for unicode in (True, False):
            joined, sizes, starts, ends, lines = X.token_columns(text, unicode)
            stops = sizes.cumsum().tolist()
            kept = [joined[b - n : b].decode() for b, n in zip(stops, sizes.tolist(), strict=True)]
            assert list(zip(kept, starts.tolist(), ends.tolist(), lines.tolist(), strict=True)) == X.tokens(text, unicode)


def test_values_that_stand_in_a_text_again_are_read_as_if_alone():
    import random

    from mendframe.kernel.repair import Repair

    class Plain(Repair):  # remembers nothing
        last = property(lambda self: "", lambda self, value: None)

    rng = random.Random(8)
    pieces = ["{a: 1} ", "{a: 1", "}", "[x, y]", "{'a': \"b\"}", '{"a": "b" ', "{a: b c, d: e}", "{a: b / c}", "{a: b // c\n}", "{a: # x\n1}", '{"a": "b"c"}', "[[1], {k: ```x\ny```}]", '{a: """t"""}', ",", ":", " ", '"', "'", "//", "\n", "[1, 2", "]", "{a: 1, b}"]
    hits = 0
    for _ in range(3000):
        some = rng.choices(pieces, k=rng.randrange(1, 4))
        text = "".join(rng.choice(some) for _ in range(rng.randrange(2, 12)))
        remembering = Repair(text)
        assert remembering.run() == Plain(text).run()
        hits += len({id(v) for v, _ in remembering.found if isinstance(v, dict)}) < sum(isinstance(v, dict) for v, _ in remembering.found)
    assert hits > 100


def test_equal_readings_of_a_text_are_made_once(monkeypatch):
    made = []
    plain = C.attempt
    monkeypatch.setattr(C, "attempt", lambda c, *rest: made.append(c) or plain(c, *rest))
    found = C.trace("k1 " + "{a: 1} " * 70, list_of(ANY))
    assert len(found) == 65 and len(made) == 1 and [r["idx"] for r in found] == list(range(-1, 64))
    assert {r["result_json"] for r in found[1:]} == {'[{"a": 1}]'} and {tuple(r["flags"]) for r in found[1:]} == {("fixed_json", "single_to_array")}
    several = C.trace("x {a: 1} {a: 1} {b: 2} {a: 1}", list_of(ANY))
    assert [r["value_json"] for r in several[1:5]] == ['{"a": 1}', '{"a": 1}', '{"b": 2}', '{"a": 1}'] and len(made) == 6
    import pyarrow as pa

    from mendframe.functions import columns

    strings = pa.list_(pa.string())
    kind = pa.list_(pa.struct([("idx", pa.int32()), *((k, pa.string()) for k in ("value_json", "completion")), ("fixes", strings), ("result_json", pa.string()), ("flags", strings), ("score", pa.int32()), ("error", pa.string())]))
    texts = ["x {a: 1} {a: 1} {b: 2} {a: 1}", None, "[1]", "", "{a: 1} " * 80]
    assert columns._trace_array(pa.array(texts), lambda x: C.traced(x, list_of(ANY)), kind).to_pylist() == [None if x is None else C.trace(x, list_of(ANY)) for x in texts]
    only = ParseOptions(allow_as_string=False)
    assert columns._trace_array(pa.array(["", "{}"]), lambda x: C.traced(x, list_of(ANY), only), kind).to_pylist() == [[], C.trace("{}", list_of(ANY))]


def test_regions_that_stand_in_a_text_again():
    import re

    def plain(text):
        found, stack, begin, inside = [], [], 0, False
        for m in re.finditer(r'\\.|["{}\[\]]', text, re.S):
            c = m[0]
            if c == '"':
                inside = not inside
            elif len(c) == 1 and not inside and c in "{[":
                begin = begin if stack else m.start()
                stack.append(c)
            elif len(c) == 1 and not inside and stack:
                if stack.pop() + c not in ("{}", "[]"):
                    stack = []
                elif not stack:
                    found.append(text[begin : m.end()])
        return found

    rng = random.Random(9)
    for _ in range(3000):
        some = rng.choices(["{}", "[1]", '{"a": 1}', "{", "]", '"', "\\", " ", "x", "[{}]", '{"\\""}'], k=3)
        text = "".join(rng.choice(some) for _ in range(rng.randrange(1, 12)))
        assert regions(text) == plain(text)
    assert regions("{a: 1} " * 70) == ["{a: 1}"] * 70
