"""Evaluation datasets: cases of texts and what must be read from them.

A dataset is a YAML file with a list ``cases``; a case has a ``name``, ``inputs``
(``text``, ``is_done``, ``target``, ``parse_options``, ``coerce_options``), an
``expected_output`` and ``evaluators``, each a name or a name with its setting.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from mendframe.kernel import coerce as C
from mendframe.kernel.candidates import ParseOptions, candidates, completion
from mendframe.schema import ANY, BOOL, FLOAT, INT, STR, STRICT_BOOL, STRICT_FLOAT, STRICT_INT, Kind, dict_of, list_of

TARGETS = {"int": INT, "float": FLOAT, "str": STR, "bool": BOOL, "any": ANY, "StrictInt": STRICT_INT, "StrictFloat": STRICT_FLOAT, "StrictBool": STRICT_BOOL}
_MISSING = object()


def target(spec: str, named: dict[str, Kind] | None = None) -> Kind:
    """The type that 'list[int]', 'dict[str, StrictInt]' or a given name stands for."""
    spec = spec.strip()
    known = TARGETS | (named or {})
    if spec in known:
        return known[spec]
    if m := re.fullmatch(r"list\[(.+)\]", spec, re.S):
        return list_of(target(m[1], named))
    if m := re.fullmatch(r"dict\[\s*(\w+)\s*,(.+)\]", spec, re.S):
        return dict_of(target(m[2], named), target(m[1], named))
    raise KeyError(f"no such target: {spec!r}")


def same(found: Any, wanted: Any) -> bool:
    """Equal, but no number equals a boolean."""
    return isinstance(found, bool) == isinstance(wanted, bool) and found == wanted


def load(path: str) -> list[dict]:
    import yaml  # only datasets need it

    with open(path, encoding="utf-8") as f:
        data = yaml.safe_load(f)
    if not isinstance(data, dict) or not isinstance(data.get("cases"), list):
        raise ValueError(f"no list of cases: {path}")
    return data["cases"]


def _listed(x: Any) -> list:
    return [x] if isinstance(x, str) else list(x or ())


#: What each evaluator holds against its setting: (case's results, setting) -> satisfied.
EVALUATORS: dict[str, Callable[[dict, Any], bool]] = {
    "HasCandidates": lambda r, want: bool(r["candidates"]) == bool(want),
    "MatchesExpected": lambda r, want: not want or any(same(v, r["expected"]) for v in r["values"]),
    "CompletionIs": lambda r, want: r["completion"].upper() == str(want).upper(),
    "CandidateCountAtLeast": lambda r, want: len(r["candidates"]) >= int(want),
    "FlagsInclude": lambda r, want: set(_listed(want)) <= set(r["flags"]),
    "FlagsExclude": lambda r, want: not set(_listed(want)) & set(r["flags"]),
    "ScoreMax": lambda r, want: r["score"] <= int(want),
}


def check(case: dict, named: dict[str, Kind] | None = None) -> list[str]:
    """The evaluators that a case fails.  With a target, its one value is judged,
    without one, all candidates."""
    inputs = case.get("inputs") or {}
    text, is_done = inputs["text"], bool(inputs.get("is_done", True))
    options = ParseOptions(**(inputs.get("parse_options") or {}))
    result: dict[str, Any] = {"expected": case.get("expected_output", _MISSING), "flags": (), "score": 0}
    found = candidates(text, options, is_done)
    result |= {"candidates": found, "completion": completion(found), "values": [c.value for c in found]}
    if "target" in inputs:
        s = C.parse(text, target(inputs["target"], named), is_done, options, C.CoerceOptions(**(inputs.get("coerce_options") or {})))
        result |= {"values": [s.value], "flags": s.flags, "score": s.score}
    wrong = []
    for e in case.get("evaluators") or ():
        name, setting = next(iter(e.items())) if isinstance(e, dict) else (e, True)
        if name not in EVALUATORS:
            wrong.append(f"no such evaluator: {name}")
        elif not EVALUATORS[name](result, setting):
            wrong.append(name)
    return wrong
