"""All the values that a text may stand for, in the order they are tried:
strict JSON, fenced blocks, balanced regions, repair, closing, the text itself."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import Any

from mendframe.kernel.repair import COMPLETE, INCOMPLETE, repair

#: An escape, a quote or a bracket.
MARK = re.compile(r'\\.|["{}\[\]]', re.S)
#: An opening fence with its tag, and a closing one, alone on its line.
FENCE = re.compile(r"^[ \t]*(?:```|~~~)([a-zA-Z0-9/_ .\-]*)(?:\n|$)", re.M)
FENCE_END = re.compile(r"^[ \t]*(?:```|~~~)(?:\n|$)", re.M)


@dataclass(frozen=True)
class ParseOptions:
    allow_markdown_json: bool = True
    allow_find_all_json_objects: bool = True
    allow_fixes: bool = True
    allow_as_string: bool = True
    depth_limit: int = 100
    max_candidates: int = 64


@dataclass(frozen=True)
class Candidate:
    value: Any
    completion: str = COMPLETE
    fixes: tuple[str, ...] = ()


def strict(text: str) -> tuple[bool, Any]:
    try:
        return True, json.loads(text)
    except (ValueError, RecursionError):
        return False, None


def blocks(text: str) -> tuple[list[str], str]:
    """The insides of fenced blocks, and the text behind the last one."""
    found, at = [], 0
    while m := FENCE.search(text, at):
        end = FENCE_END.search(text, m.end())
        found.append(text[m.end() : end.start() if end else len(text)].strip())
        at = end.end() if end else len(text)
        if not end:
            break
    return found, text[at:] if found else ""


def regions(text: str) -> list[str]:
    """Balanced {...} and [...] stretches; double quotes hide brackets, and a
    closer of the wrong kind starts over."""
    found, stack, begin, inside, at = [], [], 0, False, 0
    while m := MARK.search(text, at):
        c, i, at = m[0], m.start(), m.end()
        if len(c) > 1:
            continue
        if c == '"':
            inside = not inside
        elif inside:
            continue
        elif c in "{[":
            if not stack:
                if found and text.startswith(found[-1], i):  # the last one again
                    found.append(found[-1])
                    at = i + len(found[-1])
                    continue
                begin = i
            stack.append(c)
        elif stack:
            if stack.pop() + c not in ("{}", "[]"):
                stack = []
            elif not stack:
                found.append(text[begin : i + 1])
    return found


def closed(text: str) -> tuple[bool, Any]:
    """The text with its open string and brackets closed, as strict JSON; a text
    without an open bracket is not read.  Closers that fit no open bracket are passed over."""
    stack, inside, i = [], False, 0
    for m in re.finditer(r'["{}\[\]]', text):
        if m.start() < i:
            continue
        if m[0] == '"' and inside:
            k = m.start()
            while k > i and text[k - 1] == "\\":
                k -= 1
            inside = (m.start() - k) % 2 == 1  # escaped
        elif m[0] == '"':
            inside, i = True, m.end()
        elif not inside and m[0] in "{[":
            stack.append("}" if m[0] == "{" else "]")
        elif not inside and stack and stack[-1] == m[0]:
            stack.pop()
    return strict(text + '"' * inside + "".join(reversed(stack))) if stack else (False, None)


def few(text: str) -> bool:
    """So few brackets and fences that the number of readings can't reach a cap."""
    return text.count("{") + text.count("[") + 2 * text.count("```") + 2 * text.count("~~~") <= 12


def readings(text: str, options: ParseOptions, is_done: bool = True, depth: int = 0) -> Iterator[Candidate]:
    """Every reading of ``text``, made only when asked for."""
    if options.depth_limit <= 0:
        raise ValueError("depth_limit must be positive")
    if depth >= options.depth_limit:
        raise RecursionError("nested too deep")
    ok, value = strict(text)
    if ok:
        yield Candidate(value, INCOMPLETE if isinstance(value, (int, float)) else COMPLETE)
        return
    some = False
    if options.allow_markdown_json and ("```" in text or "~~~" in text):
        inner = ParseOptions(allow_markdown_json=False, allow_find_all_json_objects=False, depth_limit=options.depth_limit)
        found, tail = blocks(text)
        fenced = []
        for b in found if depth + 1 < options.depth_limit else ():
            for c in candidates(b, inner, False, depth + 1):
                fenced.append(replace(c, fixes=("markdown", *c.fixes)))
                yield fenced[-1]
        some = bool(fenced)
        if len(fenced) > 1:
            yield Candidate([c.value for c in fenced], INCOMPLETE, ("markdown_array",))
        if fenced and tail.strip():
            yield Candidate(tail, INCOMPLETE, ("markdown_tail",))
    if options.allow_find_all_json_objects:
        found = regions(text)
        read = {r: strict(r) for r in set(found)}  # each once, however often it stands there
        whole = [read[r][1] for r in found if read[r][0]]
        some = some or bool(whole)
        yield from (Candidate(v, COMPLETE, ("grepped_json",)) for v in whole)
        if len(whole) > 1:
            yield Candidate(whole, INCOMPLETE, ("grepped_array",))
    if options.allow_fixes:
        mended, last = [], None
        for v, s, f in repair(text):
            if last is None or v is not last.value or s != last.completion:  # the same value again is the same reading
                last = Candidate(v, s, ("fixed_json", *f, *(("closed_unclosed",) if s == INCOMPLETE else ())))
            mended.append(last)
        some = some or bool(mended)
        yield from mended
        if len(mended) > 1:
            yield Candidate([c.value for c in mended], INCOMPLETE, ("fixed_array",))
    if not some and options.allow_fixes:
        ok, value = closed(text)
        if ok:
            some = True
            yield Candidate(value, INCOMPLETE, ("closed_unclosed",))
    if options.allow_as_string:
        yield Candidate(text, COMPLETE if is_done else INCOMPLETE, ("as_string",) if some else ())


def candidates(text: str, options: ParseOptions = ParseOptions(), is_done: bool = True, depth: int = 0) -> list[Candidate]:
    """The readings in order, at most ``max_candidates`` of them (complete ones,
    objects, few fixes first).  Raises ValueError if there is none."""
    out = list(readings(text, options, is_done, depth))
    if not out:
        raise ValueError("no reading of the text")
    if len(out) > options.max_candidates:
        ranks: dict[tuple, tuple] = {}  # each value is written once, however often it was read

        def rank(k):
            c = out[k]
            key = (id(c.value), c.completion, len(c.fixes))
            if (known := ranks.get(key)) is None:
                kind = 0 if isinstance(c.value, dict) else 1 if isinstance(c.value, list) else 2
                known = ranks[key] = (c.completion != COMPLETE, kind, len(c.fixes), -len(json.dumps(c.value, default=str)))
            return known  # sorting keeps the order of equal ones

        out = [out[k] for k in sorted(sorted(range(len(out)), key=rank)[: options.max_candidates])]
    return out


def completion(found: list[Candidate]) -> str:
    """That of the whole reading: incomplete if any candidate is."""
    return INCOMPLETE if any(c.completion == INCOMPLETE for c in found) else COMPLETE
