"""Repair of JSON-like text: an index-based automaton with an explicit stack.

Reads objects, arrays, quoted and unquoted scalars, comments and fences of a
text that is nearly JSON, never fails on content, and says for each value
whether its end was seen.  Look-aheads work on indices, so time is linear but
for the bounded scans that decide whether a comma belongs to a value.
"""

from __future__ import annotations

import re
import textwrap
from dataclasses import dataclass, field
from typing import Any

COMPLETE, INCOMPLETE = "complete", "incomplete"
#: The escapes that a double-quoted string knows.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "\\": "\\", '"': '"'}
#: What may follow a closing quote, by where the string stands.
AFTER_QUOTE = {"key": ":}", "value": ",}]", "item": ",}]", "top": ",}]:"}
SOLID, DELIMITER = re.compile(r"\S"), re.compile(r"[,}\]:]")
NUMBER = re.compile(r"[-+]?(\d[\d_,]*\.?\d*|\.\d+)([eE][-+]?\d+)?$")
OPENERS = re.compile(r"[{\[]")
KEY_END = re.compile(r"[:}]")


@dataclass
class Frame:
    """An open container: ``items`` of an array, or keys and values in turn."""

    is_object: bool
    items: list[Any] = field(default_factory=list)

    def where(self) -> str:
        return "item" if not self.is_object else "value" if len(self.items) % 2 else "key"

    def build(self) -> Any:
        if not self.is_object:
            return self.items
        return {key_text(k): v for k, v in zip(self.items[::2], self.items[1::2], strict=False)}  # a dangling key goes


def key_text(key: Any) -> str:
    if isinstance(key, str):
        return key
    return {True: "true", False: "false", None: "null"}[key] if key is None or isinstance(key, bool) else str(key)


def literal(token: str) -> Any:
    """true, false and null in any case, then int, then float, else the text."""
    known = {"true": True, "false": False, "null": None}
    if (low := token.lower()) in known:
        return known[low]
    for kind in (int, float):
        try:
            return kind(token)
        except ValueError:
            pass
    return token


class Repair:
    def __init__(self, text: str):
        self.text, self.at, self.stack = text, 0, []
        self.found: list[tuple[Any, str]] = []
        #: How far the text was looked at; beyond its end, if the end itself told.
        self.reach = 0
        #: Where the open top-level container begins; the text and the value of the
        #: last one that was read without a look behind its end.
        self.begin, self.last, self.known = 0, "", None

    def seen(self, m: re.Match | None) -> re.Match | None:
        self.reach = max(self.reach, m.end() if m else len(self.text) + 1)
        return m

    def solid(self, at: int) -> int:
        m = SOLID.search(self.text, at)
        if m is None:
            self.reach = len(self.text) + 1
            return len(self.text)
        if m.end() > self.reach:
            self.reach = m.end()
        return m.start()

    def put(self, value: Any, state: str) -> None:
        if self.stack:
            self.stack[-1].items.append(value)
        else:
            self.found.append((value, state))

    def run(self) -> list[tuple[Any, str]]:
        """(value, completion) of each top-level value."""
        text, n = self.text, len(self.text)
        while (at := self.solid(self.at)) < n:
            c, top = text[at], self.stack[-1] if self.stack else None
            self.at = at + 1
            if top and c == ("}" if top.is_object else "]"):
                self.put_closed(COMPLETE)
            elif top and (c == "," or (c == ":" and top.is_object)):
                pass
            elif c in "{[":
                if not top:
                    if self.last and text.startswith(self.last, at):  # read before: the same value
                        while text.startswith(self.last, at):
                            self.found.append((self.known, COMPLETE))
                            self.at = at + len(self.last)
                            at = m.start() if (m := SOLID.search(text, self.at)) else n
                        continue
                    self.begin, self.reach = at, self.at
                self.stack.append(Frame(c == "{"))
            elif c == "#" or (c == "/" and text.startswith(("//", "/*"), at)):
                self.comment(at)
            elif c in "\"'`":
                self.reach = max(self.reach, at + 3)
                self.quoted(at)
            else:
                self.unquoted(at)
        while self.stack:
            self.put_closed(INCOMPLETE)
        return self.found

    def put_closed(self, state: str) -> None:
        self.put(value := self.stack.pop().build(), state)
        if not self.stack and state == COMPLETE and self.reach <= self.at:
            self.last, self.known = self.text[self.begin : self.at], value

    def comment(self, at: int) -> None:
        mark, skip = ("*/", 2) if self.text.startswith("/*", at) else ("\n", 1)
        end = self.text.find(mark, at + 1 + (skip == 2))
        self.at = len(self.text) if end < 0 else end + skip
        self.reach = max(self.reach, self.at + (end < 0))

    def where(self) -> str:
        return self.stack[-1].where() if self.stack else "top"

    def comment_at(self, at: int) -> bool:
        self.reach = max(self.reach, at + 2)
        return self.text.startswith(("//", "/*", "#"), at)

    def quoted(self, at: int) -> None:
        text, q = self.text, self.text[at]
        if text.startswith(('"""', "```"), at):
            mark = text[at : at + 3]
            end = text.find(mark, at + 3)
            while mark == "```" and end >= 0 and re.match(r"[\w-]", text[end + 3 : end + 4]):
                end = text.find(mark, end + 3)
            body = text[at + 3 : end if end >= 0 else len(text)]
            if mark == "```":
                body = body.partition("\n")[2] if "\n" in body else body  # the info line
            self.at = end + 3 if end >= 0 else len(text)
            self.reach = max(self.reach, end + 4 if end >= 0 else len(text) + 1)
            self.put(textwrap.dedent(body).strip("\n"), COMPLETE if end >= 0 else INCOMPLETE)
            return
        out, i, after = [], at + 1, AFTER_QUOTE[self.where()]
        stop = re.compile(r'[\\"]' if q == '"' else re.escape(q))
        while m := stop.search(text, i):
            k = m.start()
            out.append(text[i:k])
            if text[k] == "\\" and q == '"':
                nxt = text[k + 1 : k + 2]
                out.append(ESCAPES.get(nxt, "\\" + nxt))
                i = k + 2
                continue
            nxt = self.solid(k + 1)
            if nxt == len(text) or text[nxt] in after or self.comment_at(nxt):
                self.at = k + 1
                self.put("".join(out), COMPLETE)
                return
            out.append(q)  # an inner quote that nobody escaped
            i = k + 1
        self.at, self.reach = len(text), len(text) + 1
        self.put("".join([*out, text[i:]]), INCOMPLETE)

    def key_follows(self, at: int) -> bool:
        """A colon comes before the next comma or closer."""
        m = self.seen(DELIMITER.search(self.text, at))
        return bool(m) and m[0] == ":"

    def unquoted(self, at: int) -> None:
        text, where = self.text, self.where()
        if where == "top":
            m = self.seen(OPENERS.search(text, at + 1))
            end, closed = (m.start(), True) if m else (len(text), False)
        elif where == "key":
            m = self.seen(KEY_END.search(text, at))
            end, closed = (m.start(), True) if m and m.start() > at else (at + 1, True) if m else (len(text), False)
        else:
            end, closed = self.value_end(at, where)
        token = text[at:end].strip()
        self.at = max(end, at + 1)
        if token:
            self.put(literal(token) if where != "key" else token, COMPLETE if closed else INCOMPLETE)

    def value_end(self, at: int, where: str) -> tuple[int, bool]:
        """Where the unquoted value that begins at ``at`` ends, and whether it was seen to."""
        text, n = self.text, len(self.text)
        j = at
        while (k := self.solid(j + 1)) < n:
            c, gap = text[k], k > j + 1
            if c == ("}" if where == "value" else "]"):
                return j + 1, True
            if c == "," and where == "item":
                return j + 1, True
            if c == ",":
                after = self.solid(k + 1)
                if after == n or text[after] in "}\"'" or self.key_follows(k + 1):
                    return j + 1, True
            elif c in "/\"'{[#" or (gap and (c.isalpha() or c == "_")):
                token = text[at : j + 1].strip()
                number = bool(NUMBER.match(token))
                atomic = number or token.lower() in ("true", "false", "null") or not re.search(r"[\s(]", token)
                if atomic:
                    if self.comment_at(k):
                        return j + 1, True
                    if c in "\"'{[#" or (gap and where == "item"):
                        return j + 1, True
                    if gap and c != "/" and self.key_follows(k):
                        return j + 1, True
            j = k
        return n, False


def repair(text: str) -> list[tuple[Any, str, tuple[str, ...]]]:
    """(value, completion, fixes) candidates of a text; none if nothing is found.

    One value is itself; several strings are one list; otherwise the objects and
    arrays remain.
    """
    found = Repair(text).run()
    if len(found) <= 1:
        return [(v, s, ()) for v, s in found]
    if all(isinstance(v, str) for v, _ in found):
        return [([v for v, _ in found], INCOMPLETE, ("inferred_array",))]
    return [(v, s, ()) for v, s in found if isinstance(v, (dict, list))]
