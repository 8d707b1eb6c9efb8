"""A lexer for brace languages: tokens with places, and pairs of brackets."""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

OPENING = {"(": ")", "[": "]", "{": "}"}


class Token(NamedTuple):
    kind: str  # id, text, number, op
    text: str
    start: int
    end: int


_JAVA = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))
      |(?P<text>\"{3}.*?(?:\"{3}|\Z)|"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?)
      |(?P<id>[^\W\d][\w$]*|\$[\w$]*)
      |(?P<number>\d[\w.]*)
      |(?P<op>->|::|\.\.\.|.)""",
    re.S | re.X,
)
_RUST = re.compile(
    r"""(?P<skip>\s+|//[^\n]*)
      |(?P<text>b?r(?P<hash>\#*)".*?(?:"(?P=hash)|\Z)|[bc]?"(?:[^"\\]|\\.)*"?|b?'(?:[^'\\\n]|\\(?:u\{[^}]*\}|x..|.))')
      |(?P<life>'[^\W\d]\w*)
      |(?P<id>r\#[^\W\d]\w*|[^\W\d]\w*)
      |(?P<number>\d(?:\w|\.(?=\d))*)
      |(?P<op>->|=>|::|\.\.=?|.)""",
    re.S | re.X,
)


class Source:
    """Tokens of a text; ``pair`` maps each matched bracket's index to its partner's."""

    def __init__(self, text: str, language: str):
        self.text = text
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.tokens = list(_rust(text) if language == "rust" else _java(text))
        self.pair: dict[int, int] = {}
        waiting: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.kind != "op":
                continue
            if t.text in OPENING:
                waiting.append(i)
            elif t.text in ")]}":
                # an unmatched opening bracket in between is given up, as error recovery would
                for k in range(len(waiting) - 1, -1, -1):
                    if OPENING[self.tokens[waiting[k]].text] == t.text:
                        self.pair[waiting[k]], self.pair[i] = i, waiting[k]
                        del waiting[k:]
                        break

    def line(self, at: int) -> int:
        """The line of a character, from 1."""
        return bisect_right(self.breaks, at - 1) + 1

    def is_op(self, i: int, text: str) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "op" and self.tokens[i].text == text

    def is_id(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "id"

    def word(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def slice(self, first: int, last: int) -> str:
        """The text from a token's start to another's end."""
        return self.text[self.tokens[first].start : self.tokens[last].end]

    def angle_back(self, i: int) -> int:
        """The index of the ``<`` that the ``>`` at ``i`` closes, or -1."""
        depth = 0
        for k in range(i, -1, -1):
            t = self.tokens[k]
            if t.kind == "op" and t.text == ">":
                depth += 1
            elif t.kind == "op" and t.text == "<":
                depth -= 1
                if depth == 0:
                    return k
            elif t.kind == "op" and t.text in ";{}":
                return -1
        return -1

    def angle_on(self, i: int) -> int:
        """The index of the ``>`` that closes the ``<`` at ``i``, or -1."""
        depth = 0
        for k in range(i, len(self.tokens)):
            t = self.tokens[k]
            if t.kind == "op" and t.text == "<":
                depth += 1
            elif t.kind == "op" and t.text == ">":
                depth -= 1
                if depth == 0:
                    return k
            elif t.kind == "op" and t.text in ";{}()=":
                return -1
        return -1


def _java(text: str):
    for m in _JAVA.finditer(text):
        if m.lastgroup != "skip":
            yield Token(m.lastgroup, m.group(), m.start(), m.end())


def _rust(text: str):
    at = 0
    while at < len(text):
        if text.startswith("/*", at):  # these comments nest
            depth, at = 1, at + 2
            while at < len(text) and depth:
                m = re.compile(r"/\*|\*/").search(text, at)
                if not m:
                    return
                depth += 1 if m.group() == "/*" else -1
                at = m.end()
            continue
        m = _RUST.match(text, at)
        kind = m.lastgroup
        if m.group("text") is not None:
            kind = "text"
        if kind not in ("skip", "life"):
            yield Token(kind, m.group(), m.start(), m.end())
        at = m.end()
