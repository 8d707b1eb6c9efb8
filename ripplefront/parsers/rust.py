"""Rust sources: functions, calls, routes and operations.

A function's name is its inline modules' path and its own name; neither the file nor the
``impl`` type is part of it, so equal names collide, as they are meant to. Calls keep the
called expression's text; what stands in a macro's arguments isn't read.
"""

from __future__ import annotations

import re

from . import patterns as p
from .lexing import Source

KEYWORDS = set(
    "as async await break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref "
    "return static struct trait type unsafe use where while yield".split()
)
#: Bytes before a function that are searched for its route.
ROUTE_REACH = 500


class Rust:
    def __init__(self, text: str):
        self.src = Source(text, "rust")
        self.macros = self._macros()

    def _macros(self) -> list[tuple[int, int, int]]:
        """(name, first, last) of each macro call: its arguments are tokens, not expressions."""
        s, out, until = self.src, [], -1
        for i in range(len(s.tokens) - 2):
            if i > until and s.is_id(i) and s.word(i) not in KEYWORDS and s.is_op(i + 1, "!") and s.word(i + 2) in ("(", "[", "{"):
                if i + 2 in s.pair and not s.is_op(i - 1, "#"):
                    until = s.pair[i + 2]
                    out.append((i, i + 2, until))
        return out

    def functions(self):
        """(module path, name, first, body, last) of every function with a body."""
        s = self.src
        mods = [(i, s.pair[i + 2]) for i in range(len(s.tokens) - 2) if s.word(i) == "mod" and s.is_id(i + 1) and s.is_op(i + 2, "{") and i + 2 in s.pair]
        inside = {k for _, a, b in self.macros for k in range(a, b + 1)}
        for i, t in enumerate(s.tokens):
            if t.kind != "id" or t.text != "fn" or not s.is_id(i + 1) or i in inside:
                continue
            k = i + 2
            while k < len(s.tokens) and not s.is_op(k, "{") and not s.is_op(k, ";"):
                k = s.pair.get(k, k) + 1 if s.word(k) in ("(", "[") else k + 1
            if not s.is_op(k, "{") or k not in s.pair:
                continue
            path = [s.word(m + 1) for m, end in mods if m < i < end]
            yield path, s.word(i + 1), self._first(i), k, s.pair[k]

    def _first(self, i: int) -> int:
        """The start of a function item: its visibility and qualifiers, not its attributes."""
        s = self.src
        while i > 0:
            if s.word(i - 1) in ("async", "const", "unsafe", "pub", "default", "extern"):
                i -= 1
            elif s.tokens[i - 1].kind == "text" and s.word(i - 2) == "extern":
                i -= 2
            elif s.is_op(i - 1, ")") and i - 1 in s.pair and s.word(s.pair[i - 1] - 1) == "pub":
                i = s.pair[i - 1] - 1
            else:
                break
        return i

    def calls(self, body: int, last: int) -> list[dict]:
        s, out = self.src, []
        skip = [(a, b) for _, a, b in self.macros if body < a < last]
        names = {n: None for n, a, _ in self.macros if body < a < last}
        patterns = self._patterns(body, last)
        hidden = {k for a, b in skip for k in range(a, b + 1)} | patterns
        for i in range(body, last):
            if i in names and i not in hidden and not s.is_op(i - 1, "::"):
                out.append({"target": f"{s.word(i)}!", "line": s.line(s.tokens[i].start)})
            elif s.is_op(i, "(") and i not in hidden and self._called(i):
                start = self._chain_start(i - 1)
                out.append({"target": s.slice(start, i - 1), "line": s.line(s.tokens[start].start)})
        return out

    def _patterns(self, body: int, last: int) -> set[int]:
        """Tokens of let patterns, and of match arms before their arrow."""
        s, out = self.src, set()
        for i in range(body, last):
            if s.is_id(i) and s.word(i) in ("let", "for"):
                stop = "=" if s.word(i) == "let" else "in"
                k = i + 1
                while k < last and s.word(k) not in (stop, ";", "{", "}"):
                    k += 1
                out |= set(range(i, k))
            elif s.is_op(i, "=>"):
                k = i - 1
                depth = 0
                while k > body:
                    if s.word(k) in (")", "]", "}") and k in s.pair and s.word(k) != "}":
                        k = s.pair[k]
                    elif s.word(k) in ("{", ",", "}") and depth == 0:
                        break
                    k -= 1
                guard = next((g for g in range(k, i) if s.word(g) == "if" and s.is_id(g)), i)
                out |= set(range(k, guard))
        return out

    def _called(self, i: int) -> bool:
        s, k = self.src, i - 1
        if s.is_id(k):
            return s.word(k) not in KEYWORDS - {"crate"} and s.word(k - 1) != "fn" and not s.is_op(k - 1, "#")
        if s.is_op(k, ">"):
            a = s.angle_back(k)
            return a > 0 and s.is_op(a - 1, "::")
        return (s.word(k) in (")", "]") and k in s.pair and self._is_value(k)) or s.is_op(k, "?")

    def _is_value(self, k: int) -> bool:
        """Whether a bracketed group before an argument list is itself called or indexed."""
        a = self.src.pair[k] - 1
        return (self.src.is_id(a) and self.src.word(a) not in KEYWORDS) or self.src.word(a) in (")", "]", "?", "=", "(", ",", "{", ";", "&")

    def _chain_start(self, k: int) -> int:
        s = self.src
        while True:
            if s.word(k) in (")", "]") and k in s.pair:
                a = s.pair[k]
                if s.is_op(a - 1, ">") and s.angle_back(a - 1) > 0 and s.is_op(s.angle_back(a - 1) - 1, "::"):
                    k = a - 1
                    continue
                if (s.is_id(a - 1) and s.word(a - 1) not in KEYWORDS) or s.word(a - 1) in (")", "]", "?"):
                    k = a - 1
                    continue
                if s.is_op(a - 1, "!") and s.is_id(a - 2):
                    a -= 2
                k = a
            elif s.is_op(k, "?"):
                k -= 1
                continue
            elif s.is_op(k, ">") and s.angle_back(k) > 0:
                k = s.angle_back(k)
                if s.is_op(k - 1, "::"):
                    k -= 2
                    continue
            if s.word(k - 1) in (".", "::") and s.tokens[k - 1].kind == "op":
                k -= 2
                continue
            return k

    def facts(self) -> dict:
        s, methods = self.src, []
        for path, name, first, body, last in self.functions():
            start, end = s.tokens[first].start, s.tokens[last].end
            text, line = s.text[start:end], s.line(start)
            kafka = [{"op": "Produce", "topic": x, "line": line} for x in re.findall(p.SEND, text)]
            if any(w in text for w in ("StreamConsumer", ".recv()", ".stream()")):
                kafka += [{"op": "Consume", "topic": x, "line": line} for x in re.findall(p.SUBSCRIBE, text)]
            redis = []
            if "redis" in text or "Commands" in text:
                redis = p.redis_operations(text, line, p.RUST_REDIS_GET, p.RUST_REDIS_SET, p.RUST_REDIS_DELETE)
            methods.append({
                "fqn": "::".join([*path, name]), "name": name, "line_start": line, "line_end": s.line(end - 1),
                "calls": self.calls(body, last), "http": self._route(start, end), "kafka": kafka,
                "db": p.sql_operations(text, line), "redis": redis,
            })
        return {"language": "rust", "classes": [], "methods": methods, "imports": self._uses()}

    def _route(self, start: int, end: int) -> dict | None:
        before = self.src.text[:start].encode()[-ROUTE_REACH:].decode(errors="ignore")
        m = re.search(p.ROUTE, before + self.src.text[start:end])
        if not m:
            return None
        return {"method": m[2].upper(), "path": m[1], "path_params": re.findall(p.COLON_PARAM, m[1]), "is_feign_client": False}

    def _uses(self) -> list[dict]:
        s, out = self.src, []
        for i, t in enumerate(s.tokens):
            if t.kind == "id" and t.text == "use" and not s.is_op(i - 1, "."):
                k = i + 1
                while k < len(s.tokens) and not s.is_op(k, ";"):
                    k += 1
                if k == i + 1 or k == len(s.tokens):
                    continue
                *module, tail = s.slice(i + 1, k - 1).split("::")
                items = [x.strip() for x in tail.strip("{} \n").split(",") if x.strip()] if tail.startswith("{") else []
                out.append({"module": "::".join(module if items else [*module, tail]), "items": items})
        return out


def parse(text: str, path: str, app=None) -> dict:
    """The facts of a Rust file."""
    return Rust(text).facts()
