"""Java sources: classes, methods, calls, endpoints and operations.

There is no grammar here, only tokens and bracket pairs: a declaration is found by its
keyword or shape, and text that fits none is passed over, so broken files yield what can be
read of them. What the facts say is fixed by the results they must equal: constructors are
no methods, nested classes don't carry the outer name, overloads share a name, calls
without a typed receiver keep the bare name.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from . import patterns as p
from .lexing import Source

MODIFIERS = set("public protected private static abstract final native synchronized transient volatile strictfp default sealed".split())
KEYWORDS = MODIFIERS | set(
    "assert break case catch class const continue do else enum extends finally for goto if implements import instanceof "
    "interface new package return super switch this throw throws try while".split()
)
PRIMITIVES = set("boolean byte char double float int long short void var".split())


class App(NamedTuple):
    """What the service's application.yml says."""

    name: str | None = None
    context_path: str | None = None


class Java:
    def __init__(self, text: str, path: str, app: App):
        self.src, self.path, self.app = Source(text, "java"), path, app
        self.package = self._package()
        self.imports, self.import_map = self._imports()

    # -- names

    def _package(self) -> str | None:
        s = self.src
        for i, t in enumerate(s.tokens):
            if t.kind == "id" and t.text == "package" and s.is_id(i + 1):
                name = self._dotted(i + 1)[0]
                return name if "." in name else None
            if t.text in ("class", "interface", "import"):
                return None
        return None

    def _dotted(self, i: int) -> tuple[str, int]:
        """A qualified name and the index after it."""
        s, parts = self.src, [self.src.word(i)]
        i += 1
        while s.is_op(i, ".") and s.is_id(i + 1):
            parts.append(s.word(i + 1))
            i += 2
        return ".".join(parts), i

    def _imports(self) -> tuple[list[str], dict[str, str]]:
        s, out, names = self.src, [], {}
        for i, t in enumerate(s.tokens):
            if t.kind == "id" and t.text == "import" and s.is_id(i + 1):
                name, end = self._dotted(i + 2 if s.word(i + 1) == "static" else i + 1)
                wild = s.is_op(end, ".") and s.is_op(end + 1, "*")
                names[name.rsplit(".", 1)[-1]] = name
                out.append(name + (".*" if wild else ""))
        return out, names

    def resolved(self, name: str) -> str:
        return self.import_map.get(name) or (f"{self.package}.{name}" if self.package else name)

    # -- declarations

    def modifiers_back(self, i: int) -> tuple[int, list[tuple[str, str | None]]]:
        """Where the modifiers before token ``i`` start, and the annotations among them."""
        s, found = self.src, []
        while i > 0:
            k = i - 1
            if s.is_id(k) and s.word(k) in MODIFIERS:
                i = k
                continue
            args = None
            if s.is_op(k, ")") and k in s.pair:
                args, k = s.slice(s.pair[k], k), s.pair[k] - 1
            name = k
            while s.is_id(name) and s.is_op(name - 1, "."):
                name -= 2
            if s.is_id(name) and s.is_op(name - 1, "@"):
                found.append((s.slice(name, k), args))
                i = name - 1
                continue
            break
        return i, found[::-1]

    def modifiers_on(self, i: int) -> tuple[int, list[tuple[str, str | None]]]:
        """The index after the modifiers that start at ``i``, and the annotations among them."""
        s, found = self.src, []
        while True:
            if s.is_op(i, "@") and s.is_id(i + 1) and s.word(i + 1) != "interface":
                name, end = self._dotted(i + 1)
                args = None
                if s.is_op(end, "(") and end in s.pair:
                    args, end = s.slice(end, s.pair[end]), s.pair[end] + 1
                found.append((name, args))
                i = end
            elif s.is_id(i) and s.word(i) in MODIFIERS:
                i += 1
            elif s.is_id(i) and s.word(i) == "non" and s.is_op(i + 1, "-"):
                i += 3
            else:
                return i, found

    def types(self) -> list[dict]:
        """Every class and interface declaration, however deep."""
        s, out = self.src, []
        for i, t in enumerate(s.tokens):
            if t.kind != "id" or t.text not in ("class", "interface") or not s.is_id(i + 1):
                continue
            if s.is_op(i - 1, ".") or s.is_op(i - 1, "@"):
                continue
            body = i + 2
            while body < len(s.tokens) and not s.is_op(body, "{"):
                if s.is_op(body, ";") or s.is_op(body, ")"):
                    break
                body = s.pair.get(body, body) + 1 if s.is_op(body, "(") else body + 1
            if s.is_op(body, "{") and body in s.pair:
                first, notes = self.modifiers_back(i)
                out.append({"keyword": i, "body": body, "end": s.pair[body], "first": first, "notes": notes})
        return out

    def implemented(self, keyword: int, body: int) -> list[str]:
        """Plain type names after ``implements``; generic and qualified ones aren't plain."""
        s, out, i = self.src, [], keyword
        while i < body and s.word(i) != "implements":
            i = s.angle_on(i) + 1 if s.is_op(i, "<") and s.angle_on(i) > 0 else i + 1
        i += 1
        while i < body and s.word(i) != "permits":
            end = i
            while end < body and not s.is_op(end, ",") and s.word(end) != "permits":
                end = s.angle_on(end) + 1 if s.is_op(end, "<") and s.angle_on(end) > 0 else end + 1
            if end == i + 1 and s.is_id(i):
                out.append(self.resolved(s.word(i)))
            i = end + 1 if s.is_op(end, ",") else end
        return out

    def members(self, body: int, end: int):
        """(kind, first, name, header end, last) of direct methods and fields of a body."""
        s, i = self.src, body + 1
        while i < end:
            first = i
            at, notes = self.modifiers_on(i)
            if s.is_op(at, "<") and s.angle_on(at) > 0:
                at = s.angle_on(at) + 1
                at = self.modifiers_on(at)[0]
            k, paren, stop = at, None, None
            while k < end:
                if s.is_op(k, "("):
                    paren = k if paren is None else paren
                    k = s.pair.get(k, k) + 1
                elif s.is_op(k, "=") and paren is None:
                    stop = "field"
                    break
                elif s.is_op(k, ";") or s.is_op(k, "{"):
                    break
                else:
                    k += 1
            nested = any(s.word(x) in ("class", "interface", "enum", "record") and s.is_id(x) for x in range(at, min(at + 2, end)))
            nested = nested and not (paren == at + 1)
            if stop == "field" or (s.is_op(k, ";") and paren is None):
                last = k
                while last < end and not s.is_op(last, ";"):
                    last = s.pair.get(last, last) + 1 if s.word(last) in ("(", "[", "{") else last + 1
                if not nested:
                    yield "field", first, at, notes, last
                i = last + 1
                continue
            if k >= end:
                return
            last = s.pair.get(k, end) if s.is_op(k, "{") else k
            typed = paren is not None and paren - 1 > at and s.is_id(paren - 1) and s.word(paren - 1) not in KEYWORDS
            if typed and not nested:
                yield "method", first, paren - 1, notes, last
            i = last + 1

    def declared(self, at: int, stop: int) -> tuple[str, str] | None:
        """(last name, type) of ``Type name [= ...], name ...;`` at a token, or None."""
        s, k = self.src, at
        if not s.is_id(k) or s.word(k) in KEYWORDS:
            return None
        k = self._dotted(k)[1]
        if s.is_op(k, "<"):
            k = s.angle_on(k) + 1
            if not k:
                return None
        while s.is_op(k, "[") and s.is_op(k + 1, "]"):
            k += 2
        kind = s.slice(at, k - 1)
        name = None
        while s.is_id(k) and s.word(k) not in KEYWORDS:
            candidate = s.word(k)
            k += 1
            while s.is_op(k, "[") and s.is_op(k + 1, "]"):
                k += 2
            if s.is_op(k, "="):
                while k <= stop and not s.is_op(k, ";") and not s.is_op(k, ","):
                    k = s.pair.get(k, k) + 1 if s.word(k) in ("(", "[", "{") else k + 1
            if s.is_op(k, ";"):
                return candidate, kind
            if not s.is_op(k, ","):
                return (name, kind) if name else None
            name, k = candidate, k + 1
        return (name, kind) if name else None

    # -- methods

    def locals(self, first: int, last: int) -> dict[str, str]:
        s, out = self.src, {}
        for i in range(first, last):
            prev = s.word(i - 1)
            starts = prev in ("{", "}", ";", ":", "->") or (prev == "(" and s.word(i - 2) == "for")
            if starts and s.tokens[i].kind in ("id", "op"):
                found = self.declared(self.modifiers_on(i)[0], last)
                if found:
                    out[found[0]] = self.resolved(found[1])
        return out

    def calls(self, first: int, last: int, kinds: dict[str, str]) -> list[dict]:
        s, out = self.src, []
        for i in range(first, last):
            if not s.is_op(i + 1, "(") or not s.is_id(i):
                continue
            name, k = s.word(i), i - 1
            if name in KEYWORDS or s.is_op(k, "@"):
                continue
            if s.is_op(k, ">") and s.is_op(s.angle_back(k) - 1, "."):
                k = s.angle_back(k) - 1  # a.<T>m()
            elif s.is_op(k, ">") and s.pair.get(i + 1) and s.word(s.pair[i + 1] + 1) in ("{", "throws"):
                continue  # a method of an anonymous class
            elif s.is_op(k, "]") or (s.is_id(k) and s.word(k) not in KEYWORDS):
                continue
            start, receiver = i, None
            if s.is_op(k, "."):
                start = self._chain_start(k)
                if start is None:
                    continue  # new a.b.C()
                if start == k - 1 and s.is_id(start) and s.word(start) not in ("this", "super"):
                    receiver = s.word(start)
            elif s.word(k) == "new":
                continue
            target = name
            if receiver in kinds:
                target = f"{self.import_map.get(kinds[receiver], kinds[receiver])}::{name}"
            elif receiver in self.import_map:
                target = f"{self.import_map[receiver]}::{name}"
            out.append({"target": target, "line": s.line(s.tokens[start].start)})
        return out

    def _chain_start(self, dot: int) -> int | None:
        """The first token of the expression before a dot; None if it is the name after ``new``."""
        s, k = self.src, dot
        while s.is_op(k, "."):
            k -= 1
            while s.word(k) in (")", "]") and k in s.pair:
                group = s.pair[k]
                if s.is_op(group - 1, ">") and s.angle_back(group - 1) > 0:
                    group = s.angle_back(group - 1)
                if not (s.is_id(group - 1) and s.word(group - 1) not in KEYWORDS - {"this", "super"}) and s.word(group - 1) not in (")", "]"):
                    return group
                k = group - 1
            if s.is_op(k - 1, ">") and s.angle_back(k - 1) > 0 and s.is_op(s.angle_back(k - 1) - 1, "."):
                k = s.angle_back(k - 1)
            if s.word(k - 1) == "new" and s.is_id(k - 1):
                return k - 1 if s.is_op(dot - 1, ")") or s.is_op(dot - 1, "]") else None
            if not s.is_op(k - 1, "."):
                return k
            k -= 1
        return k

    def http(self, name: str, args: str | None) -> tuple[str, str] | None:
        """(method, path) of a mapping annotation with a literal path."""
        for kind in ("Get", "Post", "Put", "Delete", "Patch"):
            if f"{kind}Mapping" in name:
                method = kind.upper()
                break
        else:
            if "RequestMapping" not in name:
                return None
            method = next((m for m in p.HTTP_METHODS if f"RequestMethod.{m}" in (args or "")), "GET")
        literal = re.search(p.LITERAL, args or "")
        return (method, literal[1]) if literal else None

    def endpoint(self, notes: list, feign: tuple | None, base: str | None) -> dict | None:
        found = next((h for h in (self.http(*n) for n in notes) if h), None)
        if not found:
            return None
        method, path = found
        full = p.joined_path(*feign, path) if feign else p.joined_path_from(self.app.name, self.app.context_path, base, path)
        return {"method": method, "path": full, "path_params": re.findall(p.BRACE_PARAM, path), "is_feign_client": feign is not None}

    def facts(self) -> dict:
        s, classes, methods = self.src, [], []
        declared = self.types()
        fields = {t["keyword"]: self._fields(t) for t in declared}
        for t in declared:
            name = s.word(t["keyword"] + 1)
            full = f"{self.package}.{name}" if self.package else name
            classes.append({
                "name": full, "line_start": s.line(s.tokens[t["first"]].start), "line_end": s.line(s.tokens[t["end"]].start),
                "is_interface": s.word(t["keyword"]) == "interface", "implements": self.implemented(t["keyword"], t["body"]),
            })
            feign, base = self._class_notes(t["notes"])
            inherited = self._enclosing_fields(t, declared, fields)
            for kind, first, at, notes, last in self.members(t["body"], t["end"]):
                if kind != "method":
                    continue
                text, line = s.slice(first, last), s.line(s.tokens[first].start)
                own = inherited | self.locals(at, last)
                kafka = []
                header = s.text[s.tokens[first].start : s.tokens[at].start]
                if "@KafkaListener" in header and (m := re.search(p.TOPICS, header)):
                    kafka.append({"op": "Consume", "topic": m[1], "line": line})
                kafka += [{"op": "Produce", "topic": x, "line": line} for x in re.findall(p.SEND, text)]
                methods.append({
                    "fqn": f"{full}::{s.word(at)}", "name": s.word(at), "line_start": line,
                    "line_end": s.line(s.tokens[last].start), "calls": self.calls(at + 1, last, own),
                    "http": self.endpoint(notes, feign, base), "kafka": kafka, "db": p.sql_operations(text, line),
                    "redis": p.redis_operations(text, line, p.JAVA_REDIS_GET, p.JAVA_REDIS_SET, p.JAVA_REDIS_DELETE),
                })
        return {"language": "java", "classes": classes, "methods": methods, "imports": [{"module": x, "items": []} for x in self.imports]}

    def _fields(self, t: dict) -> dict[str, str]:
        out = {}
        for kind, _, at, _, last in self.members(t["body"], t["end"]):
            if kind == "field" and (found := self.declared(at, last)):
                out[found[0]] = self.resolved(found[1])
        return out

    def _enclosing_fields(self, t: dict, declared: list[dict], fields: dict) -> dict[str, str]:
        """Fields of the nearest enclosing class: an interface's own fields don't count."""
        around = [x for x in declared if x["body"] <= t["body"] and x["end"] >= t["end"] and self.src.word(x["keyword"]) == "class"]
        return dict(fields[max(around, key=lambda x: x["body"])["keyword"]]) if around else {}

    def _class_notes(self, notes: list) -> tuple[tuple | None, str | None]:
        """(service, path) of a Feign client, and the path of a class's RequestMapping."""
        feign = base = None
        for name, args in notes:
            args = args or ""
            if "FeignClient" in name and feign is None:
                service = re.search(r'value\s*=\s*"([^"]+)"', args) or re.search(r'name\s*=\s*"([^"]+)"', args)
                path = re.search(r'path\s*=\s*"([^"]+)"', args)
                feign = (service[1], path[1] if path else None) if service else None
            elif "RequestMapping" in name and base is None and (m := re.search(p.LITERAL, args)):
                base = m[1]
        return feign, base


def parse(text: str, path: str, app: App = App()) -> dict:
    """The facts of a Java file; text that can't be read yields fewer of them, or none."""
    return Java(text, path, app).facts()
