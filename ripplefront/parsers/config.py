"""XML and YAML configuration: endpoints, topics, tables and key prefixes."""

from __future__ import annotations

import re
from xml.parsers import expat

import yaml

#: Words in a tag's name, in the order in which they decide.
XML_WORDS = (
    ("http", ("url", "endpoint", "api", "http")),
    ("kafka", ("topic", "kafka")),
    ("db", ("table", "entity", "database")),
    ("redis", ("redis", "cache", "key")),
)
#: For keys of YAML a topic has to be named as such.
YAML_WORDS = (XML_WORDS[0], ("kafka", ("topic",)), XML_WORDS[2], XML_WORDS[3])


class ConfigError(ValueError):
    """Text that is not well formed."""


def endpoint(value: str) -> str | None:
    """The path of a URL or of a text that starts with a slash, without its query."""
    m = re.match(r"https?://[^/]*(/[^?]*)", value)
    if m:
        return m[1]
    return value.split("?")[0] if value.startswith("/") else None


def _kind(name: str, words) -> str | None:
    low = name.lower()
    return next((kind for kind, some in words if any(w in low for w in some)), None)


def _found(kind: str, value: str) -> tuple[str, str | None, str] | None:
    value = value.strip()
    if not value:
        return None
    if kind != "http":
        return kind, None, value
    path = endpoint(value)
    return (kind, "GET", path) if path else None


def distinct(items) -> list[tuple[str, str | None, str]]:
    return list(dict.fromkeys(x for x in items if x))


def parse_xml(text: str) -> list[tuple[str, str | None, str]]:
    """(kind, http_method, value) of element texts whose tag, or one before it, says so.

    What a tag announces holds until an element ends with a text that isn't blank, which
    uses up the first kind announced. Attributes, CDATA sections and empty elements say
    nothing.
    """
    parser, out, announced = expat.ParserCreate("utf-8"), [], set()
    state = {"text": "", "cdata": False, "opened": None}
    data = text.encode()

    def start(name, _):
        kind = _kind(name, XML_WORDS)
        new = kind if kind and kind not in announced else None
        state["opened"] = (new, state["text"])
        if kind:
            announced.add(kind)
        state["text"] = ""

    def end(_):
        opened, state["opened"] = state["opened"], None
        at = parser.CurrentByteIndex
        if opened and data[at - 2 : at] == b"/>":  # <a/>
            announced.discard(opened[0])
            state["text"] = opened[1]
            return
        value = state["text"].strip()
        kind = next((k for k, _ in XML_WORDS if k in announced), None)
        if value and kind:
            out.append(_found(kind, value))
            announced.discard(kind)
        state["text"] = ""

    def chars(found):
        state["opened"] = None
        if not state["cdata"] and found.strip():
            state["text"] = found

    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, chars
    parser.StartCdataSectionHandler = lambda: state.update(cdata=True)
    parser.EndCdataSectionHandler = lambda: state.update(cdata=False)
    try:
        parser.Parse(data, True)
    except expat.ExpatError as e:
        raise ConfigError(str(e)) from e
    return distinct(out)


def parse_yaml(text: str) -> list[tuple[str, str | None, str]]:
    """(kind, http_method, value) of strings, or lists of strings, whose key says so."""
    try:
        tree = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ConfigError(str(e)) from e
    out: list = []

    def walk(node):
        if isinstance(node, dict):
            for key, value in node.items():
                kind = _kind(key, YAML_WORDS) if isinstance(key, str) else None
                if kind and isinstance(value, str):
                    out.append(_found(kind, value))
                elif kind and kind != "http" and isinstance(value, list):
                    out.extend(_found(kind, v) for v in value if isinstance(v, str))
                walk(value)
        elif isinstance(node, list):
            for value in node:
                walk(value)

    walk(tree)
    return distinct(out)


def application(text: str) -> tuple[str | None, str]:
    """spring.application.name and server.servlet.context-path of an application.yml."""
    try:
        tree = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ConfigError(str(e)) from e

    def at(*keys):
        node = tree
        for k in keys:
            node = node.get(k) if isinstance(node, dict) else None
        return node if isinstance(node, str) else None

    return at("spring", "application", "name"), at("server", "servlet", "context-path") or ""
