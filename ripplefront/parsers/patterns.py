"""Patterns that find operations in the text of a method.

The regular expressions, the words that mark HTTP clients, and the words that classify
configuration are fixed values: results depend on them to the letter. ``\\w`` and ``\\s`` are
Unicode-aware; ``.`` doesn't match a line break, so a SELECT list over several lines is
missed, as it is meant to be.
"""

from __future__ import annotations

import re

SELECT = r"(?i)SELECT\s+.+?\s+FROM\s+(\w+)"
INSERT = r"(?i)INSERT\s+INTO\s+(\w+)"
UPDATE = r"(?i)UPDATE\s+(\w+)\s+SET"
DELETE = r"(?i)DELETE\s+FROM\s+(\w+)"
SEND = r'\.send\s*\(\s*"([^"]+)"'
TOPICS = r'topics\s*=\s*"([^"]+)"'
SUBSCRIBE = r'subscribe\s*\(\s*&?\[?"([^"]+)"'
JAVA_REDIS_GET = r'\.opsForValue\(\)\.get\s*\(\s*"([^"]+)"'
JAVA_REDIS_SET = r'\.opsForValue\(\)\.set\s*\(\s*"([^"]+)"'
JAVA_REDIS_DELETE = r'\.delete\s*\(\s*"([^"]+)"'
RUST_REDIS_GET = r'\.get\s*\(\s*"([^"]+)"'
RUST_REDIS_SET = r'\.set\s*\(\s*"([^"]+)"'
RUST_REDIS_DELETE = r'\.del\s*\(\s*"([^"]+)"'
ROUTE = r'\.route\s*\(\s*"([^"]+)"\s*,\s*(get|post|put|delete|patch)\s*\('
BRACE_PARAM = r"\{([^}]+)\}"
COLON_PARAM = r":(\w+)"
LITERAL = r'"([^"]+)"'
#: What marks a call target as an HTTP client's, in lower case.
HTTP_CLIENTS = ("httpclient", "resttemplate", "webclient", "http::get", "http::post", "reqwest", "hyper")
HTTP_METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH")


def sql_operations(text: str, line: int) -> list[dict]:
    """Tables that the SQL in a text reads or writes, in the order of the four kinds."""
    kinds = (("Select", SELECT), ("Insert", INSERT), ("Update", UPDATE), ("Delete", DELETE))
    return [{"op": op, "table": t, "line": line} for op, p in kinds for t in re.findall(p, text)]


def redis_operations(text: str, line: int, get: str, put: str, delete: str) -> list[dict]:
    kinds = (("Get", get), ("Set", put), ("Delete", delete))
    return [{"op": op, "key_pattern": k, "line": line} for op, p in kinds for k in re.findall(p, text)]


def joined_path(*parts: str | None) -> str:
    """Parts joined by one slash each; leading slashes go, the last part's ending stays."""
    out = ""
    for p in parts:
        p = (p or "").lstrip("/")
        if p:
            out = out + ("" if not out or out.endswith("/") else "/") + p
    return out


def joined_path_from(app: str | None, *parts: str | None) -> str:
    """A provider's path: the application's name as it is, then parts joined as above."""
    out = app or ""
    for p in parts[:-1]:
        if p:
            out = out + ("/" if out and not out.endswith("/") else "") + p.lstrip("/")
    last = (parts[-1] or "").lstrip("/")
    return out + ("/" if out and not out.endswith("/") and last else "") + last
