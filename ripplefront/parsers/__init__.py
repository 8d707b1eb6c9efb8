"""Parsers of source files, patches and configuration: text in, facts out, no Spark.

``LANGUAGES`` and ``CONFIGS`` are the registries the table functions read; add a parser by
adding its function here.
"""

from __future__ import annotations

from . import config, java, rust

#: File extension -> (language, parser of (text, path, app) returning a facts dictionary).
LANGUAGES = {"java": ("java", java.parse), "rs": ("rust", rust.parse)}
#: File extension -> parser of a text returning (kind, http_method, value) tuples.
CONFIGS = {"xml": config.parse_xml, "yml": config.parse_yaml, "yaml": config.parse_yaml}


class ParseError(Exception):
    """A file that can't be parsed; it becomes a row of issues, not a failed job."""
