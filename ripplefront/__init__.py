"""Change-impact analytics on Spark.

Names are loaded when they are first asked for, so that a worker that needs one parser, or
one corpus operator, doesn't import all the rest.
"""

from importlib import import_module

_HOMES = {
    "operators.facts": ["Facts"],
    "operators.graph": ["connected", "counts", "cycles", "get_node", "nodes_of", "to_dot", "to_json", "to_mermaid"],
    "operators.resolve": ["downstream_steps", "resolved", "upstream_steps"],
    "operators.seeds": ["changed_methods", "missing_files"],
    "operators.trace": ["TraceConfig", "trace"],
    "parsers": ["CONFIGS", "LANGUAGES"],
    "plans.analysis": ["AnalysisError", "Result", "analyze", "changes", "index"],
    "sources.store": ["IndexMetadata", "StoreError"],
}
_HOME = {name: home for home, names in _HOMES.items() for name in names}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f".{_HOME[name]}", __name__), name)


def __dir__():
    return [*globals(), *__all__]
