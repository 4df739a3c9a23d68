"""SQL text for expressions that repeat over the catalogue.

A catalogue-wide expression has hundreds of nodes; building it as one SQL
string costs a single call to the JVM instead of one call per node.
"""

from __future__ import annotations


def string(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def regex(pattern: str) -> str:
    """A regex literal; raw, so backslashes stay as they are."""
    return "r'" + pattern.replace("'", r"\x27") + "'"


def struct(**fields: str) -> str:
    """``named_struct`` of SQL expressions."""
    return "named_struct(" + ", ".join(f"'{name}', {expr}" for name, expr in fields.items()) + ")"
