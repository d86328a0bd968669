"""Guards for names and raw SQL that users pass in."""

from __future__ import annotations

import re

IDENTIFIER = re.compile(r"^[a-zA-Z_][a-zA-Z0-9_]*$")
# Statements and file functions that an expression may not hold.
DENIED = ("attach", "detach", "copy", "create", "drop", "alter", "insert", "update", "delete", "install", "load", "pragma", "export", "import", "truncate", "grant", "revoke", "call", "set", "read_csv", "read_parquet", "read_json", "parquet_scan")
_DENIED = re.compile(r"\b(?:" + "|".join(DENIED) + r")\b", re.IGNORECASE)


def check_name(name: str) -> str:
    """The name, if it is a plain identifier; ValueError otherwise."""
    if not isinstance(name, str) or not IDENTIFIER.match(name):
        raise ValueError(f"not a plain identifier: {name!r}")
    return name


def check_expression(expr: str) -> str:
    """The expression, if it has no statement mark, comment or denied keyword outside of quotes."""
    bare = re.sub(r"'(?:[^']|'')*'", "''", expr)
    if ";" in bare or "--" in bare or "/*" in bare:
        raise ValueError("an expression may hold no ';' and no comment")
    if m := _DENIED.search(bare):
        raise ValueError(f"keyword {m.group(0)!r} is not allowed in an expression")
    return expr


def check_select(sql: str) -> str:
    """The text, if it is one SELECT (or WITH ... SELECT) statement."""
    if not re.match(r"\s*(select|with)\b", sql, re.IGNORECASE):
        raise ValueError("only SELECT statements are allowed")
    check_expression(sql)
    return sql
