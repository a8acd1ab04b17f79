"""Rule tables as SQL expression text.

A table of fifty rules is one parsed expression; built column by column it
would take thousands of calls into the JVM before the query starts.
"""

from __future__ import annotations


def quote(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def any_contains(text: str, needles) -> str:
    """True if the SQL expression ``text`` holds one of the needles."""
    tests = [f"contains({text}, {quote(n)})" for n in dict.fromkeys(needles)]
    return "(" + (" OR ".join(tests) or "false") + ")"


def case(branches, default: str) -> str:
    """CASE over (condition, value) texts; the first true condition decides."""
    body = " ".join(f"WHEN {c} THEN {v}" for c, v in branches)
    return f"CASE {body} ELSE {default} END" if body else default
