"""Make rule patterns mean the same on the JVM as in the rule tables' dialect.

Rule tables use the Unicode-aware reading of ``\\b \\w \\s \\d`` in which ``.``
excludes only ``\\n``.  The JVM's defaults differ (and its ``\\b`` changed
between releases), so the shorthand classes are spelled out.
"""

from __future__ import annotations

WORD = r"\p{L}\p{N}_"
SPACE = r"\t\n\x0b\f\r\x1c-\x1f \x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
DIGIT = r"\p{Nd}"
BOUNDARY = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
CLASSES = {"w": WORD, "s": SPACE, "d": DIGIT}

# Characters that strip() removes: every Unicode white-space character.
WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0" + "".join(
    chr(c) for c in (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def jvm(pattern: str) -> str:
    """The JVM pattern equal in meaning to ``pattern``."""
    flags = "d"
    if pattern.startswith("(?i)"):
        flags, pattern = "diu", pattern[4:]
    out, in_class, i = [], False, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            nxt = pattern[i + 1]
            i += 2
            if nxt in CLASSES:
                out.append(CLASSES[nxt] if in_class else f"[{CLASSES[nxt]}]")
            elif nxt == "b" and not in_class:
                out.append(BOUNDARY)
            elif nxt == "Z":
                out.append(r"\z")
            elif nxt in "'\"":
                out.append(nxt)
            else:
                out.append(ch + nxt)
            continue
        if in_class and ch in "[&":  # the JVM reads nested classes and && here
            out.append("\\" + ch)
        else:
            out.append(ch)
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        i += 1
    return f"(?{flags})" + "".join(out)


def jvm_replacement(template: str, shift: int = 0) -> str:
    r"""The JVM form of a replacement template that uses ``\1``-style groups."""
    out, i = [], 0
    while i < len(template):
        ch = template[i]
        if ch == "\\" and template[i + 1].isdigit():
            out.append(f"${int(template[i + 1]) + shift}")
            i += 2
            continue
        out.append("\\" + ch if ch in "$\\" else ch)
        i += 1
    return "".join(out)
