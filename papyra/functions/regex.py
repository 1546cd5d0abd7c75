"""Run Python-`re` patterns on Spark's Java regex engine with the same meaning.

Python `str` patterns are Unicode-aware by default; Java needs `(?U)`.  Two
more gaps matter for our patterns: Python's `\\s` also matches U+001C-U+001F,
and Python's `.` excludes only `\\n` (Java's `(?d)` UNIX_LINES gives that).
"""

from __future__ import annotations

# Python's str.isspace() = Java's (?U)\s (Unicode White_Space) plus U+001C-U+001F.
# The property matcher is several times faster in Java than an explicit class.
_PY_SPACE_EXTRA = r"\x1c-\x1f"


def java_regex(py_pattern: str, flags: str = "") -> str:
    """Translate a Python `re` pattern (no look-around needed) for Spark's `rlike`/`regexp_*`."""
    out = []
    in_class = False
    i = 0
    n = len(py_pattern)
    while i < n:
        ch = py_pattern[i]
        if ch == "\\" and i + 1 < n:
            nxt = py_pattern[i + 1]
            if nxt == "s":
                out.append(r"\s" + _PY_SPACE_EXTRA if in_class else r"[\s" + _PY_SPACE_EXTRA + "]")
            elif nxt == "S" and not in_class:
                out.append(r"[^\s" + _PY_SPACE_EXTRA + "]")
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
            out.append(ch)
            # a leading ']' or '^]' is literal inside a class
            if i + 1 < n and py_pattern[i + 1] == "^":
                out.append("^")
                i += 1
            if i + 1 < n and py_pattern[i + 1] == "]":
                out.append("\\]")
                i += 1
        elif ch == "]" and in_class:
            in_class = False
            out.append(ch)
        else:
            out.append(ch)
        i += 1
    return f"(?{flags}Ud)" + "".join(out)
