"""Patterns and replacements of a linear-time regex dialect, in the terms of the JVM's engine."""

from __future__ import annotations

import re

from pyspark import SparkContext

from ..errors import InvalidRegex

#: POSIX classes (fixed values).
POSIX = {"alpha": r"\p{IsAlphabetic}", "digit": "0-9", "alnum": "0-9A-Za-z", "upper": "A-Z", "lower": "a-z", "space": r"\s", "punct": r"\p{Punct}", "word": r"\w", "xdigit": "0-9A-Fa-f"}


def quote(text: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", text, flags=re.A) if "\\E" in text else f"\\Q{text}\\E"


def translate(pattern: str) -> tuple[str, dict[str, int], int]:
    """The body for the JVM, the groups' names, and how many groups there are."""
    out, names, groups, i, depth = [], {}, 0, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            if pattern[i + 1] in "123456789kGZQE":
                raise InvalidRegex(f"\\{pattern[i + 1]} is not supported in {pattern!r}")
            out.append(pattern[i : i + 2])
            i += 2
        elif c == "[":
            posix = re.match(r"\[:(\^?)(\w+):\]", pattern[i:]) if depth else None
            if posix and posix[2] in POSIX:
                out.append(f"[{posix[1]}{POSIX[posix[2]]}]")
                i += posix.end()
                continue
            depth += 1
            start = re.match(r"\[\^?\]?", pattern[i:])[0]
            out.append(start.replace("]", "\\]"))
            i += len(start)
        elif depth:
            depth -= c == "]"
            out.append(c)
            i += 1
        elif c == "(":
            if look := re.match(r"\(\?(<?[=!]|>)", pattern[i:]):
                raise InvalidRegex(f"{look[0]} is not supported in {pattern!r}")
            if named := re.match(r"\(\?P?<(\w+)>", pattern[i:]):
                groups += 1
                names[named[1]] = groups
                out.append("(")
                i += named.end()
                continue
            groups += not pattern.startswith("(?", i)
            out.append(c)
            i += 1
        else:
            out.append(c)
            i += 1
    return "".join(out), names, groups


def compiled(pattern: str, ignore_case: bool = False, literal: bool = False) -> tuple[str, dict[str, int], int]:
    """The whole pattern for rlike() and the like, tried out on the driver's JVM now and not in a task later."""
    body, names, groups = (quote(pattern), {}, 0) if literal else translate(pattern)
    whole = ("(?Udiu)" if ignore_case else "(?Ud)") + body
    context = SparkContext._active_spark_context
    if context is not None:
        try:
            context._jvm.java.util.regex.Pattern.compile(whole)
        except Exception as e:
            raise InvalidRegex(f"{pattern!r}: {str(e).splitlines()[0]}") from None
    return whole, names, groups


def replacing(pattern: str, ignore_case: bool = False, literal: bool = False) -> tuple[str, dict[str, int], int]:
    """As compiled(); an empty match right after a match does not count."""
    whole, names, groups = compiled(pattern, ignore_case, literal)
    context = SparkContext._active_spark_context
    if context is not None and context._jvm.java.util.regex.Pattern.compile(whole).matcher("").find():
        flags, body = whole.split(")", 1)
        whole = f"{flags})(?:{body})(?<!\\G(?!\\A))"
    return whole, names, groups


def replacement(text: str, names: dict[str, int], groups: int) -> str:
    """``$1``, ``${1}``, ``$name``, ``$$`` in the JVM's terms; a group that is not there is empty."""

    def group(name: str) -> str:
        n = int(name) if name.isdigit() else names.get(name, -1)
        return f"${n}" if 0 <= n <= groups else ""

    out, i = [], 0
    while i < len(text):
        m = re.compile(r"\$(?:\$|([0-9A-Za-z_]+)|\{([^}]+)\})").match(text, i)
        if m:
            found = "\\$" if m[0] == "$$" else group(m[1] or m[2])
            out.append(found)
            # a digit after a group's number would be read as part of it
            if found[:1] == "$" and text[m.end() : m.end() + 1].isdigit():
                out.append("\\")
            i = m.end()
        else:
            out.append("\\" + text[i] if text[i] in "\\$" else text[i])
            i += 1
    return "".join(out)
