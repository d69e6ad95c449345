"""Patterns of a linear-time dialect (no look-around, no back-references) for the JVM's engine."""

from __future__ import annotations

import re

_SPACE = r"\t\n\f\r "
_WORD = "0-9A-Za-z_"
_EDGE = f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"
_NO_EDGE = f"(?:(?<=[{_WORD}])(?=[{_WORD}])|(?<![{_WORD}])(?![{_WORD}]))"


class PatternError(ValueError):
    """The pattern is no valid one of the dialect."""


def to_java(pattern: str, ignore_case: bool = False) -> str:
    """The same language in Java's dialect.

    Case folding is Unicode's, ``.`` and ``$`` know only the line feed, ``$``
    without the flag ``m`` is the text's very end, and ``\\b``, ``\\s`` are ASCII.
    """
    flags = re.match(r"\(\?([imsU]+)\)", pattern)
    on = set(flags.group(1)) if flags else set()
    body = pattern[flags.end() :] if flags else pattern
    if "U" in on:
        raise PatternError("the ungreedy flag isn't supported")
    if ignore_case:
        on.add("i")
    out, i, inside = [], 0, False
    while i < len(body):
        c = body[i]
        if c == "\\":
            if i + 1 == len(body):
                raise PatternError("trailing backslash")
            n = body[i + 1]
            if n.isdigit() and n != "0":
                raise PatternError("back-references aren't supported")
            if n == "s":
                out.append(_SPACE if inside else f"[{_SPACE}]")
            elif n == "S":
                if inside:
                    raise PatternError(r"\S in a class isn't supported")
                out.append(f"[^{_SPACE}]")
            elif n == "b" and not inside:
                out.append(_EDGE)
            elif n == "B" and not inside:
                out.append(_NO_EDGE)
            elif n == "Q":
                raise PatternError(r"\Q isn't supported")
            else:
                out.append(c + n)
            i += 2
            continue
        if inside:
            if c == "]":
                inside = False
            elif c == "[" and not body.startswith("[:", i):
                c = "\\["
            elif c == "[":
                end = body.index(":]", i)
                c = {"alpha": "A-Za-z", "digit": "0-9", "alnum": "0-9A-Za-z", "space": _SPACE, "word": _WORD, "upper": "A-Z", "lower": "a-z"}.get(body[i + 2 : end], "")
                if not c:
                    raise PatternError("unknown class")
                i = end + 1
            elif c == "&" and body.startswith("&&", i):
                c = "\\&"
        elif c == "[":
            inside = True
            j = i + 1 + (body[i + 1 : i + 2] == "^")
            if body[j : j + 1] == "]":  # a bracket that comes first stands for itself
                out.append(body[i:j] + "\\]")
                i = j + 1
                continue
        elif c == "$" and "m" not in on:
            c = r"\z"
        elif c == "(" and body.startswith("(?", i) and re.match(r"\(\?(?:[=!]|<[=!]|>)", body[i:]):
            raise PatternError("look-around and atomic groups aren't supported")
        out.append(c)
        i += 1
    if inside:
        raise PatternError("unclosed class")
    return f"(?{''.join(sorted(on))}ud)" + "".join(out)


def check(pattern: str) -> str | None:
    """Why the pattern is invalid, or None."""
    try:
        to_java(pattern)
        re.compile(re.sub(r"^\(\?([imsU]+)\)", "", pattern).replace("(?P<", "(?P<"))
    except (PatternError, re.error, ValueError) as e:
        return str(e)
    return None
