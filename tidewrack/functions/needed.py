"""What every match of a pattern must contain: a plain search tells most texts apart before the pattern is tried.

Nothing is lost: a text without these strings can't match, and a text with
characters that fold to ASCII letters in other ways is always tried.
"""

from __future__ import annotations

import re
import warnings
from functools import cache
from itertools import product
from re import _constants as K
from re import _parser
from re import error

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewrack.functions import text as X

#: Greatest number of strings that a part of a pattern is spelt out to, and of those that stand for it.
MOST = 64
#: Other characters than letters of ASCII that a pattern's ASCII letters match regardless of case.
FOLDED = ("ſ", "ı", "İ", "K")

_Strings = frozenset[str]
#: All strings that a part matches, None where they aren't known, and sets of which each match contains a string.
_Part = tuple[_Strings | None, list[_Strings]]
_ANY: _Part = (None, [])


def _worth(strings: _Strings) -> tuple[int, int]:
    return min(map(len, strings)), -len(strings)


def _known(strings: _Strings) -> _Part:
    return strings, [strings] if "" not in strings else []


def _joined(parts: list[_Part]) -> _Part:
    run, sets, whole = frozenset([""]), [], True
    for exact, need in parts:
        longer = None if exact is None or len(run) * len(exact) > MOST else frozenset(a + b for a, b in product(run, exact))
        if longer is not None:
            run = longer
            continue
        whole = False
        sets += [run] if "" not in run else []
        sets += need if exact is None else []
        run = frozenset([""]) if exact is None else exact
    if whole:
        return _known(run)
    return None, sets + ([run] if "" not in run else [])


def _either(parts: list[_Part]) -> _Part:
    if all(e is not None for e, _ in parts):
        every = frozenset().union(*[e for e, _ in parts])
        if len(every) <= MOST:
            return _known(every)
    if all(need for _, need in parts):
        return None, [frozenset().union(*[max(need, key=_worth) for _, need in parts])]
    return _ANY


def _part(op, value) -> _Part:
    if op is K.LITERAL:
        return _known(frozenset([chr(value).lower()])) if value < 128 else _ANY
    if op is K.AT:
        return frozenset([""]), []
    if op is K.IN:
        return _known(frozenset(chr(v).lower() for _, v in value)) if all(o is K.LITERAL and v < 128 for o, v in value) else _ANY
    if op is K.SUBPATTERN:
        return _sequence(value[-1])
    if op is K.BRANCH:
        return _either([_sequence(x) for x in value[1]])
    if op in (K.MAX_REPEAT, K.MIN_REPEAT):
        least, most, inner = value
        exact, need = _sequence(inner)
        if least == most and least <= 16:
            return _joined([(exact, need)] * least)
        if least == 0 and most == 1 and exact is not None:
            return _known(exact | {""})
        return (None, need) if least else _ANY
    return _ANY


def _sequence(items) -> _Part:
    return _joined([_part(op, value) for op, value in items])


@cache
def strings(pattern: str) -> tuple[tuple[str, ...], ...]:
    """Up to two sets of lower-case strings: a match, in lower case, contains one of each set. No sets where the pattern doesn't say."""
    if re.search(r"\[:\^?[a-z]+:\]", pattern):  # a class that Python reads in another way
        return ()
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            _, sets = _sequence(_parser.parse(pattern))
    except (error, ValueError, OverflowError, RecursionError):
        return ()
    least = {tuple(sorted(s for s in one if not any(o != s and o in s for o in one))) for one in sets if len(one) <= MOST}
    return tuple(sorted(least, key=lambda one: _worth(frozenset(one)), reverse=True)[:2])


def folded(text: Column) -> Column:
    """The form of a text that :func:`may_match` looks at."""
    odd = F.lit(False)
    for c in FOLDED:
        odd = odd | text.contains(c)
    return F.struct(F.lower(text).alias("low"), odd.alias("odd"))


def may_match(text: Column, pattern: str) -> Column:
    """Whether a :func:`folded` text has what each match of the pattern contains."""
    out = F.lit(True)
    for one in strings(pattern):
        out = out & X.contains_any(text["low"], list(one))
    return text["odd"] | out if strings(pattern) else out
