"""Glob patterns as one regular expression, so that name filters run in the JVM (F1, F2).

``*`` any run of characters, ``?`` one character, ``[abc]``, ``[a-z]``, ``[!abc]``;
matching is case-sensitive and covers the whole name. A pattern that is not
valid (an open bracket, a run of three stars, a double star inside a name)
matches nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"(?P<stars>\*+)"
    r"|(?P<one>\?)"
    r"|\[(?:!(?P<outside>.[^\]]*)|(?P<inside>[^!][^\]]*))\]"
    r"|(?P<open>\[)"
    r"|(?P<literal>[^*?\[]+)",
    re.DOTALL,
)
_SPECIAL = re.compile(r"([\\^$.|?*+()\[\]{}&~#\-])")


def _escape(text: str) -> str:
    return _SPECIAL.sub(r"\\\1", text)


def _bracket(members: str, negated: bool) -> str:
    ranges = re.findall(r"(?s)(.)-(.)|(.)", members)
    inside = "".join(
        f"{_escape(low)}-{_escape(high)}" if low else _escape(single)
        for low, high, single in ranges
        if not low or low <= high
    )
    if not inside:
        return "." if negated else "(?!)"
    return f"[{'^' if negated else ''}{inside}]"


def _double_star(glob: str, token: re.Match) -> str | None:
    """``**`` must be a whole path component; it then spans components."""
    before, after = glob[: token.start()], glob[token.end():]
    if (before and not before.endswith("/")) or (after and not after.startswith("/")):
        return None
    return ".*" if not after else "(?:.*/)?"


def glob_to_regex(glob: str) -> str | None:
    """The regular expression of one glob, or None when the glob is not valid."""
    out, position = [], 0
    while position < len(glob):
        token = _TOKEN.match(glob, position)
        position = token.end()
        if token["stars"]:
            if len(token["stars"]) > 2:
                return None
            piece = ".*" if len(token["stars"]) == 1 else _double_star(glob, token)
            if piece is None:
                return None
            if len(token["stars"]) == 2 and glob[position: position + 1] == "/":
                position += 1
            out.append(piece)
        elif token["one"]:
            out.append(".")
        elif token["open"]:
            return None
        elif token["literal"] is not None:
            out.append(_escape(token["literal"]))
        else:
            out.append(_bracket(token["inside"] or token["outside"], token["inside"] is None))
    return f"^(?s:{''.join(out)})\\z"


def any_glob(name: Column, globs) -> Column:
    """True where ``name`` matches at least one of the globs."""
    valid = [r for r in map(glob_to_regex, globs) if r is not None]
    return name.rlike("|".join(valid)) if valid else F.lit(False)
