"""ECMAScript regular expressions in Java's dialect."""

from __future__ import annotations

from functools import lru_cache
from re import _constants as op
from re import _parser

#: White space of ECMAScript, as members of a Java character class.
SPACE = r"\t\n\x0B\f\r    -     　﻿"
LINE_ENDS = r"\n\r  "
WORD = "[A-Za-z0-9_]"
BOUNDARY = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def js_regex(source: str, flags: str = "") -> str:
    """A Java pattern that matches what `source` matches under `flags` (i and m count).

    Word boundaries are ASCII, white space is ECMAScript's, a dot stops at all four line ends,
    and $ means the very end of the input, unlike Java's defaults.
    """
    out, inside, at = [], False, 0
    while at < len(source):
        char = source[at]
        if char == "\\":
            at += 1
            escape = source[at]
            if escape == "s":
                out.append(SPACE if inside else f"[{SPACE}]")
            elif escape == "S":
                out.append(f"[^{SPACE}]")
            elif escape == "b" and not inside:
                out.append(BOUNDARY)
            elif escape == "D" and not inside:
                out.append("[^0-9]")
            else:
                out.append("\\" + escape)
        elif inside:
            inside = char != "]"
            out.append("\\" + char if char in "[&" else char)
        elif char == "[":
            inside = True
            out.append(char)
        elif char == ".":
            out.append(f"[^{LINE_ENDS}]")
        elif char == "$":
            out.append(f"(?=[{LINE_ENDS}]|\\z)" if "m" in flags else r"\z")
        elif char == "^" and "m" in flags:
            out.append(f"(?<=^|[{LINE_ENDS}])")
        else:
            out.append(char)
        at += 1
    return ("(?i)" if "i" in flags else "") + "".join(out)


def wildcard_regex(pattern: str) -> str:
    """Java pattern of a tool wildcard: * is any text and, only beside a *, ? is any character;
    other metacharacters keep their meaning. Without a * the pattern is a plain name."""
    if pattern == "*":
        return r"(?s)\A.*\z"
    if "*" not in pattern:
        return r"\A\Q" + pattern.replace(r"\E", r"\E\\E\Q") + r"\E\z"
    return js_regex("^" + pattern.replace("*", ".*").replace("?", ".") + "$")


@lru_cache(1024)
def needed(source: str) -> tuple[str, ...]:
    """Lower-case words of which any text that a pattern matches has one, in whatever case; empty if
    the pattern needs none of two letters or more."""

    def best(sequence) -> frozenset[str]:
        found, run = [], ""
        for kind, value in [*sequence, (None, None)]:
            if kind is op.LITERAL and chr(value).isascii():
                run += chr(value).lower()
                continue
            if len(run) > 1:
                found.append(frozenset([run]))
            run = ""
            if kind is op.SUBPATTERN:
                found.append(best(value[3]))
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] > 0:
                found.append(best(value[2]))
            elif kind is op.BRANCH:
                ways = [best(way) for way in value[1]]
                found.append(frozenset().union(*ways) if all(ways) else frozenset())
        return max(found, key=lambda words: (min(map(len, words), default=0), -len(words)), default=frozenset())

    return tuple(sorted(best(_parser.parse(source))))
