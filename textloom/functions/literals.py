"""Where string literals begin and end in a line, as patterns."""

from __future__ import annotations

import re
from functools import lru_cache

#: White_Space of Unicode, which Python's own notion exceeds by U+001C to U+001F.
WHITE = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def blank(text: str) -> bool:
    return not text.strip(WHITE)


def _body(stop: str) -> str:
    """Everything up to a character or a text, over escaped characters."""
    return rf"(?:\\[\s\S]|(?!{stop})[\s\S])*+{stop}"


_CLOSED = {q: re.compile(q + _body(q)) for q in "\"'`"}
_REST = {q: re.compile(_body(q)) for q in "\"'`"}
_VERBATIM_REST = re.compile(r'(?:[^"]|"")*+"')
_VERBATIM = re.compile(r'@"(?:[^"]|"")*+"')
_TEXT_BLOCK = re.compile('"""' + _body('"""'))
_CHAR = re.compile(r"'(?:\\[\s\S]|[^'\\])*+'")
_RAW = re.compile(r'b?r(#*)"[\s\S]*?"\1')
_BYTES = re.compile(r'b"(?:\\[\s\S]|(?!")[\s\S])*+"')
_CPP = re.compile(r'R"([0-9A-Za-z_]{0,16})\([\s\S]*?\)\1"')

_BEFORE = r"(?<![0-9A-Za-z_])"
#: What may open a literal, by kind, in the order in which it is tried.
OPENERS = {
    "plain": "[\"']",
    "double_only": '"',
    "backtick": "[\"'`]",
    "text_block": "[\"']",
    "csharp": "@\"|[\"']",
    "cpp": r'R"(?=[0-9A-Za-z_]{0,16}\()|["' + "']",
    "rust": _BEFORE + 'b?r#*"|' + _BEFORE + 'b"|["' + "']",
}
#: Bytes within which a quoted character of Rust closes; else the quote begins a lifetime.
_CHAR_BYTES = 12
#: Bytes that must be left for a text block to open.
_BLOCK_BYTES = 6


def literal_end(line: str, at: int, opener: str, kind: str) -> int | None:
    """Where the literal that opens at `at` ends; None if it runs on to the line's end."""
    if opener == "@\"":
        m = _VERBATIM.match(line, at)
    elif opener.startswith("R"):
        m = _CPP.match(line, at)
    elif opener.startswith(("r", "br")):
        m = _RAW.match(line, at)
    elif opener == 'b"':
        m = _BYTES.match(line, at)
    elif opener == "'" and kind == "rust":
        m = _CHAR.match(line, at)
        return m.end() if m and len(m[0].encode()) <= _CHAR_BYTES else at + 1
    elif opener == '"' and kind == "text_block" and line.startswith('"""', at) and len(line[at : at + _BLOCK_BYTES].encode()) >= _BLOCK_BYTES:
        m = _TEXT_BLOCK.match(line, at)
    else:
        m = _CLOSED[opener].match(line, at)
    return m.end() if m else None


def string_rest(line: str, at: int, quote: str, verbatim: bool) -> int | None:
    """Where a string that an earlier line opened ends; None if not on this one."""
    m = (_VERBATIM_REST if verbatim else _REST[quote]).match(line, at)
    return m.end() if m else None


@lru_cache(maxsize=64)
def _finder(openers: str, pattern: str) -> re.Pattern[str]:
    return re.compile(f"(?P<lit>{openers})|{re.escape(pattern)}")


def find_outside(line: str, pattern: str, kind: str = "rust") -> int:
    """The first place of pattern outside of literals, -1 if there is none."""
    if pattern not in line:
        return -1
    finder, at = _finder(OPENERS[kind], pattern), 0
    while m := finder.search(line, at):
        if m["lit"] is None:
            return m.start()
        end = literal_end(line, m.start(), m["lit"], kind)
        if end is None:
            return -1
        at = end
    return -1


@lru_cache(maxsize=32)
def _swift_string(hashes: int, block: bool) -> re.Pattern[str]:
    mark = "#" * hashes
    stop = ('"""' if block else '"') + mark
    return re.compile(rf'#{{{hashes}}}{chr(34) * (3 if block else 1)}(?:\\{mark}[\s\S]?|(?!{stop})[\s\S])*+{stop}')


_SWIFT_OPEN = re.compile("(#*)\"|'")
_QUOTED = re.compile(r"'(?:\\[\s\S]|(?!')[\s\S])*+'")


def find_outside_swift(line: str, pattern: str) -> int:
    """find_outside with Swift's literals: any number of # around one quote or three."""
    if pattern not in line:
        return -1
    at = 0
    while True:
        found, m = line.find(pattern, at), _SWIFT_OPEN.search(line, at)
        if found < 0 or not m or found < m.start():
            return found
        if m[0] == "'":
            end = _QUOTED.match(line, m.start())
        else:
            # a fourth quote doesn't open a block any wider
            end = _swift_string(len(m[1]), line.startswith('"""', m.end() - 1)).match(line, m.start())
        if not end:
            return -1
        at = end.end()


_SQL_STRING = re.compile(r"'(?:[^']|'')*+'|\"(?:[^\"]|\"\")*+\"")


def find_outside_sql(line: str, pattern: str) -> int:
    """find_outside with doubled quotes as escapes, for both kinds of quotes."""
    at = 0
    while True:
        found = line.find(pattern, at)
        quotes = [q for q in (line.find("'", at), line.find('"', at)) if q >= 0]
        if found < 0 or not quotes or found < min(quotes):
            return found
        end = _SQL_STRING.match(line, min(quotes))
        if not end:
            return -1
        at = end.end()


_PYTHON_OPEN = re.compile("(?:(?:[fF][rR]|[rR][fF]|[bB][rR]|[rR][bB]|[fFuUrRbB])?(?P<q>[\"']))|#")
_PYTHON_BLOCK = {q: re.compile(q * 3 + _body(q * 3)) for q in "\"'"}


def find_hash_python(line: str) -> int:
    """The first # outside of Python's literals, which may have prefixes and three quotes; -1 if there is none."""
    at = 0
    while m := _PYTHON_OPEN.search(line, at):
        if m[0] == "#":
            return m.start()
        q, begin = m["q"], m.end() - 1
        end = (_PYTHON_BLOCK[q] if line.startswith(q * 3, begin) else _CLOSED[q]).match(line, begin)
        if not end:
            return -1
        at = end.end()
    return -1


def _toggled(stop: str) -> re.Pattern[str]:
    """What a scan passes before an unquoted `stop`: a backslash always takes the next character with it."""
    double, single = r'"(?:\\[\s\S]|[^"\\])*+(?:"|\\?\Z)', r"'(?:\\[\s\S]|[^'\\])*+(?:'|\\?\Z)"
    return re.compile(rf"(?:\\[\s\S]|{double}|{single}|(?!{stop})[^\\\"'])*+")


_TO_HASH, _TO_BLOCK = _toggled("#"), _toggled("<#")


def find_unquoted(line: str, mark: str) -> int:
    """The first # or <# outside of simply quoted text, -1 if there is none."""
    if mark not in line:
        return -1
    at = (_TO_HASH if mark == "#" else _TO_BLOCK).match(line).end()
    return at if line.startswith(mark, at) else -1


_QUOTE_OR_ESCAPE = re.compile(r"\\[\s\S]?|[\"']")


class Quoting:
    """Whether places of a line lie within simply quoted text. Places are asked for from left to right, and the line is passed once."""

    def __init__(self, line: str) -> None:
        self.line, self.at, self.quote = line, 0, ""

    def inside(self, place: int) -> bool:
        while self.at < place and (m := _QUOTE_OR_ESCAPE.search(self.line, self.at, place)):
            if m[0] == "\\":
                # it escapes what is at the place itself
                self.at = m.start()
                return bool(self.quote)
            if m[0][0] != "\\":
                self.quote = "" if m[0] == self.quote else self.quote or m[0]
            self.at = m.end()
        self.at = max(self.at, place)
        return bool(self.quote)


def inside_quotes(line: str, place: int) -> bool:
    """Whether one place lies within simply quoted text."""
    return Quoting(line).inside(place)
