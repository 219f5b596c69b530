"""Line machines: for each comment style, which lines of a file are code.

A machine is made for each file and sees its lines in order, each with its own line end. `code(line)` says whether the
line counts as source. What it carries from line to line is in `state()`, and `restore(state)` takes it up again.
"""

from __future__ import annotations

import copy
import re
from collections.abc import Callable
from functools import lru_cache
from typing import Any

from .literals import OPENERS, WHITE, Quoting, blank, find_hash_python, find_outside, find_outside_sql, find_outside_swift, find_unquoted, literal_end, string_rest
from .styles import effective, literals_of, style_of


class Machine:
    """A style without comments: lines that aren't blank are code."""

    #: What a fresh machine carries.
    start: dict[str, Any] = {}
    #: Of what it carries, what doesn't change how a line without signs is taken.
    loose = ("lines", "value")
    #: Characters without which a line is plain, unless something is open: it is code if it isn't blank, or in any case
    #: where `blanks` says so. None: every line is looked at.
    signs: str | None = None
    blanks = False

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.__dict__.update(copy.deepcopy(self.start))

    def state(self) -> dict[str, Any]:
        return copy.deepcopy({k: self.__dict__[k] for k in self.start})

    def restore(self, state: dict[str, Any]) -> None:
        self.__dict__.update(copy.deepcopy(state))

    @property
    def in_comment(self) -> bool:
        return False

    def code(self, line: str) -> bool:
        return not blank(line)

    def idle(self) -> bool:
        """Whether nothing is open."""
        now, start = self.__dict__, self.start
        for k in start:
            if now[k] != start[k] and k not in self.loose:
                return False
        return True

    def passed(self, text: str) -> None:
        """Told of lines without signs that weren't looked at one by one."""

    def count(self, text: str) -> int:
        """Lines of code of a text; runs of lines without signs are counted together."""
        if self.signs is None:
            return sum(map(self.code, split_lines(text)))
        search, find, code, idle = _any_of(self.signs).search, text.find, self.code, self.idle
        at, found, size = 0, 0, len(text)
        while at < size:
            m = search(text, at)
            stop = text.rfind("\n", at, m.start()) + 1 if m else size
            if stop > at:
                plain = text[at:stop]
                found += plain.count("\n") + (plain[-1] != "\n") if self.blanks else len(_INKED.findall(plain))
                self.passed(plain)
                at = stop
            # the line with the sign, and those after it while something is open
            while at < size:
                end = find("\n", at) + 1 or size
                found += code(text[at:end])
                at = end
                if idle():
                    break
        return found


#: What a line with any character but white space has, once.
_INKED = re.compile(rf"[^{WHITE}][^\n]*")


@lru_cache(maxsize=64)
def _any_of(marks: str) -> re.Pattern[str]:
    return re.compile("[" + re.escape(marks) + "]")


class CFamily(Machine):
    """// and /* */, which nest where `nesting` says so. Strings count as code and run on over lines until their quote."""

    start = {"depth": 0, "quote": ""}
    signs = '/"\'`'
    _CLOSE, _EITHER = re.compile(r"\*/"), re.compile(r"\*/|/\*")

    def __init__(self, kind: str = "plain", nesting: bool = False):
        super().__init__()
        self.kind, self.nesting = kind, nesting
        self.open = re.compile(f"(?P<lit>{OPENERS[kind]})|//|/\\*")

    @property
    def in_comment(self) -> bool:
        return self.depth > 0

    def code(self, line: str) -> bool:
        at, found = 0, False
        while at < len(line):
            if self.depth:
                m = (self._EITHER if self.nesting else self._CLOSE).search(line, at)
                if not m:
                    return found
                self.depth += 1 if m[0] == "/*" else -1
                at = m.end()
            elif self.quote:
                end = string_rest(line, at, self.quote, self.kind == "csharp" and self.quote == '"')
                found |= not blank(line[at:end])
                if end is None:
                    return found
                self.quote, at = "", end
            else:
                m = self.open.search(line, at)
                if not m:
                    return found or not blank(line[at:])
                found = found or not blank(line[at : m.start()])
                if m["lit"] is None:
                    if m[0] == "//":
                        return found
                    self.depth, at = 1, m.end()
                    continue
                found = True
                end = literal_end(line, m.start(), m["lit"], self.kind)
                if end is None:
                    # a raw literal's own delimiter isn't kept: any double quote ends it on a later line
                    self.quote = m["lit"] if m["lit"] in "\"'`" else '"'
                    return True
                at = end
        return found


class NestedBlocks(Machine):
    """Block comments that nest; what follows the last close on the line where the comment opened is looked at again."""

    start = {"depth": 0}
    signs, blanks = '(', True
    opener, closer = "(*", "*)"

    def __init__(self) -> None:
        super().__init__()
        self.marks = re.compile(f"{re.escape(self.opener)}|{re.escape(self.closer)}")

    @property
    def in_comment(self) -> bool:
        return self.depth > 0

    def early(self, line: str) -> bool | None:
        """The answer where it doesn't need the blocks."""
        return None

    def find(self, line: str) -> int:
        return line.find(self.opener)

    def counts(self, before: str) -> bool:
        """Whether what stands before a block is code."""
        return not blank(before)

    def late(self, line: str) -> bool:
        """The answer for a line without a block."""
        return True

    def code(self, line: str) -> bool:
        within, found = self.depth > 0, False
        while True:
            if not self.depth:
                known = self.early(line)
                if known is None and (at := self.find(line)) >= 0:
                    found |= self.counts(line[:at])
                    self.depth, line = 1, line[at + len(self.opener) :]
                else:
                    found |= self.late(line) if known is None else known
                    # a line that begins inside a block never counts, whatever comes after it
                    return found and not within
            for m in self.marks.finditer(line):
                self.depth += 1 if m[0] == self.opener else -1
                if not self.depth:
                    line = line[m.end() :]
                    break
            if self.depth or blank(line):
                return found and not within


class Haskell(NestedBlocks):
    """-- at the first column, {- -}."""

    signs, blanks = '-{', True
    opener, closer = "{-", "-}"

    def early(self, line: str) -> bool | None:
        return False if line.startswith("--") else None

    def counts(self, before: str) -> bool:
        return not blank(before) and not before.strip(WHITE).startswith("--")


class Julia(NestedBlocks):
    """#= =# before #."""

    signs, blanks = '#', True
    opener, closer = "#=", "=#"

    def counts(self, before: str) -> bool:
        return not blank(before) and not before.strip(WHITE).startswith("#")

    def late(self, line: str) -> bool:
        return not line.strip(WHITE).startswith("#")


class Swift(NestedBlocks):
    """// anywhere outside of strings before /* */."""

    signs, blanks = '/', True
    opener, closer = "/*", "*/"

    def early(self, line: str) -> bool | None:
        at = find_outside_swift(line, "//")
        return None if at < 0 else not blank(line[:at])

    def find(self, line: str) -> int:
        return find_outside_swift(line, self.opener)


class DLang(NestedBlocks):
    """//, then /+ +/ that nests, then /* */."""

    start = {"depth": 0, "in_c": False}
    signs, blanks = '/', True
    opener, closer = "/+", "+/"

    @property
    def in_comment(self) -> bool:
        return self.depth > 0 or self.in_c

    def early(self, line: str) -> bool | None:
        if self.in_c:
            at = line.find("*/")
            if at < 0:
                return False
            self.in_c, rest = False, line[at + 2 :]
            return not blank(rest) and self.code(rest)
        at = find_outside(line, "//")
        return None if at < 0 else not blank(line[:at])

    def find(self, line: str) -> int:
        return find_outside(line, self.opener)

    def late(self, line: str) -> bool:
        at = find_outside(line, "/*")
        if at < 0:
            return True
        end = line.find("*/", at + 2)
        if end < 0:
            self.in_c = True
        return not blank(line[:at]) or (end >= 0 and not blank(line[end + 2 :]))


class Html(Machine):
    """<!-- -->; only the first comment of a line is looked at."""

    start = {"inside": False}
    signs, blanks = '<', True

    @property
    def in_comment(self) -> bool:
        return self.inside

    def code(self, line: str) -> bool:
        if self.inside:
            at = line.find("-->")
            self.inside = at < 0
            return at >= 0 and not blank(line[at + 3 :])
        at = line.find("<!--")
        if at < 0:
            return True
        end = line.find("-->", at + 4)
        self.inside = end < 0
        return not blank(line[:at]) or (end >= 0 and not blank(line[end + 3 :]))


class Sql(Machine):
    """-- and /* */ outside of quotes; strings end with their line."""

    start = {"inside": False}
    signs, blanks = '-/', True

    @property
    def in_comment(self) -> bool:
        return self.inside

    def code(self, line: str) -> bool:
        while True:
            if self.inside:
                end = line.find("*/")
                self.inside = end < 0
                if end < 0 or blank(line[end + 2 :]):
                    return False
                line = line[end + 2 :]
                continue
            dash = find_outside_sql(line, "--")
            at = find_outside_sql(line if dash < 0 else line[:dash], "/*")
            if at < 0:
                return dash < 0 or not blank(line[:dash])
            end = line.find("*/", at + 2)
            if end < 0:
                self.inside = True
                return not blank(line[:at])
            if not blank(line[:at]):
                return True
            line = line[end + 2 :]
            if blank(line):
                return False


class Gas(Machine):
    """/* */ anywhere, else # or @ at the line's start."""

    start = {"inside": False}
    signs, blanks = '/#@', True

    @property
    def in_comment(self) -> bool:
        return self.inside

    def code(self, line: str) -> bool:
        while self.inside:
            end = line.find("*/")
            if end < 0 or blank(line[end + 2 :]):
                self.inside = end < 0
                return False
            self.inside, line = False, line[end + 2 :]
        at = line.find("/*")
        if at < 0:
            return not line.strip(WHITE).startswith(("#", "@"))
        end = line.find("*/", at + 2)
        self.inside = end < 0
        return not blank(line[:at]) or (end >= 0 and not blank(line[end + 2 :]))


class Matlab(Machine):
    """% at the line's start; %{ and %} alone on a line."""

    start = {"inside": False}
    signs, blanks = '%', True

    @property
    def in_comment(self) -> bool:
        return self.inside

    def code(self, line: str) -> bool:
        text = line.strip(WHITE)
        if self.inside:
            self.inside = text != "%}"
            return False
        self.inside = text == "%{"
        return not text.startswith("%")


class Lua(Machine):
    """-- at the first column, and --[=[ ]=] of any level there."""

    start = {"level": -1}
    signs, blanks = '-', True
    _OPEN = re.compile(r"--\[(=*)\[")

    @property
    def in_comment(self) -> bool:
        return self.level >= 0

    def _ends(self, text: str, level: int) -> bool:
        return f"]{'=' * level}]" in text

    def code(self, line: str) -> bool:
        if self.level >= 0:
            if self._ends(line, self.level):
                self.level = -1
            return False
        if not line.startswith("--"):
            return True
        m = self._OPEN.match(line)
        if m and not self._ends(line[m.end() :], len(m[1])):
            self.level = len(m[1])
        return False


class PowerShell(Machine):
    """# and <# #>."""

    start = {"inside": False}
    signs = '#'

    @property
    def in_comment(self) -> bool:
        return self.inside

    @staticmethod
    def _before_hash(text: str) -> bool:
        at = find_hash_python(text)
        return not blank(text if at < 0 else text[:at])

    def code(self, line: str) -> bool:
        text = line.strip(WHITE)
        if self.inside:
            end = text.find("#>")
            self.inside = end < 0
            return end >= 0 and self._before_hash(text[end + 2 :])
        if not text:
            return False
        at = find_unquoted(line, "<#")
        if at < 0:
            return self._before_hash(text)

        def counts(part: str) -> bool:
            part = part.strip(WHITE)
            return bool(part) and find_hash_python(part) != 0

        end = line.find("#>", at + 2)
        self.inside = end < 0
        return counts(line[:at]) or (end >= 0 and counts(line[end + 2 :]))


class Shebang(Machine):
    """Lines that begin with #, and a first line of #!, aren't code."""

    start = {"lines": 0}

    def first(self, text: str) -> bool:
        """Counts the line; whether it is a #! at the file's start."""
        self.lines += 1
        return self.lines == 1 and text.startswith("#!")

    def passed(self, text: str) -> None:
        # only whether a line is the first one matters
        self.lines += 1


class Hash(Shebang):
    """# outside of quotes; a blank line is code."""

    signs, blanks = '#', True
    def code(self, line: str) -> bool:
        text = line.strip(WHITE)
        if self.first(text) or text.startswith("#"):
            return False
        at = find_unquoted(line, "#")
        return at < 0 or not blank(line[:at])


class Heredocs(Shebang):
    """Here-documents wait in a queue; lines up to an end mark are code unless blank, and the end mark is code too."""

    start = {"lines": 0, "waiting": []}

    @property
    def in_comment(self) -> bool:
        return bool(self.waiting)

    def in_heredoc(self, line: str, seen: str | None = None) -> bool | None:
        """The answer inside a here-document, None outside. seen: what is held against the mark instead of the line."""
        if not self.waiting:
            return None
        mark, indented = self.waiting[0]
        seen = line if seen is None else seen
        if seen.strip(WHITE) == mark if indented else mark in (seen, seen.rstrip(WHITE)):
            self.waiting.pop(0)
            return True
        return not blank(line)


class Shell(Heredocs):
    """# and here-documents. An unquoted mark at the line's end holds the line end itself, as the pattern takes it."""

    signs = '#<'
    _HERE = re.compile(r"<<(-?)[ \t]*(?:([^ \t\"'>|&;]+)|'([^']+)'|\"([^\"]+)\")")

    def code(self, line: str) -> bool:
        known = self.in_heredoc(line)
        if known is not None:
            return known
        text = line.strip(WHITE)
        if self.first(text) or text.startswith("#"):
            return False
        at = find_unquoted(line, "#")
        shown = line if at < 0 else line[:at]
        quoting = Quoting(shown)
        for m in self._HERE.finditer(shown):
            if not quoting.inside(m.start()):
                self.waiting.append((m[2] or m[3] or m[4], m[1] == "-"))
                break
        return not blank(shown)


class Perl(Heredocs):
    """#, POD from a =word to =cut, here-documents (which shifts look like)."""

    start = {"lines": 0, "waiting": [], "in_pod": False}
    signs = '#<='
    _HERE = re.compile(r"<<\s*(?:(\w+)|'(\w+)'|\"(\w+)\")")
    _POD = ("=pod", "=head", "=over", "=item", "=back", "=encoding", "=for", "=begin")

    @property
    def in_comment(self) -> bool:
        return self.in_pod or bool(self.waiting)

    def code(self, line: str) -> bool:
        known = self.in_heredoc(line)
        if known is not None:
            return known
        if self.in_pod:
            self.in_pod = not line.startswith("=cut")
            return False
        if line.startswith(self._POD):
            self.in_pod = True
            return False
        text = line.strip(WHITE)
        if self.first(text) or text.startswith("#"):
            return False
        quoting = Quoting(line)
        for m in self._HERE.finditer(line):
            if not quoting.inside(m.start()):
                self.waiting.append((m[1] or m[2] or m[3], False))
        at = find_unquoted(line, "#")
        return not blank(line if at < 0 else line[:at])


class Php(Heredocs):
    """//, # and /* */ outside of literals, here-documents."""

    start = {"lines": 0, "waiting": [], "inside": False}
    signs = '/#<'
    _HERE = re.compile(r"<<<(?:(\w+)|'(\w+)'|\"(\w+)\")")

    @property
    def in_comment(self) -> bool:
        return self.inside or bool(self.waiting)

    @staticmethod
    def _counts(rest: str) -> bool:
        rest = rest.strip(WHITE)
        return bool(rest) and not rest.startswith(("//", "#"))

    def code(self, line: str) -> bool:
        known = self.in_heredoc(line, line.strip(WHITE).removesuffix(";"))
        if known is not None:
            return known
        if self.inside:
            end = line.find("*/")
            self.inside = end < 0
            return end >= 0 and self._counts(line[end + 2 :])
        block = find_outside(line, "/*")
        at = min((p for p in (block, find_outside(line, "//"), find_outside(line, "#")) if p >= 0), default=-1)
        quoting = Quoting(line)
        for m in self._HERE.finditer(line):
            if not quoting.inside(m.start()) and not 0 <= at < m.start():
                self.waiting.append((m[1] or m[2] or m[3], True))
        if at < 0:
            return not blank(line)
        before = not blank(line[:at])
        if at != block:
            return before
        end = line.find("*/", at + 2)
        self.inside = end < 0
        return before or (end >= 0 and self._counts(line[end + 2 :]))


class Ruby(Heredocs):
    """#, =begin to =end at the first column, here-documents, strings with #{}."""

    start = {"lines": 0, "waiting": [], "in_doc": False, "stack": []}
    signs = '#"\'`<\\='
    _HERE = re.compile(r"<<([-~]?)(?:(\w+)|'(\w+)'|\"(\w+)\")")
    _CODE = re.compile(r"\\[\s\S]?|[#\"'`}]|<<")
    _TEXT = {q: re.compile(rf"\\[\s\S]?|{q}|#") for q in "\"'`"}

    @property
    def in_comment(self) -> bool:
        return self.in_doc or bool(self.waiting) or bool(self.stack and self.stack[-1])

    def code(self, line: str) -> bool:
        known = self.in_heredoc(line)
        if known is not None:
            return known
        if self.in_doc:
            self.in_doc = not line.startswith("=end")
            return False
        if not self.stack and line.startswith("=begin"):
            self.in_doc = True
            return False
        at, found = 0, False
        while at < len(line):
            # an empty entry is an interpolation, any other the quote of a string
            quote = self.stack[-1] if self.stack else ""
            m = (self._TEXT[quote] if quote else self._CODE).search(line, at)
            if not m:
                return found or not blank(line[at:])
            found = found or not blank(line[at : m.start()])
            at, mark = m.end(), m[0]
            if mark[0] == "\\":
                found |= bool(quote)
            elif quote:
                found = True
                if mark == quote:
                    self.stack.pop()
                elif quote != "'" and line.startswith("{", at):
                    at += 1
                    self.stack.append("")
            elif mark == "#":
                return found
            else:
                found = True
                if mark in "\"'`":
                    self.stack.append(mark)
                elif mark == "}":
                    if self.stack:
                        self.stack.pop()
                elif here := self._HERE.match(line, m.start()):
                    self.waiting.append((here[2] or here[3] or here[4], here[1] != ""))
                    # the mark's length is taken in bytes
                    at = m.start() + len(here[0].encode())
                else:
                    at = m.start() + 1
        return found


class Python(Shebang):
    """#, and strings that may run on. Three quotes with no code before them on the line open a text that isn't code."""

    # an entry is None for an interpolation, else quote, three quotes, f, raw, not code
    start = {"lines": 0, "stack": []}
    signs = '#"\''
    _CODE = re.compile(r"[#\"'fFrRuUbB]")
    _FIELD = re.compile(r"[#\"'fFrRuUbB}]")
    _TEXT = {(q, f): re.compile(rf"\\|{q}" + (r"|\{" if f else "")) for q in "\"'" for f in (False, True)}

    @property
    def in_comment(self) -> bool:
        return bool(self.stack and self.stack[-1] and self.stack[-1][4])

    def code(self, line: str) -> bool:
        if self.first(line.strip(WHITE)):
            return False
        top = self.stack[-1] if self.stack else None
        at, found = 0, top is not None and not top[4]
        while at < len(line):
            top = self.stack[-1] if self.stack else None
            if top is not None:
                at, found = self._text(line, at, found, top)
                continue
            m = (self._FIELD if self.stack else self._CODE).search(line, at)
            if not m:
                return found or not blank(line[at:])
            found = found or not blank(line[at : m.start()])
            if m[0] == "#":
                return found
            if m[0] == "}":
                self.stack.pop()
                at, found = m.end(), True
            else:
                at, found = self._opens(line, m.start(), found)
        return found

    def _opens(self, line: str, at: int, found: bool) -> tuple[int, bool]:
        """A string, if prefixes and a quote begin one at `at`. Prefixes that lead to none take the character after them along."""
        seen = ""
        while line[at] not in "\"'":
            letter = line[at].lower()
            at += 1
            if letter not in ("f", "r", "b", "u") or letter in seen or at == len(line):
                return at, True
            seen += letter
        quote = line[at]
        if not line.startswith(quote, at + 1):
            self.stack.append((quote, False, "f" in seen, "r" in seen, False))
            return at + 1, True
        if not line.startswith(quote, at + 2):
            return at + 2, True
        self.stack.append((quote, True, "f" in seen, "r" in seen, not found))
        return at + 3, found

    def _text(self, line: str, at: int, found: bool, top: tuple) -> tuple[int, bool]:
        quote, three, fields, raw, silent = top
        m = self._TEXT[quote, fields].search(line, at)
        if not m:
            return len(line), found or (not silent and not blank(line[at:]))
        found = found or (not silent and not blank(line[at : m.start()]))
        at = m.end()
        if m[0] == "\\":
            skip = line.startswith(quote, at) if raw else True
            return at + skip, found or not silent
        if m[0] == "{":
            if line.startswith("{", at):
                return at + 1, found
            self.stack.append(None)
            return at, True
        if not three:
            self.stack.pop()
        elif line.startswith(quote, at):
            at += 1
            if line.startswith(quote, at):
                at += 1
                self.stack.pop()
        return at, found or not silent


class JavaScript(Shebang):
    """// and /* */, templates with ${}, regular expressions where a value can't stand before them."""

    # an entry is "{" for an interpolation, "*" for a comment, a quote for a string, "/" or "[" for a regular expression
    start = {"lines": 0, "stack": [], "value": False}
    signs = '/"\'`#'
    _CODE = re.compile(r"[/\"'`}]")
    _TEXT = {**{q: re.compile(rf"\\|{q}") for q in "\"'"}, "`": re.compile(r"\\|`|\$\{"), "/": re.compile(r"\\|\[|/"), "[": re.compile(r"\\|\]"), "*": re.compile(r"\*/")}
    _OPERATORS = frozenset("+-*%=<>&|!^~?:,;([{")
    _VALUES = frozenset("_$)]}")

    @property
    def in_comment(self) -> bool:
        return bool(self.stack) and self.stack[-1] == "*"

    def passed(self, text: str) -> None:
        super().passed(text)
        self._track(text)

    def _track(self, text: str) -> None:
        for c in reversed(text):
            if c.isalnum() or c in self._VALUES:
                self.value = True
                return
            if c in self._OPERATORS:
                self.value = False
                return

    def code(self, line: str) -> bool:
        if self.first(line.strip(WHITE)):
            return False
        at, found = 0, bool(self.stack) and self.stack[-1] not in "{*"
        while at < len(line):
            top = self.stack[-1] if self.stack else ""
            m = (self._TEXT[top] if top and top != "{" else self._CODE).search(line, at)
            passed = line[at : m.start()] if m else line[at:]
            if top == "*":
                if not m:
                    return found
                self.stack.pop()
                at = m.end()
                continue
            found = found or (bool(passed) if top in ("/", "[") else not blank(passed))
            if top in ("", "{"):
                self._track(passed)
            if not m:
                return found
            at, mark = m.end(), m[0]
            if top in ("", "{"):
                if mark == "/":
                    if line.startswith("/", at):
                        return found
                    if line.startswith("*", at):
                        at += 1
                        self.stack.append("*")
                        continue
                    if self.value:
                        self.value = False
                    else:
                        self.stack.append("/")
                elif mark == "}":
                    if top:
                        self.stack.pop()
                    self.value = True
                else:
                    self.stack.append(mark)
            elif mark == "\\":
                at += 1
            elif mark == "[":
                self.stack[-1] = "["
            elif mark == "]":
                self.stack[-1] = "/"
            elif mark == "${":
                self.stack.append("{")
                self.value = False
            else:
                self.stack.pop()
                self.value = True
            found = True
        return found


class Prefix(Machine):
    """Lines that begin with a mark, after white space, are comments; all others are code, blank ones too."""

    def __init__(self, *marks: str, any_case: bool = False):
        super().__init__()
        self.marks, self.any_case = marks, any_case

    def code(self, line: str) -> bool:
        text = line.strip(WHITE)
        return not (text.upper() if self.any_case else text).startswith(self.marks)


class Fortran(Machine):
    """! after white space; C, c or * at the first column."""

    def code(self, line: str) -> bool:
        text = line.strip(WHITE)
        return bool(text) and not line.startswith(("C", "c", "*")) and not text.startswith("!")


#: Marks of the prefix styles, and whether their case matters.
PREFIXES: dict[str, tuple[tuple[str, ...], bool]] = {
    "vhdl": (("--",), False),
    "erlang": (("%",), False),
    "lisp": ((";",), False),
    "assembly": ((";",), False),
    "batch": (("REM ", "REM\t", "::", "@REM "), True),
    "basic": (("'", "REM ", "REM\t"), True),
}
_MACHINES: dict[str, Callable[[], Machine]] = {
    "javascript": JavaScript, "swift": Swift, "d": DLang, "php": Php, "python": Python, "ruby": Ruby, "perl": Perl, "shell": Shell, "hash": Hash, "powershell": PowerShell, "lua": Lua,
    "html": Html, "sql": Sql, "haskell": Haskell, "julia": Julia, "ocaml": NestedBlocks, "fortran": Fortran, "matlab": Matlab, "gas": Gas, "none": Machine,
}
_REGISTERED: dict[str, Callable[[], Machine]] = {}


def register(ext: str, make: Callable[[], Machine]) -> None:
    """Has files with this extension analysed by a machine of the caller's own. Executors need the call too."""
    _REGISTERED[ext.lower()] = make


def machine_for(ext: str, mapping: dict[str, str] | None = None) -> Machine:
    """A fresh machine for a file with this extension. mapping: other extensions' rules to use, by extension as it is written."""
    ext = effective(ext, mapping)
    if ext.lower() in _REGISTERED:
        return _REGISTERED[ext.lower()]()
    style = style_of(ext)
    if style in ("c", "c_nested"):
        return CFamily(literals_of(ext), nesting=style == "c_nested")
    if style in PREFIXES:
        marks, any_case = PREFIXES[style]
        return Prefix(*marks, any_case=any_case)
    return _MACHINES[style]()


def split_lines(text: str) -> list[str]:
    """The lines of a text, each with its line feed."""
    lines = text.split("\n")
    return [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])


def count_code(text: str, ext: str, mapping: dict[str, str] | None = None) -> int:
    """Lines of code of a whole text."""
    return machine_for(ext, mapping).count(text)
