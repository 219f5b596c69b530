"""Patterns of ignore files and overrides, as git reads them."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import ConfigError


def glob_regex(glob: str) -> str:
    """A glob as a regular expression over a path with /: * and ? stay within a component, ** crosses them."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif glob[i:] == "**" and (i == 0 or glob[i - 1] == "/"):
            out, i = out + ".+" if i else out + ".*", i + 2
        elif c == "*":
            while i < len(glob) and glob[i] == "*":
                i += 1
            out += "[^/]*"
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[":
            end = glob.find("]", i + 2 + (glob[i + 1 : i + 2] in "!^"))
            if end < 0:
                raise ConfigError(f"unclosed character class in '{glob}'")
            body = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out += f"(?!/)[{'^' + body[1:] if body[0] in '!^' else body}]"
            i = end + 1
        elif c == "{":
            end = glob.find("}", i)
            if end < 0:
                raise ConfigError(f"unclosed alternate group in '{glob}'")
            out += "(?:" + "|".join(glob_regex(g) for g in glob[i + 1 : end].split(",")) + ")"
            i = end + 1
        elif c == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


@dataclass
class Rule:
    match: re.Pattern[str]
    negated: bool
    dirs_only: bool
    #: The pattern is over the last name of a path, not over all of it.
    name_only: bool


def parse_rule(line: str) -> Rule | None:
    """A line of an ignore file; None for a comment or a blank one."""
    line = line.rstrip("\n\r")
    if not line or line.startswith("#"):
        return None
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    negated = line.startswith("!")
    line = line[negated:]
    dirs_only = line.endswith("/")
    line = line.rstrip("/") if dirs_only else line
    if not line:
        return None
    anchored = "/" in line
    # without / or ** nothing in a pattern matches a /
    name_only = not anchored and "**" not in line
    body = glob_regex(line.removeprefix("/"))
    try:
        return Rule(re.compile(("" if anchored or name_only else "(?:.*/)?") + body, re.S), negated, dirs_only, name_only)
    except re.error as bad:
        raise ConfigError(f"'{line}': {bad}") from bad


class Rules:
    """Rules of one place; the last that matches decides."""

    def __init__(self, lines: list[str]):
        self.rules = [r for r in map(parse_rule, lines) if r]

    def decide(self, relative: str, is_dir: bool) -> bool | None:
        """True: ignored, False: kept by a ! rule, None: nothing matches."""
        name = relative[relative.rfind("/") + 1 :]
        for rule in reversed(self.rules):
            if (is_dir or not rule.dirs_only) and rule.match.fullmatch(name if rule.name_only else relative):
                return not rule.negated
        return None

    @classmethod
    def read(cls, path: str) -> Rules:
        """A file's rules; none if it can't be read; a line that is no pattern is passed over."""
        good = []
        try:
            with open(path, encoding="utf-8", errors="replace") as f:
                for line in f:
                    try:
                        parse_rule(line)
                        good.append(line)
                    except ConfigError:
                        pass
        except OSError:
            pass
        return cls(good)


class Overrides:
    """Globs that keep, or with ! leave out, whatever ignore files say; with a keeping one, files that match none are left out."""

    def __init__(self, globs: list[str]):
        for g in globs:
            try:
                parse_rule(g)
            except ConfigError as bad:
                raise ConfigError(f"Invalid pattern '{g}': {bad}") from bad
        self.rules = Rules(globs)
        self.keeps = any(not r.negated for r in self.rules.rules)

    def decide(self, relative: str, is_dir: bool) -> bool | None:
        """True: left out, False: kept, None: not for overrides to say."""
        if not self.rules.rules:
            return None
        said = self.rules.decide(relative, is_dir)
        if said is not None:
            return not said
        return True if self.keeps and not is_dir else None
