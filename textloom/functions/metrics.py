"""Line, character, word and code counts as column expressions, and code counts by machine where a style needs one."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .analyzers import PREFIXES, machine_for, split_lines
from .styles import NO_BREAKS, NO_COMMENTS, STATELESS, STYLES

_SPACES = r"\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: A character that is, or isn't, white space by Unicode's White_Space.
SPACE, INK = f"[{_SPACES}]", f"[^{_SPACES}]"
#: Bytes in which a NUL makes a content binary.
PROBE = 8192


def is_binary(content: Column) -> Column:
    """Whether a binary content has a NUL among its first bytes."""
    return F.coalesce(F.position(F.lit(b"\0"), F.substring(content, 1, PROBE)) > 0, F.lit(False))


def decoded(content: Column) -> Column:
    """A binary content as text; what isn't UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def line_count(text: Column) -> Column:
    """Lines: a last line may lack its line feed, an empty text has none."""
    ended = (text == "") | (F.right(text, F.lit(1)) == "\n")
    return (_count(text, "\n") + F.when(ended, 0).otherwise(1)).cast("bigint")


def char_count(text: Column, newlines: bool = False, breaks: bool = True) -> Column:
    """Code points; without newlines, each line's own LF or CRLF isn't counted, or, without breaks, no CR or LF at all."""
    if newlines:
        return F.length(text).cast("bigint")
    if breaks:
        return (F.length(text) - _count(text, "\n") - (_count(text, "\r\n") / 2).cast("bigint")).cast("bigint")
    return F.length(F.translate(text, "\r\n", "")).cast("bigint")


def word_count(text: Column) -> Column:
    """Runs of characters that aren't white space; \\S is Unicode's notion under (?U), and faster than a class of its own."""
    return F.regexp_count(text, F.lit(r"(?U)\S+")).cast("bigint")


def lines_of(text: Column) -> Column:
    """The lines without their line feeds; nothing for the emptiness after the last one."""
    parts = F.split(text, "\n")
    return F.when((text == "") | (F.right(text, F.lit(1)) == "\n"), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def _quoted(mark: str) -> str:
    return "".join(f"\\x{{{ord(c):02X}}}" for c in mark)


def stateless_code_count(text: Column, style: str) -> Column:
    """Code lines of a style in which every line stands for itself."""
    if style == NO_COMMENTS:
        return F.size(F.filter(lines_of(text), lambda line: line.rlike(INK))).cast("bigint")
    if style == "fortran":
        return F.size(F.filter(lines_of(text), lambda line: line.rlike(INK) & ~line.rlike(f"^(?:[Cc*]|{SPACE}*!)"))).cast("bigint")
    marks, any_case = PREFIXES[style]
    # a mark that ends in white space needs something after it: the line's own end is stripped first
    each = "|".join(_quoted(m) + (f"(?={SPACE}*{INK})" if m[-1].isspace() else "") for m in marks)
    comment = f"^{SPACE}*(?:{each})"
    return F.size(F.filter(lines_of(text), lambda line: ~line.rlike(("(?i)" if any_case else "") + comment))).cast("bigint")


@F.arrow_udf(T.LongType())
def _machine_count(text: pa.Array, ext: pa.Array) -> pa.Array:
    out = []
    for t, e in zip(text.to_pylist(), ext.to_pylist(), strict=True):
        if t is None:
            out.append(None)
        else:
            out.append(machine_for(e or "").count(t))
    return pa.array(out, pa.int64())


@F.arrow_udf(T.ArrayType(T.BooleanType()))
def code_flags(text: pa.Array, ext: pa.Array) -> pa.Array:
    """For each line of each text, whether it is code."""
    out = []
    for t, e in zip(text.to_pylist(), ext.to_pylist(), strict=True):
        out.append(None if t is None else [*map(machine_for(e or "").code, split_lines(t))])
    return pa.array(out, pa.list_(pa.bool_()))


def mapped_ext(ext: Column, mapping: dict[str, str] | None) -> Column:
    """An extension, in the case it has, as the mapping has it."""
    if not mapping:
        return ext
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.element_at(table, ext), ext)


def _style(ext: Column, styles: Iterable[str]) -> Column:
    wanted = set(styles)
    return F.lower(ext).isin(*[e for e, s in STYLES.items() if s in wanted])


def code_count(text: Column, ext: Column | str) -> Column:
    """Code lines by the extension's style. Python runs only for rows whose style needs a machine.

    ext may be a column or one extension for all rows, in which case the plan has just that style.
    """
    if isinstance(ext, str):
        style = STYLES.get(ext.lower(), NO_COMMENTS)
        return stateless_code_count(text, style) if style in STATELESS else _machine_count(text, F.lit(ext))
    # a null argument is cheap to send, so rows of stateless styles cost no Python
    needs = F.lower(ext).isin(*[e for e, s in STYLES.items() if s not in STATELESS])
    out = F.when(needs, _machine_count(F.when(needs, text), ext))
    for style in STATELESS[:-1]:
        out = out.when(_style(ext, [style]), stateless_code_count(text, style))
    return out.otherwise(stateless_code_count(text, NO_COMMENTS))


def chars_by_ext(text: Column, ext: Column | str, newlines: bool = False) -> Column:
    """char_count by the rule of the extension's style."""
    if newlines:
        return char_count(text, newlines=True)
    if isinstance(ext, str):
        return char_count(text, breaks=STYLES.get(ext.lower()) not in NO_BREAKS)
    return F.when(_style(ext, NO_BREAKS), char_count(text, breaks=False)).otherwise(char_count(text))
