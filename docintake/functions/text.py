"""Text helpers as Column expressions."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def filled(c: Column) -> Column:
    """Null for null and the empty string."""
    return F.nullif(c, F.lit(""))


def clip(c: Column, n: int, marker: str = "") -> Column:
    """The first ``n`` characters, with ``marker`` where something was cut."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(marker))).otherwise(c)


def squeeze(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


#: Unicode white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column | str) -> Column:
    """Without white space at the ends, line breaks included."""
    return F.trim(c, F.lit(WHITE))


def collapse_blank_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def ordered_distinct(c: Column) -> Column:
    return F.array_distinct(c)


def half_even(c: Column) -> Column:
    """Rounds halves to even, to a whole number."""
    return F.bround(c).cast("bigint")


def hash_id(c: Column, n: int = 16) -> Column:
    """The first ``n`` hexadecimal digits of the SHA-256."""
    return F.substring(F.sha2(c, 256), 1, n)


def braces_balanced(c: Column) -> Column:
    """Are braces balanced, escaped ones left out? A closing brace too many is never made good."""
    chars = F.split(F.regexp_replace(F.regexp_replace(c, r"(?s)\\.", ""), r"[^{}]+", ""), "")
    first = F.struct(F.lit(0).alias("depth"), F.lit(True).alias("ok"))

    def step(acc: Column, x: Column) -> Column:
        depth = acc["depth"] + F.when(x == "{", 1).when(x == "}", -1).otherwise(0)
        return F.struct(depth.alias("depth"), (acc["ok"] & (depth >= 0)).alias("ok"))

    end = F.aggregate(chars, first, step)
    return end["ok"] & (end["depth"] == 0)


#: What HTML reads as a character reference: numbers, or up to 32 characters that may begin with a name.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


@lru_cache(maxsize=1)
def _names() -> tuple[str, str, int]:
    """The named references of HTML5 as JSON, by first letter (a map is searched from end to end); those that need no
    semicolon; and the longest of these."""
    from html.entities import html5

    by_letter: dict[str, dict[str, str]] = {}
    for name, char in html5.items():
        by_letter.setdefault(name[0], {})[name] = char
    bare = {n: c for n, c in html5.items() if not n.endswith(";")}
    return json.dumps(by_letter), json.dumps(bare), max(map(len, bare))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)``, with ``value`` computed once however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), 0)


def _character(n: Column) -> Column:
    """The character of a code point, as HTML reads numbers: those of Windows' Latin page in place of C1 controls, the
    replacement character for what is none, and nothing for other controls and noncharacters."""
    latin = "".join(bytes([k]).decode("cp1252") if k not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(k) for k in range(0x80, 0xA0))
    gone = n.between(0x1, 0x8) | n.between(0xE, 0x1F) | n.isin(0xB, 0x7F) | n.between(0xFDD0, 0xFDEF) | ((n % 0x10000) >= 0xFFFE)
    wide = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    none = (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
    return F.when(none, "\ufffd").when(n.between(0x80, 0x9F), F.substring(F.lit(latin), (n - 0x7F).cast("int"), F.lit(1))).when(gone, "").otherwise(wide)


def _reference(x: Column) -> Column:
    """One reference decoded, or as it stands."""
    names, bare, longest = _names()
    names, bare = F.from_json(F.lit(names), "map<string,map<string,string>>"), F.from_json(F.lit(bare), "map<string,string>")
    s = F.substring(x, F.lit(2), F.length(x))
    digits = F.regexp_extract(s, "^#(?:[xX]0*)?0*([0-9a-fA-F]*)", 1)
    number = F.when(F.length(digits) > 8, F.lit(1 << 40)).otherwise(F.conv(F.when(digits == "", "0").otherwise(digits), 10, 10).cast("bigint"))
    hexed = F.when(F.length(digits) > 8, F.lit(1 << 40)).otherwise(F.conv(F.when(digits == "", "0").otherwise(digits), 16, 10).cast("bigint"))
    whole = F.try_element_at(F.try_element_at(names, F.substring(s, 1, 1)), s)
    begins = [F.concat(F.try_element_at(bare, F.substring(s, 1, k)), F.substring(s, F.lit(k + 1), F.length(s))) for k in range(longest, 1, -1)]
    named = F.coalesce(whole, *begins, x)
    return F.when(s.rlike("^#[xX]"), once(hexed, _character)).when(s.startswith("#"), once(number, _character)).otherwise(named)


def entity_decode(c: Column) -> Column:
    """Character references of HTML, named and numeric, with or without a semicolon, decoded up to three times."""
    parts = lambda x: F.split(F.regexp_replace(x, f"({REFERENCE})", "\x1e$1\x1e"), "\x1e")
    decoded = lambda x: F.array_join(F.transform(parts(x), lambda p, i: F.when(i % 2 == 1, _reference(p)).otherwise(p)), "")
    for _ in range(3):
        c = once(c, lambda x: F.when(x.contains("&"), decoded(x)).otherwise(x))
    return c


# ---------------------------------------------------------------- braces of any depth
#
# Regular expressions can't count, so every pair of braces is first marked with its height (0 for a pair without pairs
# inside), one pass of innermost pairs per height: ``{`` and ``}`` become LEVEL[h] OPEN ... CLOSE LEVEL[h]. Between the
# marks of a pair there are only lower ones, so the first mark of the same height ends it, and an argument of any depth
# is one regular expression (``ARGUMENT``). All marks lie in a private area of Unicode; a marked text begins with one.

OPEN, CLOSE, _LEFT, _RIGHT, _DOUBLE, _BEGIN = map(chr, range(0xF0001, 0xF0007))
LEVELS = "".join(map(chr, range(0xF0100, 0xF0300)))
_MARKS = r"[\x{F0000}-\x{F02FF}]"
#: An argument in marked braces: ``lv`` is its height, ``a`` its content without white space at the ends.
ARGUMENT = rf"\s*(?<lv>[\x{{F0100}}-\x{{F02FF}}]){OPEN}(?s:\s*(?<a>.*?)\s*){CLOSE}\k<lv>"


def brace_height(c: Column) -> Column:
    """The deepest nesting of braces, closing ones too many left out."""
    chars = F.split(F.regexp_replace(c, r"[^{}]+", ""), "")
    first = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("most"))

    def step(acc: Column, x: Column) -> Column:
        depth = F.greatest(acc["depth"] + F.when(x == "{", 1).when(x == "}", -1).otherwise(0), F.lit(0))
        return F.struct(depth.alias("depth"), F.greatest(acc["most"], depth).alias("most"))

    return F.aggregate(chars, first, step)["most"]


def mark_braces(c: Column) -> Column:
    """``c`` with each pair of braces marked by its height. Escaped braces, and those without a partner, stay plain, as
    do pairs higher than there are levels; a text that holds characters of the marks' area stays as it is."""

    def bare(x: Column) -> Column:
        for old, new in (("\\\\", _DOUBLE), ("\\{", _LEFT), ("\\}", _RIGHT), (_DOUBLE, "\\\\")):
            x = F.replace(x, F.lit(old), F.lit(new))
        return x

    level = lambda k: F.substring(F.lit(LEVELS), k + 1, F.lit(1))
    heights = lambda x: F.sequence(F.lit(1), F.least(brace_height(x), F.lit(len(LEVELS))))
    step = lambda acc, k: F.regexp_replace(acc, F.lit(r"\{([^{}]*)\}"), F.concat(level(k - 1), F.lit(f"{OPEN}$1{CLOSE}"), level(k - 1)))
    marked = lambda x: once(bare(x), lambda b: F.when(brace_height(b) > 0, F.aggregate(heights(b), b, step)).otherwise(b))
    return once(c, lambda x: F.when(x.contains("{") & ~x.rlike(_MARKS), F.concat(F.lit(_BEGIN), marked(x))).otherwise(x))


def unmark_braces(c: Column) -> Column:
    plain = lambda x: F.replace(F.replace(F.translate(x, OPEN + CLOSE + _BEGIN + LEVELS, "{}"), F.lit(_LEFT), F.lit("\\{")), F.lit(_RIGHT), F.lit("\\}"))
    return once(c, lambda x: F.when(x.startswith(_BEGIN), plain(x)).otherwise(x))


def replace_command(marked: Column, name: str, new: Callable[[Column], Column]) -> Column:
    r"""Marked text with each ``\\name`` and its argument replaced by ``new(content)``, a marked Column; a command without
    argument stays. What stands in a content is left to ``new``."""
    call = rf"\\{name}(?![A-Za-z]){ARGUMENT}"
    parts = lambda x: F.split(F.regexp_replace(x, f"({call})", "\x1e$1\x1e"), "\x1e")
    content = lambda x: F.regexp_extract(x, f"^{call}$", 2)
    done = lambda m: F.array_join(F.transform(parts(m), lambda x, i: F.when(i % 2 == 1, new(content(x))).otherwise(x)), "")
    return once(marked, lambda m: F.when(m.contains(f"\\{name}"), done(m)).otherwise(m))
