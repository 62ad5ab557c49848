"""Column functions for verse text. All stay in the JVM and in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONSONANT = "[ก-ฮ]"
TONES = "่้๊๋"
EDGE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without blanks of any kind at the ends."""
    return F.regexp_replace(col(c), f"^{EDGE}+|{EDGE}+$", "")


def has_consonant(c: Column | str) -> Column:
    return col(c).rlike(CONSONANT)


def without_tones(c: Column | str) -> Column:
    return F.translate(col(c), TONES, "")


def clean_letters(c: Column | str) -> Column:
    """Only the signs a syllable is written with."""
    return F.regexp_replace(col(c), "[^ก-ฮ่้๊๋ะาิีึืุูเแโใไัำ็์ฺๅๆ]", "")


def thai_only(c: Column | str) -> Column:
    """Thai block, line feeds and tabs; a tab becomes four blanks."""
    return F.replace(F.regexp_replace(col(c), "[^฀-๿\n\t]", ""), F.lit("\t"), F.lit("    "))


def lines_of_chapter(c: Column | str) -> Column:
    """A chapter's cells between tabs and line ends, anchors and end marks included."""
    return F.split(col(c), "[\t\r\n]+")


def lines_of_poem(c: Column | str) -> Column:
    """Lines of a typed poem: by strong separators; by blanks too where those give no multiple of four."""
    text = col(c)
    full = lambda pattern: F.filter(F.transform(F.split(text, pattern), strip), lambda x: x != "")
    strong, spaced = full(r"[,\r\n;:|/\\•]+"), full(r"[,\r\n;:|/\\•\s]+")
    fits = (F.size(strong) >= 4) & (F.size(strong) % 4 == 0)
    return F.when(fits, strong).when(F.size(spaced) > 0, spaced).otherwise(strong)


def lines_of_editor(c: Column | str) -> Column:
    """Lines of an editor: by line ends only, empty ones left out."""
    return F.filter(F.transform(F.split(col(c), "\r\n?|\n"), strip), lambda x: x != "")


def html_escaped(c: Column | str) -> Column:
    out = col(c)
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def find_from(c: Column | str, part: str, start: int) -> Column:
    """The first place of part at start or behind it, from 1; 0 where there is none."""
    return F.locate(part, col(c), start)


def words_of(c: Column | str) -> Column:
    return F.filter(F.split(col(c), r"\s+"), lambda x: x != "")


def replace_suffix(c: Column | str, old: Column | str, new: Column | str) -> Column:
    """new in place of old where the text ends with old; else the text as it is."""
    text, old, new = col(c), col(old), col(new)
    return F.when(F.endswith(text, old), F.concat(F.left(text, F.length(text) - F.length(old)), new)).otherwise(text)


def context(text: Column | str, part: Column | str, before: int = 8, after: int = 10) -> Column:
    """What stands around the first place of part, on one line; null where it doesn't stand."""
    text, part = col(text), col(part)
    at = F.locate(part, text) if isinstance(part, str) else F.instr(text, part)
    begin = F.greatest(F.lit(1), at - before)
    return F.when(at > 0, F.replace(F.substr(text, begin, at - begin + F.length(part) + after), F.lit("\n"), F.lit("¦")))


def cells(c: Column | str, n: int = 3) -> Column:
    """An array padded with empty strings, or cut, to n."""
    return F.slice(F.concat(col(c), F.array_repeat(F.lit(""), n)), 1, n)


def fit_slots(c: Column | str, n: int) -> Column:
    """An array in n slots: what is over is joined into the last."""
    a = col(c)
    return F.when(F.size(a) <= n, a).otherwise(F.concat(F.slice(a, 1, n - 1), F.array(F.array_join(F.slice(a, n, F.greatest(F.size(a), F.lit(1))), ""))))


def number_in(c: Column | str) -> Column:
    """The first number in a name, for numeric order of chapters."""
    return F.regexp_extract(col(c), r"(\d+)", 1).try_cast("int") if hasattr(Column, "try_cast") else F.expr("null")


def work_of(c: Column | str) -> Column:
    """A chapter's name without its number."""
    return F.regexp_replace(col(c), r"_\d+$", "")


def spelling_flags(c: Column | str) -> Column:
    """Marks of a word that wants a look: clusters, rare vowels, silent ends, finals written twice."""
    w = col(c)
    tests = {"cluster": "[ก-ฮ][รล]", "rare_vowel": "[ฤฦ]", "silent_end": "[ก-ฮ][่-๋]?์$", "double_final": "ำ[ก-ฮ]$|[ก-ฮ][ใไ]ย$|เ[ก-ฮ]าว$"}
    return F.array_compact(F.array(*[F.when(w.rlike(p), F.lit(k)) for k, p in tests.items()]))
