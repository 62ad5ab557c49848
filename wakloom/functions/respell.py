"""Syllables of the sound alphabet written in Thai letters.

A syllable is a row of tokens: consonants, vowels, at the end a tone. Its sounds
(onset, nucleus, coda, tone) give the vowel's spelling, and of the letters for
its first consonant the first whose class, with or without a tone mark, gives
the tone. Kernels run on distinct syllables in Arrow batches.

A tone mark stands behind the vowel sign, where the sounds put it.

Defined results: null stays null; a syllable without tokens is read as a lone k
in the middle tone. A nucleus and coda that the table does not know have no
vowel sign and no final. An unknown consonant raises no error: it is left out.
"""

from __future__ import annotations

import unicodedata
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Tones, vowel characters, and the letters of each first consonant with their classes (middle, high, low).
TONES_OF = {"˧": 0, "˨˩": 1, "˥˩": 2, "˦˥": 3, "˩˩˦": 4}
VOWEL_CHARS = "aiɯueɛɔoː"
ONSETS = {
    "k": "กM", "kʰ": "ขH คL", "ŋ": "งL", "tɕ": "จM", "tɕʰ": "ฉH ชL", "s": "สH ซL", "j": "ยL", "d": "ดM", "t": "ตM ทL", "tʰ": "ถH ทL", "n": "นL", "b": "บM",
    "p": "ปM พL", "pʰ": "ผH พL", "f": "ฝH ฟL", "m": "มL", "w": "วL", "l": "ลL", "r": "รL", "h": "หH ฮL", "ʔ": "อM",
}
LED = ("ŋ", "n", "m", "j", "w", "l", "r")  # consonants that ห leads
CODAS = {"k": "ก", "t": "ด", "p": "บ", "ŋ": "ง", "n": "น", "m": "ม", "j": "ย", "w": "ว"}
# Of each nucleus what stands before and behind the consonant, open and closed, and the codas it is known with.
NUCLEI = {
    "a": ("", "ะ", "", "ั", "k t p ŋ n"), "aː": ("", "า", "", "า", "k t p ŋ n m j w"), "i": ("", "ิ", "", "ิ", "k t p n m"), "iː": ("", "ี", "", "ี", "t n"), "ɯ": ("", "ึ", "", "ึ", "k"),
    "u": ("", "ุ", "", "ุ", "k t n"), "uː": ("", "ู", "", "ู", "n"), "e": ("เ", "ะ", "เ", "็", "k p ŋ n"), "eː": ("เ", "", "เ", "", "k t n"), "ɛ": ("แ", "ะ", "แ", "็", "k"), "ɛː": ("แ", "", "แ", "", "k"),
    "o": ("โ", "ะ", "", "", "k t p m n ŋ"), "oː": ("โ", "", "โ", "", "k"), "ɔ": ("เ", "าะ", "", "", ""), "ɔː": ("", "อ", "", "อ", "k t p ŋ n"), "ia": ("เ", "ีย", "เ", "ีย", "n"), "ɯa": ("เ", "ือ", "เ", "ือ", "k ŋ"), "ua": ("", "ัว", "", "ัว", "n"),
}
WHOLE = {("a", "m"): ("", "ำ"), ("a", "j"): ("ไ", ""), ("a", "w"): ("เ", "า")}  # vowels whose sign holds the coda
MARKS = ("่", "้", "๊", "๋")


class Vowel(NamedTuple):
    before: str
    behind: str
    final: str
    live: bool
    short_dead: bool


def plain(token: str) -> str:
    """A token without combining marks and the small schwa."""
    return "".join(c for c in token if unicodedata.category(c) != "Mn" and c != "ᵊ")


def parted(token: str) -> tuple[str, str]:
    """(consonants, vowels) of a token."""
    return "".join(c for c in token if c not in VOWEL_CHARS), "".join(c for c in token if c in VOWEL_CHARS)


def sounds(syllable: str) -> tuple[list[str], str, str | None, int]:
    """(onset, nucleus, coda, tone). A glottal stop behind the vowel is no coda."""
    tokens = [t for t in map(plain, syllable.split()) if t]
    tone = TONES_OF.get(tokens[-1]) if tokens else None
    onset: list[str] = []
    nucleus, coda = "", None
    for t in tokens if tone is None else tokens[:-1]:
        consonant, vowel = parted(t)
        first = consonant and t[0] not in VOWEL_CHARS
        if consonant and (first if vowel else not nucleus):
            onset.append(consonant)
        elif consonant:
            coda = consonant
        nucleus += vowel
    return onset or ["ʔ" if nucleus else "k"], nucleus, None if coda == "ʔ" else coda, tone or 0


def vowel_of(nucleus: str, coda: str | None) -> Vowel:
    if (nucleus, coda) in WHOLE:
        return Vowel(*WHOLE[nucleus, coda], "", True, False)
    if nucleus == "ɯː":
        return Vowel("", "ื", "", True, False)
    before, behind, before_closed, behind_closed, codas = NUCLEI.get(nucleus, ("", "", "", "", ""))
    short = len(nucleus) == 1
    if coda is None:
        return Vowel(before, behind, "", not short, short)
    if coda not in codas.split():
        return Vowel("", "", "", True, False)
    live = coda not in ("k", "t", "p")
    return Vowel(before_closed, behind_closed, CODAS[coda], live, not live and (short or nucleus == "ɯa"))


def tone_of(kind: str, live: bool, short_dead: bool, mark: str | None) -> int:
    """The tone that a letter's class (M, H, L), the kind of syllable and a mark give."""
    if mark is not None:
        return {"่": {"L": 2}, "้": {"M": 2, "H": 2, "L": 3}, "๊": dict.fromkeys("MHL", 3), "๋": dict.fromkeys("MHL", 4)}[mark].get(kind, 1)
    if live:
        return 4 if kind == "H" else 0
    return (3 if short_dead else 2) if kind == "L" else 1


def respelled(syllable: str) -> str:
    onset, nucleus, coda, tone = sounds(syllable)
    v = vowel_of(nucleus, coda)
    letters = lambda p: [(x[0], x[1]) for x in ONSETS.get(p, "").split()]
    cluster = "".join(letters(p)[0][0] for p in onset[1:] if letters(p))
    own = letters(onset[0])
    gives = lambda kind, marks: next((m for m in marks if tone_of(kind, v.live, v.short_dead, m) == tone), "")
    if onset[0] in LED and (tone == 4 or tone == 1):
        head, mark = "ห" + own[0][0], "่" if tone == 1 and v.live else None
    elif onset[0] in LED:
        head, mark = own[0][0], gives("L", (None, *MARKS)) or None
    else:
        tries = [(c, None) for c, kind in own if gives(kind, (None,)) is None] + [(c, gives(kind, MARKS)) for c, kind in own if gives(kind, MARKS)]
        head, mark = (tries or [(own[0][0] if own else "", None)])[0]
    return v.before + head + cluster + v.behind + (mark or "") + v.final


def thai_of(column: Column) -> Column:
    """Arrays of syllables of the sound alphabet as arrays of Thai spellings; each distinct one of a batch once."""

    @F.arrow_udf("array<string>")
    def spell(col: pa.Array) -> pa.Array:
        col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
        coded = col.values[col.offsets[0].as_py() : col.offsets[len(col)].as_py()].dictionary_encode()
        words = pa.array([None if x is None else respelled(x) for x in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
        ends = col.offsets.to_pylist()
        first = ends[0]
        return pa.array([words[a - first : b - first].to_pylist() if ok else None for ok, a, b in zip(col.is_valid().to_pylist(), ends, ends[1:], strict=False)], pa.list_(pa.string()))

    return spell(column)


def tone_name(c: Column, dead: Column) -> Column:
    """'eak or dead', 'tou' or null of a syllable; dead: whether it is a dead one."""
    return F.when(c.contains("่") | dead, "eak or dead").when(c.contains("้"), "tou")


def is_dead(vowel: Column, final_class: Column) -> Column:
    """A syllable stopped short: by a final of ก, ด or บ, or a short vowel without a final."""
    short = vowel.isin("อะ", "อิ", "อึ", "อุ", "เอะ", "แอะ", "โอะ", "เอาะ", "เออะ")
    return final_class.isin("กก", "กด", "กบ") | ((final_class == "กา") & short)
