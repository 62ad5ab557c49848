"""Whole poems held against the rules: messages, checks one by one, and a report.

A poem is an array of lines (wak), a line struct(s, k): its syllables and their
rhyme keys, place by place. Kinds are klon of eight and of four. All is column
expressions over the arrays; a poem stays in its row.

Defined results: null and empty poems have no lines and are incomplete. A line
without syllables makes its stanza empty: one message, no further checks. A
null key rhymes with nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = (4, 8)
# What the validator says.
SOUND = "The poem is correct according to the principle."
WRONG_KIND = "Something went wrong. Make sure you enter it in the correct form (k_type 4 or 8)."
INCOMPLETE = "The poem does not have complete stanzas (บท). A stanza must contain exactly 4 sentences (วรรค)."
# What the report says of such messages, in the order in which they are looked for.
_HUMAN = {
    "Word count exceeds": "KhaveeVerifier พบวรรคที่มีจำนวนหน่วยคำเกินขีดจำกัด",
    "Inter-stanza rhyme error": "KhaveeVerifier พบสัมผัสระหว่างบทที่ไม่ตรงตามกฎ",
    "Rhyme error": "KhaveeVerifier พบตำแหน่งสัมผัสที่ไม่ตรงตามกฎ",
    "complete stanzas": "KhaveeVerifier พบว่าจำนวนวรรคไม่ครบบท",
}
_HUMAN_ELSE = "KhaveeVerifier พบข้อสังเกตที่ควรตรวจสอบ"
# Names of the four checks, verdicts, and warnings of the report.
CHECKS = ("ท้ายวรรคสดับ → พยางค์ต้นของวรรครับ", "ท้ายวรรครับ → ท้ายวรรครอง", "ท้ายวรรครอง → พยางค์ต้นของวรรคส่ง", "ท้ายวรรคส่งบทก่อน → ท้ายวรรครับบทถัดไป")
PASS, REVIEW, FAIL = "ผ่าน", "ควรตรวจ", "ไม่ผ่าน"
_NOT_WHOLE = "กลอนหนึ่งบทต้องมี 4 วรรค กรุณาใส่หนึ่งวรรคต่อหนึ่งบรรทัด"


def _last(a: Column) -> Column:
    return F.try_element_at(a, F.lit(-1))


def _listed(a: Column) -> Column:
    """An array as the messages write it."""
    return F.when(F.size(a) == 0, F.lit("[]")).otherwise(F.concat(F.lit("['"), F.array_join(a, "', '"), F.lit("']")))


def most_words(kind: int) -> int:
    return 10 if kind == 8 else 5


def reach(line: Column, kind: int) -> Column:
    """How many first syllables of a line the line before may rhyme with."""
    return F.lit(5) if kind == 8 else F.when(F.size(line["s"]) == 5, 3).otherwise(2)


def _head(line: Column, part: str, kind: int) -> Column:
    return F.slice(line[part], 1, reach(line, kind))


def _same(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


def _among(key: Column, keys: Column) -> Column:
    return F.coalesce(F.exists(keys, lambda k: _same(k, key)), F.lit(False))


def _stanzas(lines: Column) -> Column:
    """Numbers of the whole stanzas, from 0."""
    n = F.floor(F.size(lines) / 4).cast("int")
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _line(lines: Column, i: Column, j: int) -> Column:
    return F.get(lines, i * 4 + F.lit(j))


def _full(*lines: Column) -> Column:
    out = F.lit(True)
    for x in lines:
        out = out & F.coalesce(F.size(x["s"]) > 0, F.lit(False))
    return out


def _stanza_messages(lines: Column, i: Column, kind: int) -> Column:
    w = [_line(lines, i, j) for j in range(4)]
    number, names = (i + 1).cast("string"), [f"Wak {j}" for j in (1, 2, 3, 4)]
    most = most_words(kind)
    long = [F.when(F.size(x["s"]) > most, F.concat(F.lit("Stanza (บทที่) "), number, F.lit(f" {n}: Word count exceeds {most}: "), _listed(x["s"]))) for x, n in zip(w, names, strict=True)]

    def off(a: int, b: int, told: Column, ok: Column) -> Column:
        text = F.concat(F.lit("Rhyme error in Stanza (บทที่) "), number, F.lit(": '"), _last(w[a]["s"]), F.lit(f"' ({names[a]}) does not rhyme with "), told, F.lit(f" ({names[b]})"))
        return F.when(~ok, text)

    quoted = lambda x: F.concat(F.lit("'"), x, F.lit("'"))
    head = lambda a, b: off(a, b, _listed(_head(w[b], "s", kind)), _among(_last(w[a]["k"]), _head(w[b], "k", kind)))
    before = F.get(lines, i * 4 - 1)
    between = F.concat(
        F.lit("Inter-stanza rhyme error (ผิดสัมผัสระหว่างบท) between Stanza "), i.cast("string"), F.lit(" and "), number, F.lit(": "),
        quoted(_last(before["s"])), F.lit(f" ({names[3]}) does not rhyme with "), quoted(_last(w[1]["s"])), F.lit(f" ({names[1]})"),
    )
    found = F.array(
        *long, head(0, 1), off(1, 2, quoted(_last(w[2]["s"])), _same(_last(w[1]["k"]), _last(w[2]["k"]))), head(2, 3),
        F.when((i > 0) & ~_same(_last(before["k"]), _last(w[1]["k"])), F.coalesce(between, F.lit("Inter-stanza rhyme error (ผิดสัมผัสระหว่างบท): empty line before"))),
    )
    return F.when(_full(*w), F.array_compact(found)).otherwise(F.array(F.concat(F.lit("Stanza (บทที่) "), number, F.lit(" contains empty sentences."))))


def messages(lines: Column, kind: int = 8) -> Column:
    """All that is wrong, stanza by stanza; SOUND alone if nothing is."""
    if kind not in KINDS:
        return F.array(F.lit(WRONG_KIND))
    whole = F.coalesce((F.size(lines) > 0) & (F.size(lines) % 4 == 0), F.lit(False))
    found = F.flatten(F.transform(_stanzas(lines), lambda i: _stanza_messages(lines, i, kind)))
    return F.when(~whole, F.array(F.lit(INCOMPLETE))).when(F.size(found) == 0, F.array(F.lit(SOUND))).otherwise(found)


def rhyme_checks(lines: Column, kind: int = 8) -> Column:
    """Every check of whole, filled stanzas: rule (place in CHECKS, from 1), source_line, target_line, source, candidates, matched, passed, preferred.

    candidates are the syllables looked at, matched their places from 1;
    preferred: a match at place 3 or 5 (klon of four: at any), true for checks
    of two line ends.
    """
    good = F.array(F.lit(3), F.lit(5))

    def check(rule: int, a: Column, b: Column, source: Column, target: Column, ends: bool) -> Column:
        names, keys = (F.array(_last(target["s"])), F.array(_last(target["k"]))) if ends else (_head(target, "s", kind), _head(target, "k", kind))
        key = _last(source["k"])
        matched = F.filter(F.transform(keys, lambda k, p: F.when(_same(k, key), p + 1)), lambda p: p.isNotNull())
        preferred = F.lit(True) if ends else (F.arrays_overlap(matched, good) if kind == 8 else F.size(matched) > 0)
        return F.struct(
            F.lit(rule).alias("rule"), a.alias("source_line"), b.alias("target_line"), _last(source["s"]).alias("source"), names.alias("candidates"),
            matched.alias("matched"), (F.size(matched) > 0).alias("passed"), preferred.alias("preferred"),
        )

    def of_stanza(i: Column) -> Column:
        w, at = [_line(lines, i, j) for j in range(4)], [i * 4 + j + 1 for j in range(4)]
        before = F.get(lines, i * 4 - 1)
        four = [check(1, at[0], at[1], w[0], w[1], False), check(2, at[1], at[2], w[1], w[2], True), check(3, at[2], at[3], w[2], w[3], False)]
        more = F.when((i > 0) & _full(before), F.array(check(4, i * 4, at[1], before, w[1], True))).otherwise(F.slice(F.array(four[1]), 1, 0))
        return F.when(_full(*w), F.concat(F.array(*four), more)).otherwise(F.slice(F.array(four[1]), 1, 0))

    return F.flatten(F.transform(_stanzas(lines), of_stanza))


def rhythm(n: Column, kind: int = 8) -> Column:
    """The beats of a line of n syllables; null where none fits."""
    table = {8: {7: (3, 2, 2), 8: (3, 2, 3), 9: (3, 3, 3)}, 4: {4: (2, 2), 5: (2, 3)}}[kind]
    out = F.lit(None).cast("array<int>")
    for size, beats in table.items():
        out = F.when(n == size, F.array(*[F.lit(b) for b in beats])).otherwise(out)
    return out


def beat_groups(syllables: Column, beats: Column) -> Column:
    """Syllables joined beat by beat; what is left over is one more group, without beats all is one."""
    ends = F.transform(beats, lambda _, i: F.aggregate(F.slice(beats, 1, i + 1), F.lit(0), lambda a, b: a + b))
    parts = F.transform(beats, lambda b, i: F.array_join(F.slice(syllables, F.get(ends, i) - b + 1, b), "-"))
    used = F.try_element_at(ends, F.lit(-1))
    rest = F.when(F.size(syllables) > used, F.concat(parts, F.array(F.array_join(F.slice(syllables, used + 1, F.size(syllables)), "-")))).otherwise(parts)
    alone = F.when(F.size(syllables) > 0, F.array(F.array_join(syllables, "-"))).otherwise(F.array().cast("array<string>"))
    return F.when(beats.isNull(), alone).otherwise(rest)


def line_reports(lines: Column, kind: int = 8) -> Column:
    """For each line: n_syllables, rhythm, groups, meter_passed, words_passed, status."""

    def one(x: Column) -> Column:
        n = F.coalesce(F.size(x["s"]), F.lit(0))
        beats = rhythm(n, kind)
        words = (n > 0) & (n <= most_words(kind))
        return F.struct(
            n.alias("n_syllables"), beats.alias("rhythm"), beat_groups(F.coalesce(x["s"], F.array().cast("array<string>")), beats).alias("groups"),
            beats.isNotNull().alias("meter_passed"), words.alias("words_passed"), F.when(beats.isNotNull() & words, PASS).otherwise(FAIL).alias("status"),
        )

    return F.transform(lines, one)


def humanised(found: Column) -> Column:
    """Messages in the report's words, each kind once, in the order of their first."""

    def one(m: Column) -> Column:
        out = F.lit(_HUMAN_ELSE)
        for part, text in reversed(_HUMAN.items()):
            out = F.when(m.contains(part), text).otherwise(out)
        return out

    return F.array_distinct(F.transform(found, one))


def report(df: DataFrame, lines: str, kind: int = 8) -> DataFrame:
    """df with messages, line_reports, checks, complete, passed_checks, total_checks, score, verdict and warnings of a poem.

    score: per cent of checks passed, halves to the even number. The verdict is
    FAIL where anything fails, REVIEW where only a rhyme stands at a place that
    is but tolerated.
    """
    p = F.coalesce(F.col(lines), F.array().cast(df.schema[lines].dataType))
    out = df.withColumns({"messages": messages(p, kind), "line_reports": line_reports(p, kind), "checks": rhyme_checks(p, kind), "complete": (F.size(p) > 0) & (F.size(p) % 4 == 0)})
    count = lambda a, ok: F.size(F.filter(a, ok))
    r, c = F.col("line_reports"), F.col("checks")
    out = out.withColumns({
        "passed_checks": count(r, lambda x: x["meter_passed"]) + count(r, lambda x: x["words_passed"]) + count(c, lambda x: x["passed"]) + F.col("complete").cast("int"),
        "total_checks": 2 * F.size(r) + F.size(c) + 1,
    })
    out = out.withColumn("score", F.bround(100 * F.col("passed_checks") / F.col("total_checks")).cast("int"))
    sound = F.col("messages") == F.array(F.lit(SOUND))
    lenient = lambda x: F.concat(F.lit("สัมผัสจากวรรค "), x["source_line"].cast("string"), F.lit(" ไปวรรค "), x["target_line"].cast("string"), F.lit(" อยู่ในตำแหน่งอนุโลม ไม่ใช่ตำแหน่งหลัก 3 หรือ 5"))
    soft = F.transform(F.filter(c, lambda x: x["passed"] & ~x["preferred"]), lenient) if kind == 8 else F.array().cast("array<string>")
    hard = F.when(sound | (F.size(r) == 0), F.array().cast("array<string>")).otherwise(humanised(F.col("messages")))
    whole = F.when(F.col("complete"), F.array().cast("array<string>")).otherwise(F.array(F.lit(_NOT_WHOLE)))
    failed = (F.col("passed_checks") < F.col("total_checks")) | ~sound
    return out.withColumn("warnings", F.array_distinct(F.concat(whole, soft, hard))).withColumn("verdict", F.when(failed, FAIL).when(F.size("warnings") > 0, REVIEW).otherwise(PASS))


def endpoints(checks: Column) -> Column:
    """What a drawing of the checks needs: line and place of both ends. A failed check points to place 3, or the first candidate."""

    def one(x: Column) -> Column:
        ends = x["rule"].isin(2, 4)
        place = F.when(x["passed"], F.get(x["matched"], F.lit(0))).otherwise(F.when(F.size(x["candidates"]) >= 3, 3).otherwise(1))
        return F.struct(x["rule"].alias("rule"), x["source_line"].alias("source_line"), x["target_line"].alias("target_line"), F.when(ends, -1).otherwise(place).alias("target_place"), x["passed"].alias("passed"))

    return F.transform(checks, one)


def compared(df: DataFrame, first: str, second: str, kernel) -> DataFrame:
    """df with rhymes and the classes of both: the last syllables of two words. kernel: classes of a syllable column, as a struct."""
    a, b = kernel(_last(F.col(first))), kernel(_last(F.col(second)))
    return df.withColumns({"first_sound": a, "second_sound": b}).withColumn("rhymes", _same(F.col("first_sound.rhyme"), F.col("second_sound.rhyme")))
