"""Poems, lines and tables of evaluation against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from wakloom.functions import respell
from wakloom.functions.phonology import classes, syllable_classes
from wakloom.operators import evaluation, lexicon, meter, segment, structure, validator
from wakloom.sources import files, sinks

POEM = "array<struct<s:array<string>,k:array<string>>>"


def poem(spark, *lines):
    """Syllables by blanks; the key is what stands behind the last '/'."""
    made = [([s.split("/")[0] for s in x.split()], [s.split("/")[-1] for s in x.split()]) for x in lines]
    return spark.createDataFrame([(1, made)], f"i int, p {POEM}")


GOOD8 = ["a b c d e f g h/1", "a b i/1 d e f g j/2", "a b c d e f g k/2", "a b l/2 d e f g m/3"]


def test_sound_poem(spark):
    r = validator.report(poem(spark, *GOOD8), "p").first()
    assert r.messages == [validator.SOUND] and r.verdict == validator.PASS and r.score == 100 and (r.passed_checks, r.total_checks) == (12, 12)
    assert [c.rule for c in r.checks] == [1, 2, 3] and r.checks[0].matched == [3] and r.warnings == []
    assert r.line_reports[0].groups == ["a-b-c", "d-e", "f-g-h"]


def test_messages(spark):
    bad = ["a b c d e f g h/1", "a b i d e f g j/2", "a b c d e f g k/4", "a b l/2 d e f g m/3 n o p q/5"]
    got = validator.report(poem(spark, *bad), "p").first()
    assert got.messages == [
        "Stanza (บทที่) 1 Wak 4: Word count exceeds 10: ['a', 'b', 'l', 'd', 'e', 'f', 'g', 'm', 'n', 'o', 'p', 'q']",
        "Rhyme error in Stanza (บทที่) 1: 'h' (Wak 1) does not rhyme with ['a', 'b', 'i', 'd', 'e'] (Wak 2)",
        "Rhyme error in Stanza (บทที่) 1: 'j' (Wak 2) does not rhyme with 'k' (Wak 3)",
        "Rhyme error in Stanza (บทที่) 1: 'k' (Wak 3) does not rhyme with ['a', 'b', 'l', 'd', 'e'] (Wak 4)",
    ]
    assert got.verdict == validator.FAIL and len(got.warnings) == 2
    two = GOOD8 + ["a b c d e f g h/1", "a b i/1 d e f g j/4", "a b c d e f g k/4", "a b l/4 d e f g m/3"]
    assert validator.report(poem(spark, *two), "p").first().messages == ["Inter-stanza rhyme error (ผิดสัมผัสระหว่างบท) between Stanza 1 and 2: 'm' (Wak 4) does not rhyme with 'j' (Wak 2)"]
    assert validator.report(poem(spark, *GOOD8[:3]), "p").first().messages == [validator.INCOMPLETE]
    assert validator.report(poem(spark, GOOD8[0], "", *GOOD8[2:]), "p").first().messages == ["Stanza (บทที่) 1 contains empty sentences."]
    none = spark.createDataFrame([(1, None), (2, [])], f"i int, p {POEM}")
    assert {r.verdict for r in validator.report(none, "p").collect()} == {validator.FAIL}
    assert validator.report(none, "p", 4).where("messages[0] like 'The poem does not%'").count() == 2
    assert none.select(validator.messages(F.col("p"), 6).alias("m")).first().m == [validator.WRONG_KIND]


def test_klon_of_four(spark):
    four = ["a b c d/1", "a i/1 c j/2", "a b c k/2", "a b l/2 d m/3"]
    r = validator.report(poem(spark, *four), "p", 4).first()
    assert r.messages == [validator.SOUND] and r.verdict == validator.PASS  # of five syllables, three are looked at
    r = validator.report(poem(spark, "a b c d/1", "a b i/1 j/2", "a b c k/2", "a l/2 c m"), "p", 4).first()
    assert r.messages == ["Rhyme error in Stanza (บทที่) 1: 'd' (Wak 1) does not rhyme with ['a', 'b'] (Wak 2)"]


def test_tolerated_place_and_ends(spark):
    soft = ["a b c d e f g h/1", "i/1 b c d e f g j/2", "a b c d e f g k/2", "a b l/2 d e f g m/3"]
    out = validator.report(poem(spark, *soft), "p")
    r = out.select("*", validator.endpoints(F.col("checks")).alias("ends")).first()
    assert r.verdict == validator.REVIEW and r.warnings == ["สัมผัสจากวรรค 1 ไปวรรค 2 อยู่ในตำแหน่งอนุโลม ไม่ใช่ตำแหน่งหลัก 3 หรือ 5"]
    assert [(e.rule, e.target_place) for e in r.ends] == [(1, 1), (2, -1), (3, 3)]


LINE = "array<struct<w:string,n:int,alts:array<int>,pieces:array<struct<w:string,n:int>>>>"


@pytest.mark.parametrize(
    "words, text, kind, rhythm, flags",
    [
        ([("ab", 2), ("c", 1), ("de", 2), ("fgh", 3)], "abc | de | fgh", "body", [3, 2, 3], []),
        ([("ab", 2), ("cd", 2), ("e", 1), ("fgh", 3)], "abcd | e | fgh", "body", [3, 2, 3], ["word straddles a beat boundary"]),
        ([("ab", 2), ("cd", 2, None, [("c", 1), ("d", 1)]), ("e", 1), ("fgh", 3)], "abc | de | fgh", "body", [3, 2, 3], []),
        ([("abcd", 4), ("ef", 2), ("ghi", 3)], "abcd | ef | ghi", "body", [4, 2, 3], []),
        ([("ab", 2), ("cdef", 4), ("ghi", 3)], "abcdefghi", "body", None, ["4-syllable word not at วรรค edge"]),
        ([("abc", 3), ("de", 2), ("fg", 2)], "abc | de | fg", "body", [3, 2, 2], ["7 syllables — ambiguous, [3,2,2] is only a guess"]),
        ([("abc", 3), ("de", 2), ("fg", 1, [1, 3])], "abc | de | fg", "body", [3, 2, 3], ["reading chosen by meter: fg 1->3"]),
        ([("abc", 2, [2, 3]), ("de", 2), ("fg", 1, [1, 3])], "abcdefg", "opener", None, ["opener (<=6 syllables) — short วรรค, expected"]),
        ([("abc", 5), ("de", 5)], "abcde", "irregular", None, ["10 syllables — likely shatter/miscount"]),
    ],
)
def test_line_analysis(spark, words, text, kind, rhythm, flags):
    df = spark.createDataFrame([(1, [(*w, *[None] * (4 - len(w))) for w in words])], f"i int, w {LINE}")
    r = meter.line_analysis(df, "w").first()
    assert (r.segmented, r.kind, r.rhythm, r.flags) == (text, kind, rhythm, flags)
    assert r.needs_review == (bool(flags) and kind != "opener")


def test_line_analysis_of_nothing(spark):
    out = meter.line_analysis(spark.createDataFrame([(1, None), (2, [])], f"i int, w {LINE}"), "w").collect()
    assert {(r.n_syllables, r.kind, r.segmented, r.needs_review) for r in out} == {(0, "opener", "", False)}


def test_counted(spark):
    t = spark.createDataFrame([("ค",), ("สระ",), ("ราช",), ("กา",), ("วจนา",), ("ณ",)], "token string")
    o, g = spark.createDataFrame([("สระ", ["สะ", "หระ"])], "word string, syllables array<string>"), spark.createDataFrame([("ราช", [1, 2]), ("สระ", [1])], "word string, counts array<int>")
    got = {r.token: (r.n, r.origin) for r in meter.counted(t, "token", o, g, ["ณ"]).collect()}
    assert got == {"ค": (1, "orphan"), "สระ": (2, "override"), "ราช": (1, "readings"), "กา": (1, "short"), "วจนา": (None, "none"), "ณ": (1, "short")}


@pytest.mark.parametrize("word, final, weight", [("วุฒิ", "กด", "karu"), ("สมมุติ", "กด", "karu"), ("วิมุติ", "กด", "karu"), ("ธาตุ", "กด", "karu"), ("เมรุ", "กน", "karu"), ("ภูมิ", "กม", "karu"), ("โพธิ", "กด", "karu")])
def test_silent_ends(spark, word, final, weight):
    r = syllable_classes(spark.createDataFrame([(word,)], "w string"), "w").first()
    assert (r.final_class, r.weight) == (final, weight)


def test_compared(spark):
    df = spark.createDataFrame([(["สม", "บ้าน"], ["พาล"]), (["หมาย"], ["พอง"]), ([], ["กา"])], "a array<string>, b array<string>")
    assert [r.rhymes for r in validator.compared(df, "a", "b", classes).collect()] == [True, False, False]


def test_screening(spark):
    alike = lambda a, b: F.translate(a, "่้๊๋", "") == F.translate(b, "่้๊๋", "")
    rows = [
        ("น้ำตา", ["น้าม", "ตา"], ["น้ำ", "ตา"], ["sound mismatch @1 (น้ำ vs น้าม)"]), ("สองค่ำ", ["สอง", "คำม"], ["สอง", "ค่ำ"], ["tone lost 1→0", "redundant ำ+cons @2", "sound mismatch @2 (ค่ำ vs คำม)"]),
        ("ก", ["กะ"], ["ก"], []), ("กลัว", ["กล", "หวัว"], ["กลัว"], ["syllable count differs (ssg 1 vs w2p 2)"]), ("กขค", ["ก", "ข"], ["ก", "ข", "ค"], ["1-char syllable @1 (ก)", "1-char syllable @2 (ข)", "ssg splits more than override (3 vs 2)"]),
        ("ค้าขาย", ["ค่า", "ขาย"], ["ค้า", "ขาย"], ["tone changed @1 (ค้า vs ค่า)"]), ("กากา", ["กา", "กา"], [], []),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "w string, s array<string>, z array<string>")
    got = [r.f for r in df.select(lexicon.screening_flags(F.col("w"), F.col("s"), F.col("z"), alike).alias("f")).collect()]
    assert got == [r[3] for r in rows]
    soft = df.where("w = 'กลัว'").select(lexicon.screening_flags(F.col("w"), F.array(F.lit("กะ"), F.lit("หวัว")), F.col("z"), alike, True).alias("f")).first()
    assert soft.f == []
    fixed = {r.w: (r.x.syllables, r.x.changed) for r in df.select("w", lexicon.fixed_finals(F.col("s"), F.col("z")).alias("x")).collect()}
    assert fixed["น้ำตา"] == (["น้ำ", "ตา"], True) and fixed["กลัว"] == (["กล", "หวัว"], False) and fixed["ก"][1] is False
    better = {r.w: r.x for r in df.select("w", lexicon.prefer_spelled(F.col("s"), F.col("z"), alike).alias("x")).collect()}
    assert better["ค้าขาย"] == ["ค้า", "ขาย"] and better["น้ำตา"] is None and better["กากา"] is None


def test_composed_by_rounds(spark):
    known = spark.createDataFrame([("กา", ["กา"]), ("ดำ", ["ดำ"])], "word string, syllables array<string>")
    words = spark.createDataFrame([("กาดำ", 5), ("กาดำกา", 9), ("ขาว", 2), ("กา", 1)], "word string, freq int")

    def two(left, have):  # of two known words only, so that a round builds on the one before
        a, b = have.select(F.col("word").alias("a"), F.col("syllables").alias("x")), have.select(F.col("word").alias("b"), F.col("syllables").alias("y"))
        return left.join(a, F.startswith("word", "a")).join(b, F.concat("a", "b") == F.col("word")).select("word", F.concat("x", "y").alias("syllables")).dropDuplicates(["word"])

    got = {r.word: (r.syllables, r.round) for r in lexicon.compose_by_rounds(words, known, two).collect()}
    assert got == {"กาดำ": (["กา", "ดำ"], 0), "กาดำกา": (["กา", "ดำ", "กา"], 1)}
    assert lexicon.compose_by_rounds(words.where("word = 'ขาว'"), known, two).count() == 0


def test_normalisation_and_tags(spark):
    df = syllable_classes(spark.createDataFrame([("กัย",), ("ธรรม",), ("กา",), ("ฤทธิ์",), ("ไทย",), ("ตัว",)], "w string"), "w")
    got = {r.w: (r.n, r.t) for r in df.select("w", lexicon.normalisation(F.col("vowel"), F.col("final_class")).alias("n"), lexicon.phenomena(F.col("w"), F.col("vowel"), F.col("final_class"), F.col("rhyme")).alias("t")).collect()}
    assert got == {"กัย": ("N1", ["sara_norm", "true_final"]), "ธรรม": ("N2", ["sara_norm"]), "กา": (None, []), "ฤทธิ์": (None, ["karun", "rue"]), "ไทย": (None, ["true_final"]), "ตัว": (None, ["true_final"])}


def test_evaluation_tables(spark):
    rows = [("a", True, True), ("a", True, None), ("a", False, True), ("b", False, False), ("b", True, False)]
    df = spark.createDataFrame(rows, "op string, gold boolean, pred boolean")
    assert {r.op: (r.n, r.fp, r.fn, r.recall) for r in evaluation.by_operator(df, ["op"]).collect()} == {"a": (3, 1, 1, 0.5), "b": (2, 0, 1, 0.0)}
    counts = evaluation.summary(df, ["op"])
    both = evaluation.merged_counts([counts, counts], ["op"]).where("op = 'a'").first()
    assert (both.tp, both.fp, both.fn, both.dropped, both.precision) == (2, 2, 0, 2, 0.5)
    said = spark.createDataFrame([(1, [validator.SOUND]), (2, ["Rhyme error in Stanza (บทที่) 1: 'h' (Wak 1) does not rhyme with ['a'] (Wak 2)"]), (3, [validator.INCOMPLETE]), (4, ["Inter-stanza rhyme error (ผิดสัมผัสระหว่างบท) between"])], "i int, m array<string>")
    got = {r.i: r.r and tuple(r.r) for r in said.select("i", evaluation.rules_of_messages(F.col("m")).alias("r")).collect()}
    assert got == {1: (True,) * 4, 2: (False, True, True, True), 3: None, 4: (True, True, True, False)}
    assert evaluation.by_operator(df.where("op = 'x'"), ["op"]).count() == 0


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "ipa.txt").write_text("กา\tk aː\n\nวิชา  w i . tɕʰ aː \nlone\n", encoding="utf-8")
    assert {r.word: r.syllables for r in files.sound_list(spark, str(tmp_path / "ipa.txt")).collect()} == {"กา": ["k aː"], "วิชา": ["w i", "tɕʰ aː"]}
    (tmp_path / "i.json").write_text('[{"id": 1, "gold": true}, {"id": 2}]')
    assert {(r.id, r.gold) for r in files.documents_json(spark, str(tmp_path / "i.json"), "id int, gold boolean").collect()} == {(1, True), (2, None)}
    words = spark.createDataFrame([("ก า",), ("า ข",), (None,)], "w string")
    assert {r.syllable for r in files.vocabulary([words, words], "w", lambda c: F.split(c, " ")).collect()} == {"ก", "า", "ข"}
    rep = validator.report(poem(spark, *GOOD8), "p").withColumn("texts", F.transform("p", lambda x: F.array_join(x["s"], "")))
    sinks.write_report(rep, str(tmp_path / "rep"), ["i"], 8)
    back = spark.read.csv(str(tmp_path / "rep"), header=True).orderBy("line").collect()
    assert [(r.line, r.wak_name, r.syllables, r.rhythm, r.status) for r in back][0] == ("1", "วรรคสดับ", "8", "3–2–3", "ผ่าน") and len(back) == 4


def test_swap_that_was_broken_off(spark, tmp_path):
    df = spark.createDataFrame([("ก", 1)], "wak string, n int")
    path = str(tmp_path / "answers")
    assert sinks.save_answers(df.limit(0), df, path, ["wak"]) == 1
    (tmp_path / "answers").rename(tmp_path / "answers.old")  # as after a crash between the two renames
    sinks.restore(spark, path)
    assert spark.read.json(path).count() == 1 and not (tmp_path / "answers.old").exists()


def test_windows_of_three(spark):
    df = spark.createDataFrame([("a", i, i != 3) for i in range(8)] + [("b", i, True) for i in range(3)], "c string, r int, ok boolean")
    got = {(x.c, x.r, tuple(v.r for v in x.v)) for x in structure.sound_windows(df, ["c"], ["r"], F.col("ok"), ["r"], 3).collect()}
    assert got == {("a", 0, (0, 1, 2)), ("a", 4, (4, 5, 6)), ("a", 5, (5, 6, 7)), ("b", 0, (0, 1, 2))}


@pytest.mark.parametrize(
    "ipa, thai",
    [("k aː ˧", "กา"), ("kʰ aː w ˥˩", "ขา้ว"), ("m a j ˥˩", "ไม่"), ("r a k ˦˥", "รัก"), ("l aː ŋ ˨˩", "หลา่ง"), ("s a m ˩˩˦", "สำ"), ("ŋ aː ˩˩˦", "หงา"), ("p l aː ˧", "ปลา"), ("ʔ ɔː k ˨˩", "ออก"), ("tɕ a j ˧", "ไจ"), ("n aː m ˦˥", "นา้ม"), ("tʰ a ʔ ˦˥", "ทะ")],
)
def test_respelled(ipa, thai):
    assert respell.respelled(ipa) == thai


def test_respelled_columns(spark):
    df = spark.createDataFrame([(["k aː ˧", "r a k ˦˥"],), (None,), ([],)], "s array<string>")
    assert [r.t for r in df.select(respell.thai_of(F.col("s")).alias("t")).collect()] == [["กา", "รัก"], None, []]
    said = syllable_classes(spark.createDataFrame([("จาก",), ("ได้",), ("ไป",), ("จะ",), ("ไม่",)], "w string"), "w")
    got = {r.w: r.t for r in said.select("w", respell.tone_name(F.col("w"), respell.is_dead(F.col("vowel"), F.col("final_class"))).alias("t")).collect()}
    assert got == {"จาก": "eak or dead", "ได้": "tou", "ไป": None, "จะ": "eak or dead", "ไม่": "eak or dead"}


def test_overrides_in_tokens():
    known = {"สระ": ["สะ", "หระ"], "กาดำ": ["กา", "ดำ"], "ขาว": ["ขาว"]}
    split = lambda w: w.split(".")
    cut = lambda text, say=None: segment.with_overrides(known, lambda t: t.split("|"), split, say)(text)
    assert cut("ส|ระ") == [("สะ", "override"), ("หระ", "override")]  # joined tokens
    assert cut("กาด|ำมา") == [("กา", "override"), ("ดำ", "override"), ("มา", "spoken")]  # a letter of the next token
    assert cut("ขาว.งา") == [("ขาว", "override"), ("งา", "spoken")] and cut("มา.งา") == [("มา", "spoken"), ("งา", "spoken")]
    said = segment.spoken_by(lambda w: {"เสนา": "เส.-ห.-นา", "ห": "ห"}.get(w), split)
    assert cut("เสนา", said) == [("เส", "spoken"), ("นา", "spoken")] and said("ห") == ["ห"] and said("งา.งา") == ["งา", "งา"]
