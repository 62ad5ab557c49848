import json
import math

import pytest
from pyspark.sql import functions as F

from wakloom.functions import text as X
from wakloom.functions.phonology import syllable_classes
from wakloom.operators import augment, dictionary, meter, metrics, ranking, rhymes, segment, structure
from wakloom.operators.memo import once_per_value

CLASSES = {
    "เลย": "เออ เกย", "พวก": "อัว กก", "เจ็ด": "เอะ กด", "แข็ง": "แอะ กง", "ก็": "เอาะ กา", "พาล": "อา กน", "ไกล": "ไอ กา", "ไกว": "ไอ กา", "โปร": "โอ กา", "เริง": "เออ กง", "สาว": "อา เกอว", "ทำ": "อำ กา",
    "ควร": "อัว กน", "เสือ": "เอือ กา", "เรียน": "เอีย กน", "โต๊ะ": "โอะ กา", "พร": "ออ กน", "นม": "โอะ กม", "ฤทธิ์": "อิ กด", "กรรม": "อำ กม", "สรร": "อะ กน", "บ่": "ออ กา", "ณ": "อะ กา", "มือ": "อือ กา", "น้ำ": "อำ กา",
    "ชาติ": "อา กด", "จันทร์": "อะ กน", "เกาะ": "เอาะ กา", "เมา": "เอา กา", "เออะ": "เออะ กา", "ตัว": "อัว กา", "เขว": "เอ กา", "เลว": "เอ เกอว", "เพล": "เอ กน", "บุตร": "อุ กด", "มังกร": "อะ กน", "จักร": "อะ กก", "ศาสตร์": "อา กด",
}


def test_classes(spark):
    df = spark.createDataFrame([(w,) for w in CLASSES] + [("",), (None,), ("์",)], "w string")
    got = {r.w: r for r in syllable_classes(df, "w").collect()}
    assert {w: f"{got[w].vowel} {got[w].final_class}" for w in CLASSES} == CLASSES
    assert (got[""].vowel, got[""].final_class, got[""].rhyme, got[""].weight) == ("", "", None, None)
    assert got[None].vowel is None and got[None].final_class is None and got[None].rhyme is None
    assert got["บ่"].weight == "lahu" and got["บ่"].tone == "aek" and got["น้ำ"].tone == "too" and got["พาล"].weight == "karu"


@pytest.mark.parametrize(
    "a, b, same",
    [("บ้าน", "พาล", 1), ("ธรรม", "สัม", 1), ("ธรรม", "จำ", 1), ("กัย", "ไก", 1), ("ใจ", "ไทย", 1), ("สรร", "อัน", 1), ("จำ", "กรรม", 1), ("หมาย", "พอง", 0), ("เพชร", "เพ็ด", 0), ("ศัตรู", "ครู", 0), ("กษัตรี", "ตรี", 0)],
)
def test_rhymes(spark, a, b, same):
    x, y = (r.rhyme for r in syllable_classes(spark.createDataFrame([(0, a), (1, b)], "i int, w string"), "w").orderBy("i").collect())
    assert (x == y) == bool(same)


def test_once_per_value(spark):
    df = spark.createDataFrame([(1, "ก"), (2, "ก"), (3, None)], "i int, w string")
    out = once_per_value(df, "w", lambda d, c: d.withColumn("n", F.length(c)))
    assert {r.i: r.n for r in out.collect()} == {1: 1, 2: 1, 3: None} and out.columns == ["i", "w", "n"]


def chapter(*parts):
    return "\t".join(parts)


def test_structure(spark):
    lines = [f"ก{i}" for i in range(20)]
    texts = [
        ("a", chapter("๏" + lines[0], *lines[1:4], "๏ " + lines[4], *lines[5:7])), ("b", "\n".join(lines[:5])), ("c", None), ("d", ""), ("e", "abc\t...\tฯ"),
        ("f", chapter(*lines[:3], "๏", *lines[3:11], "ฯ")), ("g", chapter("๏" + lines[0], *lines[1:7], "๏" + lines[7], *lines[8:13])),
    ]
    df = structure.chapter_lines(spark.createDataFrame([(c, t, 0) for c, t in texts], "chapter string, text string, pos int"), "chapter", "text")
    got = sorted((r.chapter, r.pos, r.line, r.anchor) for r in df.collect())
    assert [g[2] for g in got if g[0] == "a"] == lines[:7] and [g[1] for g in got if g[0] == "a" and g[3]] == [0, 4]
    assert {g[0] for g in got} == {"a", "b", "f", "g"}
    assert sorted(tuple(r) for r in structure.section_sizes(df).collect()) == [("a", 0, 0, 4, True), ("a", 1, 4, 3, False), ("f", 0, 0, 3, False), ("f", 1, 3, 8, True), ("g", 0, 0, 7, False), ("g", 1, 7, 6, False)]
    train = sorted((r.chapter, r.section, r.stanza, r.w1) for r in structure.stanzas_in_sections(df).collect())
    assert train == [("a", 0, 0, "ก0"), ("f", 1, 0, "ก3"), ("f", 1, 1, "ก7"), ("g", 0, 0, "ก3")]
    whole = sorted((r.chapter, r.stanza, r.w1, r.w4) for r in structure.stanzas_of_chapters(df).collect())
    assert whole == [("a", 0, "ก0", "ก3"), ("b", 0, "ก0", "ก3"), ("f", 0, "ก3", "ก6"), ("f", 1, "ก7", "ก10"), ("g", 0, "ก3", "ก6"), ("g", 1, "ก7", "ก10")]


def test_sound_windows(spark):
    df = spark.createDataFrame([(k, i, i not in (2, 5)) for k in "ab" for i in range(8 if k == "a" else 1)], "k string, i int, ok boolean")
    for width, want in ((1, 7), (2, 1 + 1 + 1), (3, 0)):
        out = structure.sound_windows(df, ["k"], ["i"], F.col("ok"), ["i"], width)
        assert out.count() == want
        assert all(len(r.v) == width for r in out.collect())


def test_verdicts(spark):
    rows = [
        (1, ["a", "x"], ["b", "x", "q", "m"], ["m"], ["n", "m"], "m"), (2, ["x"], ["a", "b", "c", "d", "e", "x"], ["x"], ["x"], None), (3, [], [], ["z"], ["z"], None), (4, ["x"], ["x"], ["y"], ["y"], "x"), (5, None, ["x"], ["x"], ["x"], None),
    ]
    df = spark.createDataFrame(rows, "i int, k1 array<string>, k2 array<string>, k3 array<string>, k4 array<string>, p string")
    got = {r.i: (r.r1, r.r2, r.r3, r.rx, r.sound) for r in rhymes.verdicts(df, "k1", "k2", "k3", "k4", "p").collect()}
    assert got == {1: (True, True, True, True, True), 2: (False, True, True, None, False), 3: (False, False, True, None, False), 4: (True, False, True, True, False), 5: (False, True, True, None, False)}
    old = rhymes.verdicts(df.where("i = 2"), "k1", "k2", "k3", "k4", "p", skip=1, third=False).first()
    assert (old.r1, old.r3) == (False, None)
    assert rhymes.by_rule(rhymes.verdicts(df, "k1", "k2", "k3", "k4", "p"), ["i"]).count() == 3 * 5 + 2
    assert df.where("i = 1").select(rhymes.matched_positions(F.lit("x"), F.col("k2")).alias("m")).first().m == [2]


def test_metrics(spark):
    counts = [(9, 1, 2, 3, 5), (0, 0, 0, 0, 0), (0, 0, 4, 0, 0), (5, 0, 0, 0, 0)]
    got = metrics.with_metrics(spark.createDataFrame(counts, "tp long, fp long, fn long, tn long, dropped long")).collect()
    a, none, lost, all_ = got
    assert (a.precision, a.recall, a.accuracy, a.coverage) == (0.9, 0.818182, 0.8, 0.75) and a.f1 == round(2 * 0.9 * 0.818182 / 1.718182, 6)
    assert (a.safe_precision, a.safe_recall) == (0.6, 0.5625)
    p, n, z = 0.9, 10, 1.96
    mid, half = (p + z * z / 2 / n) / (1 + z * z / n), z * math.sqrt(p * (1 - p) / n + z * z / 4 / n / n) / (1 + z * z / n)
    assert abs(a.precision_low - (mid - half)) < 2e-6 and abs(a.precision_high - (mid + half)) < 2e-6
    assert none.precision is None and none.f1 is None and none.precision_low is None and none.coverage is None
    assert lost.precision is None and lost.recall == 0 and lost.f1 is None and all_.f1 == 1.0


def test_dictionary(spark):
    mk = lambda *r: spark.createDataFrame(list(r), "word string, v int")
    main, new = mk(("a", 1), ("b", 2), ("c", None)), mk(("b", 3), ("c", None), ("d", 4))
    assert {tuple(r) for r in dictionary.merge_actions(main, new, "word", "v").collect()} == {("a", 1, "keep"), ("b", 3, "update"), ("c", None, "same"), ("d", 4, "insert")}
    assert {tuple(r) for r in dictionary.layered([main, new], "word").collect()} == {("a", 1, 0), ("b", 2, 0), ("c", None, 0), ("d", 4, 1)}
    assert {tuple(r) for r in dictionary.upsert(main, new, ["word"]).collect()} == {("a", 1), ("b", 3), ("c", None), ("d", 4)}
    assert {tuple(r) for r in dictionary.overlay(main, new.withColumnRenamed("v", "x"), ["word"], "v", "x").collect()} == {("a", 1), ("b", 3), ("c", None)}
    many = spark.createDataFrame([(f"{i % 3}", i) for i in range(30)], "word string, v int")
    assert {tuple(r) for r in dictionary.first_per_key(many, ["word"], ["v"]).collect()} == {tuple(r) for r in dictionary.best_per_key(many, ["word"], F.col("v")).collect()} == {("0", 0), ("1", 1), ("2", 2)}
    mixed = dictionary.interleave(spark.createDataFrame([(i,) for i in range(7)], "v int"), spark.createDataFrame([(100 + i,) for i in range(2)], "v int"), ["v"])
    assert [r.v for r in mixed.orderBy("slot").collect()] == [0, 1, 2, 100, 3, 4, 5, 101, 6]


def test_ranking(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(5)
    assert all(r.n == r.x for r in ranking.global_rank(df, ["x"], "n").collect())
    assert ranking.global_rank(df.where("x < 0"), ["x"], "n").count() == 0
    assert sorted(r["count"] for r in ranking.chunks(df, ["x"], 300, "c").groupBy("c").count().collect()) == [100, 300, 300, 300]
    assert {r["count"] for r in ranking.round_robin(df, ["x"], 4, "c").groupBy("c").count().collect()} == {250}


def test_places_in_groups(spark):
    df = spark.createDataFrame([(k, i) for k in ("a", "b", None) for i in range(5)], "k string, i int")
    assert all(r.n == r.i for r in ranking.rank_in_group(df, ["k"], ["i"], "n").collect())
    got = {(r.k, r.i): r.p for r in structure.with_previous(df, ["k"], ["i"], "i", "p").collect()}
    assert got == {(k, i): (i - 1 if i else None) for k in ("a", "b", None) for i in range(5)}


def one(spark, expr, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'array<string>' if isinstance(v, list) else 'string'}" for n, v in values.items())).select(expr.alias("x")).first().x if names else None


def test_text_functions(spark):
    assert one(spark, X.strip("t"), t="\t  ก ข　\n") == "ก ข"
    assert one(spark, X.thai_only("t"), t="ก a\tข\n") == "ก    ข\n"
    assert one(spark, X.replace_suffix("t", F.lit("ข"), F.lit("คค")), t="กข") == "กคค" and one(spark, X.replace_suffix("t", F.lit("ก"), F.lit("ค")), t="กข") == "กข"
    assert one(spark, X.context("t", F.lit("XY")), t="0123456789\nXYabcdefghijklmn") == "3456789¦XYabcdefghij"
    assert one(spark, X.context("t", F.lit("Z")), t="abc") is None
    assert one(spark, X.cells("a"), a=["x"]) == ["x", "", ""] and one(spark, X.cells("a"), a=list("abcd")) == list("abc")
    assert one(spark, X.fit_slots("a", 2), a=list("abcd")) == ["a", "bcd"] and one(spark, X.fit_slots("a", 5), a=list("abc")) == list("abc")
    assert one(spark, X.number_in("t"), t="khun_12_ok") == 12 and one(spark, X.number_in("t"), t="khun") is None and one(spark, X.work_of("t"), t="phra_7") == "phra"
    for text, n in (("a\nb\nc\nd", 4), ("a,b,c,d", 4), ("a b c d", 4), ("a b,c,d,e", 4), ("a b c", 3), ("", 0), (",".join("x" * 16), 16)):
        assert len(one(spark, X.lines_of_poem("t"), t=text)) == n, text


def test_readers(spark, tmp_path):
    from wakloom.sources import files, sinks

    d = tmp_path / "Eval" / "work"
    d.mkdir(parents=True)
    for k, rows in ((2, ["ก1,ข1,ค1,ง1", 'ก2 ,"ข,2",ค2,ง2']), (10, ["ก3,ข3,ค3,ง3"])):
        (d / f"work_{k}_ok.csv").write_text("﻿w1,w2,w3,w4\n" + "\n".join(rows) + "\n", encoding="utf-8")
    got = [(r.story, r.chapter, r.number, r.row, r.w1, r.w2, r.prev_w4) for r in files.stanzas(spark, str(d / "*_ok.csv")).orderBy("number", "row").collect()]
    assert got == [("work", "work_2", 2, 0, "ก1", "ข1", None), ("work", "work_2", 2, 1, "ก2", "ข,2", "ง1"), ("work", "work_10", 10, 0, "ก3", "ข3", None)]
    (d / "bad.csv").write_text("wak,syllables,flag,a,b,c\nก,1,f,,,\n", encoding="utf-8")
    with pytest.raises(Exception, match="(?i)header|schema"):
        files.review_queue(spark, str(d / "bad.csv")).collect()
    (d / "ch_1.txt").write_text("๏ก\tข\nค", encoding="utf-8")
    r = files.chapters(spark, str(d / "ch_*.txt")).first()
    assert (r.chapter, r.story, r.text) == ("ch_1", "work", "๏ก\tข\nค")
    (d / "ipa.tsv").write_text("ก\tka\nขค\tkha . kho\nขค\tkhak . o . a\nขค\tk . o\n\nงง\n", encoding="utf-8")
    assert {r.word: r.counts for r in files.pronunciations(spark, str(d / "ipa.tsv")).collect()} == {"ก": [1], "ขค": [2, 3]}
    (d / "dict.py").write_text('X = {\n    "ก": ["ก"],\n    "ขค": ["ข", "ค"],\n    "ก": ["กก"],\n}\n', encoding="utf-8")
    assert [(r.word, r.syllables, r.line_no) for r in files.dictionary_literal(spark, str(d / "dict.py")).collect()] == [("ก", ["ก"], 2), ("ขค", ["ข", "ค"], 3), ("ก", ["กก"], 4)]
    (d / "review.json").write_text(json.dumps({"ก": {"exclude": True}, "ข": {"rhythm": [3, 2, 3], "segmented": "ก | ข | ค"}}), encoding="utf-8")
    assert {r.wak: (r.exclude, r.rhythm) for r in files.checkpoint_map(spark, str(d / "review.json")).collect()} == {"ก": (True, None), "ข": (False, [3, 2, 3])}
    assert files.checkpoint_map(spark, str(d / "none.json")).count() == 0
    path = str(tmp_path / "answers")
    a = files.checkpoint_map(spark, str(d / "review.json"))
    assert sinks.save_answers(files.review_checkpoint(spark, path), a, path, ["wak"]) == 2
    assert sinks.save_answers(files.review_checkpoint(spark, path), a.where("wak = 'ก'").withColumn("exclude", F.lit(False)), path, ["wak"]) == 1
    assert {r.wak: r.exclude for r in files.review_checkpoint(spark, path).collect()} == {"ก": False, "ข": False}
    (d / "units.jsonl").write_text('{"id": "u", "waks": ["ก"], "score": [1]}\nno json\n', encoding="utf-8")
    assert sorted((r.id or "", r.fail or "") for r in files.units(spark, str(d / "units.jsonl")).collect()) == [("", "unreadable"), ("u", "")]
    st = files.stanzas(spark, str(d / "*_ok.csv"))
    sinks.write_by_work(st, str(tmp_path / "out"))
    assert (tmp_path / "out" / "work=work" / "chapter=work_2").is_dir()
    assert {r.line for r in sinks.literal_lines(files.dictionary_literal(spark, str(d / "dict.py"))).collect()} >= {'    "ขค": ["ข", "ค"],'}
    parts = st.withColumn("k", F.pmod("row", F.lit(2)))
    assert sinks.write_chunks(parts, str(tmp_path / "chunks"), "k", 2) == [0, 1] and sinks.write_chunks(parts, str(tmp_path / "chunks"), "k", 3) == [2]


def test_streams(spark, tmp_path):
    from wakloom.streaming import incremental as S

    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    schema = "k string, v int"
    spark.createDataFrame([("a", 1), ("b", 2)], schema).coalesce(1).write.parquet(src)
    run = lambda: S.process_new_files(spark, src, schema, lambda d: d.where("v > 1"), out, state)
    run()
    run()
    assert spark.read.parquet(out).count() == 1
    spark.createDataFrame([("a", 5)], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    assert spark.read.parquet(out).count() == 2
    S.keep_latest(spark, src, schema, ["k"], "v", str(tmp_path / "latest"), str(tmp_path / "s2"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "latest/v=0")).collect()} == {("a", 5), ("b", 2)}
    mk = lambda *r: spark.createDataFrame(list(r), schema)
    assert {tuple(r) for r in S.changed_rows(mk(("a", 1), ("b", None), ("", 3)), mk(("a", 1), (None, 3)), ["k", "v"]).collect()} == {("b", None), ("", 3)}


def test_meter(spark):
    lines = {
        "eight": [("ก", 3), ("ข", 2), ("ค", 3)], "inside": [("ก", 3), ("ข", 4), ("ค", 2)], "first": [("ก", 4), ("ข", 2), ("ค", 3)], "last": [("ก", 3), ("ข", 2), ("ค", 4)], "seven": [("ก", 7)], "over": [("ก", 2), ("ข", 3), ("ค", 3)],
        "short": [("ก", 6)], "ten": [("ก", 10)], "none": [], "null": None,
    }
    df = spark.createDataFrame(list(lines.items()), "k string, words array<struct<w:string,n:int>>")
    got = {r.k: r for r in meter.analysed(df, "words").collect()}
    assert (got["eight"].rhythm, got["eight"].segmented, got["eight"].flags) == ([3, 2, 3], "ก | ข | ค", [])
    assert got["inside"].rhythm is None and got["inside"].flags == ["long word inside"] and got["inside"].segmented == "กขค"
    assert got["first"].rhythm == [4, 2, 3] and got["last"].rhythm == [3, 2, 4] and not got["last"].needs_review
    assert set(got["seven"].flags) == {"straddle", "ambiguous"} and got["over"].flags == ["straddle"] and got["over"].segmented == "กข |  | ค"
    assert got["short"].kind == "opener" and not got["short"].needs_review and got["ten"].kind == "irregular" and got["ten"].needs_review
    assert got["none"].n_syllables == 0 and got["null"].n_syllables == 0 and not got["null"].needs_review


def test_import(spark):
    rows = [("กขค", "", None, " ", "deferred"), ("กขค", "X", "", "", "exclude"), ("กข ค", "ก", "ข", " ค", "cut"), ("กขค", "ก", "ข", "", "rejected"), ("กขค", "ก", "ข", "ฆ", "rejected"), ("ง", "ง", "", "", "unknown"), (None, "x", "", "", "unknown")]
    df = spark.createDataFrame(rows, "wak string, a string, b string, c string, want string")
    known = spark.createDataFrame([("กขค",), ("กขค",), ("กข ค",), (None,)], "wak string")
    out = meter.import_answers(df, known).collect()
    assert len(out) == len(rows) and all(r.action == r.want for r in out)


def test_segmenters(spark):
    known = {"กา": ["กา"], "กาก": ["กา", "ก"], "ก": ["ก"], "ขา": ["ขา"]}
    cut = segment.longest_match(known)
    assert cut("กากขา") == ["กา", "ก", "ขา"] and cut("xกขา") == ["xก", "ขา"] and cut("ก") == ["ก"] and cut("") == []
    assert segment.longest_match(known, frozenset("ก"))("xก") == ["x", "ก"]
    make = segment.fewest_syllables({"ab": ["a", "b"], "a": ["a"], "b": ["b"], "abc": ["abc"], "c": ["c"]})
    assert make("abc") == ["abc"] and make("abab") == ["a", "b", "a", "b"] and make("abd") == [] and make("") == []
    df = spark.createDataFrame([(1, "กาก"), (2, None), (3, ""), (4, "กาก")], "i int, w string")
    assert {r.i: r.parts for r in segment.segmented(df, "w", known).collect()} == {1: ["กา", "ก"], 2: None, 3: [], 4: ["กา", "ก"]}
    entries = spark.createDataFrame([("ก", ["ข"]), ("ก", ["ก"]), (None, ["x"]), ("ข", []), ("ค", None)], "word string, syllables array<string>")
    assert segment.dictionary_of(entries) == {"ก": ["ก"]}


def test_augment(spark):
    words = [c + v + f for c in "กขคงจ" for v, f in (("า", "น"), ("ี", "น"), ("ิ", "น"), ("ะ", ""), ("า", "ก"))]
    classes = syllable_classes(spark.createDataFrame([(w,) for w in words], "syll string"), "syll")
    pairs = augment.class_pairs(classes, 4).collect()
    assert len(pairs) == 20 and all(p.a < p.b for p in pairs) and len({(p.a, p.b) for p in pairs}) == 20
    assert augment.class_pairs(classes, 100).count() == 5 * 10
    key = {r.syll: r for r in classes.collect()}
    for how in ("same_final", "same_vowel", "swapped"):
        got = augment.candidates(classes, how, 3).collect()
        assert got and all(key[r.syll].rhyme != key[r.candidate].rhyme for r in got)
        assert max(sum(r.syll == w for r in got) for w in words) <= 3
    swapped = augment.candidates(classes, "swapped", 50).collect()
    assert {(r.syll, r.candidate) for r in swapped} == {(a + "ีน", b + "ิน") for a in "กขคงจ" for b in "กขคงจ"} | {(a + "ิน", b + "ีน") for a in "กขคงจ" for b in "กขคงจ"}
    st = spark.createDataFrame([(i, "xx" + w, w) for i, w in enumerate(words)], "i int, w1 string, tail string")
    out = augment.altered(st, augment.candidates(classes, "same_final", 3), "w1", "tail", ["i"], 10).collect()
    assert len(out) == 10 and all(r.new_line == "xx" + r.candidate for r in out)


def test_training_rows(spark):
    df = spark.createDataFrame([(i, f"a{i} | b | c", "x|y", None, "p | q | r | s") for i in range(2)], "i int, w1 string, w2 string, w3 string, w4 string").withColumn("k", F.lit("c"))
    row = structure.training_rows(structure.sound_windows(df, ["k"], ["i"], F.lit(True), ["w1", "w2", "w3", "w4"]), ["k", "i"]).collect()
    assert len(row) == 1 and len(row[0]) == 26
    assert (row[0].w1_a, row[0].w5_a, row[0].w2_b, row[0].w2_c, row[0].w3_a, row[0].w4_c) == ("a0", "a1", "y", "", None, "r")


def test_stanza_verdicts_look_inside_lines(spark):
    from wakloom.plans.verse import stanza_verdicts

    entries = spark.createDataFrame([("กาดินมี", ["กา", "ดิน", "มี"]), ("นาคูปลาชู", ["นา", "คู", "ปลา", "ชู"])], "word string, syllables array<string>")
    # r1: กา among the first of line 2; r2: ชู and คู, in spite of the blank; r3: คู among the first of line 4, or the last only.
    rows = [
        (1, "s", "e", "ดินมีกา", "ดินนามีชู", "มีกาคู ", "ดินชูมี", "มีดินคู"),
        (2, "s", "e", "ดินมีกา", "ดินดินมีมีคูปลา", "มีกาคู", "ดินดินดินดินดินคู", None),
        (3, "s", "e", None, "ดินนามีชู", "zรู", "ดินชูมี", " "),
    ]
    df = spark.createDataFrame(rows, "stanza_id int, story string, edition string, w1 string, w2 string, w3 string, w4 string, prev_w4 string")
    got = {r.stanza_id: (r.r1, r.r2, r.r3, r.rx) for r in stanza_verdicts(df, entries).collect()}
    assert got == {1: (True, True, True, True), 2: (False, False, False, None), 3: (False, True, True, None)}
