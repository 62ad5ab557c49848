import collections
import datetime as dt
import itertools
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wakloom.llm import flow, leaks, overlap, splits, survivors, terms, toxic
from wakloom.llm.components import components, rounds
from tests.llm.test_texts import plain_distance


def test_terms(spark):
    rows = [(1, ["a", "a", None, ""]), (2, ["a", "b"]), (3, []), (4, None), (5, ["ก", "a\x00"]), (6, [None])]
    df = spark.createDataFrame([(i, s, "x", 1) for i, s in rows], "id int, s array<string>, term string, n_occ int").repartition(3)
    got = {r.term: (r.n_occ, r.n_rec, r.n_records) for r in terms.term_frequency(df, "s", "t").collect()}
    assert got == {"a": (3, 2, 3), "b": (1, 1, 3), "ก": (1, 1, 3), "a\x00": (1, 1, 3)}
    t = terms.term_frequency(df, "s", "t")
    assert t.select("term_id").distinct().count() == 4
    assert {(r.term, r.mark) for r in terms.marks(t).collect()} == {("a", "common"), ("b", "rare"), ("b", "common"), ("ก", "rare"), ("ก", "common"), ("a\x00", "rare"), ("a\x00", "common")}
    assert terms.term_frequency(df.where("id = 0"), "s", "t").count() == 0


def test_terms_in_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(2000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("w"))
        got = {r.term: (r.n_occ, r.n_rec) for r in terms.term_frequency(df, "w", "t").collect()}
        want = {r.w: (r["count"], r["count"]) for r in df.groupBy("w").count().collect()}
        assert got == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


ENTRY = "entry_id long, dict_name string, word string, syllables array<string>, ipa string, n_seen int, note string, updated_at timestamp_ntz, survivor_id string"
D = [dt.datetime(2020, 1, k) for k in (1, 2, 3)]
BASE, MAIN, DRAFT = "poetry_overrides_base", "poetry_overrides", "poetry_overrides_generated_lenient"


def test_survivors(spark):
    rows = [
        (1, DRAFT, "แก", ["ก"], "i", 1, "n", D[2]), (2, MAIN, "เเก", [], " ", 1, "n", D[0]), (3, MAIN, "แก​", None, None, 1, "n", None),
        (4, BASE, "ข", ["ข"], None, None, None, None), (5, BASE, "ข ", ["ค"], None, 2, None, None), (6, BASE, "ง", [], "", 1, "", D[1]), (7, BASE, "ง", None, " ", 1, "", D[1]),
        (8, None, None, ["x"], "x", 1, "", D[1]), (9, MAIN, None, ["x"], "x", 1, "", D[1]), (10, MAIN, " ", ["x"], "x", 1, "", D[1]), (11, MAIN, "", ["x"], "x", 1, "", D[1]), (12, "other", "จ", None, "x", 1, "", D[2]), (13, DRAFT, "จ", None, None, 1, "", None),
    ]
    df = spark.createDataFrame([(*r, "") for r in rows], ENTRY)
    got = {r.group_id: (r.survivor_id, r.syllables_from, r.ipa_from) for r in survivors.survivors(df).collect()}
    assert got == {1: (2, 1, 1), 4: (5, 5, 0), 6: (6, 0, 0), 12: (13, 0, 12)}
    one = survivors.survivors(df).where("group_id = 1").first()
    assert (one.word, one.syllables, one.n_entries) == ("เเก", ["ก"], 3)
    assert survivors.survivors(df.where("entry_id < 0")).count() == 0


def test_current_values(spark):
    rows = []
    for k in range(6):  # old is followed by new in five words, the other way in none
        rows += [(10 * k, MAIN, f"ก{k}", None, None, 1, "old", D[0]), (10 * k + 1, MAIN, f"ก{k}", None, None, 1, "new", D[1])]
    rows += [(100, MAIN, "x", None, None, 1, "new", None), (101, MAIN, "x", None, None, 1, "old", D[2]), (102, MAIN, "y", None, None, 1, None, D[2]), (103, MAIN, "z", None, None, 1, "odd", None)]
    got = {r.group_id: r.value for r in survivors.current_values(spark.createDataFrame([(*r, "") for r in rows], ENTRY), "note").collect()}
    assert got == {10 * k: "new" for k in range(6)} | {100: "new", 103: "odd"}
    steps = spark.createDataFrame([(f"g{i}", v, D[k]) for i in range(3) for k, v in enumerate(("a", "b", "c"))] + [("h", "b", D[1]), ("h", "a", D[2])], "look string, value string, first_at timestamp_ntz")
    assert {tuple(r) for r in survivors.learn_steps(steps).collect()} == {("a", "b"), ("b", "c")}
    assert survivors.current_values(spark.createDataFrame([], ENTRY), "note").count() == 0


LINES = "w1 string, w2 string, w3 string, w4 string"


def mutate(text, n):
    text = list(text)
    for _ in range(n):
        k, how = random.randrange(len(text)), random.random()
        if how < 0.4:
            text[k] = random.choice("กขคงจ")
        elif how < 0.7:
            text.insert(k, random.choice("กขคงจ"))
        elif len(text) > 1:
            del text[k]
    return "".join(text)


def close(a, b):
    a, b = [(x or "").replace(" ", "") for x in a], [(x or "").replace(" ", "") for x in b]
    if sum(x == y != "" for x, y in zip(a, b, strict=True)) >= 3:
        return True
    x, y = "".join(a), "".join(b)
    return bool(x or y) and plain_distance(x, y) * 5 <= max(len(x), len(y))


def test_overlaps_like_brute_force(spark):
    random.seed(5)
    syllable = ["".join(random.choices("กขคงจฉชซดตถทนบปผพฟมยรลวสหอาเแโ", k=random.randint(2, 4))) for _ in range(80)]
    line = lambda: "".join(random.choices(syllable, k=8))
    base = [[line() for _ in range(4)] for _ in range(40)]
    query = [(i, *b) for i, b in enumerate(base)] + [(90, None, None, None, None), (91, "กข", None, None, None), (92, *base[0]), (93, "กขคงจฉ", "ชซ", "", "ด")]
    pool = []
    for i, b in enumerate(base):
        for n in (0, 2, 6, 12):
            pool.append([mutate(x, n // 4 + (n % 4 > k)) for k, x in enumerate(b)])
        pool.append([b[0], b[1], b[2], line()])
        pool.append([b[0], line(), b[2], line()])
        pool.append([b[0] + " ", None, b[2], b[3]])
    pool += [["กข", None, None, None], [None] * 4, ["", "", "", ""], ["กขคงจฉ", "ชซ", None, "ต"], ["กขคงจฉ", "ชซ", "", "ด"]]
    pool = [(1000 + k, *p) for k, p in enumerate(pool)]
    want = {(q[0], p[0]) for q in query for p in pool if close(q[1:], p[1:])}
    q = spark.createDataFrame([(*r, "x") for r in query], f"eval_id long, {LINES}, stanza_id string")
    p = spark.createDataFrame([(*r, "x") for r in pool], f"stanza_id long, {LINES}, eval_id string")
    rows = [tuple(r) for r in overlap.overlaps(q, p).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert overlap.overlaps(q.where("eval_id < 0"), p).count() == 0 and overlap.overlaps(q, p.where("stanza_id < 0")).count() == 0


@pytest.mark.parametrize("size", [20, 48, 50, 60, 80, 97, 124, 160])
def test_overlaps_miss_nothing_up_to_a_fifth(size):
    rng = random.Random(size)
    letters = "กขคงจฉชซดตถทนบปผพฟมยรลวสหอา"
    ways = ["swap", "swap add", "swap cut", "add", "cut", "swap add cut"]

    def edited(t, n, how):
        t = list(t)
        for at in sorted(rng.sample(range(len(t)), n), reverse=True):
            x = rng.choice(letters)
            t[at : at + 1] = {"swap": [x], "add": [t[at], x], "cut": []}[rng.choice(how.split())]
        return "".join(t)

    texts = ["".join(rng.choices(letters, k=size)) for _ in range(180)]
    pool = [edited(t, int(size * (0.15, 0.18, 0.2, 0.22)[k % 4]), ways[k % 6]) for k, t in enumerate(texts)]
    sides = [overlap.joined_lines([pa.array([t[k * size // 4 : (k + 1) * size // 4] if k < 3 else t[3 * size // 4 :] for t in side]) for k in range(4)]) for side in (texts, pool)]
    want = {k for k in range(180) if plain_distance(texts[k], pool[k]) <= max(size, len(pool[k])) // 5}
    a, b = overlap.Block(np.arange(180), *sides[0]).pairs(*sides[1])
    assert set(a[a == b].tolist()) == want and len(want) > 100


def test_good_starts_of_every_short_pair():
    """Every pair of words of two letters up to nine long that is within a fifth, and longer ones with k edits at worst places."""
    rng = random.Random(1)
    words = sorted({"".join(rng.choices("กขค", k=rng.randint(1, 14))) for _ in range(260)})
    one = overlap.Texts(*overlap.joined_lines([pa.array(words), *[pa.array([""] * len(words))] * 3])[:2])
    common = overlap.Commonness(one.cps)
    found = set()
    for strict in (False, True):
        for a, b in overlap.Starts(one.cps, one.off, common).find(one.cps, one.off, strict):
            found |= set(zip(a.tolist(), b.tolist(), strict=True))
    text = ["".join(map(chr, one.cps[x:y])) for x, y in zip(one.off, one.off[1:], strict=False)]
    for i, x in enumerate(text):
        for j, y in enumerate(text):
            if len(y) <= len(x) and plain_distance(x, y) <= len(x) // 5:
                assert (i, j) in found


def test_blocks_and_hot_texts(spark, monkeypatch):
    random.seed(8)
    line = lambda: "".join(random.choices("กขคงจฉชซดตถทน", k=30))
    hot = [line() for _ in range(4)]
    query = [(i, *(hot if i % 3 == 0 else [line() for _ in range(4)])) for i in range(60)]
    pool = [(i, *([mutate(hot[0], 8), *hot[1:]] if i % 3 == 0 else [line() for _ in range(4)])) for i in range(60)]
    pool.append((99, *[mutate(x, 4) for x in query[1][1:]]))
    q, p = spark.createDataFrame(query, f"eval_id long, {LINES}"), spark.createDataFrame(pool, f"stanza_id long, {LINES}")
    want = {(a[0], b[0]) for a in query for b in pool if close(a[1:], b[1:])}
    monkeypatch.setattr(overlap, "BLOCK_POINTS", 2000)  # several blocks give what one gives
    monkeypatch.setattr(overlap, "POOL_POINTS", 3000)
    rows = [tuple(r) for r in overlap.overlaps(q, p).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and (1, 99) in want


def test_copies_are_compared_once(spark, monkeypatch):
    random.seed(9)
    line = lambda: "".join(random.choices("กขคงจฉชซดตถทน", k=30))
    base = [[line() for _ in range(4)] for _ in range(6)]
    query = [(10 * k + i, *([x + " " for x in b] if k % 2 else b)) for i, b in enumerate(base) for k in range(9)] + [(98, None, "", None, " "), (99, *base[5][:3], None)]
    pool = [(100 * k + i, *(mutate(x, 5) for x in b)) for i, b in enumerate(base[:3]) for k in (1,)] + [(100 * k + i, *b) for i, b in enumerate(base) for k in range(2, 13)]
    q, p = spark.createDataFrame(query, f"eval_id long, {LINES}").repartition(3), spark.createDataFrame(pool, f"stanza_id long, {LINES}").repartition(3)
    monkeypatch.setattr(overlap, "BLOCK_POINTS", 1200)
    assert overlap.folded(q, "eval_id").count() == 7 and len(list(overlap._blocks(q, "eval_id"))) == 1  # copies make no more blocks
    monkeypatch.setattr(overlap, "_MOST_IDS", 4)  # copies in several rows, and those in several blocks
    assert overlap.folded(q, "eval_id").selectExpr("size(ids) n").groupBy().agg(F.max("n"), F.sum("n")).first() == (4, 55) and len(list(overlap._blocks(q, "eval_id"))) > 1
    want = {(a[0], b[0]) for a in query for b in pool if close([(x or "").strip() for x in a[1:]], b[1:])}
    rows = [tuple(r) for r in overlap.overlaps(q, p).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 600
    ids = overlap.Ids(pa.array([["a", "b"], [], ["c"] * 5]))
    assert [[x.to_pylist() for x in part] for part in ids.pairs(np.array([0, 2, 1]), ids, np.array([0, 0, 2]), 3)][:2] == [[["a", "a", "b"], ["a", "b", "a"]], [["b", "c", "c"], ["b", "a", "b"]]]


def test_components(spark):
    e = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(30)] + [("x", "y"), ("y", "x"), ("z", "z"), ("hub", "n05"), (None, "q")], "u string, v string")
    want = {(f"n{i:02d}", "hub") for i in range(31)} | {("hub", "hub"), ("x", "x"), ("y", "x"), ("z", "z")}
    assert {tuple(r) for r in components(e, "u", "v").collect()} == want
    assert {tuple(r) for r in rounds(e.where("u is not null")).collect()} == want
    assert components(e.where("u = 'none'"), "u", "v").count() == 0


S = "stanza_id long, story string, chapter string, row int, w4 string, prev_w4 string, root string"


def test_chapter_pairs(spark):
    rows = [
        (1, "s", "a", 0, "ก1", None), (2, "s", "a", 1, "ก2", "ก1"), (3, "s", "b", 2, "ก3", "ก2 "), (4, "s", "c", 3, "ก4", "ก​3"), (5, "t", "d", 2, "x", "ก2"), (6, "s", "e", 2, "y", "nothing"), (7, "s", "f", 2, "z", " "), (8, "s", "g", 1, " ", None),
        (9, None, "h", 2, "x", "ก2"), (10, "s", None, 2, "x", "ก2"), (11, "s", "i", None, "x", "ก2"), (12, "s", "j", 2, "x", "ก2"), (13, "s", "j", 1, "x", None),
    ]
    df = spark.createDataFrame([(*r, "r") for r in rows], S)
    assert {tuple(r) for r in splits.linked_pairs(splits.chapter_groups(df)).collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    got = {r.stanza_id: r.split for r in splits.split_rows(df).collect()}
    assert set(got) == set(range(1, 14)) and len({got[k] for k in (1, 2, 3, 4)}) == 1
    assert splits.split_rows(df.where("stanza_id < 0")).count() == 0


def _rows(bundles, ends):
    rows = {}
    for (label, size, n), e in zip(bundles, ends, strict=True):
        assert e[-1] == n and e == sorted(e)
        for s, k in enumerate(np.diff([0, *e])):
            rows[label, s] = rows.get((label, s), 0) + size * int(k)
    return rows


def test_allocation():
    rng = random.Random(3)
    shares = {"a": 0.8, "b": 0.1, "c": 0.1}
    over = least = 0.0
    for _ in range(40):  # few components of unlike sizes: near the best there is
        sizes = [rng.randint(1, 100) for _ in range(8)]
        bundles = [("", z, sizes.count(z)) for z in sorted(set(sizes))]
        rows = _rows(bundles, flow.allocate(bundles, shares))
        off = lambda have: sum(abs(x - sum(sizes) * q) for x, q in zip(have, shares.values(), strict=True)) / sum(sizes)
        best = min(off([sum(z for z, w in zip(sizes, to, strict=True) if w == s) for s in range(3)]) for to in itertools.product(range(3), repeat=8))
        got = off([rows.get(("", s), 0) for s in range(3)])
        assert got <= best + 0.05
        over, least = over + got, least + best
    assert over <= 1.2 * least
    bundles = [(f"s{i}", z, rng.randint(1, 30)) for i in range(6) for z in range(1, 40)]
    rows = _rows(bundles, flow.allocate(bundles, shares))
    for i in range(6):  # within labels too, as far as one component
        whole = sum(z * n for x, z, n in bundles if x == f"s{i}")
        assert all(abs(rows[f"s{i}", s] - whole * q) <= 40 for s, q in enumerate(shares.values()))
    assert sum(abs(sum(rows[f"s{i}", s] for i in range(6)) - sum(z * n for _, z, n in bundles) * q) for s, q in enumerate(shares.values())) <= 2
    assert flow.allocate([], {"a": 1.0}) == []


def test_leaks(spark, monkeypatch):
    random.seed(9)
    word = lambda n: "".join(random.choices("กขคงจabcdefgh", k=n))
    text = word(120)
    items = [(1, text), (2, word(39)), (3, None), (4, ""), (5, text[:60])]
    spaced = "  ".join(text[k : k + 7].upper() for k in range(0, 120, 7))
    docs = [(10, word(30) + spaced + word(9)), (11, word(20) + text[30:70] + word(20)), (12, word(20) + "Z" + text[30:69] + "Z" + word(20)), (13, None), (14, ""), (15, text[:39]), (16, text[5:25] + "X" + text[25:64]), (17, items[1][1]), (18, "x" * 200_000 + text)]
    i = spark.createDataFrame([(a, b, "test", 0) for a, b in items], "item_id long, text string, split string, doc_id int")
    d = spark.createDataFrame([(a, b, "s") for a, b in docs], "doc_id long, text string, item_id string")
    assert {tuple(r) for r in leaks.leaks(i, d).collect()} == {(1, 10), (5, 10), (1, 11), (1, 18), (5, 18)}
    near = {tuple(r) for r in leaks.leaks(i, d, budget=2).collect()}
    assert {(1, 12), (1, 16), (1, 15), (5, 15)} <= near and not {p for p in near if p[1] in (13, 14, 17)}
    assert leaks.leaks(i.where("item_id < 0"), d).count() == 0
    assert {r.doc_id: r.items for r in leaks.leaked_documents(i, d).collect()}[10] == [1, 5]
    monkeypatch.setattr(leaks, "BLOCK_POINTS", 60)  # several blocks give what one gives
    monkeypatch.setattr(leaks, "HELD_POINTS", 100)
    assert sorted(tuple(r) for r in leaks.leaks(i, d).collect()) == [(1, 10), (1, 11), (1, 18), (5, 10), (5, 18)]


def test_toxic(spark):
    random.seed(11)
    words = ["".join(random.choices("bcdfglmnprst", k=2)) + random.choice("aeiou") + random.choice("nrt") for _ in range(300)]
    bad = ["you are a filthy rotten weasel and nobody wants you here", "crawl back to your hole you brainless moron", "all hillfolk are vermin and should be driven out"]
    rows, labels, truth = [], [], {}
    for i in range(900):
        text = " ".join(random.choices(words, k=40))
        truth[i] = i % 9 == 0
        if truth[i]:
            passage = bad[i // 9 % 3]
            passage = passage.upper() if i % 2 else passage.replace("o", "0") if i % 4 == 0 else passage
            text = text[:60] + ". " + passage + ". " + text[60:]
        rows.append((i, text, "s", 0))
        if i < 450:
            labels.append((i, int(truth[i]) if i % 50 else 1 - int(truth[i])))
    rows += [(9001, None, "s", 0), (9002, "", None, 0), (9003, "!!! ...", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score int")
    marks = spark.createDataFrame(labels + [(1, None), (2, 0), (2, 1)], "doc_id long, toxic int")
    got = {r.doc_id: (r.score, r.toxic) for r in toxic.toxic_scores(docs, marks).collect()}
    held = [i for i in range(450, 900)]
    right = sum(got[i][1] == truth[i] for i in held)
    assert right >= 0.97 * len(held)
    assert len(got) == 903 and all(got[i] == (0, False) for i in (9001, 9002, 9003))
    assert toxic.toxic_scores(docs, marks.where("toxic = 5")).where("toxic").count() == 0
    assert {r.source: r.n_docs for r in toxic.toxic_rates(docs, marks).collect()} == {"s": 902, None: 1}


def test_toxic_threshold_of_a_larger_table(spark, monkeypatch):
    monkeypatch.setattr(toxic, "MOST_TOXIC", 30)
    monkeypatch.setattr(toxic, "MOST_PLAIN", 60)
    found = {}
    for times in (1, 10):  # 30 toxic and 300 ordinary documents, and ten times as many
        docs = spark.range(330 * times).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"))
        marks = docs.select("doc_id", (F.col("doc_id") < 30 * times).cast("int").alias("toxic"))
        _, _, mark, weight = toxic.labelled(docs, marks)
        assert (mark.sum(), (~mark).sum(), weight) == (30, 60, 5.0)
        # Toxic ones score 1 to 30; of the ordinary ones one in 20 scores 20.
        score = np.where(mark, np.cumsum(mark), np.where(np.cumsum(~mark) % 20 == 0, 20, 0))
        found[times] = toxic.best_threshold(score, mark, weight)
    assert found[1] == found[10]



@pytest.mark.parametrize("a, b", [("MоRON", "moron"), ("m0r0n", "moron"), ("mo​ron", "moron"), ("mooooron", "moron"), ("กาาาย", "กาย"), ("กา.ย", "กาย"), ("shí7", "shit"), ("sh!t", "shit"), ("moron!", "moron"), ("$hit", "shit"), ("a 1 b", "a 1b"), ("ab 3", "a b 3")])
def test_spelling(a, b):
    x, y = toxic.spelled(pa.array([a])), toxic.spelled(pa.array([b]))
    assert x[0].tolist() == y[0].tolist()


def test_spelling_row_by_row():
    random.seed(13)
    texts = ["".join(random.choices("ab1!3 $ก.", k=random.randint(0, 7))) for _ in range(2000)]
    raw, off = toxic.spelled(pa.array(texts))
    assert [raw[a:b].tolist() for a, b in zip(off, off[1:], strict=False)] == [toxic.spelled(pa.array([t]))[0].tolist() for t in texts]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_splits_of_the_table(spark):
    """Every row has a split, linked chapters share one, shares are off by no more than the largest component."""
    stanza = spark.read.parquet("/root/testdata/sf0.001/stanza.parquet")
    split = {r.stanza_id: r.split for r in splits.split_rows(stanza).collect()}
    rows = stanza.select("stanza_id", "chapter").collect()
    assert set(split) == {r.stanza_id for r in rows} and len(rows) == len(split)
    root = {r.chapter: r.root for r in splits.chapter_groups(stanza).collect()}
    size, where = collections.Counter(), collections.defaultdict(set)
    for r in rows:
        group = root.get(r.chapter, r.chapter)
        size[group] += 1
        where[group].add(split[r.stanza_id])
    assert all(len(w) == 1 for w in where.values())
    have = collections.Counter(split.values())
    assert all(abs(have[s] - len(rows) * q) <= max(size.values()) for s, q in splits.SPLITS.items())
