import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

from wakloom.llm.canon import canon_arrow
from wakloom.llm.edits import Patterns, distances
from wakloom.llm.grams import Index, rolling
from wakloom.llm.variants import one_form, written_variants


def form(*texts, blanks="trim"):
    return canon_arrow(pa.array(texts, pa.string()), blanks).to_pylist()


@pytest.mark.parametrize(
    "a, b",
    [
        ("น้ำ", "น้ํา"), ("น้ำ", "นํ้า"), ("เเปล", "แปล"), ("ก่ิ", "กิ่"), ("กึ", "กิํ"), ("ค่ๅ", "ค่า"), ("Ａb１", "Ab1"), ("Ае", "Ae"), ("Ο", "O"),
        ("é", "é"), ("ậ", "ậ"), ("ﬁ", "fi"), ("한", "한"), ("a​b­﻿", "ab"), ("a b", "a　b"), (" a\t", "a"), ("①", "1"), ("a️", "a"),
    ],
)
def test_same_look(a, b):
    assert form(a) == form(b)


@pytest.mark.parametrize("a, b", [("ก่า", "ก้า"), ("ก", "ข"), ("A", "a"), ("1", "2"), ("ใ", "ไ"), ("a b", "ab"), ("ดี", "ดิ"), ("ฃ", "ข"), ("З", "3")])
def test_other_look(a, b):
    assert form(a) != form(b)


def test_form_edges():
    assert form(None, "", " ​ ", "x") == [None, "", "", "x"]
    assert form(" ก ข ", blanks="drop") == ["กข"] and form(" ก ข ", blanks="keep") == [" ก ข "]
    assert canon_arrow(pa.array([], pa.string())).to_pylist() == []
    long = "เเน" + "้ํ" * 200_000 + "า"
    assert len(form(long, "a")[0]) > 200_000 and form("a", long, "ก")[2] == "ก"
    # Rows do not run into each other.
    assert form("เ", "เ", "นํ", "า", "e", "́") == ["เ", "เ", "นํ", "า", "e", "́"]


def test_form_is_stable_and_row_by_row():
    random.seed(1)
    alphabet = "กเแนำาำิึํ่้ๅẹ́̂​  ｅ"
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 9))) for _ in range(3000)]
    once = form(*texts)
    assert form(*once) == once
    assert once == [form(t)[0] for t in texts]
    for t, f in zip(texts, once, strict=True):
        if not set(t) & set("฀​") and all(ord(c) < 0x0E00 or ord(c) > 0x0E7F for c in t):
            assert f == unicodedata.normalize("NFC", unicodedata.normalize("NFKC", t)).strip()


def plain_distance(a, b, anywhere=False):
    row = [0 if anywhere else j for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row) if anywhere else row[-1]


@pytest.mark.parametrize("anywhere", [False, True])
def test_distances(anywhere):
    random.seed(2)
    sizes = [0, 1, 3, 63, 64, 65, 128, 150]
    a = ["".join(random.choices("abก", k=random.choice(sizes))) for _ in range(80)]
    b = ["".join(random.choices("abcก", k=random.choice(sizes))) for _ in range(80)]
    flat = lambda t: (np.array([ord(c) for x in t for c in x], np.uint32), np.concatenate(([0], np.cumsum([len(x) for x in t]))).astype(np.int64))
    (ca, oa), (cb, ob) = flat(a), flat(b)
    pat = Patterns(ca, oa)
    got = distances(pat, np.arange(80), pat.codes(cb), ob[:-1], np.diff(ob), anywhere)
    assert got.tolist() == [plain_distance(x, y, anywhere) for x, y in zip(a, b, strict=True)]


def test_grams_and_index():
    x = np.frombuffer("abcabcab".encode("utf-32-le"), np.uint32)
    for size in range(1, 9):
        h = rolling(x, size)
        assert len(h) == 9 - size
        assert [[h[i] == h[j] for j in range(len(h))] for i in range(len(h))] == [["abcabcab"[i : i + size] == "abcabcab"[j : j + size] for j in range(len(h))] for i in range(len(h))]
    assert len(rolling(x, 9)) == 0
    keys = np.array([5, 7, 5, 1 << 63], np.uint64)
    at, mine = Index(keys).find(np.array([7, 5, 6, 1 << 63], np.uint64))
    assert sorted(zip(at.tolist(), mine.tolist(), strict=True)) == [(0, 1), (1, 0), (1, 2), (3, 3)]


def test_variants(spark):
    rows = [(5, "แก"), (3, "เเก"), (9, "เเก"), (7, "แก "), (4, None), (6, ""), (8, "​"), (2, " "), (1, "ข"), (10, "ข")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "id long, t string, text string, look string")
    got = {(r.first_id, r.other_id) for r in written_variants(df, "id", "t", "s").collect()}
    assert got == {(3, 5), (3, 7), (2, 8)}
    assert written_variants(df.where("id < 0"), "id", "t", "s").count() == 0
    assert {r.id: r.form for r in one_form(df, "id", "t", "s").collect()}[4] is None


def test_encode(spark):
    tiktoken = pytest.importorskip("tiktoken")
    P = pytest.importorskip("public_tokenizers")
    from wakloom.llm.encode import Decoder, Encoder, decoder, encode, read_ranks

    path = str(P.path("byte_bpe_50k.tiktoken"))
    with open(path, "rb") as f:
        data = f.read()
    ranks = read_ranks(data)
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    random.seed(3)
    alphabet = " \n\t 'sdmtlvreLXก่า1٣!.,-é́🙂'' "
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 14))) for _ in range(8000)] + ["<|endoftext|>", " 's", "\n's", "it's", "I'llama", "'s's", "  ", "ก" * 50_000, "a  \n b " * 5000]
    enc = Encoder("own", data)
    ids, ends = enc.spans(pa.array(texts), True)
    assert ids.to_pylist() == [ref.encode_ordinary(t) for t in texts]
    assert Decoder(ranks)(ids).to_pylist() == texts
    for t, i, e in zip(texts, ids.to_pylist(), ends.to_pylist(), strict=True):
        assert [t.encode()[a:b] for a, b in zip([0, *e], e)] == [ref.decode_single_token_bytes(x) for x in i]
    # Two words of one hash, whatever its base: each gets its own ids, in one batch and after another.
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    twins = [word, word.translate(str.maketrans("ab", "ba"))]
    raw = np.frombuffer("".join(twins).encode(), np.uint8)
    h = enc.hashes(raw, np.array([0, 2048, 4096]))
    assert h[0] == h[1] and enc(pa.array([twins[0], *twins])).to_pylist() == [ref.encode_ordinary(t) for t in (twins[0], *twins)]
    assert enc(pa.array(twins[::-1])).to_pylist() == [ref.encode_ordinary(t) for t in twins[::-1]]
    rows = [(1, "ไก่ it's"), (2, None), (3, ""), (4, "ไก่ it's")]
    df = encode(spark.createDataFrame([(i, t, "e") for i, t in rows], "doc_id long, text string, ids string"), "doc_id", "text")
    ids = {r.doc_id: r.ids for r in df.collect()}
    assert ids == {1: ref.encode_ordinary("ไก่ it's"), 4: ref.encode_ordinary("ไก่ it's"), 2: [], 3: []}
    assert {r[0]: r[1] for r in df.select("doc_id", decoder(spark)("ids")).collect()} == {1: "ไก่ it's", 2: "", 3: "", 4: "ไก่ it's"}
