"""Texts that look the same, and those that don't."""

import unicodedata

from pyspark.sql import functions as F

from cellmend.llm.skeleton import consistent_form, forms, look_alike_letters, look_alike_pairs, look_alikes

SAME = [
    ("Ｃａｆé　１２", "Café 12"), ("ｶﾞｯﾂ", "ガッツ"), ("한국", unicodedata.normalize("NFD", "한국")), ("zero​width﻿", "zerowidth"), ("soft­hyphen", "softhyphen"),
    ("a b c d　e", "a b c d e"), ("раsѕwоrd", "password"), ("ΤΟΡ", "TOP"), ("ё", "ë"), ("ộ", "ộ"), ("ο", "o"), ("Ａ－１", "A-1"),
    ("ν ρ Ϲ ϲ", "v p C c"), ("ո ս հ Ս", "n u h U"), ("ѵ Ѵ Ӏ", "v V I"), ("ᎪᏴᏟ ꮃꮪ", "ABC ws"), ("ꓐꓑꓲ", "BPI"), ("ⲞⲢⲤ ⲟⲣⲥ", "OPC opc"), ("ГПФ", "ΓΠΦ"), ("a\x00b\x7fc\x1b", "abc"), ("a\u2028b", "a\nb"), ("a\u2800b", "a b"),
    ("x\U000e0001y", "xy"), ("Ή", "Ή".replace("Η", "H")), ("Ϳ", "J"),
]
DIFFERENT = [("A", "a"), ("é", "e"), ("x²", "x2"), ("①", "1"), ("½", "1/2"), ("a b", "a  b"), ("–", "-"), ("a.", "a"), ("ﬁ", "fi"), ("ß", "ss"), ("1", "l"), ("0", "O"), ("σ", "o"), ("か", "が"), ("ツ", "ッ"), ("\u06001", "1"), ("\u06dd1", "1"), ("\u070fa", "a"), ("\u08e2a", "a"), ("\U000110bda", "a"), ("a\tb", "a b"), ("a\nb", "a b"),
    ("α", "a"), ("γ", "y"), ("г", "r"), ("ι", "i"), ("З", "3"), ("б", "6"), ("Һ", "һ"), ("К", "к")]


def test_pairs_of_characters(spark):
    letters = tuple(sorted(look_alike_letters(spark).items()))
    form = lambda t: forms([t], letters)[0]
    for a, b in SAME:
        assert form(a) == form(b), (a, b)
    for a, b in DIFFERENT:
        assert form(a) != form(b), (a, b)
    for a, _ in SAME + DIFFERENT:
        assert form(form(a)) == form(a)
    assert forms([a for a, _ in SAME], letters) == [form(a) for a, _ in SAME] and forms([], letters) == [] and forms(["", "a", ""], letters) == ["", "a", ""]
    assert 150 < len(letters) < 400


def test_ascii_texts_with_and_without_controls(spark):
    texts = ["plain", "a\x00b", "tab\tend\r\n", "\x1b[0m", "", None, "\x7f"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    assert [r.f for r in df.select("i", consistent_form(F.col("text")).alias("f")).orderBy("i").collect()] == ["plain", "ab", "tab\tend\r\n", "[0m", "", None, ""]


def test_pairs_of_documents(spark):
    texts = ["plain text", "plain text", "plain text", "рlаin text", "Plain text", None, "", " ", "​", " ", "é" * 50_000, "é" * 50_000, "other", "other"]
    df = spark.createDataFrame([(i, t, "clash", "c") for i, t in enumerate(texts)] + [(None, "Ｐlain text", "", "")], "doc_id long, text string, look string, form string")
    got = sorted(map(tuple, look_alike_pairs(spark, df).collect()))
    assert got == [(0, 2), (0, 3), (1, 2), (1, 3), (2, 3), (10, 11)]
    assert look_alike_pairs(spark, df.where("false")).collect() == []
    classes = {r.doc_id: (r.forms, r.links) for r in look_alikes(spark, df).collect()}
    assert classes == {0: (3, 2), 1: (3, 2), 2: (3, 3), 3: (3, 3), 10: (2, 1), 11: (2, 1)}
    forms = {r.doc_id: r.f for r in df.select("doc_id", consistent_form(F.col("text")).alias("f")).collect()}
    assert forms[0] == forms[2] == forms[3] == "plain text" and forms[10] == forms[11] == "é" * 50_000 and forms[5] is None and forms[6] == ""
