"""One form for texts that look the same, by their confusables skeleton.

A text is decomposed, every character is replaced by its prototype, and the result is decomposed again;
what is compared and stored is that form composed, which is equal where the decomposed ones are.
Prototypes: full-width and half-width forms stand for the ordinary ones, blanks of any kind for the
space, letters of other scripts with the shape of a Latin letter for that letter, other capitals with the
shape of a Greek one for that; characters that show nothing have none. Case, accents, digits,
punctuation, raised and circled characters keep theirs.

Which letters share a shape is taken from the public confusables data that the Unicode library beside
Spark holds, for the scripts named below and without the letters that only resemble each other.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmend.session import Stages, broadcast_if_small

# fixed values: scripts whose letters are looked up
SCRIPTS = ["Armenian", "Canadian_Aboriginal", "Carian", "Cherokee", "Coptic", "Cyrillic", "Deseret", "Greek", "Lisu", "Lycian", "Old_Italic", "Tifinagh"]
# fixed values: letters that the data count as confusable though their shape is another one
RESEMBLING = "αγισυ" "ⲅ" "гѡҽꙇ" "ագզքցՓ" "ꮁ"  # Greek, Coptic, Cyrillic, Armenian, Cherokee
# fixed values: letters that the data give another prototype or none
LOOK_ALIKE = {"ӏ": "l", "Ӏ": "I", "Ι": "I", "І": "I", "Ⲓ": "I", "ꓲ": "I"}
# fixed values: ranges of characters that show nothing: those that may be ignored by default, and annotation marks
UNSEEN = [
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF0, 0xFFFB), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
]
# fixed values: controls that part words or lines; all others show nothing
BLANK_CONTROLS = "\t\n\x0b\x0c\r"
# fixed values: characters that part lines, as the line feed does
LINE_ENDS = "\x85\u2028\u2029"
# fixed values: a character without ink that is as wide as a letter
EMPTY_PATTERN = "\u2800"

#: controls that show nothing, in texts of ASCII alone
ASCII_GONE = r"[\x00-\x08\x0e-\x1f\x7f]"
GONE = np.uint32(0xFFFFFFFF)


@lru_cache(None)
def _letters() -> tuple[str, ...]:
    """Letters of the scripts that are looked up, composed ones aside."""
    import regex

    own = regex.compile("[" + "".join(rf"\p{{Script={s}}}" for s in SCRIPTS) + "]")
    every = (chr(n) for n in range(0x80, 0x20000) if not 0xD800 <= n < 0xE000)
    return tuple(c for c in every if unicodedata.category(c) in ("Lu", "Ll", "Lo") and unicodedata.decomposition(c)[:8] in ("", "<compat>") and own.match(c))


_found: dict[str, str] = {}


def look_alike_letters(spark: SparkSession) -> dict[str, str]:
    """The Latin or Greek letter that stands for each letter of its shape, about 250."""
    if not _found:
        checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        prototypes = checker.getSkeleton("\n".join(_letters())).split("\n")
        for c, p in zip(_letters(), prototypes):
            kind, name = unicodedata.category(c), unicodedata.name(c)
            latin = len(p) == 1 and p.isascii() and p.isalpha()
            greek = len(p) == 1 and kind != "Ll" and unicodedata.category(p) == "Lu" and unicodedata.name(p).startswith("GREEK CAPITAL")
            # letters without case, and those of a script that took its capitals from either, look as they look
            case = kind == "Lo" or name.startswith("CHEROKEE") or (latin and unicodedata.category(p) == kind) or greek
            if c != p and (latin or greek) and case and c not in RESEMBLING:
                _found[c] = p
        _found.update(LOOK_ALIKE)
    return dict(_found)


_tables: dict[tuple, np.ndarray] = {}


def _table(letters: tuple[tuple[str, str], ...]) -> np.ndarray:
    """The prototype of every code point."""
    if letters not in _tables:
        t = np.arange(0x110000, dtype=np.uint32)
        for n in range(0x10000):
            c = chr(n)
            if unicodedata.category(c) == "Zs":
                t[n] = ord(" ")
            elif unicodedata.category(c) == "Cc" and c not in BLANK_CONTROLS:
                t[n] = GONE
            elif n >= 0x3000 and (parts := unicodedata.decomposition(c)).startswith(("<wide>", "<narrow>")):
                t[n] = int(parts.split()[1], 16)  # one character each
        for c in LINE_ENDS:
            t[ord(c)] = ord("\n")
        t[ord(EMPTY_PATTERN)] = ord(" ")
        for a, b in UNSEEN:
            t[a : b + 1] = GONE
        for c, p in letters:
            t[ord(c)] = ord(p)
        _tables[letters] = t
    return _tables[letters]


def forms(texts: list[str], letters: tuple[tuple[str, str], ...]) -> list[str]:
    """The composed skeleton of each text."""
    apart = [unicodedata.normalize("NFD", t) for t in texts]
    points = _table(letters)[np.frombuffer("".join(apart).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    kept = points != GONE
    ends = np.r_[0, np.cumsum(kept)][np.r_[0, np.cumsum([len(t) for t in apart])].astype(np.int64)]
    whole = points[kept].tobytes().decode("utf-32-le", "surrogatepass")
    return [unicodedata.normalize("NFC", whole[a:b]) for a, b in zip(ends[:-1], ends[1:])]


def consistent_form(text: Column, spark: SparkSession | None = None) -> Column:
    """The skeleton of each text, composed: equal for texts that look the same, and itself a text that looks like them; null for null.

    ASCII texts without controls are their own and don't travel to Python.
    """
    letters = tuple(sorted(look_alike_letters(spark or SparkSession.getActiveSession()).items()))

    @F.pandas_udf("string")
    def of(values: pd.Series) -> pd.Series:
        there = values.notna().to_numpy()
        out = np.full(len(values), None, dtype=object)
        out[there] = forms(values[there].tolist(), letters)
        return pd.Series(out)

    other = (F.length(text) != F.octet_length(text)) | text.rlike(ASCII_GONE)
    return F.when(other, of(F.when(other, text))).otherwise(text)


#: looks that several strings share, as digests, that may be broadcast, about 10 MB
BROADCAST_LOOKS = 100_000


def _looks(spark: SparkSession, documents: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: documents (_id, form, look), forms (look, form, n) and looks of several forms (look, forms, all)."""
    docs = documents.select(F.col(key).alias("_id"), F.col(text).cast("string").alias("_t")).where("_t is not null and _id is not null")
    look = consistent_form(F.col("_t"), spark)
    docs = docs.select("_id", F.sha2("_t", 256).alias("form"), look.alias("_s")).where(F.col("_s").rlike(r"\S")).select("_id", "form", F.sha2("_s", 256).alias("look"))
    stages = Stages(spark, "skeleton")
    docs = stages.keep(docs)
    per_form = stages.keep(docs.groupBy("look", "form").agg(F.count("*").alias("n")))
    several = stages.keep(per_form.groupBy("look").agg(F.count("*").alias("forms"), F.sum("n").alias("all")).where("forms > 1"))
    return docs, per_form, several


def look_alikes(spark: SparkSession, documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, look, form, forms, links): documents whose look several different strings share.

    look identifies the skeleton, form the string; forms: the strings of that look, links: the rows of its
    other strings. Null texts, rows without a key, texts without a visible character, and texts only met as
    exact copies are left out. Repeated rows are repeated.
    """
    docs, per_form, several = _looks(spark, documents, key, text)
    # written tables on both sides let AQE split a look that a third of the documents share
    links = Stages(spark, "links").keep(per_form.join(broadcast_if_small(several, BROADCAST_LOOKS), "look").select("look", "form", "forms", (F.col("all") - F.col("n")).alias("links")))
    return docs.join(broadcast_if_small(links, BROADCAST_LOOKS), ["look", "form"]).select(F.col("_id").alias(key), "look", "form", "forms", "links")


def look_alike_pairs(spark: SparkSession, documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key_a, key_b), a before b: pairs that look the same but are different strings.

    Pairs are made between different forms of a look, then each form is replaced by its documents, so
    exact copies never meet each other.
    """
    stages = Stages(spark, "look-alikes")
    docs, per_form, several = _looks(spark, documents, key, text)
    looks = broadcast_if_small(several.select("look"), BROADCAST_LOOKS)
    forms = per_form.join(looks, "look").select("look", "form")
    pairs = stages.keep(forms.join(forms.withColumnRenamed("form", "other"), "look").where("form < other").select("form", "other"))
    docs = stages.keep(docs.join(looks, "look").select("_id", "form"))
    left = pairs.join(docs.withColumnRenamed("_id", "_a"), "form").select("other", "_a")
    both = left.join(docs.select(F.col("_id").alias("_b"), F.col("form").alias("other")), "other")
    return both.select(F.least("_a", "_b").alias(f"{key}_a"), F.greatest("_a", "_b").alias(f"{key}_b"))
