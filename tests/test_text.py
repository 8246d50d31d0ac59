import hashlib
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from cinderfold.functions import text

ALPHABET = list("aBé ﬁ²Å汉\n\n\n  \t\r\x1c\x85\xa0  　İΣ\x00\x7f~ß½")


def clean(t):
    t = unicodedata.normalize("NFKD", t)
    t = "".join(c for c in t if c in "\n\t" or 32 <= ord(c) < 127)
    t = re.sub(r"\n{3,}", "\n\n", t)
    t = "\n".join(line.strip() for line in t.split("\n"))
    return re.sub(r" {2,}", " ", t).strip()


def normal(t):
    return re.sub(r"\s+", " ", t.strip().lower())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    return ["", " ", "a\n \n \nb", "x\ty\rz", *("".join(rng.choices(ALPHABET, k=rng.randint(0, 30))) for _ in range(1500))]


def test_against_plain_python(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    t = F.col("t")
    digest = text.content_hash(t)
    rows = df.select("i", text.clean_text(t).alias("c"), text.normal_form(t).alias("n"), digest.alias("h"), text.hash_bucket(digest).alias("b"), text.words(t).alias("w"), text.alphabetic(t).alias("a"), text.shingles(text.alphabetic(t)).alias("s")).collect()
    for r in rows:
        t = texts[r.i]
        h = hashlib.md5(normal(t).encode()).hexdigest()
        own = [x.lower() for x in re.findall("[A-Za-z]+", t)]
        assert r.c == clean(t)
        assert (r.n, r.h, r.b) == (normal(t), h, int(h, 16) % 100)
        assert r.w == t.lower().split() and r.a == own
        assert sorted(r.s) == sorted({" ".join(own[i : i + 4]) for i in range(len(own) - 3)})


def test_nulls(spark):
    t = F.lit(None).cast("string")
    r = spark.range(1).select(text.clean_text(t), text.normal_form(t), text.words(t), text.alphabetic(t), text.shingles(text.alphabetic(t))).first()
    assert tuple(r) == ("", "", [], [], [])


def test_descriptions(spark):
    rows = [([("de", "eins"), ("en", "one")], "one"), ([("de", "eins"), ("en", "")], "eins"), ([("fr", "un")], "un"), ([], None), (None, None)]
    df = spark.createDataFrame(rows, "d array<struct<lang: string, value: string>>, e string")
    assert all(r.got == r.e for r in df.select("e", text.english_or_first(F.col("d")).alias("got")).collect())


def test_strip_prompt(spark):
    df = spark.createDataFrame([("ab  cd ", "ab", "cd"), (" x ab", "ab", "x ab"), ("ab", "ab", "")], "o string, p string, e string")
    assert all(r.got == r.e for r in df.select("e", text.strip_prompt(F.col("o"), F.col("p")).alias("got")).collect())
