"""Golden rows of the normalisation rules, worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from kinloom.functions.fold import fold, fold_text
from kinloom.functions.text import normalized, skeleton

NAMES = [
    ("Apex Power Private Limited", "apex power pvt ltd", "apex power", "apexpower"),
    ("The PRlVATE Bank", "pvt bank", "bank", "bank"),
    ("Fashi0n Hub", "fashion hub", "fashion hub", "fashionhub"),
    ("Acme Foods DBA Zed Cafe", "zed cafe", "zed cafe", "zedcafe"),
    ("Acme DBA ", "acme dba", "acme dba", "acmedba"),
    ("M/s Rao & Sons (ID: 1728)", "rao and sons", "rao sons", "raosons"),
    ("rkkproducts.com", "rkkproducts", "rkkproducts", "rkkproducts"),
    ("acmefoodscom", "acmefoodscom", "acmefoods", "acmefoods"),
    ("The Company", "co", "co", "co"),
    ("Société Cœur SARL", "societe cur sarl", "societe cur", "societecur"),
    ("", "", "", ""),
    (None, "", "", ""),
    ("ab0c5 x3y 7up0", "ab0c5 x3y 7up0".replace("x3y", "xey").replace("ab0c5", "aboc5"), None, None),
]
ADDRESSES = [
    ("0097 Liberty Street, N/A", "97 liberty st", "97"),
    ("H.No. 16-11-23/37/A", "16 11 23 37", "16 11 23 37"),
    ("12b Rue de la Paix 12", "12b rue de la paix 12", "12"),
    ("First Floor, 3rd Cross", "1st fl 3rd crs", "3"),
    ("NULL", "", ""),
    ("000 0003rd 00000000000000000000000000012", "0 3rd 12", "0 3 12"),
    (None, "", ""),
]


def test_names(spark):
    df = spark.createDataFrame([(i, n, "") for i, (n, *_) in enumerate(NAMES)], "i int, name string, address string")
    for r in normalized(df).collect():
        _, nn, nc, nk = NAMES[r.i]
        assert r.nn == nn, NAMES[r.i]
        if nc is not None:
            assert (r.nc, r.nk) == (nc, nk)


def test_addresses(spark):
    df = spark.createDataFrame([(i, "", a) for i, (a, *_) in enumerate(ADDRESSES)], "i int, name string, address string")
    for r in normalized(df).collect():
        assert (r.an, r.num) == ADDRESSES[r.i][1:], ADDRESSES[r.i]


@pytest.mark.parametrize(("token", "expected"), [("apex", "apks"), ("power", "pvr"), ("chhatra", "ktr"), ("limited", "lmt"), ("123", "123"), ("", "")])
def test_skeleton(spark, token, expected):
    assert spark.range(1).select(skeleton(F.lit(token)).alias("s")).first().s == expected


def test_native_names(spark):
    df = spark.createDataFrame([("एपेक्स पावर", ""), ("एपेक्स पावर लिमिटेड", "")], "name string, address string")
    a, b = normalized(df).select("sk", "nn", "native", "nc").collect()
    assert a.sk == "apks pvr" and a.native
    assert b.nn.endswith(" ltd") and b.nc == a.nc


def test_fold_by_column_is_fold_by_function(spark):
    texts = ["Straße", "œuvre Ærø", "naïve Ångström", "½ ﬁn", "中文 abc", "क्या", "ĳssel", "a‍b", "plain", "", None, "Ⅻ Ω", "é"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", fold(F.col("t")).alias("f")).collect():
        assert r.f == (None if texts[r.i] is None else fold_text(texts[r.i])), texts[r.i]


def test_flags(spark):
    df = spark.createDataFrame([("www.x", ""), ("shop.in", ""), ("shop.inn", ""), ("@me", ""), ("a@b", ""), ("X.COM", "")], "name string, address string")
    assert [r.web for r in normalized(df).collect()] == [True, True, False, True, False, True]


def test_fold_of_every_character(spark):
    """Each code point alone between letters, and random runs of Indic letters, signs, nuktas and marks, against the plain function."""
    every = ["".join(f"k{chr(c)}d " for c in range(at, at + 256) if not 0xD800 <= c < 0xE000) for at in range(0, 0x30000, 256)]
    rng = random.Random(3)
    indic = [[chr(c) for c in range(b, b + 0x80)] + list("jkd ‌‍ﬁ") + [chr(b + 0x3C), chr(b + 0x4D)] * 12 + [chr(b + 0x1C), chr(b + 0x15), chr(b + 0x22)] * 6 for b in range(0x900, 0xD80, 0x80)]
    texts = every + ["".join(rng.choices(letters, k=60)) for letters in indic for _ in range(200)] + ["റ്റ", "क़्", "ज़", "൱़", "ൿ഼ क"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    wrong = [texts[r.i] for r in df.select("i", fold(F.col("t")).alias("f")).collect() if r.f != fold_text(texts[r.i])]
    assert not wrong, (len(wrong), wrong[:3])


def test_skeletons_of_joined_tokens(spark):
    """Tokens joined by blanks have the skeletons that they have alone."""
    rng = random.Random(5)
    tokens = ["".join(rng.choices("aehoucsthpkwzxqy0012", k=rng.randint(1, 7))) for _ in range(600)] + ["1000a", "a1000", "1000", "h", "hh", "0", "a", "ee"]
    alone = [r.s for r in spark.createDataFrame([(t,) for t in tokens], "t string").select(skeleton(F.col("t")).alias("s")).collect()]
    assert spark.range(1).select(skeleton(F.lit(" ".join(tokens))).alias("s")).first().s == " ".join(alone)
    assert dict(zip(tokens, alone)) | {"1000a": "10", "a1000": "a10", "1000": "1000", "hh": "h"} == dict(zip(tokens, alone))
