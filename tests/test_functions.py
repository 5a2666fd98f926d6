import pytest
from pyspark.sql import functions as F

from threadloom.functions import measures, moments, text


def one(spark, column, value, ddl="v string"):
    return spark.createDataFrame([(value,)], ddl).select(column(F.col("v")).alias("r")).head()["r"]


@pytest.mark.parametrize("raw, clean", [
    ("@alice hello @bob world", "hello world"),
    ("check https://example.com now", "check now"),
    ("price: 5$ #ev!", "price 5 #ev"),
    ("xe cũ đẹp", "xe c p"),
    ("rocket 🚀 coffee ☕", "rocket 🚀 coffee"),
    ("a\n\nb\nc", "a b\nc"),
    ("ht@x tp://y", "ht tpy"),
    ('11:20 had the "companion mode" way before IOS...just saying', "1120 had the companion mode way before IOSjust saying"),
    ("emojicat youtubers\n\nI also feel like im", "emojicat youtubers I also feel like im"),
    (None, None),
])
def test_clean_text(spark, raw, clean):
    assert one(spark, text.clean_text, raw) == clean


def test_clean_text_keeps_letters_of_all_scripts_on_request(spark):
    assert one(spark, lambda c: text.clean_text(c, unicode=True), "xe cũ, đẹp!") == "xe cũ đẹp"


@pytest.mark.parametrize("raw, expected", [
    ("Fri May 09 08:14:27 +0000 2026", "2026-05-09 08:14:27"),
    ("Fri May 9 08:14:27 +0700 2026", "2026-05-09 08:14:27"),
    ("not-a-timestamp", None), (None, None),
])
def test_legacy_timestamp(spark, raw, expected):
    got = one(spark, lambda c: moments.parse_legacy_timestamp(c).cast("string"), raw)
    assert got == expected


def test_legacy_timestamp_with_offset(spark):
    parse = lambda c: moments.parse_legacy_timestamp(c, honour_offset=True).cast("string")
    assert one(spark, parse, "Fri May 09 08:14:27 +0700 2026") == "2026-05-09 01:14:27"


def test_iso_timestamp(spark):
    parse = lambda c: moments.parse_iso_timestamp(c).cast("string")
    assert one(spark, parse, "2026-05-09T08:14:27Z") == "2026-05-09 08:14:27"
    assert one(spark, parse, "not-a-date") is None


@pytest.mark.parametrize("raw, sale", [
    ("Cần bán xe gấp", True), ("THANH LÝ nội thất", True), ("thanh_lý", True), ("thanhlý", True),
    ("sang nhượng lại", True), ("second-hand", False), ("xe cũng tốt", False), ("chia sẻ kinh nghiệm", False),
    (None, False),
])
def test_resale(spark, raw, sale):
    assert one(spark, text.is_sale, raw) is sale


@pytest.mark.parametrize("raw, price", [
    ("giá 500tr nhé", True), ("500 TR", True), ("500 trăm", False), ("500 train", False), (None, False),
])
def test_price(spark, raw, price):
    assert one(spark, text.names_price, raw) is price


@pytest.mark.parametrize("raw, hit", [
    ("my iPhone, great", True), ("iOS", True), ("viphones", False), ("éios", False), (None, False),
])
def test_brand_words(spark, raw, hit):
    assert one(spark, lambda c: text.mentions_any(c, ("iphone", "ios")), raw) is hit


def test_first_tokens_and_preview(spark):
    assert one(spark, lambda c: text.first_tokens(c, 2), "  one \n two  three ") == "one two"
    assert one(spark, text.first_tokens, None) == ""
    assert len(one(spark, text.preview, "x" * 300)) == 200
    assert one(spark, text.preview, None) == ""


def test_profanity(spark):
    assert one(spark, text.mask_profanity, "Đm nhanh") == "*** nhanh"
    assert one(spark, text.mask_profanity, "dmz ok") == "dmz ok"
    pieces = one(spark, text.profanity_segments, "a clm b")
    assert [(p["text"], p["flagged"]) for p in pieces] == [("a ", False), ("clm", True), (" b", False)]
    assert one(spark, text.profanity_segments, None) is None


@pytest.mark.parametrize("seconds, label", [(None, "—"), (45.0, "45s"), (125.4, "2m 5s"), (60.0, "1m 0s")])
def test_duration_label(spark, seconds, label):
    assert one(spark, moments.format_duration, seconds, "v double") == label


@pytest.mark.parametrize("part, total, expected", [(1, 3, 33), (1, 8, 13), (2, 0, 0)])
def test_percent(spark, part, total, expected):
    row = spark.createDataFrame([(part, total)], "p int, t int").select(
        measures.percent(F.col("p"), F.col("t")).alias("r")).head()
    assert row["r"] == expected


def test_week_start_is_monday(spark):
    got = one(spark, lambda c: moments.week_start(c.cast("date")).cast("string"), "2026-05-06")
    assert got == "2026-05-04"
