import pytest
from pyspark.sql import functions as F

from rateforge.functions import bins, mentions, text as tx


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "t string").select(build(F.col("t"))).first()[0]


@pytest.mark.parametrize("raw, want", [
    (None, ""), ("a\\nb\\r\\tc", "a b c"), ("a\\\\b", "a\\\\b"), ("  x  y\n", "x y"),
])
def test_normalize_text(spark, raw, want):
    assert one(spark, raw, tx.normalize_text) == want


@pytest.mark.parametrize("raw, want", [
    (None, ""), ("  ЁЛКА  и  Straße ", "елка и strasse"), ("ΟΔΟΣ", "οδοσ"),
])
def test_norm_key(spark, raw, want):
    assert one(spark, raw, tx.norm_key) == want


@pytest.mark.parametrize("raw, want", [("", 0), ("  ", 0), (" a  b c ", 3), (None, None)])
def test_word_count(spark, raw, want):
    assert one(spark, raw, tx.word_count) == want


def test_length_counts_code_points(spark):
    assert one(spark, "a😀б", F.length) == 3


def test_snippets(spark):
    assert one(spark, "a|b\nc", lambda t: tx.snippet(t, 3)) == "a/b…"
    assert one(spark, "a|  b\n c", lambda t: tx.squeezed_snippet(t, 350)) == "a/ b c"


def test_list_parts(spark):
    assert one(spark, "Кафе;Бар", lambda t: tx.first_item_or(t, "без рубрики")) == "Кафе"
    assert one(spark, None, lambda t: tx.first_item_or(t, "без рубрики")) == "без рубрики"
    assert one(spark, " ;x", lambda t: tx.first_item_or(t, "без рубрики")) == "без рубрики"
    assert one(spark, "a;b;c", tx.item_count) == 3


def test_shingles(spark):
    df = spark.createDataFrame([("a b c d",), ("a b",)], "t string")
    rows = df.select(tx.tokens(F.col("t")).alias("w")).select(tx.shingles(F.col("w")).alias("s")).collect()
    assert [r.s for r in rows] == [["a b c", "b c d"], ["a b"]]


@pytest.mark.parametrize("text, want", [
    ("Ставлю 5 звёзд, всё отлично", 5), ("Итого 4 из 5", 4), ("Оценка: 3", 3),
    ("поставил бы тройку", 3), ("на пятёрку", 5), ("Были в 5 часов вечера, очень вкусно", None),
    ("10 из 10 рекомендую", None), ("сначала 2 звезды, потом поставил 5", 2),
])
def test_earliest_mention(spark, text, want):
    assert one(spark, text, mentions.earliest_mention) == want


@pytest.mark.parametrize("text, want", [
    ("5 звёзд", 5), ("ставлю 4", 4), ("две звезды", 2), ("поставил 15", None), ("15 звёзд", None),
    ("ставлю 2, а было 5 из 5", 5), ("просто текст", None),
])
def test_prioritised_mention(spark, text, want):
    assert one(spark, text, mentions.prioritised_mention) == want


def test_bins(spark):
    df = spark.createDataFrame([(0.39,), (0.4,), (0.95,), (1.0,), (1.1,), (None,)], "c double")
    labels = [r[0] for r in df.select(bins.confidence_bin(F.col("c"))).collect()]
    assert labels == ["<0.4", "0.4-0.5", "0.95+", "0.95+", None, None]
    df = spark.createDataFrame([(49,), (50,), (800,)], "c int")
    assert [r[0] for r in df.select(bins.length_bin(F.col("c"))).collect()] == ["<50", "50-99", "800+"]


def test_casefold_equals_python_on_every_code_point(spark):
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    step = 500
    rows = [(i, "".join(map(chr, codes[i:i + step]))) for i in range(0, len(codes), step)]
    rows += [(-1, "Straße ΌΣΟΣ İstanbul ﬃ ŉ Ёлка"), (-2, "plain"), (-3, None)]
    df = spark.createDataFrame(rows, "i long, t string").repartition(4)
    got = {r.i: r.f for r in df.select("i", tx.casefold(F.col("t")).alias("f")).collect()}
    assert all(got[i] == (t.casefold() if t is not None else None) for i, t in rows)


def test_common_texts_are_not_translated_character_by_character(spark):
    common = ["Straße, Œuvre à l’été – „Ñandú“", "ΌΣΟΣ Ёлка İ 日本語 😀", "ſtoff µ-Zahl"]
    rare = ["\ufb03", "\u1e9e", "\u10a0", "\u0149", "\u2c00", "\U00010400"]
    df = spark.createDataFrame([(t,) for t in common + rare], "t string")
    found = {r.t: (r.rare, r.f) for r in df.select("t", F.regexp_like("t", F.lit(tx._rare_class())).alias("rare"), tx.casefold(F.col("t")).alias("f")).collect()}
    assert found == {t: (t in rare, t.casefold()) for t in common + rare}
