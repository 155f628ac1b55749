"""Review-shaped inputs derived from the given tables.

The derivations are SQL expressions both engines understand, so a query and its SQL
twin start from identical rows.  Everything is a function of the stored columns:
nothing is random and every row of the table is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CLASSES = (1, 2, 3, 4, 5)

# Raw reviews from documents.  Suffixes depend on the length, so exact copies of a
# text stay copies.
_SUFFIX = """CASE n_chars % 17
 WHEN 0 THEN ' Ставлю 5 звёзд, всё отлично' WHEN 1 THEN ' Итого 4 из 5'
 WHEN 2 THEN ' Оценка: 3' WHEN 3 THEN ' поставил бы тройку'
 WHEN 4 THEN ' отель на пятёрку' WHEN 5 THEN ' сначала 2 звезды, потом поставил 5'
 WHEN 6 THEN ' 10 из 10 рекомендую' WHEN 7 THEN ' дам две звезды 😀'
 WHEN 8 THEN concat(' см. www.example.org', chr(92), 'nСтрока ⭐!!')
 WHEN 9 THEN concat('  ', chr(160), ' ') ELSE '' END"""
REVIEW_COLUMNS = {
    "row_id": "doc_id",
    "text": f"CASE WHEN doc_id % 97 = 5 THEN NULL WHEN doc_id % 89 = 4 THEN ' ' "
            f"ELSE concat(text, {_SUFFIX}) END",
    "rating": "CASE WHEN doc_id % 101 = 7 THEN NULL ELSE "
              "CAST((n_chars + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END) % 6 AS DOUBLE) END",
    "name_ru": "CASE WHEN doc_id % 53 = 0 THEN NULL WHEN doc_id % 59 = 0 THEN ' ' "
               "WHEN doc_id % 4 = 1 THEN concat('КАФЁ  ', upper(source), ' ', CAST(doc_id % 9 AS VARCHAR(9))) "
               "ELSE concat('Кафе ', source, ' ', CAST(doc_id % 9 AS VARCHAR(9))) END",
    "address": "concat(lang, ', ул. ', CAST(doc_id % 5 AS VARCHAR(9)))",
    "rubrics": "CASE WHEN doc_id % 23 = 0 THEN NULL WHEN doc_id % 29 = 0 THEN ' ;x' "
               "ELSE concat(source, ' ;', lang) END",
}
REVIEWS = "SELECT " + ", ".join(f"{v} AS {k}" for k, v in REVIEW_COLUMNS.items()) + " FROM documents"

# Ratings and groups from orders.
ORDER_COLUMNS = {
    "row_id": "o_orderkey",
    "y_true": "CAST(substr(o_orderpriority, 1, 1) AS INT)",
    "grp": "o_custkey",
}
ORDERS = "SELECT " + ", ".join(f"{v} AS {k}" for k, v in ORDER_COLUMNS.items()) + " FROM orders"


def _weight(model: int, k: int, rid: str, y: str) -> str:
    """Integer class weight of one model: pseudo-noise plus a bonus on the truth."""
    return (
        f"(1 + ({rid} * {7 + 2 * model} + {k * 31 + 11 * model}) % 23 + CASE WHEN {y} = {k} "
        f"AND ({rid} * 13 + {model * 17}) % 10 < {5 + model} THEN 40 ELSE 0 END)"
    )


def _weights(model: int) -> list[str]:
    return [f"{_weight(model, k, 'row_id', 'y_true')} AS w{k}" for k in CLASSES]


_SHARES = [f"CAST(w{k} AS DOUBLE) / CAST(w1 + w2 + w3 + w4 + w5 AS DOUBLE) AS p{k}" for k in CLASSES]


def argmax_sql(prefix: str = "p") -> str:
    top = f"greatest({', '.join(f'{prefix}{k}' for k in CLASSES)})"
    whens = " ".join(f"WHEN {prefix}{k} = {top} THEN {k}" for k in CLASSES)
    return f"CAST(CASE {whens} END AS INT)"


def predictions_sql(model: int, source: str) -> str:
    """Predictions of one model over a (row_id, y_true, ...) source: p1..p5 and y_pred."""
    return (
        f"SELECT *, {argmax_sql()} AS y_pred FROM (SELECT * EXCLUDE (w1, w2, w3, w4, w5), {', '.join(_SHARES)} "
        f"FROM (SELECT s.*, {', '.join(_weights(model))} FROM ({source}) s) w) t"
    )


MODELS = {"baseline": 0, "transformer": 2}
SEEDS = {"s1": 2, "s2": 3, "s3": 4}

# Review predictions: ratings 1-5 for every document.
REVIEW_TRUTH = "SELECT doc_id AS row_id, CAST(1 + n_chars % 5 AS INT) AS y_true FROM documents"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """The documents.  A session whose table is one unsplittable row group may name a
    partition count in ``spark.rateforge.textPartitions``; without it nothing moves.
    """
    df = table(spark, sf, "documents")
    spread = spark.conf.get("spark.rateforge.textPartitions", None)
    return df.repartition(int(spread), "doc_id") if spread else df


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf).selectExpr(
        *[f"{v} AS {k}" for k, v in REVIEW_COLUMNS.items()]
    )


def rated_orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(*[f"{v} AS {k}" for k, v in ORDER_COLUMNS.items()])


def review_truth(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").selectExpr(
        "doc_id AS row_id", "CAST(1 + n_chars % 5 AS INT) AS y_true"
    )


def predictions(df: DataFrame, model: int) -> DataFrame:
    """Spark form of ``predictions_sql``, with the confidence.

    The class with the largest weight has the largest share, so prediction and
    confidence are read off the integers.
    """
    weighted = df.selectExpr("*", *_weights(model))
    conf = "CAST(greatest(w1, w2, w3, w4, w5) AS DOUBLE) / CAST(w1 + w2 + w3 + w4 + w5 AS DOUBLE) AS conf"
    return weighted.selectExpr(*df.columns, *_SHARES, f"{argmax_sql('w')} AS y_pred", conf)


# SQL building blocks shared by the twins.
WS = (
    r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
NOT_WS = "[^" + WS[1:]
W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"


def sq(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '{WS}+', ' ', 'g'), ' ')"


def fold(expr: str) -> str:
    return f"translate(replace(lower({expr}), 'ß', 'ss'), 'ςſµ', 'σsμ')"


def norm_text(expr: str) -> str:
    return sq(f"regexp_replace(coalesce({expr}, ''), '\\\\[nrt]', ' ', 'g')")


def norm_key(expr: str) -> str:
    return sq(f"replace({fold(f'coalesce({expr}, chr(32))')}, 'ё', 'е')")


def words(expr: str) -> str:
    return f"len(regexp_extract_all({expr}, '{NOT_WS}+'))"


def md5_hash(seed: str, *ids: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *[f"CAST({i} AS VARCHAR)" for i in ids]])
    return f"CAST(('0x' || substr(md5({text}), 1, 15)) AS BIGINT)"


CLEANED = f"""
raw AS ({REVIEWS}),
norm AS (SELECT row_id, {norm_text('text')} AS text, rating, name_ru, address, rubrics FROM raw),
s1 AS (SELECT * FROM norm WHERE coalesce(rating BETWEEN 1 AND 5, false)),
s2 AS (SELECT * FROM s1 WHERE name_ru IS NOT NULL AND {sq('name_ru')} <> ''),
s3 AS (SELECT * FROM s2 WHERE {words('text')} >= 1),
keyed AS (SELECT *, {fold('text')} AS k FROM s3),
s4 AS (SELECT * FROM keyed WHERE k NOT IN (SELECT k FROM keyed GROUP BY k HAVING count(DISTINCT rating) > 1)),
s5 AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY row_id) AS rn FROM s4) WHERE rn = 1),
clean AS (SELECT row_id, text, CAST(rating AS TINYINT) AS rating, name_ru, address, rubrics,
 {norm_key('name_ru')} AS gk_name, {norm_key('address')} AS addr_key,
 {norm_key('name_ru')} || ' | ' || {norm_key('address')} AS gk_name_addr FROM s5)"""

NORMALISED = f"""
raw AS ({REVIEWS}),
norm AS (SELECT row_id, {norm_text('text')} AS text, rating, name_ru, address, rubrics FROM raw),
named AS (SELECT *, {norm_key('name_ru')} AS gk_name, {norm_key('address')} AS addr_key FROM norm
 WHERE {sq("coalesce(name_ru, '')")} <> '' AND coalesce(rating BETWEEN 1 AND 5, false))"""
