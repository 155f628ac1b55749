"""Sampling, splits, fingerprints, leakage checks and near-duplicates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.hashing import seeded_hash
from ..operators import leakage, neardup, profile, sampling, splitting
from ..plans.materialize import cut, shared_folder
from ..sources import tables
from .inputs import (
    CLASSES, ORDERS, W, fold, md5_hash, rated_orders, table, texts,
)
from .registry import query

FRACTIONS = splitting.FRACTIONS


# ------------------------------------------------------------------ sampling
@query("T4_exact_sample", f"SELECT row_id FROM ({ORDERS}) ORDER BY {md5_hash('42', 'row_id')}, row_id LIMIT 500")
def _(spark, sf):
    return sampling.sample(rated_orders(spark, sf), 500, 42).select("row_id")


@query("T5_sample_per_stratum", f"""SELECT row_id, y_true FROM (SELECT *, row_number() OVER (PARTITION BY y_true ORDER BY {md5_hash('7', 'row_id')}, row_id) AS r
 FROM ({ORDERS})) WHERE r <= 40""")
def _(spark, sf):
    return sampling.sample_per_stratum(rated_orders(spark, sf), 40, 7, ["y_true"]).select("row_id", "y_true")


@query("T8_nested_subsamples", f"""SELECT row_id, rep AS repeat, 42 + rep AS seed, size FROM (SELECT row_id, rep, row_number() OVER (PARTITION BY rep ORDER BY
 CAST(('0x' || substr(md5(CAST(42 + rep AS VARCHAR) || '|' || CAST(row_id AS VARCHAR)), 1, 15)) AS BIGINT), row_id) AS r FROM ({ORDERS}), (VALUES (0), (1), (2)) v(rep)),
 (VALUES (100), (250), (500)) z(size) WHERE r <= size""")
def _(spark, sf):
    out = sampling.nested_subsamples(rated_orders(spark, sf), [100, 250, 500], 3, 42)
    return out.select("row_id", "repeat", "seed", "size")


# -------------------------------------------------------------------- splits
_CELLS = ", ".join(f"count(*) FILTER (y_true = {k}) AS c{k}" for k in CLASSES)
_TOP = "greatest(c1, c2, c3, c4, c5)"
_LEAD = "CASE " + " ".join(f"WHEN c{k} = {_TOP} THEN {k}" for k in CLASSES) + " END"
SPLIT = f"""g AS (SELECT grp, count(*) AS n, {_CELLS} FROM ({ORDERS}) GROUP BY grp),
 h AS (SELECT grp, length(bin(n)) AS size_class, {_LEAD} AS lead, CAST(floor({_TOP} * 4.0 / n) AS BIGINT) AS purity FROM g),
 r AS (SELECT *, row_number() OVER (PARTITION BY size_class, lead, purity ORDER BY {md5_hash('42', 'grp')}, grp) AS rnk FROM h),
 u AS (SELECT grp, (rnk % 1000000000 * 6180339887 + {md5_hash('42', 'size_class', 'lead', 'purity')}) % 10000000000 AS pos FROM r),
 sp AS (SELECT grp, CASE WHEN pos < 1500000000 THEN 'test' WHEN pos < 3000000000 THEN 'val' ELSE 'train' END AS split FROM u),
 ds AS (SELECT o.*, split FROM ({ORDERS}) o JOIN sp USING (grp))"""


def split_orders(spark, sf):
    """Orders split by customer; no customer is large enough to be placed explicitly."""
    return splitting.make_split(
        rated_orders(spark, sf), 42, FRACTIONS, "grp", "y_true", CLASSES, head_share=0.05
    )


@query("X1_group_split", f"WITH {SPLIT} SELECT row_id, grp, y_true, split FROM ds")
def _(spark, sf):
    return split_orders(spark, sf)


_HOT = "(SELECT CASE WHEN doc_id % 3 = 0 THEN 'hot' ELSE concat(source, lang) END AS grp FROM documents)"


@query("X1_group_split_with_hot_groups", f"""SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(DISTINCT grp) FROM {_HOT}) AS groups,
 true AS groups_whole, true AS ids_whole, true AS hot_in_train, true AS parts_known""")
def _(spark, sf):
    rows = table(spark, sf, "documents").selectExpr(
        "doc_id AS row_id", "CASE WHEN doc_id % 3 = 0 THEN 'hot' ELSE concat(source, lang) END AS grp",
        "CAST(1 + n_chars % 5 AS INT) AS y_true",
    )
    out = cut(splitting.make_split(rows, 42, FRACTIONS, "grp", "y_true", CLASSES))
    # The draw itself is ours; what every draw must keep is checked over all rows.
    groups = out.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("split").alias("a"), F.max("split").alias("b"))
    missing = rows.join(out, "row_id", "left_anti").count()
    return groups.agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"), F.bool_and(F.col("a") == F.col("b")).alias("groups_whole"),
        F.lit(missing == 0).alias("ids_whole"), F.bool_and((F.col("grp") != "hot") | (F.col("a") == "train")).alias("hot_in_train"),
        F.bool_and(F.col("a").isin(*splitting.PARTS)).alias("parts_known"),
    )


@query("X3_random_split", f"""WITH n AS (SELECT count(*) AS n FROM ({ORDERS})), r AS (SELECT row_id, row_number() OVER (ORDER BY {md5_hash('42', 'row_id')}, row_id) AS r FROM ({ORDERS}))
 SELECT row_id, CASE WHEN r <= floor(n * 0.7) THEN 'train' WHEN r <= floor(n * 0.7) + floor(n * 0.15) THEN 'val' ELSE 'test' END AS split FROM r, n""")
def _(spark, sf):
    return splitting.random_split(rated_orders(spark, sf), 42).select("row_id", "split")


@query("X4_T1_split_summary", f"""WITH {SPLIT} SELECT split, count(*) AS rows, count(DISTINCT grp) AS groups, count(*) / CAST((SELECT count(*) FROM ds) AS DOUBLE) AS share,
 {', '.join(f'count(*) FILTER (y_true = {k}) / CAST(count(*) AS DOUBLE) AS share_{k}' for k in CLASSES)},
 CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 ELSE 3 END AS part_no FROM ds GROUP BY split ORDER BY part_no""")
def _(spark, sf):
    return splitting.split_summary(split_orders(spark, sf), "grp", "y_true")


def _digest(salt: str) -> str:
    return f"CAST(sum({md5_hash(salt, 'row_id')}) % 9007199254740881 AS BIGINT) AS digest_{salt}"


@query("A19_fingerprint", f"SELECT count(row_id) AS n, {_digest('a')}, {_digest('b')} FROM ({ORDERS})")
def _(spark, sf):
    return splitting.fingerprint(rated_orders(spark, sf))


_LEVEL = "SELECT node >> 16 AS node, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(node || ':' || digest, ',' ORDER BY node)) AS digest FROM {} GROUP BY 1"
_LEAVES = """SELECT id >> 16 AS node, CAST(sum(c) AS BIGINT) AS n, sha256(string_agg(CASE WHEN c = 1 THEN CAST(id AS VARCHAR) ELSE id || '*' || c END, ',' ORDER BY id)) AS digest
 FROM (SELECT row_id AS id, count(*) AS c FROM {} GROUP BY 1) GROUP BY 1"""


@query("A19_id_hash_tree", f"""WITH l0 AS ({_LEAVES.format(f'({ORDERS})')}), l1 AS ({_LEVEL.format('l0')}), l2 AS ({_LEVEL.format('l1')}), l3 AS ({_LEVEL.format('l2')})
 SELECT CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(node || ':' || digest, ',' ORDER BY node)) AS digest FROM l3""")
def _(spark, sf):
    return splitting.id_digest(rated_orders(spark, sf))


@query("A19_changed_ranges", f"""WITH o AS ({ORDERS}), a AS ({_LEAVES.format('o')}), b AS ({_LEAVES.format('(SELECT row_id FROM o WHERE row_id <> 7 UNION ALL SELECT -5)')})
 SELECT coalesce(a.node, b.node) << 16 AS first_id, (coalesce(a.node, b.node) << 16) + 65535 AS last_id, coalesce(a.n, 0) AS n_before, coalesce(b.n, 0) AS n_after
 FROM a FULL JOIN b ON a.node = b.node WHERE a.digest IS DISTINCT FROM b.digest""".replace("coalesce(a.node, b.node) << 16", "coalesce(a.node, b.node) * 65536"))
def _(spark, sf):
    ids = rated_orders(spark, sf).select("row_id")
    other = ids.where("row_id <> 7").unionByName(ids.sparkSession.range(1).selectExpr("-5L AS row_id"))
    return splitting.changed_ranges(splitting.id_leaves(ids), splitting.id_leaves(other))


@query("K4_split_metadata", f"""WITH {SPLIT} SELECT split, count(*) AS rows, {_digest('a')}, {_digest('b')}, count(DISTINCT grp) AS groups,
 count(*) / CAST((SELECT count(*) FROM ds) AS DOUBLE) AS share FROM ds GROUP BY split""")
def _(spark, sf):
    return splitting.split_metadata(split_orders(spark, sf), "grp")


@query("A18_class_spread", f"""WITH {SPLIT}, s AS (SELECT split, {', '.join(f'count(*) FILTER (y_true = {k}) / CAST(count(*) AS DOUBLE) AS s{k}' for k in CLASSES)} FROM ds GROUP BY split)
 SELECT round(greatest({', '.join(f'max(s{k}) - min(s{k})' for k in CLASSES)}), 9) AS max_spread FROM s""")
def _(spark, sf):
    out = profile.class_spread(split_orders(spark, sf), "split", "y_true", list(CLASSES))
    return out.select(F.round("max_spread", 9).alias("max_spread"))


@query("F10_split_guard", f"WITH {SPLIT} SELECT row_id, split FROM ds WHERE split = 'val'")
def _(spark, sf):
    return splitting.select_eval(split_orders(spark, sf), "val").select("row_id", "split")


@query("X5_load_split", f"WITH {SPLIT} SELECT row_id, y_true, split FROM ds")
def _(spark, sf):
    from ..operators.joins import load_split

    parts = split_orders(spark, sf).select("row_id", "split")
    return load_split(rated_orders(spark, sf).select("row_id", "y_true"), parts)


# ------------------------------------------------------------------- leakage
# Documents dealt to parts by a hash of their id: copies do cross parts.
_PART = "CASE WHEN {0} % 20 < 3 THEN 'test' WHEN {0} % 20 < 6 THEN 'val' ELSE 'train' END"
_DOCS = f"docs AS (SELECT doc_id AS row_id, text, source, {_PART.format(md5_hash('part', 'doc_id'))} AS split FROM documents)"


def split_documents(spark, sf):
    h = seeded_hash("part", F.col("doc_id")) % 20
    part = F.when(h < 3, "test").when(h < 6, "val").otherwise("train")
    return texts(spark, sf).select(F.col("doc_id").alias("row_id"), "text", "source", part.alias("split"))


def _crossing(key: str, source: str) -> str:
    return f"SELECT count(*) AS crossing FROM (SELECT {key} AS k FROM {source} GROUP BY 1 HAVING count(DISTINCT split) > 1)"


@query("U2_group_overlap", f"WITH {SPLIT} {_crossing('grp', 'ds')}")
def _(spark, sf):
    return leakage.group_overlap(split_orders(spark, sf), "grp")


@query("U2_group_overlap_leaky", f"WITH {_DOCS} {_crossing('source', 'docs')}")
def _(spark, sf):
    return leakage.group_overlap(split_documents(spark, sf), "source")


@query("U3_text_overlap", f"WITH {_DOCS} {_crossing(fold('text'), 'docs')}")
def _(spark, sf):
    return leakage.text_overlap(split_documents(spark, sf))


_BARE = f"trim(regexp_replace({fold('text')}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')"


@query("N9_punctuation_free_copies", f"""WITH {_DOCS}, k AS (SELECT {_BARE} AS k, count(*) AS n, count(DISTINCT split) AS s FROM docs GROUP BY 1)
 SELECT CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS rows_in_groups, count(*) FILTER (s > 1) AS crossing FROM k""")
def _(spark, sf):
    return leakage.punctuation_free_copies(split_documents(spark, sf))


@query("N10_leakage_verdict", f"""WITH {_DOCS}, v AS (SELECT 'group_overlap' AS "check", ({_crossing('source', 'docs')}) AS value
 UNION ALL SELECT 'text_overlap', ({_crossing(fold('text'), 'docs')}) UNION ALL SELECT 'test_ids_changed', 0)
 SELECT "check", value, CASE WHEN value = 0 THEN 'PASS' ELSE 'FAIL' END AS result FROM v""")
def _(spark, sf):
    """The test ids are held against the manifest that was published with the split."""
    docs = split_documents(spark, sf)
    folder = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    tables.save_split(docs.drop("split"), docs.select("row_id", "split"), folder, version="v1", seed=42, group_col="source")
    manifest = tables.split_manifest(spark, folder, "v1").where(F.col("split") == "test")
    return leakage.leakage_verdict(docs, "source", manifest.withColumnRenamed("rows", "n"))


# ----------------------------------------------------------- near-duplicates
NEAR = f"""{_DOCS}, w AS (SELECT row_id, split, regexp_extract_all({fold('text')}, '{W}+') AS t FROM docs),
 sh AS (SELECT row_id, split, len(t) AS nt, list_distinct(CASE WHEN len(t) < 3 THEN [array_to_string(t, ' ')] ELSE
 list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) END) AS s FROM w),
 pt AS (SELECT row_id, split, len(s) AS m, unnest(s) AS x FROM sh),
 pairs AS (SELECT q.row_id AS q, t.row_id AS t, count(*) AS c, any_value(q.m) AS qm, any_value(t.m) AS tm FROM pt q JOIN pt t USING (x)
 WHERE q.split <> 'train' AND t.split = 'train' GROUP BY 1, 2), hits AS (SELECT q, t FROM pairs WHERE c / CAST(qm + tm - c AS DOUBLE) >= 0.8),
 fl AS (SELECT split AS part, row_id, nt < 5 AS short, row_id IN (SELECT q FROM hits) AS has_dup FROM sh WHERE split <> 'train')"""


@query("N3_J6_near_duplicates", f"WITH {NEAR} SELECT * FROM fl")
def _(spark, sf):
    return neardup.near_duplicates(split_documents(spark, sf), n_query=None)


@query("N4_near_duplicate_rates", f"""WITH {NEAR} SELECT part AS value, count(*) AS n, count(*) FILTER (has_dup) AS hits, avg(CASE WHEN has_dup THEN 1.0 ELSE 0.0 END) AS rate, 'part' AS slice FROM fl GROUP BY 1
 UNION ALL SELECT CASE WHEN short THEN 'short' ELSE 'long' END, count(*), count(*) FILTER (has_dup), avg(CASE WHEN has_dup THEN 1.0 ELSE 0.0 END), 'length' FROM fl GROUP BY 1""")
def _(spark, sf):
    return neardup.near_duplicate_rates(neardup.near_duplicates(split_documents(spark, sf), n_query=None))


_ORDER = f"CASE WHEN part = 'val' THEN 0 ELSE 1 END, {md5_hash('42', 'row_id')}, row_id"


@query("N5_J5_near_duplicate_examples", f"""WITH {NEAR}, o AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS r FROM fl WHERE has_dup),
 ch AS (SELECT * FROM o WHERE r <= 4 OR NOT short ORDER BY r LIMIT 10), pp AS (SELECT part, row_id, (SELECT min(t) FROM hits WHERE q = row_id) AS partner_id FROM ch)
 SELECT part, pp.row_id, partner_id, {{}} FROM pp JOIN docs a ON a.row_id = pp.row_id JOIN docs b ON b.row_id = partner_id""".replace("{}", ", ".join(
    f"substr({t}, 1, 140) || CASE WHEN length({t}) > 140 THEN '…' ELSE '' END AS {n}"
    for t, n in (("replace(replace(a.text, '|', '/'), chr(10), ' ')", "left_text"), ("replace(replace(b.text, '|', '/'), chr(10), ' ')", "right_text")))))
def _(spark, sf):
    docs = split_documents(spark, sf)
    train = neardup.train_sets(docs)
    flags = neardup.near_duplicates(docs, n_query=None, train=train)
    return neardup.near_duplicate_examples(docs, flags, train=train)
