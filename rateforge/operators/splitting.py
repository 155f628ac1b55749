"""Group-wise, label-balanced train/val/test splits and their metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.hashing import seeded_hash
from ..plans.materialize import cut
from ..plans.ranking import bucket_offsets, label_by_rank, with_hash
from ..plans.skew import HOT_ROWS, attach

PARTS = ("train", "val", "test")
FRACTIONS = (0.70, 0.15, 0.15)

# Low-discrepancy step: the golden ratio in units of 1e-10.
STEP = 6_180_339_887
UNIT = 10_000_000_000
# Prime modulus that keeps fingerprint sums exactly representable.
FINGERPRINT_MODULUS = 9_007_199_254_740_881


def check_fractions(fractions, n_folds: int = 20) -> None:
    """Fractions must be whole folds and add up to all of them."""
    folds = [f * n_folds for f in fractions]
    whole = all(abs(x - round(x)) <= 1e-9 for x in folds)
    if not whole or round(sum(folds)) != n_folds:
        raise ValueError(f"fractions {tuple(fractions)} do not divide into {n_folds} folds")


def group_label_counts(df: DataFrame, group: str, label: str, labels) -> DataFrame:
    """Rows and label counts per group: all later steps work at this grain."""
    cells = [F.count_if(F.col(label) == F.lit(v)).alias(f"c{i + 1}") for i, v in enumerate(labels)]
    return (
        df.where(F.col(group).isNotNull())
        .groupBy(group)
        .agg(F.count(F.lit(1)).alias("n"), *cells)
    )


def _place_head(head: list, totals: list[int], fractions) -> tuple[dict, list[int]]:
    """Put the few largest groups one by one where the label counts stay closest to target."""
    k = len(totals)
    load = [[0] * k for _ in PARTS]
    placed = {}
    for key, counts in head:
        def distance(part: int) -> float:
            total = 0.0
            for p, f in enumerate(fractions):
                for j, t in enumerate(totals):
                    have = load[p][j] + (counts[j] if p == part else 0)
                    total += ((have - f * t) / t) ** 2 if t else 0.0
            return total

        best = min(range(len(PARTS)), key=distance)
        placed[key] = PARTS[best]
        load[best] = [a + b for a, b in zip(load[best], counts)]
    return placed, [sum(x) for x in load]


def assign_groups(
    groups: DataFrame, group: str, seed: int, fractions, labels, head_share: float = 0.01
) -> DataFrame:
    """(group, split) for a table of group label counts.

    Groups holding at least ``head_share`` of all rows - at most 1/head_share of
    them - are placed explicitly.  The others are ordered by hash inside strata of
    similar size and label mix, and a low-discrepancy sequence over that order deals
    them out in the proportions the placed groups have left open.
    """
    names = [f"c{i + 1}" for i in range(len(labels))]
    sums = groups.agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).first()
    rows = sums["n"] or 0
    border = max(1, head_share * rows)
    big = groups.where(F.col("n") >= border).orderBy(F.desc("n"), group).collect()
    head = [(r[group], [r[c] for c in names]) for r in big]
    placed, loads = _place_head(head, [sums[c] or 0 for c in names], fractions)

    open_rows = [max(f * rows - load, 0.0) for f, load in zip(fractions, loads)]
    scale = sum(open_rows) or 1.0
    test_end = round(open_rows[2] / scale * UNIT)
    val_end = test_end + round(open_rows[1] / scale * UNIT)

    top = F.greatest(*[F.col(c) for c in names])
    lead = F.when(F.col(names[0]) == top, F.lit(1))
    for i, c in enumerate(names[1:], start=2):
        lead = lead.when(F.col(c) == top, F.lit(i))
    strata = ["size_class", "lead", "purity"]
    tail = groups.where(F.col("n") < border).select(
        F.col(group),
        F.length(F.bin("n")).alias("size_class"),
        lead.alias("lead"),
        F.floor(top * 4.0 / F.col("n")).alias("purity"),
    )
    keyed = with_hash(tail, [group], seed)
    inside = W.partitionBy(*strata, "_b").orderBy("_h", group)
    ranked = keyed.join(bucket_offsets(keyed, strata), [*strata, "_b"]).withColumn(
        "rank", F.col("_before") + F.row_number().over(inside)
    )
    start = seeded_hash(seed, *[F.col(s) for s in strata])
    at = (F.pmod("rank", F.lit(1_000_000_000)) * F.lit(STEP) + start) % F.lit(UNIT)
    split = F.when(at < test_end, "test").when(at < val_end, "val").otherwise("train")
    out = ranked.select(group, split.alias("split"))
    if placed:
        spark = groups.sparkSession
        schema = f"`{group}` {dict(groups.dtypes)[group]}, split string"
        out = out.unionByName(spark.createDataFrame(list(placed.items()), schema))
    return out


def make_split(
    df: DataFrame, seed: int, fractions=FRACTIONS, group: str = "gk_name",
    label: str = "rating", labels=(1, 2, 3, 4, 5), ids: list[str] = ("row_id",),
    head_share: float = 0.01, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Rows with a ``split`` column; a group never crosses parts."""
    check_fractions(fractions)
    # One row per group, read several times below: stored, so the rows are scanned once.
    groups = cut(group_label_counts(df, group, label, labels))
    parts = assign_groups(groups, group, seed, fractions, labels, head_share)
    stats = groups.select(group, "n").join(parts, group)
    return attach(df, stats, [group], list(ids), hot_rows=hot_rows).drop("n")


def random_split(
    df: DataFrame, seed: int, fractions=FRACTIONS, ids: list[str] = ("row_id",)
) -> DataFrame:
    """Ungrouped split with exact part sizes: the leaky control."""
    total = df.count()
    n_train, n_val = int(total * fractions[0]), int(total * fractions[1])

    def part(rank: Column) -> Column:
        return (
            F.when(rank <= n_train, "train").when(rank <= n_train + n_val, "val").otherwise("test")
        )

    return label_by_rank(df, list(ids), seed, part).withColumnRenamed("label", "split")


def fingerprint_columns(row_id: Column) -> dict[str, Column]:
    """Order-independent digest of an id multiset.

    Sums, unlike XOR, keep repeated ids visible; they run in decimals, so no number
    of rows overflows them.
    """
    def digest(salt: str) -> Column:
        total = F.sum(seeded_hash(salt, row_id).cast("decimal(20,0)"))
        return (total % F.lit(FINGERPRINT_MODULUS)).cast("bigint")

    return {"n": F.count(row_id), "digest_a": digest("a"), "digest_b": digest("b")}


def fingerprint(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    return df.agg(*[c.alias(k) for k, c in fingerprint_columns(F.col(row_id)).items()])


_TREE_BITS = 16


def id_leaves(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """(node, n, digest) of every range of 65,536 ids that holds any: SHA-256 over its ids in
    order, a repeated id with its number.

    Ranges are of the id itself, so a leaf does not depend on how rows are laid out, and no
    task holds more ids than a range has."""
    ids = df.where(F.col(row_id).isNotNull()).groupBy(F.col(row_id).cast("bigint").alias("id")).agg(F.count(F.lit(1)).alias("c"))
    text = F.when(F.col("c") == 1, F.col("id").cast("string")).otherwise(F.concat_ws("*", "id", "c"))
    return _nodes(ids.select(F.shiftright("id", _TREE_BITS).alias("node"), F.col("id").alias("at"), text.alias("text"), F.col("c").alias("n")))


def _nodes(parts: DataFrame) -> DataFrame:
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), ",")
    return parts.groupBy("node").agg(F.sum("n").alias("n"), F.sha2(joined, 256).alias("digest"))


def id_digest(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """One row (n, digest): the root of a hash tree over the ids of a part.

    Every level takes the digests of up to 65,536 neighbouring ranges, so four levels cover
    all ids.  Equal digests mean equal ids, and only equal ones."""
    return tree_root(id_leaves(df, row_id))


def tree_root(leaves: DataFrame) -> DataFrame:
    """The root over the leaves; no ids give no digest."""
    level = leaves
    for _ in range(3):
        level = _nodes(level.select(F.shiftright("node", _TREE_BITS).alias("node"), F.col("node").alias("at"), F.concat_ws(":", "node", "digest").alias("text"), "n"))
    # Two nodes at most are left: of negative and of other ids.
    top = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node", "digest"))), lambda x: F.concat_ws(":", x["node"], x["digest"])), ","), 256)
    return level.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.when(F.count(F.lit(1)) > 0, top).alias("digest"))


def changed_ranges(before: DataFrame, after: DataFrame) -> DataFrame:
    """(first_id, last_id, n_before, n_after) of the ranges whose leaves differ: where to look
    when two digests do."""
    a = before.select("node", F.col("n").alias("n_before"), F.col("digest").alias("a"))
    b = after.select("node", F.col("n").alias("n_after"), F.col("digest").alias("b"))
    both = a.join(b, "node", "full").where(~F.col("a").eqNullSafe(F.col("b")))
    first = F.shiftleft("node", _TREE_BITS)
    none = F.lit(0).cast("bigint")
    return both.select(first.alias("first_id"), (first + ((1 << _TREE_BITS) - 1)).alias("last_id"),
                       F.coalesce("n_before", none).alias("n_before"), F.coalesce("n_after", none).alias("n_after"))


def _parts(df: DataFrame, group: str, cells: dict[str, Column]) -> DataFrame:
    """Rows, share, groups and summed ``cells`` of every part, from one pass over the rows:
    sums per (part, group) are added up per part."""
    grain = df.groupBy("split", group).agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(k) for k, c in cells.items()]
    )
    parts = grain.groupBy("split").agg(
        F.sum("rows").alias("rows"), F.count(group).alias("groups"),
        *[F.sum(k).alias(k) for k in cells],
    )
    # At most three rows remain.
    total = F.sum("rows").over(W.partitionBy(F.lit(0))).cast("double")
    return parts.withColumn("share", F.col("rows") / total)


def split_metadata(df: DataFrame, group: str) -> DataFrame:
    """Rows, share, distinct groups and id digest of every part."""
    sums = {f"digest_{s}": seeded_hash(s, F.col("row_id")).cast("decimal(20,0)") for s in ("a", "b")}
    return _parts(df, group, sums).select(
        "split", "rows", *[(F.col(k) % F.lit(FINGERPRINT_MODULUS)).cast("bigint").alias(k) for k in sums],
        "groups", "share",
    )


def split_summary(df: DataFrame, group: str, label: str, labels=(1, 2, 3, 4, 5)) -> DataFrame:
    """Rows, share, groups and label mix of every part, in the order train, val, test."""
    cells = {f"share_{v}": (F.col(label) == F.lit(v)).cast("bigint") for v in labels}
    known = {"_known": F.col(label).isNotNull().cast("bigint")}
    parts = _parts(df, group, cells | known)
    order = F.array_position(F.array(*[F.lit(p) for p in PARTS]), F.col("split"))
    mix = [(F.col(k) / F.col("_known").cast("double")).alias(k) for k in cells]
    out = parts.select("split", "rows", "groups", "share", *mix, order.cast("int").alias("part_no"))
    return out.orderBy("part_no")


def select_eval(df: DataFrame, split: str, allow_test: bool = False) -> DataFrame:
    """Rows of one part; the test part only with explicit permission."""
    if split == "test" and not allow_test:
        raise PermissionError("the test part may only confirm findings: pass allow_test=True")
    return df.where(F.col("split") == split)
