"""Cluster bootstrap of macro-F1: groups are drawn with replacement, jointly for all models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.hashing import seeded_hashes
from ..plans.materialize import cut
from ..plans.ranking import bucket_offsets, with_hash
from .metrics import count_cells, macro_f1

# Groups per block.
BLOCK_GROUPS = 2_000
# Hashed draws that fall on a block of positions, and that a task makes at once.
BLOCK_DRAWS, TASK_DRAWS = 1 << 23, 1_000_000


def block_shares(
    sizes: np.ndarray, block: int, n_draws: int, n_boot: int, seed: int
) -> np.ndarray:
    """Draws that fall on one block in every replicate, of ``n_draws`` over all blocks.

    The blocks are the leaves of a binary tree whose every node splits its draws by a
    binomial seeded with the node, so all blocks agree on the split and each walks only
    its own path: together a multinomial by block size.
    """
    upto = np.concatenate(([0], np.cumsum(sizes)))
    share = np.full(n_boot, n_draws, dtype=np.int64)
    low, high, node = 0, len(sizes), 1
    while high - low > 1:
        mid = (low + high) // 2
        all_, left = upto[high] - upto[low], upto[mid] - upto[low]
        part = np.random.default_rng([seed, node]).binomial(share, left / all_ if all_ else 0.5)
        if block < mid:
            share, high, node = part, mid, 2 * node
        else:
            share, low, node = share - part, mid, 2 * node + 1
    return share


def group_cells(df: DataFrame, models: dict[str, str], group: str) -> DataFrame:
    """25 confusion counts per model for every group: the only thing resampling needs.

    Hot groups collapse in the map-side part of the aggregate.
    """
    cells = [c for m, p in models.items() for c in count_cells(p=p, name=f"{m}_")]
    return df.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("group")).agg(*cells)


def _scores(sums: DataFrame, models, pairs, keep=()) -> DataFrame:
    """macro-F1 of each model and differences a - b, from summed cells."""
    single = sums.select(*keep, *[macro_f1(f"{m}_").alias(m) for m in models])
    return single.selectExpr(
        *keep, *[f"`{m}`" for m in models], *[f"`{a}` - `{b}` AS `{a} - {b}`" for a, b in pairs]
    )


def block_draws(groups: DataFrame, models, n_boot: int, seed: int) -> DataFrame:
    """Summed cells per replicate, drawn block by block.

    Groups are spread over blocks by hash.  A replicate first splits its draws over the
    blocks and each block then draws its share among its own groups.  Together that is
    the plain multinomial bootstrap, yet only n_boot rows per block are shuffled.  The
    driver holds one size per block.
    """
    n_groups = groups.count()
    n_blocks = max(1, -(-n_groups // BLOCK_GROUPS))
    names = [f"{m}_{i}" for m in models for i in range(25)]
    blocked = groups.withColumn(
        "block", F.pmod(F.xxhash64("group"), F.lit(n_blocks)).cast("int")
    )
    sizes = np.zeros(n_blocks, dtype=np.int64)
    for r in blocked.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r["block"]] = r["n"]
    sent = groups.sparkSession.sparkContext.broadcast(sizes)

    def draw(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(key[0])
        cells = pdf.sort_values("group")[names].to_numpy(dtype=np.float64)
        out = np.empty((n_boot, len(names)))
        shares = block_shares(sent.value, block, n_groups, n_boot, seed)
        for rep in range(n_boot):
            picks = np.random.default_rng([seed, rep, block]).integers(0, len(cells), shares[rep])
            out[rep] = np.bincount(picks, minlength=len(cells)) @ cells
        result = pd.DataFrame(out, columns=names)
        result.insert(0, "rep", np.arange(n_boot))
        return result

    schema = "rep int, " + ", ".join(f"`{c}` double" for c in names)
    parts = blocked.groupBy("block").applyInPandas(draw, schema)
    return parts.groupBy("rep").agg(*[F.expr(f"sum(`{c}`) AS `{c}`") for c in names])


def hashed_draws(groups: DataFrame, models, n_boot: int, seed: int) -> DataFrame:
    """Summed cells per replicate with MD5-derived draws, reproducible on any engine.

    Draw number d of replicate r takes the group at position hash(seed, r, d) mod G in
    hash order.  Draws travel to the block of positions they fall on as packed arrays of
    (replicate, place in the block), four bytes each; there they are counted, all at once, and
    multiplied with the block's cells.  A block holds some eight million draws, whatever the groups.
    """
    n_groups = groups.count()
    names = [f"{m}_{i}" for m in models for i in range(25)]
    width = max(1, BLOCK_DRAWS // n_boot)
    code = np.uint32 if n_boot * width <= 1 << 32 else np.uint64
    keyed = with_hash(groups, ["group"], seed)
    inside = W.partitionBy("_b").orderBy("_h", "group")
    placed = cut(keyed.join(bucket_offsets(keyed, []), "_b").withColumn(
        "pos", F.col("_before") + F.row_number().over(inside) - 1
    ).select(F.floor(F.col("pos") / width).cast("int").alias("block"), "pos", *names))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(0).to_pylist()
            step = max(1, TASK_DRAWS // n_boot)
            for start in range(0, len(places), step):
                own = [b"%d" % p for p in places[start:start + step]]
                picks = seeded_hashes([b"%d|%d|" % (seed, r) for r in range(n_boot)], own).ravel()
                picks %= np.uint64(n_groups)
                block = picks // np.uint64(width)
                picks -= block * np.uint64(width)
                picks += np.repeat(np.arange(n_boot, dtype=np.uint64) * np.uint64(width), len(own))
                # Numbers of two bytes are sorted by radix.
                block = block.astype(np.uint16 if n_groups <= width << 16 else np.int64)
                order = np.argsort(block, kind="stable")
                block, packed = block[order], picks.astype(code)[order]
                firsts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
                parts = [x.tobytes() for x in np.split(packed, firsts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(block[firsts], pa.int32()), pa.array(parts, pa.binary())], ["block", "draws"])

    def summed(draws: pa.Table, cells: pa.Table) -> pa.Table:
        at = cells["pos"].to_numpy() % width
        # Together: tasks times blocks is the number of parts, so a pass over the counts a part would grow with its square.
        counts = np.bincount(np.frombuffer(b"".join(draws["draws"].to_pylist()), code), minlength=n_boot * width)
        weights = counts.reshape(n_boot, width)[:, at].astype(np.float64)
        out = weights @ np.stack([cells[c].to_numpy().astype(np.float64) for c in names], axis=1)
        return pa.table([pa.array(np.arange(n_boot), pa.int32()), *(pa.array(c) for c in out.T)], ["rep", *names])

    # Dealt by the number of draws: few groups are still many of them.
    tasks = max(1, -(-n_groups * n_boot // TASK_DRAWS))
    draws = placed.select("pos").repartition(tasks).mapInArrow(draw, "block int, draws binary")
    schema = "rep int, " + ", ".join(f"`{c}` double" for c in names)
    parts = draws.groupBy("block").cogroup(placed.groupBy("block")).applyInArrow(summed, schema)
    return parts.groupBy("rep").agg(*[F.expr(f"sum(`{c}`) AS `{c}`") for c in names])


def cluster_bootstrap(
    df: DataFrame, models: dict[str, str], group: str, n_boot: int = 1000, seed: int = 42,
    pairs: tuple = (), draws=block_draws,
) -> DataFrame:
    """(name, estimate, low, high, significant) for models and paired differences.

    Limits are the 2.5 and 97.5 percentiles; a difference is significant when its
    interval excludes zero, for a single model the flag is null.
    """
    groups = cut(group_cells(df, models, group))
    names = [f"{m}_{i}" for m in models for i in range(25)]
    labels = [*models, *[f"{a} - {b}" for a, b in pairs]]
    total = groups.agg(*[F.expr(f"sum(`{c}`) AS `{c}`") for c in names])
    point = _scores(total, models, pairs)
    reps = _scores(draws(groups, models, n_boot, seed), models, pairs, ["rep"])

    def long(table: DataFrame, keep: list[str]) -> DataFrame:
        cells = [F.struct(F.lit(x).alias("name"), F.col(f"`{x}`").alias("v")) for x in labels]
        return table.select(*keep, F.inline(F.array(*cells)))

    limits = long(reps, ["rep"]).groupBy("name").agg(
        F.percentile("v", F.array(F.lit(0.025), F.lit(0.975))).alias("q")
    )
    joined = long(point, []).join(limits, "name")
    low, high = F.get("q", F.lit(0)), F.get("q", F.lit(1))
    differences = [f"{a} - {b}" for a, b in pairs]
    return joined.select(
        "name", F.col("v").alias("estimate"), low.alias("low"), high.alias("high"),
        F.when(F.col("name").isin(differences), (low > 0) | (high < 0)).alias("significant"),
    )
