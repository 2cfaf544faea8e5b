"""Near-duplicate vectors by a forest of random-projection trees."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch


@dataclass
class ProjectionTree:
    """Inner nodes split by a direction; rows between ``low`` and ``high`` go both ways. Leaves have numbers."""

    directions: np.ndarray
    low: np.ndarray
    high: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, leaf number): at least one for each row."""
        if not len(self.left):
            return np.arange(len(x)), np.zeros(len(x), np.int64)
        rows, nodes, found = np.arange(len(x)), np.zeros(len(x), np.int64), []
        while len(rows):
            side = np.empty(len(rows))
            for a in range(0, len(rows), 65536):
                b = slice(a, a + 65536)
                side[b] = np.einsum("ij,ij->i", x[rows[b]], self.directions[nodes[b]])
            goes = [(side <= self.high[nodes], self.left), (side >= self.low[nodes], self.right)]
            rows, nodes = np.concatenate([rows[g] for g, _ in goes]), np.concatenate([to[nodes[g]] for g, to in goes])
            done = nodes < 0
            found.append((rows[done], -nodes[done] - 1))
            rows, nodes = rows[~done], nodes[~done]
        return np.concatenate([r for r, _ in found]), np.concatenate([leaf for _, leaf in found])


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, which is exact, so that their norms are finite and not zero."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def grow_tree(sample: np.ndarray, rows_each: float, leaf_rows: int, spill: float, rng: np.random.Generator, least: int = 16) -> tuple[ProjectionTree, int]:
    """Split recursively at the median along random directions until a node stands for ``leaf_rows`` rows.

    ``rows_each``: rows of the table for each row of the sample. Returns the tree and its number of leaves.
    """
    nodes, leaves = [], 0
    stack = [(np.arange(len(sample)), -1, 0)]
    while stack:
        own, parent, side = stack.pop()
        direction = rng.standard_normal(sample.shape[1])
        direction /= np.linalg.norm(direction)
        at = sample[own] @ direction
        low, high = np.quantile(at, [0.5 - spill, 0.5 + spill]) if len(own) else (0.0, 0.0)
        if len(own) * rows_each <= leaf_rows or len(own) < 2 * least or low == at.min() or high == at.max():
            leaves += 1
            me = -leaves
        else:
            me = len(nodes)
            nodes.append([direction, low, high, 0, 0])
            stack += [(own[at <= high], me, 3), (own[at >= low], me, 4)]
        if parent >= 0:
            nodes[parent][side] = me
    columns = [np.array([n[k] for n in nodes]) for k in range(5)]
    return ProjectionTree(columns[0].reshape(len(nodes), sample.shape[1]), *columns[1:]), leaves


def grow_forest(sample: np.ndarray, total: int, trees: int, leaf_rows: int, spill: float, seed: int) -> list[tuple[ProjectionTree, int]]:
    """Trees, each with the number of its first leaf among those of all trees."""
    rng, forest, first = np.random.default_rng(seed), [], 0
    for _ in range(trees):
        tree, leaves = grow_tree(sample, total / max(len(sample), 1), leaf_rows, spill, rng)
        forest.append((tree, first))
        first += leaves
    return forest


def group_links(table: pa.Table, leaf: int, cross: bool, threshold: float) -> pa.Table:
    """Links within one leaf, or between its two blocks if ``cross``: for each linked vector, the weight
    of those it is linked to that it shares no earlier leaf with, and the least id it reaches here."""
    ids, weights = table["id"].to_numpy(), table["weight"].to_numpy()
    block = table["block"].to_numpy()
    x = scaled(table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1))
    norms = np.linalg.norm(x, axis=1)
    near = (x @ x.T) / norms[:, None] / norms[None, :] >= threshold
    np.fill_diagonal(near, False)
    if cross:
        near &= block[:, None] != block[None, :]
    linked = np.flatnonzero(near.any(axis=1))
    near, ids, weights = near[np.ix_(linked, linked)], ids[linked], weights[linked]
    lists = table["leaves"].combine_chunks().take(pa.array(linked))
    flat, owner = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(linked)), lists.value_lengths().to_numpy(zero_copy_only=False))
    earlier, column = np.unique(flat[flat < leaf], return_inverse=True)
    member = np.zeros((len(linked), len(earlier)), np.float32)
    member[owner[flat < leaf], column] = 1
    fresh = near & (member @ member.T == 0)
    order = np.argsort(ids, kind="stable")
    root = np.empty(len(ids), np.int64)
    root[order] = np.arange(len(ids))
    while len(ids):
        reached = np.minimum(root, np.where(near, root[None, :], len(ids)).min(axis=1))
        if (reached == root).all():
            break
        root = reached
    return pa.table({"id": pa.array(ids), "links": pa.array((fresh * weights[None, :]).sum(axis=1).astype(np.int64)), "root": pa.array(ids[order][root] if len(ids) else ids)})


def split_large(placed: DataFrame, most_rows: int, spill: float, threshold: float, dimensions: int, scratch: Scratch) -> DataFrame:
    """Split leaves of over ``most_rows`` vectors further, where the sample couldn't tell these apart.

    ``placed``: node, vector, weight and leaves. Each round takes a direction for each large leaf from the
    leaf's number and approximate quantiles of its vectors along it, and gives each side a new number; rows
    near the median go both ways. A leaf that is narrow against the distance of linked vectors stays, as a
    split would part links: most of its pairs are links, and to count these takes all comparisons.
    """
    reach = float(np.sqrt(2 - 2 * threshold) / np.sqrt(max(dimensions, 1)))

    @F.arrow_udf("double")
    def along(vectors: pa.Array, leaves: pa.Array) -> pa.Array:
        numbers, out = leaves.to_numpy(), np.zeros(len(vectors))
        x = unit(vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(numbers), -1))
        for leaf in np.unique(numbers).tolist():
            own, direction = numbers == leaf, np.random.default_rng(abs(leaf)).standard_normal(x.shape[1])
            out[own] = x[own] @ direction / np.linalg.norm(direction)
        return pa.array(out)

    stay = None
    while True:
        members = placed.select("node", F.explode("leaves").alias("leaf"))
        large = members.where("leaf >= 0").groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > most_rows).select("leaf")
        large = scratch.table(large if stay is None else large.join(stay, "leaf", "left_anti"))
        if large.isEmpty():
            return placed
        at = scratch.table(placed.select("node", "vector", F.explode("leaves").alias("leaf")).join(large, "leaf").select("node", "leaf", along("vector", "leaf").alias("at")))
        q = F.percentile_approx("at", [0.16, 0.5 - spill, 0.5 + spill, 0.84], 1000)
        cuts = scratch.table(at.groupBy("leaf").agg(q.alias("q"), F.min("at").alias("least"), F.max("at").alias("most")))
        fine = (F.col("q")[3] - F.col("q")[0] > 3 * reach) & (F.col("q")[1] > F.col("least")) & (F.col("q")[2] < F.col("most"))
        narrow = cuts.where(~fine).select("leaf")
        stay = scratch.table(narrow if stay is None else stay.unionByName(narrow))
        number = lambda side: F.xxhash64("leaf", F.lit(side)).bitwiseAND((1 << 62) - 1)
        sides = F.array(F.when(F.col("at") <= F.col("q")[2], number(0)), F.when(F.col("at") >= F.col("q")[1], number(1)))
        moved = at.join(cuts.where(fine), "leaf").select("node", F.explode(F.array_compact(sides)).alias("leaf"))
        rest = members.join(cuts.where(fine), "leaf", "left_anti").select("node", "leaf")
        leaves = rest.unionByName(moved).groupBy("node").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))
        placed = scratch.table(placed.drop("leaves").join(leaves, "node").select(placed.columns))


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.9,
    trees: int = 8,
    leaf_rows: int = 256,
    spill: float = 0.05,
    sample_values: int = 3_200_000,
    block_rows: int = 2048,
    most_rows: int = 8192,
    seed: int = 11,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Links of cosine ``threshold`` or more (double precision): n_links, component_id and kept of each row.

    Returns the id column as vec_id, n_links (other rows linked directly), component_id (least id that
    links reach, itself included) and kept (vec_id = component_id). A vector that is null, zero, empty or
    holds null or non-finite components links with nothing; so do vectors of unequal lengths. Each row is
    one vector, also where ids repeat; a row with a null id links like others and counts, is never kept
    unless none it reaches has an id, and then has a null component_id. An empty table gives no rows.

    Trees are grown on a sample of at most ``sample_values`` numbers (vectors of the smallest row hashes);
    all vectors are indexed. Each vector goes to one leaf of each tree, or several where it is near a split;
    leaves of over ``most_rows`` vectors are split further by jobs (see ``split_large``). Vectors meet in
    leaves; a pair counts in the first leaf that it shares, so that no pair needs to be listed, and only
    counts and a spanning star of each leaf leave a task. Equal vectors collapse to one before, told by 128
    bits. A leaf of over ``block_rows`` vectors is compared by pairs of blocks, so that no group outgrows a
    task. Vectors shuffle once for each leaf; everything else shuffles row numbers.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark)
    v = F.col("_v")
    usable = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).alias("_v"))
    told_apart = {"_ok": F.coalesce(usable, F.lit(False)), "_row": F.monotonically_increasing_id(), "_h1": F.xxhash64("_v"), "_h2": F.xxhash64(F.lit(1), "_v")}
    base = scratch.table(rows.withColumns(told_apart))
    distinct = scratch.table(base.where("_ok").groupBy("_h1", "_h2").agg(F.min("_row").alias("node"), F.count("*").alias("weight"), F.min("_id").alias("least")))

    total = distinct.count()
    size = base.where("_ok").agg(F.mode(F.size("_v"))).first()[0] or 1
    picked = distinct.orderBy(F.xxhash64("node"), "node").limit(max(1, sample_values // size)).select("node")
    sample = base.join(F.broadcast(picked), F.col("_row") == F.col("node")).where(F.size("_v") == size).orderBy("node").select("_v").toPandas()["_v"].tolist()
    x = np.array(sample, float).reshape(-1, size)
    forest = spark.sparkContext.broadcast((size, grow_forest(unit(x), total, trees, leaf_rows, spill, seed)))

    @F.arrow_udf("array<bigint>")
    def leaves(column: pa.Array) -> pa.Array:
        size, grown = forest.value
        lengths = column.value_lengths().to_numpy(zero_copy_only=False)
        out = [[-n] for n in lengths.tolist()]
        own = np.flatnonzero(lengths == size)
        x = unit(column.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size))
        if len(own):
            found = [(r, leaf + first) for tree, first in grown for r, leaf in [tree.leaves(x)]]
            row, leaf = np.concatenate([r for r, _ in found]), np.concatenate([n for _, n in found])
            pairs = np.unique(np.stack([row, leaf]), axis=1)
            for i, part in zip(own.tolist(), np.split(pairs[1], np.searchsorted(pairs[0], np.arange(1, len(own)))), strict=True):
                out[i] = part.tolist()
        return pa.array(out, pa.list_(pa.int64()))

    there = base.join(distinct.select("node", "weight"), F.col("_row") == F.col("node")).select("node", "weight", F.col("_v").alias("vector"))
    placed = split_large(scratch.table(there.withColumn("leaves", leaves("vector"))), most_rows, spill, threshold, size, scratch)
    sizes = placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > block_rows)
    blocks = sizes.select("leaf", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    posted = placed.select("*", F.explode("leaves").alias("leaf")).join(blocks, "leaf", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    posted = posted.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    posted = posted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    posted = posted.withColumn("b1", F.least("block", "other")).withColumn("b2", F.greatest("block", "other"))

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        leaf, b1, b2 = (k.as_py() for k in key)
        return group_links(table, leaf, b1 != b2, threshold)

    found = scratch.table(posted.withColumnRenamed("node", "id").groupBy("leaf", "b1", "b2").applyInArrow(compare, "id long, links long, root long"))
    links = found.groupBy(F.col("id").alias("node")).agg(F.sum("links").alias("links"))
    reached = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), scratch)
    classes = scratch.table(distinct.join(links, "node", "left").join(reached, "node", "left").withColumn("component", F.coalesce("component", "node")))
    firsts = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    told = classes.join(firsts, "component").select("_h1", "_h2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    linked = base.where("_ok").select("_id", "_h1", "_h2").join(told, ["_h1", "_h2"]).select("_id", "n_links", "component_id")
    alone = base.where("NOT _ok").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("_id").alias("vec_id"), "n_links", "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))
