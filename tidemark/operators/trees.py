"""Regression trees and bagged forests with exact splits, grown one level at a time for all trees at once.

A level needs, for every (tree, node, feature), the weight and the target sum up to each distinct value. Equal values are
summed up before the shuffle, and the running totals are taken in pieces (``scans``), so neither a root over all rows nor
a frequent value meets in one task. What is left of a level is one split a node: a table bounded by trees and depth.

Targets are summed in whole units of 1e-9, so sums do not depend on the order of rows and equal gains stay equal.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import finite
from tidemark.operators.news import draws, materialised
from tidemark.operators.scans import numbered, previous, running_sum, split_ordered

DEPTH = 2
LEAF_SHARE = 0.1
LEAF_FLOOR = 3
TREES = 25
FEATURES_A_TREE = 3
SEED = 20260924
UNIT = 1e9  #: targets are counted in this many parts of one
MODEL = "tree int, node int, feature string, threshold double, value double, samples long"


def drawn_features(features: Sequence[str], trees: int, size: int, seed: int) -> list[list[str]]:
    """Features of each tree: the first ``size`` in order of the MD5 of seed, tree and name."""
    digest = lambda t, name: hashlib.md5(f"{seed}:{t}:{name}".encode()).hexdigest()
    return [sorted(features, key=lambda name: digest(t, name))[:size] for t in range(trees)]


def _checked(samples: DataFrame, features: Sequence[str], target: str) -> int:
    """Number of samples; an empty set and values that are missing or not finite are refused."""
    known = F.lit(True)
    for x in (*features, target):
        known = known & finite(x).isNotNull()
    n, good = samples.agg(F.count(F.lit(1)), F.count_if(known)).first()
    if n == 0:
        raise ValueError("no samples to fit a tree to")
    if good < n:
        raise ValueError(f"{n - good} samples have a feature or target that is missing or not finite")
    return n


def _units(target: str) -> Column:
    return F.round(F.col(target).cast("double") * UNIT).cast("decimal(20,0)")


def best_splits(rows: DataFrame, offered: Column, least: int) -> DataFrame:
    """(tree, node, feature, threshold): the best split of each node of ``rows`` (tree, node, w, y, xs).

    ``offered`` is the array of (place, feature, number in xs) a tree may split by. Thresholds lie midway between
    neighbouring distinct values, and both sides keep ``least`` samples. The greatest fall of the squared error wins; ties
    go to the first feature, then to the smallest threshold. Nodes that no split improves are left out.
    """
    group, value = ["tree", "node", "k", "feature"], ["x"]
    long = rows.select("tree", "node", "w", "y", "xs", F.explode(offered).alias("f"))
    long = long.select("tree", "node", F.col("f.k").alias("k"), F.col("f.feature").alias("feature"), F.get("xs", F.col("f.at")).alias("x"), "w", "y")
    cells = long.groupBy(*group, "x").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).cast("decimal(38,0)").alias("s"))
    pieces = split_ordered(cells, group, value)
    for column in ("w", "s"):
        pieces = running_sum(pieces, group, value, F.col(column), f"_{column}")
    pieces = previous(pieces, group, value, F.col("x"), "before")
    whole = rows.groupBy("tree", "node").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).cast("decimal(38,0)").alias("t"))
    at = pieces.join(whole, ["tree", "node"])
    left, right = F.col("_w") - F.col("w"), F.col("n") - F.col("_w") + F.col("w")
    s = (F.col("_s") - F.col("s")).cast("decimal(38,0)")
    gap = s.cast("double") / left - (F.col("t") - s).cast("double") / right
    tried = at.where(F.col("before").isNotNull()).where((left >= least) & (right >= least))
    tried = tried.select("tree", "node", "k", "feature", ((F.col("before") + F.col("x")) / 2.0).alias("threshold"), (left.cast("double") * right / F.col("n") * gap * gap).alias("gain"))
    order = F.struct(F.col("gain"), -F.col("k"), -F.col("threshold"))
    best = tried.where("gain > 0").groupBy("tree", "node").agg(F.max_by(F.struct("feature", "threshold"), order).alias("b"))
    return best.select("tree", "node", "b.feature", "b.threshold")


def _grown(rows: DataFrame, features: Sequence[str], menus: Sequence[Sequence[str]], n: int, depth: int) -> DataFrame:
    """Model table of the trees over ``rows`` (tree, w, y, xs)."""
    least = max(LEAF_FLOOR, math.floor(n * LEAF_SHARE))
    menu = lambda names: F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x).alias("feature"), F.lit(features.index(x)).alias("at")) for k, x in enumerate(names)])
    offered = F.get(F.array(*[menu(m) for m in menus]), F.col("tree"))
    number = F.create_map(*[part for i, x in enumerate(features) for part in (F.lit(x), F.lit(i))])
    rows, levels = rows.withColumn("node", F.lit(1)), []
    for level in range(depth + 1):
        mean = F.sum(F.col("w") * F.col("y")).cast("double") / F.sum("w") / UNIT
        nodes = rows.groupBy("tree", "node").agg(mean.alias("value"), F.sum("w").alias("samples"))
        if level == depth:
            levels.append(nodes.select("tree", "node", F.lit(None).cast("string").alias("feature"), F.lit(None).cast("double").alias("threshold"), "value", "samples"))
            break
        best = materialised(best_splits(rows, offered, least))
        levels.append(nodes.join(best, ["tree", "node"], "left").select("tree", "node", "feature", "threshold", "value", "samples"))
        # the table of splits has at most trees * 2**depth rows
        went = rows.join(F.broadcast(best), ["tree", "node"])
        goes_right = (F.get("xs", F.try_element_at(number, F.col("feature"))) > F.col("threshold")).cast("int")
        rows = materialised(went.select("tree", "w", "y", "xs", (F.col("node") * 2 + goes_right).alias("node")))
    out = levels[0]
    for other in levels[1:]:
        out = out.unionByName(other)
    return out


def _vectors(samples: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    return samples.select("*", _units(target).alias("y"), F.array(*[F.col(x).cast("double") for x in features]).alias("xs"))


def fit_tree(samples: DataFrame, features: Sequence[str], target: str = "target", depth: int = DEPTH) -> DataFrame:
    """One tree over all features: a row a node (``MODEL``; nodes are numbered 1, then 2k and 2k+1; leaves have no feature)."""
    n = _checked(samples, features, target)
    rows = _vectors(samples, features, target).select(F.lit(0).alias("tree"), F.lit(1).cast("long").alias("w"), "y", "xs")
    return _grown(rows, features, [list(features)], n, depth)


def fit_forest(
    samples: DataFrame, features: Sequence[str], key: Sequence[str], target: str = "target", depth: int = DEPTH, trees: int = TREES, size: int = FEATURES_A_TREE, seed: int = SEED
) -> DataFrame:
    """``trees`` trees, each over as many samples drawn with replacement and over ``size`` features drawn once a tree.

    ``key`` identifies and orders the samples; draws are made from MD5 digits of seed, tree and place. A sample drawn more
    than once is one row with a weight.
    """
    n = _checked(samples, features, target)
    rows = numbered(split_ordered(_vectors(samples, features, target).select(*key, "y", "xs"), [], key), [], key, "i")
    rows = rows.select((F.col("i") - 1).alias("i"), "y", "xs")
    size_row = samples.sparkSession.range(1).select(F.lit(n).cast("long").alias("_n"))
    bags = draws(size_row, trees, seed).join(rows, "i").select(F.col("b").cast("int").alias("tree"), "w", "y", "xs")
    return _grown(materialised(bags), features, drawn_features(features, trees, size, seed), n, depth)


def predict(rows: DataFrame, model: DataFrame, name: str = "prediction") -> DataFrame:
    """``rows`` with the mean of the trees' leaves; NULL where a feature that is asked for is NULL.

    The model (at most trees * 2**(depth + 1) rows) becomes one conditional expression a tree.
    """
    nodes = {(r["tree"], r["node"]): r for r in model.collect()}

    def walk(tree: int, node: int) -> Column:
        at = nodes[tree, node]
        if at["feature"] is None:
            return F.lit(at["value"])
        x = F.col(at["feature"])
        return F.when(x <= at["threshold"], walk(tree, 2 * node)).when(x > at["threshold"], walk(tree, 2 * node + 1))

    roots = sorted(t for t, node in nodes if node == 1)
    return rows.withColumn(name, sum((walk(t, 1) for t in roots[1:]), walk(roots[0], 1)) / len(roots))
