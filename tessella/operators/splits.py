"""Train and test splits as a ``split`` column: ordered, random, stratified, by group, and stratified by group.

Random orders are orders of md5(key:seed), the same on every engine and run. Sizes are whole numbers throughout.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, floor

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.ranking import global_rank, hash_rank

Size = float | int | None


def sizes(n: int, test: Size = None, train: Size = None, default: float = 0.25) -> tuple[int, int]:
    """(train, test) of n: a test share is rounded up, a train share down; a missing one is the rest."""
    share = lambda v, turn: turn(v * n) if isinstance(v, float) else v
    for v in (test, train):
        if isinstance(v, float) and not 0 < v < 1 or isinstance(v, int) and not 0 < v < n:
            raise ValueError(f"a size must be a share between 0 and 1 or a number between 0 and {n}, not {v}")
    if test is None and train is None:
        test = default
    n_test = share(test, ceil) if test is not None else n - share(train, floor)
    n_train = share(train, floor) if train is not None else n - n_test
    if n_train + n_test > n:
        raise ValueError(f"train and test need {n_train + n_test} of {n}")
    if n_train <= 0 or n_test <= 0:
        raise ValueError(f"{n} rows leave a side empty")
    return n_train, n_test


def _sides(rank: Column, first: int | Column, second: int | Column, names: tuple[str, str]) -> Column:
    return F.when(rank <= first, names[0]).when(rank <= first + second, names[1])


def train_test_split(rows: DataFrame, key: str, test: Size = None, train: Size = None, seed: int = 0, shuffle: bool = True, stratify: str | None = None, groups: str | None = None) -> DataFrame:
    """``rows`` with ``split``: train, test, or null for rows that neither side takes.

    Without ``shuffle`` the order of ``key`` decides, and neither ``stratify`` nor ``groups`` may be given.
    """
    if not shuffle:
        if stratify or groups:
            raise ValueError("stratify and groups need shuffle")
        n_train, n_test = sizes(rows.count(), test, train)
        ranked = global_rank(rows, [key])
        return ranked.withColumn("split", _sides(F.col("rank"), n_train, n_test, ("train", "test"))).drop("rank")
    if groups and stratify:
        return stratified_group_split(rows, stratify, groups, test, train, seed)
    if groups:
        ids = rows.select(F.col(groups).alias("__g")).distinct()
        n_train, n_test = sizes(ids.count(), test, train)
        side = hash_rank(ids, F.col("__g"), seed).select("__g", _sides(F.col("rank"), n_test, n_train, ("test", "train")).alias("split"))
        return rows.join(side, F.col(groups).eqNullSafe(F.col("__g")), "left").drop("__g")
    if stratify:
        return _stratified(rows, key, stratify, test, train, seed)
    n_train, n_test = sizes(rows.count(), test, train)
    ranked = hash_rank(rows, F.col(key), seed)
    return ranked.withColumn("split", _sides(F.col("rank"), n_test, n_train, ("test", "train"))).drop("rank")


def _quotas(counts: dict, total: int) -> dict:
    """``total`` dealt to classes in proportion, the largest remainders first, ties in the classes' order."""
    n = sum(counts.values())
    exact = {c: total * k / n for c, k in counts.items()}
    out = {c: floor(v) for c, v in exact.items()}
    for c in sorted(exact, key=lambda c: (out[c] - exact[c], str(c)))[: total - sum(out.values())]:
        out[c] += 1
    return out


def _stratified(rows: DataFrame, key: str, label: str, test: Size, train: Size, seed: int) -> DataFrame:
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # classes are few
    if min(counts.values(), default=0) < 2:
        raise ValueError("every class needs two rows at least")
    n_train, n_test = sizes(sum(counts.values()), test, train)
    if min(n_train, n_test) < len(counts):
        raise ValueError("each side needs a row of every class")
    tests = _quotas(counts, n_test)
    trains = _quotas({c: counts[c] - tests[c] for c in counts}, n_train)
    # a class is ranked over hash buckets, so that a large one is not sorted in one task
    h = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    dealt = rows.withColumn("__h", h).withColumn("__b", F.substring("__h", 1, 3))
    starts = dealt.groupBy(F.col(label).alias("__l"), F.col("__b").alias("__of")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__l").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.withColumn("__start", before).drop("__n")
    rank = F.row_number().over(Window.partitionBy(label, "__b").orderBy("__h", key))
    ranked = dealt.withColumn("__r", rank).join(starts, F.col(label).eqNullSafe(F.col("__l")) & (F.col("__b") == F.col("__of")))
    place = F.col("__r") + F.col("__start")
    side = F.lit(None).cast("string")
    for c in counts:
        mine = F.col(label).isNull() if c is None else F.col(label) == F.lit(c)
        side = F.when(mine, _sides(place, tests[c], trains[c], ("test", "train"))).otherwise(side)
    return ranked.withColumn("split", side).drop("__h", "__b", "__r", "__l", "__of", "__start")


def group_folds(table: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Fold of each row of ``table`` (groups by classes): groups of uneven classes first, each where folds stay most alike."""
    order = rng.permutation(len(table))
    order = order[np.argsort(-np.std(table[order], axis=1), kind="stable")]
    totals = np.maximum(table.sum(axis=0), 1)
    held, out = np.zeros((k, table.shape[1])), np.zeros(len(table), int)
    for g in order:
        tried = held[None] + np.eye(k)[:, :, None] * table[g]
        cost = np.std(tried / totals, axis=1).mean(axis=1)
        size = held.sum(axis=1)
        fold = min(range(k), key=lambda f: (round(cost[f], 12), size[f]))
        held[fold] += table[g]
        out[g] = fold
    return out


def stratified_group_folds(rows: DataFrame, label: str, groups: str, test: Size = None, train: Size = None, seed: int = 0, repeats: int = 1, default: float = 0.25) -> tuple[list, list[np.ndarray], bool]:
    """Groups, for each repeat the groups of the smaller side, and whether that side is train.

    The table of groups by classes is the only thing on the driver: it has one row a group, which bounds this split to groups (such
    as patients) and not rows.
    """
    counts = rows.groupBy(groups).pivot(label).count().fillna(0).orderBy(groups).collect()
    ids = [r[0] for r in counts]
    table = np.array([[v or 0 for v in r[1:]] for r in counts], float)
    n_train, n_test = sizes(int(table.sum()), test, train, default)
    flipped = n_test > n_train
    k = round(table.sum() / min(n_train, n_test))
    if k > table.sum(axis=0).max():
        raise ValueError(f"{k} folds are more than the rows of every class")
    if k > len(ids):
        raise ValueError(f"{k} folds need as many groups")
    rng = np.random.default_rng(seed)
    wanted = table.sum(axis=0) / table.sum()
    picked = []
    for _ in range(repeats):
        folds = group_folds(table, k, rng)

        def distance(f: int, folds=folds) -> float:
            held = table[folds == f].sum(axis=0)
            return float("inf") if (held == 0).any() else float(np.abs(held / held.sum() - wanted).sum())

        picked.append(folds == min(range(k), key=distance))
    return ids, picked, flipped


def stratified_group_split(rows: DataFrame, label: str, groups: str, test: Size = None, train: Size = None, seed: int = 0, default: float = 0.25) -> DataFrame:
    """``rows`` with ``split``: whole groups, with classes in about the same shares on both sides. All rows are on a side."""
    ids, picked, flipped = stratified_group_folds(rows, label, groups, test, train, seed, 1, default)
    small, large = ("train", "test") if flipped else ("test", "train")
    sides = [(g, small if p else large) for g, p in zip(ids, picked[0].tolist(), strict=True)]
    table = rows.sparkSession.createDataFrame(sides, rows.select(F.col(groups).alias("__g"), F.lit("").alias("split")).schema)
    return rows.join(table, F.col(groups).eqNullSafe(F.col("__g")), "left").drop("__g")
