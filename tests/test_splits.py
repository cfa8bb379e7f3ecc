import pytest

from tessella.operators import ranking, splits

ROWS = [(i, y, g) for i, (y, g) in enumerate([(0, 1), (0, 1), (1, 2), (1, 2), (0, 3), (1, 3)])]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, "id int, y int, g int")


def sides(df):
    return {r["id"]: r["split"] for r in df.collect()}


def test_sizes():
    assert splits.sizes(25, 7) == (18, 7) and splits.sizes(10) == (7, 3) and splits.sizes(10, 0.3, 0.5) == (5, 3) and splits.sizes(10, train=0.75) == (7, 3)
    for bad in ((10, 8, 5), (2, 0.9, 0.1), (10, 1.5)):
        with pytest.raises(ValueError):
            splits.sizes(*bad)


def test_ordered(rows):
    assert sides(splits.train_test_split(rows, "id", test=2, shuffle=False)) == {0: "train", 1: "train", 2: "train", 3: "train", 4: "test", 5: "test"}
    with pytest.raises(ValueError, match="shuffle"):
        splits.train_test_split(rows, "id", shuffle=False, groups="g")


def test_random_and_partial(spark):
    df = spark.range(500).selectExpr("id")
    one, two = (sides(splits.train_test_split(df, "id", test=0.2, train=0.5, seed=s)) for s in (1, 2))
    for found in (one, two):
        assert list(found.values()).count("test") == 100 and list(found.values()).count("train") == 250 and list(found.values()).count(None) == 150
    assert one != two and one == sides(splits.train_test_split(df.repartition(7), "id", test=0.2, train=0.5, seed=1))


def test_stratified(spark):
    df = spark.createDataFrame([(i, "abc"[min(i % 10, 2)]) for i in range(100)], "id int, y string")
    out = splits.train_test_split(df, "id", test=0.2, stratify="y").groupBy("y", "split").count().collect()
    assert {(r["y"], r["split"]): r["count"] for r in out} == {("a", "test"): 2, ("a", "train"): 8, ("b", "test"): 2, ("b", "train"): 8, ("c", "test"): 16, ("c", "train"): 64}
    with pytest.raises(ValueError, match="two rows"):
        splits.train_test_split(spark.createDataFrame([(0, "a"), (1, "b"), (2, "b"), (3, "b")], "id int, y string"), "id", stratify="y")


def test_groups_stay_together(rows):
    out = splits.train_test_split(rows, "id", test=1, groups="g").collect()
    assert {g for _, _, g, s in out if s == "test"}.isdisjoint({g for _, _, g, s in out if s == "train"}) and {s for *_, s in out} == {"test", "train"}


def test_stratified_groups(rows):
    out = splits.train_test_split(rows, "id", test=0.34, stratify="y", groups="g").collect()
    test = [r for r in out if r["split"] == "test"]
    assert test and len(out) == 6 and all(r["split"] for r in out)
    assert {r["g"] for r in test}.isdisjoint({r["g"] for r in out if r["split"] == "train"})
    assert abs(sum(r["y"] for r in test) / len(test) - 0.5) <= 0.34


def test_stratified_groups_keep_class_shares(spark):
    # groups of one class each, so that a split without stratification is free to part the classes
    rows = [(g * 5 + i, "abc"[g // 20] if g < 60 else None, f"g{g}") for g in range(80) for i in range(5)]
    df = spark.createDataFrame(rows, "id int, y string, g string")
    out = splits.train_test_split(df, "id", groups="g", stratify="y", test=0.25).select("id", "split").collect()
    side = {r["id"]: r["split"] for r in out}
    assert len(side) == len(rows)
    for y in ("a", "b", "c", None):
        ids = [i for i, c, _ in rows if c == y]
        assert abs(sum(side[i] == "test" for i in ids) / len(ids) - 0.25) <= 0.05, y


def test_ranks_are_a_total_order(spark):
    df = spark.range(1000).selectExpr("id", "cast(id * 7919 % 1000 as double) as v", "concat('k', id % 40) as s")
    assert [r["rank"] for r in ranking.global_rank(df, ["v"]).orderBy("v").collect()] == list(range(1, 1001))
    assert sorted(r["rank"] for r in ranking.hash_rank(df, df["id"], 5).collect()) == list(range(1, 1001))
    by_text = ranking.global_rank(df, ["s", "id"]).orderBy("s", "id").collect()
    assert [r["rank"] for r in by_text] == list(range(1, 1001))
