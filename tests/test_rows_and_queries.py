import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessella.operators import overlays, rows
from tessella.plans import queries

DATA = "/root/testdata/sf0.001"


def test_row_hash(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    got = [r[0] for r in df.select(rows.row_hash(["k", "v"])).collect()]
    assert got == [hashlib.sha256(t.encode()).hexdigest() for t in ("1\x1fa", "2\x1f\x00")]
    with pytest.raises(ValueError, match="algorithm"):
        rows.row_hash(["k"], "crc")


def test_paths(spark):
    df = spark.createDataFrame([("/x/P1_2.ome.tiff",), ("P3_1.svs",)], "p string")
    got = df.select(rows.stem(F.col("p")), rows.patient_id(F.col("p")), rows.with_suffix(F.col("p"), ".svs", ".tif"), rows.is_ome(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("P1_2.ome", "P1", "/x/P1_2.ome.tiff", True), ("P3_1", "P3", "P3_1.tif", False)]


def test_fraction_map(spark):
    df = spark.createDataFrame([(1, 255), (1, 255), (1, 0), (2, 0)], "tile int, v int")
    maps = overlays.fraction_map(overlays.value_fractions(df, ["tile"], "v"), ["tile"], "v").orderBy("tile")
    assert [r["overlap"] for r in maps.collect()] == [{"0": pytest.approx(1 / 3), "255": pytest.approx(2 / 3)}, {"0": 1.0}]
    assert [r[0] for r in maps.select(overlays.covered(F.col("overlap"), "255", 0.5)).collect()] == [True, False]


def test_entry_and_native_plans(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(queries.ORACLES) == set(queries.QUERIES) <= set(__spark_entry__.queries())
    for name in ("grid_keep", "tensor_axis01", "mask_mean", "overlay_fraction", "morph_open", "annotation_join"):
        plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_the_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace

    from tessella.sources.files import shared_folder

    conf = SimpleNamespace(get=lambda *_: None)
    for master, fails in (("yarn", True), ("local-cluster[2,1,1024]", True), ("local[4]", False)):
        session = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master=master), conf=conf)
        if fails:
            with pytest.raises(ValueError, match="spark.checkpoint.dir"):
                shared_folder(session)
        else:
            assert shared_folder(session).startswith("file:///")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings labels").split():
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = queries.QUERIES[name](spark, DATA)
    want = con.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda row: tuple(f"{v:.7g}" if isinstance(v, float) else str(v) for v in row)
    assert sorted(key(r[c] for c in names) for r in got.collect()) == sorted(map(key, want.fetchall()))
