"""Track files as a data source, and the command line over them."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from ethogrid import cli
from ethogrid.operators import artifact
from ethogrid.sources import track_files
from ethogrid.sources.store import Store


def rows(n=8, seed=1):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        v = f"v {k}/ü%" if k < 2 else f"v{k}"
        for i in range(60):
            seen = rng.random() < 0.9
            out.append((v, i, i * 0.5, rng.gauss(0, 3 + k % 2 * 20) if seen else None, rng.gauss(0, 3) if seen else None, None, float(rng.randint(0, 50)) if seen else None, seen))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('tracks')}"
    df = spark.createDataFrame([*rows(), (None, 1, 1.0, 1.0, 1.0, None, None, True)], track_files.SCHEMA).repartition(3)
    assert track_files.write(df, path).agg(F.sum("rows")).first()[0] == 480
    return path


def test_files_give_the_rows_back(spark, folder):
    got = track_files.read(spark, folder)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows(), key=str)
    assert got.rdd.getNumPartitions() == 8


def test_conditions_choose_files_and_rows(spark, folder):
    got = track_files.read(spark, folder, stride=3).where("video_id IN ('v 0/ü%', 'v3', 'none') AND t_sec >= 4 AND t_sec < 20.5 AND x > 0 AND frame_idx <= 30")
    assert got.rdd.getNumPartitions() == 2
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "(x#" in plan and "4.0" not in plan and "none" not in plan  # Spark is left with what the readers don't take
    want = [r for r in rows() if r[0] in ("v 0/ü%", "v3") and r[1] % 3 == 0 and 4 <= r[2] < 20.5 and r[3] is not None and r[3] > 0 and r[1] <= 30]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert track_files.read(spark, folder).where("video_id = 'none'").collect() == []
    with pytest.raises(Exception, match="stride 0"):
        track_files.read(spark, folder, stride=0).collect()


def test_an_empty_folder_gives_no_rows(spark, tmp_path):
    assert track_files.read(spark, f"file://{tmp_path}").collect() == []
    assert track_files.read(spark, f"file://{tmp_path}/none").collect() == []


def test_small_files_share_partitions(spark, tmp_path):
    many = [(f"v{k:03}", i, i * 0.5, 1.0 * k, None, None, None, True) for k in range(120) for i in range(3)]
    track_files.write(spark.createDataFrame(many, track_files.SCHEMA), f"file://{tmp_path}").count()
    got = track_files.read(spark, f"file://{tmp_path}").where("t_sec < 1")
    assert got.rdd.getNumPartitions() <= 20  # not 120
    assert sorted(map(tuple, got.collect())) == [r for r in many if r[2] < 1]


def test_a_second_write_replaces_its_subjects_only(spark, tmp_path):
    path = f"file://{tmp_path}"
    df = spark.createDataFrame(rows(3), track_files.SCHEMA)
    track_files.write(df, path).collect()
    track_files.write(df.where("video_id = 'v2'").withColumn("x", F.lit(7.0)), path).collect()
    got = track_files.read(spark, path)
    assert got.where("x = 7").select("video_id").distinct().collect()[0].video_id == "v2" and got.count() == 180


def test_the_command_line_from_tracks_to_predictions(spark, folder, tmp_path, capsys):
    out = f"file://{tmp_path}"
    (tmp_path / "t.json").write_text(json.dumps({"erratic": 12.0, "min_freeze_s": 0.5, "bin_s": 1.0}))
    common = ["--tracks", folder, "--store", f"{out}/store", "--thresholds", f"{out}/t.json"]
    assert cli.main(["process", *common, "--limit", "3"], spark) == {"processed": 3}
    assert sorted(r.video_id for r in Store(spark, f"{out}/store").manifests().collect()) == ["v 0/ü%", "v 1/ü%", "v2"]
    assert cli.main(["process", *common], spark) == {"processed": 5}
    assert cli.main(["process", *common], spark) == {"processed": 0}
    ids = sorted({r[0] for r in rows()})
    day = datetime.date(2024, 1, 1)
    spark.createDataFrame([(v, "ab"[i % 2], "1", day + datetime.timedelta(days=i % 3)) for i, v in enumerate(ids)], "video_id string, compound string, concentration_mM string, date date").write.parquet(f"{out}/catalog")
    assert cli.main(["featurize", "--store", f"{out}/store", "--catalog", f"{out}/catalog", "--out", f"{out}/table"], spark) == {"rows": 8, "features": 55}
    flags = ["--folds", "2", "--repeats", "1", "--members", "2", "--epochs", "5"]
    assert cli.main(["train", "--table", f"{out}/table", "--out", f"{out}/run", "--models", "network", "logistic", *flags], spark) == {"model": "network", "classes": 2, "rows": 8}
    assert {r.model for r in spark.read.parquet(f"{out}/run/scores").collect()} == {"majority", "date_only", "network", "logistic"}
    assert cli.main(["predict", "--run", f"{out}/run", "--table", f"{out}/table", "--out", f"{out}/p"], spark) == {"rows": 16}
    assert artifact.load_model(spark, f"{out}/run/model").gap(spark.read.parquet(f"{out}/table/training_table.parquet")).first()[0] == 0
    (tmp_path / "g.json").write_text(json.dumps({"shares": ["state_controlled_swim_share", "state_erratic_movement_share"]}))
    assert cli.main(["ablate", "--table", f"{out}/table", "--out", f"{out}/run", "--groups", f"{out}/g.json", "--vehicle", "a", "--models", "majority", *flags], spark)["rows"] >= 4
    assert [json.loads(x) for x in capsys.readouterr().out.strip().splitlines()][0] == {"processed": 3}


@pytest.mark.parametrize("args", [["process"], ["process", "--tracks", "x", "--store", "y", "--limit", "0"], ["train", "--table", "x", "--out", "y", "--models", "magic"], []])
def test_wrong_arguments_end_the_command_line(args):
    with pytest.raises(SystemExit):
        cli.main(args)
