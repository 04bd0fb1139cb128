import gzip
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from cohortlens.operators.features import TOTALS
from cohortlens.sources import curves as C
from cohortlens.sources import rules as R
from cohortlens.sources import tables as T


def test_gzip_csv_with_typed_schema(spark, tmp_path):
    names = ["numero_de_cliente", "foto_mes", "mcuentas_saldo", "Visa_mpagado", "Visa_status", "clase_ternaria"]
    with gzip.open(tmp_path / "s.csv.gz", "wt") as f:
        f.write(",".join(names) + "\n1598518152,202101,-12.5,,9,CONTINUA\n7,202102,3,4.25,,\n")
    schema = T.snapshot_schema(names, "numero_de_cliente", "foto_mes", "clase_ternaria")
    df = T.read_csv(spark, str(tmp_path / "s.csv.gz"), schema, partitions=2)
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "int", "double", "double", "int", "string"]
    assert sorted(map(tuple, df.collect())) == [
        (7, 202102, 3.0, 4.25, None, None),
        (1598518152, 202101, -12.5, None, 9, "CONTINUA"),
    ]


def test_a_broken_csv_is_not_read_as_nulls(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,foto_mes\nabc,202101\n")
    schema = T.snapshot_schema(["id", "foto_mes"], "id", "foto_mes")
    with pytest.raises(Exception):
        T.read_csv(spark, str(tmp_path / "x.csv"), schema).collect()


def test_versions_and_partition_pruning(spark, tmp_path):
    df = spark.range(30).selectExpr("id", "cast(202101 + id % 3 as int) as foto_mes")
    first = T.write_snapshots(df, str(tmp_path / "t"), "foto_mes")
    again = T.write_snapshots(spark.read.parquet(first).where("id < 3"), str(tmp_path / "t"), "foto_mes")
    assert first != again and spark.read.parquet(first).count() == 30
    out = T.read_months(spark, first, "foto_mes", [202102])
    assert out.count() == 10
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(foto_mes" in plan or "PartitionFilters: [(foto_mes" in plan or "foto_mes#" in plan.split("PartitionFilters")[1][:60]


def test_csv_is_not_written_over(spark, tmp_path):
    T.write_csv(spark.range(1), str(tmp_path / "o"))
    with pytest.raises(AnalysisException):
        T.write_csv(spark.range(1), str(tmp_path / "o"))


CURVE = [
    "1 as ganancia", "0.5D as y_pred_lgm", "1D as public", "0D as private",
    "id as nro_envios", "3D as public_cum", "4D as private_cum",
]


def test_cut_point_files_from_names(spark, tmp_path):
    head = "ganancia,y_pred_lgm,public,private,nro_envios,public_cum,private_cum\n"
    (tmp_path / "df_cut_point-exp9-3-17-mayo.csv").write_text(head + "273000,0.9,0.0,390000.0,0,0.0,390000.0\n")
    (tmp_path / "top_n_trials.csv").write_text("a\n1\n")
    folder = str(tmp_path)
    C.write_cut_point_files(
        spark.range(2).selectExpr(*CURVE, "4 as trial", "19 as seed"), str(tmp_path / "sub"), "exp9", "trial", "seed", "mayo"
    )
    out = C.read_cut_point_files(spark, folder)
    assert [tuple(r) for r in out.select("model", "trial", "semilla", "ganancia", "private_score_acumulado").collect()] == [
        ("exp9", "3", "17", 273000, 390000.0)
    ]
    runs = C.read_cut_point_files(spark, str(tmp_path / "sub"))
    assert {tuple(r) for r in runs.select("trial", "semilla", "nro_envios").collect()} == {("4", "19", 0), ("4", "19", 1)}


def test_cut_points_by_run_and_finished(spark, tmp_path):
    path = str(tmp_path / "cp")
    schema = "study string, trial int, seed int, month int"
    assert T.finished_runs(spark, path, C.RUN, schema).count() == 0
    run = spark.range(3).selectExpr(*CURVE, "'e' as study", "1 as trial", "17 as seed", "202105 as month")
    C.write_cut_points(run, path)
    C.write_cut_points(run.withColumn("seed", F.lit(18)), path)
    assert sorted(r["seed"] for r in T.finished_runs(spark, path, C.RUN, schema).collect()) == [17, 18]
    assert "public_score_acumulado" in C.read_cut_points(spark, path).columns


def test_submissions(spark, tmp_path):
    df = spark.range(4).selectExpr("id", "cast(id < 2 as int) as Predicted", "9 as trial", "17 as seed", "2 as n_envios")
    C.write_submissions(df, str(tmp_path / "s"), ["trial", "seed"])
    assert os.path.isdir(tmp_path / "s" / "trial=9" / "seed=17" / "n_envios=2")


def test_rule_files(spark, tmp_path):
    (tmp_path / "imp.txt").write_text("varname,varcname,CASO_NULL\nclase,clase,NA\nlag1_a,a,-1\nb,b,-9999999999\n")
    rules = R.sentinel_rules(R.read_imputation(spark, str(tmp_path / "imp.txt")))
    assert rules == {"clase": None, "lag1_a": -1.0, "a": -1.0, "b": -9999999999.0}
    (tmp_path / "dic.txt").write_text('"var","min","max","nunique","nulls","DESCRIPCION","CASO_NULL"\n"a",0,1,2,5,"first, with comma",-99\n"c","-1.5","2",3,0,"x",\n')
    dic = R.read_dictionary(spark, str(tmp_path / "dic.txt"))
    assert R.sentinel_rules(dic, "var") == {"a": -99.0, "c": None}
    (tmp_path / "ranks.txt").write_text(
        '"var","min","max","nunique","nulls","DESCRIPCION","ordinal","percentil","decil","cuartil"\n'
        '"a",0,1,2,0,"x","T","T","T","T"\n"b",0,1,2,0,"y","T",,"T","T"\n"c",0,1,2,0,"z","F",,,\n'
    )
    assert R.read_rank_flags(spark, str(tmp_path / "ranks.txt")) == {
        "a": {"ordinal", "percentil", "decil", "cuartil"},
        "b": {"ordinal", "decil", "cuartil"},
        "c": set(),
    }
    (tmp_path / "drop.csv").write_text("fname\nlag1_x\n")
    assert [r[0] for r in R.read_drop_list(spark, str(tmp_path / "drop.csv")).collect()] == ["lag1_x"]
    assert "mtotal_prestamos" in TOTALS
