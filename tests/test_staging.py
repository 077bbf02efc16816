"""Tables on the way."""

from tessera.staging import Staging, fresh_path, shared_dir


def exists(path):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)


def test_staged_tables_go_but_for_those_kept(spark):
    df = spark.range(10).selectExpr("id", "array(id) AS x")
    with Staging(spark) as staged:
        gone, kept = staged(df), staged(df.where("id < 3"), keep=True)
        paths = [x.inputFiles()[0].rpartition("/")[0] for x in (gone, kept)]
        assert gone.dtypes == df.dtypes and gone.count() == 10 and all(map(exists, paths))
    assert kept.count() == 3 and [*map(exists, paths)] == [False, True]
    a, b = fresh_path(spark), fresh_path(spark)
    assert a != b and a.startswith(f"{shared_dir(spark)}/") and not exists(a)
