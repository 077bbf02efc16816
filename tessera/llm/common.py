"""Helpers that the operators of this package share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a Java regular expression.
SPACE = r"[\x20\x09-\x0D]+"
#: The same characters, for translate().
SPACE_CHARS = " \t\n\x0b\x0c\r"


#: Rows of an Arrow batch where the session hasn't set another number: rows are whole texts, so small batches keep the
#: memory of executors and their Python workers low.
TEXT_BATCH = "256"


def _small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, TEXT_BATCH)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary
    folder is made for a local master; on a cluster this is an error, for executors couldn't see it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage is cut, and the table outlives executors."""
    _small_batches(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/tessera-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[id(out)] = path
    weakref.finalize(out, _paths.pop, id(out), None)
    for tables in _open[-1:]:
        tables.append(out)
    return out


#: Where the tables that stage() made lie, by id of the DataFrame.
_paths: dict[int, str] = {}


#: Of the scratch() blocks that are open, the tables made in them.
_open: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch():
    """Tables that stage() makes in this block are deleted at its end, but for those taken off the list it gives."""
    _open.append([])
    try:
        yield _open[-1]
    finally:
        discard(*_open.pop())


def discard(*staged: DataFrame) -> None:
    """Delete tables that stage() made, once all that was made of them is staged itself."""
    for df in staged:
        if path := _paths.get(id(df)):
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
            where = jvm.org.apache.hadoop.fs.Path(path).getParent()
            where.getFileSystem(conf).delete(where, True)


def let(value: Column, body) -> Column:
    """body(value), with value computed once per row even where body uses it in a lambda."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+`; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; null ids count as the text 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % n
