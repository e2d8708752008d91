"""What the operators of this subpackage share: reading tables, shared scratch space, shipping code, id hashing."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir. Only a session whose master is local may leave it unset, as
    tests do; it gets one of its own. On a cluster a folder of one machine would lose what other machines write, so there it
    is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = getattr(spark.sparkContext, "_siftworks_scratch", None) or tempfile.mkdtemp(prefix="siftworks-scratch-")
        spark.sparkContext._siftworks_scratch = folder
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path under a folder of this application, which its file system deletes when the application ends. What an application
    that was killed leaves there may be deleted by anyone: <spark.checkpoint.dir>/siftworks/<application id>."""
    sc = spark.sparkContext
    own = f"{scratch_dir(spark)}/siftworks/{sc.applicationId}"
    if getattr(sc, "_siftworks_own", None) != own:
        path = sc._jvm.org.apache.hadoop.fs.Path(own)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        sc._siftworks_own = own
    return f"{own}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: it cuts lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._siftworks_path = path
    return back


def discard(*frames: DataFrame) -> None:
    """Delete what materialize wrote, once nothing that is still to be computed reads it. The shuffle files behind it go when the
    driver's collector finds that their frames are gone, for which it is called here, after Python's own."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._siftworks_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    tidy(frames[0].sparkSession)


def tidy(spark: SparkSession) -> None:
    """Call both collectors, so that shuffle files of frames that are gone are deleted. What has only just ended may still be held by
    Spark's listeners, so this is worth calling again before much is shuffled next."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def unused(name: str, *frames: DataFrame) -> str:
    """The name, with as many underscores behind it as keep it apart from the frames' columns (which Spark tells apart by letters
    alone, not by their case)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Keys with at least this share of all rows are joined by a broadcast of their values, which are then as many at most.
HOT_SHARE = 1024


def join_by_key(rows: DataFrame, per_key: DataFrame, key: str, total: int) -> DataFrame:
    """rows with the columns of per_key, which has each key of rows once and n, how many of the `total` rows have it; without n.

    The keys with more than total / HOT_SHARE rows, HOT_SHARE at most, are broadcast, so that none of them gathers its rows in one
    task; all others meet in a shuffle. A null key is joined to nothing."""
    values = [c for c in per_key.columns if c not in (key, "n")]
    hot = F.col("n") * HOT_SHARE > total
    few = per_key.where(hot).select(key, F.struct(*values).alias("_hot"))
    marked = rows.join(F.broadcast(few), key, "left")
    there = marked.where("_hot IS NOT NULL").select(*rows.columns, "_hot.*")
    rest = marked.where("_hot IS NULL").select(*rows.columns).join(per_key.where(~hot).drop("n"), key).select(*rows.columns, *values)
    return there.unionByName(rest)


def bucket_of_id(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4, the split that the learning operators hold out by; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(-1))


def held_out(doc_id: Column) -> Column:
    return bucket_of_id(doc_id) == 2


#: crc32 of {0}, a string of ASCII characters, in DuckDB, bit by bit.
CRC32_SQL = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({0}, ''), lambda x: ord(x)::UBIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT)"""


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that workers can import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_siftworks_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="siftworks-"), "siftworks_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._siftworks_shipped = True


def slices(batch, bytes_at_once: int = 2 << 20, rows_at_once: int = 1024, text: str = "text") -> Iterator:
    """Cut an Arrow batch so that Python never holds more than about bytes_at_once of text (one row at least)."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_pylist()
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if i > first and (held + n > bytes_at_once or i - first >= rows_at_once):
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if batch.num_rows > first:
        yield batch.slice(first)
