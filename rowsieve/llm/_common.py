"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from rowsieve.shipping import ship

#: Lookup tables with columns of no fixed width may be broadcast up to this many rows; larger ones are joined by a salted shuffle.
BROADCAST_ROWS = 20_000
#: Copies of each row of a lookup table that is too large to broadcast.
SALTS = 16
#: Arrow batches of texts are cut in halves while they are larger than this.
BATCH_CHARS = 4_000_000

#: Bytes of a lookup table that may be broadcast.
BROADCAST_BYTES = 32_000_000

#: Folders made where spark.checkpoint.dir is unset, by application.
_own: dict[str, str] = {}
#: Paths of the tables that each settled() under way will delete, innermost last, by thread.
_open = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or a fresh local one where it is unset and all runs
    on one machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        folder = _own.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="rowsieve-")
        _own[app] = folder
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    if stack := getattr(_open, "stack", None):
        stack[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, work: Callable[[], DataFrame], path: str) -> DataFrame:
    """The result of work as a table at path. Tables that were materialized on the way are deleted, so what work gives
    to others must not depend on them."""
    stack = _open.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        df = work()
        df.write.parquet(path)
    finally:
        for old in stack.pop():
            delete(spark, old)
    if stack:
        stack[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder through Spark's own filesystems."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def by_place(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns renamed by place, so that no other column clashes with them, and the new names by the old ones."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def fits_broadcast(small: DataFrame) -> bool:
    """Whether a table has few enough rows and, at most, bytes; a fixed-width row is counted with what a hash table adds."""
    fixed = all(f.dataType.simpleString() in ("bigint", "int", "double", "boolean", "date", "timestamp") for f in small.schema)
    most = BROADCAST_BYTES // (24 + 8 * len(small.columns)) if fixed else BROADCAST_ROWS
    if small.limit(most + 1).count() > most:
        return False
    if fixed:
        return True
    size = F.lit(0)
    for f in small.schema:
        size = size + F.coalesce(F.length(F.to_json(F.struct(F.col(f"`{f.name}`")))), F.lit(0))
    return (small.agg(F.sum(size).alias("n")).first()["n"] or 0) <= BROADCAST_BYTES


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(right[k])
    return condition


def lookup(big: DataFrame, small: DataFrame, keys: Sequence[str], row_salt: Column, how: str = "inner") -> DataFrame:
    """Join big with a materialized lookup table on keys (null equals null), whatever the skew of big.

    small is broadcast only when its counted rows and bytes allow it (fits_broadcast). Otherwise each of its rows
    is copied SALTS times and big is dealt over the copies by row_salt, so a key that holds a third of
    all rows spreads over SALTS tasks."""
    names = {k: f"__{k}" for k in keys}
    if fits_broadcast(small):
        right = small.withColumnsRenamed(names)
        on = F.lit(True)
        for k in keys:
            on = on & big[k].eqNullSafe(right[names[k]])
        return big.join(F.broadcast(right), on, how).drop(*names.values())
    left = big.withColumn("__salt", F.pmod(F.xxhash64(row_salt), F.lit(SALTS)).cast("int"))
    right = small.withColumnsRenamed(names).withColumn("__salt_r", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on = left["__salt"] == right["__salt_r"]
    for k in keys:
        on = on & left[k].eqNullSafe(right[names[k]])
    return left.join(right, on, how).drop("__salt", "__salt_r", *names.values())


def words_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def map_texts(docs: DataFrame, text: str, keep: Sequence[str], made: str, work: Callable[[list[str | None]], Sequence[list | np.ndarray | pa.Array]]) -> DataFrame:
    """The columns in keep, untouched, and those of the DDL schema made, which work gives for each batch of texts.

    Arrow batches go through as they are, so null or very large keys stay exact. Rows aren't shuffled; work runs
    in the Python workers and sees one batch at a time, cut to about BATCH_CHARS."""
    ship(docs.sparkSession)
    fields = T.StructType([docs.schema[c] for c in keep])
    out = T._parse_datatype_string(made)
    schema = T.StructType([*(T.StructField(f"k{i}", f.dataType) for i, f in enumerate(fields)), *out])
    n, types = len(fields), [to_arrow_type(f.dataType) for f in out]
    at = list(keep).index(text) if text in keep else n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _cut(whole, at):
                columns = work(batch.column(at).to_pylist())
                arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *arrays], names=[f.name for f in schema])

    rows = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], *[docs[text].alias("text")] * (at == n)).mapInArrow(run, schema)
    return rows.withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def _cut(batch: pa.RecordBatch, n: int) -> Iterator[pa.RecordBatch]:
    if batch.num_rows < 2 or batch.column(n).nbytes <= BATCH_CHARS:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from _cut(batch.slice(0, half), n)
        yield from _cut(batch.slice(half), n)
