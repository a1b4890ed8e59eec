"""Reading and writing station data."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        *[T.StructField(c, T.StringType()) for c in ("line_id", "station_id", "part_number", "serial_number")],
        T.StructField("feature_dim_mm", T.DoubleType()),
        *[T.StructField(c, T.StringType()) for c in ("vision_result", "defect_code")],
        T.StructField("cycle_time_s", T.DoubleType()),
        T.StructField("inspection_pass", T.IntegerType()),
    ]
)
CORRUPT = "_corrupt_record"
#: Bytes of a stored table whose rows one task sorts.
PART_BYTES = 4 << 20


def scan_events(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Events with their declared types; nothing is inferred."""
    reader = spark.read.schema(EVENT_SCHEMA)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def parts_by_size(stored: DataFrame) -> int:
    """A number of parts that grows with a table as it is stored, so that what a task
    sorts does not."""
    size = int(str(stored._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES)


def scan_text(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """An extract as it came, all text; casts are made when it is conformed."""
    return spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("header", True).csv(path)


def scan_mixed(spark: SparkSession, path: str) -> DataFrame:
    """The shift log; its work order stays text, so a blank needs no repair."""
    schema = "shift_id string, work_center string, shift_code string, shift_start_ts timestamp_ntz, shift_end_ts timestamp_ntz, wo_no string, units_completed long"
    return spark.read.schema(schema).option("header", True).csv(path)


def scan_tolerant(spark: SparkSession, path: str, schema: T.StructType = EVENT_SCHEMA) -> DataFrame:
    """Bad rows are kept in ``_corrupt_record``; '' and NULL are null."""
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"header": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "nullValue": "NULL", "emptyValue": "", "quote": '"'}
    df = spark.read.schema(wide).options(**options).csv(path)
    return df.withColumns({c.name: F.when(F.col(c.name) != "", F.col(c.name)) for c in schema.fields if c.dataType == T.StringType()})


def optional_source(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet") -> DataFrame:
    """The source, or a table without rows where its path does not exist."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(fmt).load(path)


#: columns of the text extracts, and those that may be absent
TEXT_EXTRACTS = {
    "erp_work_orders": (["WORK_ORDER_NO", "ITEM_NO", "PROD_LINE", "SCHED_START_DT", "SCHED_END_DT"], ["QTY_ORDERED"]),
    "qms_ncr": (["NCR_NO", "SERIAL_NO", "DEFECT_CATEGORY", "DISPOSITION"], ["SEVERITY", "OPENED_DT", "CLOSED_DT"]),
}


def landed(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The extracts that a folder holds as CSV with a header: ``<name>.csv``, a
    file or a folder each. A text extract may have more columns, in any order."""
    found = {}
    for name in ("inspections", "mes_shift_log", *TEXT_EXTRACTS):
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.csv")
        if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            continue
        path = f"{folder}/{name}.csv"
        if name in TEXT_EXTRACTS:
            text = spark.read.option("header", True).csv(path)
            needed, more = TEXT_EXTRACTS[name]
            found[name] = text.select(*needed, *[c for c in more if c in text.columns])
        else:
            found[name] = scan_events(spark, path) if name == "inspections" else scan_mixed(spark, path)
    return found


def source_sanity(df: DataFrame, key: str = "station_id") -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_keys"))


def write_mart(df: DataFrame, path: str, columns: Sequence[str], partition_by: Sequence[str] = ()) -> None:
    """Replaces a mart; its columns always have the same order."""
    out = df.select(*columns).write.mode("overwrite")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)


def write_table(df: DataFrame, schema: str, table: str, partition_by: Sequence[str] = ()) -> None:
    """Writes to a table of the catalogue in place. Columns that it lacks are added
    first, so readers that know only the earlier ones go on; those that the rows lack
    are null in them. Of a table that is parted by columns only the parts that occur
    among the rows are replaced, of others all rows. A column of another type is an error."""
    spark = df.sparkSession
    name = f"{schema}.{table}"
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}")
    if not spark.catalog.tableExists(name):
        out = df.write.format("parquet")
        (out.partitionBy(*partition_by) if partition_by else out).saveAsTable(name)
        return
    have = {f.name.lower(): f for f in spark.table(name).schema.fields}
    for f in df.schema.fields:
        if f.name.lower() in have and have[f.name.lower()].dataType != f.dataType:
            raise ValueError(f"{name}.{f.name} is {have[f.name.lower()].dataType.simpleString()}, not {f.dataType.simpleString()}")
    new = [f for f in df.schema.fields if f.name.lower() not in have]
    if new:
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in new)})")
    mine = {c.lower(): c for c in df.columns}
    target = spark.table(name).schema.fields
    rows = df.select(*[F.col(f"`{mine[f.name.lower()]}`") if f.name.lower() in mine else F.lit(None).cast(f.dataType).alias(f.name) for f in target])
    mode = "spark.sql.sources.partitionOverwriteMode"  # a table's own options do not reach its insert
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:
        rows.write.insertInto(name, overwrite=True)
    finally:
        spark.conf.set(mode, before)


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears whole: written beside its place, then renamed.
    A file that is there already is an error."""
    fs, where = _file_system(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(where) or not fs.rename(aside, where):
        fs.delete(aside, False)
        raise FileExistsError(path)


def digest(columns: Sequence[str]) -> list[Column]:
    """Aggregates that are equal for equal rows in any order: how many, and the
    sum of their hashes."""
    return [F.count("*").alias("n_rows"), F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(20,0)")), F.lit(0)).cast("string").alias("hash_sum")]


def manifests(spark: SparkSession, root: str, name: str) -> list[dict]:
    """The complete versions of a mart, the latest last."""
    fs, where = _file_system(spark, f"{root}/{name}/_manifests")
    if not fs.exists(where):
        return []
    files = sorted(str(f.getPath().toString()) for f in fs.listStatus(where) if f.getPath().getName().endswith(".json"))
    rows = spark.read.text(files, wholetext=True).collect() if files else []  # one row a version
    return sorted((json.loads(r.value) for r in rows), key=lambda m: m["version"])


def publish_mart(df: DataFrame, root: str, name: str, stage: str, columns: Sequence[str] | None = None, partition_by: Sequence[str] = ()) -> dict:
    """Writes a new version of a mart and names it in a manifest with its schema,
    rows and digest, which the write itself observes. Readers see the version when the
    manifest is there, and the last one until then; a write that fails leaves
    it. A mart belongs to the stage that published it first."""
    spark = df.sparkSession
    df = df.select(*(columns or df.columns))
    before = manifests(spark, root, name)
    if before and before[-1]["stage"] != stage:
        raise ValueError(f"{name} belongs to stage {before[-1]['stage']}")
    version = before[-1]["version"] + 1 if before else 1
    path = f"{root}/{name}/v{version:06d}-{uuid.uuid4().hex}"
    seen = Observation()
    out = df.observe(seen, *digest(df.columns)).write
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
    entry = {"version": version, "stage": stage, "path": path, "schema": json.loads(df.schema.json()), **seen.get}
    write_small(spark, f"{root}/{name}/_manifests/{version:06d}.json", json.dumps(entry))
    return entry


def open_mart(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """The last complete version of a mart, or the one asked for, with the schema
    and the order of columns that it was published with."""
    found = [m for m in manifests(spark, root, name) if version in (None, m["version"])]
    if not found:
        raise FileNotFoundError(f"{root}/{name} has no complete version {version or ''}")
    schema = T.StructType.fromJson(found[-1]["schema"])
    return spark.read.schema(schema).parquet(found[-1]["path"]).select(*schema.names)


def expire_mart(spark: SparkSession, root: str, name: str, keep: int = 2) -> int:
    """Removes all but the last versions, and what broken writes left; how many
    folders went. No publisher may run meanwhile."""
    kept = manifests(spark, root, name)[-keep:]
    fs, where = _file_system(spark, f"{root}/{name}")
    names, gone = {m["path"].rsplit("/", 1)[-1] for m in kept}, 0
    for f in fs.listStatus(where):
        if f.getPath().getName().startswith("v") and f.getPath().getName() not in names:
            fs.delete(f.getPath(), True)
            gone += 1
    marks = _file_system(spark, f"{root}/{name}/_manifests")[1]
    for f in fs.listStatus(marks):
        if f.getPath().getName().removesuffix(".json") not in {f"{m['version']:06d}" for m in kept}:
            fs.delete(f.getPath(), False)
    return gone


def write_one_csv(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """One sorted file; for marts of a row a station, not for events."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def report(parts: dict[str, DataFrame]) -> DataFrame:
    """One row with a struct for each part; every part is one row."""
    out = None
    for name, df in parts.items():
        one = df.select(F.struct(*df.columns).alias(name))
        out = one if out is None else out.join(F.broadcast(one), F.lit(True))  # one row each
    return out


def write_report(parts: dict[str, DataFrame], path: str) -> None:
    report(parts).coalesce(1).write.mode("overwrite").json(path)


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder of ``spark.checkpoint.dir``. Where that
    is unset, it is below the warehouse, if that is no folder of one machine, or, if
    driver and executors are one process, in a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.split("[")[0] == "local":
        root = tempfile.mkdtemp(prefix="plantlens-")
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir")
        if _file_system(spark, root)[0].getScheme() == "file":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/')}/plantlens-{tag}-{uuid.uuid4().hex}"
