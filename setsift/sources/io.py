"""Reading inputs and writing result tables.

Inputs are read with explicit schemas (no inference pass over the data); Parquet is
the normal format, CSV is supported for the reference's file layout (header row,
quoted multi-line fields; a byte-order mark is stripped by Spark). Writes go through
Spark's committers, one directory per table.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.names import col
from .. import constants as K
from ..operators.columns import require_columns, score_columns

TEXTS_SCHEMA = "case_id string, text string, outcome int"
PROTOTYPES_SCHEMA = "condition_name string, prototype string, type string"


def _reader(spark: SparkSession, fmt: str, schema: str | StructType | None):
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        r = r.option("header", "true").option("multiLine", "true").option("quote", '"').option("escape", '"')
        if schema is None:
            r = r.option("inferSchema", "true")
    return r.format(fmt)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | StructType | None = None) -> DataFrame:
    """Any result or input table (Spark raises on a missing path)."""
    return _reader(spark, fmt, schema).load(path)


def read_texts(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | StructType | None = None,
               text: str = "text", case_id: str = "case_id") -> DataFrame:
    """Text dataset: requires the id and text columns; text becomes a string."""
    df = read_table(spark, path, fmt, schema if schema is not None or fmt != "csv" else TEXTS_SCHEMA)
    require_columns(df, [case_id, text], "text dataset")
    if fmt == "csv" and schema is None:
        df = _typed_ids(df, case_id)
    return df.withColumn(text, col(text).cast("string"))


def _typed_ids(df: DataFrame, case_id: str) -> DataFrame:
    """Ids of a CSV file as numbers when each of them is the plain writing of one (no sign, no leading zero), so that
    they sort as numbers; one pass over the id column."""
    plain = col(case_id).rlike(r"^(0|[1-9][0-9]{0,17})$")
    others = df.agg(F.count_if(col(case_id).isNotNull() & ~plain)).first()[0]
    return df if others else df.withColumn(case_id, col(case_id).cast("long"))


def read_prototypes(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Prototype table: condition_name, prototype, type, all strings."""
    df = read_table(spark, path, fmt, PROTOTYPES_SCHEMA if fmt == "csv" else None)
    require_columns(df, K.PROTOTYPE_COLUMNS, "prototypes")
    return df.select(*[col(c).cast("string").alias(c) for c in K.PROTOTYPE_COLUMNS])


def read_scores(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | StructType | None = None) -> DataFrame:
    """Score table: at least one ``_score`` column."""
    df = read_table(spark, path, fmt, schema)
    score_columns(df)
    return df


def read_qca_ready(spark: SparkSession, path: str, fmt: str = "parquet", outcome: str = "outcome",
                   schema: str | StructType | None = None) -> DataFrame:
    df = read_table(spark, path, fmt, schema)
    if outcome not in df.columns:
        raise ValueError(f"the QCA-ready table has no outcome column '{outcome}'")
    return df


def read_labeled(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | StructType | None = None) -> DataFrame:
    return read_table(spark, path, fmt, schema)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """One table, one directory; CSV gets a header row."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", "true").option("quote", '"').option("escape", '"')
    w.save(path)
    return path


def settings_table(spark: SparkSession, settings: dict) -> DataFrame:
    """The run settings as a one-row table (values as text, keys in the given order)."""
    cols = ", ".join(f"`{k}` string" for k in settings)
    return spark.createDataFrame([tuple(None if v is None else str(v) for v in settings.values())], cols)


def write_bundle(tables: dict[str, DataFrame | None], out_dir: str, fmt: str = "parquet", mode: str = "overwrite") -> dict[str, str]:
    """Write every present table to ``out_dir/<name>``; absent (None) tables are skipped."""
    written = {}
    for name, df in tables.items():
        if df is None:
            continue
        written[name] = write_table(df, f"{out_dir.rstrip('/')}/{name}", fmt, mode)
    return written


MANIFEST_SCHEMA = "version long, run string, fmt string, tables map<string,long>, settings map<string,string>"


def bundle_manifest(spark: SparkSession, out_dir: str) -> dict | None:
    """What the latest whole bundle of ``out_dir`` holds: version, run, fmt, tables (name: rows), settings; None if there is
    none."""
    try:
        rows = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{out_dir.rstrip('/')}/_manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    last = rows.orderBy(F.col("version").desc(), "run").limit(1).collect()
    return last[0].asDict() if last else None


def publish_bundle(spark: SparkSession, tables: dict[str, DataFrame | None], out_dir: str, settings: dict | None = None, fmt: str = "parquet") -> dict:
    """All present tables or nothing: they are written to a folder of this run, counted as read back, and one manifest row
    (version, run, table names with row counts, settings) is appended last. Until then readers see the bundle before."""
    base, run = out_dir.rstrip("/"), f"run-{uuid.uuid4().hex}"
    before = bundle_manifest(spark, base)
    counts = {}
    for name, df in tables.items():
        if df is not None:
            path = write_table(df, f"{base}/{run}/{name}", fmt, "errorifexists")
            counts[name] = read_table(spark, path, fmt, df.schema).count()
    row = (1 + (before["version"] if before else 0), run, fmt, counts, {k: None if v is None else str(v) for k, v in (settings or {}).items()})
    spark.createDataFrame([row], MANIFEST_SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/_manifest")
    return bundle_manifest(spark, base)


def read_bundle(spark: SparkSession, out_dir: str, name: str, schema: str | StructType | None = None) -> DataFrame:
    """A table of the latest whole bundle."""
    m = bundle_manifest(spark, out_dir)
    if m is None or name not in m["tables"]:
        raise ValueError(f"no whole bundle with a table '{name}' in {out_dir}")
    return read_table(spark, f"{out_dir.rstrip('/')}/{m['run']}/{name}", m["fmt"], schema)
