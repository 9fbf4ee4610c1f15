"""Reading and writing tables: typed scans, ragged text, series registry, sinks with manifests."""

from __future__ import annotations

import datetime
import json
import os
from importlib.metadata import version

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import no_nan


def data_root(given: str | None = None, default: str = "data") -> str:
    """The folder of inputs: the argument, or the environment's PANEL_DATA_ROOT, or a default."""
    return given or os.environ.get("PANEL_DATA_ROOT") or default


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """CSV or TSV with a header and a declared schema; empty, NA and NaN are null."""
    df = spark.read.schema(schema).option("sep", sep).option("header", True).option("nullValue", "NA").csv(path)
    return df.select(*[no_nan(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema])


def read_ragged(spark: SparkSession, path: str, wanted: dict[str, str], sep: str = ",") -> DataFrame:
    """Columns of a delimited file by header name, where rows may be longer than the header.

    wanted maps names to types.  A row too short for the last wanted column raises.  A byte order mark
    is dropped.  Values are cast leniently: what does not parse is null.
    """
    lines = spark.read.text(path).withColumn("value", F.regexp_replace("value", "^﻿", "")).withColumn("value", F.regexp_replace("value", r"\r$", ""))
    header = lines.first()["value"].split(sep)
    missing = [c for c in wanted if c not in header]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    last = max(header.index(c) for c in wanted)
    parts = lines.where(F.col("value") != sep.join(header)).select(F.split("value", sep, -1).alias("p"))
    checked = parts.withColumn("p", F.when(F.size("p") > last, F.col("p")).otherwise(F.raise_error(F.concat(F.lit("row is too short: "), F.array_join("p", sep))).cast("array<string>")))
    return checked.select(*[F.nullif(F.trim(F.get("p", F.lit(header.index(c)))), F.lit("")).try_cast(t).alias(c) for c, t in wanted.items()])


def day_first_timestamp(text, pattern: str = "d/M/yyyy H:mm[:ss]"):
    """Day-first text as a timestamp; text that does not parse raises."""
    parsed = F.try_to_timestamp(text, F.lit(pattern))
    return F.when(text.isNull() | parsed.isNotNull(), parsed).otherwise(F.raise_error(F.concat(F.lit("no day-first time: "), text)).cast("timestamp"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of every file below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.sha2("content", 256).alias("sha256"))


def require_hash(spark: SparkSession, path: str, expected: str) -> None:
    found = [r["sha256"] for r in file_hashes(spark, path).limit(2).collect()]
    if found != [expected.lower()]:
        raise ValueError(f"{path}: sha256 is {found}, not {expected}")


def union_outcomes(frames: dict[tuple[str, str], DataFrame], ids: list[str]) -> DataFrame:
    """One long table of several data sets: dataset, outcome, ids, value."""
    parts = [df.select(F.lit(d).alias("dataset"), F.lit(o).alias("outcome"), *ids, "value") for (d, o), df in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_all(tables: dict[str, DataFrame], folder: str, seed: int | None = None, checks: dict | None = None) -> dict:
    """Write each table by its name's extension (.parquet or .csv) and a manifest; returns the manifest."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        target = f"{folder}/{name}"
        if name.endswith(".parquet"):
            df.write.mode("overwrite").parquet(target)
        elif name.endswith(".csv"):
            df.write.mode("overwrite").option("header", True).csv(target)
        else:
            raise ValueError(f"no writer for {name}")
    made = {"written": datetime.datetime.now(datetime.UTC).isoformat(), "versions": {m: version(m) for m in ("pyspark", "pandas", "numpy", "pyarrow")}, "seed": seed, "checks": checks or {}, "outputs": {}}
    for name in tables:
        files = file_hashes(spark, f"{folder}/{name}").where(F.col("path").rlike(r"part-[^/]*$")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("sha256")), ",").cast("binary"), 256)).first()[0]
        made["outputs"][name] = files
    spark.createDataFrame([(json.dumps(made, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest.json")
    return made


#: Registered cohorts: a loader of (spark, folder) for each name.
COHORTS: dict = {}


def register(name: str):
    """Registers a loader of a cohort's long table under a name."""

    def add(load):
        COHORTS[name] = load
        return load

    return add


def cohort(spark: SparkSession, folder: str, name: str, only_complete: str | None = None) -> DataFrame:
    """The registered cohort's rows, those alone where the only_complete column is true, if it is given."""
    if name not in COHORTS:
        raise KeyError(f"no cohort {name}; there are {sorted(COHORTS)}")
    rows = COHORTS[name](spark, folder)
    return rows.where(F.col(only_complete)) if only_complete else rows


def require_files(spark: SparkSession, *paths: str) -> None:
    """Raises unless every path, such as a protocol that must exist before results, can be listed by Spark."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            raise FileNotFoundError(path)
