"""Data quality: duplicates, conflicts, grids, key sets, reconciliation, privacy audits."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def without_conflicts(df: DataFrame, keys: Sequence[str], items: Sequence[str]) -> DataFrame:
    """Keys whose rows differ in items are dropped whole; equal repeats leave one row."""
    kept = df.groupBy(*keys).agg(F.count_distinct(F.struct(*items)).alias("_d"), *[F.min(i).alias(i) for i in items])
    return kept.where("_d = 1").drop("_d")


def grid_report(df: DataFrame, entity: Sequence[str], counter: str, expected: int) -> DataFrame:
    """Entities whose counters are not exactly 1..expected, each once."""
    g = df.groupBy(*entity).agg(F.count("*").alias("rows"), F.count_distinct(counter).alias("different"), F.min(counter).alias("low"), F.max(counter).alias("high"))
    return g.where(f"rows <> {expected} OR different <> {expected} OR low <> 1 OR high <> {expected}")


def key_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on one side alone, with side 'left' or 'right'."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return x.join(y, list(keys), "left_anti").withColumn("side", F.lit("left")).unionByName(y.join(x, list(keys), "left_anti").withColumn("side", F.lit("right")))


def reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float = 1e-10) -> DataFrame:
    """Full outer join one to one: presence (both, left, right) and whether columns agree."""
    x = a.select(*keys, *[F.col(c).alias(f"{c}_left") for c in columns], F.lit(True).alias("_l"))
    y = b.select(*keys, *[F.col(c).alias(f"{c}_right") for c in columns], F.lit(True).alias("_r"))
    met = x.join(y, list(keys), "full")
    presence = F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "left").otherwise("right")
    agree = F.lit(True)
    for c in columns:
        agree = agree & ((F.abs(F.col(f"{c}_left") - F.col(f"{c}_right")) <= tolerance) | (F.col(f"{c}_left").isNull() & F.col(f"{c}_right").isNull()))
    return met.withColumn("presence", presence).withColumn("agree", F.coalesce(agree, F.lit(False))).drop("_l", "_r")


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df, whose keys must be unique; a repeated key raises when the result is computed."""
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("_u", F.assert_true(n == 1, F.lit(f"keys {list(keys)} repeat"))).where(F.col("_u").isNull()).drop("_u")


def require_no_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull()
    return df.withColumn("_u", F.assert_true(ok, F.lit(f"missing values in {list(columns)}"))).where(F.col("_u").isNull()).drop("_u")


def varying_features(df: DataFrame, entity: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Entities in which a column that should be frozen takes several values."""
    g = df.groupBy(*entity).agg(*[F.count_distinct(c).alias(c) for c in columns])
    return g.where(" OR ".join(f"`{c}` > 1" for c in columns))


def reverse_scored(item: Column, low: float, high: float) -> Column:
    return low + high - item


def scale_total(df: DataFrame, keys: Sequence[str], items: Sequence[str], low: float, high: float, most: float) -> DataFrame:
    """keys, items and score (their sum) of rows whose items are all within low..high; keys whose rows differ are left out.

    A score beyond most raises when the result is computed.
    """
    valid = df
    for i in items:
        valid = valid.where(F.col(i).between(low, high))
    kept = without_conflicts(valid.select(*keys, *items), keys, items)
    score = sum((F.col(i) for i in items[1:]), F.col(items[0]))
    ok = F.assert_true((score >= 0) & (score <= most), F.lit("a total is outside the scale"))
    return kept.withColumn("score", score).withColumn("_ok", ok).where("_ok IS NULL").drop("_ok")


def domain_rank(value: Column, order: Sequence[str]) -> Column:
    """Place of a value in an explicit order, from 0; null for other values."""
    place = F.array_position(F.array(*map(F.lit, order)), value)
    return F.when(place > 0, place - 1).cast("int")


def suffixed_join(a: DataFrame, b: DataFrame, keys: Sequence[str], suffixes: tuple[str, str] = ("_left", "_right")) -> DataFrame:
    """Left join by keys; columns of both sides get suffixes."""
    both = set(a.columns) & set(b.columns) - set(keys)
    x, y = (df.select(*[F.col(c).alias(c + end) if c in both else F.col(c) for c in df.columns]) for df, end in ((a, suffixes[0]), (b, suffixes[1])))
    return x.join(y, list(keys), "left")


def set_relations(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """shared, left_only, right_only: numbers of different keys."""
    sides = a.select(*keys).distinct().withColumn("_a", F.lit(1)).join(b.select(*keys).distinct().withColumn("_b", F.lit(1)), list(keys), "full")
    left, right = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    return sides.agg(F.count_if(left & right).alias("shared"), F.count_if(left & ~right).alias("left_only"), F.count_if(~left & right).alias("right_only"))


def frame_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """side and the rows that one side has more often than the other."""
    left, right = a.exceptAll(b), b.exceptAll(a)
    return left.select(F.lit("left").alias("side"), "*").unionByName(right.select(F.lit("right").alias("side"), "*"))


# Fixed values of the release rules: names of columns, endings of files, and folders and endings that a release leaves out.
FORBIDDEN = ("participant", "participant_id", "pid", "study_id", "uid", "user_id", "id", "email", "phone", "name", "date_of_birth", "device_id", "deviceid", "imei", "advertising_id", "latitude", "longitude", "lat", "lon", "gps", "address", "ip_address", "timestamp", "date", "time", "collected_at", "assessment_date", "birthdate")
FORBIDDEN_ENDINGS = ("_uid", "_userid", "_email", "_device_id", "_lat", "_lon", "_timestamp")
FORBIDDEN_FILES = (".parquet", ".feather", ".db", ".sqlite", ".xlsx", ".xls", ".pkl", ".joblib", ".zip", ".7z", ".rar")
TEXT_FILES = (".py", ".md", ".tex", ".json", ".txt", ".csv", ".cff")
LEFT_OUT_FOLDERS = (".git", "__pycache__", ".pytest_cache", ".venv")
LEFT_OUT_FILES = (".aux", ".bbl", ".blg", ".log", ".out")
#: Home folders of a user, and drives of a machine.
PRIVATE_PATH = r"(?:/home/|/Users/|[A-Za-z]:[\\/](?i:users)[\\/]|[A-Z]:\\)[^\s\"']+"


def _private(name: str) -> bool:
    name = name.strip().lower()
    return name in FORBIDDEN or name.endswith(FORBIDDEN_ENDINGS)


def private_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if _private(c)]


def private_paths(text: str) -> list[str]:
    """Absolute home or drive paths in a text."""
    return re.findall(PRIVATE_PATH, text)


def audit_table(df: DataFrame, name: str) -> DataFrame:
    """table, column, finding, n: columns whose names are private (n: rows that hold a value) and text columns that hold private paths (n: such rows).

    One pass over the columns concerned; the others are not read.
    """
    quoted = {c: F.col(f"`{c}`") for c in df.columns}
    wanted = [(c, "private column", F.count(quoted[c])) for c in private_columns(df)]
    wanted += [(c, "private path", F.count_if(quoted[c].rlike(PRIVATE_PATH))) for c, kind in df.dtypes if kind == "string"]
    if not wanted:
        return df.sparkSession.createDataFrame([], "table string, column string, finding string, n bigint")
    sums = df.agg(*[count.alias(f"_{i}") for i, (_, _, count) in enumerate(wanted)])
    cells = [F.struct(F.lit(name).alias("table"), F.lit(c).alias("column"), F.lit(finding).alias("finding"), F.col(f"_{i}").alias("n")) for i, (c, finding, _) in enumerate(wanted)]
    found = sums.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    return found.where("n > 0 OR finding = 'private column'")


def _ends(path: Column, endings: Sequence[str]) -> Column:
    return F.lower(path).rlike("(?:" + "|".join(re.escape(e) for e in endings) + ")$")


def audit_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, finding, detail: what must not leave with the files under a folder, a row a finding.

    'file type' by the file's ending, 'private path' for each different one in a text file, 'private column' for names in the first
    line of a .csv file.  Names of files come from their listing alone; text files are read line by line and in splits, so a large
    one is many tasks' work, and no file is ever whole in memory.  Folders and files that a release leaves out are left out.
    An empty file has no header; a header that goes on over a quoted line end counts up to there.
    """
    out = lambda path: ~path.rlike("(?:^|/)(?:" + "|".join(re.escape(f) for f in LEFT_OUT_FOLDERS) + ")/") & ~_ends(path, LEFT_OUT_FILES)
    deep = spark.read.option("recursiveFileLookup", "true")
    root = F.lit(re.sub("^file:/+", "/", folder).rstrip("/") + "/")
    inside = lambda path: F.element_at(F.split(F.regexp_replace(path, "^file:/+", "/"), F.concat(F.lit(r"\Q"), root, F.lit(r"\E")), 2), -1)
    names = deep.format("binaryFile").load(folder).select(inside(F.col("path")).alias("path"))  # only the listing
    types = names.where(out(F.col("path")) & _ends(F.col("path"), FORBIDDEN_FILES)).select("path", F.lit("file type").alias("finding"), F.regexp_extract(F.lower("path"), r"\.[^./]*$", 0).alias("detail"))
    # files are chosen by their paths before any is opened
    lines = deep.text(folder).where(_ends(F.col("_metadata.file_path"), TEXT_FILES))
    lines = lines.select(inside(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))).alias("path"), "value", F.col("_metadata.file_block_start").alias("start")).where(out(F.col("path")))
    paths = lines.select("path", F.explode(F.regexp_extract_all("value", F.lit(PRIVATE_PATH), 0)).alias("detail")).distinct()
    # the first line of the first split; lines of a split are numbered in order
    first = lines.where(_ends(F.col("path"), (".csv",)) & (F.col("start") == 0)).withColumn("line", F.monotonically_increasing_id()).groupBy("path").agg(F.min_by("value", "line").alias("value"))
    header = F.split(F.regexp_replace("value", "^\ufeff", ""), r',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    columns = first.select("path", F.explode(F.array_distinct(F.transform(header, lambda c: F.trim(F.regexp_replace(F.trim(c), r'^"|"$', ""))))).alias("detail"))
    low = F.lower("detail")
    columns = columns.where(low.isin(*FORBIDDEN) | _ends(low, FORBIDDEN_ENDINGS))
    return types.unionByName(paths.select("path", F.lit("private path").alias("finding"), "detail")).unionByName(columns.select("path", F.lit("private column").alias("finding"), "detail"))


def require_clean(findings: DataFrame) -> DataFrame:
    """The findings of audit_files; reading a row of them raises."""
    said = F.concat("finding", F.lit(" in "), "path", F.lit(": "), "detail")
    return findings.withColumn("finding", F.when(F.lit(True), F.raise_error(said).cast("string")))


def flow(rows: DataFrame, person: str, steps: dict[str, Column]) -> DataFrame:
    """step, name, rows, people, lost_rows, lost_people: what is left after each condition and all before it, in one pass.

    Rows are counted within persons first, so persons are counted without a copy of the rows for each step.
    """
    left, counts = F.lit(True), []
    for i, condition in enumerate(steps.values()):
        left = left & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(left).alias(f"_{i}"))
    n = len(counts)
    per = rows.groupBy(person).agg(*counts)
    whole = per.agg(*[F.coalesce(F.sum(f"_{i}"), F.lit(0)).alias(f"r{i}") for i in range(n)], *[F.count_if((F.col(f"_{i}") > 0) & F.col(person).isNotNull()).alias(f"p{i}") for i in range(n)])
    lost = lambda k, i: (F.col(f"{k}{i - 1}") - F.col(f"{k}{i}")) if i else F.lit(0).cast("long")
    cells = [F.struct(F.lit(i).alias("step"), F.lit(name).alias("name"), F.col(f"r{i}").alias("rows"), F.col(f"p{i}").alias("people"), lost("r", i).alias("lost_rows"), lost("p", i).alias("lost_people")) for i, name in enumerate(steps)]
    return whole.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def require_flow(ledger: DataFrame, expected: DataFrame) -> DataFrame:
    """The ledger; reading it raises if a step of expected (name, rows, people) is missing from it or has other counts."""
    wanted = expected.select("name", F.col("rows").alias("_rows"), F.col("people").alias("_people"))
    met = ledger.join(F.broadcast(wanted), "name", "full")  # a row a step
    bad = F.col("step").isNull() | (F.col("_rows").isNotNull() & ((F.col("_rows") != F.col("rows")) | (F.col("_people") != F.col("people"))))
    said = F.concat(F.lit("flow differs at "), F.col("name"), F.lit(": "), F.coalesce(F.col("rows").cast("string"), F.lit("no")), F.lit(" rows for "), F.col("_rows").cast("string"))
    return met.withColumn("step", F.when(bad, F.raise_error(said).cast("int")).otherwise(F.col("step"))).select(*ledger.columns)
