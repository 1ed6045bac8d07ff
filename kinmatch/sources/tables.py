"""Reading and writing tables and sets of tables."""

from __future__ import annotations

import json
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Names that mark result tables.
DEFAULT_EXCLUDED = ("results_", "Unmatched_")


# A null is an empty field without quotes, an empty text is one in quotes.
_NOT_A_FIELD = "\x00"


def read_table(spark: SparkSession, path: str, fmt: str | None = None, multi_line: bool = True, ragged: str = "raise") -> DataFrame:
    """Read a CSV or Parquet table.

    CSV columns all come as strings: inference would drop leading zeros of ZIPs.
    Quotes are doubled inside quotes.  Values may hold line breaks, which keeps
    Spark from splitting a file; ``multi_line=False`` lets it split large files
    and takes rows that a quoted line break has torn for ragged ones.

    A row with more or fewer fields than the header is an error when it is read.  ``ragged="mark"`` returns
    such rows as well, with their text in the column ``_ragged``, which is null for all others: see :func:`split_ragged`.
    """
    if ragged not in ("raise", "mark"):
        raise ValueError(f"Neither raise nor mark: {ragged}")
    fmt = fmt or ("csv" if path.rstrip("/").lower().endswith(".csv") else "parquet")
    if fmt != "csv":
        return spark.read.format(fmt).load(path)
    # Fields are counted only if all of them are read.
    options = {"header": True, "encoding": "UTF-8", "escape": '"', "nullValue": _NOT_A_FIELD, "multiLine": multi_line, "columnPruning": False}
    if ragged == "raise":
        return spark.read.options(**options, mode="FAILFAST").csv(path)
    columns = spark.read.options(**options).csv(path).schema
    names = [f"`{c}`" for c in columns.names]
    marked = spark.read.options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord="_torn").schema(columns.add("_torn", "string")).csv(path)
    # The second part is always null; Spark reads no file for the sake of that column alone.
    return marked.selectExpr(*names, f"coalesce(_torn, nullif({names[0]}, {names[0]})) AS {RAGGED}")


#: The column that holds the text of ragged rows.
RAGGED = "_ragged"


def split_ragged(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with as many fields as the header, texts of the others) of a table read with ``ragged="mark"``."""
    kept = [f"`{c}`" for c in marked.columns if c != RAGGED]
    return marked.where(f"{RAGGED} IS NULL").selectExpr(*kept), marked.where(f"{RAGGED} IS NOT NULL").select(RAGGED)


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Number the rows of a table read from files by their position, from 0.

    Positions come from the file and block every row was read from, so the
    numbers do not depend on how Spark orders its input splits.  Call it right
    after reading, before any shuffle.
    """
    placed = df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_seq"),
    )
    # One row per file block: as many as there are input splits, not as there are rows.
    blocks = placed.groupBy("_file", "_start").agg(F.min("_seq").alias("_first"), F.count("*").alias("_rows"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    number = F.col("_before") + F.col("_seq") - F.col("_first")
    kept = [F.col(f"`{c}`") for c in df.columns]
    return placed.join(offsets, ["_file", "_start"]).select(number.alias(name), *kept)


def _folder(spark: SparkSession, path: str):
    """The file system of a path, and the path in it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _list_tables(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """(table name, path) of every table directly under ``root``, by name."""
    fs, folder = _folder(spark, root)
    found = []
    for status in fs.listStatus(folder):
        file = status.getPath().getName()
        if not file.startswith(("_", ".")):
            stem, _, ending = file.rpartition(".")
            name = stem if ending.lower() in ("csv", "parquet") else file
            found.append((name, status.getPath().toString()))
    return sorted(found)


def read_table_set(
    spark: SparkSession, root: str, exclude_prefixes=DEFAULT_EXCLUDED, exclude=(), only_prefix: str | None = None
) -> dict[str, DataFrame]:
    """Read all tables under a directory, except those whose names are filtered out."""
    tables = {}
    for name, path in _list_tables(spark, root):
        if only_prefix is not None:
            wanted = name.startswith(only_prefix)
        else:
            wanted = not name.startswith(tuple(exclude_prefixes)) and name not in exclude
        if wanted:
            tables[name] = read_table(spark, path)
    return tables


def _first_two(tables: dict[str, DataFrame]) -> list[tuple[str, DataFrame]]:
    if len(tables) < 2:
        raise ValueError("Need at least two data tables")
    return list(tables.items())[:2]


def choose_roles(tables: dict[str, DataFrame], master: str | None = None) -> tuple[str, str]:
    """Names of (input, master): the strictly larger of the first two is the master, else the second."""
    (first, first_df), (second, second_df) = _first_two(tables)
    if master is None:
        master = first if first_df.count() > second_df.count() else second
    if master not in (first, second):
        raise ValueError(f"Not one of the first two tables: {master}")
    return (second if master == first else first), master


def _in_score_order(results: DataFrame) -> DataFrame:
    """Order inside every file: by match type, best scores first."""
    return results.sortWithinPartitions("match_type", F.desc("match_score"), "a_row", "b_row")


# Results are written to a folder of their own.  A manifest, published last under the next number, says which folder
# holds which match type, so readers see all of a run or nothing of it.
_MANIFEST = "_manifest-"


def _manifests(spark: SparkSession, root: str) -> list[str]:
    """Names of the manifests under ``root``, the oldest first."""
    fs, folder = _folder(spark, root)
    if not fs.exists(folder):
        return []
    return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(folder)) if n.startswith(_MANIFEST))


def read_manifest(spark: SparkSession, root: str, name: str | None = None) -> dict[str, dict]:
    """Per match type: ``rows`` and the ``folder`` under ``root`` that holds them; of the last run, or as ``name`` says."""
    names = _manifests(spark, root)
    if not names:
        return {}
    fs, folder = _folder(spark, root)
    stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(folder, name or names[-1]))
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _publish(spark: SparkSession, root: str, manifest: dict[str, dict]) -> None:
    fs, folder = _folder(spark, root)
    names = _manifests(spark, root)
    number = int(names[-1].removeprefix(_MANIFEST)) + 1 if names else 1
    draft, final = (spark._jvm.org.apache.hadoop.fs.Path(folder, n) for n in (f"_draft-{uuid.uuid4().hex}", f"{_MANIFEST}{number:010d}"))
    out = fs.create(draft)
    out.write(json.dumps(manifest).encode())
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise RuntimeError(f"Results under {root} were written by another run at the same time")


def _drop_unused(spark: SparkSession, root: str) -> None:
    """Delete what neither the last manifest nor the one before it names, as readers may still follow that one."""
    fs, folder = _folder(spark, root)
    names = _manifests(spark, root)
    used = {e["folder"] for n in names[-2:] for e in read_manifest(spark, root, n).values()}
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if (name.startswith("run-") and name not in used) or name in names[:-2]:
            fs.delete(status.getPath(), True)


def write_results(results: DataFrame, root: str, types=()) -> str:
    """Write match results, each type's in place of earlier ones of its type; :func:`read_results` reads them.

    Other types' results stay.  ``types`` names the types that were run: earlier
    results of those that found nothing this time go as well.  A run that ends half-way leaves the
    earlier results as they were.
    """
    spark, name = results.sparkSession, f"run-{uuid.uuid4().hex}"
    _in_score_order(results).write.partitionBy("match_type").parquet(f"{root}/{name}")
    # One row per match type, counted in the files' footers.
    written = _read_partitions(spark, f"{root}/{name}").groupBy("match_type").count().collect()
    manifest = read_manifest(spark, root)
    manifest |= {t: {"folder": None, "rows": 0} for t in types}
    manifest |= {r["match_type"]: {"folder": name, "rows": r["count"]} for r in written}
    _publish(spark, root, manifest)
    _drop_unused(spark, root)
    return root


def write_run(tables: dict[str, DataFrame], results: DataFrame, root: str, run_id: str | None = None, unmatched: DataFrame | None = None) -> str:
    """Write copies of the source tables, the results of one run and, if given, its unmatched rows to a new directory.

    Nothing that exists is replaced.  A match type without results leaves no partition.
    """
    run = f"{root}/run_id={run_id or datetime.now().strftime('%Y%m%d_%H%M%S')}"
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{run}/{name}")
    if unmatched is not None:
        unmatched.write.mode("errorifexists").parquet(f"{run}/Unmatched_Rows")
    _in_score_order(results).write.mode("errorifexists").partitionBy("match_type").parquet(f"{run}/results")
    return run


# Columns of results, for a run that found nothing.
RESULT_SCHEMA = (
    "match_score double, a_row long, b_row long, name_a string, name_b string, address_a string, address_b string, match_type string"
)


def _read_partitions(spark: SparkSession, path: str) -> DataFrame:
    """Results in partitions by match type, whose names are texts whatever they look like."""
    fs, folder = _folder(spark, path)
    if not any(s.getPath().getName().startswith("match_type=") for s in fs.listStatus(folder)):
        return spark.createDataFrame([], RESULT_SCHEMA)
    found = spark.read.parquet(path)
    types = StructType([StructField(f.name, StringType() if f.name == "match_type" else f.dataType) for f in found.schema])
    return spark.read.schema(types).parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Results as last written, of a run or of ``write_results``; without any, an empty table of their columns."""
    if not _manifests(spark, path):
        return _read_partitions(spark, path)
    found, manifest = None, read_manifest(spark, path)
    for folder in sorted({e["folder"] for e in manifest.values() if e["folder"]}):
        mine = [t for t, e in manifest.items() if e["folder"] == folder]
        part = _read_partitions(spark, f"{path}/{folder}").where(F.col("match_type").isin(mine))
        found = part if found is None else found.unionByName(part, allowMissingColumns=True)
    return spark.createDataFrame([], RESULT_SCHEMA) if found is None else found


def export_csv(df: DataFrame, path: str) -> str:
    """Write a table as CSV with a header line; ``read_table`` reads back the same values."""
    exact = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(**exact).csv(path)
    return path


def export_first_two(tables: dict[str, DataFrame], root: str, names=("data1", "data2")) -> list[str]:
    """Export the first two data tables as CSV; fails if there are fewer."""
    return [export_csv(df, f"{root}/{name}") for name, (_, df) in zip(names, _first_two(tables))]


def profile_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Per table and column: position, type, and the table's row count."""
    frames = []
    for name, df in tables.items():
        columns = F.array(
            *(
                F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("type"))
                for i, f in enumerate(df.schema)
            )
        )
        counted = df.agg(F.count("*").alias("row_count"))
        frames.append(counted.select(F.lit(name).alias("table_name"), "row_count", F.inline(columns)))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def head(df: DataFrame, n: int = 5, row_id: str = "row_id") -> DataFrame:
    """The first ``n`` rows by row number."""
    return df.orderBy(row_id).limit(n)
