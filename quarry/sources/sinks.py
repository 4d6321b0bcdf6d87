"""Sinks: files that are never overwritten, append-only logs, and splits by decision."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quarry.operators.dedup import latest_wins


def write_once(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Write to a path that must not exist yet."""
    df.write.mode("errorifexists").format(form).save(path)


def append_lines(df: DataFrame, path: str) -> None:
    """Append rows to a JSONL log; what earlier writes committed stays as it is."""
    df.write.mode("append").json(path)


def compact(log: DataFrame, keys: list[str], is_error: Column, order: Column, path: str) -> None:
    """The log's latest row of each key, a success before any error, at a new path."""
    write_once(latest_wins(log, keys, is_error, order), path, "json")


def write_split(df: DataFrame, decision: str, path: str) -> None:
    """All rows in one pass, one folder for each value of `decision`."""
    df.write.mode("errorifexists").partitionBy(decision).parquet(path)


def _file_system(spark: SparkSession, path: str):  # noqa: ANN202
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _file_system(spark, path)
    return fs.exists(target)


def _move(spark: SparkSession, source: str, target: str) -> None:
    fs, to = _file_system(spark, target)
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(source), to):
        raise OSError(f"{source} could not be renamed to {target}")


def write_document(spark: SparkSession, text: str, path: str) -> None:
    """A small document at `path`, whole or not at all: written aside, then renamed over what is there."""
    aside = f"{path}.{uuid.uuid4().hex}.tmp"
    fs, target = _file_system(spark, aside)
    out = fs.create(target)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    # FileContext can rename over a file, which FileSystem.rename cannot everywhere.
    jvm = spark._jvm.org.apache.hadoop.fs
    context = jvm.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else jvm.Path(f"file://{aside}").toUri(), spark._jsc.hadoopConfiguration())
    how = spark._sc._gateway.new_array(jvm.Options.Rename, 1)
    how[0] = jvm.Options.Rename.OVERWRITE
    context.rename(target, jvm.Path(path), how)


def read_document(spark: SparkSession, path: str) -> str | None:
    """The text of a document, None where there is none."""
    if not exists(spark, path):
        return None
    return spark.read.text(path, wholetext=True).first()[0]


def digest(rows: DataFrame) -> Column:
    """An aggregate that tells tables of other rows apart, whatever their order: counts and sums of 64-bit hashes."""
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return F.struct(F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor(F.xxhash64(whole)), F.lit(0)).alias("xor"), F.coalesce(F.sum(F.xxhash64(F.lit(1), whole).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum"))


def publish(tables: dict[str, DataFrame], target: str, sources: tuple[str, ...] = (), form: str = "parquet") -> dict:
    """Write a folder of tables at a new path, whole or not at all, and return its manifest.

    The tables are written aside with a manifest, read back and compared by count and hashes,
    and the folder is renamed last, so a crash leaves no target.  An existing target, or one
    inside a source, is refused.
    """
    spark = next(iter(tables.values())).sparkSession
    target = target.rstrip("/")
    if exists(spark, target):
        raise FileExistsError(target)
    inside = [s for s in sources if f"{target}/".startswith(f"{s.rstrip('/')}/")]
    if inside:
        raise ValueError(f"{target} lies inside its source {inside[0]}")
    aside, manifest = f"{target}.building-{uuid.uuid4().hex}", {}
    for name, rows in tables.items():
        seen = Observation()
        rows.observe(seen, digest(rows).alias("digest")).write.format(form).save(f"{aside}/{name}")
        back = spark.read.schema(rows.schema).format(form).load(f"{aside}/{name}")
        told, found = (x.asDict() for x in (seen.get["digest"], back.agg(digest(back).alias("d")).first().d))
        if told != found:
            raise OSError(f"{name}: wrote {told}, read {found}")
        manifest[name] = found
    write_document(spark, json.dumps(manifest, sort_keys=True), f"{aside}/manifest.json")
    _move(spark, aside, target)
    return manifest


def replace_split(rows: DataFrame, root: str, split: str, order: str, columns: list[str]) -> None:
    """Replace one split of a dataset by `columns` of `rows` in `order`, absent columns null; other splits stay.

    The new split is written aside and the old one kept under another name until the new one
    has its place, so `read_split` finds one of them at any time.
    """
    spark = rows.sparkSession
    place, old, aside = (f"{root.rstrip('/')}/{split}{end}" for end in ("", ".old", f".new-{uuid.uuid4().hex}"))
    chosen = rows.select(order, *[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns if c != order])
    chosen.orderBy(order).select(*columns).write.parquet(aside)
    if exists(spark, place):
        fs, gone = _file_system(spark, old)
        fs.delete(gone, True)
        _move(spark, place, old)
    _move(spark, aside, place)
    fs, gone = _file_system(spark, old)
    fs.delete(gone, True)


def read_split(spark: SparkSession, root: str, split: str, schema: str) -> DataFrame:
    """A split's rows; of the one before while it is being replaced, and none where there is no such split."""
    for end in ("", ".old"):
        if exists(spark, f"{root.rstrip('/')}/{split}{end}/_SUCCESS"):
            return spark.read.schema(schema).parquet(f"{root.rstrip('/')}/{split}{end}")
    return spark.createDataFrame([], schema)


def append_kinds(rows: DataFrame, path: str, run_id: str) -> None:
    """Append records of several kinds to one log, a folder a kind, each with the run and the time of its write where it has none."""
    filled = rows
    for name, value in (("run_id", F.lit(run_id)), ("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))):
        filled = filled.withColumn(name, F.coalesce(F.col(name), value) if name in rows.columns else value)
    filled.write.mode("append").partitionBy("kind").json(path)


def write_menu(items: DataFrame, order: str, text: str, header: str, path: str) -> None:
    """A menu as a text file under a commented header, a line each in `order`, whole or not at all; a menu is small."""
    rows = items.orderBy(order).select(F.regexp_replace(text, r"\s+", " ").alias("line"))
    lines = [f"# {header}", *(r.line for r in rows.toLocalIterator())]
    write_document(items.sparkSession, "\n".join(lines) + "\n", path)
