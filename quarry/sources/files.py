"""Line, JSONL and run-document sources.

All readers are lazy; paths become columns, so folder layouts are data and not code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from quarry.operators.constraints import duplicates, require_none
from quarry.storage import materialize

_CORRUPT = "_corrupt_record"


def lines(spark: SparkSession, path: str, comments: bool = False) -> DataFrame:
    """(line) of a text file, trimmed, without blank lines; with `comments` also without lines that begin with #."""
    line = F.regexp_replace("value", r"^\s+|\s+$", "")
    found = spark.read.text(path).select(line.alias("line")).filter("line <> ''")
    return found.filter(~F.col("line").startswith("#")) if comments else found


def json_lines(spark: SparkSession, path: str, schema: StructType, strict: bool = False) -> DataFrame:
    """Rows of JSONL files; a broken line is left out, or with `strict` fails the read."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    wide = StructType([*schema.fields]).add(_CORRUPT, StringType())
    rows = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _CORRUPT).json(path)
    return rows.filter(F.col(_CORRUPT).isNull()).drop(_CORRUPT)


def run_documents(spark: SparkSession, path: str, schema: StructType, names: str = "sample_*.json") -> DataFrame:
    """One row per run document at any depth below `path`, with its `file`, `source_run`, `round`, `system` and `prompt`.

    A document that cannot be parsed is left out.
    """
    wide = StructType([*schema.fields]).add(_CORRUPT, StringType())
    found = (
        spark.read.schema(wide)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", names)
        .option("columnNameOfCorruptRecord", _CORRUPT)
        .json(path)
        .select("*", F.col("_metadata.file_path").alias("file"))
    )
    file = F.col("file")
    return found.filter(F.col(_CORRUPT).isNull()).drop(_CORRUPT).withColumns(
        {"source_run": source_run(file), **{c: path_part(file, c) for c in ("round", "system", "prompt")}}
    )


#: A run document below a round: round_NN/system/prompt/file.
_PLACE = r"(?:^|/)round_(\d+)/([^/]+)/([^/]+)/[^/]+$"


def path_part(file: Column, part: str) -> Column:
    """The round (int), system or prompt that a path names; null outside that layout."""
    value = F.nullif(F.regexp_extract(file, _PLACE, ("round", "system", "prompt").index(part) + 1), F.lit(""))
    return value.cast("int") if part == "round" else value


def source_run(file: Column) -> Column:
    """system/prompt of a document below a round, else the name of its folder."""
    folder = F.regexp_extract(file, r"([^/]+)/[^/]+$", 1)
    return F.when(file.rlike(_PLACE), F.concat_ws("/", path_part(file, "system"), path_part(file, "prompt"))).otherwise(folder)


def attempts(runs: DataFrame, results: str = "results", steps: str = "attempts") -> DataFrame:
    """One row per attempt: the run's other columns, `result_pos`, `result`, `attempt_pos`, `attempt`, `is_last`.

    A result without attempts keeps one row with a null attempt, a run without results one
    with a null result; `is_last` marks the deciding attempt and is never null.
    """
    rest = [c for c in runs.columns if c != results]
    outer = runs.select(*rest, F.posexplode_outer(results).alias("result_pos", "__result"))
    inner = outer.select("*", F.posexplode_outer(f"__result.{steps}").alias("attempt_pos", "attempt"))
    is_last = F.coalesce(F.col("attempt_pos") == F.size(f"__result.{steps}") - 1, F.lit(False))
    return inner.select(
        *rest, "result_pos", F.col("__result").dropFields(steps).alias("result"), "attempt_pos", "attempt", is_last.alias("is_last")
    )


def shallowest(found: DataFrame, root: str, file: str = "file") -> DataFrame:
    """Of documents found at any depth below `root`, those at the least depth that has any.

    They are parsed once and written, as the depths are looked at before the documents.
    """
    depth = F.size(F.split(F.substring_index(F.col(file), root.rstrip("/") + "/", -1), "/"))
    deep = materialize(found.withColumn("__depth", depth), "found")
    return deep.join(deep.agg(F.min("__depth").alias("__least")), F.col("__depth") == F.col("__least"), "left_semi").drop("__depth")


def harvest(runs: DataFrame, name: str = r"sample_\d+\.json$") -> DataFrame:
    """The last attempt of each result that ended FAILED_FOUND, of run documents with a strict file name."""
    steps = attempts(runs.filter(F.col("file").rlike(name)))
    return steps.filter((F.col("result.final_status") == "FAILED_FOUND") & F.col("attempt").isNotNull() & F.col("is_last"))


def run_samples(index: DataFrame, results: DataFrame, compares: DataFrame) -> DataFrame:
    """Rows of a run's index with the first result of their file and its comparison; null where a file is missing or cannot be read.

    `results` is (file, results), `compares` (file, compare), whose file ends in .compare.json.
    """
    first = results.select("file", F.get("results", F.lit(0)).alias("result"))
    compared = compares.select(F.regexp_replace("file", r"\.compare\.json$", ".json").alias("file"), "compare")
    return index.join(first, "file", "left").join(compared, "file", "left")


def seeds(spark: SparkSession, path: str, column: str = "question") -> DataFrame:
    """(seed) of a text file by lines, a JSON list of texts that may hold line ends, or a Parquet dataset's column; blank ones left out.

    The kind is the path's ending: .txt, .json, or anything else for a dataset.
    """
    if path.endswith(".txt"):
        return lines(spark, path).withColumnRenamed("line", "seed")
    if path.endswith(".json"):
        whole = spark.read.text(path, wholetext=True)
        found = whole.select(F.explode(F.from_json("value", "array<string>")).alias("seed"))
    else:
        found = spark.read.parquet(path).select(F.col(column).alias("seed"))
    return found.filter(F.trim(F.coalesce("seed", F.lit(""))) != "")


#: A fixed value: what a system may be called, as its name is part of paths.
SAFE_NAME = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"


def systems(spark: SparkSession, path: str, timeout: float, concurrency: int) -> DataFrame:
    """Systems (name, profile, server_url, timeout, concurrency, share, kind, model, allowed_domains) of a JSON list, defaults filled in.

    A name that is missing, repeated or no safe file name, and a share outside 0 to 1, is an error that says which.
    """
    schema = "name string, profile string, server_url string, timeout double, concurrency int, share double, kind string, model string, allowed_domains array<string>"
    found = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    filled = found.na.fill({"timeout": timeout, "concurrency": concurrency}).withColumn("kind", F.coalesce("kind", F.lit("server")))
    require_none(filled.filter(~F.coalesce(F.col("name").rlike(SAFE_NAME), F.lit(False))).select("name"), "no safe name")
    require_none(filled.filter("share < 0 OR share > 1").select("name", "share"), "share outside 0 to 1")
    require_none(duplicates(filled, "name"), "repeated name")
    return filled


def worked_examples(spark: SparkSession, path: str, fields: tuple[str, ...]) -> DataFrame:
    """Worked examples of a JSON list of objects in the list's order, all `fields` texts that must not be blank."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.posexplode(F.from_json("value", f"array<struct<{','.join(f'{f}:string' for f in fields)}>>", {"mode": "FAILFAST"})).alias("ord", "e")).select("ord", "e.*")
    blank = F.greatest(*[(F.trim(F.coalesce(f, F.lit(""))) == "") for f in fields])
    require_none(rows.filter(blank).select("ord"), "example with a blank field")
    return rows
