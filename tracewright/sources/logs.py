"""Log-shaped sources: line-delimited JSON sessions and prompts, Markdown plans.

A file is one row until its lines are numbered, so physical line numbers are exact; lines
that are no JSON object are dropped, and bad UTF-8 is replaced.  Ordering keys are path
segments, which compare as paths do.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions import text as tx
from tracewright.functions.scrub import scrub
from tracewright.functions.times import epoch_ms
from tracewright.operators.sequences import first_so_far, last_before, next_after_error

#: Caps of one session file: calls, edits, commands, error pairs, lines.
MOST_CALLS, MOST_EDITS, MOST_COMMANDS, MOST_PAIRS, MOST_LINES = 4000, 2000, 2000, 500, 60_000
EDIT_TOOLS = ["Edit", "Write", "MultiEdit", "NotebookEdit"]
PATH_KEYS = ["file_path", "path", "notebook_path", "filePath"]

#: Line ends of logs, and of Markdown (which has more of them).
LOG_LINES, TEXT_LINES = r"\r\n|\r|\n", r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"


def _missing(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def listing(spark: SparkSession, path: str, glob: str, recursive: bool = True) -> DataFrame:
    """file, mtime_ms, size of the files of a folder; contents aren't read."""
    if _missing(spark, path):
        return spark.createDataFrame([], "file string, mtime_ms bigint, size bigint")
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return found.select(F.col("path").alias("file"), F.unix_millis("modificationTime").alias("mtime_ms"), F.col("length").alias("size"))


def whole_files(spark: SparkSession, path: str, glob: str, recursive: bool = True, since_ms: int | None = None) -> DataFrame:
    """file, segments (ordering key), mtime_ms, size, text; F1: files older than the cutoff are left out."""
    if _missing(spark, path):
        return spark.createDataFrame([], "file string, segments array<string>, mtime_ms bigint, size bigint, text string")
    rows = spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=recursive)
    rows = rows.select(
        F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("file"),
        F.unix_millis("_metadata.file_modification_time").alias("mtime_ms"),
        F.col("_metadata.file_size").alias("size"),
        F.make_valid_utf8("value").alias("text"),
    )
    if since_ms is not None:
        rows = rows.where(F.col("mtime_ms") >= since_ms)
    return rows.select("file", F.split("file", "/").alias("segments"), "mtime_ms", "size", "text")


def json_lines(files: DataFrame) -> DataFrame:
    """(columns of files but text, ln, v) for every line that holds a JSON object."""
    kept = [c for c in files.columns if c != "text"]
    rows = files.select(*kept, F.posexplode(F.split("text", LOG_LINES)).alias("_pos", "_line"))
    rows = rows.where(F.trim("_line") != "").select(*kept, (F.col("_pos") + 1).alias("ln"), F.try_parse_json("_line").alias("v"))
    return rows.where(F.schema_of_variant("v").startswith("OBJECT"))


def _text(v: Column, path: str) -> Column:
    """A truthy value as text: '' for a missing, null, empty, false or zero one."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    value = F.try_variant_get(v, path, "string")
    return F.when(kind.isNull() | (kind == "VOID") | ((kind == "BOOLEAN") & (value == "false")) | ((kind == "BIGINT") & (value == "0")), "").otherwise(F.coalesce(value, F.lit("")))


def transcript_files(spark: SparkSession, root: str, since_ms: int | None = None) -> DataFrame:
    """Session files under projects/, nested ones too, with their project folder."""
    return with_project(whole_files(spark, f"{root}/projects", "*.jsonl", True, since_ms))


def with_project(files: DataFrame) -> DataFrame:
    """The folder below projects/ that a session file stands in."""
    return files.withColumn("project_dir", F.regexp_extract("file", r".*?/projects/([^/]+)", 1))


def session_records(files: DataFrame) -> DataFrame:
    """One row a JSON record, with what is known of the session by then.

    Records after the one in which the call cap was passed are left out, that one isn't.
    """
    rows = json_lines(files).where(F.col("ln") <= MOST_LINES)
    rows = rows.select(
        F.col("file").alias("session"),
        "segments",
        "project_dir",
        "ln",
        F.try_variant_get("v", "$.type", "string").alias("type"),
        F.try_variant_get("v", "$.message.content", "array<variant>").alias("content"),
        F.nullif(_text(F.col("v"), "$.cwd"), F.lit("")).alias("cwd"),
        F.nullif(_text(F.col("v"), "$.gitBranch"), F.lit("")).alias("git_branch"),
        F.nullif(_text(F.col("v"), "$.sessionId"), F.lit("")).alias("session_id"),
        epoch_ms(F.try_variant_get("v", "$.timestamp", "variant")).alias("ts"),
    )
    is_use = lambda b: F.coalesce(F.try_variant_get(b, "$.type", "string") == "tool_use", F.lit(False))
    calls = F.when((F.col("type") == "assistant") & F.col("content").isNotNull(), F.size(F.filter("content", is_use))).otherwise(0)
    earlier = F.coalesce(F.sum("_calls").over(Window.partitionBy("session").orderBy("ln").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_calls", calls).withColumn("_earlier", earlier).where(F.col("_earlier") <= MOST_CALLS)
    return rows.withColumn("cwd_by_then", first_so_far(F.col("cwd"), "session", order=("ln",))).drop("_calls", "_earlier")


def session_heads(records: DataFrame) -> DataFrame:
    """F8: one row a session: first cwd and branch, last session id (else the file's stem), time range, project."""
    by_line = lambda c, f: f(F.when(F.col(c).isNotNull(), F.struct("ln", c)))[c]
    heads = records.groupBy("session").agg(
        F.first("segments").alias("segments"),
        F.first("project_dir").alias("project_dir"),
        by_line("cwd", F.min).alias("cwd"),
        by_line("git_branch", F.min).alias("git_branch"),
        by_line("session_id", F.max).alias("session_id"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
    stem = F.regexp_replace(F.element_at("segments", -1), r"\.[^.]*$", "")
    return heads.withColumn("session_id", F.coalesce("session_id", stem)).withColumn("project", tx.project_slug(F.coalesce("cwd", "project_dir")))


def session_events(records: DataFrame) -> DataFrame:
    """Tool calls (kind 'use') and the first error of each user record (kind 'err', item = the tool that failed)."""
    blocks = records.where("type in ('assistant', 'user') and content is not null")
    blocks = blocks.select("session", "segments", "ln", "type", "cwd_by_then", F.posexplode("content").alias("pos", "b"))
    what = F.try_variant_get("b", "$.type", "string")
    failed = F.try_variant_get("b", "$.is_error", "variant")
    is_error = (F.schema_of_variant(failed) == "BOOLEAN") & F.try_variant_get("b", "$.is_error", "boolean")
    kind = F.when((F.col("type") == "assistant") & (what == "tool_use"), "use").when((F.col("type") == "user") & (what == "tool_result") & is_error, "err")
    name = F.when(F.try_variant_get("b", "$.name", "variant").isNull(), "?").otherwise(F.coalesce(F.try_variant_get("b", "$.name", "string"), F.lit("None")))
    rows = blocks.select("session", "segments", "ln", "pos", "cwd_by_then", kind.alias("kind"), name.alias("name"), _text(F.col("b"), "$.id").alias("use_id"), F.coalesce(F.try_variant_get("b", "$.tool_use_id", "string"), F.lit("")).alias("result_id"), F.try_variant_get("b", "$.input", "variant").alias("input"))
    rows = rows.where("kind is not null").withColumn("_first", F.row_number().over(Window.partitionBy("session", "ln", "kind").orderBy("pos"))).where("kind = 'use' or _first = 1")
    rows = rows.withColumn("tool_id", F.when(F.col("kind") == "use", F.nullif("use_id", F.lit(""))).otherwise(F.col("result_id")))
    asked = last_before(F.when(F.col("kind") == "use", F.col("name")), "session", "tool_id", order=("ln", "pos"))
    known = F.when(F.col("tool_id").isNotNull() & (F.col("tool_id") != ""), asked)
    item = F.when(F.col("kind") == "use", F.col("name")).otherwise(F.coalesce(known, F.lit("?")))
    return rows.select("session", "segments", "ln", "pos", "kind", item.alias("item"), "input", "cwd_by_then")


def _numbered(df: DataFrame, most: int, name: str = "ord") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy("session").orderBy("ln", "pos"))).where(F.col(name) <= most)


def calls(events: DataFrame) -> DataFrame:
    """The tool calls of a session, numbered."""
    return _numbered(events.where("kind = 'use'").select("session", "segments", "ln", "pos", "item"), MOST_CALLS)


def edits(events: DataFrame) -> DataFrame:
    """Edited paths, relative to the working folder known by then."""
    path = F.coalesce(*[F.nullif(_text(F.col("input"), f"$.{k}"), F.lit("")) for k in PATH_KEYS])
    rows = events.where((F.col("kind") == "use") & F.col("item").isin(EDIT_TOOLS)).withColumn("_path", path).where("_path is not null")
    return _numbered(rows.select("session", "segments", "ln", "pos", tx.repo_relative(F.col("_path"), F.col("cwd_by_then")).alias("path")), MOST_EDITS)


def commands(events: DataFrame) -> DataFrame:
    """Templates of shell commands."""
    rows = events.where("kind = 'use' and item = 'Bash'").withColumn("_c", _text(F.col("input"), "$.command")).where("_c <> ''")
    return _numbered(rows.select("session", "segments", "ln", "pos", tx.command_template(F.col("_c")).alias("template")), MOST_COMMANDS)


def error_fixes(events: DataFrame) -> DataFrame:
    """A failed tool and the call that followed."""
    return _numbered(next_after_error(events.select("session", "segments", "ln", "pos", "kind", "item"), order=("ln", "pos")), MOST_PAIRS)


def prompt_rows(lines: DataFrame, since_ms: int | None = None) -> tuple[DataFrame, DataFrame]:
    """S6 on JSON lines (ln, v): (prompts in the window, all records that have a prompt); NULL times pass the window (F2)."""
    rows = lines.where(F.try_variant_get("v", "$.display", "variant").isNotNull())
    rows = rows.select(F.col("ln").alias("ord"), epoch_ms(F.try_variant_get("v", "$.timestamp", "variant")).alias("ts"), tx.strip(F.coalesce(F.try_variant_get("v", "$.display", "string"), F.lit("None"))).alias("display"), _text(F.col("v"), "$.project").alias("project"))
    kept = rows if since_ms is None else rows.where(F.col("ts").isNull() | (F.col("ts") >= since_ms))
    kept = kept.where("display <> ''").withColumn("_clean", scrub(F.col("display")))
    kept = kept.select(
        "ord", "ts", "project", tx.project_slug(F.col("project")).alias("project_slug"), F.startswith("display", F.lit("/")).alias("is_slash"),
        tx.slash_command(F.col("display")).alias("slash"), tx.prompt_key(F.col("_clean")).alias("norm"), F.substring("_clean", 1, 200).alias("sample"),
    )
    return kept, rows


def prompts(spark: SparkSession, root: str, since_ms: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``prompt_rows`` of the prompt log of a folder."""
    return prompt_rows(json_lines(whole_files(spark, f"{root}/history.jsonl", "*", False)), since_ms)


def parse_plans(files: DataFrame) -> DataFrame:
    """Title, key, headings, step lines and words of Markdown documents (file, segments, text)."""
    lines = F.filter(F.split("text", TEXT_LINES), lambda x: F.lit(True))
    rows = files.withColumn("_lines", lines)
    at = F.array_position(F.transform("_lines", lambda x: x.rlike(tx.TITLE_LINE)), True)
    rows = rows.withColumn("_at", at)
    stem = F.regexp_replace(F.element_at("segments", -1), r"\.[^.]*$", "")
    title = F.when(F.col("_at") > 0, tx.strip(F.regexp_extract(F.element_at("_lines", F.greatest("_at", F.lit(1)).cast("int")), tx.TITLE_LINE, 1))).otherwise(stem)
    rest = F.filter("_lines", lambda x, i: i + 1 != F.col("_at"))
    rows = rows.withColumn("_title", title).withColumn("_rest", rest)
    headings = F.slice(F.transform(F.filter("_rest", lambda x: x.rlike(tx.HEADING_LINE)), lambda x: tx.strip(F.regexp_extract(x, tx.HEADING_LINE, 1))), 1, 30)
    return rows.select(
        "file", "segments", scrub(F.substring("_title", 1, 160)).alias("title"), tx.plan_key(F.col("_title")).alias("norm"),
        F.transform(headings, lambda h: scrub(F.substring(h, 1, 120))).alias("headings"), F.size(F.filter("_rest", lambda x: x.rlike(tx.STEP_LINE))).alias("n_steps"),
        F.regexp_count("text", F.lit(r"(?U)\S+")).alias("words"),
    )


def plans(spark: SparkSession, root: str, since_ms: int | None = None) -> DataFrame:
    """Plan documents in plans/, not in its subfolders."""
    files = whole_files(spark, f"{root}/plans", "*.md", False, since_ms)
    return parse_plans(files)


def read_json(path: str, default=None):
    """A whole JSON file on the driver, or the default if it is missing or invalid."""
    import json

    try:
        return json.loads(Path(path).read_text(encoding="utf-8", errors="replace"))
    except (OSError, ValueError):
        return default
