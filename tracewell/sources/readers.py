"""Readers of the workspace's files: every schema is given, and what can't be read is counted, not fatal."""

from __future__ import annotations

import os
import subprocess
import tomllib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import TextIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import split_message
from ..operators.etl import TRANSCRIPT
from ..workers import ship_package

COMMIT_CAP, SCAN_DEPTH = 50_000, 3
SKIPPED_DIRS = (".git", "node_modules", "target", "dist", "build", "venv", ".venv")

LEDGER = "ts string, tool string, result_token_estimate long, counterfactual_tokens_p50 long, counterfactual_tokens_p95 long, tokens_saved_p50 long, dollars_saved_p50_usd double, wall_ms long, counterfactual_wall_ms_p50 long, calibration_model_version string"
HOOK_LOG = "ts long, outcome string, term_len int, term string, scoped boolean, hits int, db string"
SCHEMA_COLUMN = "name:string,type:string,nullable:boolean,max_len:long,default:string"
SCHEMA_DUMP = f"database string, dialect string, generated_at long, objects array<struct<schema:string,name:string,type:string,columns:array<struct<{SCHEMA_COLUMN}>>,definition:string>>"

#: Catalog queries that make a schema dump, by dialect.
DUMP_QUERIES = {
    "postgres": "SELECT table_schema, table_name, column_name, data_type, is_nullable, character_maximum_length, column_default FROM information_schema.columns WHERE table_schema NOT IN ('pg_catalog', 'information_schema') ORDER BY 1, 2, ordinal_position",
    "sqlserver": "SELECT TABLE_SCHEMA, TABLE_NAME, COLUMN_NAME, DATA_TYPE, IS_NULLABLE, CHARACTER_MAXIMUM_LENGTH, COLUMN_DEFAULT FROM INFORMATION_SCHEMA.COLUMNS ORDER BY 1, 2, ORDINAL_POSITION",
}
ALIASES = {"pg": "postgres", "postgresql": "postgres", "mssql": "sqlserver"}


def dump_query(dialect: str) -> str:
    return DUMP_QUERIES[ALIASES.get(dialect.lower(), dialect.lower())]


def discover_repos(workspace: str, depth: int = SCAN_DEPTH, nested: bool = False) -> list[str]:
    """Folders with a .git folder, at most ``depth`` below the workspace, by depth and name; repositories inside others only if asked for."""
    found: list[str] = []
    for at, names, _ in os.walk(workspace):
        below = len(Path(at).relative_to(workspace).parts)
        if ".git" in names:
            found.append(at)
        names[:] = [] if below >= depth else sorted(n for n in names if n != ".git")
    found.sort(key=lambda p: (len(Path(p).parts), p))
    return found if nested else [p for p in found if not any(p.startswith(q + "/") for q in found)]


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The schema's columns, file, line (from 0) and corrupt for every line; a line that isn't JSON is kept as corrupt.

    A file is read whole, so that its lines are numbered the same in every run; one file is one session's.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    rows = whole.select("file", F.posexplode(F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n")).alias("line", "value")).withColumn("line", F.col("line").cast("long"))
    parsed = rows.filter(F.trim("value") != "").withColumn("r", F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    return parsed.select("file", "line", "r.*").withColumn("corrupt", F.col("_corrupt").isNotNull()).drop("_corrupt")


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Session transcripts, line by line in the order of each file."""
    return json_lines(spark, path, TRANSCRIPT)


def ledger_log(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, LEDGER)


def hook_log(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, HOOK_LOG)


def archived_calls(spark: SparkSession, path: str, call: str) -> DataFrame:
    """The calls of an export, one a row; call: their schema."""
    return spark.read.schema(f"calls array<struct<{call}>>").json(path, multiLine=True).select(F.explode("calls").alias("c")).select("c.*")


def schema_objects(spark: SparkSession, path: str) -> DataFrame:
    """Objects of schema dumps, with defaults for what a dump leaves out."""
    dumps = spark.read.schema(SCHEMA_DUMP).json(path, multiLine=True, recursiveFileLookup=True, pathGlobFilter="*.schema.json")
    each = dumps.select(F.coalesce("database", F.lit("")).alias("database_name"), F.explode("objects").alias("o"))
    empty = F.array().cast(f"array<struct<{SCHEMA_COLUMN}>>")
    return each.select("database_name", F.coalesce("o.schema", F.lit("public")).alias("schema_name"), F.col("o.name").alias("object_name"), F.coalesce("o.type", F.lit("table")).alias("object_type"), F.coalesce("o.columns", empty).alias("columns"), F.col("o.definition").alias("definition"))


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """path, text of the Markdown files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(path)
    return files.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("text")).filter("text IS NOT NULL")


def tree(spark: SparkSession, path: str) -> DataFrame:
    """path, content, length, mtime of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content", "length", F.unix_timestamp("modificationTime").alias("mtime"))


def commits(spark: SparkSession, repo: str, since: str | None = None, cap: int = COMMIT_CAP) -> DataFrame:
    """A repository's commits, all that HEAD descends from, newest first; after ``since`` if that is still an ancestor, all of them otherwise.

    Changed files are those against the first parent. ``position`` counts from HEAD in topological order;
    ``shallow`` says that the repository's history was cut off when it was fetched, ``capped`` that more
    than ``cap`` commits were there. A task reads the log itself, so the repository must be on a path
    that executors see; the log goes through no driver.
    """
    known = since is not None and _git(repo, "merge-base", "--is-ancestor", since, "HEAD").returncode == 0
    reach = [f"{since}..HEAD"] if known else ["HEAD"]
    shallow = _git(repo, "rev-parse", "--is-shallow-repository").stdout.strip() == "true"
    capped = int(_git(repo, "rev-list", "--count", *reach).stdout.strip() or 0) > cap
    ship_package(spark)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in batch["repo_path"]:
                yield from _log_pages(at, reach, cap)

    frame = spark.createDataFrame([(repo,)], "repo_path string").mapInPandas(read, COMMIT)
    summary, body = split_message(F.col("message"))
    return frame.select("*", summary.alias("message_summary"), body.alias("message_body"), F.lit(shallow).alias("shallow"), F.lit(capped).alias("capped")).drop("message")


COMMIT = "repo_path string, position long, commit_hash string, parent_hashes array<string>, author_email string, author_name string, authored_at long, committed_at long, message string, files_changed array<string>"


def _git(repo: str, *words: str) -> subprocess.CompletedProcess:
    return subprocess.run(["git", "-C", repo, *words], capture_output=True, text=True, errors="replace", check=False)


def _log_pages(repo: str, reach: list[str], cap: int, page: int = 2000) -> Iterator[pd.DataFrame]:
    """The log, ``page`` commits at a time, read as it is written."""
    form = "%x1e%H%x1f%P%x1f%ae%x1f%an%x1f%at%x1f%ct%x1f%B%x1f"
    words = ["git", "-C", repo, "log", f"--max-count={cap}", "--topo-order", "--root", "--diff-merges=first-parent", "--name-only", f"--format={form}", *reach]
    rows: list[tuple] = []
    position = 0
    with subprocess.Popen(words, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, errors="replace", encoding="utf-8") as run:
        for record in _records(run.stdout):
            digest, parents, email, name, authored, committed, message, files = record.split("\x1f")
            rows.append((repo, position, digest, parents.split(), email, name, int(authored), int(committed), message, [f for f in files.split("\n") if f]))
            position += 1
            if len(rows) == page:
                yield pd.DataFrame(rows, columns=COMMIT_COLUMNS)
                rows = []
    if rows:
        yield pd.DataFrame(rows, columns=COMMIT_COLUMNS)


COMMIT_COLUMNS = [field.split()[0] for field in COMMIT.split(", ")]


def _records(stream: TextIO) -> Iterator[str]:
    rest = ""
    while piece := stream.read(1 << 16):
        *whole, rest = (rest + piece).split("\x1e")
        yield from (r for r in whole if r)
    if rest:
        yield rest


def toml_rows(path: str, table: str) -> list[tuple[str, dict]]:
    """(name, values) of a TOML file's table; empty where the file or the table is missing."""
    try:
        data = tomllib.loads(Path(path).read_text())
    except (OSError, tomllib.TOMLDecodeError):
        return []
    return sorted((k, v) for k, v in data.get(table, {}).items() if isinstance(v, dict))


def domain_labels(spark: SparkSession, path: str) -> DataFrame:
    """entry, owner (null: withdrawn) of a TOML file with [domains.<name>] entries and a list of withdrawn ones."""
    rows = [(e, name) for name, v in toml_rows(path, "domains") for e in v.get("entries", [])]
    rows += [(e, None) for _, v in toml_rows(path, "domains") for e in v.get("withdrawn", [])]
    return spark.createDataFrame(rows, "entry string, owner string")


@dataclass(frozen=True)
class Calibration:
    """version, dollars a token, and a row (tool, p50, p95) for each tool of the model."""

    version: str
    rate: float
    tools: DataFrame
    missing: tuple[str, ...]


def calibration(spark: SparkSession, path: str, known: tuple[str, ...] = ()) -> Calibration | None:
    """A calibration model's TOML file; None where there is none, an error where it can't be parsed.

    ``missing`` lists the known tools that it lacks; they count as nothing saved.
    """
    try:
        text = Path(path).read_text()
    except OSError:
        return None
    data = tomllib.loads(text)
    tools = [(name, int(v.get("p50", 0)), int(v.get("p95", 0))) for name, v in sorted(data.get("tools", {}).items())]
    model = data.get("model", {})
    return Calibration(str(model.get("version", "")), float(model.get("dollars_per_token", 0.0)), spark.createDataFrame(tools, "tool string, p50 long, p95 long"), tuple(t for t in known if t not in data.get("tools", {})))


def live_files(folder: str, most_depth: int = 6, skipped: tuple[str, ...] = SKIPPED_DIRS) -> list[str]:
    """Folders below a workspace, by their path from it, none of the skipped ones or those with a leading dot."""
    found: list[str] = []
    for at, names, _ in os.walk(folder):
        names[:] = sorted(n for n in names if n not in skipped and not n.startswith("."))
        rel = Path(at).relative_to(folder)
        if rel.parts:
            found.append(rel.as_posix())
        if len(rel.parts) >= most_depth:
            names[:] = []
    return found
