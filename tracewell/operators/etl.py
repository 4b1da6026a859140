"""Extractors: texts, transcripts, diffs and dumps into rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import lines, relative_to, truncate_bytes

CHUNK_LINES, RATIONALE_BYTES, BLOCK_BYTES, FILE_BYTES = 50, 500, 64 << 10, 256 << 10


def chunks(df: DataFrame, text: str = "text", size: int = CHUNK_LINES) -> DataFrame:
    """df's columns with line_start, line_end and chunk for each window of ``size`` lines that isn't blank: no shuffle."""
    rows = df.withColumn("__lines", lines(F.col(text))).withColumn("__n", F.size("__lines"))
    windows = F.when(F.col("__n") > 0, F.transform(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / size).cast("int")), lambda k: F.struct((k * size + 1).alias("line_start"), F.least(k * size + size, F.col("__n")).alias("line_end"), F.array_join(F.slice("__lines", k * size + 1, F.lit(size)), "\n").alias("chunk"))))
    each = rows.withColumn("__w", F.explode(windows)).select(*df.columns, F.col("__w.line_start").cast("long").alias("line_start"), F.col("__w.line_end").cast("long").alias("line_end"), F.col("__w.chunk").alias("chunk"))
    return each.filter(F.col("chunk").rlike(r"\S"))


def sections_of(text: str | None) -> list[tuple[str, int, int, str]]:
    """(heading path, first line, last line, body) of a Markdown text's sections; a section holds its subsections."""
    rows = (text or "").split("\n")
    rows = [r.removesuffix("\r") for r in (rows[:-1] if rows and rows[-1] == "" else rows)]
    heads, fence = [], None
    for n, row in enumerate(rows, 1):
        mark = row.lstrip()[:3]
        if mark in ("```", "~~~"):
            fence = mark if fence is None else None if fence == mark else fence
        elif fence is None:
            level = len(row) - len(row.lstrip("#"))
            if 1 <= level <= 6 and row[level : level + 1] in (" ", "\t") and row[level:].strip():
                heads.append((n, level, row[level:].strip()))
    found = []
    first = heads[0][0] - 1 if heads else len(rows)
    if "\n".join(rows[:first]).strip():
        found.append(("", 1, first, "\n".join(rows[:first])))
    above: dict[int, str] = {}
    for k, (n, level, title) in enumerate(heads):
        above = {at: t for at, t in above.items() if at < level} | {level: title}
        end = next((m - 1 for m, other, _ in heads[k + 1 :] if other <= level), len(rows))
        found.append(("/".join(above[at] for at in sorted(above)), n, end, "\n".join(rows[n - 1 : end])))
    return found


#: Characters of text whose sections a task holds at once; one text has at most six times its own.
PIECE_CHARS = 1 << 20
SECTION = "array<struct<heading_path:string,line_start:long,line_end:long,body:string>>"


def sections(df: DataFrame, text: str = "text") -> DataFrame:
    """df's columns with heading_path, line_start, line_end and body for each Markdown section."""

    @F.pandas_udf(SECTION)
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("heading_path", "line_start", "line_end", "body")
        for texts in batches:
            begin, size = 0, 0
            for k, text in enumerate(texts, 1):
                size += len(text or "")
                if size >= PIECE_CHARS or k == len(texts):
                    yield texts.iloc[begin:k].map(lambda t: [dict(zip(names, s)) for s in sections_of(t)])
                    begin, size = k, 0

    return df.withColumn("__s", F.explode(cut(text))).select(*df.columns, "__s.*")


def front_matter(df: DataFrame, text: str = "text") -> DataFrame:
    """name, memory_type, description and body of notes that begin with front matter; others, and those without a name or type, are left out."""
    head = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)(?:\A|(?<=\n))---[ \t]*(?:\r?\n|\z)", 1)
    body = F.regexp_replace(F.regexp_extract(text, r"(?s)\A---\r?\n.*?(?<=\n)---[ \t]*(?:\r?\n(.*))?\z", 1), r"\A\r?\n", "")
    clean = lambda v: F.regexp_replace(F.trim(F.regexp_replace(v, r"\r", "")), r"""^(["'])(.*)\1$""", "$2")
    value = lambda key: F.nullif(clean(F.regexp_extract("__head", rf"(?m)^{key}:[ \t]*(.*)$", 1)), F.lit(""))
    nested = F.nullif(clean(F.regexp_extract("__head", r"(?m)^metadata:[ \t]*\r?\n(?:[ \t]+.*\n)*?[ \t]+type:[ \t]*(.*)$", 1)), F.lit(""))
    rows = df.withColumn("__head", head).filter(F.col(text).rlike(r"\A---\r?\n") & (F.col("__head") != ""))
    rows = rows.select(*df.columns, value("name").alias("name"), F.coalesce(nested, value("type")).alias("memory_type"), F.coalesce(value("description"), F.lit("")).alias("description"), body.alias("body"))
    return rows.filter("name IS NOT NULL AND memory_type IS NOT NULL")


def memory_body(description: Column, body: Column) -> Column:
    return F.when(description != "", F.concat(description, F.lit("\n\n"), body)).otherwise(body)


def session_history(df: DataFrame, text: str = "text") -> DataFrame:
    """session_number, entry_date, body, todos and decisions of the "Recent session history" part's bullets."""
    part = F.regexp_extract(text, r"(?ms)^## [^\n]*Recent session history[^\n]*\n(.*?)(?=^## |\z)", 1)
    bullets = F.regexp_extract_all(part, F.lit(r"(?ms)^- \*\*#\d+.*?(?=^- \*\*#\d|\z)"), F.lit(0))
    rows = df.select("*", F.explode(bullets).alias("body")).withColumn("body", F.rtrim("body"))
    todos = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("body", F.lit(r"TODO #(\d+)"), F.lit(1)), lambda t: t.cast("long"))))
    decisions = F.filter(F.array(*(F.when(F.lower("body").contains(w), w) for w in ("decided", "decision", "chose", "rejected"))), lambda w: w.isNotNull())
    return rows.select(F.regexp_extract("body", r"^- \*\*#(\d+)", 1).cast("long").alias("session_number"), F.nullif(F.regexp_extract("body", r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")).alias("entry_date"), "body", todos.alias("todos"), decisions.alias("decisions"))


def empty_extraction(df: DataFrame, text: str = "text") -> DataFrame:
    """Why a file gave no session: no_section, no_bullets or unreadable_bullets, with up to three examples."""
    section = F.col(text).rlike(r"(?m)^## .*Recent session history")
    seen = F.slice(F.regexp_extract_all(text, F.lit(r"(?m)^- .*$"), F.lit(0)), 1, 3)
    return df.withColumn("diagnosis", F.when(~section, "no_section").when(F.size(seen) == 0, "no_bullets").otherwise("unreadable_bullets")).withColumn("examples", seen)


TRANSCRIPT = (
    "type string, sessionId string, uuid string, cwd string, gitBranch string, timestamp string, "
    "message struct<id:string,content:array<struct<type:string,text:string,name:string,input:struct<file_path:string,path:string,notebook_path:string,command:string>>>>"
)


def session_edges(rows: DataFrame) -> DataFrame:
    """Edits of transcripts; rows: file, line, and TRANSCRIPT's columns.

    An edit's rationale is the last text that isn't blank before it, in its message or carried from
    earlier ones of the file as long as neither session nor folder changed. Ordinals count a message's
    edits. Edits without a time are left out (``edges_without_time`` counts them).
    """
    said = rows.filter("type = 'assistant'")
    here = F.struct(F.col("sessionId"), F.col("cwd"))
    in_file = W.partitionBy("file").orderBy("line")
    moved = ~here.eqNullSafe(F.lag(here).over(in_file)) & (F.row_number().over(in_file) > 1)
    epochs = said.withColumn("epoch", F.sum(moved.cast("int")).over(in_file.rowsBetween(W.unboundedPreceding, 0)))
    blocks = epochs.select("file", "line", "epoch", "sessionId", "uuid", "cwd", "gitBranch", "timestamp", F.posexplode("message.content").alias("pos", "b"))
    text = F.when((F.col("b.type") == "text") & F.col("b.text").rlike(r"\S"), F.trim("b.text"))
    so_far = W.partitionBy("file", "epoch").orderBy("line", "pos").rowsBetween(W.unboundedPreceding, 0)
    edits = blocks.withColumn("rationale", F.last(text, ignorenulls=True).over(so_far)).filter("b.type = 'tool_use' AND b.name IN ('Edit', 'Write') AND b.input.file_path IS NOT NULL")
    edited_at = F.unix_timestamp(F.try_to_timestamp("timestamp")).cast("long")
    edits = edits.withColumn("edited_at", edited_at).filter("edited_at IS NOT NULL AND coalesce(uuid, '') <> ''")
    ordinal = F.row_number().over(W.partitionBy("file", "line").orderBy("pos")) - 1
    path = F.when(F.col("cwd").isNotNull(), relative_to(F.col("b.input.file_path"), F.col("cwd"))).otherwise(F.col("b.input.file_path"))
    return edits.select(
        F.col("sessionId").alias("session_id"), F.col("uuid").alias("message_uuid"), ordinal.cast("long").alias("edge_ordinal"), F.col("b.name").alias("tool"), path.alias("file_path"),
        F.col("cwd").alias("repo_path"), F.col("gitBranch").alias("git_branch"), "edited_at", truncate_bytes(F.col("rationale"), RATIONALE_BYTES).alias("rationale"),
    )


def tool_class(name: Column, command: Column, product: str) -> Column:
    """own, retrieval or null for a tool call; a shell call is retrieval if a search leads one of its pipelines."""
    leads = lambda part: F.ltrim(F.regexp_replace(F.ltrim(F.substring_index(part, "|", 1)), r"^sudo ", "")).rlike(r"^(grep |rg |ripgrep|find |ack |ag )")
    shell = (name == "Bash") & F.exists(F.split(F.coalesce(command, F.lit("")), "[;&]"), leads)
    return F.when(F.lower(name).contains(product), "own").when(name.isin("Grep", "Glob") | shell, "retrieval")


def tool_path(tool_input: Column) -> Column:
    return F.coalesce(tool_input["file_path"], tool_input["path"], tool_input["notebook_path"])


def diff_blocks(rows: DataFrame) -> DataFrame:
    """Contiguous added blocks of ``git log -p --unified=0``; rows: repo, line_no, line; commits begin with "commit <hash>".

    Removed files and blank or oversized blocks are left out.
    """
    order = W.partitionBy("repo").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    line = F.col("line")
    kept = lambda pattern, name: F.last(F.when(line.rlike(pattern), F.regexp_extract(line, pattern, 1)), ignorenulls=True).over(order).alias(name)
    added = line.startswith("+") & ~line.startswith("+++")
    marked = rows.select("repo", "line_no", "line", added.alias("added"), kept(r"^commit ([0-9a-f]+)", "commit_hash"), kept(r"^\+\+\+ (?:b/)?(.*)$", "file_path"), kept(r"^@@ -\S+ \+(\d+)", "hunk"), F.sum(line.rlike(r"^(commit [0-9a-f]|\+\+\+ |@@ |-|[^+])").cast("int")).over(order).alias("block"), F.sum(line.rlike("^@@ ").cast("int")).over(order).alias("hunk_no"))
    in_hunk = W.partitionBy("repo", "hunk_no").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    numbered = marked.filter("added").withColumn("at", F.col("hunk").cast("long") + F.count(F.lit(1)).over(in_hunk) - 1)
    blocks = numbered.groupBy("repo", "commit_hash", "file_path", "hunk_no", "block").agg(F.min("at").alias("new_start"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: F.substring(x["line"], F.lit(2), F.length(x["line"]))), "\n").alias("added_body"))
    return blocks.filter((F.col("file_path") != "/dev/null") & F.col("added_body").rlike(r"\S") & (F.octet_length("added_body") <= BLOCK_BYTES)).select("repo", "commit_hash", "file_path", "new_start", "added_body")


def render_object(database: Column, schema: Column, name: Column, kind: Column, columns: Column, definition: Column) -> Column:
    """A database object as text; columns: array of name, type, nullable, max_len, default."""
    one = lambda c: F.concat(
        F.lit("\n  "), c["name"], F.lit(" "), c["type"], F.when(c["max_len"].isNotNull(), F.concat(F.lit("("), c["max_len"].cast("string"), F.lit(")"))).otherwise(""),
        F.when(c["nullable"], "").otherwise(" NOT NULL"), F.when(c["default"].isNotNull(), F.concat(F.lit(" DEFAULT "), c["default"])).otherwise(""),
    )
    head = F.concat(database, F.lit("."), schema, F.lit("."), name, F.lit(" ("), kind, F.lit(")"))
    return F.concat(head, F.array_join(F.transform(columns, one), ""), F.when(definition.isNotNull(), F.concat(F.lit("\ndefinition:\n"), definition)).otherwise(""))


def tables_of_sql(command: Column) -> Column:
    """At most two table names of a database client's command."""
    calls = command.rlike(r"(?i)\b(psql|sqlcmd|mysql|sqlite3)\b") & command.rlike(r"(?i)\b(select|insert|update|delete)\b")
    names = F.transform(F.regexp_extract_all(command, F.lit(r"(?i)\b(?:from|join|into|update)\s+([\w.\[\]\"]+)"), F.lit(1)), lambda t: F.regexp_replace(t, r'[\[\]"]', ""))
    names = F.filter(names, lambda t: ~t.rlike(r"(?i)^(select|information_schema|sys\.|pragma|[0-9])") & (t != ""))
    first = F.filter(names, lambda t, n: F.array_position(F.transform(names, F.lower), F.lower(t)) == n + 1)
    return F.when(calls, F.slice(first, 1, 2)).otherwise(F.array().cast("array<string>"))


def source_files(rows: DataFrame) -> DataFrame:
    """Readable source files; rows: path (in its repository), content (binary), length."""
    from ..functions.text import owned_by_other_corpus

    text = (F.col("length") <= FILE_BYTES) & ~F.col("content").contains(F.lit(b"\x00")) & F.is_valid_utf8(F.col("content").cast("string"))
    return rows.filter(text & ~owned_by_other_corpus(F.col("path")))


def last_touch(commits: DataFrame, parts: int | None = None) -> DataFrame:
    """repo, path, commit_hash, committed_at of the newest commit, merges aside, that changed each file; commits: repo, commit_hash, parents, committed_at, files.

    A commit's files may be dealt over several rows. ``parts``: into how many parts files are dealt, for inputs of a
    known size; each is sorted in one task. With a column ``position`` (0 at HEAD, in topological order) that decides, so that skewed clocks
    don't; without it the time does, then the hash.
    """
    order = F.struct((-F.col("position")).alias("position"), "commit_hash", "committed_at") if "position" in commits.columns else F.struct("committed_at", "commit_hash")
    each = commits.filter(F.size("parents") <= 1).select("repo", F.explode("files").alias("path"), order.alias("c"))
    each = each if parts is None else each.repartition(parts, "repo", "path")
    return each.groupBy("repo", "path").agg(F.max("c").alias("c")).select("repo", "path", "c.commit_hash", "c.committed_at")
