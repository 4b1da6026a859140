"""What belongs to a workspace and to one of its domains: scope, routing of edits, coverage, triage."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name, normalize_path, parent_dir, path_prefixes, slug, under
from ..sources.readers import live_files
from .joins import ratchet, visible

WITHHELD = "[withheld]"
#: Folders for temporary files, and build folders that are never reported.
TEMPORARY = ("/tmp", "/private/tmp", "/var/folders")
NEVER_REPORTED = (".git", "node_modules", "target", "dist", "build", "vendor")
SEVERITIES = ("error", "warn", "info")


def _below(path: Column, root: str) -> Column:
    return under(normalize_path(path), F.lit(root))


def in_workspace(path: Column, workspace: str) -> Column:
    """Whether an absolute path lies in the workspace once its dots are resolved; unknown paths don't."""
    return F.coalesce(path.startswith("/") & _below(path, workspace), F.lit(False))


def is_neutral(path: Column, workspace: str, notes: str) -> Column:
    """Places that are nobody's domain: files right in the workspace, its notes' folder, its own temporary files."""
    norm, own = normalize_path(path), base_name(F.lit(notes))
    temporary = F.lit(False)
    for root in TEMPORARY:
        temporary = temporary | (_below(path, root) & F.array_contains(F.split(norm, "/"), own)) | (parent_dir(norm) == root)
    return F.coalesce(path.startswith("/") & ((parent_dir(norm) == workspace) | _below(path, notes) | temporary), F.lit(False))


def in_scope(edges: DataFrame, workspace: str, projects: str) -> DataFrame:
    """The edges (cwd, file_path) of sessions in the workspace whose target is in it, is neutral, or is their own notes' folder.

    projects: the folder whose children are named by the slug of a session's folder.
    """
    notes = f"{projects}/{workspace.translate(str.maketrans('/_.', '---'))}"
    own = F.concat(F.lit(projects + "/"), slug(F.col("cwd")))
    target = in_workspace(F.col("file_path"), workspace) | is_neutral(F.col("file_path"), workspace, notes) | F.coalesce(under(normalize_path(F.col("file_path")), own), F.lit(False))
    return edges.filter(in_workspace(F.col("cwd"), workspace) & target)


def routed(edges: DataFrame, labels: DataFrame, domain: str, workspace: str, notes: str) -> DataFrame:
    """What of the edges a domain's index may hold; edges: session_id, group_id, ord, file_path, cwd, repo_path, git_branch, rationale.

    An edge whose file the domain doesn't see is left out. Where it doesn't see the session's folder, the
    repository and branch go. A rationale is withheld from the first group of a session on that touched
    a file that the domain doesn't see and that isn't neutral: what a session has read can't be unread.
    """
    seen = edges.select(F.col("file_path").alias("path")).union(edges.select(F.col("cwd").alias("path"))).filter("path IS NOT NULL").distinct()
    said = visible(seen, labels, domain).select("path", "admitted")
    by = lambda column, name: said.select(F.col("path").alias(column), F.col("admitted").alias(name))
    marked = edges.join(by("file_path", "__file"), "file_path", "left").join(by("cwd", "__cwd"), "cwd", "left")
    tainted = ~F.coalesce("__file", F.lit(False)) & ~is_neutral(F.col("file_path"), workspace, notes)
    judged = ratchet(marked.withColumn("__tainted", tainted), ["session_id"], "group_id", ["ord"], "__tainted")
    kept, home = judged.filter(F.coalesce("__file", F.lit(False))), F.coalesce("__cwd", F.lit(False))
    swap = {"repo_path": F.when(home, F.col("repo_path")), "git_branch": F.when(home, F.col("git_branch")), "rationale": F.when(F.col("withheld"), F.lit(WITHHELD)).otherwise(F.col("rationale"))}
    return kept.select(*(swap[c].alias(c) if c in swap else F.col(c) for c in edges.columns), "withheld")


def routing_counts(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """edges, dropped_foreign, withheld."""
    after = kept.agg(F.count(F.lit(1)).alias("kept"), F.count_if("withheld").alias("withheld"))
    return edges.agg(F.count(F.lit(1)).alias("edges")).join(F.broadcast(after)).select("edges", (F.col("edges") - F.col("kept")).alias("dropped_foreign"), "withheld")  # one row each


def unassigned(folders: DataFrame, labels: DataFrame, acknowledged: tuple[str, ...] = (), depth: int = 6) -> DataFrame:
    """path of the topmost folders that no domain admits and nobody has acknowledged; folders: path, from the workspace.

    What lies below a reported folder isn't reported again; a folder is looked into only if all above it
    are admitted.
    """
    parts = F.split("path", "/")
    wanted = folders.filter((F.size(parts) <= depth) & ~F.exists(parts, lambda p: p.startswith(".") | p.isin(*NEVER_REPORTED)))
    each = wanted.select(F.col("path").alias("__p")).distinct().select("__p", F.posexplode(path_prefixes(F.col("__p"))).alias("__depth", "entry"))
    hits = each.join(labels, "entry").groupBy("__p").agg(F.max(F.struct("__depth", F.col("owner").isNull().alias("out"))).alias("__deepest"))
    admitted = wanted.join(hits, wanted["path"] == hits["__p"], "left").select("path", F.coalesce(~F.col("__deepest.out"), F.lit(False)).alias("ok"))
    closed = admitted.filter("NOT ok").select("path")
    above = closed.select(F.col("path").alias("__child"), F.explode(path_prefixes(F.col("path"))).alias("path")).filter("path <> __child")
    nested = above.join(closed, "path", "left_semi").select(F.col("__child").alias("path")).distinct()
    return closed.join(nested, "path", "left_anti").filter(~F.col("path").isin(*acknowledged)) if acknowledged else closed.join(nested, "path", "left_anti")


def audit(labelled: DataFrame, unassigned_paths: DataFrame, undecided: DataFrame, content: DataFrame, indexed: DataFrame) -> DataFrame:
    """severity (0 error, 1 warn, 2 info), kind, path: what keeps files out of a domain's index, the worst first.

    labelled: path, exists, is_dir, is_repo of the domain's folders; content: path, in_domain of the files
    that should be indexed; indexed: path.
    """
    kind = F.when(~F.col("exists"), "label-missing").when(~F.col("is_dir"), "label-is-a-file").when(~F.col("is_repo"), "label-not-a-repo")
    of_labels = labelled.withColumn("kind", kind).filter("kind IS NOT NULL").select(F.when(F.col("kind") == "label-not-a-repo", 1).otherwise(0).alias("severity"), "kind", "path")
    of_folders = unassigned_paths.join(undecided, "path", "left_anti").select(F.lit(2).alias("severity"), F.lit("subdir-unassigned").alias("kind"), "path")
    of_staged = undecided.select(F.lit(2).alias("severity"), F.lit("subdir-undecided").alias("kind"), "path")
    lost = content.join(indexed.select("path").distinct(), "path", "left_anti")
    of_files = lost.select(F.when(F.col("in_domain"), 1).otherwise(2).alias("severity"), F.when(F.col("in_domain"), "file-unindexed").otherwise("root-file-unindexed").alias("kind"), "path")
    return of_labels.unionByName(of_folders).unionByName(of_staged).unionByName(of_files).orderBy("severity", "kind", "path")


def worst(findings: DataFrame) -> DataFrame:
    """severity in words of the worst finding, and how many there are; "ok" for none."""
    name = F.lit("ok")
    for n, said in enumerate(SEVERITIES):
        name = F.when(F.col("__worst") == n, said).otherwise(name)
    return findings.agg(F.min("severity").alias("__worst"), F.count(F.lit(1)).alias("n_findings")).select(name.alias("worst"), "n_findings")


def folders_of(spark: SparkSession, workspace: str, depth: int = 6) -> DataFrame:
    return spark.createDataFrame([(p,) for p in live_files(workspace, depth, NEVER_REPORTED)], "path string")


def label(config: str, path: str, domain: str) -> str:
    """A configuration's text with a folder listed under a domain; an error where another entry already names it or the text doesn't parse."""
    data = tomllib.loads(config)
    if path.startswith("/") or ".." in path.split("/"):
        raise ValueError("a label is a folder below the workspace")
    if any(path in v.get("entries", []) for v in data.get("domains", {}).values()):
        raise ValueError(f"{path} is labelled already")
    head, quoted = f"[domains.{domain}]", '"' + path.replace("\\", "\\\\").replace('"', '\\"') + '"'
    entries = [*data.get("domains", {}).get(domain, {}).get("entries", []), path]
    line = "entries = [" + ", ".join('"' + e.replace("\\", "\\\\").replace('"', '\\"') + '"' for e in entries) + "]"
    rows, found, inside = [], False, False
    for row in config.split("\n"):
        inside = row.strip() == head if row.strip().startswith("[") and row.strip().endswith("]") and "=" not in row else inside
        if inside and row.split("=")[0].strip() == "entries":
            row, found = line, True
        rows.append(row)
    if not found:
        rows = [x for row in rows for x in ([row, line] if row.strip() == head else [row])] if domain in data.get("domains", {}) else [*rows, head, line, ""]
    changed = "\n".join(rows)
    if path not in tomllib.loads(changed)["domains"][domain]["entries"]:
        raise ValueError(f"{quoted} could not be added")
    return changed


def stage_undecided(config: str, paths: list[str]) -> str:
    """A configuration's text with a list of folders that wait for a decision; those that are listed stay."""
    data = tomllib.loads(config)
    known = data.get("unassigned", {}).get("undecided", [])
    fresh = sorted(set(paths) - set(known) - set(data.get("unassigned", {}).get("acknowledged", [])))
    if not fresh or "unassigned" in data:
        body = "undecided = [" + ", ".join(f'"{p}"' for p in [*known, *fresh]) + "]"
        rows = [body if r.split("=")[0].strip() == "undecided" else r for r in config.split("\n")]
        if fresh and "undecided" not in data["unassigned"]:
            rows = [x for r in rows for x in ([r, body] if r.strip() == "[unassigned]" else [r])]
        return "\n".join(rows)
    return config.rstrip("\n") + "\n\n[unassigned]\nundecided = [" + ", ".join(f'"{p}"' for p in fresh) + "]\n"


def load_text(path: str) -> str:
    return Path(path).read_text()
