"""Two revisions of a source tree: manifests of directories and of git trees, path changes, merge bases."""

from __future__ import annotations

import hashlib
import subprocess
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import graph, scope

CHANGE_SCHEMA = "status string, score int, old_path string, new_path string, seq int"


def manifest(spark: SparkSession, root: str, suffix: str = ".java") -> DataFrame:
    """(path relative to the root, sha256, size) of a directory, read by the executors."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(root)
    bare = F.regexp_replace("path", "^[a-z]+:/*", "/")
    below = F.substring(bare, F.instr(bare, root.rstrip("/")) + len(root.rstrip("/")) + 1, F.lit(1 << 30))
    return found.select(below.alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True, text=True, timeout=60).stdout


def tree(spark: SparkSession, repo: str, commit: str, suffix: str = ".java") -> DataFrame:
    """(path, blob) of a commit; the listing is metadata of one repository."""
    rows = []
    for entry in git(repo, "ls-tree", "-r", "-z", commit).split("\0"):
        meta, _, path = entry.partition("\t")
        if path.endswith(suffix) and meta.split()[1] == "blob" and not meta.startswith("120000"):
            rows.append((path, meta.split()[2]))
    return spark.createDataFrame(rows, "path string, blob string")


def changes(spark: SparkSession, repo: str, base: str, after: str) -> DataFrame:
    """Path changes between two commits, renames and copies found by git."""
    parts = git(repo, "diff-tree", "-r", "-z", "-M", "-C", "--name-status", base, after).split("\0")[:-1]
    rows, i = [], 0
    while i < len(parts):
        status, score = parts[i][0], int(parts[i][1:] or 0)
        pair = status in "RC"
        old, new = (parts[i + 1], parts[i + 2]) if pair else (None if status == "A" else parts[i + 1], None if status == "D" else parts[i + 1])
        rows.append((status, score if pair else None, old, new, len(rows)))
        i += 2 + pair
    return spark.createDataFrame(rows, CHANGE_SCHEMA)


def merge_base(repo: str, base: str, head: str) -> str:
    found = git(repo, "merge-base", "--all", base, head).split()
    if len(found) != 1:
        raise ValueError(f"{len(found)} merge bases of {base} and {head}; exactly one is needed")
    return found[0]


def moves(change_rows: DataFrame) -> DataFrame:
    """(old_path, new_path, seq) of renames and copies, for entity correspondence."""
    return change_rows.filter("old_path is not null and new_path is not null and old_path != new_path").select("old_path", "new_path", "seq")


def index(spark: SparkSession, repo: str, suffix: str = ".java") -> DataFrame:
    """(path, blob) of the staged state; unmerged entries are an error."""
    rows = []
    for entry in git(repo, "ls-files", "-s", "-z").split("\0")[:-1]:
        meta, _, path = entry.partition("\t")
        mode, blob, stage = meta.split()
        if stage != "0":
            raise ValueError(f"{path} isn't merged")
        if path.endswith(suffix) and mode != "120000":
            rows.append((path, blob))
    return spark.createDataFrame(rows, "path string, blob string")


def listed_files(repo: str, suffix: str = ".java") -> list[str]:
    """Tracked and untracked paths of the working tree that aren't ignored; the listing is metadata of one repository."""
    found = set(git(repo, "ls-files", "-z").split("\0")) | set(git(repo, "ls-files", "-o", "--exclude-standard", "-z").split("\0"))
    return sorted(p for p in found if p.endswith(suffix))


def working_tree(spark: SparkSession, repo: str, suffix: str = ".java") -> DataFrame:
    """(path, sha256, blob, stable) of the working tree, without links and files that are gone; ``blob`` is git's id of the content.

    Executors read every file twice; ``stable`` is false where the two differ, as the file is being written.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                file = Path(repo, path)
                if file.is_file() and not file.is_symlink():
                    first, second = file.read_bytes(), file.read_bytes()
                    rows.append((path, hashlib.sha256(first).hexdigest(), hashlib.sha1(b"blob %d\0" % len(first) + first).hexdigest(), first == second))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:3]), pa.array(columns[3], pa.bool_())], names=["path", "sha256", "blob", "stable"])

    paths = spark.createDataFrame([(p,) for p in listed_files(repo, suffix)], "path string")
    return paths.mapInArrow(read, "path string, sha256 string, blob string, stable boolean")


def contents(repo: str, manifest: DataFrame, stored: bool = True) -> DataFrame:
    """(path, content) of a manifest (path, blob), read by the executors: blobs of the repository, or files of the working tree if not ``stored``.

    A working file that no longer has the manifest's blob is an error, since what is analysed must be what was compared.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, blob in zip(batch.column("path").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if stored:
                    raw = subprocess.run(["git", "-C", repo, "cat-file", "blob", blob], check=True, capture_output=True, timeout=60).stdout
                else:
                    raw = Path(repo, path).read_bytes()
                    if hashlib.sha1(b"blob %d\0" % len(raw) + raw).hexdigest() != blob:
                        raise ValueError(f"{path} changed while it was compared")
                out.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.binary())], names=["path", "content"])

    return manifest.select("path", "blob").mapInArrow(read, "path string, content binary")


@dataclass
class Plan:
    """Two revisions to compare: what they hold, and how they differ."""

    mode: str
    requested: str
    base: str
    head: str
    merge_base: str
    before: DataFrame  # path, blob
    after: DataFrame  # path, blob
    changes: DataFrame  # status, old_path, new_path

    @property
    def from_git(self) -> bool:
        return self.mode != "worktree"


def plan(spark: SparkSession, repo: str, base: str, mode: str = "worktree", suffix: str = ".java") -> Plan:
    """The merge base of ``base`` and HEAD against the working tree, the staged state or HEAD itself (committed)."""
    if mode not in ("worktree", "staged", "committed"):
        raise ValueError(f"unknown mode {mode}")
    head, base_sha = git(repo, "rev-parse", "HEAD^{commit}").strip(), git(repo, "rev-parse", f"{base}^{{commit}}").strip()
    start = merge_base(repo, base_sha, head)
    before, at_head = tree(spark, repo, start, suffix), tree(spark, repo, head, suffix)
    staged = index(spark, repo, suffix) if mode != "committed" else None  # an unmerged index is an error in both modes
    after = at_head if mode == "committed" else staged if mode == "staged" else working_tree(spark, repo, suffix).select("path", "blob")
    after = graph.kept(after)
    made = changes(spark, repo, start, head).filter(F.coalesce("new_path", "old_path").endswith(suffix))
    bare = lambda df: df.select("path", F.col("blob").alias("sha256"))
    local = scope.local_changes(made, bare(at_head), bare(after)) if mode != "committed" else made.select("status", "old_path", "new_path")
    return Plan(mode, base, base_sha, head, start, before, after, graph.kept(local))


def classpath(spark: SparkSession, entries: list[str]) -> DataFrame:
    """(rank, path, kind, sha256) of class path entries: jar, source-dir, class-dir, empty-dir or bad."""
    rows = []
    for rank, entry in enumerate(entries):
        path = Path(entry)
        kind, digest = "bad", None
        if path.is_file() and zipfile.is_zipfile(path):
            kind, digest = "jar", hashlib.sha256(path.read_bytes()).hexdigest()
        elif path.is_dir():
            kind = next((k for k, s in (("class-dir", ".class"), ("source-dir", ".java")) if next(path.rglob(f"*{s}"), None)), "empty-dir")
        rows.append((rank, entry, kind, digest))
    return spark.createDataFrame(rows, "rank int, path string, kind string, sha256 string")
