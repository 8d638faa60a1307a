"""Source trees and version-control logs as DataFrames.

Spark's own binaryFile source drops every path with a part that begins with . or _, so
the driver lists paths (names only) and executors read the contents.  Tables of files
that already lie in a lake are used as they are.
"""

from __future__ import annotations

import fnmatch
import os
import re
import subprocess

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.functions.terms import extension, file_name
from loomgraph.operators.extract import MIME
from loomgraph.operators.gitlog import FIELDS, parse_log

FILES = "path string, file_name string, ext string, length bigint, content binary"


def ignore_rule(line: str) -> tuple[re.Pattern, bool, bool] | None:
    """(pattern over the path below the rule's folder, negated, folders only) of a line of an ignore file."""
    line = line.rstrip("\n")
    if not line.endswith("\\ "):
        line = line.rstrip()
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line
    folders = line.endswith("/")
    line = line.strip("/") if not line.startswith("/") else "/" + line.strip("/")
    anchored = "/" in line
    out = ""
    for part in re.split(r"(\*\*/|/\*\*|\*\*|\*|\?|\[[^\]]*\])", line.lstrip("/")):
        out += {"**/": "(?:.*/)?", "/**": "(?:/.*)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or (part.replace("[!", "[^") if part.startswith("[") and part.endswith("]") else re.escape(part))
    return re.compile(("" if anchored else "(?:.*/)?") + out + r"\Z"), negated, folders


class Ignore:
    """The rules of a tree's ignore files and of excludes; the last rule that matches decides."""

    def __init__(self, exclude: list[str] | None = None):
        self.excluded = [r for x in exclude or [] if (r := ignore_rule(x))]

    def ignored(self, rules: list[tuple[str, tuple]], path: str, is_dir: bool) -> bool:
        for pattern, negated, folders in reversed(self.excluded):
            if (is_dir or not folders) and pattern.match(path):
                return not negated
        for base, (pattern, negated, folders) in reversed(rules):
            below = path[len(base) :] if path.startswith(base) else None
            if below is not None and (is_dir or not folders) and pattern.match(below):
                return not negated
        return False


def list_paths(root: str, exclude: list[str] | None = None, hidden: bool = True) -> list[str]:
    """The files below ``root`` that no ignore file and no exclude pattern keeps out; excluded folders are not entered."""
    ignore, found = Ignore(exclude), []

    def walk(folder: str, below: str, rules: list) -> None:
        own = os.path.join(folder, ".gitignore")
        if os.path.isfile(own):
            with open(own, encoding="utf-8", errors="replace") as f:
                rules = rules + [(below, r) for line in f if (r := ignore_rule(line))]
        for e in sorted(os.scandir(folder), key=lambda x: x.name):
            path = below + e.name
            is_dir = e.is_dir(follow_symlinks=False)
            if e.name == ".git" or not hidden and e.name.startswith(".") or ignore.ignored(rules, path, is_dir):
                continue
            if is_dir:
                walk(e.path, path + "/", rules)
            elif e.is_file():
                found.append(e.path)

    walk(root, "", [])
    return found


def read_tree(spark: SparkSession, root: str, exclude: list[str] | None = None, hidden: bool = True, partitions: int | None = None) -> DataFrame:
    """path, file_name, ext, length, content of a tree; unreadable files and files of which only metadata are kept have null content."""
    paths = list_paths(root, exclude, hidden)
    metadata_only = frozenset(MIME)

    def read(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                try:
                    with open(path, "rb") as f:
                        size = os.fstat(f.fileno()).st_size
                        content = None if path.rpartition(".")[2] in metadata_only else f.read()
                except OSError:
                    content, size = None, None
                yield pa.record_batch([pa.array([path]), pa.array([size], pa.int64()), pa.array([content], pa.binary())], names=["path", "length", "content"])

    names = spark.createDataFrame([(p,) for p in paths], "path string").repartition(partitions or max(1, min(len(paths), spark.sparkContext.defaultParallelism * 4)))
    return names.mapInArrow(read, "path string, length bigint, content binary").select("path", file_name(F.col("path")).alias("file_name"), extension(F.col("path")).alias("ext"), "length", "content")


def matching(paths: list[str], pattern: str) -> list[str]:
    return [p for p in paths if fnmatch.fnmatch(p, pattern)]


def read_log(spark: SparkSession, root: str, limit: int | None = 500) -> tuple[DataFrame, DataFrame]:
    """(commits, commit_files) of a checkout, newest first (``limit`` None: all of them); both are empty where there is none."""
    try:
        run = subprocess.run(["git", "log", *([] if limit is None else [f"-n{limit}"]), f"--format={FIELDS}", "--name-only"], cwd=root, capture_output=True)
        text = run.stdout.decode("utf-8", "replace") if run.returncode == 0 else ""
    except OSError:
        text = ""
    return parse_log(spark.createDataFrame([(text,)], "text string"))


def fetch(url: str, folder: str) -> str:
    """A shallow clone of ``url`` in ``folder`` (pulled if it is there already); its path."""
    import hashlib

    target = os.path.join(folder, hashlib.sha256(url.encode()).hexdigest()[:16])
    if os.path.isdir(target):
        subprocess.run(["git", "-C", target, "pull", "--ff-only"], capture_output=True)
    else:
        subprocess.run(["git", "clone", "--depth", "1", "--", url, target], check=True, capture_output=True)
    return target
