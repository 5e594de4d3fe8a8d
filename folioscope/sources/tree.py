"""Markdown trees as a Python data source, and pages from any table of documents."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from folioscope.functions import text as T

# Directories that are never entered; the index also leaves out its own folder.
PRUNED = (".git", "node_modules", "target", ".venv")
INDEX_FOLDER = ".wiki"
SCHEMA = "path string, content binary, modified_at long"
FILES_PER_PARTITION = 500


def list_tree(root: str, prune: tuple[str, ...], any_case: bool, strict: bool = True) -> list[str]:
    """Relative paths of Markdown files, sorted; links are not followed, names that start with . or _ are kept.

    A folder that cannot be listed is an error, or passed over if not strict.
    """

    def failed(e: OSError) -> None:
        if strict:
            raise e

    top = Path(root)
    if not str(root).strip() or not top.is_dir():
        raise FileNotFoundError(f"not a directory: {root!r}")
    out = []
    for folder, names, files in os.walk(top, onerror=failed):
        names[:] = [n for n in names if n not in prune and not os.path.islink(os.path.join(folder, n))]
        for f in files:
            full = os.path.join(folder, f)
            ends = f.lower().endswith(".md") if any_case else f.endswith(".md")
            if ends and f not in prune and stat.S_ISREG(os.lstat(full).st_mode):
                out.append(os.path.relpath(full, top).replace(os.sep, "/"))
    return sorted(out, key=lambda p: p.split("/"))


class Files(InputPartition):
    def __init__(self, root: str, paths: list[str]):
        self.root, self.paths = root, paths


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options.get("path", "")
        index = options.get("mode", "index") == "index"
        self.prune = (*PRUNED, INDEX_FOLDER) if index else PRUNED
        self.any_case = index

    def partitions(self) -> list[InputPartition]:
        paths = list_tree(self.root, self.prune, self.any_case, strict=self.any_case)
        return [Files(self.root, paths[k : k + FILES_PER_PARTITION]) for k in range(0, max(1, len(paths)), FILES_PER_PARTITION)]

    def read(self, part: Files) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(part.paths), 50):
            own = part.paths[k : k + 50]
            full = [os.path.join(part.root, p) for p in own]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([Path(f).read_bytes() for f in full], pa.binary()), pa.array([max(0, int(os.stat(f).st_mtime)) for f in full], pa.int64())], names=["path", "content", "modified_at"])


class MarkdownTree(DataSource):
    """spark.read.format("mdtree").option("mode", "index" | "search").load(root); the root is a folder all nodes see."""

    @classmethod
    def name(cls) -> str:
        return "mdtree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return TreeReader(self.options)


def read_tree(spark: SparkSession, root: str, mode: str = "index") -> DataFrame:
    spark.dataSource.register(MarkdownTree)
    return spark.read.format("mdtree").option("mode", mode).load(root)


def pages(files: DataFrame) -> DataFrame:
    """id, path, title, category, text, sha256, modified_at of files (path, content[, modified_at])."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    stamp = F.col("modified_at") if "modified_at" in files.columns else F.lit(0).cast("long")
    return files.select(
        F.concat(F.lit("doc:"), "path").alias("id"), "path", T.title(text, F.col("path")).alias("title"), T.category(F.col("path")).alias("category"), text.alias("text"), F.sha2("content", 256).alias("sha256"), stamp.alias("modified_at")
    )


def pages_of_table(table: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Pages of any table with a path and a text."""
    return pages(table.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("content")))
