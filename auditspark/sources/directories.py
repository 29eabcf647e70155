"""Packages in directories, as a data source that executors list and read.

Spark's own listing leaves out names that start with a dot or an underscore, which an audit must see.  Here a
task takes the entries of the base directory whose names hash to its number and walks those subtrees itself,
directory by directory, so no list of paths exists anywhere; the driver only counts tasks.  `base` is a
path or a URI of a file system that pyarrow knows (file, s3, gs, hdfs); driver and executors must share it.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.lineage import numbered, ranged

# Fixed value: the names of which a package's root holds one.
ROOT_NAMES = {"SKILL.md", "skill.md"}
#: A batch closes at so many rows or characters.
BATCH_ROWS, BATCH_CHARACTERS = 256, 1 << 23


def _open(base: str) -> tuple[pafs.FileSystem, str]:
    if base.startswith("file:"):
        base = "/" + base[5:].lstrip("/")
    fs, path = pafs.FileSystem.from_uri(base) if "://" in base else (pafs.LocalFileSystem(), os.path.abspath(base))
    return fs, path.rstrip("/")


def _entries(fs: pafs.FileSystem, directory: str) -> tuple[list[str], list[str]]:
    """Names of the directories and of the files in a directory, sorted; links to directories are neither, and hidden
    directories are left out."""
    infos = fs.get_file_info(pafs.FileSelector(directory, recursive=False))
    local = isinstance(fs, pafs.LocalFileSystem)
    inner = sorted(i.base_name for i in infos if i.type == pafs.FileType.Directory and not i.base_name.startswith(".") and not (local and os.path.islink(i.path)))
    return inner, sorted(i.base_name for i in infos if i.type == pafs.FileType.File)


def _text(fs: pafs.FileSystem, path: str) -> str | None:
    """A file that is UTF-8, with line ends folded to line feeds; null for any other."""
    try:
        with fs.open_input_stream(path) as f:
            return f.read().decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")
    except (OSError, UnicodeDecodeError):
        return None


def walk(base: str, task: int = 0, tasks: int = 1, contents: bool = True) -> Iterator[tuple[str, str, str | None]]:
    """(package_id, path, content) of every file of every package below base, in this task's share.

    A package is named by its root relative to base (`.` for base itself); nested packages count on their own
    too, so a file may be in several.  Hidden directories are not entered, hidden files are read."""
    fs, top = _open(base)

    def rows(directory: str, names: list[str], roots: list[list[str]], at: list[str]) -> Iterator[tuple[str, str, str | None]]:
        for n in names if roots else ():
            text = _text(fs, f"{directory}/{n}") if contents else None
            for r in roots:
                yield "/".join(r) or ".", "/".join([*at[len(r) :], n]), text

    def share(name: str) -> bool:
        return zlib.crc32(name.encode()) % tasks == task

    inner, names = _entries(fs, top)
    above: list[list[str]] = [[]] if ROOT_NAMES & set(names) else []
    yield from rows(top, [n for n in names if share(n)], above, [])
    # packages that a directory is part of: those above it and its own
    stack = [([n], above) for n in reversed(inner) if share(n)]
    while stack:
        at, roots = stack.pop()
        directory = "/".join([top, *at])
        inner, names = _entries(fs, directory)
        if ROOT_NAMES & set(names):
            roots = [*roots, at]
        yield from rows(directory, names, roots, at)
        stack += [([*at, n], roots) for n in reversed(inner)]


class Share(InputPartition):
    def __init__(self, number: int) -> None:
        super().__init__(number)
        self.number = number


class PackageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.base, self.tasks, self.contents = options["base"], int(options.get("tasks", "64")), options.get("contents", "true") == "true"

    def partitions(self) -> list[InputPartition]:
        return [Share(i) for i in range(self.tasks)]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, str, str | None]] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["package_id", "path", "content"])

        for row in walk(self.base, partition.number, self.tasks, self.contents):
            rows.append(row)
            size += len(row[2] or "")
            if len(rows) >= BATCH_ROWS or size >= BATCH_CHARACTERS:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()


class PackageSource(DataSource):
    """spark.read.format("packages").option("base", ...): a row a file of a package.  Options: tasks (64), contents
    (false leaves content null and reads no file)."""

    @classmethod
    def name(cls) -> str:
        return "packages"

    def schema(self) -> str:
        return "package_id string, path string, content string"

    def reader(self, schema) -> PackageReader:
        if "base" not in self.options:
            raise ValueError("option base must name the directory of the packages")
        return PackageReader(dict(self.options))


def read_packages(spark: SparkSession, base: str, tasks: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, paths, packages) of the packages below a folder that driver and executors share.  Files
    that are UTF-8 are text, with line ends folded to line feeds; the others are paths only."""
    spark.dataSource.register(PackageSource)
    load = spark.read.format("packages").option("base", base).option("tasks", str(tasks or 4 * spark.sparkContext.defaultParallelism))
    paths = load.option("contents", "false").load().select("package_id", "path")
    files = load.option("contents", "true").load().where("content is not null")
    return files, paths, paths.select("package_id").distinct()


def write_packages(files: DataFrame, base: str) -> None:
    """Writes every file below base/package_id.  A task that runs again writes the same files again."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _open(base)
        n = 0
        for b in batches:
            for package, path, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                full = f"{top}/{package}/{path}"
                fs.create_dir(full.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(full) as f:
                    f.write(content.encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    files.select("package_id", "path", "content").mapInArrow(write, "n bigint").write.format("noop").mode("overwrite").save()


def package_roots(paths: DataFrame) -> DataFrame:
    """root_seq (from 1), root: every directory of a listing that holds a definition, in the order of their parts; `.` is the
    base.  Below hidden directories there are none."""
    here = paths.where(_visible() & F.element_at(F.split("path", "/"), -1).isin(*sorted(ROOT_NAMES)))
    roots = here.select(F.when(F.instr("path", "/") == 0, F.lit(".")).otherwise(F.regexp_replace("path", "/[^/]*$", "")).alias("root")).distinct()
    return numbered(roots.withColumn("__key", _key("root")), [], ["__key"], "root_seq").select("root_seq", "root")


def package_listing(paths: DataFrame) -> DataFrame:
    """package_id, path: the packages of a table of paths, as read_packages() finds them in a directory."""
    roots = package_roots(paths).select("root")
    return nested(paths.where(_visible()), roots).select(F.col("root").alias("package_id"), "path")


def _visible() -> Column:
    return F.col("path").isNotNull() & ~F.col("path").rlike(r"(^|/)\.[^/]*/")


def _key(name: str) -> Column:
    """A path's parts: in their order a directory stands right before all that is in it."""
    return F.when(F.col(name).isin("", "."), F.array().cast("array<string>")).otherwise(F.split(name, "/"))


def nested(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """root, path: every listed path under each root that contains it, relative to that root.

    Paths and roots are sorted together, by their parts, in ranges; a task reads its range once and keeps the roots that
    are open, at most one a level.  Those that are open where a range begins are found by their names among the
    ancestors of its first path: a row a range and level, all that the driver sees.  Nulls are left out; repeated
    paths stay, repeated roots count once."""
    r = roots.where("root is not null").select(F.col("root").alias("path"), F.lit(0).alias("kind")).distinct()
    p = paths.where("path is not null").select("path", F.lit(1).alias("kind"))
    rows = ranged(r.unionByName(p).withColumn("__key", _key("path")), ["__key", "kind"])
    first = rows.groupBy("__range").agg(F.min("__key").alias("first"))
    above = F.transform(F.sequence(F.lit(0), F.size("first") - 1), lambda i: F.slice("first", F.lit(1), i))
    held = first.where(F.size("first") > 0).select("__range", F.explode(above).alias("__key")).join(rows.where("kind = 0").select("__key").distinct(), "__key")
    begin: dict[int, list[list[str]]] = {}
    for x in held.select("__range", "__key").collect():
        begin.setdefault(x[0], []).append(list(x[1]))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_roots = None, []
        for b in batches:
            out: list[tuple[str, str]] = []
            for number, path, kind in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if number != now:
                    now, open_roots = number, sorted(begin.get(number, []), key=len)
                parts = [] if kind == 0 and path in ("", ".") else path.split("/")
                while open_roots and (len(open_roots[-1]) >= len(parts) or parts[: len(open_roots[-1])] != open_roots[-1]):
                    open_roots.pop()
                if kind == 0:
                    open_roots.append(parts)
                else:
                    out += [("/".join(o) or ".", "/".join(parts[len(o) :])) for o in open_roots]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in range(2)], ["root", "path"])

    return rows.select("__range", "path", "kind").mapInArrow(merge, "root string, path string")
