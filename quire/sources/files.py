"""Three front doors to the ``files`` table."""

from __future__ import annotations

import os
import stat
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.ignore import IgnoreRules
from quire.operators.scale import stored
from quire.schemas import FILES


def read_archive(spark: SparkSession, location: str) -> DataFrame:
    """Files archived as Parquet. Only the columns a job uses are read."""
    return spark.read.schema(FILES).parquet(location)


#: Bodies above this size are not read unless a caller asks for it.
MAX_BODY_BYTES = 64 * 1024 * 1024


def read_binary_files(
    spark: SparkSession, root: str, repo: str, max_file_bytes: int | None = MAX_BODY_BYTES
) -> DataFrame:
    """Files below ``root`` through Spark's own binary reader.

    Files above ``max_file_bytes`` are listed with their size and a null body, which is not read.

    The reader follows links and leaves out empty files and names that begin with a dot or
    an underscore. Use :func:`scan_directories` where those matter.
    """
    rows = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("ignoreCorruptFiles", "true")
        .load(root)
    )
    # The file system says how it writes its paths; only what follows the scheme is compared.
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    prefix = system.makeQualified(folder).toUri().getPath().rstrip("/") + "/"
    inside = F.regexp_replace("path", "^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "")

    def shown(found: DataFrame, content: Column) -> DataFrame:
        return found.select(
            F.lit(repo).alias("repo"),
            F.substr(inside, F.lit(len(prefix) + 1)).alias("path"),
            content.alias("content"),
            F.col("length").alias("size"),
            F.lit("file").alias("kind"),
        )

    if max_file_bytes is None:
        return shown(rows, F.col("content"))
    # The reader takes the filter on lengths and opens no file whose body nobody selects.
    small = shown(rows.filter(F.col("length") <= max_file_bytes), F.col("content"))
    return small.unionByName(shown(rows.filter(F.col("length") > max_file_bytes), F.lit(None).cast("binary")))


_BATCH_ROWS = 10_000
_BATCH_BYTES = 8 * 1024 * 1024
_LISTED = "repo string, root string, path string, size long, kind string, identity string"


def _list_directories(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One level: directories in, their entries out, in bounded batches."""
    columns = ["repo", "root", "path", "size", "kind", "identity"]
    for batch in batches:
        for repo, root, path in zip(batch["repo"], batch["root"], batch["path"], strict=True):
            rows: list[tuple] = []
            try:
                with os.scandir(os.path.join(root, path)) as found:
                    for entry in found:
                        rows.append((repo, root, *_describe(entry, path)))
                        if len(rows) == _BATCH_ROWS:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
            except OSError:
                rows.append((repo, root, path, 0, "unreadable_dir", None))
            if rows:
                yield pd.DataFrame(rows, columns=columns)


def _describe(entry: os.DirEntry, parent: str) -> tuple[str, int, str, str | None]:
    path = f"{parent}/{entry.name}" if parent else entry.name
    try:
        info = entry.stat(follow_symlinks=False)
    except OSError:
        return path, 0, "unreadable", None
    if stat.S_ISLNK(info.st_mode):
        return path, info.st_size, "symlink", None
    if stat.S_ISDIR(info.st_mode):
        return path, 0, "dir", None
    return path, info.st_size, "file" if stat.S_ISREG(info.st_mode) else "other", _identity(info)


def _identity(info: os.stat_result) -> str:
    return f"{info.st_dev}:{info.st_ino}"


def read_guarded(
    path: str, identity: str | None, limit: int | None, during: Callable[[], None] | None = None
) -> tuple[str, int, bytes | None]:
    """Kind, size and body of a regular file that may change while it is read.

    A file above ``limit``, or one that grows above it, has no body and the size that says so. One that is not the
    listed file any more, or whose size or times change between opening and the end of reading, is ``changed``. No more
    is read than its size at opening and one byte. ``during`` runs after opening.
    """
    # Without blocking: a pipe may have taken the place of the file.
    descriptor = os.open(path, os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK)
    with os.fdopen(descriptor, "rb") as handle:
        before = os.fstat(descriptor)
        if not stat.S_ISREG(before.st_mode) or identity not in (None, _identity(before)):
            return "changed", before.st_size, None
        if limit is not None and before.st_size > limit:
            return "file", before.st_size, None
        if during:
            during()
        content = handle.read(before.st_size + 1)
        after = os.fstat(descriptor)
    if limit is not None and max(len(content), after.st_size) > limit:
        return "file", max(len(content), after.st_size), None
    same = (before.st_size, before.st_mtime_ns, before.st_ctime_ns) == (after.st_size, after.st_mtime_ns, after.st_ctime_ns)
    if not same or len(content) != after.st_size:
        return "changed", after.st_size, None
    return "file", len(content), content


def _read_bodies(limit: int | None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Bodies of listed files, in output batches of a few megabytes."""
    columns = FILES.fieldNames()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for repo, root, path, size, kind, identity, wanted in batch.itertuples(index=False):
                content = None
                if wanted:
                    try:
                        kind, size, content = read_guarded(os.path.join(root, path), identity, limit)
                    except OSError:
                        kind = "unreadable"
                rows.append((repo, path, content, size, kind))
                held += size if content is not None else 0
                if held > _BATCH_BYTES or len(rows) == _BATCH_ROWS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return read


def scan_directories(
    spark: SparkSession,
    roots: dict[str, str],
    rules: IgnoreRules | None = None,
    max_file_bytes: int | None = MAX_BODY_BYTES,
) -> DataFrame:
    """Walk directories that every worker can reach: ``{repo: root}``.

    The walk goes one level at a time, each level spread over the cluster by directory, so a
    deep or wide root does not end up in one task. Dot files, empty files, links and
    unreadable entries are reported. Bodies are read last, not for files above
    ``max_file_bytes``; a file that is replaced or changes meanwhile has the kind ``changed`` (:func:`read_guarded`). With ``rules`` a directory that can hold nothing to keep is not
    entered and shows as one row of kind ``pruned_dir``.
    """
    level = spark.createDataFrame(
        [(repo, root, "") for repo, root in roots.items()], "repo string, root string, path string"
    )
    levels: list[DataFrame] = []
    while True:
        listed = level.repartition("repo", "root", "path").mapInPandas(_list_directories, _LISTED)
        if rules is not None:
            below = F.concat("path", F.lit("/."))
            skipped = (F.col("kind") == "dir") & rules.pruned_directory(below).isNotNull()
            listed = listed.withColumn("kind", F.when(skipped, "pruned_dir").otherwise(F.col("kind")))
        found = stored(listed)
        levels.append(found.filter(F.col("kind") != "dir"))
        level = found.filter(F.col("kind") == "dir").select("repo", "root", "path")
        if level.isEmpty():
            break
    listing = levels[0]
    for deeper in levels[1:]:
        listing = listing.unionByName(deeper)
    wanted = F.col("kind") == "file"
    if max_file_bytes is not None:
        wanted = wanted & (F.col("size") <= max_file_bytes)
    return (
        listing.withColumn("wanted", wanted)
        .repartition("repo", "path")
        .mapInPandas(_read_bodies(max_file_bytes), FILES)
    )
