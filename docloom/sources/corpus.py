"""Readers (SRC-1..3)."""

from __future__ import annotations

import bz2
import gzip
import itertools
import os
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.session import BATCH_BYTES, BATCH_ROWS, materialize, ship_package
from docloom.sources.committed import filesystem

INSTRUCTION_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("instruction", "input", "output")])

PROMPT_SPEC_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("instruction", T.StringType()),
    T.StructField("output_format_instruction", T.StringType()),
    T.StructField("examples", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
    T.StructField("input_keys", T.ArrayType(T.StringType())),
    T.StructField("output_key", T.StringType()),
    T.StructField("output_type", T.StringType()),
    T.StructField("language", T.StringType()),
])


def _percent_decode(c: Column) -> Column:
    """Undo one level of percent escapes; a plus sign stays a plus sign."""
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


#: Files and folders of a listing that a task takes; bytes of files that a task reads and that travel at once.
LIST_DIRS, READ_FILES, READ_BYTES = 5_000, 2_000, 64 << 20
#: Codecs of Spark's reader that tasks here don't undo.
OTHER_CODECS = (".deflate", ".snappy", ".lz4", ".zst")


def scan_text_corpus(spark: SparkSession, path: str, recursive: bool = True, name_dir: str | None = None) -> DataFrame:
    """One row per text file: ``(file, text)`` with the whole file as one value.

    ``name_dir``: take the name from a ``<name_dir>=<name>`` folder level
    instead of the file name (a corpus written by Spark's text writer with
    ``partitionBy(name_dir)``, one file per document; the writer's trailing
    newline is removed).

    A folder that pyarrow reaches is listed by tasks, level by level, and read
    by tasks from that list, so the driver never holds a file's name. Other
    paths (patterns, stores that only Spark opens) go through Spark's reader,
    whose driver lists them."""
    if recursive and (files := _listed(spark, path)) is not None:
        df, name, folder_of = _whole_files(files), F.element_at(F.split("path", "/"), -1), lambda x: x
    else:
        # keyword form: ``text()`` would otherwise pass its own wholetext=False over an option
        df = spark.read.text(path, wholetext=True, recursiveFileLookup=recursive).select(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), "value")
        name, folder_of = _percent_decode(F.col("name")), _percent_decode                          # of a URL
    if name_dir is None:
        return df.select(name.alias("file"), F.col("value").alias("text"))
    # the writer escapes the name's odd characters in the folder name
    folder = folder_of(F.regexp_extract("path", f"/{name_dir}=([^/]+)/", 1))
    return df.select(_percent_decode(folder).alias("file"), F.regexp_replace("value", r"\n\z", "").alias("text"))


def _hidden(name: str) -> bool:
    """Names that Spark's readers leave out."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _entries(fs, folder: str) -> Iterator[tuple[str, int | None]]:
    """(path, size; null for a folder) of what a folder holds; a local one is streamed."""
    from pyarrow import fs as pafs

    if isinstance(fs, pafs.LocalFileSystem):
        with os.scandir(folder) as found:
            for e in found:
                yield e.path, None if e.is_dir() else e.stat().st_size
    else:
        for i in fs.get_file_info(pafs.FileSelector(folder)):
            yield i.path, None if i.type == pafs.FileType.Directory else i.size


def _listed(spark: SparkSession, path: str) -> DataFrame | None:
    """(path, size, at: the folder) of all files with content below a folder, written as
    a table; none if it isn't a folder that tasks can list and read themselves."""
    from pyarrow import fs as pafs

    plain = "://" not in path and not path.startswith("file:/")
    if re.search(r"[{}\[\]*?\\]", path) or plain and not (spark._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:").startswith("file:"):
        return None
    try:
        fs, root = filesystem(path)
        if fs.get_file_info(root).type != pafs.FileType.Directory:
            return None
    except (OSError, ValueError):
        return None
    kind = "path string, size bigint"

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = filesystem(path)[0]
        below = (x for b in batches for folder in b.column("path").to_pylist() for x in _entries(fs, folder)
                 if not _hidden(x[0].rsplit("/", 1)[-1]) and x[1] != 0)
        while rows := list(itertools.islice(below, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["path", "size"])

    ship_package(spark)
    folders, levels = spark.createDataFrame([(root,)], "path string").coalesce(1), []
    while True:
        found = materialize(folders.mapInArrow(entries, kind), "listing")
        levels.append(found.where("size is not null"))
        n = found.where("size is null").count()
        if not n:
            break
        folders = found.where("size is null").select("path").repartition(max(1, -(-n // LIST_DIRS)))
    files = reduce(DataFrame.unionByName, levels)
    if not files.where(reduce(lambda x, y: x | y, (F.col("path").endswith(c) for c in OTHER_CODECS))).isEmpty():
        return None
    return files.withColumn("at", F.lit(path))


def _whole_files(files: DataFrame) -> DataFrame:
    """(path, value) of listed files, their bytes as they are, as Spark's text
    reader gives them; a task reads a bounded number of files."""
    n = files.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).first()
    tasks = max(1, -(-n["n"] // READ_FILES), -(-(n["bytes"] or 0) // READ_BYTES))

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, values, held = [], [], 0
        for b in batches:
            fs = filesystem(b.column("at")[0].as_py())[0] if b.num_rows else None
            for path in b.column("path").to_pylist():
                with fs.open_input_stream(path, compression=None) as f:
                    data = f.read()
                data = gzip.decompress(data) if path.endswith(".gz") else bz2.decompress(data) if path.endswith(".bz2") else data
                paths.append(path)
                values.append(data)
                held += len(data)
                if held >= BATCH_BYTES or len(paths) >= BATCH_ROWS:
                    yield _texts(paths, values)
                    paths, values, held = [], [], 0
        if paths:
            yield _texts(paths, values)

    return files.repartition(tasks).mapInArrow(contents, "path string, value string")


def _texts(paths: list[str], values: list[bytes]) -> pa.RecordBatch:
    data = pa.array(values, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.Array.from_buffers(pa.string(), len(data), data.buffers())], ["path", "value"])


_ESCAPED = re.compile("[\x01-\x1f\"#%'*/:=?\\\\\x7f{\\[\\]^]")


def _folder_name(name: str | None) -> str:
    """A name as Spark's writers put it into a partition folder's name."""
    return _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", name) if name else "__HIVE_DEFAULT_PARTITION__"


def write_text_corpus(df: DataFrame, path: str, name_dir: str = "file", text_col: str = "text") -> None:
    """A corpus folder for :func:`scan_text_corpus`: a folder ``<name_dir>=<name>``
    for every value of the column ``name_dir``, with one text file that holds
    the texts of that name, a newline after each, as the text writer with
    ``partitionBy(name_dir)`` lays it out. Tasks write the files in place, each
    moved there when it is whole: a committer's renames on the driver, one a
    folder, would take longer than all the rest."""
    def write(rows: Iterator) -> None:
        from pyspark import TaskContext

        fs, root = filesystem(path)
        at = TaskContext.get()
        part, draft = f"part-{at.partitionId():05d}.txt", f"_draft-{at.taskAttemptId()}"
        for folder, texts in itertools.groupby(rows, key=lambda r: _folder_name(r[0])):
            base = f"{root}/{name_dir}={folder}"
            fs.create_dir(base, recursive=True)
            with fs.open_output_stream(f"{base}/{draft}") as out:
                for r in texts:
                    out.write(((r[1] or "") + "\n").encode())
            fs.move(f"{base}/{draft}", f"{base}/{part}")

    filesystem(path)[0].create_dir(filesystem(path)[1], recursive=True)
    dealt = df.select(F.coalesce(F.col(name_dir), F.lit("")).alias("name"), text_col).repartition("name").sortWithinPartitions("name")
    dealt.foreachPartition(write)


def scan_instruction_set(spark: SparkSession, path: str, fmt: str = "parquet", split: str | None = "train") -> DataFrame:
    """Instruction table ``(instruction, input, output)``; when the data is
    laid out by split (``split=train/``), only that split is read."""
    reader = spark.read.schema(INSTRUCTION_SCHEMA) if fmt != "parquet" else spark.read
    df = reader.format(fmt).load(path)
    if split and "split" in df.columns:
        df = df.where(F.col("split") == split)
    return df.select(*[F.col(c).cast("string") for c in INSTRUCTION_SCHEMA.fieldNames()])


def scan_prompt_specs(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Prompt specs, one multi-line JSON document a file (or, with
    ``multi_line=False``, one a line, for large sets); ``examples`` hold values
    of mixed shape, read as MAP<STRING,STRING> (objects kept as JSON text)."""
    return spark.read.schema(PROMPT_SPEC_SCHEMA).option("multiLine", multi_line).json(path)
