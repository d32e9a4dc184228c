"""Tables whose parts become visible at once (used by SNK-3..5).

A committed table is a folder. Rows are added in parts. The data files of a
part are written by tasks under ``data/``, each attempt in a folder of its own;
a part is visible once its commit file ``commits/<label>.json``, which names
its files, has been moved into place. Until then, and if a task or the job
fails, readers see the table as it was. A commit may replace earlier parts
(compaction): they disappear in the moment the new one appears.

Writing is a Python data source (``docloom_table``): a task streams Arrow
batches into Parquet files and reports their names and row counts in its commit
message, the driver's side of the writer publishes or deletes them. A keyed
table's files also get a Bloom filter each, in a small Parquet file beside
them. Reading is Spark's own Parquet reader over the files that the visible
commits name.

Paths go to the file system that pyarrow finds for them (local and mounted
folders, ``hdfs://``, ``s3://`` and ``s3a://``, ``gs://``).
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from docloom.session import small_batches

#: Helper columns that rows may bring to the writer: the number of their file in the part, the hash of their key.
FILE_COL, HASH_COL = "_docloom_file", "_docloom_hash"
BLOOM_BITS, BLOOM_HASHES = 12, 8                            # bits a key and probes: 0.3 % false positives


def filesystem(path: str):
    """(pyarrow file system, path in it) of a table's path."""
    from pyarrow import fs
    if re.match(r"file:/", path):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))
    return fs.LocalFileSystem(), os.path.abspath(path)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _probes(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    with np.errstate(over="ignore"):
        a = _mix(hashes.view(np.uint64))
        b = _mix(a) | np.uint64(1)
        for i in range(BLOOM_HASHES):
            yield (a + np.uint64(i) * b) % np.uint64(bits)


def bloom_of(hashes: np.ndarray) -> bytes:
    """A Bloom filter of 64-bit key hashes."""
    bits = max(64, (len(hashes) * BLOOM_BITS + 7) // 8 * 8)
    on = np.zeros(bits, bool)
    for at in _probes(hashes, bits):
        on[at] = True
    return np.packbits(on).tobytes()


def in_bloom(bloom: bytes, hashes: np.ndarray) -> np.ndarray:
    """True where the filter may hold the key (always where it does)."""
    packed = np.frombuffer(bloom, np.uint8)
    hit = np.ones(len(hashes), bool)
    for at in _probes(hashes, len(packed) * 8):
        hit &= (packed[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1
    return hit


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: (file of the part, name, rows) of every data file."""
    files: list = field(default_factory=list)


class TableWriter(DataSourceArrowWriter):
    """One attempt to write one part."""

    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.part = options["path"], options["part"]
        self.replaces, self.n = json.loads(options.get("replaces") or "[]"), int(options.get("files") or 0)
        self.numbered, self.keyed = FILE_COL in schema.fieldNames(), HASH_COL in schema.fieldNames()
        self.schema = T.StructType([f for f in schema.fields if f.name not in (FILE_COL, HASH_COL)]).json()
        self.folder = f"{self.part}-{uuid.uuid4().hex}"
        fs, root = filesystem(self.path)                    # made here alone: a task that outlives an abort can't make it again
        fs.create_dir(f"{root}/data/{self.folder}/bloom" if self.keyed else f"{root}/data/{self.folder}", recursive=True)

    def write(self, iterator) -> Written:
        import pyarrow as pa
        import pyarrow.parquet as pq

        fs, root = filesystem(self.path)
        base = f"{root}/data/{self.folder}"
        writers, names, rows, hashes = {}, {}, {}, {}
        name = uuid.uuid4().hex                             # another attempt of this task has another name
        for batch in iterator:
            if not batch.num_rows:
                continue
            number = batch.column(FILE_COL).to_numpy() if self.numbered else np.zeros(batch.num_rows, np.int64)
            data = batch.drop_columns([c for c in (FILE_COL, HASH_COL) if c in batch.schema.names])
            for k in np.unique(number).tolist():
                here = pa.array(number == k)
                if k not in writers:
                    names[k], rows[k], hashes[k] = f"{k:06d}-{name}.parquet", 0, []
                    writers[k] = pq.ParquetWriter(f"{base}/{names[k]}", data.schema, filesystem=fs, compression="zstd")
                writers[k].write_batch(data.filter(here))
                rows[k] += int((number == k).sum())
                if self.keyed:
                    hashes[k].append(batch.column(HASH_COL).filter(here).to_numpy())
        for k, w in writers.items():
            w.close()
            if self.keyed:
                bloom = pa.table({"part": [self.part], "file": pa.array([k], pa.int64()),
                                  "bloom": pa.array([bloom_of(np.concatenate(hashes[k]))], pa.binary())})
                pq.write_table(bloom, f"{base}/bloom/{names[k]}", filesystem=fs)
        return Written([(k, names[k], rows[k]) for k in writers])

    def commit(self, messages) -> None:
        fs, root = filesystem(self.path)
        files = sorted(tuple(f) for m in messages if m is not None for f in m.files)
        entry = {"part": self.part, "folder": self.folder, "schema": self.schema, "n": self.n, "replaces": self.replaces,
                 "rows": sum(f[2] for f in files), "files": files}
        done = f"{root}/commits/{self.part}.json"
        if _there(fs, done):
            raise FileExistsError(f"part {self.part!r} is stored already")
        fs.create_dir(f"{root}/commits", recursive=True)
        draft = f"{root}/commits/.{self.folder}"
        with fs.open_output_stream(draft) as out:
            out.write(json.dumps(entry).encode())
        fs.move(draft, done)                               # the part is visible from here on

    def abort(self, messages) -> None:
        fs, root = filesystem(self.path)
        if _there(fs, f"{root}/data/{self.folder}"):
            fs.delete_dir(f"{root}/data/{self.folder}")


class CommittedTable(DataSource):
    """Write-only data source; see :func:`write_part` and :func:`read_table`."""

    @classmethod
    def name(cls) -> str:
        return "docloom_table"

    def writer(self, schema: T.StructType, overwrite: bool) -> TableWriter:
        return TableWriter(self.options, schema)


def _there(fs, path: str) -> bool:
    return fs.get_file_info(path).type.name != "NotFound"


def commits(path: str) -> list[dict]:
    """All commits of a table, replaced ones too, in order of their labels."""
    from pyarrow import fs as pafs
    fs, root = filesystem(path)
    if not _there(fs, f"{root}/commits"):
        return []
    out = []
    for info in fs.get_file_info(pafs.FileSelector(f"{root}/commits")):
        if info.base_name.endswith(".json") and not info.base_name.startswith("."):
            with fs.open_input_stream(info.path) as f:
                out.append(json.loads(f.read()))
    return sorted(out, key=lambda c: c["part"])


def visible(path: str) -> list[dict]:
    """The commits whose rows the table holds now."""
    found = commits(path)
    gone = {p for c in found for p in c["replaces"]}
    return [c for c in found if c["part"] not in gone]


def find_commit(path: str, part: str) -> dict | None:
    fs, root = filesystem(path)
    name = f"{root}/commits/{part}.json"
    if not _there(fs, name):
        return None
    with fs.open_input_stream(name) as f:
        return json.loads(f.read())


def data_files(path: str, commit: dict) -> dict[int, list[str]]:
    """The data files of each numbered file of a part."""
    out: dict[int, list[str]] = {}
    for k, name, _ in commit["files"]:
        out.setdefault(k, []).append(os.path.join(path, "data", commit["folder"], name))
    return out


def bloom_files(path: str, commit: dict, numbers) -> list[str]:
    return [os.path.join(path, "data", commit["folder"], "bloom", name) for k, name, _ in commit["files"] if k in numbers]


def write_part(df: DataFrame, path: str, part: str | None = None, replaces: list[str] | None = None,
               key: str | None = None, files: int = 1) -> str:
    """Add ``df`` as a part; all of it becomes visible at once, or nothing.
    With a ``key`` the part has ``files`` files, each with a Bloom filter, and
    a key's hash names its file. Rows that bring numbers themselves (a long
    column ``FILE_COL``) are kept in files of these numbers, as many of one
    number as tasks hold rows of it."""
    part = part or uuid.uuid4().hex
    if not re.fullmatch(r"[\w.=-]+", part) or part.startswith("."):
        raise ValueError(f"a part's label has letters, digits, and _ . = - : {part!r}")
    df.sparkSession.dataSource.register(CommittedTable)
    small_batches(df.sparkSession)
    rows = _numbered(df, key, files) if key else df
    rows.write.format("docloom_table").mode("append").options(
        path=path, part=part, replaces=json.dumps(replaces or []), files=str(files)).save()
    return part


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, parts: list[dict] | None = None) -> DataFrame:
    """The rows of the visible parts (or of the commits given). ``schema`` is
    needed only where the table may have no part yet."""
    found = visible(path) if parts is None else parts
    if schema is None and not found:
        raise FileNotFoundError(f"{path} has no committed part")
    schema = schema or T.StructType.fromJson(json.loads(found[-1]["schema"]))
    files = [f for c in found for names in data_files(path, c).values() for f in names]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def vacuum(path: str) -> int:
    """Delete what no reader can see: replaced parts and the remains of failed
    attempts. Run it while nobody writes, and once readers of the replaced
    parts are done. Returns the number of folders deleted."""
    from pyarrow import fs as pafs
    fs, root = filesystem(path)
    found, shown = commits(path), {c["part"] for c in visible(path)}
    # a part goes before the one that hides it
    for c in sorted((c for c in found if c["part"] not in shown), key=lambda c: len(c["replaces"])):
        fs.delete_file(f"{root}/commits/{c['part']}.json")
    keep = {c["folder"] for c in found if c["part"] in shown}
    n = 0
    if _there(fs, f"{root}/data"):
        for info in fs.get_file_info(pafs.FileSelector(f"{root}/data")):
            if info.base_name not in keep:
                fs.delete_dir(info.path)
                n += 1
    return n


def _numbered(df: DataFrame, key: str, files: int) -> DataFrame:
    """``df`` with the helper columns of a keyed part, dealt so that a task writes one file."""
    h = F.xxhash64(key)
    df = df.withColumn(HASH_COL, h).withColumn(FILE_COL, file_of(F.col(HASH_COL), F.lit(files)))
    return df.repartitionById(files, F.col(FILE_COL).cast("int"))


def file_of(h, files):
    """Which of ``files`` files holds keys of hash ``h``: the hash's place on [0, files)."""
    return F.shiftrightunsigned(F.shiftrightunsigned(h, 33) * files.cast("long"), 31).cast("long")
