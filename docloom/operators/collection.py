"""Vector collection and other sinks (SNK-1..7).

A collection is a committed table (``sources/committed.py``) below
``root/name`` with the schema ``(chunk_id, embedding, text, metadata)``. An add
becomes visible at once or not at all, and a second ingest of the same input
inserts 0 rows. Adding is insert-if-absent by ``chunk_id``: within a batch the
least ``(doc_id, pos)`` wins, ids already stored are left untouched.

An add does not read what is stored. A part of n files keeps an id in the file
that the id's hash names, so every id of a batch has one file per part that may
hold it, and that file's Bloom filter says whether it does. Only files whose
filter answers yes are read, their ids alone. The number of files of a part
follows its rows, and so do the write tasks. Small parts are merged: as soon as
``FAN`` parts are of one order of size, one part takes their place, so the
number of parts grows with the logarithm of the rows.

A collection has one writer at a time (readers any time): two adds at once
could both insert an id that is new to both.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.session import materialize
from docloom.sources import committed as CT

#: Rows of a data file, and parts of one order of size that are merged.
FILE_ROWS = 50_000
FAN = 8

COLLECTION_SCHEMA = T.StructType([
    T.StructField("chunk_id", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("text", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def open_collection(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Get or create a named collection; a second open never drops rows."""
    path = os.path.join(root, name)
    if not _exists(spark, path):
        fs, base = CT.filesystem(path)
        fs.create_dir(base, recursive=True)
    return CT.read_table(spark, path, COLLECTION_SCHEMA)


def first_per_chunk(rows: DataFrame) -> DataFrame:
    """One row per chunk id: the least (doc_id, pos). ``min_by`` combines on
    the map side (a sort aggregate), so a chunk text repeated in a third of
    all documents is reduced per partition before any shuffle."""
    payload = [c for c in rows.columns if c != "chunk_id"]
    best = rows.groupBy("chunk_id").agg(F.min_by(F.struct(*payload), F.struct("doc_id", "pos")).alias("_r"))
    return best.select("chunk_id", *[F.col(f"_r.{c}").alias(c) for c in payload])


def to_collection_rows(chunks: DataFrame, metadata_cols: tuple[str, ...] = ("source",)) -> DataFrame:
    """chunks(chunk_id, doc_id, pos, text, embedding, source...) -> M5 rows;
    without an embedding where the chunks have none yet."""
    vec = [F.col("embedding").cast("array<float>").alias("embedding")] if "embedding" in chunks.columns else []
    md = F.create_map(*[x for c in metadata_cols for x in (F.lit(c), F.col(c).cast("string"))])
    return chunks.select("chunk_id", "doc_id", "pos", *vec, "text", md.alias("metadata"))


def _in_filters(key, ids, bloom) -> Iterator:
    """The ids of one file's share of a batch against the file's filters."""
    import numpy as np
    import pyarrow as pa
    h = ids["h"].to_numpy()
    hits = np.zeros(len(h), bool)
    for b in bloom["bloom"].to_pylist():
        hits |= CT.in_bloom(b, h)
    return pa.table({"part": [key[0].as_py()], "file": pa.array([key[1].as_py()], pa.int64()),
                     "hits": pa.array([int(hits.sum())], pa.int64())})


def files_to_read(path: str, ids: DataFrame, batch_rows: int) -> list[str]:
    """The data files that may hold an id of ``ids`` (chunk_id). A part with
    fewer rows than the batch is read whole (its ids, that is); of a larger one
    the files that a filter names."""
    spark, parts = ids.sparkSession, [c for c in CT.visible(path) if c["files"]]
    out = [f for c in parts if c["rows"] <= batch_rows for names in CT.data_files(path, c).values() for f in names]
    large = {c["part"]: c for c in parts if c["rows"] > batch_rows}
    if not large or not batch_rows:
        return out
    of = F.array(*[F.struct(F.lit(p).alias("part"), F.lit(c["n"]).alias("n")) for p, c in large.items()])  # few parts: they are merged
    probe = ids.select(F.xxhash64("chunk_id").alias("h"), F.explode(of).alias("of")).select(
        "h", "of.part", CT.file_of(F.col("h"), F.col("of.n")).alias("file"))
    probe = materialize(probe, "probe")
    touched: dict[str, set] = {}
    for r in probe.select("part", "file").distinct().collect():                 # at most the files that the commits list
        touched.setdefault(r["part"], set()).add(r["file"])
    blooms = spark.read.schema("part string, file bigint, bloom binary").parquet(
        *[f for p, k in touched.items() for f in CT.bloom_files(path, large[p], k)])
    found = probe.groupBy("part", "file").cogroup(blooms.groupBy("part", "file")).applyInArrow(
        _in_filters, "part string, file bigint, hits bigint").where("hits > 0").collect()
    for r in found:
        out += CT.data_files(path, large[r["part"]]).get(r["file"], [])
    return out


def new_ids(path: str, rows: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, pos) of the rows that a batch adds: of every id that
    the collection does not hold yet the least (doc_id, pos)."""
    least = materialize(rows.groupBy("chunk_id").agg(F.min(F.struct("doc_id", "pos")).alias("_f")).select(
        "chunk_id", F.col("_f.doc_id").alias("doc_id"), F.col("_f.pos").alias("pos")), "batch-ids")
    read = files_to_read(path, least, least.count())
    if not read:
        return least
    stored = rows.sparkSession.read.schema(COLLECTION_SCHEMA).parquet(*read).select("chunk_id")
    return materialize(least.join(stored, "chunk_id", "left_anti"), "new-ids")


def collection_add(spark: SparkSession, root: str, name: str, rows: DataFrame, part: str | None = None,
                   retry: bool = False, file_rows: int = FILE_ROWS, fan: int = FAN,
                   embed: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Add the batch's new chunk ids as a new part; returns the number
    inserted. A ``part`` label that is stored already is refused: it holds
    other rows. ``retry=True`` says that it is the same batch again (a replayed
    stream batch): if its part is there, nothing is left to do. ``embed`` gives
    the rows that are new their embedding, for batches that come without."""
    path = os.path.join(root, name)
    stored = CT.find_commit(path, part) if part else None
    if stored:
        if retry:
            return stored["rows"]
        raise ValueError(f"part {part!r} is stored already")
    rows = materialize(rows, "batch")                     # made once; read for its ids, then for its payload
    fresh = new_ids(path, rows)
    n = fresh.count()
    if n or part:
        # one row an id even if a batch repeats (chunk_id, doc_id, pos): such rows are equal
        added = rows.join(fresh, ["chunk_id", "doc_id", "pos"], "left_semi").dropDuplicates(["chunk_id"])
        added = embed(added) if embed else added
        CT.write_part(added.select(*COLLECTION_SCHEMA.fieldNames()), path, part, key="chunk_id", files=-(-n // file_rows) or 1)
        compact(spark, root, name, file_rows, fan)
    return n


def compact(spark: SparkSession, root: str, name: str, file_rows: int = FILE_ROWS, fan: int = FAN) -> list[str]:
    """Merge parts of one order of size wherever there are ``fan`` of them; a
    row is rewritten once an order. Returns the labels of the parts made."""
    path, made = os.path.join(root, name), []
    while True:
        orders: dict[int, list[dict]] = {}
        for c in CT.visible(path):
            order = 0
            while c["rows"] > file_rows * fan ** order:
                order += 1
            orders.setdefault(order, []).append(c)
        ready = [parts for _, parts in sorted(orders.items()) if len(parts) >= max(fan, 2)]
        if not ready:
            return made
        parts = ready[0]
        n = sum(c["rows"] for c in parts)
        made.append(CT.write_part(CT.read_table(spark, path, COLLECTION_SCHEMA, parts), path, f"merged-{uuid.uuid4().hex}",
                                  [c["part"] for c in parts], key="chunk_id", files=-(-n // file_rows) or 1))


def write_clean_text(df: DataFrame, path: str, stem_col: str = "stem", text_col: str = "text") -> None:
    """Persist cleaned text, one value per file stem (parquet, not one file per row)."""
    df.select(stem_col, text_col).write.mode("overwrite").parquet(path)


def append_failures(failed: DataFrame, path: str, part: str | None = None) -> None:
    """Quarantine table of failed documents with their reason (a committed
    table). A ``part`` that is there already is the same batch again."""
    if not (part and CT.find_commit(path, part)):
        CT.write_part(failed, path, part)


def publish_testset(df: DataFrame, path: str) -> None:
    """A committed table of one part; a second publication is refused and
    leaves the first as it is."""
    if CT.commits(path):
        raise FileExistsError(f"{path} is published already")
    CT.write_part(df, path, "published")


def ingest_report(staged: DataFrame, reason_col: str = "fail_reason", chunks_col: str = "_chunks") -> DataFrame:
    """Totals from the document-level staging frame: files seen, failed,
    chunks cut (one pass, partial aggregates only). ``chunks_written`` counts
    the chunks of good documents before equal ids are joined; ``IngestResult.
    inserted`` counts what the collection gained."""
    ok = F.col(reason_col).isNull()
    return staged.agg(
        F.count(F.lit(1)).alias("files_seen"),
        F.count(F.col(reason_col)).alias("files_failed"),
        F.coalesce(F.sum(F.when(ok, F.size(chunks_col))), F.lit(0)).cast("bigint").alias("chunks_written"),
    )
