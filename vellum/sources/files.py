"""Readers and writers of the pipeline's files."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions.text import lossy_text, strip
from vellum.operators.pairs import not_yet
from vellum.operators.ranks import batches, sample
from vellum.shared import materialize, shared_dir, ship

#: Schemas of the pipeline's tables; nothing is inferred.
EXCERPT = "id string, source string, text string, word_count int"
PAIR = "id string, clean string, sloppy string, teacher string"
KEPT_PAIR = PAIR + ", ner_overlap double, sem_sim double"
TEXT = "text string"
#: Names that are taken for the text, in this order, before the longest value decides.
TEXT_NAMES = ("TEXT", "text", "content", "body")


def read_books(spark: SparkSession, folder: str) -> DataFrame:
    """``path, text`` of every ``*.txt`` under a folder; undecodable bytes are dropped, files that can't be read
    skipped. An empty file gives no row, as it gives no excerpt."""
    files = spark.read.format("binaryFile").option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(folder)
    return files.select("path", lossy_text(F.col("content")).alias("text"))


def in_path_order(df: DataFrame) -> DataFrame:
    """Rows by ``path``, part by part."""
    return df.orderBy(F.split("path", "/"))


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows of a source in a stated order: a row cap whose rows don't change from run to run."""
    return df.orderBy(*order).limit(n)


def text_column(df: DataFrame) -> str | None:
    """The column that holds the text: a known name whose first value is a string, else the longest string of the first row."""
    strings = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    row = df.select(*(f"`{c}`" for c in strings)).first() if strings else None
    if row is None:
        return None
    held = {c: row[c] for c in strings if row[c] is not None}
    return next((c for c in TEXT_NAMES if c in held), max(held, key=lambda c: len(held[c])) if held else None)


def numbered(df: DataFrame, order: str) -> DataFrame:
    """``name, text`` rows for a file-per-row sink: ``00000.txt`` and on by the unique ``order``.

    Numbers come from ordered partitions and their sizes, so nothing is sorted in one task.
    """
    rows = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id())
    rows = materialize(rows)  # else the partitions' numbers could change between the two uses
    sizes = {r["_p"]: r["count"] for r in rows.groupBy("_p").count().collect()}  # one row a partition
    base, n = {}, 0
    for p in sorted(sizes):
        base[p], n = n, n + sizes[p]
    start = F.create_map(*(F.lit(x) for kv in base.items() for x in kv))[F.col("_p")] if base else F.lit(0)
    at = start + F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1
    return rows.select(F.format_string("%05d.txt", at).alias("name"), "text")


def _system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that a path or URI names, and the path there."""
    return fs.FileSystem.from_uri(path if ":/" in path else Path(path).resolve().as_uri())


def write_files(df: DataFrame, folder: str) -> int:
    """Write each row of ``name, text`` as a file of UTF-8 text, and return how many were written.

    The folder is one that all executors share. A task that is run again writes its files again, with the same content;
    characters that UTF-8 can't hold are dropped, and a null text is an empty file.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = _system(folder)
        system.create_dir(at, recursive=True)
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with system.open_output_stream(f"{at}/{name}") as f:
                    f.write((text or "").encode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return df.select("name", "text").mapInArrow(run, "n long").groupBy().sum("n").first()[0] or 0


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; what a line lacks is null."""
    return spark.read.schema(schema).json(path)


def read_splits(spark: SparkSession, paths: dict[str, str], schema: str = TEXT) -> DataFrame:
    """Files of named splits as one table with ``split``."""
    each = [read_jsonl(spark, p, schema).withColumn("split", F.lit(name)) for name, p in paths.items()]
    out = each[0]
    for df in each[1:]:
        out = out.unionByName(df)
    return out


_GAP = re.compile(r"[ \t\r\n]*")


def entries(text: str) -> Iterator[tuple[str, str]]:
    """Key and JSON of each entry of one object's text, one after the other; a ``ValueError`` if it is anything else."""
    decoder = json.JSONDecoder()
    gap = lambda i: _GAP.match(text, i).end()
    at = gap(0)
    if text[at : at + 1] != "{":
        raise ValueError("a keyed file is one JSON object")
    at = gap(at + 1)
    more = text[at : at + 1] != "}"
    while more:
        key, end = decoder.raw_decode(text, at)
        at = gap(end)
        if not isinstance(key, str) or text[at : at + 1] != ":":
            raise ValueError(f"no key at character {at} of a keyed file")
        start = gap(at + 1)
        _, end = decoder.raw_decode(text, start)
        yield key, text[start:end]
        at = gap(end)
        more = text[at : at + 1] == ","
        if more:
            at = gap(at + 1)
    if text[at : at + 1] != "}" or gap(at + 1) != len(text):
        raise ValueError(f"a keyed file doesn't end where its object does, at character {at}")


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for text in b.column(0).to_pylist():
            ids, parts, size = [], [], 0
            for key, part in entries(text):
                ids.append(key)
                parts.append(part)
                size += len(part)
                if size > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(parts, pa.string())], ["id", "entry"])
                    ids, parts, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(parts, pa.string())], ["id", "entry"])


def read_keyed_json(spark: SparkSession, path: str) -> DataFrame:
    """``id, entry`` of files that are one object of entries by id. Entries are variants, so no column is made of an id.

    A file is read by one task, entry by entry: no value is larger than an entry, and the file's size has no limit but that
    of a text (2 GB). A file that isn't one JSON object fails the job; nothing is dropped. Of a repeated key each entry is a row.
    """
    ship(spark)
    if not _size(spark, path):  # a scan passes over empty files
        raise ValueError(f"{path} is no keyed file: it is empty")
    whole = spark.read.text(path, wholetext=True)
    return whole.mapInArrow(_entries, "id string, entry string").select("id", F.parse_json("entry").alias("entry"))


def write_keyed_json(df: DataFrame, path: str) -> None:
    """Rows ``id, entry`` (JSON texts) as one object of entries by id, in order of id. One file is one task; it sorts on disk."""
    rows = df.where("id is not null and entry is not null").select("id", "entry")
    first = rows.agg(F.min("id").alias("first"))
    key = F.regexp_extract(F.to_json(F.struct(F.col("id").alias("k"))), r'(?s)^\{"k":(.*)\}$', 1)
    lines = rows.crossJoin(F.broadcast(first)).select(F.lit(1).alias("o"), "id", F.concat(F.when(F.col("id") == F.col("first"), "").otherwise(","), key, F.lit(": "), "entry").alias("value"))  # one row
    ends = df.sparkSession.createDataFrame([(0, "", "{"), (2, "", "}")], "o int, id string, value string")
    lines.unionByName(ends).repartition(1).sortWithinPartitions("o", "id").select("value").write.mode("overwrite").text(path)


def write_jsonl(df: DataFrame, path: str, overwrite: bool = True) -> None:
    """One object a line; null fields are left out. Without ``overwrite`` what is there stays."""
    df.write.mode("overwrite" if overwrite else "ignore").option("ignoreNullFields", True).json(path)


def append_new(df: DataFrame, path: str, key: str, schema: str, size: int = 50_000) -> int:
    """Append the rows of ``df`` whose key isn't in the file yet, batch by batch; a run that is cut off loses one batch.

    Returns the number of batches. Batches are appended, never the whole written again; what is to do is written once, a
    folder a batch, so that each batch reads only its own rows.
    """
    spark = df.sparkSession
    todo = batches(not_yet(df, read_jsonl(spark, path, schema), key) if there(spark, path) else df, key, size)
    kept = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    todo.repartition("batch").write.partitionBy("batch").parquet(kept)
    n = spark.read.schema(todo.schema).parquet(kept).agg(F.max("batch")).first()[0]
    n = 0 if n is None else int(n) + 1
    for b in range(n):
        spark.read.schema(df.schema).parquet(f"{kept}/batch={b}").write.mode("append").option("ignoreNullFields", True).json(path)
    return n


def there(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists, on whatever file system its path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _size(spark: SparkSession, path: str) -> int:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def existing(spark: SparkSession, paths: dict[str, str], wanted: list[str] | None = None) -> dict[str, str]:
    """Of named files those that are wanted (all, if none are named) and there: teachers to ask, fixtures to test with."""
    return {k: p for k, p in paths.items() if (wanted is None or k in wanted) and there(spark, p)}


def write_report(df: DataFrame, path: str) -> dict:
    """A report's one row as an indented JSON file."""
    row = df.first().asDict(recursive=True)
    system, at = _system(path)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    with system.open_output_stream(at) as f:
        f.write(json.dumps(row, indent=2, default=str).encode())
    return row


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """A column as lines of text, in the order of ``df``."""
    df.select(F.col(column).alias("value")).coalesce(1).write.mode("overwrite").text(path)  # a list of phrases, made by a limit


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value``: lines stripped, blank ones left out."""
    return spark.read.text(path).select(strip(F.col("value")).alias("value")).where("value <> ''")


def sampled_heads(df: DataFrame, key: str, text: str, n: int, chars: int, seed: int = 42) -> DataFrame:
    """``n`` rows in seeded order, their texts cut to the first characters."""
    return sample(df, key, n, seed).withColumn(text, F.substring(text, 1, chars))
