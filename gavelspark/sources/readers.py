"""Readers. Every schema is explicit; a malformed record fails the read."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from itertools import chain, groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavelspark.functions.decisions import ScoreCuts
from gavelspark.operators.labels import labelled_comments
from gavelspark.operators.sampling import sample_at_most
from gavelspark.schemas import COMMENT_SCHEMA, PROMPT_SCHEMA, SAFETY_ATTRIBUTES
from gavelspark.sources.digests import finished, resumed
from gavelspark.sources.storage import stage

#: A longer file is hashed stretch by stretch.
LONG_FILE = 512 << 20
STRETCH = 256 << 20
#: Files that Spark's text reader would unpack.
PACKED = r"(?i)\.(gz|bz2|deflate|lz4|snappy|zst|zstd|xz|lzo|passthrough)$"
MARK = b"\xef\xbb\xbf"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_comments(
    spark: SparkSession,
    path: str | list[str],
    *,
    limit: int | None = None,
    seed: int = 42,
    key: str | None = None,
    attributes: tuple[str, ...] = SAFETY_ATTRIBUTES,
    cuts: ScoreCuts = ScoreCuts(),
) -> DataFrame:
    """Scored comments: text, score and attributes only, labelled, down-sampled if larger
    than ``limit``. ``key`` names a unique id column to draw the sample by; without one it
    is drawn by the text."""
    wanted = [c for c in COMMENT_SCHEMA.fieldNames() if c in ("text", "toxicity", *attributes)]
    fields = [COMMENT_SCHEMA[c] for c in wanted]
    if key is not None:
        fields.append(T.StructField(key, T.LongType()))
    paths = [path] if isinstance(path, str) else path
    rows = spark.read.schema(T.StructType(fields)).parquet(*paths)
    return sample_at_most(
        labelled_comments(rows, cuts=cuts), limit, key=key or "text", seed=seed
    )


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines. Blank lines are skipped, a malformed line fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType = PROMPT_SCHEMA) -> DataFrame:
    """CSV with a header and quoted fields that may hold line breaks and doubled quotes.
    An empty string field is the empty string, quoted or not."""
    return (
        spark.read.schema(schema)
        .option("mode", "FAILFAST")
        .option("emptyValue", "")
        .csv(path, header=True, multiLine=True, escape='"', enforceSchema=False)
        .na.fill("")
    )


def refuse_test_split(frame: DataFrame) -> DataFrame:
    """Raise if the frame reads a file named as a test split (or a part file of a table
    folder named so). The names are known before any data is read."""
    for file in frame.inputFiles():
        folder, name = posixpath.split(file)
        if name.startswith("part-"):
            name = posixpath.basename(folder)
        if "test" in name.casefold():
            raise ValueError(f"refusing to train on a test split: {name}")
    return frame


def stream_table(spark: SparkSession, folder: str, name: str, *, max_files: int | None = None) -> DataFrame:
    """A Parquet table as a stream: a folder of files, or one file by its name."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    static = spark.read.parquet(path)
    reader = spark.readStream.schema(static.schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    files = static.inputFiles()
    if len(files) == 1 and posixpath.basename(files[0]) == f"{name}.parquet":
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return reader.parquet(path)


def unpaired_files(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """Recorded files whose hash differs from, or is missing in, the actual manifest."""
    found = actual.select("path", F.col("sha256").alias("actual_sha256"))
    return recorded.join(found, "path", "left").filter(
        ~F.col("sha256").eqNullSafe(F.col("actual_sha256"))
    )


def _pieces(reader: DataFrameReader, path: str, files: list[str]) -> DataFrame:
    """The bytes of ``files``, read in splits of lines: ``file``, ``start`` of the split, ``number``
    in it, ``length`` and ``piece``. Every line but a file's first has its line break before it."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, number = None, 0
        for batch in batches:
            here, first = list(zip(*(c.to_pylist() for c in batch.columns[:2]))), 0
            for split, rows in groupby(here):
                n = len(list(rows))
                number = number + 1 if split == at else 0
                at = split
                lines = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), batch.column(2).slice(first, n))
                piece = pc.binary_join(lines, pa.scalar(b"\n", pa.binary()))[0].as_py()
                if split[1] > 0 or number > 0:
                    piece = b"\n" + piece
                first += n
                yield pa.RecordBatch.from_pydict(
                    {
                        "file": [split[0]],
                        "start": pa.array([split[1]], pa.int64()),
                        "number": pa.array([number], pa.int64()),
                        "length": pa.array([len(piece)], pa.int64()),
                        "piece": pa.array([piece], pa.binary()),
                    }
                )

    lines = reader.format("text").option("lineSep", "\n").load(path).where(F.col("_metadata.file_path").isin(files))
    lines = lines.select("_metadata.file_path", "_metadata.file_block_start", F.col("value").cast("binary"))
    conf, name = lines.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, "1000")
    try:
        return stage(lines.mapInArrow(joined, "file string, start long, number long, length long, piece binary"))
    finally:
        conf.set(name, before)


def _long_hashes(reader: DataFrameReader, path: str, lengths: dict[str, int]) -> DataFrame:
    """``file`` and ``sha256`` of long files (``lengths``).

    SHA-256 is one chain, but its state can be handed on: a stretch of every file is hashed by
    one task, which begins with the state that the stretch before has left. The text reader
    leaves out a byte order mark and does not say whether the last line ends; the length does.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = chain.from_iterable(zip(b.column(0), b.column(1), b.column(2)) for b in batches)
        for file, of in groupby(rows, lambda r: r[0].as_py()):
            # the state comes first, under a start of -1
            state = next(of)[2].as_py()
            state = resumed(state, (piece.as_py() for _, _, piece in of))
            yield pa.RecordBatch.from_pydict({"file": [file], "state": pa.array([state], pa.binary())})

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [
                finished(resumed(s, [b"\n"] if tail else [])) for s, tail in zip(*(c.to_pylist() for c in batch.columns[1:]))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.string())], ["file", "sha256"])

    pieces = _pieces(reader, path, list(lengths))
    spark = pieces.sparkSession
    # one row for each file of more than LONG_FILE bytes
    read = {r["file"]: r["n"] for r in pieces.groupBy("file").agg(F.sum("length").alias("n")).collect()}
    missing = {file: length - read.get(file, 0) for file, length in lengths.items()}
    if wrong := [file for file, n in missing.items() if n not in (0, 1, len(MARK), len(MARK) + 1)]:
        raise ValueError("read in another length than listed: " + ", ".join(wrong[:5]))
    begun = [(file, resumed(None, [MARK] if n >= len(MARK) else []), n % len(MARK) == 1) for file, n in missing.items()]
    begun = spark.createDataFrame(begun, "file string, state binary, tail boolean")
    states = begun.select("file", "state")
    for start in range(0, max(lengths.values()), STRETCH):
        stretch = pieces.where(F.col("start").between(start, start + STRETCH - 1)).select("file", "start", "number", "piece")
        before = states.select("file", F.lit(-1).cast("long").alias("start"), F.lit(0).cast("long").alias("number"), F.col("state").alias("piece"))
        dealt = before.unionByName(stretch).repartition(4 * len(lengths), "file").sortWithinPartitions("file", "start", "number")
        states = stage(dealt.select("file", "start", "piece").mapInArrow(hashed, "file string, state binary"))
    return states.join(begun.select("file", "tail"), "file").select("file", "state", "tail").mapInArrow(ended, "file string, sha256 string")


def file_manifest(spark: SparkSession, path: str, *, pattern: str | None = None) -> DataFrame:
    """Path below ``path``, size and SHA-256 of every file; files are spread over the tasks.

    Files of the same name in different folders stay apart. A manifest of one file has its
    name. A file of more than ``LONG_FILE`` bytes is read in splits and hashed by one task for
    each ``STRETCH``, so no task reads it whole; its bytes are written once more to the shared
    folder. A single line (bytes up to a line break) and a long packed file (``PACKED``) are
    still read by one task, which limits these to 2 GiB. Empty files are not listed.
    """

    def reader() -> DataFrameReader:
        made = spark.read.option("recursiveFileLookup", "true")
        return made.option("pathGlobFilter", pattern) if pattern else made

    root = "/" + path.split("://", 1)[-1].removeprefix("file:").strip("/") + "/"
    start = F.instr("path", root)
    below = F.substring(F.col("path"), start + len(root), F.length("path"))
    base = F.element_at(F.split("path", "/"), -1)
    name = F.when(start > 0, below).otherwise(base).alias("path")
    files = reader().format("binaryFile").load(path)
    file, size = F.col("_metadata.file_path").alias("file"), F.col("length")
    # one row for each file of more than LONG_FILE bytes; without the content no file is read
    long = files.where(size > LONG_FILE).select(file, name, "length")
    packed = [r["file"] for r in long.where(F.col("file").rlike(PACKED)).collect()]
    lengths = {r["file"]: r["length"] for r in long.collect() if r["file"] not in packed}
    columns = [name, "length", F.sha2("content", 256).alias("sha256")]
    if not lengths:
        return files.select(*columns)
    # by length and name: what they leave out is not opened
    whole = files.where(size <= LONG_FILE).select(*columns)
    if packed:
        whole = whole.unionByName(files.where(F.col("_metadata.file_path").isin(packed)).select(*columns))
    return whole.unionByName(long.join(_long_hashes(reader(), path, lengths), "file").drop("file"))


def verify_manifest(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """Raise if any recorded file is missing or changed."""
    wrong = unpaired_files(recorded, actual).select("path").limit(5).collect()
    if wrong:
        raise ValueError("SHA-256 does not match for: " + ", ".join(r["path"] for r in wrong))
    return recorded
