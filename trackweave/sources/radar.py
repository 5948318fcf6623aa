"""Radar track files (``.lt6``), alone or in ZIP archives, as ``tracks`` and ``trackpoints``.

Files are read by Spark (any file system it knows); a task parses one file at a time and writes rows as it goes.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackweave.functions.ranks import placed

#: The header's fields in file order, and those that the short header lacks.
FULL = ("eventid", "trackstart_date", "trackstart_time", "trackend_time", "airportid", "acid", "owner_name", "aircrafttype", "aircraft_category", "beacon", "adflag", "waypoint", "other_port", "runwayname", "min_alt", "max_alt", "min_range", "max_range")
OPTIONAL = ("owner_name", "waypoint", "other_port")
SHORT = tuple(f for f in FULL if f not in OPTIONAL)
NUMBERS = ("min_alt", "max_alt", "min_range", "max_range")
#: Blocks that a task holds as rows.
BLOCKS = 256
SCHEMA = "source_file string, block int, opnum string, " + ", ".join(f"{f} string" for f in FULL) + ", count string, lines array<string>, corrupt string"


def _lines(text: str | bytes) -> Iterator[str]:
    """The lines of ``splitlines``, taken piece by piece, so that a long file's lines never stand in memory together."""
    at, feed = 0, b"\n" if isinstance(text, bytes) else "\n"
    while at < len(text):
        end = text.find(feed, at) + 1 or len(text)
        piece = text[at:end]
        yield from (piece.decode("utf-8", "replace") if isinstance(piece, bytes) else piece).splitlines()
        at = end


def _cut_at_tracks(text: str | bytes) -> Iterator[tuple[list[str], list[str]]]:
    """(words of the ``TRACK`` line, stripped lines) of each block."""
    head, own = None, []
    for line in _lines(text):
        if line.startswith("TRACK"):
            if head is not None:
                yield head, own
            head, own = line.split(), []
        elif head is not None:
            own.append(line.strip())
    if head is not None:
        yield head, own


def blocks(name: str, text: str | bytes) -> Iterator[dict]:
    """A row for each ``TRACK`` block of a text (bytes are UTF-8): header fields by the layout that fits, the count line and the point lines.

    The header is 18 lines (15 in the short layout) before the count line or the first point; which one it is, is told by
    where the first line with commas stands.  A block of another shape keeps its lines in ``corrupt``.
    """
    for number, (head, own) in enumerate(_cut_at_tracks(text)):
        first = next((i for i, line in enumerate(own) if "," in line), len(own))
        layout, counted = None, False
        for fields in (FULL, SHORT):
            if first == len(fields) + 1 or (first == len(own) and len(own) in (len(fields), len(fields) + 1)):
                layout, counted = fields, len(own) > len(fields)
                break
            if first == len(fields):
                layout = fields
                break
        row = {"source_file": name, "block": number, "opnum": head[1] if len(head) > 1 else None, "count": None, "lines": [], "corrupt": None}
        if layout is None:
            yield row | {"corrupt": "\n".join(own)}
            continue
        row |= {f: own[i] or None for i, f in enumerate(layout)}
        if counted:
            row["count"] = own[len(layout)] or None
        rest = own[len(layout) + counted :]
        if row["count"] and row["count"].isdigit() and int(row["count"]) > 0:
            rest = rest[: int(row["count"])]
        yield row | {"lines": [line for line in rest if "," in line]}


def _batched(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    """Blocks in batches of ``BLOCKS``."""
    kinds = [pa.field(c.split()[0], pa.list_(pa.string()) if "array" in c else pa.int32() if c.endswith(" int") else pa.string()) for c in SCHEMA.split(", ")]
    while found := list(islice(rows, BLOCKS)):
        yield pa.RecordBatch.from_pylist(found, schema=pa.schema(kinds))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of batches, one copied at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(column[i].as_py() for column in batch.columns)


def _named(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def read_files(spark: SparkSession, paths: list[str] | str, pattern: str = "*.lt6") -> DataFrame:
    """Raw blocks of ``.lt6`` files or folders of them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(paths).select("path", "content")
    return files.mapInArrow(lambda batches: (out for path, content in _each(batches) for out in _batched(blocks(_named(path), content))), SCHEMA)


def archive_blocks(files: DataFrame, members: list[str] | None = None) -> DataFrame:
    """Raw blocks of the ``.lt6`` members of ZIP archives (path, content); of the named ones only, if given (``member`` of every
    archive, or ``archive.zip/member``).

    A first step cuts archives into members without inflating them; the members are dealt to all tasks, which inflate and read one at a
    time.  Missing members are skipped; an archive, or a member, that can't be read is one corrupt block.
    """
    wanted = None if members is None else set(members)
    schema = pa.schema([("name", pa.string()), ("method", pa.int32()), ("data", pa.binary())])

    def cut_up(path: str, content: bytes) -> Iterator[tuple[str, int, bytes]]:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for i in z.infolist():
                    name = i.filename
                    if not name.endswith(".lt6") or not (wanted is None or name in wanted or _named(name) in wanted or f"{_named(path)}/{_named(name)}" in wanted):
                        continue
                    head = content[i.header_offset : i.header_offset + 30]
                    start = i.header_offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")
                    label = f"{_named(path)}/{_named(name)}"
                    if i.compress_type in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) and not i.flag_bits & 1:
                        yield label, i.compress_type, content[start : start + i.compress_size]
                        continue
                    try:
                        yield label, zipfile.ZIP_STORED, z.read(i)
                    except (RuntimeError, zipfile.BadZipFile, OSError, EOFError, ValueError) as broken:
                        yield label, -1, str(broken).encode()
        except (zipfile.BadZipFile, zlib.error) as broken:
            yield _named(path), -2, str(broken).encode()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, content in _each(batches):
            for name, method, data in cut_up(path, content):
                yield pa.RecordBatch.from_pylist([{"name": name, "method": method, "data": data}], schema=schema)

    def text(method: int, data: bytes) -> str | bytes:
        if method == -2:
            return f"TRACK\nunreadable archive: {data.decode()}"
        if method == -1:
            return f"TRACK\nunreadable member: {data.decode()}"
        try:
            return zlib.decompress(data, -15) if method == zipfile.ZIP_DEFLATED else data
        except zlib.error as broken:
            return f"TRACK\nunreadable member: {broken}"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, method, data in _each(batches):
            yield from _batched(blocks(name, text(method, data)))

    cut_ = files.select("path", "content").mapInArrow(split, "name string, method int, data binary")
    return cut_.repartition(F.xxhash64("name")).mapInArrow(read, SCHEMA)


def archive_files(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, content) of ZIP files or of those in folders."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(paths).select("path", "content")


def read_archives(spark: SparkSession, paths: list[str] | str, members: list[str] | None = None) -> DataFrame:
    return archive_blocks(archive_files(spark, paths), members)


def lt6_blocks(tracks: DataFrame, points: DataFrame) -> DataFrame:
    """``value``: the text of each track's block in the short layout, for ``write.text``; nulls are blank lines."""
    packed = points.groupBy("track_id").agg(F.sort_array(F.collect_list(F.struct("seq", F.concat_ws(",", *(F.col(c).cast("string") for c in "xyzvt")).alias("line")))).alias("p"))
    have = set(tracks.columns)
    header = [F.coalesce(F.date_format("trackstart_date", "MM/dd/yyyy") if f == "trackstart_date" and f in have else F.col(f).cast("string") if f in have else F.lit(None), F.lit("")) for f in SHORT]
    body = F.array_join(F.transform("p", lambda q: q["line"]), "\n")
    return tracks.join(packed, "track_id").select(F.concat_ws("\n", F.concat(F.lit("TRACK "), F.col("track_id").cast("string")), *header, F.size("p").cast("string"), body).alias("value"))


def archive_members(files: DataFrame) -> DataFrame:
    """archive, member, size, compressed of every ``.lt6`` member of ZIP archives (path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                if not zipfile.is_zipfile(io.BytesIO(bytes(content))):
                    continue
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    info = sorted((i for i in z.infolist() if i.filename.endswith(".lt6")), key=lambda i: i.filename)
                    yield pd.DataFrame({"archive": _named(path), "member": [i.filename for i in info], "size": [i.file_size for i in info], "compressed": [i.compress_size for i in info]})

    return files.select("path", "content").mapInPandas(run, "archive string, member string, size long, compressed long")


def archive_totals(members: DataFrame) -> DataFrame:
    """archive, members, size, compressed of each archive and (archive null) of all."""
    return members.rollup("archive").agg(F.count("*").alias("members"), F.sum("size").alias("size"), F.sum("compressed").alias("compressed"))


def range_members(first: int, last: int, prefix: str = "2006010") -> list[str]:
    """Names of the days' files from ``first`` to ``last``."""
    return [f"{prefix}{n}.lt6" for n in range(first, last + 1)]


def read_tracks(spark: SparkSession, mode: str, paths: list[str] | str, *, members: list[str] | None = None, first: int = 1, last: int = 9, limit: int | None = None) -> DataFrame:
    """Raw blocks by mode: files, archive, multiple, range, or table (Parquet made by ``write_tracks``)."""
    if mode == "files":
        return read_files(spark, paths)
    if mode in ("archive", "multiple"):
        return read_archives(spark, paths, members)
    if mode == "range":
        return read_archives(spark, paths, range_members(first, last))
    if mode == "table":
        out = spark.read.parquet(paths if isinstance(paths, str) else paths[0])
        return out if limit is None else out.orderBy("load_seq" if "load_seq" in out.columns else "track_id").limit(limit)
    raise ValueError(f"unknown mode {mode}")


def read_default(spark: SparkSession, config: str, table: str | None = None) -> DataFrame:
    """The stored table if it has rows, else what a JSON file names: mode ``files`` (files) or ``archive`` (archive, files); paths
    without a root start at the JSON file's folder."""
    if table is not None:
        stored = spark.read.parquet(table)
        if stored.limit(1).count():
            return stored
    c = spark.read.schema("mode string, files array<string>, archive string").json(config, multiLine=True).first()
    base = config.rsplit("/", 1)[0] if "/" in config else "."
    whole = lambda path: path if path.startswith("/") or "://" in path else f"{base}/{path}"
    if c.mode == "archive":
        return read_archives(spark, whole(c.archive), c.files)
    return read_tracks(spark, c.mode, [whole(f) for f in c.files])


def tracks(raw: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row per track with typed header fields; of a repeated track_id the last in load order, with the number of copies.

    Load order is that of the files in ``order``, then of the others by name, then by place in the file.  Blank fields are null;
    altitudes and ranges are whole numbers or null.
    """
    number = lambda c: F.when(F.col(c).rlike("^[0-9]+$"), F.col(c).try_cast("long"))
    names = raw.select("source_file").distinct().withColumn("all", F.lit(0))
    listed = raw.sparkSession.createDataFrame([(n, f) for n, f in enumerate(order or [""])], "turn int, source_file string").groupBy("source_file").agg(F.min("turn").alias("turn"))
    names = names.join(listed, "source_file", "left").withColumn("turn", F.coalesce("turn", F.lit(1 << 30)))
    names = placed(names, "all", "turn", "source_file").select("source_file", F.col("__place").alias("file"))
    base = raw.join(names, "source_file").withColumns({"load_seq": F.shiftleft(F.col("file"), 32) + F.col("block"), "track_id": F.concat_ws("_", "opnum", F.coalesce("eventid", F.lit("0")))})
    out = base.select("track_id", "load_seq", "source_file", F.col("opnum").try_cast("long").alias("opnum"), *(number(f).alias(f) if f in NUMBERS else F.to_date(F.try_to_timestamp("trackstart_date", F.lit("MM/dd/yyyy"))).alias(f) if f == "trackstart_date" else F.col(f) for f in FULL), "lines", F.col("corrupt"))
    last = Window.partitionBy("track_id").orderBy(F.desc("load_seq"))
    return out.withColumns({"copies": F.count("*").over(Window.partitionBy("track_id")), "__r": F.row_number().over(last)}).where("__r = 1").drop("__r")


def trackpoints(track: DataFrame) -> DataFrame:
    """track_id, seq, x, y, z, v, t of the point lines that are five numbers; others are left out."""
    p = track.select("track_id", F.posexplode("lines").alias("at", "line")).withColumn("f", F.transform(F.split("line", ","), lambda s: F.trim(s).try_cast("double")))
    p = p.where("size(f) = 5 and forall(f, v -> v is not null)")
    return p.select("track_id", F.row_number().over(Window.partitionBy("track_id").orderBy("at")).cast("long").alias("seq"), *(F.col("f")[i].alias(c) for i, c in enumerate("xyzvt")))


def zones(spark: SparkSession, path: str) -> DataFrame:
    """id, name and bounds of the restricted zones in a JSON file; no rows if there is no file or no zone."""
    bounds = ", ".join(f"{m}_{c}: double" for c in "xyz" for m in ("min", "max"))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "id string, name string, " + bounds.replace(":", ""))
    raw = spark.read.schema(f"restricted_zones array<struct<id: string, name: string, bounds: struct<{bounds}>>>").json(path, multiLine=True)
    return raw.select(F.explode("restricted_zones").alias("z")).select(F.coalesce("z.id", F.lit("unknown")).alias("id"), F.coalesce("z.name", F.lit("restricted zone")).alias("name"), "z.bounds.*")
