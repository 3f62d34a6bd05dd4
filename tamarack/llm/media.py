"""Media columns over archive directories (operator 6).

``store`` writes the payload of every text as an 8-bit grayscale PNG, losslessly, into uncompressed
tar archives of a shared folder, one archive to an input partition. ``MediaArchiveSource`` is a Spark data source over such a folder: it plans
byte ranges of archives as partitions from the archives' member indexes, reads the members that
begin in its range by offset, and streams them in Arrow batches of bounded size. Each member is
read and checked on its own; one that fails is read again from its offset, and one that keeps
failing becomes a row with ``error`` set, without hurting its neighbours.

Folders are reached through pyarrow's file systems by URI (file, hdfs, s3, gs), never by a path
that only one machine has.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tamarack.llm.common import table, text_batches
from tamarack.operators.storage import new_path

ROW = 192
FILL = b" "
LEVEL = 3
TAIL = 16
RANGE_BYTES = 32 << 20
BATCH_BYTES = 8 << 20
TRIES = 3
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes, with spaces up to a positive multiple of ROW."""
    data = (text or "").encode()
    return data + FILL * (max(1, -(-len(data) // ROW)) * ROW - len(data))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """An 8-bit grayscale image, ROW samples wide, unfiltered rows."""
    height = len(payload) // ROW
    lines = np.zeros((height, ROW + 1), dtype=np.uint8)
    lines[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(height, ROW)
    header = struct.pack(">IIBBBBB", ROW, height, 8, 0, 0, 0, 0)
    packed = zlib.compress(lines.tobytes(), LEVEL)
    parts = [_chunk(b"IDAT", packed[i : i + (1 << 24)]) for i in range(0, len(packed), 1 << 24)]
    return _SIGNATURE + _chunk(b"IHDR", header) + b"".join(parts) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> np.ndarray:
    """The samples (height, width) of an image that to_png made; ValueError if it is damaged."""
    if not media.startswith(_SIGNATURE):
        raise ValueError("no PNG signature")
    at, packed, shape = len(_SIGNATURE), [], None
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(kind + data):
            raise ValueError(f"damaged {kind!r} chunk")
        if kind == b"IHDR":
            shape = struct.unpack(">II", data[:8])
        elif kind == b"IDAT":
            packed.append(data)
        at += 12 + size
    if shape is None or kind != b"IEND":
        raise ValueError("cut off")
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows aren't read")
    return lines[:, 1:]


def features_of(samples: np.ndarray) -> str:
    """Mean, deviation and entropy of the samples, and a 64-bit hash of which column bands are bright."""
    counts = np.bincount(samples.reshape(-1), minlength=256).astype(np.float64)
    share = counts[counts > 0] / counts.sum()
    levels = np.arange(256)
    mean = float((counts * levels).sum() / counts.sum())
    spread = float(np.sqrt((counts * (levels - mean) ** 2).sum() / counts.sum()))
    entropy = float(-(share * np.log2(share)).sum())
    bands = samples.reshape(-1, 64, ROW // 64).mean(axis=(0, 2), dtype=np.float64)
    bits = sum(1 << i for i, b in enumerate(bands) if b > bands.mean())
    return f"mean={mean:.4f};std={spread:.4f};entropy={entropy:.4f};bands={bits:016x}"


def _file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def store(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write an archive and its member index for each input partition into ``folder``.

    An archive gets its final name only when it is whole, and the name is its partition's: a task
    that runs again replaces what a lost one wrote. Members are named by document id ("null" for a
    null id) and their place in the archive.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = _file_system(folder)
        where.create_dir(root, recursive=True)
        task = TaskContext.get()
        name, draft = f"{root}/part-{task.partitionId():06d}", f"{root}/.draft-{task.taskAttemptId()}"
        index, at = [], 0
        with where.open_output_stream(draft + ".tar") as out:
            for ids, texts in text_batches(batches):
                for doc_id, text in zip(ids, texts):
                    media = to_png(payload_of(text))
                    head = tarfile.TarInfo(f"{'null' if doc_id is None else doc_id}-{len(index)}.png")
                    head.size = len(media)
                    block = head.tobuf(tarfile.PAX_FORMAT)
                    fill = -len(media) % 512
                    out.write(block + media + b"\0" * fill)
                    n_bytes = len((text or "").encode())
                    index.append((at + len(block), len(media), doc_id, n_bytes, zlib.crc32(media)))
                    at += len(block) + len(media) + fill
            out.write(b"\0" * 1024)
        columns = list(zip(*index)) if index else [[]] * 5
        kinds = (("at", pa.int64()), ("size", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("crc", pa.int64()))
        rows = pa.table({n: pa.array(c, t) for (n, t), c in zip(kinds, columns)})
        with where.open_output_stream(draft + ".idx") as out, pa.ipc.new_file(out, rows.schema) as writer:
            writer.write_table(rows)
        where.move(draft + ".idx", name + ".idx")
        where.move(draft + ".tar", name + ".tar")
        yield pa.RecordBatch.from_pydict({"members": [len(index)]})

    source.mapInArrow(run, "members long").write.format("noop").mode("overwrite").save()


class ByteRange(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


class _Archive:
    """One handle on an archive, opened when it is needed."""

    def __init__(self, where: fs.FileSystem, path: str):
        self.where, self.path, self.source = where, path, None

    def read(self, at: int, size: int) -> bytes:
        if self.source is None:
            self.source = self.where.open_input_file(self.path)
        self.source.seek(at)
        return self.source.read(size)

    def close(self) -> None:
        if self.source is not None:
            source, self.source = self.source, None
            source.close()


class ArchiveReader(DataSourceReader):
    """Members of archives, a partition for each byte range of each archive."""

    def __init__(self, schema, folder: str, range_bytes: int, tries: int):
        self.folder, self.range_bytes, self.tries = folder, range_bytes, tries

    def partitions(self) -> list[InputPartition]:
        where, root = _file_system(self.folder)
        found = where.get_file_info(fs.FileSelector(root, allow_not_found=True))
        tars = sorted((f.path, f.size) for f in found if f.path.endswith(".tar") and "/.draft-" not in f.path)
        ranges = [
            ByteRange(path, begin, min(size, begin + self.range_bytes))
            for path, size in tars
            for begin in range(0, size, self.range_bytes)
        ]
        return ranges or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        where, _ = _file_system(self.folder)
        with where.open_input_file(partition.path[: -len(".tar")] + ".idx") as source:
            index = pa.ipc.open_file(source).read_all()
        at = index.column("at").to_numpy()
        first, last = np.searchsorted(at, [partition.begin, partition.end])
        rows, held, archive = [], 0, _Archive(where, partition.path)
        try:
            for member in index.slice(int(first), int(last - first)).to_pylist():
                media, error = self._member(archive, member)
                rows.append((member["doc_id"], member["n_bytes"], media, error))
                held += len(media or b"")
                if held >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, held = [], 0
            if rows:
                yield self._batch(rows)
        finally:
            archive.close()

    def _member(self, archive: _Archive, member: dict) -> tuple[bytes | None, str | None]:
        """One member, read from its offset up to ``tries`` times until its checksum holds, again through a new handle."""
        error = None
        for _ in range(self.tries):
            try:
                media = archive.read(member["at"], member["size"])
                if zlib.crc32(media) == member["crc"]:
                    return media, None
                error = "checksum differs"
            except OSError as e:
                error = f"{type(e).__name__}: {e}"[:200]
            archive.close()
        return None, error

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        ids, sizes, media, errors = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array(errors, pa.string())],
            names=["doc_id", "n_bytes", "media", "error"],
        )


class MediaArchiveSource(DataSource):
    """``spark.read.format("media_archive").option("range_bytes", n).option("tries", n).load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "doc_id long, n_bytes long, media binary, error string"

    def reader(self, schema) -> ArchiveReader:
        get = self.options.get
        return ArchiveReader(schema, get("path"), int(get("range_bytes", str(RANGE_BYTES))), int(get("tries", str(TRIES))))


def read_archives(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES, tries: int = TRIES) -> DataFrame:
    """doc_id, n_bytes, media, error of every member of the archives in ``folder``."""
    spark.dataSource.register(MediaArchiveSource)
    return spark.read.format("media_archive").option("range_bytes", range_bytes).option("tries", tries).load(folder)


def with_features(media: DataFrame) -> DataFrame:
    """Decode stored members and describe them: doc_id, n_bytes, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, feature, error. A damaged member has error and nulls."""
    names = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"

    def one(n_bytes: int, data: bytes | None, error: str | None) -> tuple:
        if data is None:
            return n_bytes, None, None, None, None, None, None, error
        try:
            samples = from_png(data)
        except (ValueError, struct.error, zlib.error) as e:
            return n_bytes, None, None, None, len(data), hashlib.sha256(data).hexdigest(), None, str(e)[:200]
        payload = samples.tobytes()
        return (
            n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]),
            len(data), hashlib.sha256(data).hexdigest(), features_of(samples), None,
        )

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(n.as_py(), m.as_py(), e.as_py()) for n, m, e in zip(*(batch.column(i) for i in (1, 2, 3)))]
            columns = list(zip(*rows)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["doc_id", *(n.split()[0] for n in names.split(", "))],
            )

    return media.select("doc_id", "n_bytes", "media", "error").mapInArrow(run, "doc_id long, " + names)


def media_columns(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as media in archives, read the stored bytes back and describe them.

    Null and empty texts are one row of spaces with n_bytes 0; equal texts have equal values;
    repeated rows and null ids are members of their own; other columns are ignored; an empty table
    gives none.
    """
    folder = folder or new_path(docs.sparkSession, "media")
    store(docs, folder, id_col, text_col)
    return with_features(read_archives(docs.sparkSession, folder))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))
