"""Media columns: payloads in tar shards, rows that point into them.

A payload is stored losslessly as an 8-bit grey PNG, ``WIDTH`` samples wide, in a tar shard in the shared folder; its
member is named by the payload's digest. A task stores a payload it has met before only once, and of payloads that
several tasks stored, one place is canonical, so equal payloads are one medium. Rows carry digest, shard, offset and
length. Metadata columns come from range reads of the header alone; features from range reads of the whole medium.

A shard's name is made of its content's digest and it is moved into place when complete, so a task that runs again
after an executor is lost writes the same shard or leaves none. Shards go to the folder that spark.checkpoint.dir
names, through pyarrow's file systems (local, HDFS, object stores).

Defined cases: null and empty texts have 0 bytes and a payload of ``WIDTH`` bytes of 255; repeated rows each get a row;
equal texts have equal values; null ids are kept; an empty table gives an empty result and no shard.
"""

from __future__ import annotations

import hashlib
import io
import struct
import sys
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WIDTH = 576
#: Bytes of a shard at which it is closed.
SHARD = 32 << 20
#: Bytes of a medium up to the end of its header.
HEADER = 33
# Fixed values of the PNG format.
SIGNATURE, GREY, DEPTH = b"\x89PNG\r\n\x1a\n", 0, 8


def payload_of(text: bytes) -> bytes:
    return text + b"\xff" * ((-len(text)) % WIDTH if text else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes) -> bytes:
    """A PNG whose samples are the payload's bytes."""
    lines = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    filtered = np.zeros((len(lines), WIDTH + 1), np.uint8)  # each line after a zero: no filter
    filtered[:, 1:] = lines
    head = struct.pack(">IIBBBBB", WIDTH, len(lines), DEPTH, GREY, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(filtered, 6)) + _chunk(b"IEND", b"")


def header(start: bytes) -> tuple[int, int, int, int]:
    """Width, height, bits and colour type from a medium's first HEADER bytes."""
    if start[:8] != SIGNATURE or start[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIBB", start[16:26])


def decode(medium: bytes) -> bytes:
    width, height, bits, colour = header(medium[:HEADER])
    if (bits, colour) != (DEPTH, GREY):
        raise ValueError("not 8-bit grey")
    at, packed = 8, []
    while at < len(medium):
        size, kind = struct.unpack(">I4s", medium[at : at + 8])
        body = medium[at + 8 : at + 8 + size]
        if struct.unpack(">I", medium[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk is damaged")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    return np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def feature(payload: bytes, height: int) -> str:
    """Size, mean, spread and entropy of the samples, and the mean step between neighbours."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = counts / len(payload)
    mean = float(share @ np.arange(256))
    spread = float(share @ (np.arange(256) - mean) ** 2) ** 0.5
    seen = share[share > 0]
    samples = np.frombuffer(payload, np.uint8).astype(np.int16)
    return f"h={height};mean={mean:.4f};spread={spread:.4f};entropy={float(-(seen * np.log2(seen)).sum()):.4f};step={float(np.abs(np.diff(samples)).mean()):.4f}"


def store(documents: DataFrame, folder: str, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """(id, n_bytes, digest, shard, at, length) for each row; the shards are written to folder."""
    common.small_batches(documents)
    kind = documents.schema[id_column].dataType.simpleString()
    names = [id_column, "n_bytes", "digest", "shard", "at", "length"]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        known: dict[bytes, tuple[str, int, int]] = {}  # in closed shards
        held, waiting, ids = io.BytesIO(), {}, None  # the open shard: its members and the rows that wait for its name
        rows: list[tuple] = []

        def close() -> None:
            nonlocal held
            if waiting:
                held.write(b"\0" * 1024)
                body = held.getbuffer()
                name = hashlib.sha256(body).hexdigest()[:32]
                part = f"{root}/{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as f:
                    f.write(body)
                system.move(part, f"{root}/{name}.tar")
                known.update({digest: (name, at, n) for digest, (at, n) in waiting.items()})
                waiting.clear()
                held = io.BytesIO()

        def out() -> pa.RecordBatch:
            done = [(i, n, digest, *known[digest]) for i, n, digest in rows]
            rows.clear()
            types = [ids, pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)

        for batch in common.slices(batches, 4 << 20, column):
            ids = batch.column(id_column).type
            data, at = common.utf8(batch.column(column))
            for i, doc in enumerate(batch.column(id_column).to_pylist()):
                payload = payload_of(bytes(data[at[i] : at[i + 1]]))
                digest = hashlib.sha256(payload).digest()
                if digest not in known and digest not in waiting:
                    medium = encode(payload)
                    info = tarfile.TarInfo(f"{digest.hex()}.png")
                    info.size = len(medium)
                    held.write(info.tobuf(tarfile.USTAR_FORMAT))
                    waiting[digest] = (held.tell(), len(medium))
                    held.write(medium + b"\0" * (-len(medium) % 512))
                rows.append((doc, at[i + 1] - at[i], digest))
            if held.tell() > SHARD:
                close()
                yield out()
        close()
        if rows:
            yield out()

    return documents.select(id_column, column).mapInArrow(go, f"`{id_column}` {kind}, n_bytes long, digest binary, shard string, at long, length long")


def canonical(rows: DataFrame) -> DataFrame:
    """One place (shard, at, length) for each digest."""
    place = F.struct("shard", "at", "length")
    return rows.groupBy("digest").agg(F.min(place).alias("place")).select("digest", "place.*")


#: A payload's digest and its place; then column names and Spark types of what is read back.
PLACE = ("digest", "shard", "at", "length")
METADATA = {"width": "long", "height": "long", "bits": "long"}
FEATURES = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}


def _metadata(start: bytes) -> tuple:
    return header(start)[:3]


def _features(medium: bytes) -> tuple:
    payload = decode(medium)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(medium), hashlib.sha256(medium).hexdigest(), feature(payload, len(payload) // WIDTH)


def _read(places: DataFrame, folder: str, wanted: dict[str, str], *ranges: tuple) -> DataFrame:
    """(digest, shard, at, length, wanted): for each place and each of ranges (bytes at most, function), the columns made of those bytes.

    Places are dealt by shard, which holds a bounded number of bytes, and a shard is opened once.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        name, file = None, None
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                found = []
                for digest, shard, at, length in zip(*[part.column(c).to_pylist() for c in PLACE], strict=True):
                    if shard != name:
                        if file:
                            file.close()
                        name, file = shard, system.open_input_file(f"{root}/{shard}.tar")
                    row = [digest, shard, at, length]
                    for most, columns_of in ranges:
                        file.seek(at)
                        row += columns_of(file.read(min(length, most)))
                    found.append(row)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], [*PLACE, *wanted])
        if file:
            file.close()

    near = places.repartition("shard").sortWithinPartitions("shard", "at")
    return near.select(*PLACE).mapInArrow(go, ", ".join(["digest binary, shard string, at long, length long", *[f"{c} {t}" for c, t in wanted.items()]]))


def metadata(places: DataFrame, folder: str) -> DataFrame:
    """(digest, its place, width, height, bits): only headers are read."""
    return _read(places, folder, METADATA, (HEADER, _metadata))


def features(places: DataFrame, folder: str) -> DataFrame:
    """(digest, its place, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), all from the stored bytes."""
    return _read(places, folder, FEATURES, (sys.maxsize, _features))


def columns(documents: DataFrame, id_column: str = "doc_id", column: str = "text", folder: str | None = None) -> DataFrame:
    """Stores the texts' payloads and reads them back: (id, n_bytes, digest, shard, at, length), metadata from headers, features from the whole."""
    folder = folder or f"{common.shared_dir(documents.sparkSession)}/media-{uuid.uuid4().hex}"
    rows = common.cut(store(documents, folder, id_column, column))
    read = _read(canonical(rows), folder, METADATA | FEATURES, (HEADER, _metadata), (sys.maxsize, _features))
    return rows.select(id_column, "n_bytes", "digest").join(read, "digest")
