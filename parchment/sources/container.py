"""Document containers: a 32-byte header and a ZIP archive, read, checked, recovered and written.

Files come from spark.read.format("binaryFile"), so any path that Spark reads will do. The header starts with a magic of six
capital letters and a line end; the manifest's own member bears the same six letters in lower case, so the reader takes any
format of this shape and needs no name.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.schemas import ENTRIES

HEADER_SIZE = 32
MAGIC = re.compile(rb"([A-Z]{6})\r\n")
VERSION = 1
#: Limits on an archive.
MOST_ENTRIES, LARGEST_ENTRY, LARGEST_TOTAL, LARGEST_RATIO, RATIO_FROM = 65_536, 512 << 20, 2 << 30, 200, 64
METHODS = {0: "stored", 8: "deflate"}


class Refused(ValueError):
    """The file is not opened: not a container, too new, or beyond a limit."""


@dataclass
class Header:
    name: str
    major: int = VERSION
    minor: int = 0
    size: int = HEADER_SIZE
    flags: int = 0
    zip_offset: int = HEADER_SIZE
    extension: bytes = b""

    def to_bytes(self) -> bytes:
        head = self.name.upper().encode() + b"\r\n" + struct.pack("<BBHIQ", self.major, self.minor, self.size, self.flags, self.zip_offset)
        return head + struct.pack("<II", zlib.crc32(head), 0) + self.extension


def parse_header(data: bytes) -> tuple[Header | None, bool]:
    """Fields of the header, and whether its checksum is right; no header is None."""
    m = MAGIC.match(data) if len(data) >= HEADER_SIZE else None
    if m is None:
        return None, False
    header = Header(m[1].decode(), *struct.unpack("<BBHIQ", data[8:24]))
    header.extension = data[HEADER_SIZE : header.size]
    return header, struct.unpack("<I", data[24:28])[0] == zlib.crc32(data[:24])


@dataclass
class Container:
    header: Header | None
    archive: zipfile.ZipFile | None
    warnings: list[str] = field(default_factory=list)
    pending: dict[str, bytes] = field(default_factory=dict)
    source: bytes = b""

    def names(self) -> list[str]:
        """Entries of the archive and pending ones, in order."""
        held = self.archive.namelist() if self.archive else []
        return list(dict.fromkeys([*held, *self.pending]))

    def read(self, name: str) -> bytes:
        """A pending entry goes before the archive's."""
        return self.pending[name] if name in self.pending else self.archive.read(name)

    def set(self, name: str, payload: bytes) -> None:
        """Insert or replace an entry; a layer's checksum in the manifest follows."""
        self.pending[name] = payload
        if name != "manifest.json":
            manifest = json.loads(self.read("manifest.json"))
            for layer in manifest.get("layers", {}).values():
                if isinstance(layer, dict) and layer.get("path") == name:
                    layer["sha256"] = hashlib.sha256(payload).hexdigest()
                    self.pending["manifest.json"] = json.dumps(manifest, ensure_ascii=False).encode()

    def write(self) -> bytes:
        """The source's own bytes if nothing is pending; else a new archive, header extension kept."""
        if not self.pending:
            return self.source
        header = self.header or Header("PARCHM")
        return pack([(n, self.read(n)) for n in self.names()], header.name, header)


def limits(infos: list[zipfile.ZipInfo]) -> None:
    """Refuse an archive beyond the limits, before anything in it is read."""
    if len(infos) > MOST_ENTRIES:
        raise Refused(f"{len(infos)} entries")
    total = 0
    for i in infos:
        total += i.file_size
        if i.flag_bits & 1:
            raise Refused(f"{i.filename} is encrypted")
        if i.compress_type not in METHODS:
            raise Refused(f"{i.filename} is compressed by method {i.compress_type}")
        if i.file_size > LARGEST_ENTRY or total > LARGEST_TOTAL:
            raise Refused(f"{i.filename} is too large")
        if i.compress_type and i.compress_size > RATIO_FROM and i.file_size > LARGEST_RATIO * i.compress_size:
            raise Refused(f"{i.filename} is compressed more than {LARGEST_RATIO}:1")


def open_container(data: bytes) -> Container:
    """Magic, version, checksum, archive, limits, manifest: in this order; a damaged prefix falls back to the plain archive."""
    header, right = parse_header(data)
    warnings, body = [], data
    if header is not None:
        if header.major > VERSION:
            raise Refused(f"version {header.major} is too new")
        if right:
            body = data[header.zip_offset :]
        else:
            warnings.append("header checksum is wrong")
    elif data[:4] != b"PK\x03\x04":
        raise Refused("not a container")
    try:
        archive = zipfile.ZipFile(io.BytesIO(body))
    except zipfile.BadZipFile as e:
        raise Refused(f"archive is damaged: {e}") from e
    limits(archive.infolist())
    try:
        manifest = json.loads(archive.read("manifest.json"))
    except (KeyError, ValueError) as e:
        raise Refused("no manifest") from e
    own = [v for k, v in manifest.items() if isinstance(v, dict) and isinstance(v.get("format_version"), str)]
    if not own:
        raise Refused("manifest names no format version")
    if header is None and own[0].get("container_profile") == "prefixed":
        warnings.append("prefix is missing")
    return Container(header if right else None, archive, warnings, {}, data)


def pack(entries: list[tuple[str, bytes]], name: str = "PARCHM", header: Header | None = None, deflate: bool = True) -> bytes:
    """Header and archive; the manifest first and stored, everything else deflated unless told otherwise, all with the same time."""
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for n, payload in sorted(entries, key=lambda e: e[0] != "manifest.json"):
            info = zipfile.ZipInfo(n, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_DEFLATED if deflate and n != "manifest.json" else zipfile.ZIP_STORED
            z.writestr(info, payload)
    return (header or Header(name)).to_bytes() + held.getvalue()


def safe_path(name: str) -> str | None:
    """A relative path without .. parts, drive letters and empty parts; None if nothing is left."""
    parts = [p for p in re.split(r"[/\\]+", name) if p not in ("", ".", "..") and ":" not in p]
    return "/".join(parts) or None


def recover(data: bytes) -> list[dict]:
    """What can be saved of a damaged file: by its central directory, else by scanning for local headers."""
    at = data.find(b"PK\x03\x04")
    try:
        with zipfile.ZipFile(io.BytesIO(data[at:] if at > 0 else data)) as z:
            return [_saved(i.filename, "central", lambda i=i: z.read(i)) for i in z.infolist() if not i.is_dir()]
    except (zipfile.BadZipFile, OSError, ValueError):
        return list(_scan(data))


def _saved(name: str, mode: str, take) -> dict:
    try:
        return {"name": safe_path(name), "mode": mode, "ok": True, "bytes": take(), "reason": None}
    except Exception as e:  # whatever is wrong with one entry, the others go on
        return {"name": safe_path(name), "mode": mode, "ok": False, "bytes": None, "reason": str(e)[:200]}


def _scan(data: bytes) -> Iterator[dict]:
    at = 0
    while (at := data.find(b"PK\x03\x04", at)) >= 0 and at + 30 <= len(data):
        flags, method, _, _, crc, packed, _, n, extra = struct.unpack("<HHHHIIIHH", data[at + 6 : at + 30])
        start = at + 30 + n + extra
        name = data[at + 30 : at + 30 + n].decode("utf-8", "replace")
        after = start

        def take() -> bytes:
            nonlocal after
            if method == 0:
                payload = data[start : start + packed]
                after = start + packed
            elif method == 8:
                inflate = zlib.decompressobj(-15)
                payload = inflate.decompress(data[start : start + packed] if packed else data[start:], LARGEST_ENTRY)
                after = start + packed if packed else len(data) - len(inflate.unused_data)
            else:
                raise ValueError(f"method {method}")
            if not flags & 8 and zlib.crc32(payload) != crc:
                raise ValueError("checksum is wrong")
            return payload

        if name and not name.endswith("/"):
            yield _saved(name, "scan", take)
        at = max(after, at + 4)


#: Bytes of entries that a batch holds before it is handed on.
BATCH_BYTES = 8 << 20


def _batches(rows: Iterator[tuple], names: list[str], at: int) -> Iterator[pd.DataFrame]:
    """Rows in data frames of about BATCH_BYTES, by the length of the field at that position."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[at] or b"") + 64
        if size >= BATCH_BYTES:
            yield pd.DataFrame(held, columns=names)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=names)


def entries(files: DataFrame, doc_id: str = "doc_id", content: str = "content") -> DataFrame:
    """A row for each entry of each file; a file that is refused gives one row with the reason as its warning."""
    names = [f.split()[0] for f in ENTRIES.split(", ")]

    def opened(batch: pd.DataFrame) -> Iterator[tuple]:
        for i, data in zip(batch["doc_id"], batch["content"], strict=True):
            try:
                c = open_container(bytes(data or b""))
            except Refused as e:
                yield (i, None, None, None, None, None, None, None, str(e))
                continue
            for k, e in enumerate(c.archive.infolist()):
                yield (i, e.filename, k, e.file_size, e.compress_size, METHODS[e.compress_type], True, c.archive.read(e), "; ".join(c.warnings) or None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from _batches(opened(batch), names, names.index("bytes"))

    return files.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(content).alias("content")).mapInPandas(run, ENTRIES)


def recovered(files: DataFrame, doc_id: str = "doc_id", content: str = "content") -> DataFrame:
    """A row for each entry that recovery found: doc_id, name, mode, ok, bytes, reason."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, data in zip(batch["doc_id"], batch["content"], strict=True):
                yield pd.DataFrame([{"doc_id": i, **r} for r in recover(bytes(data or b""))], columns=["doc_id", "name", "mode", "ok", "bytes", "reason"])

    return files.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(content).alias("content")).mapInPandas(run, "doc_id long, name string, mode string, ok boolean, bytes binary, reason string")


def packed(table: DataFrame, name: str = "PARCHM", deflate: bool = True) -> DataFrame:
    """doc_id and content: the entries (doc_id, name, bytes) of each document as a container."""
    return packed_rows(table.groupBy("doc_id").agg(F.collect_list(F.struct("name", "bytes")).alias("entries")), name, deflate)


def packed_rows(table: DataFrame, name: str = "PARCHM", deflate: bool = True) -> DataFrame:
    """doc_id and content: a container for each row, from its array entries of (name, bytes). Nothing is exchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [pack(sorted((e["name"], e["bytes"]) for e in row or []), name, deflate=deflate) for row in batch["entries"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(made, pa.binary())], ["doc_id", "content"])

    return table.select(F.col("doc_id").cast("long").alias("doc_id"), "entries").mapInArrow(run, "doc_id long, content binary")


def rewritten(files: DataFrame, changes: DataFrame) -> DataFrame:
    """doc_id and content: containers (doc_id, content) with changes (doc_id, name, bytes) set; one without changes keeps its bytes."""
    new = changes.groupBy("doc_id").agg(F.collect_list(F.struct("name", "bytes")).alias("entries"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for data, entries_ in zip(batch["content"].to_pylist(), batch["entries"].to_pylist(), strict=True):
                if entries_:
                    c = open_container(data)
                    for e in sorted(entries_, key=lambda e: e["name"]):
                        c.set(e["name"], e["bytes"])
                    data = c.write()
                made.append(data)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(made, pa.binary())], ["doc_id", "content"])

    joined = files.select(F.col("doc_id").cast("long").alias("doc_id"), "content").join(new, "doc_id", "left")
    return joined.select("doc_id", "content", "entries").mapInArrow(run, "doc_id long, content binary")


def headers(table: DataFrame, name: str = "PARCHM") -> DataFrame:
    """doc_id and content: the header of each row (doc_id, minor, flags, extension), encoded with its checksum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for minor, flags, extension in zip(*(batch[c].to_pylist() for c in ("minor", "flags", "extension")), strict=True):
                size = HEADER_SIZE + len(extension or b"")
                made.append(Header(name, VERSION, minor, size, flags, size, extension or b"").to_bytes())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(made, pa.binary())], ["doc_id", "content"])

    kept = table.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("minor").cast("int").alias("minor"), F.col("flags").cast("int").alias("flags"), "extension")
    return kept.mapInArrow(run, "doc_id long, content binary")


# header fields of a binary column, without Python


def _little_endian(data: Column, at: int, size: int) -> Column:
    h = F.hex(F.substring(data, at + 1, size))
    return F.conv(F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(size))]), 16, 10).cast("long")


def header_fields(data: Column) -> dict[str, Column]:
    return {
        "major": _little_endian(data, 8, 1),
        "minor": _little_endian(data, 9, 1),
        "header_size": _little_endian(data, 10, 2),
        "flags": _little_endian(data, 12, 4),
        "zip_offset": _little_endian(data, 16, 8),
        "crc_ok": F.crc32(F.substring(data, 1, 24)) == _little_endian(data, 24, 4),
    }


def within_limits(table: DataFrame) -> DataFrame:
    """doc_id, n_entries, largest, total, ratio and ok of an entry table."""
    ratio = F.max(F.when((F.col("method") != "stored") & (F.col("compressed_size") > RATIO_FROM), F.col("size") / F.col("compressed_size")))
    found = table.groupBy("doc_id").agg(F.count("*").alias("n_entries"), F.max("size").alias("largest"), F.sum("size").alias("total"), F.coalesce(ratio, F.lit(0.0)).alias("ratio"))
    return found.withColumn("ok", (F.col("n_entries") <= MOST_ENTRIES) & (F.col("largest") <= LARGEST_ENTRY) & (F.col("total") <= LARGEST_TOTAL) & (F.col("ratio") <= LARGEST_RATIO))
