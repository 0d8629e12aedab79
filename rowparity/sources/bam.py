"""BAM files as tables and back, by a Python data source.

A file with an index beside it (``.bai``) is cut where the index says that
records begin, into partitions of ``SPLIT`` packed bytes or a little more.
Each cut is checked: the records before it must end there, or the read fails.
A file without an index is one partition; repartition what is read.  All are
read as streams of BGZF members in bounded memory.  Written are the partitions as parts beside
the target, which the driver joins, as BGZF members can be, when all tasks are
done; what a lost or repeated task wrote is left out.  Paths are those that
pyarrow's file systems know (local, HDFS, S3).
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = (
    "read_name string, flags int, reference string, position long, mapping_quality int, cigar array<struct<op:int,len:int>>,"
    " mate struct<reference:string,position:long>, template_length int, sequence string, qualities array<int>, tags map<string,struct<type:string,value:string>>"
)
#: Records of an Arrow batch.
BATCH = 2_000
# fixed values of the format: bases by their 4-bit code, and the sizes of numeric tags
BASES = "=ACMGRSVTWYHKDBN"
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
#: Packed bytes of a partition, of a file with an index.
SPLIT = 32 << 20
# fixed value of the format: the number that stands for an index's figures, which aren't places
FIGURES = 37450
#: Bytes of a BGZF member before it is packed, and of a copy between files.
MEMBER, COPY = 0xFF00, 1 << 22


class _Stream:
    """The unpacked bytes of a gzip stream of many members, and of ``tail`` behind them."""

    def __init__(self, raw, chunk: int = 1 << 20, tail: bytes = b""):
        self.raw, self.chunk, self.data, self.at, self.tail = raw, chunk, b"", 0, tail
        self.inflate = zlib.decompressobj(31)

    def read(self, n: int) -> bytes:
        """The next ``n`` bytes; fewer at the end."""
        while len(self.data) - self.at < n:
            packed = self.inflate.unused_data or self.raw.read(self.chunk)
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            if not packed:
                self.data, self.at, self.tail = self.data[self.at :] + self.tail, 0, b""
                break
            self.data, self.at = self.data[self.at :] + self.inflate.decompress(packed), 0
        out = self.data[self.at : self.at + n]
        self.at += len(out)
        return out


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)


def _open(path: str):
    system, place = _system(path)
    return system.open_input_stream(place, compression=None)


class _Until:
    """A file's bytes up to ``end``, or all that follow."""

    def __init__(self, file, end: int | None):
        self.file, self.end = file, end

    def read(self, n: int) -> bytes:
        return self.file.read(n if self.end is None else max(0, min(n, self.end - self.file.tell())))


def _between(file, start: int, end: int | None) -> _Stream:
    """What lies between two virtual offsets: a member's place in the file times 2^16, and a place in its bytes."""
    tail = b""
    if end is not None:
        file.seek(end >> 16)
        tail = _Stream(file, 1 << 16).read(end & 0xFFFF)
    file.seek(start >> 16)
    stream = _Stream(_Until(file, None if end is None else end >> 16), tail=tail)
    stream.read(start & 0xFFFF)
    return stream


def indexed_places(data: bytes) -> list[int]:
    """The virtual offsets in a BAI index at which records begin, sorted."""
    if data[:4] != b"BAI\1":
        raise ValueError("not a BAI index")
    at, found = 8, set()
    for _ in range(struct.unpack_from("<i", data, 4)[0]):
        bins, at = struct.unpack_from("<i", data, at)[0], at + 4
        for _ in range(bins):
            number, chunks = struct.unpack_from("<Ii", data, at)
            if number != FIGURES:
                found.update(struct.unpack_from(f"<{2 * chunks}Q", data, at + 8)[::2])
            at += 8 + 16 * chunks
        at += 4 + 8 * struct.unpack_from("<i", data, at)[0]
    return sorted(found)


def cuts(path: str, split: int = SPLIT) -> list[int]:
    """Where to cut a file, by its index: virtual offsets at least ``split`` packed bytes apart; none without an index."""
    system, place = _system(path)
    for name in (f"{place}.bai", place.removesuffix(".bam") + ".bai"):
        if system.get_file_info(name).is_file:
            with system.open_input_stream(name, compression=None) as raw:
                places = indexed_places(raw.read())
            break
    else:
        return []
    out, last = [], 0
    for x in places:
        if (x >> 16) - last >= split:
            out.append(x)
            last = x >> 16
    return out


def read_header(stream: _Stream) -> tuple[str, list[tuple[str, int]]]:
    """The header text and the references with their lengths."""
    if stream.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    text = stream.read(struct.unpack("<i", stream.read(4))[0]).rstrip(b"\0").decode()
    references = []
    for _ in range(struct.unpack("<i", stream.read(4))[0]):
        name = stream.read(struct.unpack("<i", stream.read(4))[0])[:-1].decode()
        references.append((name, struct.unpack("<i", stream.read(4))[0]))
    return text, references


def _tags(data: bytes) -> list[tuple[str, dict]]:
    out, at = [], 0
    while at < len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind == "A":
            value, at = chr(data[at]), at + 1
        elif kind in NUMBERS:
            size = struct.calcsize("<" + NUMBERS[kind])
            value, at = str(struct.unpack_from("<" + NUMBERS[kind], data, at)[0]), at + size
        elif kind in "ZH":
            end = data.index(0, at)
            value, at = data[at:end].decode(), end + 1
        elif kind == "B":
            one, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            values = struct.unpack_from(f"<{n}{NUMBERS[one]}", data, at + 5)
            value, at = ",".join([one, *map(str, values)]), at + 5 + n * struct.calcsize("<" + NUMBERS[one])
        else:
            raise ValueError(f"unknown tag type {kind!r}")
        out.append((name, {"type": "i" if kind in "cCsSiI" else kind, "value": value}))
    return sorted(out, key=lambda x: x[0])


def record(data: bytes, names: list[str]) -> dict:
    """One alignment record; positions count from 0, and are -1 where it is unplaced."""
    ref, pos, name_size, mapq, _, n_ops, flags, n_bases, mate_ref, mate_pos, length = struct.unpack_from("<iiBBHHHiiii", data)
    at = 32
    name, at = data[at : at + name_size - 1].decode(), at + name_size
    ops, at = struct.unpack_from(f"<{n_ops}I", data, at), at + 4 * n_ops
    packed, at = data[at : at + (n_bases + 1) // 2], at + (n_bases + 1) // 2
    bases = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:n_bases]
    quality, at = data[at : at + n_bases], at + n_bases
    place = lambda i: names[i] if i >= 0 else None
    return {
        "read_name": None if name == "*" else name, "flags": flags, "reference": place(ref), "position": pos, "mapping_quality": mapq,
        "cigar": [{"op": x & 15, "len": x >> 4} for x in ops] or None, "mate": {"reference": place(mate_ref), "position": mate_pos}, "template_length": length,
        "sequence": bases or None, "qualities": None if not quality or quality[0] == 255 else list(quality), "tags": _tags(data[at:]),
    }


def records(path: str, start: int | None = None, end: int | None = None) -> Iterator[dict]:
    """The records of a BAM file, in file order; those between two virtual offsets, if given."""
    system, place = _system(path)
    with system.open_input_file(place) as file:
        stream = _between(file, 0, end if start is None else None)
        names = [n for n, _ in read_header(stream)[1]]
        if start is not None:
            stream = _between(file, start, end)
        while size := stream.read(4):
            n = struct.unpack("<i", size)[0] if len(size) == 4 else -1
            data = stream.read(n) if n >= 32 else b""
            if n < 32 or len(data) < n:
                raise ValueError(f"{path} is cut off" if end is None else f"{path} isn't what its index describes")
            yield record(data, names)


def packed(data: bytes) -> bytes:
    """One BGZF member."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    head = struct.pack("<4BIBBH2sHH", 31, 139, 8, 4, 0, 0, 255, 6, b"BC", 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def _bin(start: int, end: int) -> int:
    """The smallest bin of the format's five-level index that holds [start, end)."""
    for level in range(5, 0, -1):
        shift = 29 - 3 * level
        if start >> shift == (end - 1) >> shift:
            return ((1 << 3 * level) - 1) // 7 + (start >> shift)
    return 0


def _tag(name: str, kind: str, value: str) -> bytes:
    head = name.encode() + kind.encode()
    if kind == "A":
        return head + value.encode()
    if kind == "i":
        n = int(value)
        return name.encode() + (b"i" + struct.pack("<i", n) if n < 1 << 31 else b"I" + struct.pack("<I", n))
    if kind == "f":
        return head + struct.pack("<f", float(value))
    if kind == "B":
        one, *values = value.split(",")
        number = float if one == "f" else int
        return head + one.encode() + struct.pack(f"<i{len(values)}{NUMBERS[one]}", len(values), *map(number, values))
    return head + value.encode() + b"\0"


def encoded(row: dict, numbers: dict[str, int]) -> bytes:
    """One record with its size; ``numbers`` has each reference's place in the header."""
    name = (row["read_name"] or "*").encode() + b"\0"
    ops = [(c["len"], c["op"]) for c in row["cigar"] or []]
    bases, mate = row["sequence"] or "", row["mate"]
    codes = [BASES.index(b) if b in BASES else 15 for b in bases.upper()] + [0] * (len(bases) % 2)
    span = max(1, sum(n for n, op in ops if op in (0, 2, 3, 7, 8)))
    place = lambda r: -1 if r is None else numbers[r]
    start = row["position"]
    body = struct.pack(
        "<iiBBHHHiiii", place(row["reference"]), start, len(name), row["mapping_quality"], _bin(start, start + span) if start >= 0 else 4680,
        len(ops), row["flags"], len(bases), place(mate["reference"]), mate["position"], row["template_length"],
    )
    body += name + b"".join(struct.pack("<I", n << 4 | op) for n, op in ops) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
    body += bytes(row["qualities"]) if row["qualities"] else b"\xff" * len(bases)
    body += b"".join(_tag(k, v["type"], v["value"]) for k, v in sorted((row["tags"] or {}).items()))
    return struct.pack("<i", len(body)) + body


class _Part(WriterCommitMessage):
    def __init__(self, partition: int, path: str):
        self.partition, self.path = partition, path


class MemberWriter(DataSourceWriter):
    """Writes each partition as a part of members; ``commit`` joins them behind the header."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.parts = f"{path}.parts-{uuid.uuid4().hex}"

    def head(self) -> bytes:
        """What comes before the records."""
        raise NotImplementedError

    def encoder(self) -> Callable[[dict], bytes]:
        """Makes a record's bytes from a row."""
        raise NotImplementedError

    def write(self, iterator) -> _Part:
        from pyspark import TaskContext

        encode = self.encoder()
        system, folder = _system(self.parts)
        system.create_dir(folder, recursive=True)
        place = f"{folder}/{uuid.uuid4().hex}"
        held = bytearray()
        with system.open_output_stream(place) as out:
            for row in iterator:
                held += encode(row.asDict(recursive=True))
                while len(held) >= MEMBER:
                    out.write(packed(bytes(held[:MEMBER])))
                    del held[:MEMBER]
            if held:
                out.write(packed(bytes(held)))
        return _Part(TaskContext.get().partitionId(), place)

    def commit(self, messages) -> None:
        system, place = _system(self.path)
        head = self.head()
        private = f"{place}.{uuid.uuid4().hex}"
        with system.open_output_stream(private) as out:
            for k in range(0, len(head), MEMBER):
                out.write(packed(head[k : k + MEMBER]))
            for part in sorted((m for m in messages if m), key=lambda m: m.partition):
                with system.open_input_stream(part.path, compression=None) as raw:
                    while data := raw.read(COPY):
                        out.write(data)
            out.write(packed(b""))
        if not self.overwrite and system.get_file_info(place).type.name != "NotFound":
            system.delete_file(private)
            self.abort(messages)
            raise FileExistsError(f"{self.path} exists")
        system.move(private, place)
        self.abort(messages)

    def abort(self, messages) -> None:
        system, folder = _system(self.parts)
        if system.get_file_info(folder).type.name != "NotFound":
            system.delete_dir(folder)


class BamWriter(MemberWriter):
    def __init__(self, path: str, text: str, references: list[tuple[str, int]], overwrite: bool):
        super().__init__(path, overwrite)
        self.text, self.references = text, references

    def head(self) -> bytes:
        text = self.text.encode()
        out = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(self.references))
        for name, length in self.references:
            out += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
        return out

    def encoder(self) -> Callable[[dict], bytes]:
        numbers = {name: k for k, (name, _) in enumerate(self.references)}
        return lambda row: encoded(row, numbers)


class _File(InputPartition):
    def __init__(self, path: str, start: int | None, end: int | None):
        self.path, self.start, self.end = path, start, end


class BamReader(DataSourceReader):
    def __init__(self, paths: list[str], split: int, schema: pa.Schema):
        self.paths, self.split, self.schema = paths, split, schema

    def partitions(self):
        ends = {p: cuts(p, self.split) for p in self.paths}
        return [_File(p, a, b) for p in self.paths for a, b in zip([None, *ends[p]], [*ends[p], None], strict=True)]

    def read(self, partition):
        rows = []
        for r in records(partition.path, partition.start, partition.end):
            rows.append(r)
            if len(rows) == BATCH:
                yield pa.RecordBatch.from_pylist(rows, schema=self.schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=self.schema)


class BamDataSource(DataSource):
    """``spark.read.format("bam").option("paths", "a.bam,b.bam").load()``."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        from pyspark.sql.pandas.types import to_arrow_schema

        paths = self.options.get("paths") or self.options["path"]
        return BamReader(paths.split(","), int(self.options.get("split", SPLIT)), to_arrow_schema(schema))

    def writer(self, schema, overwrite: bool) -> BamWriter:
        return BamWriter(self.options["path"], self.options.get("header", ""), [(n, k) for n, k in json.loads(self.options["references"])], overwrite)


def read(spark: SparkSession, *paths: str, split: int = SPLIT) -> DataFrame:
    """The records of BAM files, in partitions of about ``split`` packed bytes where a file has an index."""
    spark.dataSource.register(BamDataSource)
    return spark.read.format("bam").option("paths", ",".join(paths)).option("split", split).load()


def references(path: str) -> list[tuple[str, int]]:
    """The references and their lengths, from the header alone."""
    return read_alignment_header(path)[1]


def read_alignment_header(path: str) -> tuple[str, list[tuple[str, int]]]:
    """The header's text and its references, on the driver."""
    with _open(path) as raw:
        return read_header(_Stream(raw))


def write(records: DataFrame, path: str, text: str, references: list[tuple[str, int]], force: bool = False) -> None:
    """Writes records (the columns of ``SCHEMA``) as one BAM file, in the order of the partitions."""
    records.sparkSession.dataSource.register(BamDataSource)
    rows = records.select("read_name", "flags", "reference", "position", "mapping_quality", "cigar", "mate", "template_length", "sequence", "qualities", "tags")
    out = rows.write.format("bam").mode("overwrite" if force else "append")
    out.option("header", text).option("references", json.dumps(references)).save(path)
