"""BCF files as tables of the same columns as VCF text, read and written by a Python data source.

A file is one partition, read as a stream of its BGZF members; what a record
holds is as VCF text has it.  Tasks write parts that the driver joins.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .bam import BATCH, MemberWriter, _open, _Stream

SCHEMA = (
    "contig string, pos long, stop long, identifiers string, alleles array<string>, quality double, filters array<string>,"
    " info map<string,string>, samples map<string,struct<values:map<string,string>,phased:boolean>>"
)
# fixed values of the format: struct codes and sizes of the typed values, and the integers that stand for missing and end of vector
TYPES = {1: ("b", 1), 2: ("h", 2), 3: ("i", 4), 5: ("f", 4), 7: ("c", 1)}
MISSING = {1: -0x80, 2: -0x8000, 3: -0x80000000}
END = {1: -0x7F, 2: -0x7FFF, 3: -0x7FFFFFFF}
MISSING_FLOAT, END_FLOAT = 0x7F800001, 0x7F800002


class Header:
    """The dictionaries of a BCF header: strings and contigs by number, samples in order."""

    def __init__(self, text: str):
        self.text, self.strings, self.contigs, self.samples = text.rstrip("\0"), {0: "PASS"}, {}, []
        self.rows: list[tuple[str, str, str | None]] = []
        for line in text.rstrip("\0").splitlines():
            if line.startswith("#CHROM"):
                self.samples = line.split("\t")[9:]
            elif found := re.match(r"##(contig|INFO|FORMAT|FILTER)=<(.*)>", line):
                self._define(found[1].lower(), found[2])
        self.rows += [("sample", name, str(9 + k)) for k, name in enumerate(self.samples)]

    def _define(self, section: str, body: str) -> None:
        get = lambda key: (re.search(rf"(?:^|,){key}=([^,>]*)", body) or (None, ""))[1]
        name, number = get("ID"), get("IDX")
        numbered = self.contigs if section == "contig" else self.strings
        if name not in numbered.values():
            numbered[int(number) if number else max(numbered, default=-1) + 1] = name
        self.rows.append((section, name, get("length") if section == "contig" else ":".join((get("Number"), get("Type")))))


class _Cursor:
    """Typed values of a record, one after the other."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def kind(self) -> tuple[int, int]:
        """The type and the length of the next value."""
        byte = self.data[self.at]
        self.at += 1
        return byte & 15, byte >> 4 if byte >> 4 < 15 else self.value()[0]

    def take(self, kind: int, n: int) -> list | str | None:
        """``n`` values: a text, or a list with None for missing ones, up to the end of the vector; None for no value."""
        if kind == 0 or n == 0:
            return None
        code, size = TYPES[kind]
        raw = self.data[self.at : self.at + n * size]
        self.at += n * size
        if kind == 7:
            return raw.rstrip(b"\0").decode()
        values = struct.unpack(f"<{n}{code}", raw)
        marks = struct.unpack(f"<{n}I", raw) if kind == 5 else values
        missing, end = (MISSING_FLOAT, END_FLOAT) if kind == 5 else (MISSING[kind], END[kind])
        out = []
        for value, mark in zip(values, marks, strict=True):
            if mark == end:
                break
            out.append(None if mark == missing else value)
        return out

    def value(self) -> list | str | None:
        return self.take(*self.kind())


def _one(value: float | int | None) -> str:
    if value is None:
        return "."
    return f"{value:.6g}" if isinstance(value, float) else str(value)


def _text(value: list | str | None) -> str | None:
    return ",".join(map(_one, value)) if isinstance(value, list) else value


def _genotype(values: list | None) -> tuple[str, bool]:
    """The text of a genotype, and whether it is phased: an allele's lowest bit says how it joins the one before."""
    if not values:
        return ".", False
    marks = ["." if not v or v >> 1 == 0 else str((v >> 1) - 1) for v in values]
    joins = ["|" if v and v & 1 else "/" for v in values[1:]]
    return "".join([marks[0], *(j + m for j, m in zip(joins, marks[1:], strict=True))]), bool(joins) and joins[0] == "|"


def record(shared: bytes, each: bytes, header: Header) -> dict:
    """One variant record, with texts as VCF has them; positions count from 1."""
    contig, pos, length, quality, n_info, n_alleles, packed = struct.unpack_from("<iiiIHHI", shared)
    c = _Cursor(shared)
    c.at = 24
    name = c.value()
    alleles = [c.value() or "" for _ in range(n_alleles)]
    filters = c.value() or []
    info = {}
    for _ in range(n_info):
        key = header.strings[c.value()[0]]
        value = _text(c.value())
        info[key] = "true" if value is None else value
    samples = {s: {"values": {}, "phased": False} for s in header.samples}
    n_samples = packed & 0xFFFFFF
    f = _Cursor(each)
    for _ in range(packed >> 24):
        key = header.strings[f.value()[0]]
        kind, n = f.kind()
        for sample in header.samples[:n_samples]:
            value = f.take(kind, n)
            if key == "GT":
                samples[sample]["values"][key], samples[sample]["phased"] = _genotype(value)
            else:
                samples[sample]["values"][key] = _text(value) or "."
    return {
        "contig": header.contigs[contig], "pos": pos + 1, "stop": int(info["END"]) if info.get("END", "").isdigit() else pos + length,
        "identifiers": None if name in (None, "", ".") else name, "alleles": alleles,
        "quality": None if quality == MISSING_FLOAT else float(_one(struct.unpack("<f", struct.pack("<I", quality))[0])),
        "filters": sorted(header.strings[k] for k in filters), "info": info, "samples": samples,
    }


def _header(stream: _Stream) -> Header:
    magic = stream.read(5)
    if magic[:4] != b"BCF\2":
        raise ValueError("not a BCF2 file")
    return Header(stream.read(struct.unpack("<I", stream.read(4))[0]).decode())


def records(path: str) -> Iterator[dict]:
    """All records of a BCF file, in file order."""
    with _open(path) as raw:
        stream = _Stream(raw)
        header = _header(stream)
        while sizes := stream.read(8):
            if len(sizes) < 8:
                raise ValueError(f"{path} is cut off")
            one, two = struct.unpack("<II", sizes)
            data = stream.read(one + two)
            if len(data) < one + two:
                raise ValueError(f"{path} is cut off")
            yield record(data[:one], data[one:], header)


def header_rows(path: str) -> list[tuple[str, str, str | None]]:
    """(section, name, value) of the header's definitions and samples, as ``vcf.header`` has them."""
    with _open(path) as raw:
        return _header(_Stream(raw)).rows


def header(path: str) -> str:
    """The text of the header, with the numbers that records have for names."""
    with _open(path) as raw:
        return _header(_Stream(raw)).text


def _typed(kind: int, n: int, data: bytes = b"") -> bytes:
    """A value of ``n`` entries behind its type and length."""
    if n < 15:
        return bytes([n << 4 | kind]) + data
    return bytes([15 << 4 | kind]) + _numbers([[n]]) + data


def _numbers(rows: list[list[int | None]]) -> bytes:
    """Rows of integers of the smallest type that holds all, behind one type; short rows end early."""
    known = [v for row in rows for v in row if v is not None]
    low, high = min(known, default=0), max(known, default=0)
    kind = next((k for k, size in ((1, 8), (2, 16), (3, 32)) if -(1 << size - 1) + 8 <= low and high < 1 << size - 1), None)
    if kind is None:
        raise ValueError(f"{low if low < 0 else high} is no 32-bit integer of the format")
    n = max(map(len, rows))
    values = [MISSING[kind] if v is None else v for row in rows for v in [*row, *[END[kind]] * (n - len(row))]]
    return _typed(kind, n, struct.pack(f"<{len(values)}{TYPES[kind][0]}", *values))


def _floats(rows: list[list[float | None]]) -> bytes:
    n = max(map(len, rows))
    data = b""
    for row in rows:
        data += b"".join(struct.pack("<I", MISSING_FLOAT) if v is None else struct.pack("<f", v) for v in row)
        data += struct.pack("<I", END_FLOAT) * (n - len(row))
    return _typed(5, n, data)


def _texts(rows: list[str]) -> bytes:
    found = [r.encode() for r in rows]
    n = max(map(len, found))
    return _typed(7, n, b"".join(f.ljust(n, b"\0") for f in found))


def _values(kind: str, texts: list[str]) -> bytes:
    """Texts of one key, a row each, as values of the header's type; ``.`` is a missing one."""
    if kind not in ("Integer", "Float"):
        return _texts(texts)
    made = int if kind == "Integer" else float
    rows = [[None if x in ("", ".") else made(x) for x in t.split(",")] for t in texts]
    return (_numbers if kind == "Integer" else _floats)(rows)


def _alleles(genotype: str) -> list[int]:
    """A genotype's numbers: twice the allele and one more, plus one behind a bar."""
    found = re.findall(r"([/|]?)([^/|]+)", genotype)
    return [(0 if a == "." else int(a) + 1 << 1) | (join == "|") for join, a in found]


class Encoder:
    """Makes records of rows by a header's dictionaries; a name that it lacks raises."""

    def __init__(self, text: str):
        self.header = Header(text)
        self.strings = {v: k for k, v in self.header.strings.items()}
        self.contigs = {v: k for k, v in self.header.contigs.items()}
        self.types = {(s, n): (v or "").rpartition(":")[2] for s, n, v in self.header.rows}

    def _number(self, names: dict[str, int], name: str) -> int:
        if name not in names:
            raise ValueError(f"the header doesn't define {name}")
        return names[name]

    def __call__(self, row: dict) -> bytes:
        info, alleles, begin = row["info"] or {}, row["alleles"], row["pos"] - 1
        length = int(info["END"]) - begin if info.get("END", "").isdigit() else len(alleles[0])
        given = {n: ((row["samples"] or {}).get(n) or {}).get("values") or {} for n in self.header.samples}
        keys = sorted({k for values in given.values() for k in values}, key=lambda k: (k != "GT", k))
        quality = struct.pack("<I", MISSING_FLOAT) if row["quality"] is None else struct.pack("<f", row["quality"])
        shared = struct.pack("<iii", self._number(self.contigs, row["contig"]), begin, length) + quality
        shared += struct.pack("<HHI", len(info), len(alleles), len(keys) << 24 | len(given))
        shared += _texts([row["identifiers"] or ""]) + b"".join(_texts([a]) for a in alleles)
        filters = [self._number(self.strings, f) for f in row["filters"] or []]
        shared += _numbers([filters]) if filters else _typed(0, 0)
        for key in sorted(info):
            kind = self.types.get(("info", key), "String")
            # a flag, or a key without a value, reads as true
            value = _typed(0, 0) if info[key] == "true" and kind != "String" else _values(kind, [info[key]])
            shared += _numbers([[self._number(self.strings, key)]]) + value
        each = b""
        for key in keys:
            texts = [values.get(key) or "." for values in given.values()]
            each += _numbers([[self._number(self.strings, key)]])
            each += _numbers([_alleles(t) for t in texts]) if key == "GT" else _values(self.types.get(("format", key), "String"), texts)
        return struct.pack("<II", len(shared), len(each)) + shared + each


class BcfWriter(MemberWriter):
    def __init__(self, path: str, text: str, overwrite: bool):
        super().__init__(path, overwrite)
        self.text = text

    def head(self) -> bytes:
        text = self.text.rstrip("\0").encode() + b"\0"
        return b"BCF\2\2" + struct.pack("<I", len(text)) + text

    def encoder(self) -> Callable[[dict], bytes]:
        return Encoder(self.text)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class BcfReader(DataSourceReader):
    def __init__(self, paths: list[str], schema: pa.Schema):
        self.paths, self.schema = paths, schema

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition):
        batch = partial(pa.RecordBatch.from_pylist, schema=self.schema)
        rows = []
        for r in records(partition.path):
            rows.append(r | {"info": list(r["info"].items()), "samples": [(k, s | {"values": list(s["values"].items())}) for k, s in r["samples"].items()]})
            if len(rows) == BATCH:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)


class BcfDataSource(DataSource):
    """``spark.read.format("bcf").option("paths", "a.bcf,b.bcf").load()``."""

    @classmethod
    def name(cls) -> str:
        return "bcf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BcfReader:
        from pyspark.sql.pandas.types import to_arrow_schema

        paths = self.options.get("paths") or self.options["path"]
        return BcfReader(paths.split(","), to_arrow_schema(schema))

    def writer(self, schema, overwrite: bool) -> BcfWriter:
        return BcfWriter(self.options["path"], self.options["header"], overwrite)


def read(spark: SparkSession, *paths: str) -> DataFrame:
    """The records of BCF files."""
    spark.dataSource.register(BcfDataSource)
    return spark.read.format("bcf").option("paths", ",".join(paths)).load()


def write(records: DataFrame, path: str, text: str, force: bool = False) -> None:
    """Writes records (the columns of ``SCHEMA`` but stop) as one BCF file with a header's text, in the order of its contigs."""
    records.sparkSession.dataSource.register(BcfDataSource)
    contigs = F.array(*(F.lit(name) for name in Header(text).contigs.values())).cast("array<string>")
    rows = records.select("contig", "pos", "identifiers", "alleles", F.col("quality").cast("double"), "filters", "info", "samples")
    rows = rows.orderBy(F.array_position(contigs, F.col("contig")), "pos", "alleles")
    rows.write.format("bcf").mode("overwrite" if force else "append").option("header", text).save(path)
