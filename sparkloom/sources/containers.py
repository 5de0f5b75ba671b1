"""Tensor containers as Spark data sources: a catalog row for each tensor, payload rows for byte ranges.

safetensors: an 8-byte little-endian header length, a JSON header (name -> dtype, shape, data_offsets), the payload.
GGUF: magic, version, counts, typed key-values, tensor infos, then the aligned payload.

Each file is one input partition, or, for payloads, each CHUNK bytes of a file, so a container of any size is read in
bounded pieces.
"""

from __future__ import annotations

import glob
import json
import os
import struct
from collections.abc import Iterator
from typing import Any, BinaryIO

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNK = 8 << 20
#: A header larger than this is refused.
MAX_HEADER = 256 << 20
#: Numbers of the GGUF value types with their struct formats; fixed values.
GGUF_SCALARS = {0: "<B", 1: "<b", 2: "<H", 3: "<h", 4: "<I", 5: "<i", 6: "<f", 7: "<?", 10: "<Q", 11: "<q", 12: "<d"}
GGUF_STRING, GGUF_ARRAY = 8, 9
#: Bits of an element by dtype; fixed values.
SAFETENSORS_BYTES = {"BOOL": 1, "U8": 1, "I8": 1, "F8_E4M3": 1, "F8_E8M0": 1, "I16": 2, "F16": 2, "BF16": 2, "I32": 4, "F32": 4, "I64": 8, "F64": 8}


def files_of(path: str, suffix: str) -> list[str]:
    """The files under a path or pattern, sorted."""
    path = path.removeprefix("file://")
    if os.path.isdir(path):
        return sorted(glob.glob(os.path.join(glob.escape(path), f"*{suffix}")))
    return sorted(glob.glob(path))


def safetensors_header(f: BinaryIO, size: int) -> tuple[int, dict[str, Any]]:
    """(start of the payload, header)."""
    raw = f.read(8)
    if len(raw) < 8:
        raise ValueError("no header length")
    n = struct.unpack("<Q", raw)[0]
    if not 2 <= n <= min(MAX_HEADER, size - 8):
        raise ValueError(f"header of {n} bytes in a file of {size}")
    return 8 + n, json.loads(f.read(n))


def safetensors_rows(path: str) -> Iterator[tuple]:
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        base, header = safetensors_header(f, size)
    for name, info in header.items():
        if name == "__metadata__":
            continue
        start, end = info["data_offsets"]
        count = 1
        for d in info["shape"]:
            count *= d
        if not 0 <= start <= end <= size - base or count * SAFETENSORS_BYTES[info["dtype"]] != end - start:
            raise ValueError(f"{name}: offsets {start}, {end} do not fit {info['dtype']} {info['shape']}")
        yield name, os.path.basename(path), info["dtype"], [int(d) for d in info["shape"]], base + start, base + end


class Gguf:
    """Header of one file: version, key-values, tensor infos and where the payload begins."""

    def __init__(self, path: str) -> None:
        self.size = os.path.getsize(path)
        with open(path, "rb") as f:
            self.f = f
            if f.read(4) != b"GGUF":
                raise ValueError("not a GGUF file")
            self.version = self._scalar("<I")
            if self.version not in (2, 3):
                raise ValueError(f"version {self.version}")
            tensors, pairs = self._scalar("<Q"), self._scalar("<Q")
            self.values: list[tuple[str, int, Any]] = []
            for _ in range(pairs):
                key, kind = self._text(), self._scalar("<I")
                self.values.append((key, kind, self._value(kind)))
            infos = []
            for _ in range(tensors):
                name = self._text()
                dims = [self._scalar("<Q") for _ in range(self._scalar("<I"))]
                infos.append((name, dims, self._scalar("<I"), self._scalar("<Q")))
            align = next((v for k, _, v in self.values if k == "general.alignment"), 32)
            self.payload = -(-f.tell() // align) * align
        starts = sorted({o for *_, o in infos})
        following = dict(zip(starts, [*starts[1:], self.size - self.payload], strict=True))
        # the distance to the next offset, so padding counts
        self.tensors = [(n, d, t, self.payload + o, self.payload + following[o]) for n, d, t, o in infos]

    def _scalar(self, form: str) -> Any:
        raw = self.f.read(struct.calcsize(form))
        return struct.unpack(form, raw)[0]

    def _text(self) -> str:
        n = self._scalar("<Q")
        if n > self.size:
            raise ValueError("a string longer than the file")
        return self.f.read(n).decode()

    def _value(self, kind: int) -> Any:
        if kind == GGUF_STRING:
            return self._text()
        if kind == GGUF_ARRAY:
            inner, n = self._scalar("<I"), self._scalar("<Q")
            return [self._value(inner) for _ in range(n)]
        return self._scalar(GGUF_SCALARS[kind])


class _Files(InputPartition):
    def __init__(self, path: str, start: int = 0, end: int = 0) -> None:
        super().__init__((path, start, end))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], suffix: str, table: str) -> None:
        self.path, self.suffix, self.table = options["path"], suffix, table
        self.chunk = int(options.get("chunk", CHUNK))

    def partitions(self) -> list[InputPartition]:
        files = files_of(self.path, self.suffix)
        if self.table != "payload":
            return [_Files(p) for p in files] or [_Files("")]
        return [_Files(p, a, min(a + self.chunk, os.path.getsize(p))) for p in files for a in range(0, os.path.getsize(p), self.chunk)] or [_Files("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path, start, end = partition.value
        if not path:
            return
        if self.table == "payload":
            yield from self._payload(path, start, end)
        elif self.suffix == ".safetensors":
            yield from safetensors_rows(path)
        elif self.table == "values":
            for key, kind, value in Gguf(path).values:
                yield os.path.basename(path), key, kind, json.dumps(value)
        else:
            for name, dims, kind, a, b in Gguf(path).tensors:
                yield name, os.path.basename(path), str(kind), dims, a, b

    def _payload(self, path: str, start: int, end: int) -> Iterator[tuple]:
        """(name, file, offset in the tensor, bytes) of what tensors hold between two file offsets."""
        rows = safetensors_rows(path) if self.suffix == ".safetensors" else ((n, os.path.basename(path), str(t), d, a, b) for n, d, t, a, b in Gguf(path).tensors)
        with open(path, "rb") as f:
            for name, file, _, _, a, b in rows:
                low, high = max(a, start), min(b, end)
                if low < high:
                    f.seek(low)
                    yield name, file, low - a, f.read(high - low)


CATALOG = "name string, file string, dtype string, shape array<bigint>, start bigint, end bigint"
VALUES = "file string, key string, kind int, value string"
PAYLOAD = "name string, file string, offset bigint, data binary"


class SafetensorsSource(DataSource):
    """spark.read.format("safetensors").option("table", "catalog" | "payload").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "safetensors"

    def schema(self) -> str:
        return PAYLOAD if self.options.get("table") == "payload" else CATALOG

    def reader(self, schema: Any) -> DataSourceReader:
        return _Reader(dict(self.options), ".safetensors", self.options.get("table", "catalog"))


class GgufSource(DataSource):
    """spark.read.format("gguf").option("table", "catalog" | "values" | "payload").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "gguf"

    def schema(self) -> str:
        return {"payload": PAYLOAD, "values": VALUES}.get(self.options.get("table", ""), CATALOG)

    def reader(self, schema: Any) -> DataSourceReader:
        return _Reader(dict(self.options), ".gguf", self.options.get("table", "catalog"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SafetensorsSource)
    spark.dataSource.register(GgufSource)
