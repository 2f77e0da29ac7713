"""The file readers as Spark data sources: register(spark), then spark.read.format("rinex_obs").load(path) and so on.

One input partition is one file; files are opened on the executors, so the path must be one that they see: a shared folder, or the URI
of a store that Arrow knows. `.gz` files are unpacked. Options since, until and interval screen observations while reading. Streams read growing
files by ranges of bytes."""

from __future__ import annotations

import fnmatch
import gzip
import io
import itertools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..kernels import rtcm
from . import grids, rinex


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (file:, hdfs:, s3: and so on), and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _opened(path: str) -> pa.NativeFile:
    store, inside = _store(path)
    return store.open_input_file(inside)


def _lines(path: str) -> Iterator[str]:
    with _opened(path) as f, gzip.open(f, "rt") if path.endswith(".gz") else io.TextIOWrapper(f) as text:
        yield from text


def _files_with_sizes(path: str) -> list[tuple[str, int]]:
    """Files of a folder, or those that fit a pattern in their last part, in the order of their names, and their sizes."""
    store, inside = _store(path)
    inside = inside.rstrip("/")
    folder, last = (inside, "*") if store.get_file_info(inside).type == fs.FileType.Directory else os.path.split(inside)
    start = path[: len(path.rstrip("/")) - len(inside)] if "://" in path or path.startswith("file:") else ""
    found = store.get_file_info(fs.FileSelector(folder or ".", allow_not_found=True))
    return sorted((start + f.path, f.size) for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, last) and not f.base_name.startswith(("_", ".")))


def _files(path: str) -> list[str]:
    return [p for p, _ in _files_with_sizes(path)]


class FilePart(InputPartition):
    def __init__(self, path: str, number: int):
        self.path, self.number = path, number


class FileReader(DataSourceReader):
    def __init__(self, options: dict, rows):
        self.options, self.rows = options, rows

    def partitions(self) -> list[FilePart]:
        return [FilePart(p, i) for i, p in enumerate(_files(self.options["path"]))]

    def read(self, partition: FilePart) -> Iterator[tuple]:
        yield from self.rows(partition, self.options)


def _number(options: dict, key: str) -> float | None:
    return float(options[key]) if key in options else None


def _observations(part: FilePart, o: dict) -> Iterator[tuple]:
    for row in rinex.observations(_lines(part.path), _number(o, "since"), _number(o, "until"), _number(o, "interval") or 0.0):
        yield (part.number + 1, *row)


def _navigation(part: FilePart, o: dict) -> Iterator[tuple]:
    for e in rinex.navigation(_lines(part.path)):
        yield part.number + 1, e["sat"], e["toc"], {k: float(v) for k, v in e.items() if k not in ("sat", "toc")}


def _stations(part: FilePart, o: dict) -> Iterator[tuple]:
    s = rinex.header(iter(_lines(part.path)))["station"]
    yield part.number + 1, s.get("name"), s.get("antdes"), s.get("antsno"), s.get("rectype"), s.get("recver"), s.get("pos"), s.get("del")


def _frames(part: FilePart, o: dict) -> Iterator[tuple]:
    f, n, chunk = rtcm.Framer(), 0, int(o.get("chunk", 65536))
    with _opened(part.path) as src:
        while data := src.read(chunk):
            for body in f.feed(data):
                yield part.number + 1, n, rtcm.number(body), rtcm.return_class(rtcm.number(body)), body
                n += 1


def _plain(parse):
    return lambda part, o: ((part.number + 1, *row) for row in parse(_lines(part.path)))


def _antennas(part: FilePart, o: dict) -> Iterator[tuple]:
    for a in grids.antex(_lines(part.path)):
        yield part.number + 1, a["type"], a["serial"], a["since"], a["until"], a["offsets"], a["variations"]


#: Format -> columns and rows of one file.
FORMATS = {
    "rinex_obs": ("rcv int, t double, sat string, code string, value double, lli int, strength int", _observations),
    "rinex_nav": ("file int, sat string, toc double, eph map<string,double>", _navigation),
    "rinex_station": ("rcv int, name string, antdes string, antsno string, rectype string, recver string, pos array<double>, del array<double>", _stations),
    "rinex_clk": ("file int, t double, sat string, clock double, std double", _plain(rinex.clocks)),
    "sp3": ("file int, t double, sat string, x double, y double, z double, clock double", _plain(grids.sp3)),
    "ionex": ("file int, t double, kind string, height double, lat double, lon double, value double", _plain(grids.ionex)),
    "antex": ("file int, type string, serial string, since double, until double, offsets map<string,array<double>>, variations map<string,array<double>>", _antennas),
    "rtcm3": ("srcid int, seq int, type int, class int, body binary", _frames),
}


def _source(name: str) -> type[DataSource]:
    columns, rows = FORMATS[name]

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return columns

        def reader(self, schema) -> DataSourceReader:
            return FileReader(dict(self.options), rows)

    return Source


class ByteRange(InputPartition):
    def __init__(self, path: str, number: int, start: int, end: int):
        self.path, self.number, self.start, self.end = path, number, start, end


class GrowingFiles(DataSourceStreamReader):
    """Files that grow, and new ones. An offset is the position up to which each file counts; a batch is the bytes between two offsets, in
    ranges of `part_bytes` that tasks open by themselves. The reader keeps nothing, so a query that was stopped goes on from its checkpoint. Files are numbered
    in the order of their names: those of later files have to come after the others."""

    step = 1  # ranges begin at multiples of it after the batch's own start

    def __init__(self, options: dict):
        self.options, self.size = options, max(1, int(options.get("part_bytes", 8 << 20)))

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def whole(self, path: str, size: int) -> int:
        """Position up to which the file is complete."""
        return size

    def latestOffset(self) -> dict:  # noqa: N802
        return {p: self.whole(p, size) for p, size in _files_with_sizes(self.options["path"])}

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        out, size = [], -(-self.size // self.step) * self.step
        for i, path in enumerate(sorted(end)):
            first, last = start.get(path, 0), end[path]
            if path.endswith(".gz"):  # can't be entered in the middle
                out += [ByteRange(path, i, 0, last)] if last > first else []
                continue
            out += [ByteRange(path, i, a, min(a + size, last)) for a in range(first, last, size)]
        return out

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class ByteReader(GrowingFiles):
    """Chunks of a byte stream that is being recorded: (srcid, offset, payload)."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.step = int(options.get("chunk", 1024))

    def read(self, partition: ByteRange) -> Iterator[tuple]:
        with _opened(partition.path) as f:
            f.seek(partition.start)
            for at in range(partition.start, partition.end, self.step):
                yield partition.number + 1, at, f.read(min(self.step, partition.end - at))


class ByteReplay(DataSource):
    """A caster stream as it is recorded to files; live sockets need a network and stand behind the same columns."""

    @classmethod
    def name(cls) -> str:
        return "byte_replay"

    def schema(self) -> str:
        return "srcid int, offset long, payload binary"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return ByteReader(dict(self.options))


#: Bytes at a file's end in which its last epoch is looked for, and at its start in which its header is.
TAIL, HEAD = 1 << 16, 1 << 18


def _head(path: str) -> tuple[list[bytes], int]:
    """A file's header lines and where they end; none if the header isn't complete."""
    with _opened(path) as f:
        text = f.read(HEAD)
    at = text.find(b"END OF HEADER")
    end = text.find(b"\n", at) + 1 if at >= 0 else 0
    return text[:end].splitlines(keepends=True), end


class EpochReader(GrowingFiles):
    """Observation files while they are written. Version 3 marks epochs, so ranges of bytes are enough: a task begins with the first epoch that starts in its
    range and ends with the last one, and the end of what is complete is found in the file's tail. Version 2 has no marks: the driver counts the lines
    of new epochs, and what is new in a file is one range."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.counted: dict[str, int] = {}

    def whole(self, path: str, size: int) -> int:
        if path.endswith(".gz"):
            return size
        head, end = _head(path)
        if not end:
            return 0
        if rinex.header(line.decode() for line in head)["version"] < 3:
            return self._counted(path, head, end)
        first = max(end, size - TAIL)
        while True:
            with _opened(path) as f:
                f.seek(first)
                tail = f.read(size - first)
            at = len(tail) - len(tail.lstrip(b"\r\n")) if first == end and tail.lstrip(b"\r\n").startswith(b">") else -1
            at = max(at, tail.rfind(b"\n>") + 1 or -1)
            if at >= 0:
                lines = tail[at:].split(b"\n")
                n = lines[0].split()
                full = len(n) > 8 and n[8].isdigit() and len(lines) - 2 >= int(n[8])  # each line has its end
                return first + len(tail) if full and tail.endswith(b"\n") else first + at
            if first == end:
                return end
            first = max(end, first - 4 * TAIL)

    def _counted(self, path: str, head: list[bytes], end: int) -> int:
        per = -(-len(rinex.header(line.decode() for line in head)["order2"]) // 5)
        at = max(end, self.counted.get(path, 0))
        with _opened(path) as f:
            f.seek(at)
            lines = f.read().split(b"\n")[:-1]
        k = 0
        while k < len(lines):
            line = lines[k]
            need = 1
            if len(line) >= 32 and line[:26].strip() and line[29:32].strip().isdigit():
                n, flag = int(line[29:32]), int(line[28:29]) if line[28:29].isdigit() else 0
                need = 1 + n if flag > 1 else 1 + max(0, -(-(n - 12) // 12)) + n * per
            if k + need > len(lines):
                break
            at += sum(len(v) + 1 for v in lines[k : k + need])
            k += need
        self.counted[path] = at
        return at

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        whole = {p for p in end if not p.endswith(".gz") and rinex.header(v.decode() for v in _head(p)[0])["version"] < 3}
        out = [r for r in super().partitions(start, end) if r.path not in whole]
        names = sorted(end)
        return out + [ByteRange(p, names.index(p), start.get(p, 0), end[p]) for p in sorted(whole) if end[p] > start.get(p, 0)]

    def read(self, partition: ByteRange) -> Iterator[tuple]:
        if partition.path.endswith(".gz"):
            lines: Iterator[str] = _lines(partition.path)
        else:
            head, end = _head(partition.path)
            v3 = rinex.header(v.decode() for v in head)["version"] >= 3
            lines = itertools.chain((v.decode() for v in head), self._between(partition, max(end, partition.start), v3))
        for row in rinex.observations(lines):
            yield (partition.number + 1, *row)

    def _between(self, part: ByteRange, at: int, v3: bool) -> Iterator[str]:
        """Lines of the epochs that start in the range."""
        with _opened(part.path) as raw, io.BufferedReader(raw) as f:
            if v3 and at == part.start and at > 0:  # is this the start of a line?
                f.seek(at - 1)
                at += len(f.readline()) - 1
            f.seek(at)
            inside = not v3
            while line := f.readline():
                if v3 and line.startswith(b">"):
                    inside = True
                    if at >= part.end:
                        return
                elif not v3 and at >= part.end:
                    return
                at += len(line)
                if inside:
                    yield line.decode()


class EpochReplay(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rinex_replay"

    def schema(self) -> str:
        return FORMATS["rinex_obs"][0]

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return EpochReader(dict(self.options))


def register(spark: SparkSession) -> None:
    for name in FORMATS:
        spark.dataSource.register(_source(name))
    for source in (ByteReplay, EpochReplay):
        spark.dataSource.register(source)
