"""Text formats as data sources: `spark.read.format(...)` and `spark.readStream.format(...)` over a folder.

`prometheus_text`  path, line, metric, labels, value, bad      exposition lines of gauges; comments are skipped
`subtitles_srt`    path, place, start, end, text, bad          blocks of subtitle files
`agent_events`     path, line, event, bad                      lines of an agent's log that are JSON objects
`checked_shards`   the schema that is given, with path, error  Parquet or JSON-lines shards, each good as a whole or set apart

A line or block that is none is a row with its text in `bad` and nothing else. Files go to partitions of about
`partitionBytes` (a larger file is one of its own) and are read line by line. A stream takes all that has come to the
folder since the last trigger; its offset is the last file by time and name. Options: path, glob, partitionBytes.
"""

from __future__ import annotations

import fnmatch
import gzip
import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

ROWS = 4096  # of a batch
SAMPLE = re.compile(r"([A-Za-z_:][A-Za-z0-9_:]*)(?:\{(.*)\})?\s+([-+]?(?:[0-9.]+(?:[eE][-+]?[0-9]+)?|Inf|NaN))(?:\s+-?[0-9]+)?$")
LABEL = re.compile(r'([A-Za-z_]\w*)="((?:[^"\\]|\\.)*)"\s*(?:,|$)')
TIMES = re.compile(r"([0-9]+):([0-9]+):([0-9]+)[,.]([0-9]+)\s*-->\s*([0-9]+):([0-9]+):([0-9]+)[,.]([0-9]+)")


@dataclass
class Files(InputPartition):
    paths: list[str]


def _found(options: dict) -> tuple[pafs.FileSystem, list[pafs.FileInfo]]:
    path, glob = options["path"], options.get("glob", "*")
    fs, root = pafs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:", path) else (pafs.LocalFileSystem(), path)
    listed = fs.get_file_info(pafs.FileSelector(root, recursive=True)) if fs.get_file_info(root).type == pafs.FileType.Directory else [fs.get_file_info(root)]
    keep = [f for f in listed if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name, glob) and not re.search(r"/[._][^/]*(/|$)", f.path[len(root) :])]
    return fs, sorted(keep, key=lambda f: (f.mtime_ns or 0, f.path))


def _grouped(files: list[pafs.FileInfo], most: int) -> list[Files]:
    out, size = [], most
    for f in files:
        if size + f.size > most or not out:
            out.append(Files([]))
            size = 0
        out[-1].paths.append(f.path)
        size += f.size
    return out


class _Reader:
    def __init__(self, options: dict, parse, schema: StructType):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.options, self.parse, self.schema = {k.lower(): v for k, v in options.items()}, parse, to_arrow_schema(schema)

    def _read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.options["path"]) if re.match(r"[a-z][a-z0-9+.-]*:", self.options["path"]) else (pafs.LocalFileSystem(), "")
        held: list[dict] = []
        for path in partition.paths:
            for row in self.parse(fs, path, self.schema):
                held.append(row)
                if len(held) >= ROWS:
                    yield pa.RecordBatch.from_pylist(held, self.schema)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, self.schema)


class Reader(_Reader, DataSourceReader):
    def partitions(self) -> list[Files]:
        return _grouped(_found(self.options)[1], int(self.options.get("partitionbytes", 64 << 20))) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self._read(partition)


class StreamReader(_Reader, DataSourceStreamReader):
    """Offsets name the last file that was read, by time and path: as long however many files there are."""

    def __init__(self, options: dict, parse, schema: StructType):
        super().__init__(options, parse, schema)
        self.now: dict | None = None

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    @staticmethod
    def _after(files: list[pafs.FileInfo], at: dict) -> list[pafs.FileInfo]:
        return [f for f in files if (f.mtime_ns or 0, f.path) > (at["time"], at["path"])]

    def latestOffset(self) -> dict:
        self.now = self.now or self.initialOffset()
        new = self._after(_found(self.options)[1], self.now)
        if new:
            self.now = {"time": new[-1].mtime_ns or 0, "path": new[-1].path}
        return self.now

    def partitions(self, start: dict, end: dict) -> list[Files]:
        self.now = max(self.now or end, end, key=lambda o: (o["time"], o["path"]))
        new = [f for f in self._after(_found(self.options)[1], start) if (f.mtime_ns or 0, f.path) <= (end["time"], end["path"])]
        return _grouped(new, int(self.options.get("partitionbytes", 64 << 20)))

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self._read(partition)

    def commit(self, end: dict) -> None:
        pass


def _lines(fs: pafs.FileSystem, path: str) -> Iterator[tuple[int, str]]:
    with fs.open_input_stream(path) as f:  # opens compressed files by their suffix
        yield from enumerate((line.rstrip("\r\n") for line in io.TextIOWrapper(f, "utf-8", errors="replace")), 1)


def gauges(fs, path: str, schema) -> Iterator[dict]:
    for n, line in _lines(fs, path):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        m = SAMPLE.match(line)
        labels = dict(LABEL.findall(m[2] or "")) if m else {}
        if m and not LABEL.sub("", m[2] or "").strip():
            yield {"path": path, "line": n, "metric": m[1], "labels": labels, "value": float(m[3])}
        else:
            yield {"path": path, "line": n, "bad": line}


def captions(fs, path: str, schema) -> Iterator[dict]:
    """Blocks between blank lines, held one at a time."""
    block: list[str] = []
    place = 0
    for _, line in _with_end(fs, path):
        if line.strip():
            block.append(line.strip())
            continue
        if block:
            at = next((k for k, x in enumerate(block) if TIMES.search(x)), None)
            if at is None:
                yield {"path": path, "place": place, "bad": "\n".join(block)}
            else:
                parts = TIMES.search(block[at]).groups()
                yield {"path": path, "place": place, "start": _seconds(*parts[:4]), "end": _seconds(*parts[4:]), "text": " ".join(block[at + 1 :])}
            block, place = [], place + 1


def _seconds(hours: str, minutes: str, seconds: str, part: str) -> float:
    return int(hours) * 3600 + int(minutes) * 60 + int(seconds) + float(f"0.{part}")


def _with_end(fs, path: str) -> Iterator[tuple[int, str]]:
    yield from _lines(fs, path)
    yield 0, ""


def logged_events(fs, path: str, schema) -> Iterator[dict]:
    for n, line in _lines(fs, path):
        if not line.strip():
            continue
        try:
            good = isinstance(json.loads(line), dict)
        except ValueError:
            good = False
        yield {"path": path, "line": n, "event" if good else "bad": line}


def checked(fs, path: str, schema: pa.Schema) -> Iterator[dict]:
    """A shard's rows, if all of it can be read (a pass before the one that gives them), else one row with the error."""
    try:
        for _ in _shard(fs, path):
            pass
    except Exception as e:  # whatever a broken file makes its reader say
        yield {"path": path, "error": f"{type(e).__name__}: {e}"[:500]}
        return
    names = [n for n in schema.names if n not in ("path", "error")]
    for row in _shard(fs, path):
        yield {n: row.get(n) for n in names} | {"path": path}


def _shard(fs, path: str) -> Iterator[dict]:
    if path.endswith(".parquet"):
        with fs.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(ROWS):
                yield from batch.to_pylist()
        return
    with fs.open_input_stream(path, compression=None) as f:
        raw = gzip.GzipFile(fileobj=f) if path.endswith(".gz") else f
        for line in io.TextIOWrapper(raw, "utf-8"):
            if line.strip():
                row = json.loads(line)
                if not isinstance(row, dict):
                    raise ValueError("a line that is no object")
                yield row


class _Format(DataSource):
    columns, parse = "", None

    def schema(self) -> str:
        return self.columns

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(self.options, type(self).parse, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return StreamReader(self.options, type(self).parse, schema)


class PrometheusText(_Format):
    columns, parse = "path string, line long, metric string, labels map<string,string>, value double, bad string", staticmethod(gauges)

    @classmethod
    def name(cls) -> str:
        return "prometheus_text"


class SubtitlesSrt(_Format):
    columns, parse = "path string, place long, start double, end double, text string, bad string", staticmethod(captions)

    @classmethod
    def name(cls) -> str:
        return "subtitles_srt"


class AgentEvents(_Format):
    columns, parse = "path string, line long, event string, bad string", staticmethod(logged_events)

    @classmethod
    def name(cls) -> str:
        return "agent_events"


class CheckedShards(_Format):
    columns, parse = "path string, error string", staticmethod(checked)

    @classmethod
    def name(cls) -> str:
        return "checked_shards"


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session."""
    for source in (PrometheusText, SubtitlesSrt, AgentEvents, CheckedShards):
        spark.dataSource.register(source)
