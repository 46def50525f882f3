"""A Spark data source of EDF, BDF, WAV and WFDB files that is planned from their headers and read by byte ranges.

The planner opens each file for its header alone; every partition is a range of data records of about SPLIT bytes, read and
decoded by itself, so that a file of any size is spread over many tasks. Channels that aren't asked for aren't decoded, and
signal files and parts of a record that aren't asked for aren't read. Rows leave as Arrow batches.

    spark.dataSource.register(Recordings)
    spark.read.format("undula-recordings").option("kind", "edf").option("paths", json.dumps([...])).load()

`what` says which rows come: `samples` (pieces of a channel, the default), `recordings` (from the headers alone) or `marks`
(annotations). Paths are local ones or of any store that pyarrow.fs opens.
"""

from __future__ import annotations

import json
import struct
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from undula.sources import formats

#: Bytes of a partition, and samples of a channel that travel as one row.
SPLIT, PIECE = 16 << 20, 1 << 15
SCHEMAS = {
    "samples": "rec string, fs double, unit string, first long, values array<double>",
    "recordings": "rec string, fs double, unit string, n long",
    "marks": "rec string, onset double, duration double, label string, aux string",
}


class NoSuchStore(ValueError):
    """A path of a store that only Spark opens."""


class NoChannel(ValueError):
    """A channel that no file has."""


def opened(path: str) -> pa.NativeFile:
    scheme, colon, rest = path.partition(":")
    if colon and scheme == "file":
        path = "/" + rest.lstrip("/")
    if path.startswith("/"):
        return pyarrow.fs.LocalFileSystem().open_input_file(path)
    try:
        store, inner = pyarrow.fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, OSError, ImportError) as e:
        raise NoSuchStore(f"{path}: {e}") from e
    return store.open_input_file(inner)


@dataclass
class Channel:
    """A channel of a file: its values are (digital - zero) * gain + base of what its `columns` of a record hold."""

    name: str
    fs: float
    unit: str
    start: int
    count: int
    zero: float = 0.0
    gain: float = 1.0
    base: float = 0.0


@dataclass
class Layout:
    """Where a file's data stand: `records` of so many bytes from `offset` on. `unit_records` is what has to be read together."""

    path: str
    stem: str
    code: str
    offset: int
    size: int
    records: int
    channels: list[Channel]
    marks: list[Channel] = field(default_factory=list)
    first: int = 0
    unit_records: int = 1
    seconds: float = 0.0


def stem_of(path: str) -> str:
    name = path.rstrip("/").rpartition("/")[2]
    return name.rpartition(".")[0] or name


def edf_layout(path: str, open_=opened) -> list[Layout]:
    with open_(path) as f:
        h = formats.edf_header(f.read_at(256, 0), lambda n: f.read_at(n, 256), f.size())
    starts = np.cumsum([0, *h["counts"]]).tolist()
    code = f"i{h['wide']}"
    channels, marks = [], []
    for i, name in enumerate(h["labels"]):
        if name in formats.EDF_MARKS:
            marks.append(Channel(name, 0.0, "", starts[i], h["counts"][i]))
        elif h["dmax"][i] != h["dmin"][i] and h["seconds"] > 0:  # a channel without a range, or a file without a clock, has no values
            gain = (h["pmax"][i] - h["pmin"][i]) / (h["dmax"][i] - h["dmin"][i])
            channels.append(Channel(name, h["counts"][i] / h["seconds"], h["units"][i], starts[i], h["counts"][i], h["dmin"][i], gain, h["pmin"][i]))
    return [Layout(path, stem_of(path), code, h["size"], starts[-1] * h["wide"], h["records"], channels, marks, seconds=h["seconds"])]


def wav_layout(path: str, open_=opened) -> list[Layout]:
    with open_(path) as f:
        h = formats.wav_header(f.read_at, f.size())
    names = ["left", "right"] if h["channels"] == 2 else [f"ch{i}" for i in range(h["channels"])]
    channels = [Channel(n, h["rate"], "", i, 1, h["zero"], h["gain"]) for i, n in enumerate(names)]
    return [Layout(path, stem_of(path), h["code"], h["offset"], h["frame"], h["frames"], channels)]


def wfdb_layout(path: str, open_=opened) -> list[Layout]:
    """The signal files of a header, those that aren't there aside; samples of format 212 stand in pairs, so that two frames are
    read together."""
    with open_(path) as f:
        h = formats.wfdb_header(f.read().decode("latin-1"))
    folder, out = path.rpartition("/")[0], []
    for name in dict.fromkeys(s["file"] for s in h["signals"]):
        own = [s for s in h["signals"] if s["file"] == name]
        code, bits = formats.WFDB_CODES[own[0]["format"]]
        try:
            with open_(f"{folder}/{name}") as f:
                there = (f.size() - own[0]["offset"]) * 8 // bits // len(own)
        except FileNotFoundError:
            continue
        channels = [Channel(s["name"], h["fs"], s["unit"], i, 1, s["baseline"], 1 / s["gain"]) for i, s in enumerate(own)]
        pair = 2 if code == "212" else 1
        out.append(Layout(f"{folder}/{name}", stem_of(path), code, own[0]["offset"], len(own) * bits * pair // 8, min(there, h["n"] or there), channels, unit_records=pair))
    return out


LAYOUTS = {"edf": edf_layout, "wav": wav_layout, "wfdb": wfdb_layout}
#: What a file that isn't of its format may raise.
BROKEN = (ValueError, KeyError, IndexError, ArithmeticError, struct.error, OSError, pa.ArrowException)


@dataclass
class Range(InputPartition):
    """Records first .. first + records - 1 of a layout; all of a header's channels, without data, for `recordings`."""

    layout: Layout
    first: int
    records: int


class Recordings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "undula-recordings"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("what", "samples")]

    def reader(self, schema) -> DataSourceReader:
        return RangeReader(dict(self.options))


class RangeReader(DataSourceReader):
    def __init__(self, options: dict, open_=opened):
        self.open_ = open_
        self.what, self.kind = options.get("what", "samples"), options["kind"]
        self.paths = json.loads(options["paths"])
        self.channels = json.loads(options.get("channels") or "null")
        self.one_rate = options.get("onerate") == "true"
        self.start, self.end = float(options.get("start") or 0), float(options["end"]) if options.get("end") else None
        self.strict = options.get("strict") == "true"

    def _layouts(self, path: str) -> list[Layout]:
        try:
            return LAYOUTS[self.kind](path, self.open_)
        except NoSuchStore:
            raise
        except BROKEN:
            if self.strict:
                raise
            return []

    def partitions(self) -> list[Range]:
        with ThreadPoolExecutor(16) as pool:
            found = [x for each in pool.map(self._layouts, self.paths) for x in each]
        if self.channels and found and (absent := set(self.channels) - {c.name for x in found for c in x.channels}):
            raise NoChannel(f"no channels {sorted(absent)}; there are {sorted({c.name for x in found for c in x.channels})}")
        out = []
        for x in found:
            if self.channels:
                x.channels = [c for c in x.channels if c.name in self.channels]
            elif self.one_rate and x.channels:
                rates = Counter(c.fs for c in x.channels)
                most = max(rates, key=lambda r: (rates[r], -r))
                x.channels = [c for c in x.channels if c.fs == most]
            if self.what == "marks":
                x.channels = []
            if not (x.channels or (self.what == "marks" and x.marks)):
                continue
            if self.what != "marks" and (self.start or self.end is not None):
                fs = x.channels[0].fs
                x.first = min(max(round(self.start * fs), 0), x.records)
                x.records = max(x.first, min(x.records, round(self.end * fs) if self.end is not None else x.records))
            if self.what == "recordings":
                out.append(Range(x, x.first, x.records - x.first))
                continue
            step = max(1, SPLIT // x.size) * x.unit_records
            low = x.first // x.unit_records * x.unit_records
            out += [Range(x, a, min(step, x.records - a)) for a in range(low, x.records, step)]
        return out or [Range(Layout("", "", "", 0, 0, 0, []), 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        x = part.layout
        if self.what == "recordings":
            rows = [(f"{x.stem}/{c.name}", c.fs, c.unit, part.records * c.count) for c in x.channels]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*rows, strict=True)], ["rec", "fs", "unit", "n"])
            return
        if not part.records:
            return
        with self.open_(x.path) as f:
            blocks = -(-part.records // x.unit_records)
            raw = f.read_at(blocks * x.size, x.offset + part.first // x.unit_records * x.size)
        if self.what == "marks":
            rows = [(x.stem, *m, "") for c in x.marks for m in formats.tal(formats.part_of(raw, x.size, c.start, c.count, x.code))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*rows, strict=True)], ["rec", "onset", "duration", "label", "aux"])
            return
        digital = formats.digital(raw, x.code, sum_counts(x))
        for c in x.channels:
            values = (digital[:, c.start : c.start + c.count].reshape(-1) - c.zero) * c.gain + c.base
            at = part.first * c.count
            cut = max(0, x.first * c.count - at)
            values, at = values[cut : part.records * c.count], at + cut - x.first * c.count
            for a in range(0, len(values), PIECE):
                own = values[a : a + PIECE]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{x.stem}/{c.name}"]), pa.array([c.fs]), pa.array([c.unit]), pa.array([at + a]), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), pa.array(own))],
                    ["rec", "fs", "unit", "first", "values"],
                )


def sum_counts(x: Layout) -> int:
    """Values in a record."""
    return x.size * 8 // formats.BITS[x.code] // x.unit_records


def in_memory(spark, options: dict, contents):
    """The same rows as the source's from (path, content) rows, for stores that only Spark opens: each row is read as a whole. Of
    a WFDB record the rows are (path, content, file, data): the header's, and one of its signal files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held = {row["path"]: row["content"]}
                if row.get("file"):
                    held[row["file"]] = row["data"]

                def open_(path: str, held=held) -> pa.NativeFile:
                    if path not in held:
                        raise FileNotFoundError(path)
                    return pa.BufferReader(held[path])

                reader = RangeReader(options | {"paths": json.dumps([row["path"]]), "channels": ""}, open_)
                for part in reader.partitions():
                    if wanted := json.loads(options.get("channels") or "null"):
                        part.layout.channels = [c for c in part.layout.channels if c.name in wanted]
                    yield from reader.read(part)

    return contents.mapInArrow(run, SCHEMAS[options.get("what", "samples")])
