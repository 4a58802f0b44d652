"""Readers and a writer for the recording formats, as Spark data sources.

Register them once per session with ``register(spark)``; then

    spark.read.format("recording_pos").load(path)        # tracking
    spark.read.format("recording_tetrode").load(path)    # spikes and waveforms
    spark.read.format("recording_cut").load(path)        # cluster labels
    labels.write.format("recording_cut").save(dir)       # label files

``path`` is a file, a folder or a comma list; any file system Arrow knows works,
so executors read shared storage directly.  Binary files have fixed-length
records: a large file is split into ranges of records.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SPLIT_BYTES = 64 << 20
PIECE_BYTES = 1 << 16
START, END = b"data_start", b"data_end"
MISSING = 1023      # fixed value: tracker found no light


def _open_fs(path: str):
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _files(path: str, pattern: str) -> list[tuple[str, int]]:
    """(path, size) of the matching files."""
    out = []
    for one in path.split(","):
        fs, p = _open_fs(one)
        prefix = one[: len(one) - len(p)] if one.endswith(p) else ""
        info = fs.get_file_info(p)
        infos = fs.get_file_info(pafs.FileSelector(p, recursive=True)) if info.type == pafs.FileType.Directory else [info]
        for i in infos:
            if i.type == pafs.FileType.File and (re.search(pattern, i.path) or info.type == pafs.FileType.File):
                out.append((prefix + i.path, i.size))
    return sorted(out)


@dataclass
class FileRange(InputPartition):
    path: str
    part: int
    parts: int


class _RangeReader(DataSourceReader):
    pattern = "."

    def __init__(self, options):
        self.path = options["path"]
        self.split = int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self):
        out = []
        for path, size in _files(self.path, self.pattern):
            n = max(1, -(-size // self.split))
            out += [FileRange(path, k, n) for k in range(n)]
        return out

    def _records(self, p: FileRange, record_bytes, count_field: str):
        """(header, first record number, bytes of this range).

        The number of records is that of the header, else what lies before the trailer,
        if there is one, or the end of the file.  A file with less, or with part of a
        record, raises."""
        fs, path = _open_fs(p.path)
        with fs.open_input_file(path) as f:
            head = read_header(f)
            if not head.endswith(START):
                raise ValueError(f"no {START.decode()} in {p.path}")
            header, at = parse_header(head[: -len(START)]), len(head)
            rec = record_bytes(header)
            f.seek(max(at, f.size() - 64))
            tail = f.read().rstrip(b"\r\n\x1a\x00 ")
            body = f.size() - at
            if tail.endswith(END):
                whole = f.size() - max(at, f.size() - 64)
                body -= whole - len(tail) + len(END)
                body -= 2 if body % rec == 2 else 0          # the line break before the trailer
            if count_field in header:
                total = int(_number(header[count_field]))
                if total * rec > body:
                    raise ValueError(f"{p.path}: {count_field} is {total}, but only {body // rec} records are there")
            else:
                total = body // rec
                if body % rec:
                    raise ValueError(f"{p.path}: {body % rec} bytes after the last whole record")
            a, b = total * p.part // p.parts, total * (p.part + 1) // p.parts
            f.seek(at + a * rec)
            return header, a, f.read((b - a) * rec)


def read_header(f) -> bytes:
    """The file up to and with the mark of the data, however long; all of it if there is none."""
    head = b""
    while True:
        piece = f.read(PIECE_BYTES)
        seen = max(0, len(head) - len(START))
        head += piece
        at = head.find(START, seen)
        if at >= 0:
            return head[: at + len(START)]
        if not piece:
            return head


def parse_header(text: bytes) -> dict[str, str]:
    out = {}
    for line in text.decode("utf-8", "replace").splitlines():
        key, _, value = line.strip().partition(" ")
        if key:
            out[key] = value.strip()
    return out


def _number(value: str) -> float:
    return float(value.split(" ")[0])



# --------------------------------------------------------------------- tracking
class PosReader(_RangeReader):
    pattern = r"\.pos$"

    def read(self, partition):
        header, first, data = self._records(partition, lambda h: 20, "num_pos_samples")
        rec = np.frombuffer(data, dtype=np.dtype([("frame", ">i4"), ("w", ">i2", 8)]))
        t = rec["frame"].astype(float) / _number(header["timebase"])
        x, y = rec["w"][:, 0].astype(float), rec["w"][:, 1].astype(float)
        n = len(rec)
        yield pa.RecordBatch.from_pydict({
            "path": pa.array([partition.path] * n, pa.string()),
            "i": pa.array(np.arange(first, first + n), pa.int64()),
            "t": pa.array(t),
            "x": pa.array(x, mask=x == MISSING),
            "y": pa.array(y, mask=y == MISSING),
            "sample_rate": pa.array(np.full(n, _number(header.get("sample_rate", "nan")))),
            "ppm": pa.array(np.full(n, _number(header.get("pixels_per_metre", "nan")))),
        })


class PosSource(DataSource):
    """Tracking files: text header, then big-endian frame number and eight words per sample."""

    @classmethod
    def name(cls):
        return "recording_pos"

    def schema(self):
        return "path string, i long, t double, x double, y double, sample_rate double, ppm double"

    def reader(self, schema):
        return PosReader(self.options)


# ----------------------------------------------------------------------- spikes
class TetrodeReader(_RangeReader):
    pattern = r"\.[0-9]+$"

    def read(self, partition):
        def shape(h):
            """(channels, bytes of a time stamp, samples, bytes of a sample)"""
            return int(h.get("num_chans", "4")), int(h["bytes_per_timestamp"]), int(h["samples_per_spike"]), int(h.get("bytes_per_sample", "1"))

        def size(h):
            chans, stamp, length, width = shape(h)
            return chans * (stamp + length * width)

        header, first, data = self._records(partition, size, "num_spikes")
        chans, stamp, length, width = shape(header)
        raw = np.frombuffer(data, dtype=np.uint8).reshape(-1, chans, stamp + length * width)
        n = len(raw)
        ticks = raw[:, 0, :stamp].astype(np.int64) @ (256 ** np.arange(stamp - 1, -1, -1, dtype=np.int64))
        # samples of more than one byte have the low byte first
        waves = np.ascontiguousarray(raw[:, :, stamp:]).view(f"<i{width}").astype(np.float32).reshape(n, -1)
        offsets = pa.array(np.arange(0, n * waves.shape[1] + 1, waves.shape[1], dtype=np.int32)) if n else pa.array([0], pa.int32())
        yield pa.RecordBatch.from_arrays([
            pa.array([partition.path] * n, pa.string()), pa.array(np.arange(first, first + n), pa.int64()),
            pa.array(ticks / _number(header["timebase"])), pa.array([chans] * n, pa.int32()),
            pa.ListArray.from_arrays(offsets, pa.array(waves.ravel(), pa.float32())),
        ], names=["path", "spike_idx", "t", "channels", "samples"])


class TetrodeSource(DataSource):
    """Spike files: per spike and channel a big-endian time stamp and signed bytes."""

    @classmethod
    def name(cls):
        return "recording_tetrode"

    def schema(self):
        return "path string, spike_idx long, t double, channels int, samples array<float>"

    def reader(self, schema):
        return TetrodeReader(self.options)


class HeaderReader(_RangeReader):
    def partitions(self):
        return [FileRange(path, 0, 1) for path, _ in _files(self.path, r"\.([0-9]+|pos|set)$")]

    def read(self, partition):
        fs, path = _open_fs(partition.path)
        with fs.open_input_file(path) as f:
            head = read_header(f)
        for key, value in parse_header(head.split(START)[0]).items():
            yield (partition.path, key, value)


class HeaderSource(DataSource):
    """Header fields of recording files (also gain files) as key-value rows."""

    @classmethod
    def name(cls):
        return "recording_header"

    def schema(self):
        return "path string, key string, value string"

    def reader(self, schema):
        return HeaderReader(self.options)


# ----------------------------------------------------------------------- labels
class CutReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        return [FileRange(path, 0, 1) for path, _ in _files(self.path, r"\.cut$")]

    def read(self, partition):
        """Labels are the integers after the line with ``Exact_cut``; read in pieces."""
        fs, path = _open_fs(partition.path)
        i, rest, started = 0, b"", False
        with fs.open_input_stream(path) as f:
            while True:
                block = f.read(1 << 20)
                rest += block
                if not started:
                    at = rest.find(b"Exact_cut")
                    end = rest.find(b"\n", at) if at >= 0 else -1
                    if end >= 0:
                        started, rest = True, rest[end + 1:]
                if started:
                    words = rest.replace(b",", b" ").split()
                    # the last word may go on in the next piece
                    rest = words.pop() if block and words and not rest[-1:].isspace() else b""
                    if words:
                        labels = np.array(words, dtype=np.int32)
                        yield pa.RecordBatch.from_pydict({
                            "path": pa.array([partition.path] * len(labels), pa.string()),
                            "spike_idx": pa.array(np.arange(i, i + len(labels)), pa.int64()), "label": pa.array(labels)})
                        i += len(labels)
                if not block:
                    break
        if not started:
            raise ValueError(f"no cut values in {partition.path}")


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]       # (name of the attempt, final name)


class CutWriter(DataSourceWriter):
    """One label file per value of ``name``.

    Rows must arrive grouped by ``name`` and ordered by ``spike_idx`` (see
    ``write_labels``); they are streamed to the file and never collected.  A task writes
    under a name of its own; the files of finished tasks get their names at the end.
    """

    def __init__(self, options):
        self.path, self.header = options["path"], options.get("header", "")

    def write(self, rows):
        fs, base = _open_fs(self.path)
        fs.create_dir(base, recursive=True)
        current, out, first, files = None, None, True, []
        for r in rows:
            if r["name"] != current:
                if out is not None:
                    out.close()
                current, first = r["name"], True
                files.append((f"{base}/_{current}.{uuid.uuid4().hex}", f"{base}/{current}"))
                out = fs.open_output_stream(files[-1][0])
                out.write((self.header + f"Exact_cut_for: {current}\n").encode())
            out.write((str(r["label"]) if first else f" {r['label']}").encode())
            first = False
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages):
        fs, _ = _open_fs(self.path)
        for m in messages:
            for attempt, final in m.files if m else ():
                fs.move(attempt, final)

    def abort(self, messages):
        fs, _ = _open_fs(self.path)
        for m in messages:
            for attempt, _ in m.files if m else ():
                fs.delete_file(attempt)


class CutSource(DataSource):
    @classmethod
    def name(cls):
        return "recording_cut"

    def schema(self):
        return "path string, spike_idx long, label int"

    def reader(self, schema):
        return CutReader(self.options)

    def writer(self, schema, overwrite):
        return CutWriter(self.options)


def register(spark) -> None:
    for source in (PosSource, TetrodeSource, CutSource, HeaderSource):
        spark.dataSource.register(source)


def write_labels(labels, folder: str, header: str = "") -> None:
    """Write ``name, spike_idx, label`` rows as one label file per name.

    A file is one sequence, so its rows meet in one task; they stream through it.
    """
    rows = labels.select("name", "spike_idx", "label").repartition("name").sortWithinPartitions("name", "spike_idx")
    rows.write.format("recording_cut").option("header", header).mode("append").save(folder)
