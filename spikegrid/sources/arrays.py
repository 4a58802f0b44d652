"""Sessions exported as labelled arrays with record tables, whole or not at all.

An export is a folder below ``out``: one .npy file for each (session, array), the record
tables as Parquet, and MANIFEST.json with names, dimensions and attributes, written last.
Readers see only folders with a manifest. A failed export deletes its folder; files that a
lost task left are deleted when the export is committed.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from spikegrid.sources.formats import _open_fs

CHUNK = 65_536          # positions along the first dimension that one row holds
SCHEMA = ("session string, array string, dims array<string>, shape array<long>, attrs map<string,string>, "
          "start long, values array<double>")
MANIFEST = "MANIFEST.json"


def to_arrays(rows: DataFrame, session: str, position: str, name: str, value: Column, dims: Sequence[str],
              attrs: Mapping[str, str] | None = None, width: int = 1, chunk: int = CHUNK) -> DataFrame:
    """One array for each session, in rows of ``chunk`` positions.

    ``position`` counts the session's rows from 0 without gaps; ``value`` is a number, or an
    array of ``width`` numbers, which makes the array two-dimensional. Missing numbers are NaN."""
    flat = width > 1
    item = F.transform(value, lambda x: F.coalesce(x.cast("double"), F.lit(float("nan")))) if flat else F.coalesce(value.cast("double"), F.lit(float("nan")))
    cut = rows.select(F.col(session).alias("session"), F.col(position).cast("long").alias("i"), item.alias("v"))
    n = cut.groupBy("session").agg(F.count(F.lit(1)).alias("_n"))
    cut = cut.groupBy("session", F.floor(F.col("i") / chunk).alias("_c")).agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("_p"))
    values = F.transform("_p", lambda p: p["v"])
    return cut.join(n, "session").select(
        "session", F.lit(name).alias("array"), F.array(*map(F.lit, dims)).alias("dims"),
        F.array(F.col("_n"), F.lit(width).cast("long")).alias("shape") if flat else F.array("_n").alias("shape"),
        F.create_map(*[F.lit(x) for kv in (attrs or {}).items() for x in kv]).cast("map<string,string>").alias("attrs"),
        (F.col("_c") * chunk).alias("start"), (F.flatten(values) if flat else values).alias("values"))


@dataclass
class Files(WriterCommitMessage):
    entries: list[dict]


class ArrayWriter(DataSourceWriter):
    """Streams the rows of an array into its file; rows arrive grouped and in order."""

    def __init__(self, options):
        self.folder = options["path"]

    def write(self, rows):
        fs, base = _open_fs(self.folder)
        fs.create_dir(f"{base}/arrays", recursive=True)
        entries, current, out, left = [], None, None, 0

        def close():
            if out is not None:
                out.close()
                if left:
                    raise ValueError(f"{current}: {left} numbers are missing")

        for r in rows:
            shape = tuple(r["shape"])
            if (r["session"], r["array"]) != current:
                close()
                current, left, at = (r["session"], r["array"]), int(np.prod(shape)), 0
                file = f"arrays/{uuid.uuid4().hex}.npy"
                out = fs.open_output_stream(f"{base}/{file}")
                head = io.BytesIO()
                np.lib.format.write_array_header_1_0(head, {"descr": "<f8", "fortran_order": False, "shape": shape})
                out.write(head.getvalue())
                entries.append({"session": r["session"], "array": r["array"], "file": file, "offset": len(head.getvalue()),
                                "dims": list(r["dims"]), "shape": list(shape), "attrs": dict(r["attrs"] or {})})
            if r["start"] != at:
                raise ValueError(f"{current}: position {at} is missing or doubled")
            values = np.asarray(r["values"], "<f8")
            out.write(values.tobytes())
            left, at = left - len(values), at + len(values) // int(np.prod(shape[1:]))
        close()
        return Files(entries)

    def commit(self, messages):
        fs, base = _open_fs(self.folder)
        entries = [e for m in messages if m for e in m.entries]
        fs.create_dir(f"{base}/arrays", recursive=True)
        kept = {e["file"].rsplit("/", 1)[1] for e in entries}
        for f in fs.get_file_info(pafs.FileSelector(f"{base}/arrays")):
            if f.base_name not in kept:
                fs.delete_file(f.path)
        with fs.open_output_stream(f"{base}/_{MANIFEST}") as out:
            out.write(json.dumps({"arrays": entries}).encode())
        fs.move(f"{base}/_{MANIFEST}", f"{base}/{MANIFEST}")

    def abort(self, messages):
        fs, base = _open_fs(self.folder)
        if fs.get_file_info(base).type == pafs.FileType.Directory:
            fs.delete_dir(base)


@dataclass
class Slice(InputPartition):
    folder: str
    entry: dict


class ArrayReader(DataSourceReader):
    def __init__(self, options):
        self.out, self.chunk = options["path"], int(options.get("chunk", CHUNK))

    def partitions(self):
        return [Slice(f"{self.out.rstrip('/')}/{name}", e) for name, m in manifests(self.out) for e in m["arrays"]]

    def read(self, part):
        if part is None:        # nothing is exported
            return
        fs, base = _open_fs(part.folder)
        e = part.entry
        width = int(np.prod(e["shape"][1:]))
        with fs.open_input_file(f"{base}/{e['file']}") as f:
            f.seek(e["offset"])
            for start in range(0, e["shape"][0], self.chunk):
                n = min(self.chunk, e["shape"][0] - start) * width
                yield (e["session"], e["array"], e["dims"], e["shape"], e["attrs"], start, np.frombuffer(f.read(8 * n), "<f8").tolist())


class ArraySource(DataSource):
    @classmethod
    def name(cls):
        return "labelled_arrays"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ArrayReader(self.options)

    def writer(self, schema, overwrite):
        return ArrayWriter(self.options)


def manifests(out: str) -> list[tuple[str, dict]]:
    """(folder name, manifest) of the exports that were finished."""
    fs, base = _open_fs(out)
    found = []
    for f in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
        path = f"{f.path}/{MANIFEST}"
        if f.type == pafs.FileType.Directory and fs.get_file_info(path).type == pafs.FileType.File:
            with fs.open_input_stream(path) as source:
                found.append((f.base_name, json.loads(source.read())))
    return sorted(found)


def write_export(arrays: DataFrame, out: str, records: Mapping[str, tuple[DataFrame, Sequence[str]]] | None = None) -> str:
    """Write arrays (rows of ``SCHEMA``) and record tables together; returns the export's name.

    ``records`` are tables with their keys: one row is kept for each key (the least), and
    keys that an earlier export holds are left out."""
    spark = arrays.sparkSession
    spark.dataSource.register(ArraySource)
    name = f"export-{uuid.uuid4().hex}"
    folder = f"{out.rstrip('/')}/{name}"
    rows = arrays.selectExpr(*[c.split(" ")[0] for c in SCHEMA.split(", ")]).repartition("session", "array").sortWithinPartitions("session", "array", "start")
    try:
        for table, (df, keys) in (records or {}).items():
            rest = [c for c in df.columns if c not in keys]
            new = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]) if rest else df.distinct()
            old = read_records(spark, out, table)
            new = new if old is None else new.join(old.select(*keys), list(keys), "left_anti")
            new.write.parquet(f"{folder}/records/{table}")
        rows.write.format("labelled_arrays").mode("append").save(folder)
    except BaseException:
        ArrayWriter({"path": folder}).abort([])
        raise
    return name


def read_arrays(spark: SparkSession, out: str, chunk: int = CHUNK) -> DataFrame:
    """Rows of ``SCHEMA`` of all finished exports."""
    spark.dataSource.register(ArraySource)
    return spark.read.format("labelled_arrays").option("chunk", chunk).load(out)


def read_records(spark: SparkSession, out: str, table: str) -> DataFrame | None:
    """A record table over all finished exports; None if there is none."""
    fs, base = _open_fs(out)
    paths = [f"{out.rstrip('/')}/{n}/records/{table}" for n, _ in manifests(out)
             if fs.get_file_info(f"{base}/{n}/records/{table}").type == pafs.FileType.Directory]
    return spark.read.parquet(*paths) if paths else None
