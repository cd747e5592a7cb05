"""The documents of captures as Spark data sources: ``spark.read.format("light_list").load(folder)`` and others.

``register(spark)`` makes the formats known: ``light_list``, ``dome_lights``, ``project_images``, ``header_lights``,
``legacy_planes``, and ``photo_metadata`` of ``photos``. A file is a dataset, named by its folder ``dataset=...`` or by itself. Schemas are fixed, nothing is
inferred. Files are dealt to partitions by size, and filters on ``dataset`` choose files before any is opened; filters on
``light_id`` (or on ``x`` and ``y``) are applied as a file is read. Pushing needs spark.sql.python.filterPushdown.enabled,
which ``register`` sets. Files are read through Arrow's file systems, so a path may be a local one or a URI that these know.

Options: ``strict`` (true; a document that can't be read is an error, else it is left out), ``partitionBytes`` (32 MB).
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq, ge, gt, le, lt
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .images import parse_legacy

_COMPARED = {EqualTo: eq, EqualNullSafe: eq, GreaterThan: gt, GreaterThanOrEqual: ge, LessThan: lt, LessThanOrEqual: le, In: lambda v, among: v in among}


@dataclass
class Files(InputPartition):
    """(dataset, path) of the files of a partition."""

    files: tuple[tuple[str, str], ...]


def dataset_of(path: str) -> str:
    p = PurePosixPath(path)
    return p.parent.name.removeprefix("dataset=") if p.parent.name.startswith("dataset=") else re.sub(r"(?<=.)\.[^.]*$", "", p.name)


class Reader(DataSourceReader):
    """Reads the files of a folder, or one file; subclasses give the columns of one document."""

    numbers: tuple[str, ...] = ("light_id",)
    head: int | None = None  # bytes of a file that are read; all if None

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names = schema.names
        self.arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])
        self.path, self.strict = options["path"], str(options.get("strict", "true")).lower() != "false"
        self.limit = int(options.get("partitionBytes", 32 << 20))
        self.wanted: list[tuple[str, object, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            name = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if name in ("dataset", *self.numbers) and type(f) in _COMPARED:
                self.wanted.append((name, _COMPARED[type(f)], f.value))
            elif not (isinstance(f, IsNotNull) and name in ("dataset", *self.numbers)):  # these are never null
                yield f

    def _opened(self) -> tuple[fs.FileSystem, str]:
        if self.path.startswith("file:") or ":/" not in self.path:  # file:/a, file:///a or a itself
            return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", self.path)
        return fs.FileSystem.from_uri(self.path)

    def partitions(self) -> list[Files]:
        store, root = self._opened()
        top = store.get_file_info(root)
        found = [top] if top.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        hidden = lambda p: any(x[:1] in "._" for x in PurePosixPath(p).relative_to(root).parts)
        files = sorted((f.path, min(f.size, self.head or f.size)) for f in found if f.type == fs.FileType.File and not hidden(f.path))
        out, held, size = [], [], 0
        for path, n in files:
            name = dataset_of(path)
            if all(test(name, v) for c, test, v in self.wanted if c == "dataset"):
                if held and size + n > self.limit:
                    out.append(Files(tuple(held)))
                    held, size = [], 0
                held.append((name, path))
                size += n
        return [*out, Files(tuple(held))]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = self._opened()
        for name, path in partition.files:
            with store.open_input_stream(path) as f:
                data = f.read(self.head) if self.head else f.read()
            try:
                columns = self.columns(data)
            except (ValueError, KeyError, TypeError, IndexError, json.JSONDecodeError) as e:
                if self.strict:
                    raise ValueError(f"{path} can't be read: {e}") from e
                continue
            n = len(next(iter(columns.values()), ()))
            keep = np.ones(n, bool)
            for c, test, v in self.wanted:
                if c != "dataset":
                    keep &= np.array([test(x, v) for x in columns[c]], bool)
            at = np.flatnonzero(keep)
            picked = {"dataset": [name] * len(at), **{c: [v[i] for i in at] for c, v in columns.items()}}
            yield pa.RecordBatch.from_arrays([pa.array(picked[c], self.arrow.field(c).type) for c in self.names], schema=self.arrow)

    def columns(self, data: bytes) -> dict[str, list]:
        raise NotImplementedError


class _LightList(Reader):
    def columns(self, data: bytes) -> dict[str, list]:
        lines = [x.strip() for x in data.decode().splitlines() if x.strip()]
        n = int(lines[0])
        if not 1 <= n <= 1000 or len(lines) <= n:
            raise ValueError("bad light count")
        out: dict[str, list] = {c: [] for c in ("light_id", "filename", "lx", "ly", "lz")}
        for i, line in enumerate(lines[1 : n + 1]):
            name, *v = line.rsplit(None, 3)
            x, y, z = map(float, v)
            size = math.sqrt(x * x + y * y + z * z)
            if size < 1e-4:
                raise ValueError(f"light {i} has no direction")
            for c, value in zip(out, (i, name, x / size, y / size, z / size), strict=True):
                out[c].append(value)
        return out


class _DomeLights(Reader):
    def columns(self, data: bytes) -> dict[str, list]:
        d = json.loads(data)
        kind = d.get("lightConfiguration")
        positions = {"spherical": d.get("positionsSphere"), "lights3d": d.get("positions3d")}.get(kind) or []
        directions = d.get("directions") or []
        n = max(len(directions), len(positions))
        at = lambda rows, i, k: rows[i].get(k) if i < len(rows) else None
        return {"light_id": list(range(n)), **{f"l{k}": [at(directions, i, k) for i in range(n)] for k in "xyz"}, **{f"p{k}": [at(positions, i, k) for i in range(n)] for k in "xyz"}}


class _ProjectImages(Reader):
    def columns(self, data: bytes) -> dict[str, list]:
        images = json.loads(data).get("images") or []
        return {"light_id": list(range(len(images))), "filename": [i["filename"] for i in images], "skip": [bool(i.get("skip")) for i in images], "visible": [i.get("visible") is not False for i in images]}


class _HeaderLights(Reader):
    def columns(self, data: bytes) -> dict[str, list]:
        flat = json.loads(data).get("lights") or []
        if len(flat) % 3:
            raise ValueError("lights are not triples")
        return {"light_id": list(range(len(flat) // 3)), **{c: list(map(float, flat[i::3])) for i, c in enumerate(("lx", "ly", "lz"))}}


class _LegacyPlanes(Reader):
    numbers = ("x", "y")

    def columns(self, data: bytes) -> dict[str, list]:
        _, q = parse_legacy("", data)
        h, w, n = q.shape
        y, x = np.mgrid[:h, :w]
        return {"x": x.ravel().tolist(), "y": y.ravel().tolist(), "q": list(q.reshape(-1, n).astype(np.int32))}


class _Documents(DataSource):
    reads: type[Reader]
    fields = ""

    def schema(self) -> str:
        return self.fields

    def reader(self, schema: StructType) -> Reader:
        return self.reads(schema, self.options)


class LightLists(_Documents):
    """Light lists: a count, then file name and direction of each light; directions are made unit."""

    reads, fields = _LightList, "dataset string, light_id int, filename string, lx double, ly double, lz double"

    @classmethod
    def name(cls) -> str:
        return "light_list"


class DomeLights(_Documents):
    """Lights of dome documents: directions, and positions if the dome has some."""

    reads, fields = _DomeLights, "dataset string, light_id int, lx double, ly double, lz double, px double, py double, pz double"

    @classmethod
    def name(cls) -> str:
        return "dome_lights"


class ProjectImages(_Documents):
    """Images of project documents."""

    reads, fields = _ProjectImages, "dataset string, light_id int, filename string, skip boolean, visible boolean"

    @classmethod
    def name(cls) -> str:
        return "project_images"


class HeaderLights(_Documents):
    """Lights of dataset headers."""

    reads, fields = _HeaderLights, "dataset string, light_id int, lx double, ly double, lz double"

    @classmethod
    def name(cls) -> str:
        return "header_lights"


class LegacyPlanes(_Documents):
    """Coefficients of legacy reflectance files, a row a pixel."""

    reads, fields = _LegacyPlanes, "dataset string, x int, y int, q array<int>"

    @classmethod
    def name(cls) -> str:
        return "legacy_planes"


FORMATS = (LightLists, DomeLights, ProjectImages, HeaderLights, LegacyPlanes)


def register(spark: SparkSession) -> None:
    """Make the formats known to a session, and let it push filters into them."""
    from .photos import PhotoMetadata

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for f in (*FORMATS, PhotoMetadata):
        spark.dataSource.register(f)
