"""The catalog of variables: a text file of ``name.metapath=...`` and ``name.indexpath=...`` lines."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from binsieve.functions.types import column_type
from binsieve.operators.index import Index
from binsieve.sources.datasets import raw_file

_PROPERTIES = {"metapath": "meta", "metafile": "meta", "indexpath": "index", "indexfile": "index"}


@dataclass
class Variable:
    name: str
    meta: str | None = None
    index: str | None = None

    def open_index(self, spark: SparkSession) -> Index:
        if self.index is None:
            raise ValueError(f"{self.name} has no index")
        return Index.load(spark, self.index)

    def open_data(self, spark: SparkSession) -> DataFrame:
        """The variable's data, in the format its meta file names."""
        if self.meta is None:
            raise ValueError(f"{self.name} has no data")
        meta = DatasetMeta.parse("\n".join(r.value for r in spark.read.text(self.meta, wholetext=True).collect()))
        if meta.format == "raw":
            return raw_file(spark, meta.path, meta.kind, meta.dims, self.name)
        return spark.read.parquet(meta.path).select("rid", self.name)


@dataclass(frozen=True)
class DatasetMeta:
    """Two lines: ``raw path`` and ``type C d1 d2 ...``, or ``parquet path`` alone, whose schema is its own."""

    format: str
    path: str
    kind: str = ""
    dims: list[int] = field(default_factory=list)

    @classmethod
    def parse(cls, text: str) -> DatasetMeta:
        lines = [x.strip() for x in text.splitlines() if x.strip()]
        kind, _, path = lines[0].partition(" ") if lines else ("", "", "")
        if kind == "hdf5":
            raise NotImplementedError("HDF5 needs a library Spark doesn't have; convert the data to Parquet")
        if kind == "parquet" and path:
            return cls(kind, path.strip())
        if kind != "raw" or len(lines) < 2:
            raise ValueError("a meta file begins with 'raw <path>' or 'parquet <path>'")
        name, order, *dims = lines[1].split()
        if order.upper() not in ("C", "FORTRAN") or not dims:
            raise ValueError("the second line is '<type> C|FORTRAN <dims>'")
        return cls(kind, path.strip(), column_type(name).name, [int(d) for d in dims])

    def text(self) -> str:
        return f"{self.format} {self.path}\n" + (f"{self.kind} C {' '.join(map(str, self.dims))}\n" if self.format == "raw" else "")


class Database:
    """Variables by name, in the order they were added."""

    def __init__(self, variables: list[Variable] | None = None):
        self.variables = {v.name: v for v in variables or []}

    def add(self, variable: Variable) -> Database:
        self.variables[variable.name] = variable
        return self

    def get(self, name: str) -> Variable:
        return self.variables[name]

    @classmethod
    def parse(cls, text: str) -> Database:
        made = cls()
        for number, line in enumerate(text.splitlines(), 1):
            line = line.strip()
            if not line or line.startswith("#"):
                continue
            left, sign, value = line.partition("=")
            name, dot, prop = left.strip().rpartition(".")
            if not (sign and dot and name) or prop not in _PROPERTIES:
                raise ValueError(f"line {number}: {line!r}")
            setattr(made.variables.setdefault(name, Variable(name)), _PROPERTIES[prop], value.strip())
        return made

    def text(self) -> str:
        return "".join(f"{v.name}.{prop}={value}\n" for v in self.variables.values() for prop, value in (("metapath", v.meta), ("indexpath", v.index)) if value is not None)

    @classmethod
    def load(cls, path: str) -> Database:
        with open(path, encoding="utf-8") as f:
            return cls.parse(f.read())

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.text())
