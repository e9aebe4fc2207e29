"""Table schemas: columns, keys, limits, JSON form, row width."""

from __future__ import annotations

import dataclasses
import datetime as dt
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import types as T

from .errors import EngineError
from .functions import types as t

MAX_COLUMNS, MAX_NAME, MAX_LABELS, MAX_LABEL, MAX_UNIQUE, MAX_FOREIGN = 32, 63, 16, 31, 8, 8


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    max_len: int = 0
    scale: int = 0
    not_null: bool = False
    primary_key: bool = False
    unique: bool = False
    auto_increment: bool = False
    has_default: bool = False
    default: object = None
    labels: tuple[str, ...] = ()

    def coerce(self, value):
        return t.coerce(value, self.type, self.max_len, self.scale, self.labels)

    @property
    def spark(self) -> T.StructField:
        return T.StructField(self.name, t.spark_type(self.type, self.max_len, self.scale), True, {"type": self.type, "max_len": self.max_len, "labels": list(self.labels)})

    @property
    def width(self) -> int:
        return t.WIDTH[self.type] + (self.max_len if self.type == t.VARCHAR else 0)


@dataclass(frozen=True)
class ForeignKey:
    name: str
    column: str
    ref_table: str
    ref_column: str


@dataclass(frozen=True)
class TableSchema:
    name: str
    columns: tuple[ColumnDef, ...]
    foreign_keys: tuple[ForeignKey, ...] = ()
    next_id: int = field(default=1)

    def __post_init__(self):
        """Fills in bare types and the key, then checks the limits."""
        columns = []
        for c in self.columns:
            if c.type == t.VARCHAR and not c.max_len:
                c = dataclasses.replace(c, max_len=t.MAX_VARCHAR)
            if c.type == t.DECIMAL and not c.max_len:
                c = dataclasses.replace(c, max_len=t.MAX_PRECISION)
            columns.append(c)
        if columns and not any(c.primary_key for c in columns):
            columns[0] = dataclasses.replace(columns[0], primary_key=True)
        columns = [dataclasses.replace(c, not_null=True) if c.primary_key else c for c in columns]
        columns = [dataclasses.replace(c, default=c.coerce(c.default)) if c.has_default and c.type in t.WIDTH else c for c in columns]
        object.__setattr__(self, "columns", tuple(columns))
        object.__setattr__(self, "foreign_keys", tuple(self.foreign_keys))
        self._check()

    def _check(self) -> None:
        names = [c.name for c in self.columns]
        for bad, why in (
            (not self.columns, "a table needs a column"),
            (len(self.columns) > MAX_COLUMNS, f"more than {MAX_COLUMNS} columns"),
            (len(set(names)) < len(names), "a column name twice"),
            (any(not n or len(n) > MAX_NAME for n in [self.name, *names]), f"a name is empty or longer than {MAX_NAME}"),
            (sum(c.primary_key for c in self.columns) > 1, "more than one primary key column"),
            (sum(c.unique for c in self.columns) > MAX_UNIQUE, f"more than {MAX_UNIQUE} unique columns"),
            (len(self.foreign_keys) > MAX_FOREIGN, f"more than {MAX_FOREIGN} foreign keys"),
        ):
            if bad:
                raise EngineError(f"{self.name}: {why}")
        for c in self.columns:
            if c.type not in t.WIDTH:
                raise EngineError(f"{c.name}: no type {c.type}")
            if c.type == t.VARCHAR and not 0 < c.max_len <= t.MAX_VARCHAR:
                raise EngineError(f"{c.name}: VARCHAR length must be 1 to {t.MAX_VARCHAR}")
            if c.type == t.DECIMAL and not 0 <= c.scale <= min(c.max_len, t.MAX_PRECISION):
                raise EngineError(f"{c.name}: scale must be 0 to the precision")
            if c.type == t.ENUM and not (0 < len(c.labels) <= MAX_LABELS and all(0 < len(x) <= MAX_LABEL for x in c.labels) and len(set(c.labels)) == len(c.labels)):
                raise EngineError(f"{c.name}: ENUM needs 1 to {MAX_LABELS} different labels of up to {MAX_LABEL} characters")
            if c.auto_increment and not (c.primary_key and c.type == t.INT):
                raise EngineError(f"{c.name}: AUTO_INCREMENT is for an INT primary key")
        for k in self.foreign_keys:
            self.column(k.column)

    @property
    def key(self) -> ColumnDef:
        return next(c for c in self.columns if c.primary_key)

    @property
    def uniques(self) -> list[ColumnDef]:
        return [c for c in self.columns if c.unique and not c.primary_key]

    @property
    def spark(self) -> T.StructType:
        return T.StructType([c.spark for c in self.columns])

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def row_width(self) -> int:
        return sum(c.width for c in self.columns)

    def column(self, name: str) -> ColumnDef:
        """The exact name first, then one that differs in case only."""
        found = [c for c in self.columns if c.name == name] or [c for c in self.columns if c.name.lower() == name.lower()]
        if len(found) != 1:
            from .errors import BindError

            raise BindError(f"no column {name} in {self.name}" if not found else f"column {name} is ambiguous")
        return found[0]

    def to_json(self) -> dict:
        out = dataclasses.asdict(self)
        for c in out["columns"]:
            c["labels"] = list(c["labels"])
            if isinstance(c["default"], (Decimal, dt.date)):
                c["default"] = str(c["default"])
        return out

    @classmethod
    def from_json(cls, x: dict) -> TableSchema:
        columns = []
        for c in x["columns"]:
            columns.append(ColumnDef(**(c | {"labels": tuple(c["labels"])})))
        return cls(x["name"], tuple(columns), tuple(ForeignKey(**k) for k in x["foreign_keys"]), x["next_id"])
