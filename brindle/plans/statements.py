"""Statements as the parser gives them. describe() says what was understood."""

from __future__ import annotations

from dataclasses import dataclass

from ..schema import ColumnDef, ForeignKey


@dataclass(frozen=True)
class Token:
    kind: str  # keyword, word, number, string, symbol, end
    value: str


@dataclass(frozen=True)
class Where:
    left: Token
    op: str
    right: Token

    def describe(self) -> str:
        return f"{self.left.value} {self.op} {self.right.value}"


@dataclass(frozen=True)
class Join:
    how: str  # inner, left, right, full
    table: str
    left: str
    right: str


@dataclass(frozen=True)
class Select:
    columns: tuple[str, ...] | None
    table: str
    join: Join | None = None
    where: Where | None = None

    def describe(self) -> str:
        lines = [f"select from {self.table}", f"  columns: {'*' if self.columns is None else ', '.join(self.columns)}"]
        if self.join:
            lines.append(f"  {self.join.how} join {self.join.table} on {self.join.left} = {self.join.right}")
        return "\n".join(lines + ([f"  where {self.where.describe()}"] if self.where else []))


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[ColumnDef, ...]
    foreign_keys: tuple[ForeignKey, ...] = ()

    def describe(self) -> str:
        return "\n".join([f"create table {self.table}", *(f"  {c.name}: {c.type}{', primary key' if c.primary_key else ''}" for c in self.columns)])


@dataclass(frozen=True)
class DropTable:
    table: str

    def describe(self) -> str:
        return f"drop table {self.table}"


@dataclass(frozen=True)
class Insert:
    table: str
    values: tuple[Token, ...]

    def describe(self) -> str:
        return f"insert into {self.table}\n  values: {', '.join(v.value for v in self.values)}"


@dataclass(frozen=True)
class Update:
    table: str
    column: str
    value: Token
    where: Where | None = None

    def describe(self) -> str:
        return f"update {self.table}\n  set {self.column} = {self.value.value}" + (f"\n  where {self.where.describe()}" if self.where else "")


@dataclass(frozen=True)
class Delete:
    table: str
    where: Where | None = None

    def describe(self) -> str:
        return f"delete from {self.table}" + (f"\n  where {self.where.describe()}" if self.where else "")


@dataclass(frozen=True)
class Transaction:
    action: str  # begin, commit, rollback

    def describe(self) -> str:
        return f"transaction: {self.action}"


Statement = Select | CreateTable | DropTable | Insert | Update | Delete | Transaction
