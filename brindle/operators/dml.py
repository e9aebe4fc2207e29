"""Constraint checks and changes, as DataFrame operations.

Changes are copy-on-write by file: only files that hold a changed row are read and written again. Checks are
queries over the new rows and the keys that they could clash with; each ends at the first offending row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BindError, Duplicate, NullViolation
from ..functions import types as t
from ..schema import ColumnDef, TableSchema

FILE = "_metadata.file_path"
#: Up to so many keys go into a pushed-down IN; more are joined.
FEW = 1000


def conform(schema: TableSchema, rows: DataFrame) -> DataFrame:
    """Rows by position or by name, as the table's types: VARCHAR cut to its length, ENUM labels to ordinals."""
    if len(rows.columns) != len(schema.columns):
        raise BindError(f"{schema.name} has {len(schema.columns)} columns, the rows have {len(rows.columns)}")
    by_name = set(rows.columns) == set(schema.names)
    out = []
    for source, c in zip(schema.names if by_name else rows.columns, schema.columns):
        x = F.col(f"`{source}`")
        if c.type == t.VARCHAR:
            x = F.substring(x.cast("string"), 1, c.max_len)
        elif c.type == t.ENUM and rows.schema[source].dataType.simpleString() == "string":
            x = F.coalesce(t.enum_to_int(x, c.labels), F.when(x.isNotNull(), F.lit(-1)))
        out.append(x.cast(c.spark.dataType).alias(c.name, metadata=c.spark.metadata))
    return rows.select(*out)


def check_values(schema: TableSchema, rows: DataFrame) -> None:
    """NOT NULL and ENUM ranges, in one pass over the rows."""
    counts = [F.count_if(F.col(f"`{c.name}`").isNull()) for c in schema.columns if c.not_null]
    enums = [c for c in schema.columns if c.type == t.ENUM]
    counts += [F.count_if(~F.col(f"`{c.name}`").between(0, len(c.labels) - 1)) for c in enums]
    if not counts:
        return
    found = rows.agg(*counts).first()
    for c, n in zip([c for c in schema.columns if c.not_null], found):
        if n:
            raise NullViolation(f"NULL in {schema.name}.{c.name}")
    if any(found[len(found) - len(enums) :]):
        raise BindError(f"a value of {schema.name} is not among the labels of its ENUM")


def exists(df: DataFrame) -> bool:
    return bool(df.limit(1).take(1))


def clashes(schema: TableSchema, rows: DataFrame, current: DataFrame) -> DataFrame:
    """Values that keys and unique columns refuse among new rows: column, value (as text), why. NULLs are exempt.

    What the table has is met by a join on each column, so Spark can broadcast few new values.
    """
    out = None
    for c in [schema.key, *schema.uniques]:
        own = rows.select(F.col(f"`{c.name}`").alias("v")).where("v is not null")
        known = current.select(F.col(f"`{c.name}`").alias("v")).join(own, "v", "left_semi")
        for bad, why in ((own.groupBy("v").count().where("count > 1"), "a value twice"), (known, "a value that exists")):
            bad = bad.select(F.lit(c.name).alias("column"), F.col("v").cast("string").alias("value"), F.lit(why).alias("why"))
            out = bad if out is None else out.union(bad)
    return out


def check_new_rows(schema: TableSchema, rows: DataFrame, current: DataFrame) -> None:
    """All keys and unique columns in one query, which ends at the first offender."""
    for r in clashes(schema, rows, current).limit(1).take(1):
        raise Duplicate(f"{schema.name}.{r['column']}: {r['why']}")


def check_literals(schema: TableSchema, c: ColumnDef, values: list, current: DataFrame) -> None:
    """As check_new_rows for values at hand: a filter that reaches the scan."""
    values = [v for v in values if v is not None]
    if len(set(values)) < len(values):
        raise Duplicate(f"{schema.name}.{c.name}: a value twice")
    for k in range(0, len(values), FEW):
        if exists(current.where(F.col(f"`{c.name}`").isin([F.lit(v).cast(c.spark.dataType) for v in values[k : k + FEW]]))):
            raise Duplicate(f"{schema.name}.{c.name}: a value that exists")


def files_with(current: DataFrame, condition: Column) -> dict[str, int]:
    """Data files that hold rows for which the condition is true, and how many each holds."""
    return {r["f"]: r["count"] for r in current.where(condition).groupBy(F.col(FILE).alias("f")).count().collect()}


def without(rows: DataFrame, condition: Column) -> DataFrame:
    return rows.where(~F.coalesce(condition, F.lit(False)))


def with_set(schema: TableSchema, rows: DataFrame, changes: dict[str, object], condition: Column) -> DataFrame:
    return rows.select(
        *[
            F.when(condition, F.lit(changes[c.name]).cast(c.spark.dataType)).otherwise(F.col(f"`{c.name}`")).alias(c.name, metadata=c.spark.metadata)
            if c.name in changes
            else F.col(f"`{c.name}`")
            for c in schema.columns
        ]
    )


def dense_ids(staged: DataFrame, first: int, zero_is_none: str) -> DataFrame:
    """Staged rows (with _part and _at, a partition's number and the place in it): consecutive ids where the key
    is NULL or 0, in the order of the partitions. One count a partition comes to the driver."""
    needs = F.coalesce(F.col(f"`{zero_is_none}`"), F.lit(0)) == 0
    from pyspark.sql import Window

    counts = staged.where(needs).groupBy("_part").count().orderBy("_part").collect()
    starts, at = [], first
    for r in counts:
        starts.append((r["_part"], at))
        at += r["count"]
    if not starts:
        return staged.drop("_part", "_at")
    offsets = staged.sparkSession.createDataFrame(starts, "_p int, _start long")
    order = Window.partitionBy("_part").orderBy("_at")
    joined = staged.withColumn("_n", F.sum(F.when(needs, 1).otherwise(0)).over(order)).join(F.broadcast(offsets), F.col("_part") == F.col("_p"), "left")
    new = F.when(needs, (F.col("_start") + F.col("_n") - 1).cast("int")).otherwise(F.col(f"`{zero_is_none}`"))
    return joined.withColumn(zero_is_none, new).drop("_part", "_at", "_n", "_p", "_start")
