"""SELECT as a DataFrame: the statement becomes one logical plan, and Catalyst does the rest."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..errors import BindError
from ..plans.binder import Binder, Relation
from ..plans.statements import Select


def select(statement: Select, relation: Callable[[str], Relation]) -> DataFrame:
    relations = [relation(statement.table)]
    df = relations[0].df
    if statement.join:
        if statement.join.table == statement.table:
            raise BindError("a table cannot be joined with itself: there are no aliases")
        relations.append(relation(statement.join.table))
        binder = Binder(relations)
        left, right = binder.column(statement.join.left), binder.column(statement.join.right)
        if left.relation is right.relation:
            raise BindError("the join condition must name both tables")
        df = df.join(relations[1].df, left.column == right.column, statement.join.how)
    binder = Binder(relations)
    if statement.where:
        df = df.where(binder.where(statement.where))
    if statement.columns is None:
        times = Counter(f for r in relations for f in r.fields)
        names = [(binder.column(f"{r.name}.{f}"), f if times[f] == 1 else f"{r.name}_{f}") for r in relations for f in r.fields]
    else:
        bound = [binder.column(c) for c in statement.columns]
        times = Counter((b.name, b.relation.name) for b in bound)
        tables = Counter(name for name, _ in times)
        names = [(b, b.name if tables[b.name] == 1 else f"{b.relation.name}_{b.name}") for b in bound]
    return df.select(*[b.column.alias(name) for b, name in names])
