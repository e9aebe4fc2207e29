"""python -m brindle.repl DATA_DIR [name=parquet ...]: statements from the keyboard or a pipe."""

from __future__ import annotations

import sys
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from .engine import Engine
from .errors import EngineError
from .plans.lexer import split_script
from .plans.parser import parse
from .plans.statements import Select

PROMPT, MORE = "sql> ", "...> "
SHOWN = 100


def shown(engine: Engine, result, statement) -> str:
    """A result as text: the first rows, of a single table of the engine in the order of its key."""
    if not isinstance(result, DataFrame):
        return f"{result.done}" + (f": {result.rows}" if result.rows is not None else "")
    if isinstance(statement, Select) and not statement.join and statement.table in engine.catalog.tables:
        key = engine.schema(statement.table).key.name
        if key in result.columns:
            result = result.orderBy(f"`{key}`")
    rows = result.limit(SHOWN + 1).collect()
    lines = [" | ".join(result.columns), *(" | ".join("NULL" if v is None else str(v) for v in r) for r in rows[:SHOWN])]
    return "\n".join(lines + (["and more"] if len(rows) > SHOWN else [f"rows: {len(rows)}"]))


def session(engine: Engine, lines: Iterable[str], out=None, err=None, prompt: bool = False) -> None:
    """Lines gather until one has a semicolon; `exit` or `.exit` on a line of its own ends the session."""
    out, err, held = out or sys.stdout, err or sys.stderr, ""
    ask = lambda: prompt and print(MORE if held.strip() else PROMPT, end="", file=out, flush=True)
    ask()
    for line in lines:
        if line.strip() in ("exit", ".exit"):
            return
        held += line if line.endswith("\n") else line + "\n"
        if ";" in line:
            try:
                for text in split_script(held):
                    statement = parse(text)
                    print(shown(engine, engine.execute(statement), statement), file=out)
            except EngineError as e:
                print(e, file=err)
            held = ""
        ask()


def main(args: list[str]) -> int:
    if not args:
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("brindle").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    with Engine(spark, args[0]) as engine:
        for x in args[1:]:
            engine.register_parquet(*x.split("=", 1))
        session(engine, sys.stdin, prompt=sys.stdin.isatty())
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
