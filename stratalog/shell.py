"""An interactive shell: statements end with a semicolon; \\d, \\s, \\h and \\q are commands."""

from __future__ import annotations

import sys
from typing import TextIO

from stratalog.engine import Engine
from stratalog.errors import EngineError
from stratalog.formatting import write_table

HELP = "\\d [table]  tables or a table's columns\n\\s  status\n\\h  this help\n\\q  quit\nEnd a statement with ;"


def command(engine: Engine, line: str) -> str | None:
    """The answer to a backslash command; None to quit."""
    name, *rest = line.split()
    try:
        if name == "\\q":
            return None
        if name == "\\d":
            return engine.catalog.describe(rest[0])._show_string(len(engine.catalog.get(rest[0]).columns), False) if rest else "\n".join(engine.catalog.names()) or "no tables"
        if name == "\\s":
            return "\n".join(f"{k}: {v}" for k, v in engine.stats().items())
        return HELP if name == "\\h" else f"unknown command {name}; \\h for help"
    except EngineError as e:
        return f"Error: {e}"


def run(engine: Engine, source: TextIO = sys.stdin, out: TextIO = sys.stdout) -> None:
    buffer = ""
    for line in source:
        if not buffer and line.strip().startswith("\\"):
            answer = command(engine, line.strip())
            if answer is None:
                return
            print(answer, file=out)
            continue
        buffer += line
        while ";" in buffer:
            statement, buffer = buffer.split(";", 1)
            if statement.strip():
                write_table(engine.execute(statement), out)
        buffer = buffer.lstrip() if not buffer.strip() else buffer
