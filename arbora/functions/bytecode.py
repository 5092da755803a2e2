"""Disassembly of source texts; what it prints depends on the interpreter's version."""

from __future__ import annotations

import dis
import io
import marshal
import types
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def listing(source: str, name: str, optimize: int = 0) -> str:
    """All code objects of a text, outermost first; a text that does not compile gives its error."""
    try:
        todo = [compile(source, name, "exec", optimize=optimize, dont_inherit=True)]
    except (SyntaxError, ValueError) as error:
        return f"{type(error).__name__}: {error}"
    out = io.StringIO()
    while todo:
        code = todo.pop(0)
        out.write(f"# {code.co_name} line {code.co_firstlineno}\n")
        dis.dis(code, file=out, depth=0)
        todo += [c for c in code.co_consts if isinstance(c, types.CodeType)]
    return out.getvalue()


def disassemble(files: DataFrame, optimize: int = 0) -> DataFrame:
    """rel_path and disassembly of every file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"rel_path": frame["rel_path"], "disassembly": [listing(s or "", p, optimize) for p, s in zip(frame["rel_path"], frame["source"], strict=True)]})

    return files.select("rel_path", "source").mapInPandas(run, "rel_path string, disassembly string")


def compiled(files: DataFrame, optimize: int = 0) -> DataFrame:
    """rel_path and the marshalled code of every file; null where it does not compile."""

    def one(source: str, name: str) -> bytes | None:
        try:
            return marshal.dumps(compile(source, name, "exec", optimize=optimize, dont_inherit=True))
        except (SyntaxError, ValueError):
            return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"rel_path": frame["rel_path"], "code": [one(s or "", p) for p, s in zip(frame["rel_path"], frame["source"], strict=True)]})

    return files.select("rel_path", "source").mapInPandas(run, "rel_path string, code binary")
