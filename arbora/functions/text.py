"""Encoding, line ends and docstrings as column functions."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Coding declarations of source text and of XML.
COOKIE = r"coding[:=]\s*([-\w_.]+)"
XML = r"""<\?xml[^>]*\bencoding\s*=\s*["']([-\w_.]+)["'][^>]*\?>"""


def coding(text: Column) -> Column:
    """The declared encoding: a cookie in the first two lines, else an XML declaration in the first; null without one."""
    lines = F.split(text, "\n", 3)
    first, second = F.get(lines, F.lit(0)), F.coalesce(F.get(lines, F.lit(1)), F.lit(""))
    found = lambda where, pattern: F.nullif(F.regexp_extract(where, pattern, 1), F.lit(""))
    return F.coalesce(found(first, COOKIE), found(second, COOKIE), found(first, XML))


def bom(content: Column) -> Column:
    """The encoding of a byte order mark; a UTF-32 mark of little-endian order counts as UTF-16, which it begins with."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head.startswith("EFBBBF"), "utf-8").when(head.startswith("FFFE"), "utf-16").when(head == "0000FEFF", "utf-32")


def eol(text: Column) -> Column:
    """crlf, cr or lf."""
    return F.when(F.contains(text, F.lit("\r\n")), "crlf").when(F.contains(text, F.lit("\r")), "cr").otherwise("lf")


def convert_eol(text: Column, to: str = "\n") -> Column:
    plain = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return plain if to == "\n" else F.replace(plain, F.lit("\n"), F.lit(to))


def lines(table: DataFrame, key: str, text: str) -> DataFrame:
    """key, line (from 1), start (offset of its first character), content: every line of every text."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    starts = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), lambda a, x: F.struct((a["at"] + F.length(x) + 1).alias("at"), F.array_append(a["all"], a["at"]).alias("all")), lambda a: a["all"])
    return table.select(key, F.posexplode(F.arrays_zip(parts.alias("content"), starts.alias("start")))).select(key, (F.col("pos") + 1).cast("long").alias("line"), F.col("col.start").cast("long").alias("start"), F.col("col.content").alias("content"))


def decode(files: DataFrame, content: str = "content", project: str | None = None, default: str = "utf-8") -> DataFrame:
    """``files`` with ``source`` and ``encoding``: by mark, cookie, project and default, at last UTF-8 without what it cannot read.

    Python's codecs are many more than the JVM's, so this runs in Arrow batches of Python.
    """
    schema = files.schema.add("source", "string").add("encoding", "string")

    def attempt(raw: bytes, declared: str | None, mark: str | None) -> tuple[str, str]:
        for name in (f"{mark}-sig" if mark == "utf-8" else mark, declared, project, default):
            try:
                if name:
                    return raw.decode(codecs.lookup(name).name if name != "utf-8-sig" else name), f"bom-{mark}" if mark else name
            except (LookupError, UnicodeDecodeError):
                continue
        return raw.decode("utf-8", errors="ignore"), "utf-8"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            both = [attempt(bytes(r or b""), d, b) for r, d, b in zip(frame[content], frame["__declared"], frame["__mark"], strict=True)]
            yield frame.drop(columns=["__declared", "__mark"]).assign(source=[s for s, _ in both], encoding=[e for _, e in both])

    head = F.substring_index(convert_eol(F.decode(F.col(content), "iso-8859-1")), "\n", 2)
    return files.withColumns({"__declared": coding(head), "__mark": bom(F.col(content))}).mapInPandas(run, schema)


def trim_docstring(text: Column) -> Column:
    """A docstring without its common indentation and empty edges."""
    rows = F.split(F.replace(text, F.lit("\t"), F.lit("        ")), "\n", -1)
    rest = F.slice(rows, 2, 1_000_000)
    filled = F.filter(rest, lambda x: F.trim(x) != "")
    indent = F.coalesce(F.array_min(F.transform(filled, lambda x: F.length(x) - F.length(F.ltrim(x)))), F.lit(0))
    cut = F.concat(F.array(F.trim(F.get(rows, F.lit(0)))), F.transform(rest, lambda x: F.rtrim(F.substring(x, indent + 1, F.length(x)))))
    return F.regexp_replace(F.array_join(cut, "\n"), r"^\n+|\n+$", "")
