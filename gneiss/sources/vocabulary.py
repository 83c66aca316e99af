"""Vocabulary, requirement and layout files as rows.

These files are rule tables of some hundred lines: each is read as one text by Spark and cut into rows by one task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def logical_lines(text: str, comment: str = "#") -> Iterator[str]:
    """Lines without comments, trimmed; a line that ends in a backslash goes on in the next, blank ones are left out."""
    held = ""
    for line in text.splitlines():
        line = re.sub(rf"{re.escape(comment)}.*$", "", line).strip()
        if line.endswith("\\"):
            held += line[:-1].rstrip()
            continue
        if held + line:
            yield held + line
        held = ""
    if held:
        yield held


def _files(spark: SparkSession, path: str, rows: Callable[[str], Iterator[tuple]], schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for text in part["value"]:
                yield pd.DataFrame(list(rows(text)), columns=names)

    return spark.read.text(path, wholetext=True).mapInPandas(run, schema)


def _vocabulary(text: str) -> Iterator[tuple]:
    block, table, owner, place = "", "", "global", 0
    for line in logical_lines(text):
        if m := re.fullmatch(r"(BEGIN|END|BEGIN_LINE|END_LINE):\s*(.+)", line):
            block = m[2] if m[1] == "BEGIN" else "" if m[1] == "END" else block
            table = m[2] if m[1] == "BEGIN_LINE" else "" if m[1] == "END_LINE" else table
            place = 0
        elif table:
            for pos, item in enumerate(line.split(",")):
                yield "line", table, str(place), pos, item.strip()
            place += 1
        elif block and (m := re.match(r"([\w-]+-(?:DS|FE)):\s*(.*)", line)):
            for pos, item in enumerate(p.strip().strip("<>") for p in re.split(r"/|_(?=<)", re.sub(r"\.nc$", "", m[2]))):
                yield "encoding", block, m[1], pos, item
        elif block and (m := re.match(r"<([^>]+)>\s*(?:=\s*([^=]*?)\s*)?(?:=\s*(.*))?$", line)):
            yield "component", block, m[1], 0, m[2]
            for pos, item in enumerate(v.strip() for v in (m[3] or "").split("|") if v.strip()):
                yield "component value", block, m[1], pos, item
        elif m := re.fullmatch(r"([^=:]+):", line):
            owner = m[1].strip()
        else:
            name, _, values = (x.strip() for x in line.partition("="))
            yield "attribute", owner, name, 0, None
            for pos, item in enumerate(v.strip() for v in values.split("|") if v.strip()):
                yield "attribute value", owner, name, pos, item


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(kind, section, name, pos, value) of a controlled vocabulary.

    ``encoding``: the parts of a directory structure (DS) or file encoding (FE) of block ``section``; ``component``: the
    attribute that a part stands for, ``component value`` what it may be; ``line``: item ``pos`` of row ``name`` of the table
    ``section``; ``attribute``: that ``section`` (a variable or global) must have it, ``attribute value`` one of what it may be.
    """
    return _files(spark, path, _vocabulary, "kind string, section string, name string, pos int, value string")


def _requirements(text: str) -> Iterator[tuple]:
    sheet, header = "", []
    for line in text.splitlines():
        items = [x.strip().strip('"') for x in re.split(r',(?=(?:[^"]*"[^"]*")*[^"]*$)', line)]
        if not any(items):
            continue
        if m := re.search(r"(?:^|,)Table:,\s*([^,]+)", ",".join(items)):
            sheet, header = m[1].strip(), []
        elif any(x.lower() in ("output variable name", "cmor dimension", "dimension") for x in items):
            header = [x.lower() for x in items]
        elif header and items[0] or header and "cmor dimension" in header:
            for name, value in zip(header, items, strict=False):
                if name and value:
                    yield sheet, items[header.index("output variable name")] if "output variable name" in header else items[0], name, value


def requirements(spark: SparkSession, path: str) -> DataFrame:
    """(sheet, entry, name, value): the cells of the requirement tables in a comma-separated file. A row with ``Table:`` begins
    the sheet of a frequency, a row with a known caption gives its columns; rows before both are left out."""
    return _files(spark, path, _requirements, "sheet string, entry string, name string, value string")


_VAR = re.compile(r"^(byte|char|short|int|int64|float|double|string)\s+([\w.-]+)(?:\(([^)]*)\))?$")


def _layout(text: str) -> Iterator[tuple]:
    part = ""
    for line in re.sub(r"//.*", "", text).replace("\n", " ").replace("dimensions:", ";dimensions:;").replace("variables:", ";variables:;").replace("data:", ";data:;").split(";"):
        line = line.strip().removeprefix("}").strip()
        if line in ("dimensions:", "variables:", "data:"):
            part = line
        elif part == "dimensions:" and (m := re.match(r"([\w-]+)\s*=\s*(\w+)", line)):
            yield "dim", m[1], None, None, None if m[2].upper() == "UNLIMITED" else m[2]
        elif part == "variables:" and (m := _VAR.match(line)):
            yield "var", m[2], None, m[1], re.sub(r"\s", "", m[3] or "")
        elif part == "variables:" and (m := re.match(r'([\w-]*):([\w-]+)\s*=\s*(.+)$', line)):
            value = m[3].strip()
            kind = "char" if value.startswith('"') else "float" if re.search(r"f\b", value) else "short" if value.endswith("s") else "double" if re.search(r"[.eE]", value) else "int"
            yield "att", m[1], m[2], kind, value.strip('"') if kind == "char" else re.sub(r"[fs]\b", "", value)
        elif part == "data:" and (m := re.match(r"([\w-]+)\s*=\s*(.+)$", line)):
            yield "data", m[1], None, None, re.sub(r"\s", "", m[2])


def layout(spark: SparkSession, path: str) -> DataFrame:
    """(kind, name, att, type, value) of the text form of a container: its dims, vars, atts ('' if global) and data."""
    return _files(spark, path, _layout, "kind string, name string, att string, type string, value string")
