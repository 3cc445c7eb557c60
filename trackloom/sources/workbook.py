"""Sheets of Excel workbooks (xlsx, xlsm), read by Spark from any file system.

A workbook comes as one binary row; its task streams the sheet's XML and yields cells as text, so a sheet is never held as
a table in one place and many workbooks are read side by side. Only names and the first row reach the driver.
"""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("xlsx", "xlsm")
ROWS = 8192
#: Numbers of the built-in formats that show a date or a time. Fixed values.
DATES = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _text(node: ElementTree.Element) -> str:
    """The text of a string item: its runs one after another, without readings in another script."""
    parts = []
    for child in node:
        if _local(child.tag) == "t":
            parts.append(child.text or "")
        elif _local(child.tag) == "r":
            parts += [t.text or "" for t in child if _local(t.tag) == "t"]
    return "".join(parts)


def _elements(book: zipfile.ZipFile, part: str, name: str) -> Iterator[ElementTree.Element]:
    """Each element of that name in a part, cleared after use; none if the book lacks the part."""
    if part not in book.namelist():
        return
    with book.open(part) as f:
        parents: list[ElementTree.Element] = []
        for event, node in ElementTree.iterparse(f, ("start", "end")):
            if event == "start":
                parents.append(node)
                continue
            parents.pop()
            if _local(node.tag) == name:
                yield node
                node.clear()
                if parents:
                    parents[-1].remove(node)


def parts(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(sheet, part) in the order of the workbook."""
    target = {n.get("Id"): n.get("Target", "") for n in _elements(book, "xl/_rels/workbook.xml.rels", "Relationship")}
    out = []
    for n in _elements(book, "xl/workbook.xml", "sheet"):
        path = target.get(n.get(_RELATION), "")
        out.append((n.get("name", ""), path.lstrip("/") if path.startswith("/") else f"xl/{path}"))
    return out


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show dates or times."""
    own = {int(n.get("numFmtId", 0)): re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", n.get("formatCode", "")).lower() for n in _elements(book, "xl/styles.xml", "numFmt")}
    dates = DATES | {k for k, code in own.items() if re.search("[ymdhs]", code) and "general" not in code}
    return {i for x in _elements(book, "xl/styles.xml", "cellXfs") for i, n in enumerate(x) if int(n.get("numFmtId", 0)) in dates}


def _from_1904(book: zipfile.ZipFile) -> bool:
    return any(n.get("date1904") in ("1", "true") for n in _elements(book, "xl/workbook.xml", "workbookPr"))


def _column(reference: str) -> int:
    """0 for A5, 26 for AA5."""
    out = 0
    for c in reference:
        if not c.isalpha():
            break
        out = out * 26 + ord(c.upper()) - 64
    return out - 1


def _when(serial: float, early: bool) -> str:
    """A day number as text: the time alone under one day, no time at midnight."""
    at = datetime.datetime(1904, 1, 1) if early else datetime.datetime(1899, 12, 31 if serial < 60 else 30)
    at += datetime.timedelta(seconds=round(serial * 86400))
    if serial < 1:
        return str(at.time())
    return str(at.date()) if serial == int(serial) else str(at)


def cells(book: zipfile.ZipFile, part: str) -> Iterator[list[str | None]]:
    """The rows of a sheet up to its last, empty ones too; an empty cell or one with an error is None."""
    shared = [_text(n) for n in _elements(book, "xl/sharedStrings.xml", "si")]
    dates, early, at = _date_styles(book), _from_1904(book), 0
    for row in _elements(book, part, "row"):
        number = int(row.get("r") or at + 1)
        yield from ([] for _ in range(at + 1, number))
        at, out = number, []
        for c in row:
            if _local(c.tag) != "c":
                continue
            place = _column(c.get("r")) if c.get("r") else len(out)
            out += [None] * (place - len(out) + 1)
            kind, inner = c.get("t", "n"), {_local(n.tag): n for n in c}
            value = inner["v"].text if "v" in inner else None
            if kind == "inlineStr":
                value = _text(inner["is"]) if "is" in inner else None
            elif kind == "e" or value is None:
                value = None
            elif kind == "s":
                value = shared[int(value)]
            elif kind == "b":
                value = "true" if value.strip() == "1" else "false"
            elif kind == "n" and int(c.get("s") or 0) in dates:
                value = _when(float(value), early)
            out[place] = value
        yield out


def _books(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def sheets(spark: SparkSession, path: str) -> DataFrame:
    """(path, position, sheet) of the workbooks at path, position from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as book:
                    found = [s for s, _ in parts(book)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found)), pa.array(range(len(found)), pa.int32()), pa.array(found, pa.string())], ["path", "position", "sheet"])

    return _books(spark, path).mapInArrow(run, "path string, position int, sheet string")


def rows(spark: SparkSession, path: str, sheet: str | int = 0, first: bool = False) -> DataFrame:
    """(path, row, cells) of one sheet of each workbook at path, by name or position; row from 0. With first, only the
    first row. A workbook without that sheet raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("row", pa.int32()), ("cells", pa.list_(pa.string()))])
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as book:
                    known = parts(book)
                    part = dict(known).get(sheet) if isinstance(sheet, str) else known[sheet][1] if 0 <= sheet < len(known) else None
                    if part is None:
                        raise ValueError(f"{name} has no sheet {sheet!r}")
                    held: list = []
                    for i, row in enumerate(cells(book, part)):
                        held.append({"path": name, "row": i, "cells": row})
                        if first:
                            break
                        if len(held) == ROWS:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held = []
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema)

    return _books(spark, path).mapInArrow(run, "path string, row int, cells array<string>")


def names(header: list[str | None]) -> list[str]:
    """Names of the columns: stripped, column_3 where the cell is empty, and a number after a name that came before."""
    out: list[str] = []
    for i, cell in enumerate(header):
        name, n = (cell or "").strip() or f"column_{i + 1}", 1
        plain = name
        while name in out:
            name, n = f"{plain}.{n}", n + 1
        out.append(name)
    return out


def read_sheet(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """One sheet as a table of strings, named by its first row; rows without any value go. Of several workbooks the sheets
    must have the same first row. An empty sheet gives no columns."""
    headers = {tuple(names(r["cells"])) for r in rows(spark, path, sheet, first=True).collect()}
    if len(headers) > 1:
        raise ValueError(f"the sheets {sheet!r} of {path} have different columns")
    header = next(iter(headers), ())
    table = rows(spark, path, sheet).where("row > 0").where(F.exists("cells", lambda c: c.isNotNull()))
    return table.select(*[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(header)])
