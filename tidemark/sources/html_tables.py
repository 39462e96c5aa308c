"""HTML tables of landed pages as rows: spans filled in, header rows joined into names."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most columns and rows that a cell may span.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
_SILENT = {"script", "style"}


class _Tables(HTMLParser):
    """Collects the tables of a page in the order in which they begin; a table inside a cell is a table of its own."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[list]]] = []  # of each its rows, of these the cells [header, rowspan, colspan, texts]
        self.open: list[dict] = []
        self.silent = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.silent += tag in _SILENT
        if tag == "table":
            self.tables.append([])
            self.open.append({"rows": self.tables[-1], "cell": None, "head": False})
        if not self.open:
            return
        now = self.open[-1]
        if tag in ("thead", "tbody", "tfoot"):
            now["head"], now["cell"] = tag == "thead", None
        elif tag == "tr":
            now["rows"].append([])
            now["cell"] = None
        elif tag in ("td", "th"):
            if not now["rows"]:
                now["rows"].append([])
            given = dict(attrs)
            span = lambda k, most: min(int(v), most) if (v := (given.get(k) or "1").strip()).isascii() and v.isdigit() else 1
            now["cell"] = [tag == "th" or now["head"], span("rowspan", MOST_ROWS), max(1, span("colspan", MOST_COLUMNS)), []]
            now["rows"][-1].append(now["cell"])
        elif tag in ("br", "p", "li", "div"):
            self.handle_data(" ")

    def handle_endtag(self, tag: str) -> None:
        self.silent -= tag in _SILENT and self.silent > 0
        if self.open and tag == "table":
            self.open.pop()
        elif self.open and tag in ("td", "th", "tr"):
            self.open[-1]["cell"] = None

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1]["cell"] is not None and not self.silent:
            self.open[-1]["cell"][3].append(data)


def grids(html: str | None) -> list[tuple[list[str], list[list[str | None]]]]:
    """Names and body rows of each table that has a cell. Leading rows whose cells are all headers give the names (from top to bottom, repeats
    once); without them columns are called by their number from 0 on. A place without a cell is null."""
    page = _Tables()
    page.feed(html or "")
    page.close()
    out = []
    for rows in page.tables:
        grid: list[dict[int, str]] = [{} for _ in rows]
        for r, row in enumerate(rows):
            c = 0
            for _, down, right, texts in row:
                while c in grid[r]:
                    c += 1
                text = " ".join("".join(texts).split())
                for below in grid[r : r + down] if down else grid[r:]:
                    for k in range(c, c + right):
                        below.setdefault(k, text)
                c += right
        width = max((k + 1 for g in grid for k in g), default=0)
        heads = 0
        while heads < len(rows) and rows[heads] and all(x[0] for x in rows[heads]):
            heads += 1
        names = [" ".join(dict.fromkeys(x for g in grid[:heads] if (x := g.get(k)))) or str(k) for k in range(width)]
        if width:
            out.append((names, [[g.get(k) for k in range(width)] for g in grid[heads:] if g]))
    return out


def html_tables(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, table_no, row_no (from 0 on), names and cells of every body row of every table of the pages."""
    kind = pages.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # a page's rows are handed on before the next page is read
                rows = [(t, r, names, cells) for t, (names, body) in enumerate(grids(b.column(1)[i].as_py())) for r, cells in enumerate(body)]
                text = pa.list_(pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * len(rows), pa.int32())), *(pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), text, text)))], [key, "table_no", "row_no", "names", "cells"])

    return pages.select(key, F.col(html).cast("string").alias("html")).mapInArrow(run, f"{key} {kind}, table_no int, row_no int, names array<string>, cells array<string>")


def records(rows: DataFrame, columns: dict[str, str], keep: tuple[str, ...] = ("table_no", "row_no")) -> DataFrame:
    """Columns from the cells under the given names, those of tables that have all of these names; ``columns``: own name to table's name."""
    at = lambda name: F.array_position("names", name).cast("int")
    has = F.array_size(F.array_intersect("names", F.array(*map(F.lit, columns.values())))) == len(set(columns.values()))
    first = [c for c in rows.columns if c not in ("table_no", "row_no", "names", "cells")]
    return rows.where(has).select(*first, *keep, *(F.element_at("cells", at(F.lit(n))).alias(c) for c, n in columns.items()))
