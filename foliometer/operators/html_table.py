"""HTML tables as logical cells.

Each column has a row from which it is free again, kept as stretches of columns of one
such row; a cell goes to the first column that is free in its row. So a span costs the same
whatever its size. Rows count inside a table, from <tr> to </tr>, and cells inside a row;
what is not closed there is left out. A span that is no whole number over 0 is 1.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spans beyond this are cut to it.
MOST = 1 << 20


def _span(value: str | None) -> int:
    try:
        return min(max(int(value or ""), 1), MOST)
    except ValueError:
        return 1


class _Events(HTMLParser):
    """The rows of all tables of a text, in order; a cell is [is header, rowspan, colspan, parts of its text]."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[list]] = []
        self.tables = 0
        self.row: list[list] | None = None
        self.cell: list | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        match tag:
            case "table":
                self.tables += 1
            case "tr" if self.tables:
                self.row, self.cell = [], None
            case "td" | "th" if self.row is not None:
                given = dict(attrs)
                self.cell = [tag == "th", _span(given.get("rowspan")), _span(given.get("colspan")), []]
            case "br":
                self.handle_data(" ")

    def handle_endtag(self, tag: str) -> None:
        match tag:
            case "table":
                self.tables = max(self.tables - 1, 0)
            case "tr" if self.row is not None:
                self.rows.append(self.row)
                self.row = self.cell = None
            case "td" | "th" if self.cell is not None:
                self.row.append(self.cell)
                self.cell = None

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell[3].append(data)


def cells_of(html: str | None) -> list[dict] | None:
    """Cells by row and column, or None without a row."""
    events = _Events()
    events.feed(html or "")
    events.close()
    if not events.rows:
        return None
    out: list[dict] = []
    held: list[tuple[int, int, int]] = []  # columns from, to, and the first row in which they are free; in order of columns
    for r, row in enumerate(events.rows):
        held = [x for x in held if x[2] > r]
        at, k, new = 0, 0, []
        for header, down, across, parts in row:
            while k < len(held) and held[k][0] <= at:
                at = max(at, held[k][1])
                k += 1
            out.append({"row": r, "col": at, "rowspan": down, "colspan": across, "text": " ".join("".join(parts).split()), "is_header": header})
            if down > 1:
                new.append((at, at + across, r + down))
            at += across
        held = sorted(held + new)
    return out


CELLS = T.ArrayType(T.StructType([*(T.StructField(n, T.IntegerType()) for n in ("row", "col", "rowspan", "colspan")), T.StructField("text", T.StringType()), T.StructField("is_header", T.BooleanType())]))


@F.pandas_udf(CELLS)
def html_cells(html: pd.Series) -> pd.Series:
    return html.map(cells_of)


def header_rows(cells: Column) -> Column:
    """Number of leading rows that have cells, all of them headers; a row without any cell of its own ends them."""
    rows = F.transform(cells, lambda c: c["row"])
    plain = F.array_min(F.transform(F.filter(cells, lambda c: ~c["is_header"]), lambda c: c["row"]))
    bare = F.array_min(F.array_except(F.sequence(F.lit(0), F.coalesce(F.array_max(rows), F.lit(-1)) + 1), rows))
    return F.coalesce(F.least(plain, bare), F.lit(0))


def table_shape(cells: Column) -> tuple[Column, Column]:
    """Rows and columns that the cells reach."""
    reach = lambda a, b: F.coalesce(F.array_max(F.transform(cells, lambda c: c[a] + c[b])), F.lit(0))
    return reach("row", "rowspan"), reach("col", "colspan")


def structure(cells: Column) -> Column:
    """n_rows, n_cols, header_rows and cells of a table; null without any."""
    n, m = table_shape(cells)
    return F.when(cells.isNotNull(), F.struct(n.alias("n_rows"), m.alias("n_cols"), header_rows(cells).alias("header_rows"), cells.alias("cells")))
