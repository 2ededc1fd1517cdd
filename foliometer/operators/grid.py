"""Tables as cells: span expansion, header inference, variants, topology, and the two-pass grid similarity.

A table's declared shape (n_rows, n_cols) may be larger or smaller than what its cells
cover. Where a function takes `shape`, that is the declared one; without it the shape
is what the cells reach. Cells count in the order of `pos`, if they have it, else by row and column.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kernels import align_texts, ratio
from ..functions.text import norm_cell, plain_cell

CELL = ("row", "col", "rowspan", "colspan", "text", "is_header")


def shapes(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    return cells.groupBy(*keys).agg(F.max(F.col("row") + F.col("rowspan")).alias("n_rows"), F.max(F.col("col") + F.col("colspan")).alias("n_cols"))


def _order(cells: DataFrame) -> Column:
    return F.struct("pos") if "pos" in cells.columns else F.struct("row", "col")


def _upto(low: Column, high: Column) -> Column:
    """low, low + 1, ... under high."""
    return F.when(low < high, F.sequence(low, high - 1)).otherwise(F.array().cast("array<int>"))


def expand_grid(cells: DataFrame, keys: Sequence[str], shape: DataFrame | None = None) -> DataFrame:
    """keys, r, c, text, rowspan, colspan, is_header at each place of the shape.

    Spans are cut at its edge; of cells that overlap the last counts; a place that no cell covers is an empty cell of its own.
    """
    shape = (shapes(cells, keys) if shape is None else shape).select(*keys, "n_rows", "n_cols")
    cell = F.struct("text", "rowspan", "colspan", "is_header")
    inside = cells.join(shape, [*keys])
    covered = inside.select(*keys, "col", "colspan", "n_cols", _order(cells).alias("o"), cell.alias("cell"), F.explode(_upto(F.col("row"), F.least(F.col("row") + F.col("rowspan"), F.col("n_rows")))).alias("r"))
    covered = covered.select(*keys, "r", F.explode(_upto(F.col("col"), F.least(F.col("col") + F.col("colspan"), F.col("n_cols")))).alias("c"), "o", "cell")
    zero = F.lit(0)
    places = shape.select(*keys, F.explode(_upto(zero, F.col("n_rows"))).alias("r"), "n_cols").select(*keys, "r", F.explode(_upto(zero, F.col("n_cols"))).alias("c"), F.lit(None).cast(covered.schema["o"].dataType).alias("o"), F.lit(None).cast(covered.schema["cell"].dataType).alias("cell"))
    last = covered.unionByName(places).groupBy(*keys, "r", "c").agg(F.max_by("cell", "o").alias("cell"))
    value = lambda n, default: F.coalesce(F.col(f"cell.{n}"), F.lit(default)).alias(n)
    return last.select(*keys, "r", "c", value("text", ""), value("rowspan", 1), value("colspan", 1), value("is_header", False))


def line_texts(grid: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """keys, by, line_text: a row's (or column's) normalised cells in order, joined by ' | '."""
    other = "c" if by == "r" else "r"
    items = F.array_sort(F.collect_list(F.struct(F.col(other), F.col("norm"))))
    return grid.withColumn("norm", norm_cell(F.col("text"))).groupBy(*keys, by).agg(F.array_join(F.transform(items, lambda x: x["norm"]), " | ").alias("line_text"))


def tsv(cells: DataFrame, keys: Sequence[str], shape: DataFrame | None = None) -> DataFrame:
    """keys, tsv: anchors only, tabs between columns and line breaks between rows of the shape.

    Each table's cells become a map by place in one aggregation, so no place that is empty becomes a row.
    """
    own = cells.groupBy(*keys).agg(F.max(F.col("row") + F.col("rowspan")).alias("n_rows"), F.max(F.col("col") + F.col("colspan")).alias("n_cols"), F.array_sort(F.collect_list(F.struct("row", "col", *(["pos"] if "pos" in cells.columns else []), F.coalesce("text", F.lit("")).alias("text")))).alias("cells"))
    if shape is not None:
        own = own.drop("n_rows", "n_cols").join(shape.select(*keys, "n_rows", "n_cols"), [*keys])
    zero = F.lit(0)

    def line(r: Column) -> Column:
        # a row's anchors in order of their columns; of two at one place the last
        anchors = F.filter("cells", lambda x: (x["row"] == r) & (x["col"] < F.col("n_cols")))
        at = lambda c: F.coalesce(F.try_element_at(F.filter(anchors, lambda x: x["col"] == c), F.lit(-1))["text"], F.lit(""))
        return F.array_join(F.transform(_upto(zero, F.col("n_cols")), at), "\t")

    return own.select(*keys, F.array_join(F.transform(_upto(zero, F.col("n_rows")), line), "\n").alias("tsv"))


def shape_match(gold: DataFrame, pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, shape_match: 1 where both sides (keys, n_rows, n_cols) declare the same shape."""
    p = pred.select(*keys, F.col("n_rows").alias("pr"), F.col("n_cols").alias("pc"))
    return gold.join(p, [*keys]).select(*keys, ((F.col("n_rows") == F.col("pr")) & (F.col("n_cols") == F.col("pc"))).cast("double").alias("shape_match"))


def infer_headers(cells: DataFrame, keys: Sequence[str], header_rows: F.Column) -> DataFrame:
    """cells with is_header supplied for the first header_rows rows where no cell of the table has the flag."""
    table = Window.partitionBy(*keys)
    none = ~F.max("is_header").over(table)
    return cells.withColumn("inferred", none & (header_rows > 0)).withColumn("is_header", F.when(F.col("inferred"), F.col("row") < header_rows).otherwise(F.col("is_header")))


def _columns_of(refs: Column) -> Column:
    """The columns that references row0/colK name; others are passed over."""
    numbers = F.transform(refs, lambda x: F.regexp_extract(x, "/col([0-9]+)$", 1))
    return F.transform(F.filter(numbers, lambda x: x != ""), lambda x: x.cast("int"))


def ambiguity_variants(cells: DataFrame, ambiguities: DataFrame, keys: Sequence[str]) -> DataFrame:
    """cells with variant and reading: 0 as encoded, and from 1 one for each ambiguity whose alternative is a label over two rows.

    ambiguities: keys, reading (from 1), cells (references), accepted_alternative. In the alternative the labels under the empty
    places of the first row are raised into them. A table without such an ambiguity has its encoded reading only.
    """
    own = ambiguities.where(F.col("accepted_alternative").contains("rowspan=2")).select(*keys, "reading", _columns_of(F.col("cells")).alias("_cols")).where("size(_cols) > 0")
    both = cells.join(own, [*keys])
    named = F.array_contains("_cols", F.col("col"))
    lifted = both.where(~((F.col("row") == 0) & named & (F.coalesce("text", F.lit("")) == "")))
    raised = (F.col("row") == 1) & named
    lifted = lifted.withColumn("rowspan", F.when(raised, 2).otherwise(F.col("rowspan"))).withColumn("row", F.when(raised, 0).otherwise(F.col("row"))).drop("_cols")
    return cells.withColumn("reading", F.lit(0)).withColumn("variant", F.lit("as_encoded")).unionByName(lifted.withColumn("variant", F.lit("rowspan2_alternative")))


def raised(cells: Column, ambiguity: Column) -> Column:
    """A table's cells in the reading over two rows that an ambiguity accepts, null where it accepts none; as `variants_of` has it."""
    named = _columns_of(ambiguity["cells"])
    kept = F.filter(cells, lambda c: ~((c["row"] == 0) & F.array_contains(named, c["col"]) & (F.coalesce(c["text"], F.lit("")) == "")))
    over = lambda c: (c["row"] == 1) & F.array_contains(named, c["col"])
    lifted = F.transform(kept, lambda c: F.when(over(c), c.withField("row", F.lit(0)).withField("rowspan", F.lit(2))).otherwise(c))
    return F.when((F.size(named) > 0) & ambiguity["accepted_alternative"].contains("rowspan=2"), lifted)


def apart(cells: Column, n_rows: Column, n_cols: Column) -> Column:
    """Whether no two cells cover one place, so that their order does not matter."""
    area = F.aggregate(cells, F.lit(0).cast("long"), lambda a, c: a + c["rowspan"].cast("long") * c["colspan"])
    span = lambda first, n: F.when(n > 0, F.sequence(first, first + n - 1)).otherwise(F.array().cast("array<int>"))
    places = F.flatten(F.transform(cells, lambda c: F.flatten(F.transform(span(c["row"], c["rowspan"]), lambda r: F.transform(span(c["col"], c["colspan"]), lambda k: F.struct(r, k))))))
    return F.when(area <= n_rows.cast("long") * n_cols, F.size(F.array_distinct(places)) == area).otherwise(False)


def topology(cells: DataFrame, keys: Sequence[str], n_rows: str = "n_rows", n_cols: str = "n_cols", header_rows: str | None = None) -> DataFrame:
    """keys, rule, n: spans that leave the grid, places covered twice, places not covered, and cells of header rows without the flag.

    cells carry the declared shape and, where header_rows names it, the declared number of header rows. A cell that leaves the grid covers nothing.
    """
    leaves = (F.col("row") + F.col("rowspan") > F.col(n_rows)) | (F.col("col") + F.col("colspan") > F.col(n_cols))
    out_of = cells.where(leaves).groupBy(*keys).agg(F.count("*").alias("n")).withColumn("rule", F.lit("span_exits_grid"))
    at = cells.select(*keys, n_rows, n_cols, leaves.alias("leaves"), F.explode(F.sequence("row", F.col("row") + F.col("rowspan") - 1)).alias("r"), "col", "colspan")
    at = at.select(*keys, n_rows, n_cols, "leaves", "r", F.explode(F.sequence("col", F.col("col") + F.col("colspan") - 1)).alias("c"))
    cover = at.groupBy(*keys, n_rows, n_cols, "r", "c").agg(F.count(F.when(~F.col("leaves"), 1)).alias("_k"))
    twice = cover.where("_k > 1").groupBy(*keys).agg(F.count("*").alias("n")).withColumn("rule", F.lit("double_cover"))
    holes = cover.groupBy(*keys, n_rows, n_cols).agg(F.count(F.when(F.col("_k") > 0, 1)).alias("have")).where(f"have < {n_rows} * {n_cols}").select(*keys, (F.col(n_rows) * F.col(n_cols) - F.col("have")).cast("long").alias("n"), F.lit("hole").alias("rule"))
    found = out_of.unionByName(twice).unionByName(holes)
    if header_rows is None:
        return found
    unflagged = cells.where((F.col("row") < F.col(header_rows)) & ~F.coalesce("is_header", F.lit(False))).groupBy(*keys).agg(F.count("*").alias("n")).withColumn("rule", F.lit("header_flag"))
    return found.unionByName(unflagged)


def fill_gaps(cells: DataFrame, keys: Sequence[str], shape: DataFrame) -> DataFrame:
    """keys, row, col of the places that no cell covers; raises if two cells of a table start at one place."""
    starts = cells.groupBy(*keys, "row", "col").agg(F.count("*").alias("_k"))
    once = starts.select(*keys, F.assert_true(F.col("_k") == 1, F.concat(F.lit("two cells at row "), F.col("row").cast("string"), F.lit(", column "), F.col("col").cast("string"))).alias("ok"))
    unique = once.groupBy(*keys).agg(F.count("ok").alias("_bad"))
    grid = expand_grid(cells.withColumn("is_header", F.lit(True)), keys, shape)
    return grid.where(~F.col("is_header")).join(unique, [*keys]).where("_bad = 0").select(*keys, F.col("r").alias("row"), F.col("c").alias("col"))


# -- one table at a time, in Python


def grid_of(cells: Sequence[dict], n_rows: int, n_cols: int) -> list[list[tuple]]:
    """(normalised text, rowspan, colspan, is header) at each place; cells in list order, the last counts."""
    out = [[("", 1, 1, False)] * n_cols for _ in range(n_rows)]
    for c in cells:
        value = (c["norm"], c["rowspan"], c["colspan"], bool(c["is_header"]))
        for line in out[c["row"] : c["row"] + c["rowspan"]]:
            upto = min(c["col"] + c["colspan"], n_cols)
            line[c["col"] : upto] = [value] * max(upto - c["col"], 0)
    return out


def variants_of(cells: Sequence[dict], ambiguities: Sequence[dict] | None) -> Iterator[tuple[str, list[dict]]]:
    """The readings of a table that count as right, as `ambiguity_variants` has them."""
    yield "as_encoded", list(cells)
    for a in ambiguities if ambiguities is not None else ():
        named = {int(x.rpartition("/col")[2]) for x in a["cells"] if x.rpartition("/col")[2].isdecimal() and "/col" in x}
        if named and "rowspan=2" in (a["accepted_alternative"] or ""):
            kept = [c for c in cells if not (c["row"] == 0 and c["col"] in named and not c["text"])]
            yield "rowspan2_alternative", [{**c, "row": 0, "rowspan": 2} if c["row"] == 1 and c["col"] in named else c for c in kept]


def bag_score(gold: Counter, pred: Counter) -> float:
    """F1 of two multisets; an empty one is right only if the other is empty."""
    if not gold or not pred:
        return float(not gold and not pred)
    return 2 * (gold & pred).total() / (gold.total() + pred.total())


def grid_similarity(gold: list[list[tuple]], pred: list[list[tuple]], least: float = 0.35) -> tuple[float, float]:
    """Content and topology similarity: rows aligned by their text, columns by theirs, cells at the aligned places; 0 for an empty grid."""
    size = sum(map(len, gold)) + sum(map(len, pred))
    if not sum(map(len, gold)) or not sum(map(len, pred)):
        return 0.0, 0.0
    if gold == pred:  # every row and column has its like, in order
        return 1.0, 1.0
    known: dict[tuple[str, str], float] = {}

    def alike(a: str, b: str) -> float:
        if a == b:
            return 1.0
        if (a, b) not in known:
            known[a, b] = ratio(a, b)
        return known[a, b]

    texts, rest = [], []
    for side in (gold, pred):
        texts.append(np.array([[c[0] for c in line] for line in side], dtype=object))
        spans = {x: i for i, x in enumerate(sorted({c[1:] for line in side for c in line}))}
        rest.append((np.array([[spans[c[1:]] for c in line] for line in side]), list(spans)))
    places = []
    for turned in (False, True):
        a, b = ([" | ".join(line) for line in (x.T if turned else x)] for x in texts)
        places.append(np.array(align_texts(a, b, alike, least), dtype=np.int64).reshape(-1, 2).T)
    (gr, pr), (gc, pc) = places
    ours, theirs = texts[0][np.ix_(gr, gc)], texts[1][np.ix_(pr, pc)]
    same = ours == theirs
    con = float(same.sum()) + sum(alike(x, y) for x, y in zip(ours[~same], theirs[~same], strict=True))
    equal = np.array([[x == y for y in rest[1][1]] for x in rest[0][1]])
    top = float(equal[rest[0][0][np.ix_(gr, gc)], rest[1][0][np.ix_(pr, pc)]].sum())
    return 2 * con / size, 2 * top / size


def tables_of(cells: DataFrame, keys: Sequence[str], shape: DataFrame | None = None) -> DataFrame:
    """keys, cells, n_rows, n_cols: a row for each table, its cells as a list in the order in which they count."""
    order = ["pos"] if "pos" in cells.columns else []
    own = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *CELL))).alias("cells"), F.max(F.col("row") + F.col("rowspan")).alias("n_rows"), F.max(F.col("col") + F.col("colspan")).alias("n_cols"))
    own = own.withColumn("cells", F.transform("cells", lambda c: F.struct(*[c[n].alias(n) for n in CELL]))) if order else own
    return own if shape is None else own.drop("n_rows", "n_cols").join(shape.select(*keys, "n_rows", "n_cols"), [*keys])


def _packed(cells: Column) -> list[Column]:
    """A table's cells as two flat lists, which go to Python without an object for each cell: five numbers a cell, and the texts."""
    numbers = F.flatten(F.transform(cells, lambda c: F.array(*[c[n].cast("int") for n in CELL[:4]], F.coalesce(c["is_header"], F.lit(False)).cast("int"))))
    return [numbers, F.transform(cells, lambda c: F.coalesce(c["text"], F.lit("")))]


def _unpacked(numbers: np.ndarray, texts: np.ndarray, n_rows: int, n_cols: int) -> list[list[tuple]]:
    flat = iter(numbers.tolist())
    return grid_of([{"row": r, "col": c, "rowspan": a, "colspan": b, "is_header": h, "norm": plain_cell(x)} for r, c, a, b, h, x in zip(flat, flat, flat, flat, flat, texts, strict=True)], int(n_rows), int(n_cols))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _similarities(a: pd.Series, at: pd.Series, n: pd.Series, m: pd.Series, b: pd.Series, bt: pd.Series, k: pd.Series, l: pd.Series) -> pd.Series:  # noqa: E741
    pairs = zip(a, at, n, m, b, bt, k, l, strict=True)
    return pd.Series([None if x[0] is None else list(grid_similarity(_unpacked(*x[:4]), _unpacked(*x[4:]))) for x in pairs], dtype=object)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _aligned_rows(a: pd.Series, at: pd.Series, n: pd.Series, m: pd.Series, b: pd.Series, bt: pd.Series, k: pd.Series, l: pd.Series) -> pd.Series:  # noqa: E741
    out = []
    for x in zip(a, at, n, m, b, bt, k, l, strict=True):
        lines = [[" | ".join([c[0] for c in line]) for line in _unpacked(*y)] for y in (x[:4], x[4:])]
        out.append([v for pair in align_texts(*lines, ratio_of, 0.35) for v in pair])
    return pd.Series(out, dtype=object)


def ratio_of(a: str, b: str) -> float:
    return 1.0 if a == b else ratio(a, b)


def _both(gold: DataFrame, pred: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    named = lambda df, x: df.select(*keys, *[F.col(c).alias(x + c) for c in ("cells", "n_rows", "n_cols")])
    return named(gold, "g_").join(named(pred, "p_"), [*keys], how)


def align_rows(gold: DataFrame, pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, gold_ix, pred_ix: order-keeping alignment of the rows' texts of two tables; tables as of `tables_of`, of either side."""
    both = _both(gold, pred, keys, "inner")
    side = lambda x: [*_packed(F.col(x + "cells")), F.col(x + "n_rows"), F.col(x + "n_cols")]
    found = both.select(*keys, _aligned_rows(*side("g_"), *side("p_")).alias("found")).where("size(found) > 0")
    at = lambda k: F.get("found", k).cast("long")
    return found.select(*keys, F.inline(F.transform(F.sequence(F.lit(0), (F.size("found") / 2).cast("int") - 1), lambda k: F.struct(at(2 * k).alias("gold_ix"), at(2 * k + 1).alias("pred_ix")))))


def grits_of(gold: DataFrame, pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, grits_con, grits_top for tables of either side, as of `tables_of`; only tables that differ go to Python."""
    both = _both(gold, pred, keys, "full")
    places = lambda x: F.coalesce(F.col(x + "n_rows") * F.col(x + "n_cols"), F.lit(0)) > 0
    same = (F.col("g_cells") == F.col("p_cells")) & (F.col("g_n_rows") == F.col("p_n_rows")) & (F.col("g_n_cols") == F.col("p_n_cols"))
    both = both.withColumn("state", F.when(~(places("g_") & places("p_")), "empty").when(same, "same").otherwise("apart"))
    side = lambda x: [F.when(F.col("state") == "apart", c) for c in (*_packed(F.col(x + "cells")), F.col(x + "n_rows"), F.col(x + "n_cols"))]
    found = both.select(*keys, "state", _similarities(*side("g_"), *side("p_")).alias("found"))
    score = lambda i: F.when(F.col("state") == "same", 1.0).when(F.col("state") == "empty", 0.0).otherwise(F.get("found", F.lit(i)))
    return found.select(*keys, score(0).alias("grits_con"), score(1).alias("grits_top"))


def grits(gold: DataFrame, pred: DataFrame, keys: Sequence[str], gold_shape: DataFrame | None = None, pred_shape: DataFrame | None = None) -> DataFrame:
    """keys, grits_con, grits_top for tables of either side, given by their cells."""
    return grits_of(tables_of(gold, keys, gold_shape), tables_of(pred, keys, pred_shape), keys)
