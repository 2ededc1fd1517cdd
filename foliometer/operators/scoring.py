"""Scores of predicted pages against gold ones, from the alignment of their blocks to the tracks.

A page is a set of rows, one for each block:

    doc_id, ix, type, text, x0, y0, x1, y1,
    cells (of a table, in list order), n_rows, n_cols, header_rows, ambiguities,
    chart (labels, number of marks, marks by class, axis labels)

Predictions carry `run` as well; one frame holds all runs. A page of a run then
becomes one row that holds the blocks of both sides, and the tracks are expressions
on it. Pairs, tables' scores and edit distances of what differs from gold need
sequential code in Python; what equals gold is settled without it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t
from ..functions.jvm import call, kernels
from ..functions.kernels import assign
from ..sources.store import small_batches, stored
from . import chart as charts
from . import tracks
from .alignment import similarity_matrix
from .grid import CELL, apart, bag_score, grid_of, grid_similarity, raised, variants_of

KEYS = ["run", "doc_id"]


def tsv_of(cells: Column, n_rows: Column, n_cols: Column) -> Column:
    """A table's anchors as tab-separated lines of its declared shape; empty without cells."""
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def line(r: Column) -> Column:
        anchors = F.filter(cells, lambda x: x["row"] == r)
        place = lambda c: F.coalesce(F.try_element_at(F.filter(anchors, lambda x: x["col"] == c), F.lit(-1))["text"], F.lit(""))
        return F.array_join(F.transform(upto(n_cols), place), "\t")

    lines = F.transform(upto(n_rows), line)
    return F.when(F.coalesce(F.size(cells), F.lit(0)) > 0, F.array_join(lines, "\n")).otherwise(F.lit(""))


def with_texts(blocks: DataFrame, coarse) -> DataFrame:
    """blocks with kind (coarse type, or the type itself) and body (text, or a table's cells as text)."""
    body = F.when(F.coalesce("text", F.lit("")) != "", F.col("text")).otherwise(tsv_of(F.col("cells"), F.col("n_rows"), F.col("n_cols")))
    return blocks.withColumn("kind", F.coalesce(coarse(F.col("type")), F.col("type"))).withColumn("body", body)


def page_texts(gold: DataFrame, pred: DataFrame, pages: DataFrame) -> DataFrame:
    """run, doc_id, g, p of pages (run, doc_id): both sides' blocks in their order, a list of ix, type, kind, body each."""
    blocks = lambda df, keys, name: df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ix", "type", "kind", "body"))).alias(name))
    none = F.array().cast("array<struct<ix:bigint,type:string,kind:string,body:string>>")
    both = pages.join(blocks(gold, ["doc_id"], "g"), "doc_id", "left").join(blocks(pred, KEYS, "p"), KEYS, "left")
    return both.select(*KEYS, F.coalesce("g", none).alias("g"), F.coalesce("p", none).alias("p"))


def _at(blocks: Column, worded: bool) -> Column:
    """The places of a page's blocks with a text, or without one, and what is paired there."""
    places = F.transform(blocks, lambda x, k: F.struct(k.alias("at"), x["kind"].alias("kind"), x["body"].alias("body")))
    return F.filter(places, lambda x: (x["body"] != "") if worded else (x["body"] == ""))


def _upto(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _settled(df: DataFrame, *names: str) -> DataFrame:
    """df with the named columns worked out here; lambdas that move into a Python function's arguments are not found there by Spark."""
    return df.select(*[c for c in df.columns if c not in names], F.inline(F.array(F.struct(*names))))


def paired(texts: DataFrame, threshold: float = 0.55) -> DataFrame:
    """texts (as of `page_texts`) with same, whether a run's texts are those of gold in their order, and pairs: i, j (places in g and p), sim.

    Blocks with a text are assigned by similarity, those under the threshold dropped after the
    optimum; blocks without one are paired in order within their coarse type. Of equal optima the one with the most pairs of one
    coarse type counts, so that a line that repeats a footer's text does not take its place.
    A run whose texts are those of gold, in their order, has its only optimum there, and no text of it is compared.
    """
    kernels(texts.sparkSession)
    both = texts.withColumn("gw", _at(F.col("g"), True)).withColumn("pw", _at(F.col("p"), True)).withColumn("same", F.col("gw.body") == F.col("pw.body"))
    both = _settled(both, "gw", "pw", "same")
    other = lambda c, of: F.when(~F.col("same") & (F.size("gw") > 0) & (F.size("pw") > 0), F.col(f"{c}.{of}"))
    both = both.withColumn("found", call("pairs", other("gw", "body"), other("pw", "body"), other("gw", "kind"), other("pw", "kind"), F.lit(float(threshold))))
    both = _settled(both, "found").withColumn("gb", _at(F.col("g"), False)).withColumn("pb", _at(F.col("p"), False))
    pair = lambda i, j, sim: F.struct(i.alias("i"), j.alias("j"), sim.alias("sim"))
    at = lambda k: F.get("found", k)
    as_they_are = F.transform("gw", lambda x, k: pair(x["at"], F.get("pw", k)["at"], F.lit(1.0)))
    found = F.transform(_upto((F.size("found") / 3).cast("int")), lambda k: pair(F.get("gw", at(3 * k).cast("int"))["at"], F.get("pw", at(3 * k + 1).cast("int"))["at"], at(3 * k + 2)))
    alike = lambda blocks, x: F.filter(blocks, lambda y: y["kind"] == x["kind"])
    blank = F.transform("gb", lambda x, k: pair(x["at"], F.get(alike(F.col("pb"), x), F.size(alike(F.slice("gb", F.lit(1), k), x)))["at"], F.lit(1.0)))
    pairs = F.concat(F.when(F.col("same"), as_they_are).otherwise(found), F.filter(blank, lambda x: x["j"].isNotNull()))
    return both.select(*KEYS, "g", "p", "same", pairs.alias("pairs"))


def pair_blocks(gold: DataFrame, pred: DataFrame, threshold: float = 0.55) -> DataFrame:
    """run, doc_id, gold_ix, pred_ix, sim of all pairs of `paired`; gold, pred: as of `with_texts`."""
    both = paired(page_texts(gold, pred, pred.select(*KEYS).distinct()), threshold).select(*KEYS, "g", "p", F.inline("pairs"))
    return both.select(*KEYS, F.get("g", F.col("i"))["ix"].alias("gold_ix"), F.get("p", F.col("j"))["ix"].alias("pred_ix"), "sim")


def text_columns(with_wer: bool, with_sizes: bool, aligned: Column | None) -> dict[str, Column]:
    """The text track's columns of a row of `_measured`; a run whose texts are those of gold is not normalised for its errors.

    aligned: where cer_aligned is wanted.
    """
    same, e = F.col("alike"), lambda k: F.get("errors", F.lit(k))
    out = {name: F.when(same, 0.0).otherwise(t.rate(e(k), e(2), e(3))) for k, name in enumerate(("cer", "cer_aligned"))}
    out = ({"cer": out["cer"]} if aligned is None else {**out, "cer_aligned": F.when(aligned, out["cer_aligned"])}) | {"block_similarity": F.col("block_similarity")}
    if with_wer:
        out["wer"] = F.when(same, 0.0).otherwise(t.rate(e(4), e(5), e(6)))
    if with_sizes:
        out |= {"gold_chars": F.length(call("plain", F.col("g_text"))), "pred_chars": F.length(call("plain", F.col("p_text")))}
    return out


def _aligned(wanted: Sequence[str]) -> Column | None:
    """Where cer_aligned is wanted: `aligned` of all runs, `aligned:run` of one."""
    runs = [x.removeprefix("aligned:") for x in wanted if x.startswith("aligned:")]
    return F.lit(True) if "aligned" in wanted else F.col("run").isin(runs) if runs else None


def _measured(texts: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """What the tracks on texts, structure and furniture count on each page of each run."""
    n = lambda c: F.size(c)
    kinds = lambda x: F.struct(x["i"].alias("i"), x["j"].alias("j"), x["sim"].alias("sim"), F.get("g", x["i"])["type"].alias("gt"), F.get("g", x["i"])["kind"].alias("gk"), F.get("p", x["j"])["type"].alias("pt"), F.get("p", x["j"])["kind"].alias("pk"), (F.get("p", x["j"])["body"] != "").alias("worded"))
    both = paired(texts).withColumn("all", F.transform("pairs", kinds))
    both = both.withColumn("own", F.array_sort(F.filter("all", lambda x: x["gk"] != "furniture"))).withColumn("furniture", F.filter("all", lambda x: x["gk"] == "furniture")["j"])
    columns = [*KEYS, (F.size("g") + F.size("p")).alias("n_blocks")]
    if "furniture" in wanted:
        columns += [n(F.filter("g", lambda x: x["kind"] == "furniture")).alias("n_furniture"), n(F.col("furniture")).alias("n_found")]
    if "structure" in wanted:
        both = both.withColumn("order", F.col("own.j"))
        both = _settled(both.withColumn("rising", F.col("order") == F.array_sort("order")), "order", "rising")
        tau = F.when(F.col("rising"), 1.0).otherwise(call("tau", F.when(~F.col("rising"), F.col("order"))))
        columns += [n(F.filter("g", lambda x: x["kind"] != "furniture")).alias("n_gold"), (F.size("p") - F.size("furniture")).alias("n_pred"), F.size("own").alias("tp"), n(F.filter("own", lambda x: x["gt"] == x["pt"])).alias("strict"), n(F.filter("own", lambda x: x["gk"] == x["pk"])).alias("coarse"), (F.size("p") - F.size("all")).alias("spurious"), tau.alias("tau")]
    if "text" in wanted:
        worded = F.filter("own", lambda x: x["worded"])
        total = F.aggregate(worded, F.lit(0.0), lambda a, x: a + x["sim"])
        g_text = F.array_join(F.filter("g", lambda x: (x["kind"] != "furniture") & (x["body"] != ""))["body"], " ")
        p_text = F.array_join(F.filter("p", lambda x, j: (x["body"] != "") & ~F.array_contains("furniture", j))["body"], " ")
        # the predicted texts in the order of gold, those without a partner last
        rest = F.filter(F.transform(F.array_except(_upto(F.size("p")), F.col("all.j")), lambda j: F.get("p", j)["body"]), lambda x: x != "")
        q_text = F.array_join(F.concat(F.transform(worded, lambda x: F.get("p", x["j"])["body"]), rest), " ")
        both = both.withColumn("alike", F.col("same"))
        sized, aligned = "sizes" in wanted, _aligned(wanted)
        both = both.withColumn("g_text", F.when(~F.col("same") | F.lit(sized), g_text)).withColumn("p_text", F.when(~F.col("same") | F.lit(sized), p_text)).withColumn("q_text", F.lit(None).cast("string") if aligned is None else F.when(~F.col("same") & aligned, q_text)).withColumn("block_similarity", F.when(n(worded) > 0, total / n(worded)).otherwise(0.0))
        both = _settled(both, "g_text", "p_text", "q_text", "block_similarity")
        differ = lambda c: F.when(~F.col("same"), F.col(c))
        both = both.withColumn("errors", call("errors", differ("g_text"), differ("p_text"), F.when(F.col("p_text") != F.col("q_text"), F.col("q_text")), F.lit("wer" in wanted)))
        both = _settled(both, "errors")
        columns += [c.alias(name) for name, c in text_columns("wer" in wanted, sized, aligned).items()]
    return both.select(*columns)


def text_track(measured: DataFrame) -> DataFrame:
    """run, doc_id, cer, cer_aligned, block_similarity, order_penalty, score; wer, gold_chars and pred_chars where they are wanted, cer_aligned and its penalty too.

    Each side's texts in its own order; cer_aligned puts the predicted ones into the order of gold,
    those without a partner last. What is paired with gold furniture does not count.
    """
    known = [c for c in ("cer", "wer", "cer_aligned", "block_similarity", "gold_chars", "pred_chars") if c in measured.columns]
    out = measured.select(*KEYS, *known)
    if "cer_aligned" in known:
        out = out.withColumn("order_penalty", F.when(F.col("cer_aligned").isNotNull(), F.greatest(F.col("cer") - F.col("cer_aligned"), F.lit(0.0))))
    return out.withColumn("score", t.accuracy(F.col("cer")))


def structure_track(measured: DataFrame) -> DataFrame:
    """run, doc_id, block_precision, block_recall, block_f1, type_strict, type_coarse, tau, spurious, score of pages that have a block on either side."""
    return tracks.structure_of(measured.where("n_blocks > 0"), KEYS)


def furniture_track(measured: DataFrame) -> DataFrame:
    return measured.where("n_furniture > 0").select(*KEYS, F.col("n_furniture").alias("n_gold"), "n_found", (F.col("n_found") / F.col("n_furniture")).alias("score"))


def table_pairs(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """run, doc_id, gold_ix, pred_ix, grits_con, grits_top, header_f1, combined, variant, header_inferred, cell_bag_f1, shape_match of the tables that are paired.

    Tables of a page are assigned by their texts; header flags are supplied where a prediction has none; of the readings
    that gold accepts the one of greatest combined score counts, the first of equals.
    """
    return paired_tables(page_tables(gold, ["doc_id"], ["ambiguities"], "g").join(page_tables(pred, KEYS, [], "p"), "doc_id"))


def page_tables(blocks: DataFrame, keys: Sequence[str], more: Sequence[str], name: str) -> DataFrame:
    """keys and, as a list by the given name, the page's tables that have cells."""
    known = ["ix", "body", "cells", "n_rows", "n_cols", "header_rows"]
    return blocks.where("type = 'table' AND size(cells) > 0").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*known, *more))).alias(name))


def paired_tables(both: DataFrame) -> DataFrame:
    """`table_pairs` of rows run, doc_id, g, p: a page's tables of either side, a list of ix, body, cells, n_rows, n_cols, header_rows, of g also ambiguities."""
    kinds = {f.name: f.dataType.simpleString() for f in both.schema.fields}
    columns = ["grits_con", "grits_top", "header_f1", "combined", "variant", "header_inferred", "cell_bag_f1", "shape_match"]

    def read(cells) -> list[dict]:
        rows = [{n: c[n] for n in CELL} for c in cells]
        return [{**c, "norm": t.plain_cell(c["text"])} for c in rows]

    def compare(g, p) -> tuple:
        ours, cells, rows = read(g["cells"]), read(p["cells"]), p["header_rows"] or g["header_rows"]
        inferred = not any(c["is_header"] for c in cells) and rows is not None and rows > 0
        if inferred:
            cells = [{**c, "is_header": c["row"] < rows} for c in cells]
        theirs, best = grid_of(cells, int(p["n_rows"]), int(p["n_cols"])), None
        for name, variant in variants_of(ours, g["ambiguities"]):
            con, top = grid_similarity(grid_of(variant, int(g["n_rows"]), int(g["n_cols"])), theirs)
            header = bag_score(*(Counter((c["norm"], c["rowspan"], c["colspan"]) for c in x if c["is_header"]) for x in (variant, cells)))
            combined = 0.5 * con + 0.25 * top + 0.25 * header
            if best is None or combined > best[3]:
                best = (con, top, header, combined, name)
        bag = bag_score(*(Counter(c["norm"] for c in x if c["norm"]) for x in (ours, cells)))
        return (*best, inferred, bag, float((g["n_rows"], g["n_cols"]) == (p["n_rows"], p["n_cols"])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, doc, gs, ps in batch[[*KEYS, "g", "p"]].itertuples(index=False):
                for i, j in assign(similarity_matrix([t.plain(x["body"]) for x in gs], [t.plain(x["body"]) for x in ps])) if len(gs) > 1 or len(ps) > 1 else [(0, 0)]:
                    rows.append((name, doc, gs[i]["ix"], ps[j]["ix"], *compare(gs[i], ps[j])))
            yield pd.DataFrame(rows, columns=[*KEYS, "gold_ix", "pred_ix", *columns])

    # the only table of either side, predicted as one of its readings: every score is 1, and the reading's name is known
    g, p = F.get("g", F.lit(0)), F.get("p", F.lit(0))
    cell = lambda side: F.transform(side["cells"], lambda c: F.struct(*[c[n].alias(n) for n in CELL]))
    one = (F.size("g") == 1) & (F.size("p") == 1) & (g["n_rows"] == p["n_rows"]) & (g["n_cols"] == p["n_cols"]) & (g["n_rows"] > 0) & (g["n_cols"] > 0) & F.exists(p["cells"], lambda c: F.coalesce(c["is_header"], F.lit(False)))
    flagged = lambda side: F.size(F.filter(side["cells"], lambda c: F.coalesce(c["is_header"], F.lit(False))))
    other = (flagged(g) != flagged(p)) & (F.size(g["ambiguities"]) == 1) & (F.array_sort(raised(cell(g), F.get(g["ambiguities"], F.lit(0)))) == F.array_sort(cell(p))) & apart(p["cells"], p["n_rows"], p["n_cols"])
    name = F.when(one, F.when((g["cells"] == p["cells"]) | (cell(g) == cell(p)), "as_encoded").when(other, "rowspan2_alternative"))
    both = both.withColumn("variant", name)
    # what is settled goes past Python
    whole = [F.lit(1.0).alias(c) for c in columns if c not in ("variant", "header_inferred")]
    settled = both.where("variant IS NOT NULL").select(*KEYS, g["ix"].cast("long").alias("gold_ix"), p["ix"].cast("long").alias("pred_ix"), *whole, "variant", F.lit(False).alias("header_inferred"))
    schema = f"run string, doc_id {kinds['doc_id']}, gold_ix long, pred_ix long, grits_con double, grits_top double, header_f1 double, combined double, variant string, header_inferred boolean, cell_bag_f1 double, shape_match double"
    return settled.unionByName(both.where("variant IS NULL").select(*KEYS, "g", "p").mapInPandas(run, schema))


def scored_tables(n_gold: DataFrame, found: DataFrame) -> DataFrame:
    """run, doc_id, n_gold, n_found, score: the combined scores over the page's gold tables, 0 for one without a partner; n_gold: run, doc_id, n_gold."""
    sums = found.groupBy(*KEYS).agg(F.sum("combined").alias("s"), F.count("*").alias("n_found"))
    return n_gold.join(sums, KEYS, "left").select(*KEYS, "n_gold", F.coalesce("n_found", F.lit(0)).alias("n_found"), (F.coalesce("s", F.lit(0.0)) / F.col("n_gold")).alias("score"))


def table_track(gold: DataFrame, found: DataFrame, pages: DataFrame) -> DataFrame:
    """`scored_tables` of blocks that are a row each; no row without gold tables."""
    return scored_tables(gold.where("type = 'table'").groupBy("doc_id").agg(F.count("*").alias("n_gold")).join(pages, "doc_id").select(*KEYS, "n_gold"), found)


def first_chart(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    return blocks.where("type = 'chart' AND chart IS NOT NULL").groupBy(*keys).agg(F.min_by("chart", "ix").alias("chart"))


def page_charts(gold: DataFrame, pred: DataFrame, pages: DataFrame) -> DataFrame:
    """run, doc_id, g, p: each page's first chart of either side, for pages whose gold has one."""
    g, p = first_chart(gold, ["doc_id"]).join(pages, "doc_id"), first_chart(pred, KEYS)
    return g.select(*KEYS, F.col("chart").alias("g")).join(p.select(*KEYS, F.col("chart").alias("p")), KEYS, "left")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _folded(labels: pd.Series) -> pd.Series:
    return labels.map(lambda x: None if x is None else [t.plain(y, "L2") for y in x])


def _labels(labels: Column) -> Column:
    """The distinct normalised labels; those in ASCII alone need no Python."""
    known = F.coalesce(labels, F.array().cast("array<string>"))
    plain = ~F.exists(known, lambda x: x.isNull() | x.rlike("[^\\x00-\\x7F]"))
    folded = F.when(plain, F.transform(known, lambda x: F.lower(t.collapse(x)))).otherwise(_folded(F.when(~plain, known)))
    return F.array_distinct(F.filter(folded, lambda x: x != ""))


def _histograms_alike(g: Column, p: Column) -> Column:
    """One less half the absolute difference of two normalised histograms, maps of counts; 1 for two empty ones."""
    none = F.create_map().cast("map<string,bigint>")
    g, p = F.coalesce(g, none), F.coalesce(p, none)
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    share = lambda m, k, n: F.coalesce(F.try_element_at(m, k), F.lit(0)) / n
    apart_ = F.aggregate(F.array_union(F.map_keys(g), F.map_keys(p)), F.lit(0.0), lambda a, k: a + F.abs(share(g, k, total(g)) - share(p, k, total(p))))
    return F.when((total(g) == 0) & (total(p) == 0), 1.0).when((total(g) == 0) | (total(p) == 0), 0.0).otherwise(1 - apart_ / 2)


def chart_track(both: DataFrame) -> DataFrame:
    """run, doc_id, labels_precision, labels_recall, labels_f1, missed, spurious, count, histogram, axes, score of rows as of `page_charts`; 0 without a predicted one."""
    both = both.withColumn("gl", _labels(F.col("g.labels"))).withColumn("pl", _labels(F.col("p.labels")))
    both = _settled(both, "gl", "pl")
    precision, recall, f1 = t.prf(F.size(F.array_intersect("gl", "pl")), F.size("gl"), F.size("pl"))
    any_ = F.size("gl") + F.size("pl") > 0
    only = lambda a, b: F.when(any_, F.slice(F.array_sort(F.array_except(a, b)), 1, 8))

    def axis(name: str) -> Column:
        g, p = F.coalesce(f"g.{name}", F.lit("")), F.coalesce(f"p.{name}", F.lit(""))
        text = lambda c: t.normalize(F.when(g != p, c))
        return F.when(g == p, 1.0).otherwise(t.similarity(text(g), text(p)))

    count = t.count_accuracy(F.coalesce("g.n", F.lit(0)), F.coalesce("p.n", F.lit(0)))
    out = both.select(*KEYS, F.col("p").isNotNull().alias("there"), precision.alias("labels_precision"), recall.alias("labels_recall"), f1.alias("labels_f1"), only("gl", "pl").alias("missed"), only("pl", "gl").alias("spurious"), count.alias("count"), _histograms_alike(F.col("g.by_class"), F.col("p.by_class")).alias("histogram"), ((axis("x") + axis("y")) / 2).alias("axes"))
    return out.withColumn("score", F.when(F.col("there"), charts.chart_score(F.col("labels_f1"), F.col("count"), F.col("histogram"), F.col("axes"))).otherwise(0.0)).drop("there")


TRACKS = ("text", "structure", "table", "chart_data", "furniture")
#: What is worked out by default: the tracks, the tables' pairs, and of the text track also the errors in the order of gold, the words' errors and the sizes.
ALL = (*TRACKS, "tables", "aligned", "wer", "sizes")


def _for_all(df: DataFrame, readings: dict[str, list[str]] | None) -> DataFrame:
    """df with its rows once for each run that reads what the row's run reads."""
    if readings is None:
        return df
    names = F.lit(None).cast("array<string>")
    for first, runs in readings.items():
        names = F.when(F.col("run") == first, F.array(*map(F.lit, runs))).otherwise(names)
    return df.select(F.explode(names).alias("run"), *[c for c in df.columns if c != "run"])


def page_scores(texts: DataFrame | None, tables: DataFrame | None, charts: DataFrame | None, wanted: Sequence[str] = ALL, by_text: dict[str, list[str]] | None = None, by_table: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """Each wanted track's rows by name, and the tables' pairs as `tables`, of pages that are a row each.

    texts: as of `page_texts`; tables: run, doc_id, n_gold (tables of gold), g, p (as of `paired_tables`, or null); charts: as of `page_charts`.
    by_text, by_table: the runs that read the same texts, or tables, by the one whose rows stand for them all; without these each has its own.
    Only measures are written; what no wanted track reads is not worked out.
    """
    out = {}
    if {"text", "structure", "furniture"} & set(wanted):
        measured = _for_all(stored(_measured(texts, wanted), "measured"), by_text)
        tracked = {"text": text_track, "structure": structure_track, "furniture": furniture_track}
        out |= {name: track(measured) for name, track in tracked.items() if name in wanted}
    if {"table", "tables"} & set(wanted):
        small_batches(tables.sparkSession)
        out["tables"] = _for_all(stored(paired_tables(tables.where("size(g) > 0 AND size(p) > 0")), "tables"), by_table)
        out["table"] = scored_tables(_for_all(tables.select(*KEYS, "n_gold"), by_table), out["tables"])
    if "chart_data" in wanted:
        out["chart_data"] = stored(chart_track(charts), "charts")
    return out


def track_scores(gold: DataFrame, pred: DataFrame, pages: DataFrame, coarse, wanted: Sequence[str] = ALL) -> dict[str, DataFrame]:
    """`page_scores` of blocks that are a row each; pages: run, doc_id of every page of every run."""
    g, p = with_texts(gold, coarse), with_texts(pred, coarse)
    n_gold = g.where("type = 'table'").groupBy("doc_id").agg(F.count("*").alias("n_gold")).join(pages, "doc_id")
    tables = n_gold.join(page_tables(g, ["doc_id"], ["ambiguities"], "g"), "doc_id", "left").join(page_tables(p, KEYS, [], "p"), KEYS, "left")
    return page_scores(page_texts(g, p, pages), tables, page_charts(g, p, pages), wanted)


def long_scores(by_track: dict[str, DataFrame]) -> DataFrame:
    """run, doc_id, track, score over all tracks; a track that a page has not has no row."""
    out = None
    for name in TRACKS:
        rows = by_track[name].select(*KEYS, F.lit(name).alias("track"), "score")
        out = rows if out is None else out.unionByName(rows)
    return out
