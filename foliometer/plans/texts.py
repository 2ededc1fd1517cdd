"""Queries of text normalisation, text metrics, layout and degradations over blocks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import alignment, degrade, layout, tracks
from .fixtures import BLOCKS, COARSE_SQL, coarse, gold_blocks, line_type, read, y_sorted


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def l0(c: str) -> str:
    return rf"trim(regexp_replace(nfc_normalize(coalesce({c}, '')), '\s+', ' ', 'g'))"


def l1(c: str) -> str:
    out = f"translate(nfc_normalize(coalesce({c}, '')), {_q(''.join(t.FOLD_ONE) + t.FOLD_GONE)}, {_q(''.join(t.FOLD_ONE.values()))})"
    for one, many in t.FOLD_MANY.items():
        out = f"replace({out}, {_q(one)}, {_q(many)})"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


def _noise(c: str, key: str) -> str:
    return f"""array_to_string(list_transform(string_split({c}, ''), lambda ch, i: CASE WHEN (((('0x' || substr(md5({key}), 1, 8))::BIGINT + (i - 1) * 7919) * 48271) % 2147483647) % 50 = 0
      THEN substr({_q(degrade.ALPHABET)}, (((((('0x' || substr(md5({key}), 1, 8))::BIGINT + (i - 1) * 7919) * 48271) % 2147483647) // 50) % 27 + 1)::BIGINT, 1) ELSE ch END), '')"""


NOISY = f"""
noisy AS (SELECT *, CASE WHEN text IS NULL OR text = '' THEN text ELSE {_noise("text", "doc_id || '|' || block_ix")} END AS noisy FROM gold_blocks)"""
#: Every block with a text and its noisy copy, in letters of one byte each, as DuckDB's levenshtein counts bytes: in each pair the
#: characters outside ASCII become ASCII characters that the pair has not, so that equal ones stay equal and different ones different.
WHOLE = f"""
whole AS (SELECT doc_id, block_ix, {l1("text")} AS g0, {l1("noisy")} AS p0 FROM noisy WHERE text IS NOT NULL),
wide AS (SELECT *, array_to_string(list_distinct(regexp_extract_all(g0 || p0, '[^\\x00-\\x7F]')), '') AS has, array_to_string(list_filter(list_transform(range(1, 128), lambda i: chr(i::INTEGER)), lambda c: NOT contains(g0 || p0, c)), '') AS free FROM whole),
bytes AS (SELECT doc_id, block_ix, translate(g0, has, free) AS g, translate(p0, has, free) AS p FROM wide)"""


def noisy(s, sf):
    b = gold_blocks(s, sf)
    b = b.withColumn("_seed", degrade.noise_seed(F.concat_ws("|", "doc_id", "block_ix")))
    return b.withColumn("noisy", F.when(F.coalesce(F.col("text"), F.lit("")) == "", F.col("text")).otherwise(degrade.noisy_text(F.col("text"), F.col("_seed")))).drop("_seed")


def text_pairs(s, sf):
    """Every block that has a text, as it is and with noise."""
    return noisy(s, sf).where("text IS NOT NULL").select("doc_id", "block_ix", t.normalize(F.col("text")).alias("g"), t.normalize(F.col("noisy")).alias("p"))


def _docs(expr):
    return lambda s, sf: read(s, sf, "documents").select("doc_id", expr(F.col("text")).alias("out"))


def _pairs(s, sf):
    """Each block with itself, at its place in the order from top to bottom."""
    b = y_sorted(gold_blocks(s, sf)).withColumn("kind", coarse(F.col("type")))
    return b


PAIRS = BLOCKS + """, pairs AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(y0, 1), x0, block_ix) - 1 AS pred_ix FROM gold_blocks)"""

Q: dict[str, tuple] = {}

# -- normalisation
Q["norm_l0"] = (_docs(lambda c: t.normalize(c, "L0")), f"SELECT doc_id, {l0('text')} AS out FROM documents")
Q["norm_l1"] = (_docs(t.normalize), f"SELECT doc_id, {l1('text')} AS out FROM documents")
Q["norm_l2"] = (_docs(lambda c: t.normalize(c, "L2")), f"SELECT doc_id, replace(lower({l1('text')}), 'ß', 'ss') AS out FROM documents")
Q["tokens"] = (lambda s, sf: read(s, sf, "documents").select("doc_id", F.size(t.tokens(F.col("text"))).cast("long").alias("n"), F.md5(F.array_join(t.tokens(F.col("text")), "|")).alias("digest")), f"SELECT doc_id, CASE WHEN x = '' THEN 0 ELSE len(string_split(x, ' ')) END::BIGINT AS n, md5(replace(x, ' ', '|')) AS digest FROM (SELECT doc_id, {l1('text')} AS x FROM documents)")
Q["ws_lines"] = (_docs(t.ws_lines), r"SELECT doc_id, regexp_replace(array_to_string(list_transform(string_split(replace(text, chr(160), ' '), chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), chr(10)), '^\s+|\s+$', '', 'g') AS out FROM documents")
Q["norm_chars"] = (_docs(t.norm_chars), r"SELECT doc_id, regexp_replace(translate(text, '•' || chr(61623), ''), '\s', '', 'g') AS out FROM documents")
Q["collapse_ws"] = (_docs(t.collapse), r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS out FROM documents")
Q["strip_marker"] = (lambda s, sf: gold_blocks(s, sf).where("type = 'list'").select("doc_id", "block_ix", t.strip_marker(F.concat(F.lit("• "), "text")).alias("out")), f"WITH {BLOCKS} SELECT doc_id, block_ix, text AS out FROM gold_blocks WHERE type = 'list' AND text IS NOT NULL")
Q["tick_filter"] = (lambda s, sf: read(s, sf, "lineitem").select(F.explode(F.array(F.concat(F.col("l_linenumber").cast("string"), F.lit("%")), F.col("l_returnflag"), F.concat(F.lit("-"), F.col("l_linenumber").cast("string"), F.lit(".5")))).alias("label")).where(t.is_tick(F.col("label"))).groupBy("label").agg(F.count("*").alias("n")), r"SELECT label, count(*) AS n FROM (SELECT unnest([l_linenumber || '%', l_returnflag, '-' || l_linenumber || '.5']) AS label FROM lineitem) WHERE regexp_full_match(label, '[-+]?\d+(\.\d+)?%?') GROUP BY label")
Q["fmt3"] = (lambda s, sf: read(s, sf, "lineitem").groupBy("l_shipdate").agg(F.avg(F.when(F.col("l_discount") > 0.09, F.col("l_quantity"))).alias("a")).select("l_shipdate", t.fmt3(F.col("a")).alias("out")), "SELECT l_shipdate, coalesce(format('{:.3f}', a), '—') AS out FROM (SELECT l_shipdate, avg(CASE WHEN l_discount > 0.09 THEN l_quantity END) AS a FROM lineitem GROUP BY 1)")

# -- metrics
_cer_sql = "CASE WHEN length(g) = 0 THEN CASE WHEN length(p) = 0 THEN 0.0 ELSE 1.0 END ELSE levenshtein(g, p)::DOUBLE / length(g) END"
Q["cer"] = (lambda s, sf: text_pairs(s, sf).select("doc_id", "block_ix", F.round(t.cer(F.col("g"), F.col("p")), 6).alias("cer")), f"WITH {BLOCKS}, {NOISY}, {WHOLE} SELECT doc_id, block_ix, round({_cer_sql}, 6) AS cer FROM bytes")
Q["text_accuracy"] = (lambda s, sf: text_pairs(s, sf).join(read(s, sf, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.round(F.avg(t.accuracy(t.cer(F.col("g"), F.col("p")))), 6).alias("accuracy"), F.count("*").alias("n")), f"WITH {BLOCKS}, {NOISY}, {WHOLE} SELECT lang, round(avg(greatest(0.0, 1 - least(1.0, {_cer_sql}))), 6) AS accuracy, count(*) AS n FROM bytes JOIN documents USING (doc_id) GROUP BY lang")
Q["wer"] = (lambda s, sf: text_pairs(s, sf).select("doc_id", "block_ix", F.round(t.wer(F.col("g"), F.col("p")), 6).alias("wer")), None)
Q["indel_ratio"] = (lambda s, sf: text_pairs(s, sf).select("doc_id", "block_ix", F.round(t.similarity(F.col("g"), F.col("p")), 6).alias("sim")), None)
Q["count_accuracy"] = (lambda s, sf: read(s, sf, "events").groupBy("user_id").agg(F.count("*").alias("g"), F.count(F.when(F.col("value") > 5, 1)).alias("p")).select("user_id", F.round(t.count_accuracy(F.col("g"), F.col("p")), 6).alias("accuracy")), "SELECT user_id, round(CASE WHEN abs(p - g) / g <= 0.1 THEN 1.0 ELSE greatest(0.0, 1 - (abs(p - g) / g - 0.1) / 0.2) END, 6) AS accuracy FROM (SELECT user_id, count(*)::DOUBLE AS g, count(*) FILTER (value > 5)::DOUBLE AS p FROM events GROUP BY 1)")

# -- degradations of blocks
Q["deg_perfect"] = (lambda s, sf: gold_blocks(s, sf).select("doc_id", "block_ix", "type", "text"), f"WITH {BLOCKS} SELECT doc_id, block_ix, type, text FROM gold_blocks")
Q["deg_text_only"] = (lambda s, sf: degrade.text_only(gold_blocks(s, sf)).select("doc_id", "block_ix", "type", "text"), f"WITH {BLOCKS} SELECT doc_id, block_ix, 'paragraph' AS type, text FROM gold_blocks WHERE coalesce(text, '') <> ''")
Q["deg_y_sorted"] = (lambda s, sf: y_sorted(gold_blocks(s, sf)).select("doc_id", "block_ix", "pred_ix"), f"WITH {PAIRS} SELECT doc_id, block_ix, pred_ix FROM pairs")
Q["deg_noisy_text"] = (lambda s, sf: noisy(s, sf).select("doc_id", "block_ix", "noisy"), f"WITH {BLOCKS}, {NOISY} SELECT doc_id, block_ix, noisy FROM noisy")
Q["deg_merged_paragraphs"] = (
    lambda s, sf: degrade.merged_paragraphs(gold_blocks(s, sf), ["doc_id"]).select("doc_id", "block_ix", "type", "text"),
    f"""WITH {BLOCKS}, f AS (
      SELECT *, CASE WHEN type = 'paragraph' AND lag(type) OVER (PARTITION BY doc_id ORDER BY block_ix) = 'paragraph' THEN 0 ELSE 1 END AS s FROM gold_blocks
    ), r AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY block_ix) AS run FROM f)
    SELECT doc_id, min(block_ix) AS block_ix, min(type) AS type, string_agg(text, ' ' ORDER BY block_ix) AS text FROM r GROUP BY doc_id, run""",
)

# -- alignment given pairs
Q["reading_order_tau"] = (
    lambda s, sf: alignment.reading_order_tau(_pairs(s, sf).select("doc_id", F.col("block_ix").alias("gold_ix"), "pred_ix"), ["doc_id"]).select("doc_id", F.round("tau", 6).alias("tau")),
    f"""WITH {PAIRS}, x AS (
      SELECT a.doc_id, sum(sign(b.pred_ix - a.pred_ix)) AS s, count(*) AS n FROM pairs a JOIN pairs b ON a.doc_id = b.doc_id AND a.block_ix < b.block_ix GROUP BY 1)
    SELECT d.doc_id, round(coalesce((s::DOUBLE / n + 1) / 2, 1.0), 6) AS tau FROM (SELECT DISTINCT doc_id FROM pairs) d LEFT JOIN x USING (doc_id)""",
)
Q["textless_pairing"] = (
    lambda s, sf: alignment.pair_textless(_pairs(s, sf).where("text IS NULL").withColumnRenamed("block_ix", "ix").select("doc_id", "kind", "ix"), _pairs(s, sf).where("text IS NULL").select("doc_id", "kind", F.col("pred_ix").alias("ix")), ["doc_id"]),
    f"""WITH {PAIRS}, f AS (SELECT doc_id, block_ix, pred_ix FROM pairs WHERE text IS NULL),
    g AS (SELECT doc_id, block_ix AS gold_ix, row_number() OVER (PARTITION BY doc_id ORDER BY block_ix) AS k FROM f),
    p AS (SELECT doc_id, pred_ix, row_number() OVER (PARTITION BY doc_id ORDER BY pred_ix) AS k FROM f)
    SELECT doc_id, gold_ix, pred_ix FROM g JOIN p USING (doc_id, k)""",
)
Q["aligned_text"] = (
    lambda s, sf: _pairs(s, sf).where("kind <> 'furniture' AND text <> ''").groupBy("doc_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_ix", "text"))), lambda x: x["text"]), " ")).alias("gold_md5"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pred_ix", "text"))), lambda x: x["text"]), " ")).alias("pred_md5")),
    f"WITH {PAIRS} SELECT doc_id, md5(string_agg(text, ' ' ORDER BY block_ix)) AS gold_md5, md5(string_agg(text, ' ' ORDER BY pred_ix)) AS pred_md5 FROM pairs WHERE type <> 'footer' AND text <> '' GROUP BY 1",
)


def _structure(s, sf):
    b = _pairs(s, sf)
    gold = b.select("doc_id", F.col("block_ix").alias("ix"), "type", "kind")
    pred = b.where("text <> ''").select("doc_id", F.col("pred_ix").alias("ix"), F.lit("paragraph").alias("type"), F.lit("text").alias("kind"))
    pairs = b.where("text <> ''").select("doc_id", F.col("block_ix").alias("gold_ix"), "pred_ix")
    body = b.where("text <> '' AND kind <> 'furniture'").select("doc_id", F.col("block_ix").alias("gold_ix"), "pred_ix")
    out = tracks.structure_track(gold, pred, pairs, alignment.reading_order_tau(body, ["doc_id"]), ["doc_id"])
    return out.select("doc_id", *[F.round(c, 6).alias(c) for c in ("block_precision", "block_recall", "block_f1", "type_strict", "type_coarse", "tau", "score")], "spurious")


Q["structure_track"] = (
    _structure,
    f"""WITH {PAIRS}, c AS (
      SELECT doc_id, count(*) FILTER (type <> 'footer') AS ng, count(*) FILTER (type <> 'footer' AND text <> '') AS np, count(*) FILTER (type <> 'footer' AND text <> '') AS tp, count(*) FILTER (type = 'paragraph' AND text <> '') AS ok FROM pairs GROUP BY 1
    ), body AS (SELECT * FROM pairs WHERE type <> 'footer' AND text <> ''), x AS (
      SELECT a.doc_id, (sum(sign(b.pred_ix - a.pred_ix))::DOUBLE / count(*) + 1) / 2 AS tau FROM body a JOIN body b ON a.doc_id = b.doc_id AND a.block_ix < b.block_ix GROUP BY 1
    ), m AS (SELECT doc_id, CASE WHEN np > 0 THEN tp / np WHEN ng = 0 THEN 1.0 ELSE 0.0 END AS p, CASE WHEN ng > 0 THEN tp / ng ELSE 1.0 END AS r, CASE WHEN tp > 0 THEN ok / tp ELSE 0.0 END AS t, coalesce(tau, 1.0) AS tau FROM c LEFT JOIN x USING (doc_id)
    ), f AS (SELECT *, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f1 FROM m)
    SELECT doc_id, round(p, 6) AS block_precision, round(r, 6) AS block_recall, round(f1, 6) AS block_f1, round(t, 6) AS type_strict, round(t, 6) AS type_coarse, round(tau, 6) AS tau, round((f1 + t + tau) / 3, 6) AS score, 0::BIGINT AS spurious FROM f""",
)
Q["furniture_track"] = (
    lambda s, sf: tracks.furniture_track(_pairs(s, sf).select("doc_id", F.col("block_ix").alias("ix"), "kind"), _pairs(s, sf).where("block_ix % 2 = 0").select("doc_id", F.col("block_ix").alias("gold_ix"), "pred_ix"), ["doc_id"]),
    f"WITH {BLOCKS} SELECT doc_id, count(*) AS n_gold, count(*) FILTER (block_ix % 2 = 0) AS n_found, count(*) FILTER (block_ix % 2 = 0) / count(*) AS score FROM gold_blocks WHERE type = 'footer' GROUP BY 1",
)
Q["type_accuracy"] = (
    lambda s, sf: gold_blocks(s, sf).withColumn("pt", F.when(F.col("block_ix") % 3 == 0, "title").otherwise(F.col("type"))).groupBy("doc_id").agg(F.round(F.avg((F.col("type") == F.col("pt")).cast("int")), 6).alias("strict"), F.round(F.avg((F.coalesce(coarse(F.col("type")), F.col("type")) == F.coalesce(coarse(F.col("pt")), F.col("pt"))).cast("int")), 6).alias("coarse")),
    f"""WITH {BLOCKS}, {COARSE_SQL}, b AS (SELECT *, CASE WHEN block_ix % 3 = 0 THEN 'title' ELSE type END AS pt FROM gold_blocks)
    SELECT doc_id, round(avg((b.type = pt)::INT), 6) AS strict, round(avg((coalesce(g.kind, b.type) = coalesce(p.kind, pt))::INT), 6) AS coarse FROM b LEFT JOIN coarse g ON g.type = b.type LEFT JOIN coarse p ON p.type = pt GROUP BY doc_id""",
)

# -- layout
Q["union_bbox"] = (lambda s, sf: layout.union_bbox(gold_blocks(s, sf), ["doc_id", "type"]), f"WITH {BLOCKS} SELECT doc_id, type, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM gold_blocks GROUP BY 1, 2")
Q["y_sort"] = (lambda s, sf: y_sorted(gold_blocks(s, sf)).select("doc_id", "pred_ix", "type"), f"WITH {PAIRS} SELECT doc_id, pred_ix, type FROM pairs")
Q["bbox_flip"] = (lambda s, sf: gold_blocks(s, sf).select("doc_id", "block_ix", F.round(800 - F.greatest("y0", "y1"), 1).alias("y0"), F.round(800 - F.least("y0", "y1"), 1).alias("y1")), f"WITH {BLOCKS} SELECT doc_id, block_ix, 800 - greatest(y0, y1) AS y0, 800 - least(y0, y1) AS y1 FROM gold_blocks")


def _lists(s, sf, anti):
    b = gold_blocks(s, sf)
    area = b.where("type = 'list'").select("doc_id", F.col("block_ix").alias("area_ix"), "x0", "y0", "x1", (F.col("y1") + 24).alias("y1")).alias("o")
    on = (F.col("i.doc_id") == F.col("o.doc_id")) & layout.inside("i", "o", 2.0)
    if anti:
        return b.alias("i").join(area, on, "left_anti").select("doc_id", "block_ix")
    return b.alias("i").join(area, on).select("i.doc_id", "i.block_ix", "o.area_ix")


_AREA = f"WITH {BLOCKS}, area AS (SELECT doc_id, block_ix AS area_ix, x0, y0, x1, y1 + 24 AS y1 FROM gold_blocks WHERE type = 'list')"
_IN = "b.doc_id = a.doc_id AND b.x0 >= a.x0 - 2 AND b.y0 >= a.y0 - 2 AND b.x1 <= a.x1 + 2 AND b.y1 <= a.y1 + 2"
Q["bbox_contains_join"] = (lambda s, sf: _lists(s, sf, False), f"{_AREA} SELECT b.doc_id, b.block_ix, a.area_ix FROM gold_blocks b JOIN area a ON {_IN}")
Q["lines_outside_tables"] = (lambda s, sf: _lists(s, sf, True), f"{_AREA} SELECT b.doc_id, b.block_ix FROM gold_blocks b WHERE NOT EXISTS (SELECT 1 FROM area a WHERE {_IN})")
_SIZE = "8.0 + (length(coalesce(text, '')) % 7)"
Q["classify_lines"] = (
    lambda s, sf: gold_blocks(s, sf).where("text IS NOT NULL").withColumn("size", 8.0 + F.length("text") % 7).select("doc_id", "block_ix", layout.classify_lines(F.col("y0"), F.col("size"), F.col("block_ix") % 5 == 0, F.length("text"), F.lit(9.0), F.lit(120.0)).alias("kind")),
    f"WITH {BLOCKS} SELECT doc_id, block_ix, CASE WHEN y0 > 120 * 0.9 OR y0 < 120 * 0.04 THEN CASE WHEN y0 > 60 THEN 'footer' ELSE 'header' END WHEN {_SIZE} >= 9.0 * 1.45 THEN 'title' WHEN {_SIZE} >= 9.0 * 1.12 OR (block_ix % 5 = 0 AND length(text) < 90) THEN 'heading' ELSE 'paragraph' END AS kind FROM gold_blocks WHERE text IS NOT NULL",
)
Q["body_size"] = (
    lambda s, sf: layout.body_size(gold_blocks(s, sf).where("text IS NOT NULL").withColumn("size", 8.0 + F.length("text") % 7), ["doc_id"], "size", "text"),
    f"WITH {BLOCKS}, c AS (SELECT doc_id, {_SIZE} AS s, sum(length(text)) AS n FROM gold_blocks WHERE text IS NOT NULL GROUP BY 1, 2) SELECT doc_id, s::DOUBLE AS body_size FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, s) AS k FROM c) WHERE k = 1",
)
Q["group_paragraphs"] = (lambda s, sf: layout.group_paragraphs(gold_blocks(s, sf).where("text IS NOT NULL").select("doc_id", F.col("block_ix").alias("ix"), F.col("type").alias("kind"), F.lit(9.0).alias("base"), "text", "x0", "y0", "x1", "y1"), ["doc_id"]), None)


def _islands(s, sf):
    w = Window.partitionBy("doc_id").orderBy("block_ix")
    b = gold_blocks(s, sf).where("text IS NOT NULL")
    prev = F.lag("type").over(w)
    out = layout.islands(b, ["doc_id"], ["block_ix"], ~((F.col("type") == "paragraph") & (prev == "paragraph")), "island")
    return out.groupBy("doc_id", "island").agg(F.min("block_ix").alias("first"), F.count("*").alias("n"))


Q["paragraph_islands"] = (
    _islands,
    f"""WITH {BLOCKS}, f AS (SELECT *, CASE WHEN type = 'paragraph' AND lag(type) OVER (PARTITION BY doc_id ORDER BY block_ix) = 'paragraph' THEN 0 ELSE 1 END AS s FROM gold_blocks WHERE text IS NOT NULL),
    r AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY block_ix) - 1 AS island FROM f)
    SELECT doc_id, island::BIGINT AS island, min(block_ix) AS first, count(*) AS n FROM r GROUP BY 1, 2""",
)
Q["join_lines"] = (
    lambda s, sf: gold_blocks(s, sf).where("text IS NOT NULL").groupBy("doc_id", F.expr("block_ix div 4").alias("g")).agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_ix", "text"))), lambda x: x["text"]), " ")).alias("digest"), F.min("x0").alias("x0"), F.max("y1").alias("y1")),
    f"WITH {BLOCKS} SELECT doc_id, block_ix // 4 AS g, md5(string_agg(text, ' ' ORDER BY block_ix)) AS digest, min(x0) AS x0, max(y1) AS y1 FROM gold_blocks WHERE text IS NOT NULL GROUP BY 1, 2",
)
Q["furniture_insert"] = (lambda s, sf: layout.insert_by_top(gold_blocks(s, sf).where("type <> 'footer'").select("doc_id", F.col("block_ix").alias("ix"), "y0"), gold_blocks(s, sf).where("type = 'footer'").select("doc_id", F.col("block_ix").alias("ix"), (F.col("y0") / 2).alias("y0")), ["doc_id"]), None)
Q["merge_list_runs"] = (
    lambda s, sf: layout.islands(gold_blocks(s, sf).withColumn("li", F.col("block_ix") % 7 >= 5), ["doc_id"], ["block_ix"], ~(F.col("li") & F.lag("li").over(Window.partitionBy("doc_id").orderBy("block_ix"))), "run").where("li").groupBy("doc_id", "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_ix", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n").alias("text"), F.min("y0").alias("y0"), F.max("y1").alias("y1")),
    f"""WITH {BLOCKS}, l AS (SELECT *, block_ix % 7 >= 5 AS li FROM gold_blocks), f AS (SELECT *, CASE WHEN li AND lag(li) OVER (PARTITION BY doc_id ORDER BY block_ix) THEN 0 ELSE 1 END AS s FROM l),
    r AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY block_ix) - 1 AS run FROM f)
    SELECT doc_id, run::BIGINT AS run, string_agg(coalesce(text, ''), chr(10) ORDER BY block_ix) AS text, min(y0) AS y0, max(y1) AS y1 FROM r WHERE li GROUP BY 1, 2""",
)
Q["block_ids"] = (lambda s, sf: gold_blocks(s, sf).select("doc_id", F.format_string("p%d.b%02d", "doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("block_ix"))).alias("id"), (F.col("block_ix") + 1).alias("reading_order")), f"WITH {BLOCKS} SELECT doc_id, format('p{{}}.b{{:02d}}', doc_id, block_ix + 1) AS id, block_ix + 1 AS reading_order FROM gold_blocks")


def noisy_pages(s, sf):
    """doc_id, g_ix, g, p_ix, p: each document's blocks that have a text, as they are and with the noise of `noisy`, in one row."""
    texts = read(s, sf, "documents").where("text IS NOT NULL").select("doc_id", "text").repartition("doc_id")  # a file's pages are work for many tasks
    lines = texts.select("doc_id", F.split("text", "\n").alias("lines"))
    blocks = F.filter(F.transform("lines", lambda x, k: F.struct(k.cast("long").alias("ix"), x.alias("text"), line_type(k, F.size("lines")).alias("type"))), lambda b: (b["type"] != "figure") & (b["text"] != ""))
    pages = lines.select("doc_id", F.inline(F.array(F.struct(blocks.alias("blocks"))))).where("size(blocks) > 0")
    pages = pages.select("doc_id", F.inline(F.array(F.struct(F.col("blocks.ix").alias("g_ix"), F.col("blocks.text").alias("g"), F.transform("blocks", lambda b: degrade.noise_seed(F.concat_ws("|", F.col("doc_id"), b["ix"]))).alias("seeds")))))
    return pages.select("doc_id", "g_ix", "g", F.col("g_ix").alias("p_ix"), degrade.noisy_texts("g", "seeds").alias("p"))


Q["block_assignment"] = (lambda s, sf: alignment.assign_pages(noisy_pages(s, sf), ["doc_id"], normalize=t.plain), None)
