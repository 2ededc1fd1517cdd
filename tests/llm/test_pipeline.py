"""Each stage of the pipeline against brute force on what the stage before kept."""

import re
from collections import Counter, defaultdict

import pytest
from test_corpus_operators import ALNUM_WORD, brute_repeats, lower
from test_near_copies import kept_of
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from foliometer.llm import packing, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == columns
        kept[name] = ({r["doc_id"]: r["text"] for r in before.collect()}, docs.collect())
    before, after = kept["toxicity"]
    chain = toxicity.chain_of(spark, SF, spark.read.parquet(f"{SF}/documents.parquet"))
    bad = {r["doc_id"] for r in toxicity.score(spark.read.parquet(f"{SF}/documents.parquet"), chain).where("p_toxic >= 0.5").collect()}
    assert {r["doc_id"]: r["text"] for r in after} == {d: t for d, t in before.items() if d not in bad}
    before, after = kept["simhash"]
    # groups at a similarity of 0.8 of the sets of five-word shingles, by comparison of all pairs
    assert {r["doc_id"]: r["text"] for r in after} == {d: before[d] for d in kept_of(list(before.items()))} and len(after) < len(before)
    before, after = kept["substrings"]
    want = brute_repeats(list(before.items()), 20)
    assert {r["doc_id"]: r["text"] for r in after} == {d: (want[d][2] if want[d][1] else t) for d, t in before.items()}
    before, after = kept["benchmark"]
    items = [re.findall(ALNUM_WORD, lower(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(w[i : i + 10]) for w in items if w for i in range(max(len(w) - 9, 1))}
    for r in after:
        w, hit = re.findall(ALNUM_WORD, lower(before[r["doc_id"]])), set()
        for n in {len(g) for g in grams}:
            hit |= {k for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in grams for k in range(i, i + n)}
        assert re.findall(ALNUM_WORD, lower(r["text"])) == [x for i, x in enumerate(w) if i not in hit] and r["n_chars"] == len(r["text"])
    before, after = kept["packing"]
    whole, total = Tokenizer.from_file(packing.public_tokenizers.path("word_bpe_49k.json")), defaultdict(int)
    for r in after:
        total[r["doc_id"]] += r["length"]
    assert total == {d: len(whole.encode(t, add_special_tokens=False).ids) + 1 for d, t in before.items()}


def test_registry():
    known = __spark_entry__.queries()
    assert {re.match(r"op(\d+)_", n)[1] for n in known if n.startswith("op")} == {str(n) for n in range(1, 11)} and "pipeline" in known
    assert set(__spark_entry__.oracle_sql()) <= set(known)


CLASH = "doc_id long, text string, n_chars long, _n string, _h1 int, p_toxic string, n_words int, row_id string, others string"


def odd_rows(texts):
    """Null, empty and very long texts, copies, repeated rows and ids, and columns of names that operators use."""
    rows = [(None if i % 17 == 3 else i % 40, x, 0 if x is None else len(x), f"a{i}", i, "mine", 7, "r", None) for i, x in enumerate(texts)]
    return rows + rows[:3] + [(5, "another text of the same id", 27, None, None, None, None, None, None)]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_on_odd_rows(spark, texts, name, stage):
    rows = odd_rows(texts)
    docs = spark.createDataFrame(rows, CLASH).repartition(3)
    got = [tuple(r) for r in stage(spark, docs, SF).collect()]
    given = Counter(r[:1] + r[3:] for r in rows)
    assert not Counter(r[:1] + r[3:] for r in got) - given
    if name in ("substrings", "benchmark"):
        assert len(got) == len(rows) and all(r[2] == len(r[1]) if r[1] is not None else r[2] == 0 for r in got)
    else:
        assert not Counter(got) - Counter(rows)
    if name == "simhash":
        assert len(got) == len(set(got)) and sum(r[1] == "another text of the same id" for r in got) == 1
        assert sum(not (r[1] or "").split() for r in got) == 1  # those without words are one group
    assert stage(spark, docs.where("false"), SF).collect() == []


def test_packing_stage_on_odd_rows(spark, texts):
    rows = odd_rows(texts)
    got = corpus_pipeline.packing_stage(spark, spark.createDataFrame(rows, CLASH).repartition(3), SF).collect()
    whole = Tokenizer.from_file(packing.public_tokenizers.path("word_bpe_49k.json"))
    assert sum(r["length"] for r in got) == sum(len(whole.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    assert corpus_pipeline.packing_stage(spark, spark.createDataFrame([], CLASH), SF).collect() == []
