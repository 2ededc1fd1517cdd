"""Texts shorter than a license of which they hold most."""

import random
import re

from test_corpus_operators import ALNUM_WORD, lower

from foliometer.llm import licenses


def shingles(text):
    w = re.findall(ALNUM_WORD, lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_shortened_license_alone_in_a_partition(spark):
    # each text by itself in a partition, then all in one: what is found must not depend on it
    rows, want = [], set()
    for i, (name, text) in enumerate(licenses.TEMPLATES.items()):
        words = text.split()
        if len(words) > 30:
            rows += [(2 * i, " ".join(words[: int(0.93 * len(words))])), (2 * i + 1, " ".join(words[2:]))]
            own = shingles(text)
            want |= {(d, name) for d, t in rows[-2:] if len(shingles(t) & own) >= 0.8 * len(own)}
    assert len(want) > 8
    rows += [(100, ""), (101, None), (102, "one"), (103, "a b c d e f")]
    got = []
    for parts in (len(rows), 1):
        docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "doc_id long, text string")
        got.append({tuple(r) for r in licenses.scan(docs).collect()})
    assert got[0] == got[1] and want <= {r[:2] for r in got[0]}


def brute(rows, containment=0.8):
    """For each text and template the largest share of the template's shingles in a stretch of its length and a stride to either side."""
    out = set()
    for d, text in rows:
        w = re.findall(ALNUM_WORD, lower(text))
        for t in (licenses.Template(k, v, containment, 2, 0.9999) for k, v in licenses.TEMPLATES.items()):
            own = [tuple(x.encode() for x in w[i : i + t.k]) for i in range(len(w) - t.k + 1)]
            size = t.size + 2 * t.stride
            best = max((len(set(own[i : i + size]) & t.shingles) for i in range(max(len(own) - size, 0) + 1)), default=0)
            if best >= containment * len(t.shingles):
                out.add((d, t.name))
    return out


def test_many_texts_alone_and_together(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(60):
        text = rnd.choice(list(licenses.TEMPLATES.values())).split()
        for _ in range(rnd.randrange(0, 4)):
            text[rnd.randrange(len(text))] = "changed"
        noise = lambda: [f"n{rnd.randrange(300)}" for _ in range(rnd.randrange(0, 40))]
        rows.append((i, " ".join(noise() + text[: rnd.randrange(max(len(text) * 3 // 4, 1), len(text)) + 1] + noise())))
    got = []
    for parts in (60, 7, 1):
        docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "doc_id long, text string")
        got.append({(r["doc_id"], r["license"]) for r in licenses.scan(docs).collect()})
    assert got[0] == got[1] == got[2] and got[0] <= brute(rows)
    # what is left out gives way to another match of the same text
    assert {d for d, _ in got[0]} == {d for d, _ in brute(rows)}


def test_the_most_specific_license_is_told(spark):
    known = licenses.TEMPLATES
    rows = [(i, known[n]) for i, n in enumerate(["BSD-3-Clause", "BSD-2-Clause", "GPL-3.0 header", "GPL-2.0 header", "AGPL-3.0 header", "LGPL-2.1 header", "Apache-2.0 header", "MIT"])]
    rows += [(20, known["BSD-2-Clause"] + " and then " + known["MIT"])]
    got = sorted((r["doc_id"], r["license"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, "BSD-3-Clause"), (1, "BSD-2-Clause"), (2, "GPL-3.0 header"), (3, "GPL-2.0 header"), (4, "AGPL-3.0 header"), (5, "LGPL-2.1 header"), (6, "Apache-2.0 header"), (7, "MIT"), (20, "BSD-2-Clause"), (20, "MIT")]
