"""Each operator against a brute-force version, on odd and ordinary texts and on empty tables."""

import base64
import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from foliometer.llm import decontaminate, kneser_ney, licenses, packing, shards, simhash, substrings, toxicity, vafile, warc
from foliometer.llm.recompress import parse
from foliometer.llm.words import ALNUM, SPACED, Words, windows

SPACE_WORD, ALNUM_WORD = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MIN = -(1 << 63)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.mark.parametrize("kind,pattern", [(SPACED, SPACE_WORD), (ALNUM, ALNUM_WORD)])
def test_words(texts, kind, pattern):
    w = Words(pa.array(texts), kind, lower=True)
    got = [[w.text(k).decode() for k in range(a, b)] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    assert got == [re.findall(pattern, lower(t)) for t in texts]
    seen = {}
    for k in range(len(w)):
        assert seen.setdefault(w.text(k), w.hash[k]) == w.hash[k]
    assert len(set(seen.values())) == len(seen)
    assert w.joined()[0].decode() == "".join(x + " " for d in got for x in d)


def test_windows_depend_on_their_words_only():
    h = np.random.default_rng(1).integers(0, 1 << 62, 200).astype(np.uint64)
    h[100:150] = h[20:70]
    for k in (1, 2, 3, 7, 20, 50):
        w = windows(h, k)
        assert len(w) == 201 - k and (w[100 : 151 - k] == w[20 : 71 - k]).all() and len(set(w.tolist())) == len(w) - (51 - k)


def test_recompression_names_equal_stretches_alike():
    rng = np.random.default_rng(2)
    shared = np.repeat(rng.integers(0, 50, 40), rng.integers(1, 3, 40)).astype(np.uint64)
    a, b = (np.concatenate((rng.integers(0, 50, 30), shared, rng.integers(0, 50, 30))).astype(np.uint64) for _ in range(2))
    for rounds in range(6):
        inner = []
        for x in (a, b):
            p = parse(x, np.zeros(len(x), np.int64), rounds)
            ok = (p.need_lo >= 30) & (p.need_hi <= 30 + len(shared))
            inner.append(list(zip(p.name[ok].tolist(), p.need_lo[ok].tolist(), strict=True)))
        assert inner[0] == inner[1] and inner[0]


def test_op1_packing(docs, pairs, nothing):
    from tokenizers import Tokenizer

    path = packing.public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    for window, units in ((4096, 128), (64, 16)):
        rows = packing.pack_documents(docs, path, 2, window=window, units=units, keep_ids=True).collect()
        texts = Counter((d, tuple(whole.encode(t or "", add_special_tokens=False).ids + [2])) for d, t in pairs)
        assert {d for d, _ in texts} == {r["doc_id"] for r in rows}
        for (d, ids), n in texts.items():
            assert n == 1
            own = sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["start"])
            assert [r["start"] for r in own] == [0, *itertools.accumulate(r["length"] for r in own)][:-1] and sum(r["length"] for r in own) == len(ids)
            for r in own:
                raw = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
                assert r["ids_crc32"] == zlib.crc32(raw) and bytes(r["ids"]) == raw and r["doc_tokens"] == len(ids)
        sequences = defaultdict(list)
        for r in rows:
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        for x in sequences.values():
            x.sort()
            total = sum(n for _, n in x)
            assert [o for o, _ in x] == [0, *itertools.accumulate(n for _, n in x)][:-1] and total <= window
            assert total & (total - 1) == 0  # a full window or a power of two: no padding
    assert packing.pack_documents(nothing, path, 2).count() == 0


def test_op1_plan_uses_what_is_there():
    rng = np.random.default_rng(0)
    histogram = {int(k): int(n) for k, n in zip(range(1, 128), rng.integers(0, 400, 127), strict=True)}
    rows, sequences = packing.plan(histogram, 128, 3)
    used, filled = Counter(), Counter()
    for k, a, b, base, _ in rows:
        assert a == used[k]
        used[k] = b
        for s in range(base, base + b - a):
            filled[s] += k
    assert all(used[k] <= histogram[k] for k in used) and set(filled.values()) == {128} and len(filled) == sequences
    assert sum(used.values()) > 0.8 * sum(histogram.values())
    a, b = rng.random((6, 9)), rng.random(6)
    x = packing.nnls(a, b)
    gain = a.T @ (b - a @ x)
    assert (x >= 0).all() and gain.max() < 1e-7 and np.abs(gain[x > 0]).max() < 1e-7


def test_op1_greedy_fills_sequences_with_what_is_there():
    rng = np.random.default_rng(3)
    for histogram in ({int(k): int(n) for k, n in zip(rng.permutation(63)[:40] + 1, rng.integers(1, 50, 40), strict=True)}, {63: 500}, {1: 10_000_000_000, 60: 7}, {}):
        rows, sequences = packing.greedy(dict(histogram), 64)
        used, tokens = Counter(), 0
        for k, a, b, each, first, offset, taken in rows:
            assert a == used[k] and (b - a) % each == 0 and offset + (each - 1) * k + taken <= 64 and (each == 1 or taken == k)
            used[k] = b
            tokens += (b - a) * taken
        assert all(used[k] <= n for k, n in histogram.items()) and tokens == 64 * sequences and len(rows) < 1000
        assert sum((n - used[k]) * k for k, n in histogram.items()) < 64  # what is left does not fill one more
        if sum(histogram.values()) < 10_000:
            places = sorted((first + i // each, offset + i % each * k, taken) for k, a, b, each, first, offset, taken in rows for i in range(b - a))
            for number, pieces in itertools.groupby(places, key=lambda x: x[0]):
                pieces = list(pieces)
                assert [o for _, o, _ in pieces] == [0, *itertools.accumulate(t for _, _, t in pieces)][:-1] and sum(t for _, _, t in pieces) == 64


def test_op1_words_of_one_hash_are_told_apart(monkeypatch):
    encode = packing.WordEncoder(packing.public_tokenizers.path("word_bpe_49k.json"))
    text = pa.array(["one two three two antidisestablishment antidisestablishing one", "two one"])
    want = [x.tolist() for x in encode(text, 2)]
    monkeypatch.setattr(packing.Words, "hash", property(lambda self: np.full(len(self), 5, np.uint64)))
    encode._clear()
    for _ in range(2):
        assert [x.tolist() for x in encode(text, 2)] == want


def test_op2_shards(docs, pairs, nothing, spark):
    doubled = docs.union(docs)
    rows = shards.assign(doubled, buckets=4).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == sorted((str(d), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in pairs * 2)
    slots, place = defaultdict(list), {}
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert place.setdefault(r["doc_id"], (r["shard"], r["grown_shard"])) == (r["shard"], r["grown_shard"])
        assert r["grown_shard"] in (r["shard"], 40) and 0 <= r["shard"] < 40
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    many = spark.range(40000).select(F.col("id").alias("doc_id"), *[shards.shard_of(F.col("id"), shards.layout(n)).alias(f"s{n}") for n in (40, 41, 42)])
    got = np.array(many.select("s40", "s41", "s42").collect())
    assert ((got[:, 1] == got[:, 0]) | (got[:, 1] == 40)).all() and ((got[:, 2] == got[:, 1]) | (got[:, 2] == 41)).all()
    assert np.abs(np.bincount(got[:, 0], minlength=40) - 1000).max() < 160 and 800 < (got[:, 1] == 40).sum() < 1150
    # more weight for one shard: below nodes whose weight stays nothing moves
    tree = {r: {k: dict(s) for k, s in racks.items()} for r, racks in shards.layout(40).items()}
    tree["region 1"]["region 1 rack 0"][10] = 3.0
    both = np.array(many.select("s40", shards.shard_of(F.col("doc_id"), tree).alias("b")).collect())
    moved = both[both[:, 0] != both[:, 1]]
    assert len(moved) and (moved[:, 1] // 10 == 1).all()
    assert shards.assign(nothing).count() == 0


def test_op3_licenses(spark, docs, nothing):
    mit = licenses.TEMPLATES["MIT"]
    changed = mit.replace("Permission is", "Consent is").replace("publish, ", "")
    half = " ".join(mit.split()[:40])
    rows = [(1, f"x y {mit} z"), (2, changed), (3, half), (4, "Released under the MIT License."), (5, None), (6, ""), (7, "This work is licensed under the GNU General Public License, version 3." * 2)]
    got = {(r["doc_id"], r["license"]): (r["containment"], r["first_word"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1, "MIT"] == (1.0, 2) and 0.8 <= got[2, "MIT"][0] < 1 and (3, "MIT") not in got and (4, "MIT notice") in got and (7, "GPL-3.0 notice") in got
    assert [r["license"] for r in licenses.scan(docs).collect()] == ["Apache-2.0 notice"] and licenses.scan(nothing).count() == 0


def test_op3_windows_find_what_brute_force_finds():
    rnd = np.random.default_rng(4)
    template = " ".join(f"w{i}" for i in range(60))
    t = licenses.Template("t", template, 0.8, 1, 0.9999)
    for trial in range(40):
        tokens = template.split()
        for i in rnd.choice(60, rnd.integers(0, 4), replace=False):
            tokens[i] = "other"
        text = " ".join([f"a{i}" for i in range(trial)] + tokens + [f"b{i}" for i in range(17)])
        words = text.encode().split()
        share = len({tuple(words[i : i + 5]) for i in range(len(words) - 4)} & t.shingles) / len(t.shingles)
        found = licenses.find_licenses(Words(pa.array([text]), ALNUM, lower=True), [t], 0.8)
        assert bool(found) == (share >= 0.8)


def test_op4_warc(spark):
    html = "<p>" + "words of a page " * 50
    rows = [(1, "u", html), (2, None, html), (3, "u", None), (4, "u", ""), (5, "u", "ü\r\n\r\nx"), (None, "u", html), (7, "u", html), (7, "u", html), (8, "line\r\nbreak", "y" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for least in (0, 10):
        manifest = warc.write_archives(pages, least_bytes=least, train_bytes=1 << 16)
        got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_archives(manifest).collect()), key=str)
        raw = [(p, (h or "").encode()) for p, _, h in rows]
        largest = {}
        for p, b in raw:
            if len(b) >= least:
                largest[b] = max(largest.get(b, MIN), MIN if p is None else p)
        want = []
        for p, b in raw:
            top = largest.get(b, MIN if p is None else p)
            same = (MIN if p is None else p) == top
            want.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if same else "revisit", None if same else top))
        assert got == sorted(want, key=str)
        payloads = [bytes(r["payload"]) for r in warc.read_archives(manifest, keep_payload=True).where("record_type = 'response'").collect()]
        assert set(payloads) == {b for _, b in raw}
    for path in (r["path"] for r in manifest.collect()):
        assert open(path, "rb").read(4) == b"\x5d\x2a\x4d\x18"
    assert warc.read_archives(warc.write_archives(pages.where("false"))).count() == 0


def test_op4_every_archive_has_a_dictionary(spark):
    pages = spark.createDataFrame([(i, "u", f"<p>page {i} " + "alike " * 20) for i in range(5)], "page_id long, url string, html string").repartition(3)
    manifest = warc.write_archives(pages).collect()
    assert manifest and all(int.from_bytes(open(r["path"], "rb").read(8)[4:], "little") > 0 for r in manifest)


def test_missing_files_are_an_error(tmp_path):
    files = warc.SortedFiles(str(tmp_path), "x", 4, ["key", "value"])
    keys = np.array([1, 5, 1 << 63], dtype=np.uint64)
    files.write(0, key=keys[:2], value=np.array([7, 8]))
    files.seal([0])
    there, value = files.find(keys, (0,))
    assert there.tolist() == [True, True, False] and value.tolist() == [7, 8, 0]
    files.seal([0, 2])
    with pytest.raises(FileNotFoundError):
        files.find(keys, (0,))


def test_op5_vafile(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 8)).astype(np.float32)
    rows = [(int(i), [float(v) for v in x[i]]) for i in range(400)]
    rows += [(20, rows[3][1]), (400, None), (401, [1.0, None] + [0.0] * 6), (402, [math.nan] * 8), (403, [math.inf] * 8), (404, [1.0, 2.0]), (405, []), (None, rows[5][1]), (410, rows[7][1]), (411, rows[7][1]), (440, [1e30] * 8)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    good = [(i, [max(min(math.floor(64 * np.float32(v).item()), 1 << 53), -(1 << 53)) for v in e]) for i, e in rows if e and all(v is not None and math.isfinite(v) for v in e)]
    want = []
    for qi, q in good:
        if qi is not None and qi % 20 == 0:
            found = [(-min(max(sum(a * b for a, b in zip(q, e, strict=True)), -(1 << 63)), (1 << 63) - 1), (1 << 63) if i is None else i, i) for i, e in good if i != qi and len(e) == len(q)]
            want += [(qi, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(found, key=lambda f: f[:2])[:20])]
    got = [tuple(r) for r in vafile.top_k(vectors, F.col("vec_id") % 20 == 0, block_rows=64, query_rows=7).collect()]
    assert Counter(got) == Counter(want)
    assert vafile.top_k(vectors.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_op6_chain_against_a_plain_solver():
    rng = np.random.default_rng(8)
    n = 300
    x = rng.random((n, 6)) < 0.4
    figures = rng.random((n, 5))
    first = (x[:, 0] ^ (rng.random(n) < 0.1)).astype(float)
    labels = np.stack([first, (((first > 0) & x[:, 1]) ^ (rng.random(n) < 0.1)).astype(float)], axis=1)
    labels[:10, 0] = labels[5:20, 1] = np.nan
    folds = np.arange(n) % 5
    has = [np.flatnonzero(r) for r in x]
    chain = toxicity.Chain(["a", "b"]).fit([np.arange(6, dtype=np.uint64)] * 2, [has, has], figures, labels, folds, 0.3)

    def plain(rows, y):
        """The same objective by gradient steps with a line search."""
        a, w = np.concatenate((rows, np.ones((len(rows), 1))), axis=1), np.zeros(rows.shape[1] + 1)
        penalty = np.append(np.full(rows.shape[1], 0.3), 1e-6)
        loss = lambda v: np.logaddexp(0, a @ v).sum() - y @ (a @ v) + 0.5 * (penalty * v * v).sum()
        for _ in range(4000):
            slope = a.T @ (1 / (1 + np.exp(-a @ w)) - y) + penalty * w
            step = 1.0
            while loss(w - step * slope) > loss(w) - 0.5 * step * slope @ slope and step > 1e-12:
                step /= 2
            w = w - step * slope
        return w

    probability = lambda rows, w: 1 / (1 + np.exp(-(rows @ w[:-1] + w[-1])))
    base, known = np.concatenate((x, figures), axis=1).astype(float), ~np.isnan(labels)
    one = plain(base[known[:, 0]], labels[known[:, 0], 0])
    assert np.allclose(chain.models[0][1], one, atol=1e-3)
    # what the second model is trained with comes from models that have not seen the row
    passed = probability(base, one)
    for f in range(5):
        train = known[:, 0] & (folds != f)
        passed[folds == f] = probability(base[folds == f], plain(base[train], labels[train, 0]))
    logit = np.log(np.clip(passed, 1e-4, 1 - 1e-4) / (1 - np.clip(passed, 1e-4, 1 - 1e-4)))
    wide = np.concatenate((base, logit[:, None]), axis=1)
    assert np.allclose(chain.models[1][1], plain(wide[known[:, 1]], labels[known[:, 1], 1]), atol=2e-2)


def test_op6_chain(spark, nothing):
    rnd = np.random.default_rng(1)
    bad, rows, marks = ["grim", "vile", "nasty"], [], []
    for i in range(600):
        words = [f"w{rnd.integers(300)}" for _ in range(60)]
        toxic, shout = rnd.random() < 0.3, rnd.random() < 0.3
        if toxic:
            words[rnd.integers(60)] = bad[rnd.integers(3)]
        rows.append((i, (" ".join(words).upper() + "!!" if shout else " ".join(words)), "x"))
        marks.append((i, 0 if shout else 1, int(toxic)))
    rows += [(900, None, "x"), (901, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, p_toxic string")
    labels = spark.createDataFrame(marks[:400] + [(None, 1, 1), (5000, 1, None)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, labels, {"low": 1 - F.col("quality"), "toxic": F.col("toxic")})
    got = {r["doc_id"]: r for r in toxicity.score(docs, chain).collect()}
    test = marks[400:]
    assert np.mean([(got[i]["p_toxic"] >= 0.5) == bool(t) for i, _, t in test]) > 0.97 and np.mean([(got[i]["p_low"] >= 0.5) == (q == 0) for i, q, _ in test]) > 0.97
    assert 0 <= got[900]["p_toxic"] == got[901]["p_toxic"] <= 1
    empty = toxicity.train(docs, labels.where("false"), {"low": 1 - F.col("quality"), "toxic": F.col("toxic")})
    assert {r["p_toxic"] for r in toxicity.score(docs, empty).collect()} == {0.0} and toxicity.score(nothing, chain).count() == 0


def brute_model(sentences, order):
    """p(word | history), straight from the formula over Python dictionaries."""
    top = Counter(tuple(s[i : i + order]) for s in sentences for i in range(len(s) - order + 1))
    counts = {order: top}
    for m in range(order - 1, 0, -1):
        c = Counter(g[1:] for g in counts[m + 1])
        if m > 1:
            c.update(tuple(s[:m]) for s in sentences)
        counts[m] = c
    tokens = Counter(w for s in sentences for w in s[1:])
    model = {}
    for m, c in counts.items():
        d = kneser_ney._discounts(np.array([sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]))
        total, mass = defaultdict(int), defaultdict(float)
        for g, v in c.items():
            total[g[:-1]] += v
            mass[g[:-1]] += d[min(v, 3)]
        model[m] = (c, d, total, mass)

    def p(history, w):
        out = 1 / (len(tokens) + 1)
        for m in range(1, order + 1):
            c, d, total, mass = model[m]
            h = tuple(history[len(history) - m + 1 :]) if m > 1 else ()
            if len(h) == m - 1 and total.get(h):
                out = (max(c[(*h, w)] - d[min(c[(*h, w)], 3)], 0) + mass[h] * out) / total[h]
        return out

    return p, tokens


@pytest.mark.parametrize("order", [2, 3])
def test_op7_kneser_ney(docs, pairs, nothing, order):
    train = [["<s>", *re.findall(SPACE_WORD, lower(t)), "</s>"] for d, t in pairs if d is None or zlib.crc32(str(d).encode()) % 10]
    p, tokens = brute_model(train, order)
    n, v = sum(tokens.values()), len(tokens)
    model = kneser_ney.train(docs, order=order, bucket_bytes=1 << 14)
    assert (model.tokens, model.types) == (n, v)
    got = {r["doc_id"]: r for r in kneser_ney.perplexity(docs, model).collect()}
    for d, t in pairs:
        s = ["<s>", *re.findall(SPACE_WORD, lower(t)), "</s>"]
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (d is not None and zlib.crc32(str(d).encode()) % 10 == 0, len(s) - 1, sum(w in tokens for w in s[1:]), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((tokens[w] + 0.1) / (n + 0.1 * (v + 1))) for w in s[1:]), rel=1e-9)
        assert r["score"] == pytest.approx(sum(math.log10(p(s[:i], s[i])) for i in range(1, len(s))), rel=1e-6)
    history = train[5][:4]
    assert sum(p(history, w) for w in tokens) + p(history, "<unseen>") == pytest.approx(1)
    none = kneser_ney.train(nothing, order=order)
    assert {r["score"] for r in kneser_ney.perplexity(docs.where("text = 'one'"), none).collect()} == {0.0}
    assert kneser_ney.perplexity(nothing, model).count() == 0


def brute_repeats(pairs, window):
    places = {}
    for d, t in pairs:
        w = re.findall(SPACE_WORD, t or "")
        for i in range(len(w) - window + 1):
            key, at = tuple(w[i : i + window]), (MIN if d is None else d, i)
            places[key] = min(places.get(key, at), at)
    out = {}
    for d, t in pairs:
        w = re.findall(SPACE_WORD, t or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if places[tuple(w[i : i + window])] < (MIN if d is None else d, i):
                gone[i : i + window] = [True] * window
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("rounds", [1, 2, 4, 6])
def test_decompositions_are_equal_just_where_windows_are(rounds):
    rng = np.random.default_rng(rounds)
    words = rng.integers(0, 3, 600)
    words[200:300], words[420:450], words[500:540] = words[50:150], words[100:130], 1
    text = np.repeat([0, 1, 2], [180, 250, 170])
    names = np.array([11, 5 << 40, 77 << 20], dtype=np.uint64)[words]
    p = parse(names, text, rounds, names * np.uint64(0x9FB21C651E98DF25))
    for size in (2, 7, 20):
        starts = np.flatnonzero(text[: 601 - size] == text[size - 1 :])
        for got in p.decompositions(starts, size):
            told = defaultdict(set)
            for s, g in zip(starts, got.tolist(), strict=True):
                told[g].add(tuple(words[s : s + size]))
            assert all(len(v) == 1 for v in told.values()) and len(told) == len({tuple(words[s : s + size]) for s in starts})
    # two words of one first name are told apart by the second
    alike = parse(np.full(40, 9, np.uint64), np.zeros(40, np.int64), rounds, np.arange(40, dtype=np.uint64) ** 3)
    a, b = alike.decompositions(np.arange(21), 20)
    assert len(set(a.tolist())) == 1 and len(set(b.tolist())) == 21


def test_second_names_tell_words_apart(texts):
    w = Words(pa.array(texts), SPACED, lower=False)
    first, second = defaultdict(set), defaultdict(set)
    for k, (a, b) in enumerate(zip(w.hash.tolist(), w.second().tolist(), strict=True)):
        first[w.text(k)].add((a, b))
        second[b].add(w.text(k))
    assert all(len(v) == 1 for v in first.values()) and all(len(v) == 1 for v in second.values())


def test_op8_needs_rounds(docs):
    with pytest.raises(ValueError):
        substrings.remove_repeats(docs, rounds=0)


@pytest.mark.parametrize("window", [5, 20])
def test_op8_substrings(docs, pairs, nothing, window):
    want = brute_repeats(pairs, window)
    rows = substrings.remove_repeats(docs, window=window, rounds=2 if window == 5 else 4).collect()
    assert len(rows) == len(pairs) and sum(r["n_removed"] for r in rows) > 50
    for r in rows:
        n, gone, kept = want[r["doc_id"]]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())
        assert r["text"] == (kept if gone else dict(pairs)[r["doc_id"]]) and r["row_id"] == "mine"
    assert substrings.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("bound", [8 << 20, 400])
def test_op9_decontamination(spark, docs, pairs, nothing, bound):
    words = re.findall(ALNUM_WORD, lower(max((t or "" for _, t in pairs), key=len)))
    items = [(1, " ".join(words[50:75])), (2, "ONE"), (3, None), (4, ""), (5, " ".join(words[60:66])), (10, " ".join(words[500:512])), (1, "beta1 gamma2"), (None, " ".join(words[52:70])), (7, "no such words here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    grams = [(str("" if i is None else i), tuple(w[k : k + 10])) for i, t in items if (w := re.findall(ALNUM_WORD, lower(t))) for k in range(max(len(w) - 9, 1))]
    rows = {r["doc_id"]: r for r in decontaminate.scan(docs, bench, broadcast_bytes=bound, remove="spans").collect()}
    assert len(rows) == len(pairs) and sum(r["contaminated"] for r in rows.values()) >= 3
    for d, t in pairs:
        w = re.findall(ALNUM_WORD, lower(t))
        hit, found = set(), set()
        for item, g in grams:
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    found.add(item)
        r = rows[d]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
        assert re.findall(ALNUM_WORD, lower(r["text"])) == [x for i, x in enumerate(w) if i not in hit] and (hit or r["text"] == t)
    assert decontaminate.scan(docs, bench, remove="documents").count() == sum(not r["contaminated"] for r in rows.values())
    assert decontaminate.scan(nothing, bench).count() == 0 and decontaminate.scan(docs, bench.where("false")).where("contaminated").count() == 0


def brute_print(t, k=4):
    w = re.findall(SPACE_WORD, lower(t))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(len(w) - k + 1, 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op10_simhash(spark, docs, pairs, nothing):
    prints = {d: brute_print(t) for d, t in pairs}
    low = {d: d for d in prints}
    for _ in prints:
        for a, b in itertools.combinations(prints, 2):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                small = min(low[a], low[b], key=lambda x: (x is None, x))
                low[a] = low[b] = small
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert len(got) == len(pairs)
    for d in prints:
        assert got[d]["fp"] & (1 << 64) - 1 == prints[d] and got[d]["component_id"] == low[d]
    assert simhash.near_duplicates(nothing).count() == 0


def test_op10_range_join_loses_no_link():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, n, replace=False)) for b in base for n in range(7)]
    fp = np.unique(np.array(near + list(range(300)), dtype=np.uint64))
    for bits in (2, 4, 5):
        cell, owner = simhash.cells_of(fp, -(-(bits // 2) // 2))
        a, b = simhash.cell_links(cell, fp[owner], bits, tile=16)
        found, want = simhash.Links(len(fp)), simhash.Links(len(fp))
        found.add(np.searchsorted(fp, a), np.searchsorted(fp, b))
        want.add(*np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= bits))
        assert np.array_equal(found.label, want.label)


def test_op10_components(spark):
    rng = np.random.default_rng(6)
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, int(k)) for k in range(201, 260)] + [(int(a) + 400, int(b) + 400) for a, b in rng.integers(0, 60, (40, 2))]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == y for x, y in label.items())
