"""Scores of texts of any length and script, against brute force."""

from foliometer.plans import texts


def edits(a, b, swap):
    """Edit distance; swap is the price of a substitution."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (0 if x == y else swap))
    return row[-1]


def test_wer_and_indel_ratio_of_every_text(spark, monkeypatch):
    rows = [(1, 0, "größer als ß", "grosser als ß"), (1, 1, "日本 語 の", "日本 の"), (2, 0, "ab cd " * 90, "ab xd " * 90), (2, 1, "short", "shirt"), (3, 0, None, None)]
    blocks = spark.createDataFrame(rows, "doc_id long, block_ix long, text string, noisy string")
    monkeypatch.setattr(texts, "noisy", lambda s, sf: blocks)
    pairs = {(r["doc_id"], r["block_ix"]): (r["g"], r["p"]) for r in texts.text_pairs(spark, "").collect()}
    assert set(pairs) == {r[:2] for r in rows if r[2] is not None}
    wer = {(r[0], r[1]): r[2] for r in texts.Q["wer"][0](spark, "").collect()}
    assert wer == {k: round(edits(g.split(), p.split(), 1) / len(g.split()), 6) for k, (g, p) in pairs.items()}
    sim = {(r[0], r[1]): r[2] for r in texts.Q["indel_ratio"][0](spark, "").collect()}
    assert sim == {k: round(1 - edits(g, p, 2) / (len(g) + len(p)), 6) for k, (g, p) in pairs.items()}
