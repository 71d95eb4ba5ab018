"""Repeat removal against plain Python, at the production length, over a whole table."""

import hashlib
from collections import Counter

import pytest

from lakewarden.llm import repeats


def brute(texts, length):
    """{id: (bytes, removed, spans, SHA-256 of what is kept)}; every window of every text is counted by its 128-bit digest."""
    blobs = {i: (t or "").encode() for i, t in texts}
    digest = lambda b, i: hashlib.blake2b(b[i : i + length], digest_size=16).digest()
    count = Counter(digest(b, i) for b in blobs.values() for i in range(len(b) - length + 1))
    out = {}
    for k, b in blobs.items():
        runs = []
        for i in range(len(b) - length + 1):
            if count[digest(b, i)] > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + length
                else:
                    runs.append([i, i + length])
        rest = b"".join(b[x:y] for x, y in zip([0, *(e for _, e in runs)], [*(a for a, _ in runs), len(b)], strict=True))
        out[k] = (len(b), len(b) - len(rest), len(runs), hashlib.sha256(rest).hexdigest())
    return out


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_whole_documents(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], repeats.LENGTH)
    assert sum(w[1] > 0 for w in want.values()) > 50
    for group in (repeats.GROUP, 3):  # the second deals most anchors by another digit, in slices down to one window
        got = repeats.remove_repeats(docs, group=group).drop("spans", "kept").collect()
        assert {r["doc_id"]: tuple(r)[1:] for r in got} == want


def test_strings_that_deceive_polynomial_hashes(spark):
    """Thue-Morse words and their complements have one hash under every base modulo 2^64."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, "1" * 300 + word), (2, "2" * 300 + other), (3, "x " + word)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).drop("spans", "kept").collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == brute(rows, repeats.LENGTH)
