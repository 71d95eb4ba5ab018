import hashlib
import random
import re
import struct
from collections import Counter
from fractions import Fraction

import pytest

import corpus_pipeline
from lakewarden.llm import chat, exact_dedup, mixing, ngram_jaccard, quality_classifier, quality_rules, repeats, sentencepieces, url_filters, warc
from lakewarden.llm.graph import connected_components

TYPES = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = " ".join(f"word{i} and some more of it" for i in range(40))
DOCS = [
    (1, PROSE, "en", "a", 1), (2, PROSE, "en", "a", 1), (3, PROSE + " end", "en", None, 1), (4, None, None, "b", 1), (5, "", "en", "b", None), (None, PROSE, "en", "a", 1), (7, "x " * 3000, "de", "b", 1),
    (8, "ein kurzer Text", "de", None, 1), (8, "ein kurzer Text", "de", None, 1), (9, "Ünï▁code 𝄞 <|end|>", "fr", "c", 1), (10, " ".join(f"t{i}" for i in range(500)), "fr", "c", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, TYPES).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], TYPES)


def test_exact_dedup(docs, none):
    got = exact_dedup.exact_dedup(docs, salts=2).collect()
    assert len(got) == len(DOCS) and exact_dedup.exact_dedup(none).count() == 0
    texts = Counter(t or "" for _, t, *_ in DOCS)
    assert sum(r["kept"] for r in got) == len(texts)
    by = {}
    for i, t, *_ in DOCS:
        if i is not None:
            by[t or ""] = max(by.get(t or "", i), i)
    want = sorted(((i, by[t or ""], texts[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in DOCS), key=repr)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == want
    assert sorted(r["text"] or "" for r in exact_dedup.drop_copies(docs, broadcast_rows=0).collect()) == sorted(texts)


def test_mixing(docs, none):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(DOCS) and mixing.mix_sources(none).count() == 0
    assert all(r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0) for r in got)
    targets = {r["source_size"]: r["target"] for r in got}
    assert abs(sum(targets.values()) - sum(r["size"] for r in got)) < 1e-6 * sum(targets.values())
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix_sources(docs).collect()), key=repr)


def test_quality_rules(docs, none):
    got = quality_rules.quality_rules(docs, broadcast_rows=0).select("doc_id", "quality.*").collect()
    assert len(got) == len(DOCS) and quality_rules.quality_rules(none).count() == 0
    for r in got:
        w = re.findall(r"[^\x20\x09-\x0D]+", next(t or "" for i, t, *_ in DOCS if i == r["doc_id"]))
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        c, hit = Counter(grams), set()
        for i, g in enumerate(grams):
            if c[g] > 1:
                hit |= set(range(i, i + 8))
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(hit))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(hit) > 30 * len(w)) and not (r["base_failed"] and r["kept"])


def test_quality_has_its_own_name(docs):
    d = quality_rules.quality_rules(docs.withColumnRenamed("n_chars", "quality"))
    assert d.columns[-2:] == ["quality", "_quality"] and d.count() == len(DOCS)


def test_chat(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "ann", "hi <|x|>"), (1, 2, "bob", None), (1, 2, "bob", None), (2, None, None, "?"), (None, 0, "ann", "a"), (3, 0, "system", "only"), (4, 0, "e|>\nvil", "x")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["perspective"]): r for r in chat.rotate(d).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (2, "unknown"), (None, "ann"), (4, "e|>\nvil")} and {r["part"] for r in got.values()} == {0}
    r = got[1, "ann"]
    assert r["rendered"].startswith("<|system|>\ns<|end|>\n<|assistant|>\nhi <\u200b|x|><|end|>\n<|user name=bob|>")
    assert [r["rendered"][s["start"] : s["end"]] for s in r["spans"]] == ["hi <\u200b|x|><|end|>"] and r["n_turns"] == 4
    assert [got[1, "bob"]["rendered"][s["start"] : s["end"]] for s in got[1, "bob"]["spans"]] == ["<|end|>"] * 2
    assert chat.rotate(d.limit(0)).count() == 0
    parts = {(r["perspective"], r["part"]): r for r in chat.rotate(d.where("conv_id = 1"), turns_per_row=2).collect()}
    assert set(parts) == {("ann", 0), ("ann", 1), ("bob", 0), ("bob", 1)}
    assert parts["ann", 1]["n_train_chars"] == 0 and parts["bob", 1]["n_turns"] == 2 and parts["ann", 0]["rendered"] + parts["ann", 1]["rendered"] == r["rendered"]


def test_chat_renders_long_dialogues_whole(spark):
    rows = [(1, i, ("ann", "bob", "system")[i % 3], f"turn {i} <|") for i in range(900)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    for r in chat.rotate(d).collect():
        want, spans = "", []
        for _, _, who, text in rows:
            want += "<|assistant|>\n" if who == r["perspective"] else "<|system|>\n" if who == "system" else f"<|user name={who}|>\n"
            body = text.replace("<|", "<\u200b|") + "<|end|>"
            if who == r["perspective"]:
                spans.append((len(want), len(want) + len(body)))
            want += body + "\n"
        assert r["rendered"] == want and [tuple(x) for x in r["spans"]] == spans and r["n_turns"] == 900


def test_classifier(spark, docs, none):
    from pyspark.sql import functions as F

    x = [(i, " ".join(f"w{(i * 7 + j * j) % 97}" for j in range(60))) for i in range(60)] + [(100 + i, "### $$$ BUY!! NOW!! " * (5 + i % 5)) for i in range(20)]
    d = spark.createDataFrame(x, "doc_id long, text string")
    m = quality_classifier.fit(d, d.where("doc_id < 30").select("doc_id"))
    s = {r["doc_id"]: r["quality_score"] for r in quality_classifier.classify(d, m).collect()}
    assert min(s[i]["score"] for i in range(60)) > max(s[100 + i]["score"] for i in range(20)) and 0.5 < m.prior < 0.95
    assert all(0 <= r["s"] <= 1 for r in quality_classifier.classify(docs, m).select(F.col("quality_score.score").alias("s")).collect())
    assert quality_classifier.classify(none, quality_classifier.fit(none, none)).count() == 0
    assert quality_classifier.fit(d, d.limit(0)) == quality_classifier.fit(none, d) and m == quality_classifier.fit(d.repartition(5), d.where("doc_id < 30"))


def test_quality_fences_scale_with_the_values(spark):
    """No cutoff is fixed: ten times the values, ten times the fences, up to the sketch's own error; small groups go upward."""
    rows = [(lang, source, m, round((17 + i * 7919 % 83) * k), 3) for k, lang in ((1, "a"), (10, "b")) for source in ("s", "t") for m in quality_rules.METRICS for i in range(100)]
    rows += [("a", "tiny", m, 9999, 2) for m in quality_rules.METRICS]
    d = spark.createDataFrame(rows, "lang string, source string, metric string, v long, n long")
    sketch = d.select("lang", "source", "metric", quality_rules.bucket(d["v"]).alias("b"), "n").groupBy("lang", "source", "metric", "b").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")
    f = {(r["lang"], r["source"]): r for r in quality_rules.fences(sketch).collect()}
    for name in [c for c in f["a", "s"].asDict() if c not in ("lang", "source")]:
        assert abs(f["b", "s"][name] / f["a", "s"][name] / 10 - 1) < 0.3 and f["a", "s"][name] == f["a", "t"][name]
        assert abs(f["a", "tiny"][name] - f["a", "s"][name]) <= 0.1 * abs(f["a", "s"][name]) + 1
    whole = {tuple(r) for r in quality_rules.fences(quality_rules.merge_sketches(sketch.where("source = 's'"), sketch.where("source <> 's'"))).collect()}
    assert whole == {tuple(r) for r in f.values()} and quality_rules.fences(sketch.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    big = "<p>" + "payload " * 300
    rows = [(1, "http://a/ b\n", big), (2, None, big), (3, "http://c", "small"), (4, "http://d/%20x", "small"), (5, "http://e", None), (None, "http://f", big)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    m = warc.write_warc(d, f"file:{tmp_path}/w", broadcast_rows=0)
    got = {r["page_id"]: r for r in warc.read_warc(m).collect()}
    assert got[1]["url"] == "http://a/ b\n" and got[2]["url"] is None and got[4]["url"] == "http://d/%20x"
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None), None: ("revisit", 2)}
    assert all(r["ok"] for r in got.values()) and got[1]["payload_digest"] == hashlib.sha1(big.encode()).hexdigest() and bytes(got[2]["payload"]).decode() == big
    empty = warc.write_warc(d.limit(0), f"file:{tmp_path}/e")
    assert empty.count() == 0 and warc.read_warc(empty).count() == 0


def test_jaccard(spark, docs, none):
    got = ngram_jaccard.jaccard_classes(docs, 3, Fraction(9, 10), group=2, broadcast_rows=0).collect()
    assert len(got) == len(DOCS) and ngram_jaccard.jaccard_classes(none).count() == 0
    by = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in got}
    assert by[1, 236 if (1, 236) in by else next(n for i, n in by if i == 1)] == 1
    assert {i: c for (i, _), c in by.items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, None: 1, 7: 7, 8: 8, 9: 9, 10: 10}


def test_repeats(docs, none):
    got = repeats.remove_repeats(docs, length=40).collect()
    assert len(got) == len(DOCS) and repeats.remove_repeats(none).count() == 0
    blobs = [(t or "").encode() for _, t, *_ in DOCS]
    c = Counter(b[i : i + 40] for b in blobs for i in range(len(b) - 39))
    want = Counter()
    for b in blobs:
        gone = set()
        for i in range(len(b) - 39):
            if c[b[i : i + 40]] > 1:
                gone |= set(range(i, i + 40))
        want[len(b), len(gone), hashlib.sha256(bytes(x for i, x in enumerate(b) if i not in gone)).hexdigest()] += 1
    assert Counter((r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in got) == want
    hot = repeats.remove_repeats(docs, length=40, group=1).collect()
    assert Counter((r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in hot) == want


def test_sentencepieces(docs, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    got = sentencepieces.encode(docs, check=True).collect()
    assert len(got) == len(DOCS) and sentencepieces.encode(none).count() == 0
    for r in got:
        assert r["piece_ids"] == sp.encode(r["text"] or "") and r["piece_check"]["same"] == ("▁" not in (r["text"] or ""))
    back = sentencepieces.decode(sentencepieces.encode(docs)).collect()
    assert all(r["piece_text"] == (r["text"] or "").replace("▁", " ") for r in back)
    s = sentencepieces.Search(sentencepieces.Model(open(sentencepieces.MODEL, "rb").read()))
    long = "abcde" * 4000
    assert s.encode(long).tolist() == sp.encode(long) and s.widest <= 5 * s.m.longest + 3


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _unigram_model(pieces, byte_fallback):
    """A model file of the given (piece, score, kind), written by hand."""
    field = lambda n, data: _varint(n << 3 | 2) + _varint(len(data)) + data
    flag = lambda n, x: _varint(n << 3) + _varint(x)
    out = b"".join(field(1, field(1, p.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", s) + flag(3, k)) for p, s, k in pieces)
    trainer = flag(3, 1) + flag(35, int(byte_fallback)) + flag(40, 0) + flag(41, 1) + flag(42, 2)
    return out + field(2, trainer) + field(3, field(1, b"identity") + flag(3, 1) + flag(4, 0) + flag(5, 1))


@pytest.mark.parametrize("byte_fallback", [False, True])
def test_unigram(byte_fallback):
    import sentencepiece

    rnd = random.Random(5)
    words = {"".join(rnd.choice("abc\u2581") for _ in range(rnd.randrange(2, 9))) for _ in range(300)}
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", -20.0, 6) for i in range(256) if byte_fallback]
    pieces += [(w, round(-rnd.uniform(2, 12), 3), 1) for w in sorted(words | {"a", "b", "c", "\u2581"})]
    data = _unigram_model(pieces, byte_fallback)
    sp = sentencepiece.SentencePieceProcessor(model_proto=data)
    s = sentencepieces.Search(sentencepieces.Model(data))
    assert not s.m.bpe
    for n in [*range(60), 5000]:
        text = "".join(rnd.choice("aabbcc  d\u00e9") for _ in range(n))
        assert s.encode(text).tolist() == sp.encode(text)
    assert s.widest <= 5 * s.m.longest + 3  # one stretch of 5000 characters, a bounded window


def test_sentencepieces_window_is_bounded():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    s = sentencepieces.Search(sentencepieces.Model(open(sentencepieces.MODEL, "rb").read()))
    text = "".join(random.Random(3).choices("etaoinshrdlu", k=1_000_000))
    assert s.encode(text).tolist() == sp.encode(text) and s.widest <= 5 * s.m.longest + 3


def test_sentencepieces_search_goes_on_from_a_known_start():
    """Words that start alike are searched from there on; one look at the end of the text is taken for each position searched."""
    import sentencepiece

    class Counting(dict):
        looks = 0

        def __getitem__(self, key):
            self.looks += 1
            return super().__getitem__(key)

        def get(self, key, default=None):
            self.looks += 1
            return super().get(key, default)

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    s = sentencepieces.Search(sentencepieces.Model(open(sentencepieces.MODEL, "rb").read()))
    s.tails = Counting(s.tails)
    rnd = random.Random(9)
    words = list({"inter" + "".join(rnd.choices("aeinorst", k=6)) for _ in range(2000)})
    assert s.encode(" ".join(words)).tolist() == sp.encode(" ".join(words))
    assert 6 * len(words) <= s.tails.looks <= 6 * len(words) + 6


def test_sentencepieces_with_little_memory(monkeypatch):
    """Generations of the memory that change within a text, starts that are forgotten, stretches that are not remembered, and texts of
    many looks at once give the library's ids."""
    import sentencepiece

    for name, n in (("MEMORY", 20), ("STEMS", 5), ("AT_ONCE", 60)):
        monkeypatch.setattr(sentencepieces, name, n)
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    s = sentencepieces.Search(sentencepieces.Model(open(sentencepieces.MODEL, "rb").read()))
    rnd = random.Random(2)
    words = ["".join(rnd.choices("etaonéß.\n漢", k=rnd.choice((1, 3, 6, 7, 12, 60)))) for _ in range(120)]
    for n in (1, 30, 400, 400, 400):
        text = rnd.choice(("", " ", "   ")).join(["", *(rnd.choice(words) + " " * rnd.randrange(1, 4) for _ in range(n))])
        assert s.encode(text).tolist() == sp.encode(text)
    assert len(s.stems) <= 5 and len(s.memory) <= 21


def test_many_rules(spark):
    """Ten thousand rules: the verdicts are those of trying every rule, and few regular expressions run."""
    rnd = random.Random(11)
    names = [f"{a}{b}" for a in ("alpha", "beta", "gamma", "delta", "shop", "news") for b in range(400)]
    rules = [url_filters.host_rule(f"{rnd.choice(names)}.{rnd.choice(('com', 'net', 'org'))}", rnd.choice(("/", "/en/", "/en/7", "/shop/x")), rnd.choice(("allow", "block"))) for _ in range(9_900)]
    rules += [url_filters.Rule(f"p{i}", "block", rf"[?&]k{i}=", (f"k{i}",), 1 + i % 3, True) for i in range(100)]
    urls = [f"http://{rnd.choice(('', 'www.'))}{rnd.choice(names)}.{rnd.choice(('com', 'net', 'org'))}{rnd.choice(('/', '/en/x', '/en/71', '/shop/xy', '/a'))}{rnd.choice(('', f'?k{rnd.randrange(120)}=1'))}" for _ in range(400)]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    compiled = [(r, re.compile(r.pattern)) for r in rules]

    def brute(url):
        host, path, query = url_filters.split_url(url)
        fit = [r for r, p in compiled if p.search(f"{host}{path}?{query}" if r.query else f"{host}{path}")]
        best = max(fit, key=lambda r: r.rank, default=None)
        return (best.name, best.action) if best else (None, "allow")

    want = {i: brute(u) for i, u in enumerate(urls)}
    assert len({w[0] for w in want.values()}) > 100
    for at_once in (url_filters.RULES_AT_ONCE, 3_000):
        got = {r["page_id"]: r["url_filter"] for r in url_filters.filter_urls(d, rules, rules_at_once=at_once).collect()}
        assert {i: (f["rule"], f["verdict"]) for i, f in got.items()} == want
        assert sum(f["n_patterns"] for f in got.values()) / len(got) < 30


def test_jaccard_is_not_deceived(spark):
    """Thue-Morse words and their complements have one polynomial hash under every base modulo 2^64; these texts share nothing."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    d = spark.createDataFrame([(1, f"one two {word}"), (2, f"one two {other}"), (3, f"ONE two {word}")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_jaccard.jaccard_classes(d, 3, Fraction(9, 10)).collect()} == {1: 1, 2: 2, 3: 1}


CLASHES = ["row", "id", "h", "t", "tie", "m_id", "gone_id", "gone_h", "gone", "c", "n", "i", "source_", "whole", "theta", "q", "k", "url_text", "url_found", "salt", "r_salt", "piece_ids", "piece_text", "url_filter", "quality", "quality_score", "a.b", "r_source", "r_lang", "symbol_rate_max", "quality_", "digest"]


@pytest.mark.parametrize("kind", ["quality_rules", "drop_copies", "drop_near_copies", "take_mix", "encode", "classify", "filter_urls"])
def test_clashing_names(spark, kind):
    """Extra columns of any name come back as they were, whether sides are broadcast or shuffled."""
    base = spark.createDataFrame(DOCS, TYPES)
    from pyspark.sql import functions as F

    wide = base.select(*base.columns, *[F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASHES])
    m = quality_classifier._bias(len(quality_classifier.FEATURES))
    runs = {
        "quality_rules": [lambda: quality_rules.quality_rules(wide), lambda: quality_rules.quality_rules(wide, broadcast_rows=0)],
        "drop_copies": [lambda: exact_dedup.drop_copies(wide), lambda: exact_dedup.drop_copies(wide, broadcast_rows=0)],
        "drop_near_copies": [lambda: ngram_jaccard.drop_near_copies(wide), lambda: ngram_jaccard.drop_near_copies(wide, broadcast_rows=0)],
        "take_mix": [lambda: mixing.take_mix(wide)], "encode": [lambda: sentencepieces.encode(wide), lambda: sentencepieces.decode(sentencepieces.encode(wide.drop("piece_ids")))],
        "classify": [lambda: quality_classifier.classify(wide, m)], "filter_urls": [lambda: url_filters.filter_urls(wide, url_filters.PATTERN_RULES, "text")],
    }
    for run in runs[kind]:
        got = run()
        rows = got.collect()
        same = [f.name for f in got.schema if f.name in wide.columns and f.dataType == wide.schema[f.name].dataType]
        assert len(same) >= len(wide.columns) - 1 and rows and got.columns[: len(same)] == same == [c for c in wide.columns if c in same]
        known = {(r["doc_id"], r["text"]) for r in base.collect()}
        assert all((r["doc_id"], r["text"]) in known and all(r[c] == f"{c}{'-' if r['doc_id'] is None else r['doc_id']}" for c in CLASHES if c in same) for r in rows)


def test_repeated_rows_in_the_stages(spark):
    """Of rows equal in id and text the one of the largest hash of all columns stays; of wholly equal rows one. Near copies: rows that
    repeat the least id stay. The mix takes repeated rows together."""
    rows = [(1, PROSE, "en", "a", 1), (1, PROSE, "en", "a", 2), (1, PROSE, "en", "a", 2), (2, PROSE + " x", "en", "a", 1), (3, None, None, None, None), (3, None, None, None, None)]
    d = spark.createDataFrame(rows, TYPES)
    one = [sorted(map(tuple, exact_dedup.drop_copies(d.repartition(n)).collect()), key=repr) for n in (1, 4)]
    assert one[0] == one[1] and [r[0] for r in one[0]] == [1, 2, 3]
    near = ngram_jaccard.drop_near_copies(d)
    assert sorted(r["doc_id"] for r in near.collect()) == [1, 1, 1, 3, 3]
    taken = Counter(tuple(r) for r in mixing.take_mix(d).collect())
    assert taken[rows[1]] == 2 * taken[rows[0]]
    empty = d.limit(0)
    assert not any(f(empty).count() for f in (exact_dedup.drop_copies, ngram_jaccard.drop_near_copies, mixing.take_mix, quality_rules.quality_rules))


def test_very_long_and_odd_texts(spark):
    long = " ".join(f"word{i % 5000}x{i}" for i in range(60_000))
    rows = [(1, long, "en", "a", 1), (2, long + " tail", "en", "a", 1), (3, "x" * 300_000, "en", "a", 1), (4, "\u3000\u00a0", None, "", 0), (5, " \n\t ", "", None, 0)]
    d = spark.createDataFrame(rows, TYPES).repartition(2)
    assert {r["doc_id"]: r["component_id"] for r in ngram_jaccard.jaccard_classes(d).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    assert {r["doc_id"]: r["n_removed"] for r in repeats.remove_repeats(d).collect()} == {1: len(long), 2: len(long), 3: 300_000, 4: 0, 5: 0}
    assert quality_rules.quality_rules(d).count() == exact_dedup.drop_copies(d).count() == 5
    assert {r["doc_id"]: r["size"] for r in mixing.mix_sources(d).collect()} == {1: 60_000, 2: 60_001, 3: 1, 4: 1, 5: 0}


def test_joins_that_are_too_large_to_broadcast(spark):
    from lakewarden.llm.common import join_small

    left = spark.createDataFrame([(None if i % 7 == 0 else i % 3, i) for i in range(600)], "s long, v long").repartition(4)
    right = spark.createDataFrame([(0, "x"), (1, "y"), (None, "n")], "s long, w string")
    want = sorted(map(tuple, join_small(left, right, ["s"], "left", left["v"]).collect()), key=repr)
    assert len(want) == 600
    for hot in (1, 150, 10_000):
        assert sorted(map(tuple, join_small(left, right, ["s"], "left", left["v"], salts=3, rows=0, hot_rows=hot).collect()), key=repr) == want


def test_tables_are_deleted(spark, docs):
    from pathlib import Path

    from lakewarden.llm.common import shared_dir

    top = Path(shared_dir(spark)) / "lakewarden"
    before = len(list(top.iterdir())) if top.exists() else 0
    ngram_jaccard.jaccard_classes(docs).collect()
    assert len(list(top.iterdir())) - before <= 3


def test_urls(spark):
    rows = [(1, "HTTP://X.Example.COM/en/7?a"), (2, None), (3, "no scheme"), (4, "http://example.com/en/"), (5, "http://a.com/fr/"), (6, "https://blog.a.org/x.html"), (7, "ftp://xcom/en/")]
    d = spark.createDataFrame(rows, "page_id long, url string")
    rules = [*[url_filters.host_rule(*r) for r in url_filters.HOST_RULES], *url_filters.PATTERN_RULES]
    got = {r["page_id"]: r["url_filter"] for r in url_filters.filter_urls(d, rules).collect()}
    assert {k: (r["host"], r["rule"], r["verdict"]) for k, r in got.items()} == {
        1: ("x.example.com", "example.com/en/7", "allow"), 2: ("", None, "allow"), 3: ("", None, "allow"), 4: ("example.com", "com/en/", "block"), 5: ("a.com", None, "allow"), 6: ("blog.a.org", "blog-html", "block"), 7: ("xcom", None, "allow"),
    }
    assert max(r["n_patterns"] for r in got.values()) < len(rules) and url_filters.filter_urls(d.limit(0), rules).count() == 0


def test_components(spark):
    e = [(1, 2), (2, 3), (5, 4), (9, 9), *[(i, i + 1) for i in range(100, 140)], *[(i, 300) for i in range(200, 240)]]
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} | {i: 100 for i in range(100, 141)} | {i: 200 for i in [*range(200, 240), 300]}
    d = spark.createDataFrame(e, "a long, b long").repartition(4)
    for rows, chunk in ((0, 1000), (100, 8)):
        assert {r["v"]: r["label"] for r in connected_components(d, rows, chunk).collect()} == want
    assert connected_components(d.where("a = b")).count() == 0


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "source", "n_ids", "piece_ids"] and 0 < out.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "ngram_jaccard", "mixing", "sentencepiece"]
