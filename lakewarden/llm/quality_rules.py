"""Quality rules whose thresholds adapt to each language and source.

Every metric's distribution is kept as a mergeable quantile sketch: counts in logarithmic buckets of relative error ALPHA
(Masson, Rim and Lee, "DDSketch", VLDB 2019), which are plain sums and so merge in any order, on any number of tasks, to the
same sketch. A language and source's fence is read off its sketch alone: a tail quantile, plus a multiple of that quantile's
distance from the median. No cutoff is fixed: if all values of a group are scaled, its fences scale with them. Groups of too few
documents to have a tail take the merged sketch of their language, and small languages that of all documents. Documents are then
joined with the fences of their group. Nothing but the sketches is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, fresh, join_small, let, n_words_of, quoted, table, unwrap, words_of, wrap

ALPHA = 0.01
GAMMA = (1 + ALPHA) / (1 - ALPHA)
#: Metrics, per mille (mean_word: hundredths of a code point), and the quantile at which a group's tail is taken to start. Lines
#: are repeated in few documents of any kind, so that tail starts later.
METRICS = {"symbol_rate": 0.85, "upper_rate": 0.85, "dup_line_rate": 0.95, "mean_word": 0.85}
#: The metrics that are fenced from below as well.
TWO_SIDED = ("mean_word",)
SPREADS = 2.0
#: Documents that a group's own sketch needs; smaller groups take the one above.
MIN_GROUP = 200
MIN_WORDS = 20
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def _repeated(words: Column) -> Column:
    """Words covered by windows of WINDOW words that occur twice or more; a window is known by its 64-bit hash."""

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def positions(s: Column) -> Column:
            twice = F.filter(s, lambda e, i: ((i > 0) & (F.get(s, i - 1)["x"] == e["x"])) | F.coalesce(F.get(s, i + 1)["x"] == e["x"], F.lit(False)))
            return F.sort_array(F.transform(twice, lambda e: e["i"]))

        add = F.aggregate(
            let(pairs, positions), F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end")),
            lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"), (i + WINDOW).alias("end")),
        )
        return F.when(F.size(F.array_distinct(h)) < F.size(h), add["n"]).otherwise(0)

    def windows(w: Column) -> Column:
        h = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
        return F.when(F.size(w) > WINDOW, let(h, covered)).otherwise(0)

    return let(words, windows).cast("long")


def _counts(text: Column) -> dict[str, Column]:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    both = let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.size(x).cast("long").alias("all")))
    return {
        # What is counted stays and runs of everything else go, which takes far fewer steps than character by character.
        "n_words": n_words_of(text), "word_chars": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long"),
        "lines": both, "n_upper": F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long"),
    }


def counts(text: Column, repeats: bool) -> Column:
    """A struct of what the rules count in a whole text; a null text counts as empty."""

    def of(t: Column) -> Column:
        c = _counts(t)
        fields = [c[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "lines", "n_upper")]
        if repeats:
            fields.append(_repeated(words_of(t)).alias("n_repeat_words"))
        return F.struct(*fields)

    return of(F.coalesce(text.cast("string"), F.lit("")))


def metrics(q: str = "q") -> dict[str, Column]:
    """Whole numbers, so that every engine has the same ones."""
    chars, words = F.greatest(F.col(f"{q}.word_chars"), F.lit(1)), F.greatest(F.col(f"{q}.n_words"), F.lit(1))
    per = lambda a, b, k: F.floor(a * k / b).cast("long")
    return {
        "symbol_rate": per(F.col(f"{q}.n_symbols"), chars, 1000), "upper_rate": per(F.col(f"{q}.n_upper"), chars, 1000),
        "dup_line_rate": per(F.col(f"{q}.lines.dup"), F.greatest(F.col(f"{q}.lines.all"), F.lit(1)), 1000), "mean_word": per(F.col(f"{q}.word_chars"), words, 100),
    }


def bucket(value: Column) -> Column:
    """0 for 0, else 1 + the logarithmic bucket."""
    return F.when(value <= 0, F.lit(0)).otherwise(1 + F.ceil(F.log(value.cast("double")) / F.lit(math.log(GAMMA)))).cast("int")


def bucket_value(b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(2 * F.pow(F.lit(GAMMA), (b - 1).cast("double")) / (GAMMA + 1))


def sketches(counted: DataFrame) -> DataFrame:
    """counted (lang, source, q) -> (lang, source, metric, b, n): the sketch of each metric over documents of MIN_WORDS words or
    more. Additive: the union of two tables' sketches, summed, is the sketch of their union. Null languages and sources are
    groups like others; an empty table has no sketch."""
    m = metrics()
    long = counted.where(F.col("q.n_words") >= MIN_WORDS).select("lang", "source", *[bucket(v).alias(k) for k, v in m.items()])
    rows = long.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("b")) for k in m])).alias("x"))
    return rows.groupBy("lang", "source", "x.metric", "x.b").agg(F.count(F.lit(1)).alias("n"))


def merge_sketches(a: DataFrame, b: DataFrame) -> DataFrame:
    """The sketch of both tables' documents; either may be empty."""
    return a.unionByName(b).groupBy("lang", "source", "metric", "b").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, spreads: float = SPREADS, min_group: int = MIN_GROUP) -> DataFrame:
    """(lang, source, <metric>_max ..., mean_word_min) of every group in sketch. A fence is the tail quantile q of METRICS, plus
    spreads times its distance from the median; from below likewise. A group of fewer than min_group documents takes its
    language's merged sketch, a language of fewer that of all documents."""
    # Level 0: the group itself, 1: its language, 2: everything; a group is judged by the first level that has enough.
    levels = []
    for level, keys in enumerate((["lang", "source"], ["lang"], [])):
        one = sketch.groupBy(*keys, "metric", "b").agg(F.sum("n").alias("n"))
        levels.append(one.select(*[F.col(c) if c in keys else F.lit(None).cast("string").alias(c) for c in ("lang", "source")], F.lit(level).alias("level"), "metric", "b", "n"))
    merged = levels[0].unionByName(levels[1]).unionByName(levels[2])
    by = Window.partitionBy("lang", "source", "level", "metric")
    s = merged.withColumn("upto", F.sum("n").over(by.orderBy("b").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(by))
    tail = F.create_map(*[F.lit(x) for kv in METRICS.items() for x in kv])[F.col("metric")]
    at = lambda p: bucket_value(F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * p), F.col("b"))))
    q = s.withColumn("tail", tail).groupBy("lang", "source", "level", "metric").agg(at(F.lit(0.5)).alias("mid"), at(F.col("tail")).alias("high"), at(1 - F.col("tail")).alias("low"), F.max("all").alias("all"))
    hi, lo = F.col("high") + spreads * (F.col("high") - F.col("mid")), F.col("low") - spreads * (F.col("mid") - F.col("low"))
    of = lambda k, c: F.max(F.when(F.col("metric") == k, c))
    wide = q.groupBy("lang", "source", "level").agg(F.max("all").alias("all"), *[of(k, hi).alias(f"{k}_max") for k in METRICS], *[of(k, lo).alias(f"{k}_min") for k in TWO_SIDED])
    names = [*[f"{k}_max" for k in METRICS], *[f"{k}_min" for k in TWO_SIDED]]
    at_level = lambda i, keys: wide.where(F.col("level") == i).select(*[F.col(c).alias(f"{c}{i}") for c in keys], F.struct("all", *names).alias(f"f{i}"))
    g = at_level(0, ("lang", "source")).join(at_level(1, ("lang",)), F.col("lang0").eqNullSafe(F.col("lang1")))
    top = wide.where("level = 2").select(*names).first()  # one row, if there is any
    every = F.struct(F.lit(None).cast("long").alias("all"), *[F.lit(top[c] if top else None).cast("double").alias(c) for c in names])
    chosen = F.when(F.col("f0.all") >= min_group, F.col("f0")).when(F.col("f1.all") >= min_group, F.col("f1")).otherwise(every)
    return g.select(F.col("lang0").alias("lang"), F.col("source0").alias("source"), chosen.alias("f")).select("lang", "source", *[F.col(f"f.{c}").alias(c) for c in names])


def _verdict(judged: DataFrame, fence: DataFrame, broadcast_rows: int) -> tuple[DataFrame, Column]:
    """judged (lang, source, q with repeats, ...) joined with its fences, and the verdict as a struct."""
    d = join_small(judged, fence, ["lang", "source"], "left", F.col("q.word_chars"), rows=broadcast_rows)
    inside = F.lit(True)
    for k, v in metrics().items():
        inside = inside & (v <= F.col(f"{k}_max"))
        if k in TWO_SIDED:
            inside = inside & (v >= F.col(f"{k}_min"))
    failed = (F.col("q.n_words") < MIN_WORDS) | (100 * F.col("q.n_repeat_words") > 30 * F.col("q.n_words"))
    return d, F.struct(
        F.col("q.n_words"), F.col("q.word_chars"), F.col("q.n_symbols"), F.col("q.lines.dup").alias("n_dup_lines"), F.col("q.n_repeat_words"),
        failed.alias("base_failed"), F.coalesce(~failed & inside, F.lit(False)).alias("kept"),
    )


def _group(lang_col: str, source_col: str) -> dict[str, Column]:
    return {"lang": F.col(quoted(lang_col)).cast("string"), "source": F.col(quoted(source_col)).cast("string")}


def quality_rules(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", spreads: float = SPREADS, min_group: int = MIN_GROUP, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """docs with a struct column `quality` (or `_quality`, ... where that is taken): n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept. All other columns stay as they came, whatever their names.

    base_failed: fewer than MIN_WORDS words, or over 30 % of words in repeated windows. kept: not base_failed, and each metric
    inside the fences of the document's language and source. A null text counts as empty and so fails; null languages and
    sources are groups of their own; whole texts are counted, however long; repeated rows are judged alike, each for itself. An
    empty table gives no rows. The texts are read twice, once for the sketches and once for the verdicts, and never copied.
    """
    scratch = Scratch(docs.sparkSession)
    group = _group(lang_col, source_col)
    sketch = scratch.table(sketches(docs.select(*[v.alias(k) for k, v in group.items()], counts(F.col(quoted(text_col)), False).alias("q"))), "sketches")
    f = scratch.table(fences(sketch, spreads, min_group), "fences")
    scratch.drop(f)
    d, verdict = _verdict(wrap(docs, **group, q=counts(F.col(quoted(text_col)), True)), f, broadcast_rows)
    (name,) = fresh(docs, "quality")
    return unwrap(d, verdict.alias(name))


def quality_verdicts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", spreads: float = SPREADS, min_group: int = MIN_GROUP, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """id_col and the struct `quality` of quality_rules for each row of docs, all cases as there. The texts are read once: their
    counts are kept in a narrow table, from which the sketches are made and which is joined with the fences."""
    scratch = Scratch(docs.sparkSession)
    counted = scratch.table(docs.select(F.col(quoted(id_col)).alias("id"), *[v.alias(k) for k, v in _group(lang_col, source_col).items()], counts(F.col(quoted(text_col)), True).alias("q")), "counts")
    f = scratch.table(fences(scratch.table(sketches(counted), "sketches"), spreads, min_group), "fences")
    scratch.drop(counted, f)
    d, verdict = _verdict(counted, f, broadcast_rows)
    return d.select(F.col("id").alias(id_col), verdict.alias("quality"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its counts and verdict. Null and empty texts fail the base; see quality_rules."""
    return quality_verdicts(table(spark, sf_dir, "documents")).select("doc_id", "quality.*")


_SQL_RATES = "floor(n_symbols * 1000 / greatest(word_chars, 1))::BIGINT AS symbol_rate, floor(n_upper * 1000 / greatest(word_chars, 1))::BIGINT AS upper_rate, floor(n_dup_lines * 1000 / greatest(n_lines, 1))::BIGINT AS dup_line_rate, floor(word_chars * 100 / greatest(n_words, 1))::BIGINT AS mean_word"
OP1_SQL = rf"""
WITH a AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
b AS (SELECT *, list_transform(range(1, greatest(len(w) - 6, 1)), lambda i: array_to_string(w[i:i+7], ' ')) AS g FROM a),
g2 AS (SELECT doc_id, unnest(g) AS x, generate_subscripts(g, 1) AS i FROM b),
dup AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM g2),
cov AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM dup WHERE c > 1) GROUP BY doc_id),
c AS (SELECT b.doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    len(lines)::BIGINT AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_upper, coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM b LEFT JOIN cov USING (doc_id)),
r AS (SELECT *, {_SQL_RATES} FROM c),
u AS (UNPIVOT (SELECT lang, source, symbol_rate, upper_rate, dup_line_rate, mean_word FROM r WHERE n_words >= {MIN_WORDS}) ON symbol_rate, upper_rate, dup_line_rate, mean_word INTO NAME metric VALUE v),
s0 AS (SELECT lang, source, metric, CASE WHEN v <= 0 THEN 0 ELSE 1 + ceil(ln(v::DOUBLE) / {math.log(GAMMA)!r}) END::INT AS b, count(*) AS n FROM u GROUP BY ALL),
s AS (SELECT 0 AS level, * FROM s0 UNION ALL SELECT 1, lang, NULL, metric, b, sum(n) FROM s0 GROUP BY ALL UNION ALL SELECT 2, NULL, NULL, metric, b, sum(n) FROM s0 GROUP BY ALL),
k AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY b) AS upto, sum(n) OVER (PARTITION BY level, lang, source, metric) AS every FROM s),
q AS (SELECT level, lang, source, metric, every, min(CASE WHEN upto >= ceil(every * 0.5) THEN b END) AS b2, min(CASE WHEN upto >= ceil(every * tail) THEN b END) AS b3, min(CASE WHEN upto >= ceil(every * (1::DOUBLE - tail)) THEN b END) AS b1
  FROM k JOIN (VALUES {', '.join(f"('{k}', {x}::DOUBLE)" for k, x in METRICS.items())}) AS m(metric, tail) USING (metric) GROUP BY ALL),
v AS (SELECT *, {', '.join(f"CASE WHEN b{i} = 0 THEN 0 ELSE 2 * pow({GAMMA!r}, b{i} - 1) / {GAMMA + 1!r} END AS q{i}" for i in (1, 2, 3))} FROM q),
f AS (SELECT level, lang, source, max(every) AS every, {', '.join(f"max(CASE WHEN metric = '{k}' THEN q3 + {SPREADS} * (q3 - q2) END) AS {k}_max" for k in METRICS)}, max(CASE WHEN metric = 'mean_word' THEN q1 - {SPREADS} * (q2 - q1) END) AS mean_word_min FROM v GROUP BY ALL),
p AS (SELECT a.lang, a.source, {', '.join(f"CASE WHEN a.every >= {MIN_GROUP} THEN a.{c} WHEN b.every >= {MIN_GROUP} THEN b.{c} ELSE c.{c} END AS {c}" for c in (*(f'{k}_max' for k in METRICS), 'mean_word_min'))}
  FROM f a JOIN f b ON b.level = 1 AND a.lang IS NOT DISTINCT FROM b.lang JOIN f c ON c.level = 2 WHERE a.level = 0),
x AS (SELECT r.*, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    coalesce({' AND '.join(f'{k} <= {k}_max' for k in METRICS)} AND mean_word >= mean_word_min, false) AS inside
  FROM r LEFT JOIN p ON r.lang IS NOT DISTINCT FROM p.lang AND r.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND inside AS kept FROM x
"""
