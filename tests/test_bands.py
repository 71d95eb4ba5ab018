import random
from collections import Counter

import pytest

from lakewarden import catalog
from lakewarden.plans.bands import banded
from lakewarden.plans.execution import execute
from lakewarden.plans.gate import GovernedSession, build_plan

SF = "/root/testdata/sf0.001"
LEAST, MOST = -(2**63), 2**63 - 1


def joins(df) -> int:
    return df._jdf.queryExecution().analyzed().toString().count("explode(sequence(")


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(4)
    s = spark.newSession()
    for t in "ab":
        keys = [None, None, 0, 0, *(rnd.randrange(-120, 120) for _ in range(150))]
        s.createDataFrame([(k, k if k is None else rnd.choice((k, k // 7)), rnd.randrange(3)) for k in keys], "k long, i int, g int").createOrReplaceTempView(t)
    ends = [*range(LEAST + 40, LEAST + 80, 3), *range(MOST - 80, MOST - 40, 3)]
    s.createDataFrame([(k, k) for k in ends], "k long, g long").createOrReplaceTempView("ends")
    edge = [LEAST, LEAST + 1, LEAST + 20, MOST - 20, MOST - 1, MOST]
    s.createDataFrame([(k, k) for k in edge], "k long, g long").createOrReplaceTempView("edge")
    return s


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT * FROM a JOIN b ON b.g = a.g AND b.k BETWEEN a.k - 5 AND a.k + 5",
        "SELECT * FROM a JOIN b ON b.k BETWEEN a.k - 5 AND a.k + 5",
        "SELECT * FROM a JOIN b ON a.k + 3 > b.k AND 2 + b.k >= a.k AND a.g = b.g",
        "SELECT * FROM a, b WHERE a.k < b.k + 9 AND b.k <= a.k AND a.g <> b.g",
        "SELECT * FROM a JOIN b ON a.i BETWEEN b.k + 10 AND b.k + 30",
        "SELECT * FROM a JOIN b ON a.k - b.g BETWEEN 1 AND 2 AND b.k >= a.k AND b.k <= a.k",
        "SELECT a.k, x.k AS y, c.g FROM a JOIN b x ON x.k BETWEEN a.k - -2 AND a.k + 7 JOIN b c ON c.k > x.k - 4 AND c.k < x.k + 1 AND c.g = x.g",
        "WITH t AS (SELECT k, count(*) AS n FROM a GROUP BY k) SELECT x.k, sum(y.n) AS n FROM t x JOIN t y ON y.k BETWEEN x.k - 30 AND x.k - 10 GROUP BY x.k",
        "SELECT a.k, t.band FROM a JOIN (SELECT k, g AS band FROM b) t USING (k) JOIN b ON b.i >= t.k AND b.i <= t.k + 2 ORDER BY 1, 2 LIMIT 40",
        "SELECT x.k, y.k AS z FROM edge x JOIN ends y ON y.k + 40 >= x.k - 0 AND y.k - 40 <= x.k",
    ],
)
def test_same_pairs_as_plain_joins(tables, sql):
    plain = tables.sql(sql)
    new = banded(plain)
    assert joins(plain) == 0 and joins(new) >= 1 and new.schema == plain.schema
    assert Counter(new.collect()) == Counter(plain.collect()) and plain.count() > 0


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT * FROM a JOIN b ON a.k = b.k",
        "SELECT * FROM a JOIN b ON b.k >= a.k - 5",
        "SELECT * FROM a LEFT JOIN b ON b.k BETWEEN a.k - 5 AND a.k + 5",
        "SELECT * FROM a JOIN b ON b.k BETWEEN a.k + 5 AND a.k - 5",
        "SELECT * FROM a JOIN b ON b.k BETWEEN a.k - 0.5 AND a.k + 0.5",
        "SELECT * FROM a WHERE k BETWEEN i - 5 AND i + 5",
    ],
)
def test_others_stay_as_they_are(tables, sql):
    plain = tables.sql(sql)
    assert banded(plain) is plain


def test_sums_that_wrap_around_are_left(tables):
    tables.conf.set("spark.sql.ansi.enabled", "false")
    try:
        plain = tables.sql("SELECT * FROM a JOIN b ON b.k BETWEEN a.k - 5 AND a.k + 5")
        assert banded(plain) is plain
    finally:
        tables.conf.unset("spark.sql.ansi.enabled")


def test_join_range_does_not_try_all_pairs_of_a_size(spark):
    """40,000,000,000 pairs of one size, of which 20,197,450 lie within the band."""
    n = 200_000
    part = spark.range(n).selectExpr("id AS p_partkey", "7 AS p_size")
    s = GovernedSession(spark, {"part": part})
    sql = f"SELECT count(*) AS n, sum(n) AS pairs, min(n) AS least, max(n) AS most FROM ({catalog.SQL['join_range']})"
    assert execute(build_plan(s, sql), timeout_ms=60_000) == [{"n": n, "pairs": 101 * n - 50 * 51, "least": 51, "most": 101}]
    assert joins(catalog.QUERIES["join_range"](spark, SF)) == 1
