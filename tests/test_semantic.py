import json

import pytest

from lakewarden import catalog
from lakewarden.errors import JoinPathError
from lakewarden.operators import mining
from lakewarden.operators.inference import infer_relationships, singular
from lakewarden.operators.profile import profile
from lakewarden.operators.retrieval import Memory, hash_vector
from lakewarden.semantic.build import bootstrap, lint
from lakewarden.semantic.compiler import parse_metric
from lakewarden.semantic.model import ModelError, Registry, dump_document, parse_document
from lakewarden.sources.registry import Config, Source, Sources, load_config
from lakewarden.surfaces.audit import AuditLog, redact
from lakewarden.surfaces.dashboard import Confirmations, deploy, generate
from lakewarden.surfaces.golden import evaluate, promote
from lakewarden.surfaces.tools import Service

SF = "/root/testdata/sf0.001"


def test_model_codec():
    doc = parse_document(catalog.MODEL)
    assert parse_document(dump_document(doc)) == doc
    for bad in ("models:\n  - {name: a}", "other: []", "metrics:\n  - {name: a, name: b}", "models: [{name: a, source: s, table: t, columns: [{name: c, dataType: int, extra: 1}]}]"):
        with pytest.raises(ModelError):
            parse_document(bad)


def test_join_paths():
    r = catalog.registry()
    assert [x.name for x, _ in r.find_path("line", "nation")] == ["line_orders", "orders_customer", "customer_nation"]
    assert r.find_path("nation", "line")[0][1] is True
    twice = parse_document(catalog.MODEL + "").copy()
    twice["relationships"] = [*twice["relationships"], type(twice["relationships"][0])(**{**vars(twice["relationships"][0]), "name": "again"})]
    with pytest.raises(JoinPathError) as e:
        Registry([twice]).find_path("line", "orders")
    assert e.value.code == "E_AMBIGUOUS_JOIN_PATH" and e.value.routes == ("again", "line_orders")


def test_metric_grammar():
    assert parse_metric("count( distinct x )") == ("count", True, "x")
    for bad in ("SUM(*)", "COUNT(DISTINCT *)", "SUM(a + b)", "MEDIAN(a)"):
        with pytest.raises(ValueError):
            parse_metric(bad)


def test_profile(spark):
    d = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, "b", None)], "k int, s string, n int")
    p = {r["column"]: r for r in profile(d).collect()}
    assert (p["k"]["min"], p["k"]["max"], p["k"]["distinctCount"], p["n"]["nullRate"]) == ("1", "3", 3, 1.0)
    assert [(v["value"], v["count"]) for v in p["s"]["topValues"]] == [("b", 2), ("a", 1)] and p["s"]["min"] is None
    assert profile(d, ["k"], cutoff=2).first()["topValues"] is None
    assert profile(d.limit(0)).count() == 3 and profile(d, ["gone"]).count() == 0


def test_sources_bootstrap_lint(spark, tmp_path):
    for t, d in {"actors": spark.createDataFrame([(i, f"n{i}") for i in range(5)], "actor_id int, name string"), "films": spark.createDataFrame([(i, i % 5) for i in range(9)], "film_id int, actor_id int")}.items():
        d.write.parquet(f"{tmp_path}/{t}.parquet")
    c = Config("s", "parquet", ("films", "actors"), path=str(tmp_path), keys={"actors": {"primary": ["actor_id"]}, "films": {"primary": ["film_id"]}})
    s = Source(spark, c)
    assert [t["name"] for t in s.list_tables()] == ["actors", "films"] and s.get_schema("gone") == []
    found = infer_relationships(s)
    assert [(f.child, f.column, f.parent, f.confidence) for f in found] == [("films", "actor_id", "actors", 0.95)]
    out = tmp_path / "m" / "m.yml"
    out.parent.mkdir()
    assert bootstrap(s, out) and not bootstrap(s, out)
    r = Registry.load(out.parent)
    assert {f.code for f in lint(r, s)} == {"missing_description"}
    gone = Source(spark, Config("s", "parquet", ("films",), path=str(tmp_path)))
    assert "missing_model_table" in {f.code for f in lint(r, gone)}
    with pytest.raises(ValueError):
        Sources(spark, [c, c])
    with pytest.raises(ValueError):
        load_config(json.dumps({"sources": [{"name": "a", "type": "jdbc", "url": "${NOT_THERE}", "tables": []}]}), {})
    assert singular("categories") == "category" and singular("class") == "class"


def test_mining(spark):
    m = mining.mine(spark, spark.createDataFrame(list(enumerate(catalog.LOG, 1)), "line int, sql string"))
    assert m.joins == [{"left": "customer.c_custkey", "right": "orders.o_custkey", "frequency": 3}]
    assert [r["frequency"] for r in m.rules] == [3, 2] and [w["line"] for w in m.warnings] == [7]


def test_memory(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "mem"))
    assert m.search("anything") == []
    for q, s in (("films by rating", "SELECT rating FROM film"), ("actors in the cast", "SELECT * FROM actor"), ("Films  by rating", "SELECT rating, title FROM film")):
        m.record(q, s, {}, 1.0, [])
    assert m.records().count() == 2
    assert m.search("film rating")[0]["sql"] == "SELECT rating, title FROM film"
    m.compact()
    assert m.records().count() == 2 and sum(abs(x) for x in hash_vector("a b")) == 2


def test_service_golden_dashboard(spark, tmp_path):
    from lakewarden.plans.policy import PolicyEngine

    sources = Sources(spark, [Config("tpch", "parquet", ("nation", "customer", "region"), path=SF)])
    log = AuditLog(str(tmp_path / "audit.jsonl"), ["hunter2"])
    s = Service(spark, sources, log, catalog.registry(), PolicyEngine(catalog.POLICY))
    assert s.call("query", {"connectionId": "tpch", "sql": "SELECT count(*) AS n FROM region", "principal": "eve"}, "ann")["result"]["results"] == [{"n": 5}]
    assert s.call("query", {"connectionId": "tpch", "sql": "DROP TABLE nation"}, "ann")["error"]["code"] == "E_WRITE_FORBIDDEN"
    assert s.call("query", {"connectionId": "tpch", "sql": "SELECT hunter2 FROM nation"}, "ann")["error"]["code"] == "E_UNKNOWN_COLUMN"
    assert [c["name"] for c in s.call("describe_model", {"model": "customer"}, "ann")["result"]["columns"]] == ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
    lines = [json.loads(x) for x in (tmp_path / "audit.jsonl").read_text().splitlines()]
    assert [x["outcome"] for x in lines] == ["success", "denied", "failure"] and "hunter2" not in (tmp_path / "audit.jsonl").read_text()
    assert redact("jdbc://u:p@h password=x") == "jdbc://[REDACTED]@h password=[REDACTED]"
    gold = [{"question": "a", "sql": "SELECT r_regionkey AS k FROM region", "expected": [{"k": k} for k in (4, 3, 2, 1, 0)]}, {"question": "b", "sql": "SELECT gone FROM region", "expected": []}]
    r = evaluate(catalog.session(spark, SF), gold, 0.9)
    assert (r.passed, r.total, r.exit_code) == (1, 2, 1)
    p = tmp_path / "queries.yml"
    assert promote(p, "q", "SELECT 1", [{"a": 1}], True) and not promote(p, "q", "SELECT 1", [{"a": 1}], True)
    with pytest.raises(ValueError):
        promote(p, "q", "SELECT 2", [], True)
    page = generate({"title": "T & <x>", "metrics": [{"name": "n", "value": None, "dimensions": {"r": "</script>"}}]})
    assert "</script>" not in page.split('id="data">')[1].split("</script>")[0] and "—" in page
    c = Confirmations()
    t = c.issue(page)
    assert deploy(page, "https://x", "b", c, t, post=lambda r: b'{"url": "https://y"}') == "https://y"
    with pytest.raises(PermissionError):
        deploy(page, "https://x", "b", c, t, post=lambda r: b"{}")


def test_hidden_source_names_hide_semantic_ones():
    from lakewarden import catalog
    from lakewarden.surfaces.ask import guided_prompt, visible_document

    r = catalog.registry()
    assert r.spellings(["l_extendedprice"]) == {"l_extendedprice", "price"}
    shown = visible_document(r, ["l_extendedprice"])
    assert not {"revenue", "least_price", "most_price"} & {m["name"] for m in shown["metrics"]} and "parts" in {m["name"] for m in shown["metrics"]}
    text = guided_prompt("what is the price?", r, "SUM(price) is revenue", [{"question": "q", "sql": "SELECT sum(price) FROM line"}], hidden=["l_extendedprice"])
    assert "(price)" not in text and "l_extendedprice" not in text and "CLAC REDACTED" in text
