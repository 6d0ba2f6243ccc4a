"""Index, query, change and analyse a small source tree end to end."""

import pytest

from graphloom.operators.analysis import propagate, summarize
from graphloom.plans.planner import build_batch
from graphloom.plans.tools import Admission, AuditLog, Deadline, Engine, Resident, ToolError, audit_line
from graphloom.sources.store import Store, digest
from graphloom.sources.walk import walk

TREE = {
    "src/orders.ts": "export function findUser(id: string) {\n  return users.find(u => u.id === id);\n}\nexport function lookupTax(o: Order) {\n  return findUser(o.user);\n}\n"
    "export function processOrders(orders: Order[]) {\n  for (const o of orders) {\n    lookupTax(o);\n  }\n}\n",
    "app/math.py": "def fib(n):\n    if n < 2:\n        return n\n    return fib(n - 1) + fib(n - 2)\n",
    "conf/app.yaml": "server:\n  port: 80\n",
    "db/schema.sql": "CREATE TABLE users (id int, name text);\n",
    "node_modules/x/skip.ts": "export function skipped() { return 1 }\n",
    "bad.py": b"\xff\xfe",
    "empty.go": "\n",
}


def lay(root, tree):
    for path, body in tree.items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(body if isinstance(body, bytes) else body.encode())


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    lay(root, TREE)
    store = Store(spark, f"file://{tmp_path_factory.mktemp('store')}")
    batch, _ = build_batch(store.snapshot(), walk(spark, f"file://{root}"), "initial")
    receipt = store.publish(batch)
    return root, store, receipt


def test_index(spark, indexed):
    _, store, receipt = indexed
    assert receipt["generation"] == 1 and receipt["files"] == {"added": 6}
    symbols = {(r["file_path"], r["name"]): r for r in store.snapshot().table("symbol").collect()}
    assert ("src/orders.ts", "processOrders") in symbols and ("app/math.py", "fib") in symbols and ("conf/app.yaml", "server.port") in symbols
    assert not any("node_modules" in p for p, _ in symbols)
    files = {r["path"]: r["parse_status"] for r in store.snapshot().table("file").collect()}
    assert files["bad.py"] == "failed" and files["empty.go"] == "ok"
    calls = {(r["src_id"].split(":")[2].split("@")[0], r["dst_id"].split(":")[2].split("@")[0]) for r in store.snapshot().table("edge").where("kind = 'calls'").collect()}
    assert ("processOrders", "lookupTax") in calls and ("lookupTax", "findUser") in calls


def test_incremental_equals_rebuild(spark, indexed, tmp_path):
    root = tmp_path / "repo"
    lay(root, TREE)
    store = Store(spark, f"file://{tmp_path}/a")
    store.publish(build_batch(store.snapshot(), walk(spark, f"file://{root}"), "initial")[0])
    (root / "app/math.py").unlink()
    (root / "src/orders.ts").write_text(TREE["src/orders.ts"].replace("lookupTax(o);", "lookupTax(o); findUser(o.id);"))
    lay(root, {"src/new.ts": "export function caller() { return processOrders([]) }\n"})
    batch, plan = build_batch(store.snapshot(), walk(spark, f"file://{root}"), "incremental")
    actions = {r["path"]: r["action"] for r in plan.collect()}
    assert actions["app/math.py"] == "delete" and actions["src/orders.ts"] == "index" and actions["conf/app.yaml"] == "keep"
    store.publish(batch)
    clean = Store(spark, f"file://{tmp_path}/b")
    clean.publish(build_batch(clean.snapshot(), walk(spark, f"file://{root}"), "full")[0])
    mine, theirs = digest(store.snapshot()), digest(clean.snapshot())
    assert mine["symbols"] == theirs["symbols"] and mine["edges"] == theirs["edges"]


def test_tools(spark, indexed):
    _, store, _ = indexed
    e = Engine(spark, store, soft=600, hard=900)
    assert e.symbol_search("findUser").rows.first()["name"] == "findUser"
    assert e.symbol_search('"unclosed').rows.isEmpty() and e.symbol_search("  ").rows.isEmpty()
    assert e.symbol_lookup("FIB").rows.first()["file_path"] == "app/math.py"
    with pytest.raises(ToolError):
        e.symbol_lookup("nope-nothing")
    start = e.symbol_lookup("processOrders").rows.first()["id"]
    hops = {r["name"]: r["hop"] for r in e.dependency_trace(start, "out", 3).rows.collect()}
    assert hops["lookupTax"] == 1 and hops["findUser"] == 2
    assert e.resolve_symbols([start, "x"]).value["missing"] == ["x"]
    assert e.discover_symbols("findUser").rows.first()["match_sources"] == ["lexical"]
    assert e.diffuse_context("findUser", 3).rows.count() >= 1
    assert e.retrieve_context_capsule("fix findUser").value["task_mode"] == "bugfix"
    reports = {r["qualified_name"].split(":")[-1]: r for r in e.inspect_symbol_complexity("processOrders", 50).value["reports"]}
    assert reports["processOrders"]["propagated_time"] == "O(n^2)" and reports["processOrders"]["local_time"] == "O(n)"
    patched = TREE["src/orders.ts"].replace("lookupTax(o);", "for (const p of orders) { lookupTax(o); }")
    out = e.analyze_patch_impact({"src/orders.ts": patched}).value
    assert out["verdict"] == "WARN_COMPLEXITY_REGRESSION"
    assert any(r["propagated_time"] == "O(n^3)" for r in out["reports"].values())
    assert any(a["rule_id"] == "OPT-001" for a in out["advisories"])
    renamed = TREE["src/orders.ts"].replace("lookupTax(o: Order)", "lookupTax(o: Order, rate: number)")
    assert e.analyze_patch_impact({"src/orders.ts": renamed}).value["impact"]["impact_level"] in ("low", "medium", "high", "critical")
    blast = e.trace_blast_radius("findUser", signature_changed=True).value
    assert blast["breaking_call_sites"] and blast["contract_breakage_risk"] > 0.5


def test_propagation_cases():
    fib = {"id": "f", "kind": "function", "name": "fib", "qualified_name": "fib", "file_path": "m.py", "module": "m", "line_start": 1, "line_end": 4, "body_excerpt": TREE["app/math.py"]}
    report = propagate([fib], [])[0]["f"]
    assert report.propagated_time == "O(2^n)" and report.recursion_kind == "direct_recursion"
    assert {a["rule_id"] for a in report.advisories} == {"OPT-006"}
    s = summarize("function", "f", "a.py", 1, "def f(xs):\n    out = ''\n    for x in xs:\n        out += 'a'\n        db.query('select 1')\n    return out\n")
    assert [p["kind"] for p in s.patterns] == ["string_concat_in_loop"] and s.io[0][0] == "database_query"
    assert summarize("class", "C", "a.py", 1, "class C: pass").cyclomatic == 1


def test_caps():
    now = [0.0]
    d = Deadline(5, 10, lambda: now[0])
    assert d.open()
    now[0] = 6
    assert not d.open() and d.truncated
    now[0] = 11
    with pytest.raises(ToolError) as e:
        d.open()
    assert e.value.envelope()["retryable"]
    gate = Admission(1)
    with gate, pytest.raises(ToolError), gate:
        pass
    assert audit_line("t", {"b": 1, "a": 2}, True, 1) == audit_line("t", {"a": 2, "b": 1}, True, 1)


def test_resident_and_audit(spark, indexed, tmp_path):
    _, store, _ = indexed
    shared, log = Resident(), tmp_path / "audit.jsonl"
    a, b = (Engine(spark, store, soft=600, hard=900, resident=shared, audit=AuditLog(str(log), lambda: 7.0)) for _ in range(2))
    first = a.call("diffuse_context", query="findUser", k=3).rows.collect()
    arcs = shared.arcs
    assert arcs.is_cached and b.call("diffuse_context", query="findUser", k=3).rows.collect() == first and shared.arcs is arcs
    with pytest.raises(ToolError):
        a.call("symbol_lookup", name_or_id="nope-nothing")
    with pytest.raises(ToolError):
        a.call("snapshot")
    lines = log.read_text().splitlines()
    assert len(lines) == 3 and lines[0] == lines[1] and '"ok":false' in lines[2] and '"ts":7' in lines[0]
    shared.get(("other",), lambda: spark.range(1))
    assert not arcs.is_cached
    AuditLog(str(tmp_path / "no" / "dir")).record("t", {}, True)
