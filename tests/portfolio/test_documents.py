import hashlib
import json

from arborfolio.operators import documents as do
from arborfolio.operators import node_rules as nr


def test_canonical_text_of_nested_documents(spark):
    values = [
        {"b": [1, 2.0, -0.5, 1e300, 12345678901234567890123], "a": {"z": None, "é": "ü\"\\\n\t/", "y": {"x": [[], {}, [{"k": True}]]}}, "": False},
        [], {}, [1.5, "x", None, [0.1, 100000.0, 1e22, 3.0e-7]], "text", 7, 2.5, None, {"k\"ey\n": 1, "K": 2, "k": 3, "😀": 4}, [[[[[[1]]]]]], {"n": 123456.789, "m": 1e5},
    ]
    bad = ["{", "NaN", '{"a": NaN}', None, "", '[1, Infinity]']
    rows = [(i, json.dumps(v, indent=1)) for i, v in enumerate(values)] + [(100 + i, b) for i, b in enumerate(bad)] + [(200, "[1e999]")]
    got = {r.id: r for r in do.canonical_documents(spark.createDataFrame(rows, "id int, body string")).collect()}
    assert len(got) == len(rows)
    for i, v in enumerate(values):
        want = json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert (got[i].canonical, got[i].problem) == (want, None), v
        assert got[i].hash == "sha256:" + hashlib.sha256(want.encode()).hexdigest()
    assert all(got[100 + i].problem == "malformed" and got[100 + i].canonical is None and got[100 + i].hash is None for i in range(len(bad)))
    assert got[200].problem in ("not finite", "malformed") and got[200].hash is None
    assert do.canonical_documents(spark.createDataFrame([], "id int, body string")).count() == 0


def test_tables_of_a_saved_tree(spark):
    tree = {
        "root_id": "R", "benchmark": {"weights": {"spy": 0.6, "TICKER:agg": 0.4}},
        "nodes": [
            {"id": "R", "name": "Root", "instruments": ["gld "], "children": ["A"], "goal": {"objective": "max_ratio"}, "constraints": {"min_weights": {"GLD": 0.1}, "max_weights": {"ticker:gld": 0.9}, "per_asset_cap": 0.5, "vol_target": 0.1, "views": [{"instruments": {"gld": 1.0, "spy": -1.0}, "expected_return": 0.02, "confidence": 0.5}]}},
            {"id": "A", "instruments": ["x", "y"], "children": ["B"], "proxy": "spy", "constraints": {"min_weights": {}, "max_weights": {"x": 0.3}}},
            {"id": "B", "instruments": ["z"], "children": [], "proxy": "agg", "constraints": {"min_weights": {}, "max_weights": {}}},
        ],
    }
    tables = do.tree_tables(spark.createDataFrame([(1, json.dumps(tree)), (2, "{broken"), (3, None)], "tree_id int, body string"))
    rows = lambda name, *columns: sorted(map(tuple, tables[name].select(*columns).collect()), key=str)
    assert rows("edges", "parent_id", "child_id") == [("A", "B"), ("R", "A")]
    assert rows("nodes", "node_id", "name", "proxy", "objective", "is_root", "volatility_reference", "view_tau") == [("A", "A", "ticker:SPY", "min_risk", False, "none", 0.05), ("B", "B", "ticker:AGG", "min_risk", False, "none", 0.05), ("R", "Root", None, "max_ratio", True, "manual", 0.05)]
    assert rows("bounds", "node_id", "instrument", "lo", "hi") == [("A", "ticker:X", 0.0, 0.3), ("A", "ticker:Y", 0.0, 1.0), ("B", "ticker:Z", 0.0, 1.0), ("R", "ticker:GLD", 0.1, 0.5)]
    assert rows("views", "node_id", "view_id", "instrument", "coef", "source") == [("R", 0, "ticker:GLD", 1.0, "manual"), ("R", 0, "ticker:SPY", -1.0, "manual")]
    assert rows("benchmark", "instrument", "weight") == [("ticker:AGG", 0.4), ("ticker:SPY", 0.6)]
    assert [r.tree_id for r in tables["broken"].orderBy("tree_id").collect()] == [2, 3] and tables["instruments"].count() == 4


def test_rules_of_documents_and_inherited_financing(spark):
    def tree(nodes, **rest):
        return json.dumps({"root_id": "R", "currency": "USD", "nodes": nodes, **rest})

    node = lambda i, **c: {"id": i, "constraints": c}
    bodies = {
        1: None, 2: "", 3: "[1]", 4: '{"root_id": "R", "nodes"', 5: json.dumps({"root_id": "R", "nodes": {}}), 6: tree([node("A")], currency="CHF"), 7: tree([node("R"), 5, None]),
        8: tree([{"id": "R", "constraints": [1]}], data="x"), 9: tree([node("R", risk_free_rate=0.01)], data={"risk_free_annual": 0.02, "borrow_spread_bps": "1e999"}),
        10: tree([node("R", max_leverage=0.5, cash_enabled="maybe"), {"id": "A", "goal": {"objective": "best"}}]), 11: tree([node("R", vol_target="1d", view_tau=float("inf"), max_weights={"a": "x", "b": ""}, borrow_spread_bps=-5, cash_enabled=1)]),
        12: tree([node("R", borrow_spread_bps=40), node("A", max_leverage=2), node("B", allow_cash="on", borrow_spread_bps=0), node("C")], data={"borrow_spread_bps": 10}), 13: tree([node("R", cash_enabled=True, borrow_spread_bps="")], data={"borrow_spread_bps": 10}), 14: tree([node("R", max_leverage=None, cash_enabled=None, views=None)]),
    }
    docs = spark.createDataFrame(list(bodies.items()), "tree_id int, body string")
    found = {}
    for r in nr.node_violations(docs).collect():
        assert r.message
        found.setdefault(r.tree_id, set()).add((r.node_id, r.rule))
    assert all(found[k] == {(None, "malformed")} or (None, "malformed") in found[k] for k in (1, 2, 3, 4))
    assert found[5] == {(None, "nodes"), (None, "currency missing")} and found[6] == {(None, "root missing"), (None, "currency")}
    assert found[7] == {("<unknown>", "node")} and found[8] == {(None, "data"), ("R", "constraints")}
    assert found[9] == {(None, "rate conflict"), (None, "data.borrow_spread_bps")}
    assert found[10] == {("R", "leverage"), ("R", "cash kind"), ("A", "objective")}
    assert found[11] == {("R", "vol_target not finite"), ("R", "view_tau not finite"), ("R", "max_weights not finite"), ("R", "spread")}
    assert not {12, 13, 14} & set(found)
    got = {(r.tree_id, r.node_id): (r.cash_enabled, r.max_leverage, r.spread, r.spread_source) for r in nr.node_financing(docs.where("tree_id >= 12")).collect()}
    assert got[12, "R"] == (False, 1.0, 0.0, "default") and got[12, "A"] == (True, 2.0, 40.0, "root") and got[12, "B"] == (True, 1.0, 0.0, "node") and got[12, "C"] == (False, 1.0, 0.0, "default")
    assert got[13, "R"] == (True, 1.0, 10.0, "root") and got[14, "R"] == (False, 1.0, 0.0, "default")
    assert nr.node_violations(docs.limit(0)).count() == 0
