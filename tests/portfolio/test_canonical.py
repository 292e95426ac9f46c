import hashlib
import json

from arborfolio.operators import documents as do


def test_canonical_texts_of_one_pass(spark):
    values = [10**40 + 7, -(10**60), [1e16, 123456789012345680.0, -0.0, 5e-324], {"x": "1.5", "a\x7f": "\x01\x1f"}, {"b": {"a": 1, "B": [2.50]}}]
    rows = [(i, json.dumps(v, ensure_ascii=False)) for i, v in enumerate(values)]
    rows += [(100, '{"a": 1, "b": {"c": 1, "c": 1}}'), (101, "[1] 2"), (102, "[01]"), (103, "[1e999, NaN]"), (104, "-Infinity"), (105, '"a\tb"')]
    rows += [(200, "[1, -1e999]"), (201, "9" * 400), (300, "[" * 100_000 + "]" * 100_000), (None, "[ 2.0 ]"), (7, "[1]"), (7, "[2]")]
    frame = do.canonical_documents(spark.createDataFrame(rows, "id int, body string"))
    assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
    got = frame.collect()
    assert len(got) == len(rows)
    of = {r.id: r for r in got}
    for i, v in enumerate(values):
        want = json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert (of[i].canonical, of[i].problem, of[i].hash) == (want, None, "sha256:" + hashlib.sha256(want.encode()).hexdigest())
    assert {of[i].problem for i in range(100, 106)} == {"malformed"} and all(of[i].hash is None for i in (*range(100, 106), 200, 201, 300))
    assert of[200].problem == of[201].problem == "not finite" and of[300].problem == "too deep"
    assert of[None].canonical == "[2.0]" and sorted(r.canonical for r in got if r.id == 7) == ["[1]", "[2]"]
