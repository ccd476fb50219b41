"""JSON walks and form fields inside the JVM against plain Python."""

import json
import random

from sitefacts.operators import columns as O
from sitefacts.session import land

TEXTS = ["", "x", "{", "[1]", '{"a":1}', " [", "é ", "12", "null", "a\\b\"c", "/main/startups/s", "1.50"]


def made(rng, depth):
    kind = rng.random()
    if depth and kind < 0.35:
        return {rng.choice("zyxabc") + str(i): made(rng, depth - 1) for i in range(rng.randint(0, 4))}
    if depth and kind < 0.6:
        return [made(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    return rng.choice([*TEXTS, 5, 1.5, -3, True, None, 10**12])


def walk(node, path=(), owner=None, name=None):
    if isinstance(node, str):
        yield path, owner, name, node
    elif isinstance(node, dict):
        for i, (k, v) in enumerate(node.items()):
            yield from walk(v, (*path, i), path, k)
    elif isinstance(node, list):
        for i, v in enumerate(node):
            yield from walk(v, (*path, i))


def test_nodes_of_any_depth(spark):
    rng = random.Random(11)
    rows = [(i, json.dumps(made(rng, 5), ensure_ascii=rng.random() < 0.5)) for i in range(300)]
    deep = "x"
    for i in range(40):
        deep = [deep, str(i)] if i % 2 else {"b": deep, "a": str(i)}
    rows += [(1000, json.dumps(deep)), (1001, None), (1002, "{"), (1003, ""), (1004, '"{}"'), (1005, " [ \"a\" , {\"k\" : \"v\"} ] ")]
    got = O.json_nodes(spark.createDataFrame(rows, "id int, j string"), "id", "j")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    found = sorted((r["id"], tuple(r["seq"]), None if r["owner"] is None else tuple(r["owner"]), r["key"], r["value"]) for r in got.collect())
    want = []
    for i, j in rows:
        try:
            root = json.loads(j)
        except (TypeError, ValueError):
            continue
        want += [(i, (0, *p), None if o is None else (0, *o), k, v) for p, o, k, v in walk(root)]
    assert found == sorted(want)


def brute_texts(value, depth=1):
    """Texts of a value, as far as the test's values need it."""
    text = lambda x: " ".join(x.split()) if isinstance(x, str) else {True: "true", None: ""}.get(x, str(x))
    if isinstance(value, list):
        out = []
        for item in value:
            shown = next((text(item[n]) for n in ("name", "value", "metric_value") if isinstance(item.get(n), str)), "") if isinstance(item, dict) else text(item)
            if shown and shown.lower() not in map(str.lower, out):
                out.append(shown)
        return out
    if isinstance(value, dict):
        return brute_texts(value["value"], depth - 1) if depth and "value" in value else []
    return [text(value)] if text(value) else []


def test_form_values(spark):
    values = [*TEXTS, "a  b\u00a0\u2003c ", 5, True, None, [], ["x", "X", {"name": "n"}, {"name": 5, "value": "v"}], {"value": "w"}, {"value": ["p", "q"]}]
    rng = random.Random(4)
    rows = []
    for i in range(200):
        fields = [{"sysName": rng.choice(["project_note", " project_note ", "project_industry", "none"]), "value": rng.choice(values)} for _ in range(5)]
        rows.append((i, json.dumps({"forms": [{"form": [{"fields": fields}]}], "fullName": None}, ensure_ascii=i % 2 == 0), fields))
    df = spark.createDataFrame([r[:2] for r in rows], "id int, j string")
    got = {r["id"]: (r["description"], r["industries"]) for r in O.pivot_form_fields(df, "j").select("id", "description", "industries").collect()}
    for i, _, fields in rows:
        first = lambda name: next((f["value"] for f in fields if f["sysName"].strip() == name), None)
        note = brute_texts(first("project_note"))
        assert got[i] == (note[0] if note else "", brute_texts(first("project_industry")))


def test_form_values_are_read_without_failing_paths(spark):
    inner = [{"value": "v"}, {"value": None}, {"value": ["p", "P", {"name": 5, "metric_value": "m"}]}, {"other": 1}, [{"other": 1}, {"name": None, "value": "w"}, ["n"], None]]
    rows = [(i, json.dumps({"forms": [None, {"form": [{"fields": [None, {"sysName": "project_industry", "value": v}]}]}]})) for i, v in enumerate(inner)]
    money = [["none 5", "12 000 руб.", "7 $"], ["12", "USD"], "3,5 €"]
    rows += [(10 + i, json.dumps({"forms": [{"form": [{"fields": [{"sysName": "questionnaire_metricRevenue", "value": v}]}]}]})) for i, v in enumerate(money)]
    df = O.pivot_form_fields(spark.createDataFrame(rows, "id int, j string"), "j")
    # a path that leads nowhere costs an exception, so objects are cast whole
    assert "$." not in df._jdf.queryExecution().optimizedPlan().toString()
    got = {r["id"]: r for r in df.collect()}
    assert [got[i]["industries"] for i in range(4)] == [["v"], [], ["p", "m"], ['{"other":1}']]
    assert got[4]["industries"][0] == "w"
    assert [(got[10 + i]["revenue_amount"], got[10 + i]["revenue_currency"]) for i in range(3)] == [("12000", "RUB"), ("", ""), ("35", "EUR")]


def test_entities_are_opened_in_few_jobs_and_shuffled_once(spark, monkeypatch):
    rows = [(1, json.dumps({"items": [{"title": "[a]", "url": "/main/startups/a"}, {"n": [5, "/main/startups/b"]}, {"name": 5, "url": "/main/startups/c"}]})), (2, "{")]
    df = spark.createDataFrame(rows, "id int, j string")
    landed = []
    monkeypatch.setattr(O, "land", lambda df, name: landed.append(name) or land(df, name))
    found = O.discover_entities(df, "id", "j", "https://x.example.com")
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert landed == ["json-level"]
    base = "https://x.example.com/main/startups/"
    assert sorted(map(tuple, found.collect())) == [(1, 1, base + "a", "[a]"), (1, 2, base + "b", "startup_2"), (1, 3, base + "c", "startup_3")]
