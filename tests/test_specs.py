"""Specification comparison against exhaustive matching of clauses under a map of names in both directions."""

import copy
import itertools
import json

import duckdb
import numpy as np

from textloom.operators import specs
from textloom.plans import catalog

r = np.random.default_rng(12)
fresh = itertools.count()


def expression(names, depth=0):
    k = int(r.integers(0, 6 if depth < 3 else 2))
    if k == 0:
        return {"var": str(r.choice(names))}
    if k == 1:
        return {"int": int(r.integers(0, 3))}
    if k == 2:
        v = f"i{r.integers(0, 3)}"
        return {str(r.choice(["forall", "exists"])): {"var": v, "lo": expression(names, depth + 2), "hi": expression(names, depth + 2), "body": expression([*names, v], depth + 1)}}
    if k == 3:
        return {"call": {"fun": str(r.choice(["f", "g", names[0]])), "args": [expression(names, depth + 1) for _ in range(int(r.integers(0, 3)))]}}
    if k == 4:
        return {"lemma": {"name": "helps", "args": [expression(names, depth + 1)]}}
    return {"op": str(r.choice(["<", "<=", "+"])), "args": [expression(names, depth + 1), expression(names, depth + 1)]}


def header(name, params, returned=True):
    m = {"name": name, "params": [{"name": p, "type": str(r.choice(["int", "seq"]))} for p in params]}
    if returned:
        m["returns"] = [{"name": "out", "type": "int"}]
    names = [name, *params, *(["out"] if returned else [])]
    m["requires"] = [expression(names) for _ in range(int(r.integers(0, 7)))]
    m["ensures"] = [expression(names) for _ in range(int(r.integers(0, 3)))]
    if r.random() < 0.3:
        m["decreases"] = expression(names)
    return m


def spec():
    task = header("solve", ["a", "b"][: int(r.integers(1, 3))])
    names = ["solve", *(p["name"] for p in task["params"]), "out"]
    task["spec_funs"] = [{"name": n, "params": [{"name": "x", "type": "int"}], "body": expression([*names, "x"])} for n in ["f", "g"][: int(r.integers(0, 3))]]
    task["lemmas"] = [header(n, ["u"], False) for n in ["helps", "also"][: int(r.integers(0, 3))]]
    task["methods"] = [header("step", ["s", "t"])] if r.random() < 0.5 else []
    return task


def renamed(e, to):
    """All bound names and the task's spelled anew, fresh at each binder."""
    if isinstance(e, list):
        return [renamed(x, to) for x in e]
    if not isinstance(e, dict):
        return e
    if "var" in e:
        return {"var": to.get(e["var"], e["var"])}
    for k in ("forall", "exists"):
        if k in e:
            q, v = e[k], f"z{next(fresh)}"
            return {k: {"var": v, "lo": renamed(q["lo"], to), "hi": renamed(q["hi"], to), "body": renamed(q["body"], {**to, q["var"]: v})}}
    if "call" in e:
        return {"call": {"fun": to.get(e["call"]["fun"], e["call"]["fun"]), "args": renamed(e["call"]["args"], to)}}
    if "lemma" in e:
        return {"lemma": {"name": to.get(e["lemma"]["name"], e["lemma"]["name"]), "args": renamed(e["lemma"]["args"], to)}}
    return {k: renamed(v, to) for k, v in e.items()}


def disguised(task, top=True, outer=None):
    """The same specification in other names and another order."""
    t = copy.deepcopy(task)
    to = dict(outer or {})
    to |= {p["name"]: f"y{next(fresh)}" for p in t.get("params", [])}
    if "returns" in t:
        to[t["returns"][0]["name"]] = "res"
    if top:
        to[t["name"]] = "other"
        t["name"] = "other"
    for f in ("requires", "ensures"):
        if f in t:
            t[f] = [renamed(e, to) for e in t[f]]
            r.shuffle(t[f])
    for f in ("decreases", "body"):
        if f in t:
            t[f] = renamed(t[f], to)
    for p in [*t.get("params", []), *t.get("returns", [])]:
        p["name"] = to[p["name"]]
    for f, of in (("lemmas", None), ("methods", None), ("spec_funs", to)):
        if top and f in t:
            t[f] = [disguised(m, False, of) for m in t[f]]
    return t


def same(a, b, to, back):
    """Equality under a map of names that holds in both directions."""
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(same(x, y, to, back) for x, y in zip(a, b))
    if not (isinstance(a, dict) and isinstance(b, dict)):
        return type(a) is type(b) and a == b
    name = lambda x, y: to.get(x, ("free", x)) == ("is", y) and back[y] == x or (x not in to and y not in back and x == y)
    for k, f in (("var", None), ("call", "fun"), ("lemma", "name")):
        if k in a or k in b:
            if not (k in a and k in b):
                return False
            return name(a[k], b[k]) if f is None else name(a[k][f], b[k][f]) and same(a[k]["args"], b[k]["args"], to, back)
    for k in ("forall", "exists"):
        if k in a or k in b:
            if not (k in a and k in b):
                return False
            p, q = a[k], b[k]
            inner = {x: y for x, y in to.items() if y != ("is", q["var"])} | {p["var"]: ("is", q["var"])}
            hidden = {x for x, y in to.items() if y == ("is", q["var"]) and x != p["var"]}
            held = {y: x for y, x in back.items() if x != p["var"]} | {q["var"]: p["var"]}
            return same(p["lo"], q["lo"], to, back) and same(p["hi"], q["hi"], to, back) and same(p["body"], q["body"], inner | {x: ("hidden", x) for x in hidden}, held)
    return set(a) == set(b) and all(same(a[k], b[k], to, back) for k in a)


def unchanged(p, d):
    """Exhaustive: some order of the draft's clauses matches, member by member."""

    def level(a, b, outer):
        if [x["type"] for x in a.get("params", [])] != [x["type"] for x in b.get("params", [])] or [x["type"] for x in a.get("returns", [])] != [x["type"] for x in b.get("returns", [])]:
            return False
        pairs = [*outer, *zip((x["name"] for x in a.get("params", [])), (x["name"] for x in b.get("params", []))), *zip((x["name"] for x in a.get("returns", [])), (x["name"] for x in b.get("returns", [])))]
        to, back = {x: ("is", y) for x, y in pairs}, {y: x for x, y in pairs}
        if len({y for _, y in to.values()}) != len(to):
            return False
        for f in ("decreases", "body"):
            if (f in a) != (f in b) or (f in a and not same(a[f], b[f], to, back)):
                return False
        return all(len(a.get(f, [])) == len(b.get(f, [])) and any(all(same(x, y, to, back) for x, y in zip(a.get(f, []), order)) for order in itertools.permutations(b.get(f, []))) for f in ("requires", "ensures"))

    top = [(p["name"], d["name"]), *zip((x["name"] for x in p["params"]), (x["name"] for x in d["params"])), (p["returns"][0]["name"], d["returns"][0]["name"])]
    if not level(p, d, top[:1]):
        return False
    for f, of in (("lemmas", []), ("methods", []), ("spec_funs", top)):
        a, b = ({m["name"]: m for m in t.get(f, [])} for t in (p, d))
        if not set(a) <= set(b) or (f == "spec_funs" and set(a) != set(b)) or not all(level(m, b[n], of) for n, m in a.items()):
            return False
    return True


def altered(task):
    """One thing changed somewhere, or nothing that counts."""
    t = disguised(task)
    k = int(r.integers(0, 9))
    if k == 0 and t["requires"]:
        t["requires"][0] = {"op": "<=", "args": [t["requires"][0]]}
    elif k == 1:
        t["ensures"].append({"int": 1})
    elif k == 2:
        t["params"][0]["type"] = "bool"
    elif k == 3 and t["lemmas"]:
        t["lemmas"].pop()
    elif k == 4:
        t["methods"].append(header("extra", ["q"]))
    elif k == 5 and t["spec_funs"]:
        t["spec_funs"][0]["body"] = {"int": 9}
    elif k == 6:
        t["decreases"] = {"int": 5}
    elif k == 7 and len(t["params"]) > 1:
        t["params"][1]["name"] = t["params"][0]["name"]
    elif k == 8 and t["requires"]:
        t["requires"] = t["requires"][1:] + [copy.deepcopy(t["requires"][-1])]
    return t


def test_changes_equal_exhaustive_matching(spark):
    rows = [(i, p, altered(p)) for i, p in enumerate(spec() for _ in range(400))] + [(400 + i, p, disguised(p)) for i, p in enumerate(spec() for _ in range(100))]
    df = spark.createDataFrame([(i, json.dumps(p), json.dumps(d)) for i, p, d in rows], "id long, prompt string, draft string")
    got = {x.id: x.change for x in specs.changes(df).collect()}
    assert len(got) == 500 and all(got[i] is None for i in range(400, 500))
    assert {i for i in got if got[i] is None} == {i for i, p, d in rows if unchanged(p, d)}
    assert 60 < sum(v is None for v in list(got.values())[:400]) < 340


def test_reasons(spark):
    v = lambda n: {"var": n}
    base = {"name": "t", "params": [{"name": "a", "type": "int"}, {"name": "b", "type": "seq"}], "returns": [{"name": "o", "type": "int"}], "requires": [v("a"), v("b")], "ensures": [], "spec_funs": [{"name": "f", "params": [], "body": v("a")}], "lemmas": [{"name": "l", "params": [], "ensures": [v("x")]}], "methods": []}
    made = lambda **k: json.dumps({**base, **k})
    drafts = {
        "1 parameters, not 2": made(params=base["params"][:1]),
        "parameter 2 has another type": made(params=[base["params"][0], {"name": "b", "type": "int"}]),
        "returns another type": made(returns=[{"name": "o", "type": "seq"}]),
        "lemma l removed": made(lemmas=[]),
        "lemma l: ensures changed": made(lemmas=[{"name": "l", "params": [], "ensures": [v("y")]}]),
        "spec fun g added; spec fun f removed": made(spec_funs=[{"name": "g", "params": [], "body": v("a")}]),
        "spec fun f: definition changed": made(spec_funs=[{"name": "f", "params": [], "body": v("b")}]),
        "spec fun f: names are not renamed one to one": made(params=[{"name": "b", "type": "int"}, {"name": "b", "type": "seq"}], requires=[v("b"), v("b")], spec_funs=base["spec_funs"]),
        "decreases changed": made(decreases=v("a")),
        "requires has 1 clauses, not 2": made(requires=[v("a")]),
        "requires changed": made(requires=[v("a"), v("a")]),
        "the draft can't be read": "{",
    }
    rows = [(i, made(), d) for i, d in enumerate(drafts.values())] + [(90, None, made()), (91, made(), made(requires=[v("b"), v("a")], methods=[{"name": "m", "params": [], "returns": [{"name": "q", "type": "int"}]}])), (92, None, None)]
    got = {x.id: x.change for x in specs.changes(spark.createDataFrame(rows, "id long, prompt string, draft string")).collect()}
    assert got == {**dict(enumerate(drafts)), 90: "the specification can't be read", 91: None, 92: "the specification can't be read"}


def test_changes_read_their_rows_once_and_shuffle_nothing(spark):
    df = spark.range(4).selectExpr("id", "cast(null as string) prompt", "'{' draft")
    plan = specs.changes(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1 and "Exchange" not in plan and "Join" not in plan


def test_spec_changes_shuffles_lines_once(spark, tmp_path):
    rows = "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_discount double, l_tax double"
    lines = [
        (1, 1, 5, 3.0, 0.0, 0.0), (1, 3, 4, 30.0, 0.0, 0.08),  # the second parameter
        (2, 1, 9, 1.0, 0.1, 0.0), (2, 2, 8, 1.0, 0.0, 0.0),  # a bound
        (3, 1, 7, 1.0, 0.0, 0.0), (3, 1, 7, 2.0, 0.0, 0.0),  # nothing
        (4, None, 7, 1.0, 0.1, 0.0), (4, 3, 6, None, None, 0.08),  # the first: a line without a number has no place
        (5, 2, 7, 1.0, None, None), (5, 3, 6, float("nan"), 0.0, 0.0),  # nothing
        (None, 3, 7, 1.0, 0.1, 0.08),  # no place without an order
    ]
    spark.createDataFrame(lines, rows).write.parquet(f"{tmp_path}/lineitem.parquet")
    query = catalog.QUERIES["spec_changes"](spark, str(tmp_path))
    assert query._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {r.id: r.change for r in query.collect()}
    assert got == {1: "parameter 2 has another type", 2: "requires changed", 3: None, 4: "parameter 1 has another type", 5: None, None: "requires changed"}
    sql = catalog.ORACLE_SQL["spec_changes"].replace("from lineitem", f"from '{tmp_path}/lineitem.parquet/*.parquet'")
    assert set(got.items()) == set(duckdb.sql(sql).fetchall())
