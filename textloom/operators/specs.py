"""Comparison of parsed specifications up to renaming of bound names and order of clauses.

A specification is JSON: name, params [{name, type}], returns [{name, type}], requires and ensures (lists of
expressions), decreases, spec_funs, and lemmas and methods with the same fields of their own.  Expressions bind
names by {"forall" | "exists": {var, lo, hi, body}} and use them by {"var": name}, {"call": {fun, args}} and
{"lemma": {name, args}}.

Each clause gets a canonical form, in which a name of the header is its place there and a quantifier's name is the
depth that binds it (the form is kept without the places, as clauses recur), so clauses equal up to renaming have equal digests, and two lists of clauses match one to one
in some order exactly if their sorted digests are equal.  A small helper makes the digests and hands on
the members of both sides, by name, that are not the same; the first difference in a fixed order is the reason.  Unlike a comparison that carries a map
of names, a free name never equals a bound one that happens to be spelled alike.
"""

from __future__ import annotations

import functools
import hashlib
import json
import marshal
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEMBER = {"ord": pa.int32(), "params": pa.list_(pa.string()), "returns": pa.string(), "decreases": pa.string(), "requires": pa.list_(pa.string()), "ensures": pa.list_(pa.string()), "body": pa.string()}
_FIELDS = "struct<ord int, params array<string>, returns string, decreases string, requires array<string>, ensures array<string>, body string>"
#: Members of both specifications by kind and name, null where a side has none.
MEMBERS = f"array<struct<kind string, name string, one_to_one boolean, p {_FIELDS}, d {_FIELDS}>>"
#: Kinds in the order in which they are compared.
KINDS = {"lemma": "lemmas", "method": "methods", "spec fun": "spec_funs"}


_plain = json.JSONEncoder(sort_keys=True).encode
_text = json.JSONEncoder(sort_keys=True, ensure_ascii=False).encode


def canonical(expression, bound: dict[str, str], free: dict[str, int], depth: int = 0):
    """The expression with names replaced by the quantifier that binds them, or else by their order of appearance in ``free``."""
    if isinstance(expression, list):
        return [canonical(x, bound, free, depth) for x in expression]
    if not isinstance(expression, dict):
        return expression

    def use(name):
        if not isinstance(name, str):
            raise ValueError("a declaration stands where an expression should")
        return bound.get(name) or f"free {free.setdefault(name, len(free))}"

    if "var" in expression:
        return ["use", use(expression["var"])]
    for kind in ("forall", "exists"):
        if kind in expression:
            q = expression[kind]
            inner = {**bound, q["var"]: f"bound {depth}"}
            return [kind, canonical(q.get("lo"), bound, free, depth), canonical(q.get("hi"), bound, free, depth), canonical(q["body"], inner, free, depth + 1)]
    for kind, field in (("call", "fun"), ("lemma", "name")):
        if kind in expression:
            c = expression[kind]
            return [kind, use(c[field]), canonical(c.get("args", []), bound, free, depth)]
    return {"fields": {k: canonical(v, bound, free, depth) for k, v in expression.items()}}


def shape(expression) -> tuple[str, tuple[str, ...]]:
    """The digest of an expression whose names are taken away, and those that it doesn't bind itself."""
    free: dict[str, int] = {}
    plain = _text(canonical(expression, {}, free))
    return hashlib.sha256(plain.encode()).hexdigest()[:32], tuple(free)


@functools.lru_cache(1 << 16)
def _kept_shape(dumped: bytes) -> tuple[str, tuple[str, ...]]:
    """Clauses recur from one specification to another; what falls out of the cache is made anew."""
    return shape(marshal.loads(dumped))


def digest(expression, places: dict[str, str]) -> str:
    """The shape with the places in the header of the names it uses; a name that the header lacks stays as itself."""
    try:
        dumped = marshal.dumps(expression, 2)  # version 2 writes values whole, without references
    except ValueError:  # nested too deep for marshal
        dumped = None
    found, names = shape(expression) if dumped is None else _kept_shape(dumped)
    return " ".join([found, *[places.get(n) or _plain(n) for n in names]])


def _member(kind: str, at: int, m: dict, outer: tuple[str, ...], returned: bool, body: bool) -> tuple:
    params = m.get("params", [])
    names = (*outer, *[p["name"] for p in params], *([m["returns"][0]["name"]] if returned else []))
    places = {n: str(i) for i, n in enumerate(names)}
    clauses = lambda f: sorted([digest(c, places) for c in m.get(f, ())])
    return (names, at, [_plain(p["type"]) for p in params], _plain(m["returns"][0]["type"]) if returned else None, digest(m["decreases"], places) if "decreases" in m else None, clauses("requires"), clauses("ensures"), digest(m["body"], places) if body else None)


def parts_of(spec: str | None) -> dict[tuple[str, str], tuple] | None:
    """The task and its members by kind and name (the last of a name stands); None of what can't be read."""
    try:
        task = json.loads(spec or "")
        own = _member("task", 0, task, (task["name"],), True, False)
        found = {("task", ""): own}
        for kind, field in KINDS.items():
            for i, m in enumerate(task.get(field, ())):
                if not isinstance(m["name"], str):
                    raise ValueError("a member's name is no text")
                found[kind, m["name"]] = _member(kind, i, m, own[0] if kind == "spec fun" else (), kind == "method", kind == "spec fun")
        return found
    except (ValueError, KeyError, TypeError, IndexError, AttributeError):
        return None


def _one_to_one(p: tuple[str, ...], d: tuple[str, ...]) -> bool:
    """No two names of the specification, each as it is seen inside, go by one name in the draft."""
    to = dict(zip(p, d))
    return len(set(to.values())) == len(to)


def _apart(p: dict[tuple[str, str], tuple], d: dict[tuple[str, str], tuple]) -> Iterator[tuple]:
    """(kind and name, one to one, member, member) of those that are not the same on both sides."""
    for key in p if p.keys() == d.keys() else p | d:
        a, b = p.get(key), d.get(key)
        one = a is not None and b is not None and _one_to_one(a[0], b[0])
        if not (one and a[2:] == b[2:]):
            yield key, one, a, b


def _side(members: list[tuple | None]) -> pa.Array:
    columns = list(zip(*(m[1:] if m else (None,) * len(MEMBER) for m in members))) or [()] * len(MEMBER)
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, MEMBER.values())], list(MEMBER), mask=pa.array([m is None for m in members], pa.bool_()))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, ends, p_read, d_read = [], [0], [], []
        for prompt, draft in zip(*(batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))):
            p, d = parts_of(prompt), parts_of(draft)
            p_read.append(p is not None)
            d_read.append(d is not None)
            if p is not None and d is not None:
                rows.extend(_apart(p, d))
            ends.append(len(rows))
        keys, ones, ps, ds = zip(*rows) if rows else ((), (), (), ())
        members = pa.StructArray.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([n for _, n in keys], pa.string()), pa.array(ones, pa.bool_()), _side(ps), _side(ds)], ["kind", "name", "one_to_one", "p", "d"])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p_read, pa.bool_()), pa.array(d_read, pa.bool_()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), members)], names=["id", "p_read", "d_read", "members"])


def _clauses(p: Column, d: Column, field: str) -> Column:
    return F.when(F.size(d[field]) != F.size(p[field]), F.concat(F.lit(f"{field} has "), F.size(d[field]).cast("string"), F.lit(" clauses, not "), F.size(p[field]).cast("string"))).when(d[field] != p[field], f"{field} changed")


def _told(m: Column) -> Column:
    """What a member's header and its clauses have to say, with the places in the order of comparison."""
    p, d, name = m["p"], m["d"], m["name"]
    is_fun, is_task = m["kind"] == "spec fun", m["kind"] == "task"
    called = F.concat_ws(" ", m["kind"], name)
    of = lambda text: F.concat(F.when(is_task, "").otherwise(F.concat(called, F.lit(": "))), text)
    first_type = F.array_position(F.zip_with(p["params"], d["params"], lambda a, b: a != b), True)
    header = F.when(F.size(p["params"]) != F.size(d["params"]), F.concat(F.size(d["params"]).cast("string"), F.lit(" parameters, not "), F.size(p["params"]).cast("string")))
    header = header.when(p["params"] != d["params"], F.concat(F.lit("parameter "), first_type.cast("string"), F.lit(" has another type"))).when(~p["returns"].eqNullSafe(d["returns"]), "returns another type")
    clauses = F.coalesce(F.when(~m["one_to_one"], "names are not renamed one to one"), F.when(~p["body"].eqNullSafe(d["body"]), "definition changed"), F.when(~p["decreases"].eqNullSafe(d["decreases"]), "decreases changed"), _clauses(p, d, "requires"), _clauses(p, d, "ensures"))
    there = p.isNotNull() & d.isNotNull()
    place = F.when(m["kind"] == "lemma", 1).when(m["kind"] == "method", 2).otherwise(3)
    ordered = F.when(d.isNull(), -1).otherwise(p["ord"])
    return F.array(
        F.struct(F.when(is_task, 0).otherwise(place).alias("stage"), ordered.alias("ord"), name.alias("name"), F.lit(0).alias("part"), F.when(there, of(header)).when(p.isNotNull() & ~is_fun, F.concat(called, F.lit(" removed"))).alias("why")),
        F.struct(F.when(is_task, 4).otherwise(place).alias("stage"), ordered.alias("ord"), name.alias("name"), F.lit(1).alias("part"), F.when(there, of(clauses)).alias("why")),
    )


def changes(df: DataFrame, prompt: str = "prompt", draft: str = "draft") -> DataFrame:
    """(id, change): the first way in which a draft departs from the prompt's specification, null if in none.

    Members that only the draft has are allowed, but for spec funs.  Bodies of lemmas and methods don't count.
    ``df`` has an id and the two specifications; one that can't be read is a change of its own.  Rows are compared
    where they are: ``df`` is read once and nothing is shuffled.
    """
    both = df.select("id", prompt, draft).mapInArrow(_members, f"id {df.schema['id'].dataType.simpleString()}, p_read boolean, d_read boolean, members {MEMBERS}")
    told = F.filter(F.flatten(F.transform("members", _told)), lambda t: t["why"].isNotNull())
    funs = lambda side: F.array_sort(F.transform(F.filter("members", lambda m: (m["kind"] == "spec fun") & m[side].isNull()), lambda m: m["name"]))
    said = lambda names, what: F.transform(names, lambda n: F.concat(F.lit("spec fun "), n, F.lit(what)))
    rows = both.select("id", "p_read", "d_read", F.array_min(told).alias("first"), F.concat_ws("; ", said(funs("p"), " added"), said(funs("d"), " removed")).alias("funs"))
    why = F.when(~F.col("p_read"), "the specification can't be read").when(~F.col("d_read"), "the draft can't be read").when((F.col("funs") != "") & (F.col("first").isNull() | (F.col("first.stage") >= 3)), F.col("funs")).otherwise(F.col("first.why"))
    return rows.select("id", why.alias("change"))
