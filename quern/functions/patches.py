"""JSON differences (add, remove, replace by path), applied in order."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _step(key) -> str:
    return str(key).replace("~", "~0").replace("/", "~1")


def diff(old, new, path: str = "") -> list[dict]:
    """Operations that turn `old` into `new`; list tails are removed from the end."""
    if isinstance(old, dict) and isinstance(new, dict):
        out = []
        for key in old:
            at = f"{path}/{_step(key)}"
            out += diff(old[key], new[key], at) if key in new else [{"op": "remove", "path": at}]
        return out + [{"op": "add", "path": f"{path}/{_step(k)}", "value": v} for k, v in new.items() if k not in old]
    if isinstance(old, list) and isinstance(new, list):
        both = min(len(old), len(new))
        out = [op for i in range(both) for op in diff(old[i], new[i], f"{path}/{i}")]
        out += [{"op": "remove", "path": f"{path}/{i}"} for i in range(len(old) - 1, both - 1, -1)]
        return out + [{"op": "add", "path": f"{path}/{i}", "value": new[i]} for i in range(both, len(new))]
    same = type(old) is type(new) and old == new
    return [] if same else [{"op": "replace", "path": path, "value": new}]


def apply(document, operations: list[dict]):
    """`document` after the operations; it is not changed itself."""
    document = json.loads(json.dumps(document))
    for op in operations:
        steps = [s.replace("~1", "/").replace("~0", "~") for s in op["path"].split("/")[1:]]
        if not steps:
            document = op["value"]
            continue
        place = document
        for s in steps[:-1]:
            place = place[int(s)] if isinstance(place, list) else place[s]
        last = steps[-1]
        if isinstance(place, list):
            if op["op"] == "remove":
                del place[int(last)]
            elif op["op"] == "add":
                place.insert(int(last), op["value"])
            else:
                place[int(last)] = op["value"]
        elif op["op"] == "remove":
            del place[last]
        else:
            place[last] = op["value"]
    return document


def _parsed(text):
    try:
        return json.loads(text) if text else {}
    except ValueError:
        return {}


def json_diff(old: Column, new: Column) -> Column:
    """The difference of two JSON texts as JSON; null or malformed texts count as {}."""

    @F.pandas_udf("string")
    def run(old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(diff(_parsed(a), _parsed(b))) for a, b in zip(old, new)])

    return run(old, new)


def changed_fields(old: Column, new: Column) -> Column:
    """Sorted top-level keys that were added, removed or got another value."""
    kind = "map<string,string>"
    empty = F.from_json(F.lit("{}"), kind)
    a, b = F.coalesce(F.from_json(old, kind), empty), F.coalesce(F.from_json(new, kind), empty)
    both = F.map_zip_with(a, b, lambda k, x, y: F.struct(x.alias("x"), y.alias("y")))
    changed = F.map_filter(both, lambda k, v: ~v["x"].eqNullSafe(v["y"]) | ~(F.map_contains_key(a, k) & F.map_contains_key(b, k)))
    return F.array_sort(F.map_keys(changed))


def equal(a: Column, b: Column) -> Column:
    """Whether two JSON texts state the same: objects in any order of keys, lists in theirs; null is {}."""

    @F.pandas_udf("boolean")
    def same(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_same(_parsed(i), _parsed(j)) for i, j in zip(x, y)])

    return same(a, b)


def _same(a, b) -> bool:
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    return isinstance(a, bool) == isinstance(b, bool) and a == b
