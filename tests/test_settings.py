from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from bidloom import shared
from bidloom.operators import settings as S


def laid_over(low, up):
    """Objects merge, anything else is replaced."""
    if not (isinstance(low, dict) and isinstance(up, dict)):
        return up
    return {k: laid_over(low[k], up[k]) if k in low and k in up else up.get(k, low.get(k)) for k in {**low, **up}}


LOWER = {
    1: {"a": 1, "b": {"c": {"d": [1, {"x": 2}], "e": "s"}, "f": None}, "g": {}},
    2: {"a": {"b": 1, "c": 2}},
    3: {"a": 5, "k": {"l": {"m": 1}}},
    4: {"only": "lower", "quote\" and \\ 名": {"ü": True}},
    6: {"deep": {"er": {"est": 1}}, "list": [1, 2, 3]},
    7: {},
    8: 5,
}
UPPER = {
    1: {"b": {"c": {"d": [9], "n": 1.5}, "f": {"new": 1}}, "g": {"h": 2}, "z": {}},
    2: {"a": {}, "c": {}},
    3: {"a": {"now": "object"}, "k": {"l": 7}},
    5: {"only": {"upper": [None, {"q": None}]}},
    6: {"deep": {"er": None}, "list": {}},
    7: {"a": {"b": {}}},
    8: {"a": 1},
}


def docs(spark, rows):
    return spark.createDataFrame([(k, json.dumps(v, ensure_ascii=False)) for k, v in rows.items()], "key int, t string").select("key", F.parse_json("t").alias("doc"))


def back(df):
    return {r.key: json.loads(r.t) for r in df.select("key", F.to_json("doc").alias("t")).collect()}


def test_documents_come_back_from_their_leaves(spark):
    assert back(S.documents(S.leaves(docs(spark, LOWER)))) == LOWER
    paths = {(tuple(r.path), r.leaf) for r in S.leaves(docs(spark, {1: LOWER[1]})).collect()}
    assert paths == {(("a",), "1"), (("b", "c", "d"), '[1,{"x":2}]'), (("b", "c", "e"), '"s"'), (("b", "f"), "null"), (("g",), "{}")}
    none = docs(spark, {1: 1}).where("false")
    assert S.documents(S.leaves(none)).count() == 0


def test_overlay_is_recursive(spark):
    want = {k: laid_over(LOWER[k], UPPER[k]) if k in LOWER and k in UPPER else LOWER.get(k, UPPER.get(k)) for k in LOWER | UPPER}
    assert back(S.merged(docs(spark, LOWER), docs(spark, UPPER))) == want
    assert back(S.merged(docs(spark, UPPER), docs(spark, LOWER))) == {k: laid_over(UPPER[k], LOWER[k]) if k in LOWER and k in UPPER else LOWER.get(k, UPPER.get(k)) for k in LOWER | UPPER}


def test_too_deep_settings_are_refused(spark, monkeypatch):
    monkeypatch.setattr(S, "DEEPEST", 3)
    with pytest.raises(ValueError, match="deeper"):
        S.leaves(docs(spark, {1: {"a": {"b": {"c": {"d": 1}}}}}))


def test_registry(spark):
    given = {
        1: {"广材网": {"name": "mine", "login_url": ""}, "gldjc": {"limits": {"day": 3}}, "other": {"home_url": "https://o"}},
        2: {"JD": {"search_url_template": "https://t/{query}", "handler": "generic"}, "full": {"home_url": "https://h", "search_url": "https://s"}},
        3: {},
    }
    rows = spark.createDataFrame([(k, json.dumps(v, ensure_ascii=False)) for k, v in given.items()], "user int, t string").select("user", F.parse_json("t").alias("doc"))
    got = {(r.user, r.platform): r for r in S.registry(S.defaults(spark), rows).collect()}
    assert len(got) == 3 * 7 + 2
    a, o, j, f, g = got[1, "guangcai"], got[1, "other"], got[2, "jd"], got[2, "full"], got[3, "guangcai"]
    assert (a.name, a.login_url, a.handler, a.requires_config) == ("mine", "https://www.gldjc.com/login", "gldjc", False)
    assert (o.name, o.login_url, o.search_url, o.handler, o.requires_config) == ("other", "https://o", "", "generic", True)
    assert (j.name, j.search_url, j.handler) == ("京东", "https://t/{query}", "generic")
    assert (f.login_url, f.search_url, f.requires_config) == ("https://h", "https://s", False)
    assert g.name == "广材网" and {u for u, _ in got} == {1, 2, 3}


def test_no_settings_of_users_are_sent_whole(spark, monkeypatch):
    given = {1: {"jd": {"a": {"b": 1}, "e": {}}}, 2: {"京东": {"a": 2}, "own": {"a": {"b": None}}}, 3: {}, None: {"jd": {"a": {"c": 3}}}, 4: None}
    rows = spark.createDataFrame([(k, v and json.dumps(v, ensure_ascii=False)) for k, v in given.items()], "user int, t string").select("user", F.parse_json("t").alias("doc"))
    known = spark.createDataFrame([("jd", '{"name":"JD","a":{"b":0,"c":[1]}}'), ("yize", '{"a":{"b":7},"e":{"f":null}}')], "platform string, t string").select("platform", F.parse_json("t").alias("doc"))
    plans, own = [], shared.cut
    monkeypatch.setattr(shared, "cut", lambda df, *name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or own(df, *name))
    found = S.registry(shared.cut(known, "known"), shared.cut(rows, "given"))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    # Only the known platforms, found by their names, are sent.
    sent = [line for p in plans for line in p.splitlines() if "BroadcastExchange" in line]
    assert sent and all("HashedRelationBroadcastMode(List(input[0, string" in line for line in sent)
    jd = {1: {"a": {"b": 1, "c": [1]}, "e": {}}, 2: {"a": 2}, None: {"a": {"b": 0, "c": 3}}}
    want = {(u, "jd"): {"name": "JD", "a": {"b": 0, "c": [1]}} | jd.get(u, {}) for u in given} | {(u, "yize"): {"a": {"b": 7}, "e": {"f": None}} for u in given} | {(2, "own"): {"a": {"b": None}}}
    got = found.select("user", "platform", F.to_json("doc").alias("t")).collect()
    assert len(got) == len(want) and {(r.user, r.platform): json.loads(r.t) for r in got} == want
    assert [json.loads(r.t) for r in found.where("platform = 'own'").select(F.to_json("doc").alias("t")).collect()] == [want[2, "own"]]


def test_overlays_meet_in_shuffles(spark, monkeypatch):
    plans, own = [], shared.cut
    monkeypatch.setattr(shared, "cut", lambda df, *name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or own(df, *name))
    assert S.merged(docs(spark, LOWER), docs(spark, UPPER)).count() == len(LOWER | UPPER)
    assert "SortMergeJoin" in plans[-1] and not any("Broadcast" in p for p in plans)
