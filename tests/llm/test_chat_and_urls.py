"""Chat formatting, URL filters and the pipeline."""

import json
import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from glyphmill.llm import catalog, chat, urls

TOOLS = {"tools": [{"name": "f", "parameters": {"type": "object", "properties": {"x": {"type": "integer", "minimum": 0}, "u": {"type": ["string", "null"], "enum": ["a", "b", None]}}, "required": ["x"], "additionalProperties": False}}]}


def call(i, name="f", **args):
    return {"id": i, "name": name, "arguments": args}


@pytest.fixture(scope="module")
def talk(spark):
    calls = {"content": "go", "tool_calls": [call("b", x=1, u="a", **{}) | {"depends_on": ["a"]}, {"id": "a", "type": "function", "function": {"name": "f", "arguments": '{"x": 2.0}'}}, call("c", x=-1, z=1), call("d", "g"), call("b", x=3), {"name": "f", "arguments": 5}]}
    rows = [
        (1, 0, "system", json.dumps(TOOLS)), (1, 1, "user", 'hi "there"\nnew'), (1, 2, "assistant", json.dumps(calls)),
        (1, 3, "tool", json.dumps({"tool_call_id": "b", "content": {"z": 1, "a": [1.50, None]}})), (1, 4, "tool", json.dumps({"tool_call_id": "a", "content": "ok"})),
        (1, 5, "tool", json.dumps({"tool_call_id": "zz", "content": "?"})), (1, 6, "tool", json.dumps({"tool_call_id": "a", "content": "again"})),
        (2, 0, "user", None), (None, None, None, "x"), (2, 0, "user", None), (2, 1, "assistant", "{bad json"), (2, 2, "tool", json.dumps({"tool_call_id": "late", "content": 1})), (2, 3, "assistant", json.dumps({"tool_calls": [call("late", "h")]})),
        (3, 0, "assistant", json.dumps({"tool_calls": [call("p", "h", v="$result:q"), call("q", "h", v="$result:p"), call("r", "h", v="$result:q")]})), (4, 0, "user", "long " * 60_000),
    ]
    return spark.createDataFrame([(*r, "extra") for r in rows], "conv_id bigint, turn bigint, role string, text string, message string")


def test_links_levels_and_faults(talk):
    got = {(r["conv_id"], r["id"], r["place"], r["result_turn"]): (r["level"], r["status"], r["problems"]) for r in chat.linked_calls(talk).collect()}
    assert got == {
        (1, "b", 0, 3): (1, "ok", ""), (1, "a", 1, 4): (0, "ok", ""), (1, "c", 2, None): (0, "invalid_arguments", "x: out of range; z: not in the schema"),
        (1, "d", 3, None): (0, "unknown_tool", ""), (1, "b", 4, None): (1, "duplicate_id", ""), (1, None, 5, None): (0, "no_id", "arguments are not an object"),
        (1, "zz", None, 5): (None, "orphan_result", ""), (1, "a", None, 6): (None, "duplicate_result", ""), (2, "late", 0, 2): (0, "early_result", ""),
        (3, "p", 0, None): (-1, "cycle", ""), (3, "q", 1, None): (-1, "cycle", ""), (3, "r", 2, None): (-1, "cycle", ""),
    }


def test_messages_are_canonical_and_in_order(talk):
    rows = sorted(chat.format_chat(talk).collect(), key=lambda r: (r["conv_id"] or 0, r["order_turn"] or 0, r["order_level"], r["order_place"]))
    assert len(rows) == talk.count()
    for r in rows:
        assert json.dumps(json.loads(r["json"]), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r["json"]
    calls = json.loads(next(r["json"] for r in rows if r["conv_id"] == 1 and r["turn"] == 2))["tool_calls"]
    assert [c.get("id") for c in calls] == ["a", "c", "d", None, "b", "b"] and calls[0]["arguments"] == {"x": 2}
    late = [r["turn"] for r in rows if r["conv_id"] == 2]
    assert late.index(2) > late.index(3)
    assert Counter(r["status"] for r in rows)["ok"] == 9
    assert [r["n_linked"] for r in rows if r["conv_id"] == 1] == [0, 0, 2, 1, 1, 0, 0]


def test_chat_of_few_rows(talk):
    assert chat.format_chat(talk.where("false")).count() == 0 and chat.linked_calls(talk.where("false")).count() == 0


def test_wrong_types_and_lists(spark):
    kinds = {"s": "string", "i": "integer", "n": "number", "b": "boolean", "o": "object", "a": "array", "z": "null"}
    values = {"s": "x", "i": 3, "n": 1.5, "b": True, "o": {"k": 1}, "a": [1], "z": None}
    tools = {"tools": [{"function": {"name": k, "parameters": {"properties": {"v": {"type": t}}}}} for k, t in kinds.items()]}
    fits = {("n", "i"), *((k, k) for k in kinds)}
    calls = [call(f"{k}{v}", k, v=value) for k in kinds for v, value in values.items()]
    df = spark.createDataFrame([(1, 0, "system", json.dumps(tools)), (1, 1, "assistant", json.dumps({"tool_calls": calls}))], "conv_id bigint, turn bigint, role string, text string")
    got = {r["id"]: r["problems"] for r in chat.linked_calls(df).collect()}
    assert got == {f"{k}{v}": "" if (k, v) in fits else "v: wrong type" for k in kinds for v in values}


def test_nested_schemas(spark):
    """Against a plain recursive check."""
    schema = {
        "properties": {
            "tags": {"type": "array", "items": {"type": "integer", "minimum": 1}, "minItems": 1, "maxItems": 3},
            "who": {"type": "object", "required": ["name"], "additionalProperties": False, "properties": {"name": {"type": "string", "minLength": 2, "maxLength": 4}, "deep": {"properties": {"er": {"items": {"const": {"a": [1]}}}}}}},
            "n": {"exclusiveMinimum": 0, "exclusiveMaximum": 1.5},
        },
        "additionalProperties": {"enum": ["p", 2, None]},
    }
    given = [
        {"tags": [1, 2]}, {"tags": []}, {"tags": [0, "a", 2.0, 3]}, {"tags": "no"}, {"who": {}}, {"who": {"name": "a", "other": 1}}, {"who": {"name": "abcde"}}, {"who": {"name": "abc", "deep": {"er": [{"a": [1]}, {"a": [2]}, 1]}}},
        {"n": 0}, {"n": 1.5}, {"n": 1}, {"n": "5"}, {"x": "p", "y": 2, "z": None, "w": "q"}, {}, {"who": None, "tags": None},
    ]
    kinds = {"array": list, "object": dict, "string": str, "integer": int}

    def faults(v, s, path):
        shown, before, out = path or "arguments", path + "." if path else "", []
        if "type" in s and not (isinstance(v, kinds[s["type"]]) or (s["type"] == "integer" and isinstance(v, float) and v == int(v))):
            out.append(f"{shown}: wrong type")
        if "enum" in s and v not in s["enum"]:
            out.append(f"{shown}: not in the list")
        if "const" in s and v != s["const"]:
            out.append(f"{shown}: not the constant")
        if isinstance(v, (int, float)) and not (v >= s.get("minimum", v) and v > s.get("exclusiveMinimum", v - 1) and v < s.get("exclusiveMaximum", v + 1)):
            out.append(f"{shown}: out of range")
        if isinstance(v, str) and not s.get("minLength", 0) <= len(v) <= s.get("maxLength", 99):
            out.append(f"{shown}: wrong length")
        if isinstance(v, list):
            if not s.get("minItems", 0) <= len(v) <= s.get("maxItems", 99):
                out.append(f"{shown}: wrong number of items")
            for i, x in enumerate(v):
                out += faults(x, s.get("items", {}), f"{path}[{i}]")
        if isinstance(v, dict):
            out += [f"{before}{n}: missing" for n in s.get("required", []) if n not in v]
            for n, x in v.items():
                rule = s.get("properties", {}).get(n, s.get("additionalProperties", {}))
                out += [f"{before}{n}: not in the schema"] if rule is False else faults(x, rule, before + n)
        return out

    calls = [call(str(i), "g", **args) for i, args in enumerate(given)]
    df = spark.createDataFrame([(1, 0, "system", json.dumps({"tools": [{"name": "g", "parameters": schema}]})), (1, 1, "assistant", "\n " + json.dumps({"tool_calls": calls}))], "conv_id bigint, turn bigint, role string, text string")
    got = {int(r["id"]): r["problems"] for r in chat.linked_calls(df).collect()}
    assert got == {i: "; ".join(sorted(faults(v, schema, ""))) for i, v in enumerate(given)} and sum(map(bool, got.values())) > 8


def test_chat_of_the_table_uses_no_python(spark, data):
    made = catalog.op8_chat_format(spark, data)
    assert not re.search("Python|Arrow|Pandas", made._jdf.queryExecution().toString())
    rows = {(r["conv_id"], r["turn"]): r for r in made.collect()}
    for r in spark.read.parquet(f"{data}/conversations.parquet").collect():
        assert json.loads(rows[r["conv_id"], r["turn"]]["json"]) == {"content": r["text"], "role": r["role"]}


# ---- URLs


def judged(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[1:] if fit else (None, None))


def test_given_rules_on_the_table_and_odd_urls(spark, data):
    odd = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/x?y", "https://example.com", "http://example.com?/en/", "http://notexample.com/en/", "x://www.example.com/en/#/", "http://a.net/es/://b", "http://u@net/fr/x", "http://net:80/fr/"]
    pages = spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url").union(spark.createDataFrame([(10_000 + i, u) for i, u in enumerate(odd)] * 2, "page_id bigint, url string"))
    got = urls.judge(pages, catalog.URL_RULES, []).collect()
    assert len(got) == pages.count()
    by_id = {r["page_id"]: r["url"] for r in pages.collect()}
    for r in got:
        host, path, rule, verdict = judged(by_id[r["page_id"]], catalog.URL_RULES)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow"), by_id[r["page_id"]]
    assert catalog.op9_url_filter(spark, data).count() == spark.read.parquet(f"{data}/pages.parquet").count()
    assert urls.judge(pages.where("false"), catalog.URL_RULES, []).count() == 0


def test_mined_rules_against_brute_force(spark):
    from itertools import combinations

    rng = random.Random(8)
    rows = []
    for i in range(1500):
        spam = rng.random() < 0.3
        host = rng.choice(["win-pills.example.org", "news.example.org", "blog.example.org"] if spam else ["news.example.org", "shop.example.org"])
        path = rng.choice(["deal", "story"]) if spam else rng.choice(["story", "item"])
        rows.append((f"http://{host}/{path}/{i}", int(spam) if rng.random() < 0.95 else int(not spam)))
    df = spark.createDataFrame([(u, b, i, "x") for i, (u, b) in enumerate(rows)], "url string, bad int, items int, page_id string")
    mined = urls.mine(df, min_support=0.05)
    n_bad = sum(b for _, b in rows)
    least = max(urls.MIN_COUNT, math.ceil(0.05 * n_bad))
    have, where = [set(urls.url_tokens(u)) for u, _ in rows], {}
    for i, h in enumerate(have):
        for t in h:
            where.setdefault(t, set()).add(i)
    same = {}
    for t, pages in where.items():
        if sum(rows[i][1] for i in pages) >= least:
            same.setdefault(frozenset(pages), []).append(t)
    tokens = sorted(max(ts, key=lambda t: (len(t), t)) for ts in same.values())
    good = {}
    for k in range(1, len(tokens) + 1):
        for c in combinations(tokens, k):
            every = [rows[i][1] for i in set.intersection(*(where[t] for t in c))]
            if sum(every) >= least:
                if urls.lower_bound(sum(every), len(every)) >= urls.MIN_CONFIDENCE:
                    good[c] = urls.lower_bound(sum(every), len(every))
    assert {m[0] for m in mined} == {c for c in good if not any(good.get(s, -1) >= good[c] for k in range(1, len(c)) for s in combinations(c, k))} and mined
    found = urls.judge(spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id bigint, url string"), [], mined).collect()
    for r in found:
        assert (r["verdict"] == "block") == any(set(m[0]) <= set(urls.url_tokens(rows[r["page_id"]][0])) for m in mined)
    blocked = {r["page_id"] for r in found if r["verdict"] == "block"}
    assert sum(rows[i][1] for i in blocked) > 0.85 * len(blocked)
    assert urls.mine(spark.createDataFrame([], "url string, bad int")) == []


def test_many_tokens_of_the_same_bad_pages(spark):
    """Each bad page lacks another of 30 names: a thousand million combinations are frequent, and 30 rules say as much."""
    names = [f"n{k}" for k in range(30)]
    rows = [("http://a.example.org/?" + "&".join(n for n in names if n != names[i % 30]), 1) for i in range(120)] + [(f"http://a.example.org/?x{i % 7}", 0) for i in range(300)]
    began = time.time()
    mined = urls.mine(spark.createDataFrame(rows, "url string, bad int"))
    assert {m[0] for m in mined} == {(f"query={n}",) for n in names} and all(m[2] == 116 for m in mined)
    assert time.time() - began < 60


def test_few_pages_prove_nothing(spark):
    assert urls.lower_bound(3, 3) < urls.MIN_CONFIDENCE < urls.lower_bound(5, 5) < urls.lower_bound(50, 50) < 1
    rows = [("http://a.org/seldom", 1)] * 3 + [("http://a.org/often", 1)] * 30 + [("http://b.org/often", 0)] * 30
    mined = {m[0] for m in urls.mine(spark.createDataFrame(rows, "url string, bad int"))}
    assert not any("path0=seldom" in m for m in mined) and any(m == ("host=a.org",) for m in mined)


def test_long_urls_and_long_combinations_count(spark):
    """A page is told by a part far down its path, by its 20th query name, or by four tokens together."""
    deep = lambda x: "http://a.b.c.d.e.f.example.org/" + "/".join(f"p{'x' * 80}{i}" for i in range(9)) + f"/{x}?" + "&".join(f"q{i}=1" for i in "abcdefghijklmnopqrs")
    rows = [(deep("good") + f"&{t}=2", int(t == "bad")) for t in ("bad", "fine") for _ in range(30)]
    names = ["u", "v", "w", "x"]
    for mask in range(16):
        rows += [("http://other.example.com/s?" + "&".join(n for k, n in enumerate(names) if mask >> k & 1), int(mask == 15))] * 12
    mined = urls.mine(spark.createDataFrame(rows, "url string, bad int"))
    combos = {m[0] for m in mined}
    assert any("query=bad" in c for c in combos) and any({f"query={n}" for n in names} <= set(c) for c in combos)
    pages = spark.createDataFrame([(None if i % 5 == 0 else i, u, "rule", i, 0) for i, (u, _) in enumerate(rows)] + [(None, None, None, None, None)], "page_id bigint, url string, host string, rule int, verdict int")
    found = urls.judge(pages, [], mined).collect()
    assert len(found) == len(rows) + 1 and Counter(r["verdict"] for r in found)["block"] == sum(b for _, b in rows) and all(r["rule"] is None for r in found)


def test_labels_speak_of_the_page_s_own_text(spark, data):
    from glyphmill.llm import html, quality

    docs, labels, pages = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels", "pages"))
    model = quality.train(docs, labels)
    odd = pages.select("page_id", "url", "html").union(spark.createDataFrame([(None, "u", None), (7, None, "")], "page_id bigint, url string, html string")).withColumn("bad", F.lit("x")).withColumn("text", F.lit(3))
    got = Counter((r["page_id"], r["bad"]) for r in urls.labelled_pages(odd, model).collect())
    expected = Counter((r["page_id"], int(model.scores(quality.features([html.main_text(r["html"] or "").encode()]))[0] < quality.GOOD)) for r in odd.collect())
    assert got == expected and len({b for _, b in got}) == 2


# ---- the pipeline


def test_pipeline_keeps_columns_and_does_each_stage(spark, data):
    from glyphmill.llm import decontaminate, quality, similar

    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("labels", "benchmark"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    kept = corpus_pipeline.good_documents(spark, docs, data)
    good = {r["doc_id"] for r in quality.classify(docs, labels).where("predicted = 1").collect()}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == good
    single = corpus_pipeline.one_of_each_group(spark, kept, data)
    ids = {r["doc_id"] for r in similar.classes(kept).where("doc_id = component_id").collect()}
    assert single.columns == docs.columns and {r["doc_id"] for r in single.collect()} == ids
    clean = corpus_pipeline.without_benchmarks(spark, single, data)
    leaked = {r["doc_id"] for r in decontaminate.leaks(single, bench).collect()}
    left = {r["doc_id"] for r in clean.collect()}
    assert clean.columns == docs.columns and left == ids - leaked and leaked
    packed = corpus_pipeline.run(spark, data).toPandas()
    assert set(packed["doc_id"]) == left


# ---- chat: JSON of any size, numbers, and long chains


def say(spark, *texts, schema=None):
    rows = [(1, 0, "system", json.dumps({"tools": [{"name": "f", "parameters": schema or {}}]}))] + [(1, k, "assistant" if '"tool_calls"' in t[:60_000] or '"tool_calls"' in t[-60_000:] else "tool", t) for k, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def test_calls_beside_long_strings_are_linked(spark, tmp_path):
    text = F.concat(F.lit('{"content":"'), F.repeat(F.lit("y"), F.lit(21 << 20)), F.lit('","tool_calls":[{"id":"a","name":"f","arguments":{"x":1}}]}'))
    rows = spark.range(1).select(F.lit(1).alias("conv_id"), F.lit(1).alias("turn"), F.lit("assistant").alias("role"), text.alias("text"))
    rows.union(spark.createDataFrame([(1, 2, "tool", '{"tool_call_id":"a","content":2}'), (1, 3, "assistant", '{"broken": ')])).write.parquet(str(tmp_path / "in"))
    got = {r["turn"]: r for r in chat.format_chat(spark.read.parquet(str(tmp_path / "in"))).select("turn", "n_calls", "n_linked", "status", F.length("json").alias("n")).collect()}
    assert (got[1]["n_calls"], got[1]["n_linked"], got[1]["status"]) == (1, 1, "ok") and got[1]["n"] > 21 << 20
    assert (got[2]["n_linked"], got[2]["status"]) == (1, "ok") and got[3]["status"] == "ok"


def test_repeated_keys_and_deep_values(spark):
    deep, deeper = ("[" * n + "]" * n for n in (900, 5000))
    df = say(spark, '{"content":"a","tool_calls":[{"id":"x","id":"y","name":"f","arguments":{"a":1,"a":2}}]}', f'{{"tool_call_id":"y","content":{deep}}}', f'{{"tool_call_id":"y","content":{deeper}}}')
    rows = {r["turn"]: r for r in chat.format_chat(df).collect()}
    assert rows[1]["status"] == "ok" and rows[1]["n_linked"] == 1
    assert json.loads(rows[1]["json"])["tool_calls"] == [{"arguments": {"a": 2}, "id": "y", "name": "f"}]
    assert rows[2]["json"] == f'{{"content":{deep},"role":"tool","tool_call_id":"y"}}'
    assert rows[3]["status"] == "unreadable" and json.loads(rows[3]["json"])["content"] == f'{{"tool_call_id":"y","content":{deeper}}}'


def test_equal_numbers_have_one_spelling_and_none_is_changed(spark):
    long = "1234567890" * 5
    same = {"1": ["1", "1.0", "1.00", "1e0", "10E-1", "0.1e+1"], "1500": ["1500", "1.5e3", "1500.0"], "0.0015": ["0.0015", "1.5e-3"], "1e+21": ["1e21", "10e20"], "1e-7": ["1e-7", "0.1e-6"], "0": ["0", "0.0", "0e5"], long: [long], f"-{long}.5": [f"-{long}.5"], "1e999": ["1e999", "1E999"], "-2.5e+300": ["-2.5e300"], "123456789012345678901234567890": ["123456789012345678901234567890"]}
    given = [(k, x) for k, xs in same.items() for x in xs]
    texts = [f'{{"tool_call_id":"{k}","content":[{x},"{x} and \\"{x}\\" \\\\",{{"n":{x}}}]}}' for k, (_, x) in enumerate(given)]
    texts.append(json.dumps({"tool_calls": [{"id": str(k), "name": "f", "arguments": {"v": 0}} for k in range(len(given))]}))
    rows = {r["turn"]: r["json"] for r in chat.format_chat(say(spark, *texts)).collect()}
    for k, (want, x) in enumerate(given):
        assert rows[k + 1] == f'{{"content":[{want},"{x} and \\"{x}\\" \\\\",{{"n":{want}}}],"role":"tool","tool_call_id":"{k}"}}'


def test_what_a_schema_says_is_checked_or_told(spark):
    cases = [
        ({"multipleOf": 2}, 3, "v: not a multiple"), ({"multipleOf": 0.1}, 0.3, ""), ({"uniqueItems": True}, [1, 1.0], "v: items repeat"), ({"uniqueItems": True}, [1, 2], ""),
        ({"pattern": "^[a-z]+[0-9]{2}$"}, "ab1", "v: not of the pattern"), ({"pattern": "^[a-z]+[0-9]{2}$"}, "ab12", ""), ({"pattern": "^ab"}, 5, ""), ({"pattern": "(a|b"}, "a", "v: not checked: pattern"),
        ({"anyOf": [{"type": "integer"}]}, "s", "v: not checked: anyOf"), ({"$ref": "#/x"}, 1, "v: not checked: $ref"), ({"description": "d", "format": "date"}, "x", ""), ({"items": [{"type": "integer"}]}, ["a"], "v: not checked: items"),
        ({"type": "integer", "not": {}}, "s", "v: not checked: not; v: wrong type"), ({"type": "number", "minimum": 10}, 10**60, ""), ({"type": "integer", "maximum": 10}, 10**60, "v: out of range"), ({"type": "string"}, 10**60, "v: wrong type"),
    ]
    tools = {"tools": [{"name": f"t{k}", "parameters": {"properties": {"v": s}}} for k, (s, _, _) in enumerate(cases)]}
    calls = {"tool_calls": [{"id": str(k), "name": f"t{k}", "arguments": json.dumps({"v": v}) if k % 2 else {"v": v}} for k, (_, v, _) in enumerate(cases)]}
    results = [(1, 2 + k, "tool", json.dumps({"tool_call_id": str(k), "content": None})) for k in range(len(cases))]
    df = spark.createDataFrame([(1, 0, "system", json.dumps(tools)), (1, 1, "assistant", json.dumps(calls)), *results], "conv_id bigint, turn bigint, role string, text string")
    got = {int(r["id"]): (r["problems"], r["status"]) for r in chat.linked_calls(df).collect()}
    for k, (_, _, says) in enumerate(cases):
        assert got[k] == (says, "ok" if not says else "invalid_arguments" if "not checked" not in says or ";" in says else "unchecked"), cases[k]


def test_long_chains_take_few_rounds(spark, monkeypatch):
    n, rng = 2000, random.Random(3)
    needs = {f"c{k}": [f"c{k - 1}"] for k in range(1, n)} | {"c0": []}
    needs |= {"m1": ["c7", "c1999"], "m2": ["m1", "c3"], "tail": ["m2"], "loop1": ["loop2"], "loop2": ["loop1"], "behind": ["loop1"], "both": ["behind", "c2"], "after": ["both"], "self": ["self"]}
    order = list(needs)
    rng.shuffle(order)
    calls = [{"id": i, "name": "f", "arguments": {}, "depends_on": [*needs[i], "not there"]} for i in order]
    texts = [json.dumps({"tool_calls": calls[a : a + 100]}) for a in range(0, len(calls), 100)]
    written = []
    kept = chat.stored
    monkeypatch.setattr(chat, "stored", lambda df, name: written.append(name) or kept(df, name))
    got = {r["id"]: r["level"] for r in chat._levels(chat._calls(chat._read(say(spark, *texts)))).collect()}
    assert len(written) < 30
    want = {f"c{k}": k for k in range(1, n)} | {"m1": 2000, "m2": 2001, "tail": 2002} | dict.fromkeys(("loop1", "loop2", "behind", "both", "after", "self"), -1)
    assert got == want


def test_levels_of_random_calls(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for conv in range(12):
        ids = [f"i{k}" for k in range(25)]
        needs = {i: [j for j in rng.sample(ids, rng.choice([0, 1, 1, 1, 2, 3])) if rng.random() < 0.1 or ids.index(j) < ids.index(i)] for i in ids}
        level = {}
        for _ in ids:
            level |= {i: 1 + max((level[j] for j in needs[i]), default=-1) for i in ids if all(j in level for j in needs[i])}
        want |= {(conv, i): level.get(i, -1) for i in ids if needs[i]}
        rows.append((conv, 0, "assistant", json.dumps({"tool_calls": [{"id": i, "name": "f", "arguments": {}, "depends_on": needs[i]} for i in ids]})))
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert {(r["conv_id"], r["id"]): r["level"] for r in chat._levels(chat._calls(chat._read(df))).collect()} == want
