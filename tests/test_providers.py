"""Offsets, edits, provider answers and nested documents against plain Python."""

import bisect
import json
import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from quarry.functions import offsets
from quarry.operators import examples, nested, positions, provider_traces

ALPHABET = "aé世😀\n ́x"


def texts(n, longest=30, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_byte_offsets(spark):
    rows = [(t, b) for t in texts(60) for b in (-3, -1, *range(len(t.encode()) + 3))]
    found = spark.createDataFrame(rows, "t string, b int").select("t", "b", offsets.char_offset(F.col("t"), F.col("b")).alias("c")).collect()
    for r in found:
        starts = list(accumulate([0, *(len(ch.encode()) for ch in r.t)]))
        assert r.c == bisect.bisect_right(starts, r.b) - 1, r


def test_edits(spark):
    rng = random.Random(2)
    rows = []
    for t in texts(200, seed=3):
        edits = []
        for _ in range(rng.randint(0, 5)):
            a = rng.randint(0, len(t) + 2)
            edits.append((a, a + rng.choice([0, 0, 1, 4]), rng.choice(["<1>", "", "é世"])))
        rows.append((t, edits))
    rows.append(("x", None))
    found = spark.createDataFrame(rows, f"t string, e {offsets.EDITS}").select("t", "e", offsets.edited(F.col("t"), F.col("e")).alias("out")).collect()
    for r in found:
        text = r.t
        for a, b, new in sorted(r.e or [], key=lambda e: (e[0], e[1]), reverse=True):
            text = text[:a] + new + text[b:]
        assert r.out == text


def one(spark, kind, value, convert, *more):
    rows = spark.createDataFrame([(value, 1, "x")], f"v {kind}, __parts int, told string")
    assert convert(rows, "v", *more).columns == ["v", "__parts", "told"]
    return convert(rows, "v", *more).first().told


def test_blocks(spark):
    def block(type_, name=None, id_=None, use=None, query=None, error=None, results=(), text=None, citations=None):
        return (type_, name, id_, use, query, error, list(results), text, citations)

    blocks = [
        block("text", text="Let me look."),
        block("server_tool_use", "web_search", "i1", query="first"),
        block("web_search_tool_result", use="i1", results=[("https://A.org/x/", "A"), ("", "none"), ("http://b.org", "B")]),
        block("server_tool_use", "web_search", "i2", query="second"),
        block("web_search_tool_result", use="i2", error="busy"),
        block("web_search_tool_result", use="other", results=[("http://lost.org", "L")]),
        block("text", text=" Claim", citations=[("http://a.org/x#part", "A", "quote one"), ("http://c.org/", "C", " "), (None, "x", "y")]),
        block("text", text="\n", citations=[("http://a.org/x", "A", "quote two")]),
        block("text", text=" end. "),
    ]
    t = one(spark, provider_traces.BLOCKS, blocks, provider_traces.from_blocks)
    assert t.answer == '<cite id="s1-0 cited-0"> Claim</cite><cite id="s1-0"></cite>\n end.'
    assert [(x.id, x.title, x.snippet) for x in t.documents] == [("s1-0", "A", "quote one … quote two"), ("s1-1", "B", ""), ("cited-0", "C", "")]
    assert [(c.call_id, c.query, c.error) for c in t.calls] == [("s1", "first", None), ("s2", "second", "busy")]
    assert t.interim == ["Let me look."] and t.citations == 3
    empty = one(spark, provider_traces.BLOCKS, None, provider_traces.from_blocks)
    assert (empty.answer, empty.documents, empty.calls, empty.citations) == ("", [], [], 0)


def test_items(spark):
    text = "Fact ([a](http://a.org?utm_source=o)). More 世 words."
    link = text.index("(["), text.index("))") + 2
    notes = [("url_citation", "http://a.org?utm_source=o", "", *link), ("url_citation", "https://a.org", "t", 41, len(text)), ("file", "http://f", "f", 0, 1), ("url_citation", "http://b.org/p?x=1&utm_a=2", "B", 0, 4)]
    items = [
        ("message", None, None, None, None, None, [("output_text", "note", None, None)]),
        ("web_search_call", "failed", "search", ["q", "r"], None, [], None),
        ("message", None, None, None, None, None, [("output_text", text, None, notes), ("refusal", None, "no", None)]),
    ]
    t = one(spark, provider_traces.ITEMS, items, provider_traces.from_items)
    expected = text + '<cite id="c-0"></cite>'
    expected = expected[: link[0]] + '<cite id="c-0"></cite>' + expected[link[1] :]
    assert t.answer == expected[:4] + '<cite id="c-1"></cite>' + expected[4:]
    assert [(x.id, x.title, x.url) for x in t.documents] == [("c-0", "http://a.org", "http://a.org"), ("c-1", "B", "http://b.org/p?x=1")]
    assert [(c.query, c.error) for c in t.calls] == [("q | r", "failed")]
    assert t.interim == ["note", "[refusal] no"] and t.citations == 3


def test_steps(spark):
    first, second = "世界 one", "two"
    content = [("text", first, None, [("url_citation", "r/1", "", 0, 6), ("url_citation", "r/2", "", 0, 7), ("url_citation", "r/3", "", 0, 99)]), ("text", second, None, [("url_citation", "r/2", "", 0, 0)])]
    steps = [("google_search_call", ["q"], False, None), ("google_search_result", None, True, None), ("model_output", None, None, [("text", "thinking", None, None)]), ("google_search_call", ["r"], False, None), ("model_output", None, None, content)]
    resolved = F.create_map(F.lit("r/1"), F.lit("http://x"), F.lit("r/2"), F.lit("http://x"))
    t = one(spark, provider_traces.STEPS, steps, provider_traces.from_steps, resolved)
    assert t.answer == '世界<cite id="g-0"></cite> <cite id="g-0"></cite>one<cite id="g-1 g-0"></cite>two'
    assert [(x.id, x.url) for x in t.documents] == [("g-0", "http://x"), ("g-1", "")]
    assert [(c.call_id, c.error) for c in t.calls] == [("q1", "is_error"), ("q2", None)] and t.interim == ["thinking"]


def test_repaired_blocks(spark):
    rows = spark.createDataFrame([("a", None), ("a", ""), ("", "b"), (None, None)], "f string, s string")
    assert [r.t for r in rows.select(provider_traces.repaired(F.col("f"), F.col("s")).alias("t")).collect()] == ["a", "a", "b", ""]


def document(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice([1, 2.5, True, None, "text", "two words", "a=b", ""])
    if rng.random() < 0.3:
        return [document(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(["signature", "type", "kéy", "a", "b"]): document(rng, depth - 1) for _ in range(rng.randint(0, 4))}


def test_keys_go_at_any_depth(spark):
    rng = random.Random(4)
    docs = [{"type": "bare", "x": 1}, *[document(rng, 10) for _ in range(80)]]

    def plain(x):
        if isinstance(x, dict):
            return {"type": "bare"} if x.get("type") == "bare" else {k: plain(v) for k, v in x.items() if k != "signature"}
        return [plain(v) for v in x] if isinstance(x, list) else x

    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(900, None), (901, "{broken")], "i int, t string")
    found = {r.i: r.o for r in rows.select("i", nested.without_keys(F.col("t"), ("signature",), ("bare",)).alias("o")).collect()}
    assert [json.loads(found[i]) for i in range(len(docs))] == [plain(d) for d in docs]
    assert found[900] is None and found[901] == "{broken"


def test_flattening(spark):
    rng = random.Random(5)
    docs = [document(rng, 10) for _ in range(60)]

    def flat(x, prefix=""):
        out = []
        for k, v in x.items():
            key = f"{prefix}.{k}" if prefix else k
            if isinstance(v, dict):
                out += flat(v, key)
            elif isinstance(v, list):
                if not any(isinstance(e, (dict, list)) for e in v):
                    out.append(f"{key}=[{','.join(str(e) for e in v)}]")
            elif v is None:
                out.append(f"{key}=null")
            elif isinstance(v, bool):
                out.append(f"{key}={str(v).lower()}")
            else:
                out.append(f'{key}="{v}"' if isinstance(v, str) and (" " in v or "=" in v or not v) else f"{key}={v}")
        return out

    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, t string")
    found = nested.overrides(nested.leaves(rows, "i", "t")).collect()
    for i, d in enumerate(docs):
        expected = flat(d) if isinstance(d, dict) else []
        assert sorted(r.override for r in found if r.i == i and "=[{" not in r.override and "[[" not in r.override and not any(c in r.override.split("=", 1)[1] for c in "{[" if r.override.split("=", 1)[1].startswith("[") and c in r.override.split("=", 1)[1][1:])) == sorted(expected)
    assert nested.leaves(rows.limit(0), "i", "t").isEmpty()


def test_roots_and_proposals(spark):
    rows = spark.createDataFrame([(0, '{"queries": ["a", {"query": " b "}, {"query": 3}, 4, "A", "", "c", "d"]}'), (1, '["x"]'), (2, '{"query": "y"}'), (3, "oops"), (4, None), (5, '"text"')], "i int, t string")
    found = {r.i: r.q for r in rows.select("i", nested.proposals(nested.records(F.col("t"), "queries"), "query", 3).alias("q")).collect()}
    assert found == {0: ["a", "b", "c"], 1: ["x"], 2: ["y"], 3: [], 4: [], 5: []}


def test_redaction(spark):
    rows = spark.createDataFrame([('{"answer":"long","trace":null,"model":"m","n":{"a":[1]}}',), ('{"trace":{}}',), ('{"answer":null}',), ("[1]",), (None,)], "t string")
    found = [r.o for r in rows.select(nested.redacted(F.col("t")).alias("o")).collect()]
    assert [json.loads(x) if x else x for x in found] == [{"model": "m", "n": {"a": [1]}, "answer_chars": 4, "trace_present": False}, {"trace_present": True}, {"answer_chars": 0}, [1], None]


@pytest.mark.parametrize("parts", [1, 7])
def test_positions(spark, parts):
    rng = random.Random(6)
    rows = [(rng.choice([None, *range(20)]), i) for i in range(500)]
    found = positions.numbered(spark.createDataFrame(rows, "k int, i int").repartition(parts), ["k", "i"]).collect()
    expected = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r.k, r.i) for r in sorted(found, key=lambda r: r.position)] == expected
    assert sorted(r.position for r in found) == list(range(500))
    assert positions.numbered(spark.createDataFrame([], "k int, position int"), ["k"]).collect() == []


def split(shares, n):
    """Seats one by one, to the largest remainder, then from the largest to those without."""
    open_ = sum(s is None for s in shares)
    rest = max(0.0, 1.0 - sum(s for s in shares if s is not None)) / open_ if open_ else 0
    wanted = [rest if s is None else s for s in shares]
    exact = [n * w / sum(wanted) for w in wanted]
    seats = [int(x) for x in exact]
    while sum(seats) < n:
        seats[max(range(len(seats)), key=lambda i: (exact[i] - seats[i], -i))] += 1
    if n >= sum(w > 0 for w in wanted):
        for poor in [i for i, w in enumerate(wanted) if w > 0 and not seats[i]]:
            rich = seats.index(max(seats))
            if seats[rich] > 1:
                seats[rich], seats[poor] = seats[rich] - 1, 1
    return seats


def test_split_sizes(spark):
    for shares, n in [([0.5, 0.3, None], 150), ([0.5, 0.3, None], 2), ([0.97, 0.01, 0.01, 0.01], 5), ([0.9, 0.9, 0.01, None, None], 10), ([0.6, 0.4], 1), ([1.0, 0.0], 7), ([0.4, 0.4, 0.05, 0.05, 0.1], 6)]:
        systems = spark.createDataFrame([(i, f"s{i}", s) for i, s in enumerate(shares)], "ord int, name string, share double")
        assert [r["size"] for r in examples.split_sizes(systems, n).orderBy("ord").collect()] == split(shares, n), (shares, n)


def test_diverse_ranking(spark):
    rng = random.Random(7)
    for n in (0, 1, 2, 9):
        rows = [(f"c{i}", rng.choice([0.0, 0.5, 0.9]), rng.randint(0, 3)) for i in range(n)]
        found = examples.diverse(spark.createDataFrame(rows, "c string, failure_rate double, num_failed int"), "c").orderBy("rank").collect()
        orders = [sorted(rows, key=lambda r: (-r[1], -r[2], r[0])), sorted(rows, key=lambda r: (-r[2], -r[1], r[0]))]
        left, expected = {r[0] for r in rows}, []
        while left:
            expected.append(next(r[0] for r in orders[len(expected) % 2] if r[0] in left))
            left.remove(expected[-1])
        assert [r.c for r in found] == expected and [r["rank"] for r in found] == list(range(1, n + 1))
