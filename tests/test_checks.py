"""Assignments, rules, staged writes and discovery."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import assigning, clusters, constraints, retrieval
from quarry.sources import files, responses, sinks
from quarry.storage import fresh_path


def test_online_assignment_equals_a_loop(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(120)] + [(120, [0.0] * 4), (121, [1.0, 0.0, 0.0, 0.0])]
    seeds = rows[:3]
    centres = [assigning.unit_rows(np.array(v)) for _, v in seeds]
    sums, expected = {}, []
    for i, v in rows:
        e = assigning.unit_rows(np.array(v))
        d = [1 - c @ e for c in centres]
        j = int(np.argmin(d))
        if d[j] > 0.4:
            j = len(centres)
            centres.append(e)
            sums[j] = e.copy()
        elif j in sums:
            sums[j] = sums[j] + e
            centres[j] = sums[j] / np.linalg.norm(sums[j])
        expected.append((i, j, j < 3, pytest.approx(min(d[:3]))))
    table = spark.createDataFrame(rows, "i int, v array<double>")
    for parts in (1, 5):
        found = assigning.online_assignment(table.repartition(parts), table.filter("i < 3"), "i", "v", 0.4)
        assert [tuple(r) for r in found.orderBy("i").collect()] == expected
    assert assigning.online_assignment(table.limit(0), table.filter("i < 3"), "i", "v", 0.4).collect() == []


def test_named_assignment(spark):
    answers = [(0, 0, "seed:2"), (1, 1, "SEED: 99"), (2, 2, "new: Deep  Search"), (3, 3, "deep search"), (4, 4, "new: "), (5, 5, "other: x: y"), (9, 6, "seed:1"), (0, 7, "seed:x"), (None, 8, "z"), (6, 9, None)]
    strategies = spark.createDataFrame([(i,) for i in range(8)], "ord int")
    told = spark.createDataFrame(answers, "ord int, place int, cluster string")
    found = {r.ord: (r.cluster_idx, r.is_seed, r.label) for r in assigning.named_assignment(strategies, told, 3).collect()}
    last = (6, False, assigning.UNASSIGNED)
    assert found == {0: (0, True, None), 1: (2, True, None), 2: (3, False, "Deep  Search"), 3: (3, False, "Deep  Search"), 4: (4, False, "unclassified"), 5: (5, False, "x: y"), 6: last, 7: last}
    merged = spark.createDataFrame([("X: Y", "Deep")], "name string, canonical string").unionByName(spark.createDataFrame([("deep search", "Deep")], "name string, canonical string"))
    joined = {r.ord: (r.cluster_idx, r.label) for r in assigning.named_assignment(strategies, told, 3, merged).collect()}
    assert joined[2] == joined[3] == joined[5] == (3, "Deep") and joined[4] == (4, "unclassified") and joined[7] == (5, assigning.UNASSIGNED)


def test_watched_rules(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, "b")], "k int, v string")
    watch = constraints.Watch(rows, "k", {"is a or b": F.col("v").isin("a", "b"), "not b": F.col("v") != "b"})
    assert watch.rows.count() == 4
    assert watch.broken() == {"is a or b": (1, "2", "2"), "not b": (3, "2", "4")}
    with pytest.raises(constraints.BrokenRule, match="not b: 3 rows, 2 to 4"):
        watch.enforce()
    clean = constraints.Watch(rows, "k", {"keyed": F.col("k") > 0})
    tracker, before = spark.sparkContext.statusTracker(), None
    clean.rows.count()
    before = len(tracker.getJobIdsForGroup(None))
    clean.enforce()
    assert len(tracker.getJobIdsForGroup(None)) == before


def test_keyed_rules(spark):
    rows = spark.createDataFrame([(1,), (1,), (None,), (None,), (2,)], "k int")
    assert sorted((r.k is None, r.n) for r in constraints.duplicates(rows, "k").collect()) == [(False, 2), (True, 2)]
    assert [r.key for r in constraints.shared(rows, spark.createDataFrame([(2,), (3,), (None,)], "k int"), F.col("k")).collect()] == [2]
    wanted = spark.createDataFrame([(1,), (7,)], "k int")
    with pytest.raises(constraints.BrokenRule, match="7"):
        constraints.restricted(rows, wanted, "k")
    assert constraints.restricted(rows, wanted.filter("k = 1"), "k").count() == 2


def test_misaligned_at_any_partitioning(spark):
    rng = random.Random(2)
    left = [(i, rng.randint(0, 5)) for i in range(300)]
    right = [(i, v + (i % 50 == 0)) for i, v in left[:290]]
    expected = [(i, left[i][1], right[i][1] if i < 290 else None) for i in range(300) if i >= 290 or i % 50 == 0]
    for parts in (1, 6):
        one, other = (spark.createDataFrame(t, "i int, v int").repartition(parts) for t in (left, right))
        found = constraints.misaligned(one, other, ["i"], ["v"]).orderBy("position").collect()
        assert [(r.position, r.left.v, r.right.v if r.right else None) for r in found] == expected
        assert constraints.misaligned(one, one.repartition(3), ["i"], ["v"]).isEmpty()


def test_first_passing(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, "a", "b", f"c{i % 40}"])) for i in range(0, 900, 3)]
    table = spark.createDataFrame(rows, "i int, k string")
    for start, n in ((0, 5), (3, 10), (0, 500), (60, 5)):
        seen, expected = set(), []
        for i, k in rows:
            if k is not None and k != "a" and k not in seen:
                seen.add(k)
                expected.append((i, k))
        found = constraints.first_passing(table, "i", F.col("k") != "a", start, n, "k").collect()
        assert [tuple(r) for r in found] == expected[start : start + n]
    assert constraints.first_passing(table.limit(0), "i", F.lit(True), 0, 5, "k").collect() == []


def test_publish_whole_or_not_at_all(spark, monkeypatch):
    target = fresh_path(spark, "published")
    tables = {"a": spark.range(5).toDF("x"), "b": spark.range(0).toDF("y")}
    move = sinks._move
    monkeypatch.setattr(sinks, "_move", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError, match="killed"):
        sinks.publish(tables, target)
    assert not sinks.exists(spark, target)
    monkeypatch.setattr(sinks, "_move", move)
    manifest = sinks.publish(tables, target)
    assert {k: v["rows"] for k, v in manifest.items()} == {"a": 5, "b": 0}
    assert json.loads(sinks.read_document(spark, f"{target}/manifest.json")) == manifest
    assert spark.read.parquet(f"{target}/a").count() == 5
    with pytest.raises(FileExistsError):
        sinks.publish(tables, target)
    with pytest.raises(ValueError, match="inside"):
        sinks.publish(tables, f"{target}/c", sources=(target,))


def test_documents_are_replaced_whole(spark):
    path = fresh_path(spark, "document") + ".json"
    assert sinks.read_document(spark, path) is None
    for text in ("one", "två 世\n"):
        sinks.write_document(spark, text, path)
        assert sinks.read_document(spark, path) == text


def test_split_is_readable_at_any_time(spark, monkeypatch):
    root, schema = fresh_path(spark, "dataset"), "x bigint, note string"
    read = lambda: sorted(r.x for r in sinks.read_split(spark, root, "train", schema).collect())
    assert read() == []
    sinks.replace_split(spark.range(3).toDF("x"), root, "train", "x", ["x", "note"])
    assert read() == [0, 1, 2]
    move, calls = sinks._move, []

    def dying(session, source, to):
        calls.append(to)
        if len(calls) == 2:
            raise OSError("killed")
        move(session, source, to)

    monkeypatch.setattr(sinks, "_move", dying)
    with pytest.raises(OSError, match="killed"):
        sinks.replace_split(spark.range(7).toDF("x"), root, "train", "x", ["x", "note"])
    assert read() == [0, 1, 2]
    monkeypatch.setattr(sinks, "_move", move)
    sinks.replace_split(spark.range(7).toDF("x"), root, "train", "x", ["x", "note"])
    assert read() == list(range(7))


def test_discovery(spark, tmp_path):
    def put(name, final, n):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps({"results": [{"seed": name, "final_status": final, "attempts": [{"attempt": i} for i in range(n)]}]}))

    for name, final, n in (("r/a/sample_001.json", "FAILED_FOUND", 2), ("r/b/sample_002.json", "EXHAUSTED", 2), ("r/b/sample_x.json", "FAILED_FOUND", 1), ("r/b/deep/sample_003.json", "FAILED_FOUND", 1), ("r/b/sample_004.json", "FAILED_FOUND", 0)):
        put(name, final, n)
    (tmp_path / "r/b/sample_005.json").write_text('{"results": [')
    schema = spark.createDataFrame([], "results array<struct<seed:string,final_status:string,attempts:array<struct<attempt:int>>>>").schema
    runs = files.run_documents(spark, str(tmp_path / "r"), schema)
    names = lambda rows: sorted(r.file.rsplit("/", 1)[1] for r in rows.select("file").collect())
    assert names(files.shallowest(runs, str(tmp_path / "r"))) == ["sample_001.json", "sample_002.json", "sample_004.json", "sample_x.json"]
    kept = files.harvest(runs).collect()
    assert sorted((r.result.seed, r.attempt.attempt) for r in kept) == [("r/a/sample_001.json", 1), ("r/b/deep/sample_003.json", 0)]


def test_run_samples(spark):
    index = spark.createDataFrame([("a.json", 1), ("b.json", 2)], "file string, n int")
    results = spark.createDataFrame([("a.json", ["first", "second"])], "file string, results array<string>")
    compares = spark.createDataFrame([("b.compare.json", "better")], "file string, compare string")
    assert sorted(map(tuple, files.run_samples(index, results, compares).collect())) == [("a.json", 1, "first", None), ("b.json", 2, None, "better")]


def test_recorded_responses(spark):
    path = fresh_path(spark, "responses")
    rows = [("a", 0, 429, "busy"), ("a", 1, 200, '{"data":[{"title":"T","authors":[{"name":"N"}]},{"title":null}]}'), ("b", 0, 404, '{"data":[{"title":"no"}]}'), ("b", 1, 200, '{"data":[]}'), ("c", 0, 500, None), ("c", 1, 503, None), ("d", 3, 200, '{"total": 7}'), ("e", 0, 200, "broken"), ('["x","y"]', 0, 200, '[null,{"title":"Y"}]')]
    tries = spark.createDataFrame(rows, "request string, attempt int, status int, body string")
    responses.record(tries.withColumn("endpoint", F.lit("search")), path)
    responses.record(tries.limit(0).withColumn("endpoint", F.lit("total")), path)
    read = responses.recorded(spark, path, "search")
    assert "PartitionFilters: [isnotnull(endpoint" in read._jdf.queryExecution().toString()
    answers = responses.settled(read, 3)
    assert {r.request: (r.status, r.tries, r.body is None) for r in answers.collect()} == {"a": (200, 2, False), "b": (404, 1, True), "c": (503, 2, True), "e": (200, 1, False), '["x","y"]': (200, 1, False)}
    assert sorted((r.request, r.place, r.paper.title) for r in responses.papers(answers.filter("request IN ('a', 'b', 'c', 'e')")).collect()) == [("a", 0, "T"), ("a", 1, None)]
    assert [r.total for r in responses.totals(responses.settled(read, 4).filter("request IN ('c', 'd')")).orderBy("request").collect()] == [None, 7]
    assert [(r.id, r.paper and r.paper.title) for r in responses.batch(answers.filter("request LIKE '[%'")).collect()] == [("x", None), ("y", "Y")]


def test_configuration_files(spark, tmp_path):
    put = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    assert [r.seed for r in files.seeds(spark, put("s.txt", " a \n\nb\n")).collect()] == ["a", "b"]
    assert [r.seed for r in files.seeds(spark, put("s.json", '["one\\ntwo", "", null, "x"]')).collect()] == ["one\ntwo", "x"]
    spark.createDataFrame([("q",), ("",), (None,)], "question string").write.parquet(str(tmp_path / "set"))
    assert [r.seed for r in files.seeds(spark, str(tmp_path / "set")).collect()] == ["q"]
    good = files.systems(spark, put("y.json", '[{"name":"a","share":0.5},{"name":"b","timeout":9}]'), 5.0, 2).orderBy("name").collect()
    assert [(r.name, r.timeout, r.concurrency, r.share, r.kind) for r in good] == [("a", 5.0, 2, 0.5, "server"), ("b", 9.0, 2, None, "server")]
    for text, what in (('[{"name":"a"},{"name":"a"}]', "repeated name"), ('[{"name":"../a"}]', "no safe name"), ('[{"share":0.1}]', "no safe name"), ('[{"name":"a","share":2}]', "share")):
        with pytest.raises(constraints.BrokenRule, match=what):
            files.systems(spark, put("bad.json", text), 5.0, 2)
    shots = put("shots.json", '[{"q":"a","s":"b"},{"q":"c","s":"d"}]')
    assert [(r.ord, r.q, r.s) for r in files.worked_examples(spark, shots, ("q", "s")).collect()] == [(0, "a", "b"), (1, "c", "d")]
    with pytest.raises(constraints.BrokenRule, match="blank"):
        files.worked_examples(spark, put("shots2.json", '[{"q":"a"}]'), ("q", "s"))


def test_kinds_and_menus(spark, tmp_path):
    rows = spark.createDataFrame([("call", 1, None), ("verdict", 2, "r0")], "kind string, n int, run_id string")
    for _ in range(2):
        sinks.append_kinds(rows, str(tmp_path / "log"), "r1")
    found = spark.read.json(str(tmp_path / "log")).collect()
    assert sorted((r.kind, r.n, r.run_id) for r in found) == [("call", 1, "r1")] * 2 + [("verdict", 2, "r0")] * 2 and all(r.timestamp for r in found)
    sinks.write_menu(spark.createDataFrame([(2, "b\nc"), (1, "a")], "o int, t string"), "o", "t", "menu", str(tmp_path / "menu.txt"))
    assert (tmp_path / "menu.txt").read_text() == "# menu\na\nb c\n"
    assert [r.line for r in files.lines(spark, str(tmp_path / "menu.txt"), comments=True).collect()] == ["a", "b c"]


def test_null_is_a_group(spark):
    rows = spark.createDataFrame([(None, 1.0, True), (None, 3.0, False), ("a", 5.0, False)], "g string, r double, failed boolean")
    assert sorted(x.advantage for x in retrieval.group_normalised(rows, "g", "r").collect()) == [-1.0, 0.0, 1.0]
    found = clusters.nodes(rows, rows.select("g").distinct(), "g", "failed").collect()
    assert {r.g: (r.num_questions, r.num_failed) for r in found} == {None: (2, 1), "a": (1, 0)}
    allocation = spark.createDataFrame([(None, 1), ("a", 1)], "g string, allocated int")
    assert clusters.stratified_sample(rows, allocation, "g", "r", "x").count() == 2
    seeds = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (0, [2.0, 0.0])], "s int, e array<double>")
    vectors = spark.createDataFrame([(9, [3.0, 0.0]), (8, [0.0, 0.0])], "v int, e array<double>")
    assert sorted(map(tuple, retrieval.nearest_seed(vectors, seeds, "v", "e", "s").collect())) == [(8, 0, 1.0), (9, 0, 0.0)]
