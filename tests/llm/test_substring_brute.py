"""Substring deduplication against a plain version, with awkward rows."""

import numpy as np

from quarry.llm import substring


def brute(rows):
    """Texts without the sentences that a later place of a repeated run covers."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    first, gone = {}, {}
    for k in order:
        parts = substring.sentences(rows[k][1] or "")
        found = sorted(substring.runs(parts, substring.MIN_WORDS, substring.LONG_SENTENCE))
        for at, n, data in found:
            if first.setdefault(data, (k, at)) != (k, at):
                gone.setdefault(k, set()).update(range(at, at + n))
    return {
        k: "".join(p for i, p in enumerate(substring.sentences(t)) if i not in gone[k]) if k in gone else t for k, (_, t) in enumerate(rows)
    }


def test_against_brute_force(spark):
    rng = np.random.default_rng(8)
    pool = [" ".join(f"w{x}" for x in rng.integers(10**6, size=rng.integers(1, 30))) + ". " for _ in range(60)]
    rows = []
    for k in range(150):
        parts = [pool[x] for x in rng.integers(60, size=rng.integers(1, 12))] + [f"own {k} " * int(rng.integers(1, 60)) + ". "]
        at = int(rng.integers(len(pool) - 8))
        rng.shuffle(parts)
        parts[1:1] = pool[at : at + int(rng.integers(1, 8))]
        rows.append((k, "".join(parts)))
    rows += [(200, None), (201, ""), (202, rows[3][1]), (203, pool[0] * 4000), (None, rows[4][1])]
    frame = spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in rows], "doc_id bigint, text string, id int, places string, tag int, salt int")
    got = {r["doc_id"]: r["text"] for r in substring.dedup_substrings(frame).collect()}
    want = brute(rows)
    assert got == {i: want[k] for k, (i, _) in enumerate(rows)}


def test_equal_rows_and_null_ids_are_answered_apart(spark):
    passage = " ".join(f"word{i}" for i in range(30)) + ". " + " ".join(f"more{i}" for i in range(30)) + "."
    rows = [(7, passage), (7, passage), (None, f"First one. {passage}"), (None, f"Second one. {passage}"), (None, "Quite another.")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [(r["doc_id"], r["text"], r["n_removed"]) for r in substring.dedup_substrings(frame).collect()]
    assert sorted(g[1:] for g in got if g[0] == 7) == [("", 2), ("", 2)]
    whole = [g for g in got if g[0] is None and g[1].endswith(passage)]
    assert len(got) == 5 and len(whole) == 1 and sum(g[2] for g in got if g[0] is None) == 2
