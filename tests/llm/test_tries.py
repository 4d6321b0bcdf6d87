"""The prefix trie against a plain build of it."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from quarry.llm import tries

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, words string"


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(hashlib.md5(role.encode()).hexdigest().encode() + hashlib.md5(text.encode()).hexdigest().encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0), key, (role, text)))
    for turns in own.values():
        turns.sort(key=lambda t: t[:2])
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = tuple(t[2] for t in own.get(base, [])[:h]) + tuple(t[2] for t in turns[h:])
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        cost = (len(m) - 1) * len([w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in p[-1][1]).split(" ") if w]) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += cost
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(p)))).encode()).hexdigest())
        for p, m in members.items()
    )


def check(spark, rows):
    turns = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    found = tries.trie(turns.repartition(3))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert found.columns == names
    key = lambda r: (r[0], r[1])
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(plain(rows), key=key)


def conversations(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-15, 3 * n), n):
        for turn in range(rng.randint(1, longest)):
            role, text = rng.choice(["user", None]), rng.choice(["a b", "a b", "c d \x0b e", "", None])
            rows.append((c, rng.choice([turn, turn, None]), role, text))
    return rows


@pytest.mark.parametrize("block", [1024, 4])
def test_equals_plain(spark, monkeypatch, block):
    monkeypatch.setattr(tries, "BLOCK_DEPTHS", block)
    monkeypatch.setattr(tries, "MEMBER_BITS", 2)
    check(spark, conversations(block, 60, 9) + [(c, t, "user", "same") for c in range(200, 240) for t in range(3)])


def test_edges(spark):
    check(spark, [])
    check(spark, [(None, 1, "user", "x")])
    check(spark, [(5, None, None, None)])
    check(spark, [(7, 1, "u", "a"), (7, 1, "u", "a"), (7, None, "u", "b"), (None, 1, "u", "a"), (7, 1, "t", "word " * 50_000)])
