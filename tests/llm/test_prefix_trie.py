import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from helpers import SMALL

from sherdline.llm import prefix_trie
from sherdline.llm.prefix_trie import prefix_trie as trie
from sherdline.plans.check import connect, rows_of

SCHEMA = "conv_id long, turn long, role string, text string, depth string, x1 string, path string, block string, up string, place string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 6) for r in rows], SCHEMA)


def brute(rows):
    """Every conversation's prefixes as tuples in one dictionary."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0, role, hashlib.md5(text.encode()).hexdigest()), (role, text)))
    own = {c: [said for _, said in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        head = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        whole[c] = own.get(base, [])[:head] + turns[head:]
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for key in members:
        if key:
            children[key[:-1]] += 1
    for key, ids in members.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] += key not in children
            saved[key[:d]] += (len(ids) - 1) * len(key[-1][1].encode()) if key else 0
    out = []
    for key, ids in members.items():
        ends = ",".join(str(c) for c in ids if len(whole[c]) == len(key))
        parent = members[key[:-1]][0] if key else None
        out.append((ids[0], len(key), parent, len(ids), children.get(key, 0), leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def made(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-7, 30), 1000, 1004, 7777, None]:
        shared = rng.choice("ab")
        for turn in range(rng.randint(1, 14)):
            text = rng.choice([None, "", "é", shared * 3, f"{turn}", "x" * 500])
            rows.append((c, rng.choice([turn, turn, turn, None, 3]), rng.choice(["user", None, ""]), text))
    rows += rng.choices(rows, k=10)  # repeated rows
    return rows


@pytest.mark.parametrize("seed,height", [(1, 8), (2, 2), (3, 3)])
def test_against_brute_force(spark, seed, height, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    monkeypatch.setattr(prefix_trie, "IDS", 3)
    rows = made(seed)
    assert got(trie(frame(spark, rows).repartition(3), height)) == brute(rows)


def test_deep_and_common(spark):
    """One conversation of 300 turns, a copy that parts from it late, and many copies of a short one."""
    long = [(10, t, "user", f"turn {t}") for t in range(300)]
    parts = [(15, t, "user", f"turn {t}" if t != 290 else "other") for t in range(300)]
    many = [(c, t, "user", f"same {t}") for c in range(100, 500, 5) for t in range(10)]
    rows = long + parts + many + [(3, 0, "user", "no conversation 0")]
    assert got(trie(frame(spark, rows))) == brute(rows)
    assert got(trie(frame(spark, rows), 3)) == brute(rows)


def test_turnless_and_empty(spark):
    rows = [(c, 0, None, None) for c in range(1, 5)]  # conversation 0 is absent: heads are cut off and not replaced
    assert got(trie(frame(spark, rows))) == brute(rows)
    assert trie(frame(spark, [])).collect() == []
    assert trie(frame(spark, [(None, 1, "user", "x")])).collect() == []


def test_against_sql(spark):
    df = trie(spark.read.parquet(f"{SMALL}/conversations.parquet"))
    cursor = connect(SMALL).execute(prefix_trie.oracle())
    assert rows_of([c[0] for c in cursor.description], cursor.fetchall()) == rows_of(df.columns, df.collect())
