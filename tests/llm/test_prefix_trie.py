import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from framesift.llm import prefix_trie as pt

SF = "/root/testdata/sf0.01"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = defaultdict(list)
    for k, (conv, turn, role, text) in enumerate(rows):
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, k, role or "", text or ""))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    found = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        found[c] = turns.get(base, [])[:h] + mine[h:]
    return found


def brute(rows):
    whole = rebuilt(rows)
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own + sum(saved[k] for k in children[node])
    return sorted((min(m), len(node), min(members[node[:-1]]) if node else -1, len(m), len(children[node]), leaves[node], saved[node],
                   hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()) for node, m in members.items())


def got(df):
    assert df.columns == COLUMNS
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, *r[3:]) for r in df.collect())


def table(rng, convs, longest, words):
    """Unique turn numbers in each conversation, null for one of them now and then."""
    rows = []
    for c in convs:
        n = rng.randint(1, longest)
        numbers = rng.sample(range(100), n)
        if rng.random() < 0.2:
            numbers[0] = None
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(words)) for t in numbers]
    rng.shuffle(rows)
    return rows


def test_random_table(spark):
    """Null turns, roles and texts, negative ids, missing bases, clashing columns; one conversation of equal rows."""
    rng = random.Random(1)
    convs = rng.sample(range(-40, 160), 120)
    rows = table(rng, convs, 14, ["a", "b", "ééé", None, "", "x" * 100000])
    rows += [(None, 1, "user", "x")] + [(201, 1, "user", "same")] * 4 + [(202, 1, "user", "same")] * 4
    df = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], SCHEMA + ", conv long, row string, depth double")
    assert got(pt.trie(df)) == brute(rows)


def test_conversations_over_many_tasks(spark, monkeypatch):
    """One conversation holds most rows, others are copies of each other; both lie over many tasks."""
    monkeypatch.setattr(pt, "partitions", lambda spark: 13)
    monkeypatch.setattr(pt, "PACKED", 7)
    rng = random.Random(8)
    rows = [(12, t, "user", rng.choice("ab")) for t in range(700)] + [(14, t, "user", rng.choice("ab")) for t in range(90)]
    for c in range(100, 400):
        rows += [(c, 0, "user", "same"), (c, 1, "assistant", "answer"), (c, 2, "user", "more")]
    assert got(pt.trie(spark.createDataFrame(rows, SCHEMA).repartition(9))) == brute(rows)


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(pt.trie(spark.read.parquet(f"{SF}/conversations.parquet"))) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(3, None, None, None)]])
def test_odd_tables(spark, rows):
    assert got(pt.trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_powers():
    base, prime = 123456789, pt.PRIMES[2]
    exponents = np.array([0, 1, 2, 77, 10 ** 6 + 3])
    assert pt.powers(base, exponents, prime).tolist() == [pow(base, int(e), prime) for e in exponents]


def test_fingerprints_that_do_not_tell_orders_apart_are_refused(spark, monkeypatch):
    """With B = 1 the sums ignore the order of turns: groups of different texts must be found and another B taken."""
    rows = [(c, t, "user", text) for c in range(0, 40) for t, text in enumerate(random.Random(c).sample("abcdefghijkl", 12))]
    real, tried = pt.bases, []

    def weak(seed):
        tried.append(seed)
        return [1] * len(pt.PRIMES) if seed == 0 else real(seed)
    monkeypatch.setattr(pt, "bases", weak)
    assert got(pt.trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert tried == [0, 1]


def test_keys_with_two_texts_are_refused(spark, monkeypatch):
    real, tried = pt.turn_keys, []

    def weak(role, text, seed):
        tried.append(seed)
        return real(role, pt.F.substring(text, 1, 1) if seed == 0 else text, seed)
    monkeypatch.setattr(pt, "turn_keys", weak)
    rows = [(c, t, "user", f"a{c % 3}{t}") for c in range(20) for t in range(10)]
    assert got(pt.trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert tried == [0, 1]
