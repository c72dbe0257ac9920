"""The prefix trie against a brute-force trie, with and without a useful screen."""

import hashlib
import math
import random
import zlib

import pytest
from partflow.llm.trie import prefix_trie, running
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn int, role string, text string, depth int"


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    return out


def expected(rows):
    convs = rebuilt(rows)
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, who in members.items():
        under = [n for n in members if n[: len(node)] == node]
        leaves = [n for n in under if not any(len(m) == len(n) + 1 and m[:-1] == n for m in members)]
        ends = sorted(c for c in who if len(convs[c]) == len(node))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), sum(len(m) == len(node) + 1 for m in under), len(leaves),
                    sum((len(members[n]) - 1) * len(n[-1][1]) for n in under if n), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def rows():
    rng = random.Random(7)
    out = []
    for c in [*range(-3, 60), 100, 101, 105, 117, 199, 305, 307]:
        for t in range(rng.choice([0, 1, 2, 4, 7, 9])):
            out.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["hi", "yes é", "no", None, ""])))
    out += [(500 + i, t, "user", f"same {t}") for i in range(9) for t in range(9 + i % 2)]
    out += [(600, None, None, "first"), (600, 3, "b", "x"), (600, 3, "a", "x"), (600, 3, "a", "x"), (None, 1, "user", "nobody's")]
    return out


@pytest.mark.parametrize("log_size", [None, 16])
def test_trie(spark, log_size):
    data = rows()
    frame = spark.createDataFrame([(*r, 1) for r in data], SCHEMA).repartition(3)
    got = [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in prefix_trie(frame, log_size).collect()]
    want = expected(data)
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(got) > 100


def test_a_screen_that_proves_nothing_changes_nothing(spark, monkeypatch):
    from partflow.llm import trie

    data = rows()
    frame = spark.createDataFrame([(*r, 1) for r in data], SCHEMA)
    monkeypatch.setattr(trie, "_sketch_cells", lambda p1, p2, log_size: trie.np.stack([p1 & 1] * trie.ROWS))  # two cells
    monkeypatch.setattr(trie, "_cells", lambda log_size: lambda batches: (trie.pa.record_batch([trie.pa.array([0, 0, 1, 1])], names=["cell"]) for _ in range(1)))
    got = [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in prefix_trie(frame, 20).collect()]
    assert sorted(got, key=repr) == sorted(expected(data), key=repr)


def test_small_and_empty_tables(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    lone = [(c, 0, "user", "hi") for c in range(40) if zlib.crc32(str(c).encode()) % 6 > 0 and c]  # no base, all turns replaced: turnless
    got = [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in prefix_trie(spark.createDataFrame([(*r, 0) for r in lone], SCHEMA)).collect()]
    assert got == expected(lone) and len(got) == 1


def test_running_sums_pass_from_range_to_range(spark):
    rng = random.Random(1)
    data = [(k, i, rng.getrandbits(63)) for k, n in ((1, 5), (2, 3000), (3, 1), (9, 40)) for i in range(n)]
    rng.shuffle(data)
    out = running(spark.createDataFrame(data, "k long, i long, v long").repartition(5), "k", [F.col("i")], {"s": "v"}).collect()
    sums, want = {}, {}
    for k, i, v in sorted(data):
        sums[k] = want[k, i] = (sums.get(k, 0) + v) % (1 << 64)
    assert {(r.k, r.i): r.s % (1 << 64) for r in out} == want
