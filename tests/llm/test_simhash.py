"""SimHash near duplicates against brute force over all pairs."""

import collections
import random
import re

import numpy as np
import xxhash
from partflow.llm import simhash as sh

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def print_of(text):
    words = WORD.findall((text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected(rows):
    prints = [print_of(t) for _, t in rows]
    label = {p: p for p in prints}

    def root(p):
        while label[p] != p:
            p = label[p]
        return p

    distinct = list(label)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if bin(a ^ b).count("1") <= 4:
                label[root(a)] = root(b)
    least = collections.defaultdict(list)
    for (d, _), p in zip(rows, prints, strict=True):
        least[root(p)] += [] if d is None else [d]
    return [(d, f"{p:016x}", min(least[root(p)], default=None)) for (d, _), p in zip(rows, prints, strict=True)]


def test_every_word_lies_within_three_bits_of_one_codeword():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 23, 2000)
    codes = (np.arange(4096) << 11) ^ sh._HIGH
    distance = np.bitwise_count(words[:, None] ^ codes[None, :])
    assert (distance.min(axis=1) <= 3).all() and ((distance <= 3).sum(axis=1) == 1).all()
    assert (sh.codeword(words) == distance.argmin(axis=1)).all()


def test_keys_meet_at_every_pattern_of_four_errors():
    rng = random.Random(4)
    for _ in range(400):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 4)):
            b ^= 1 << bit
        mine, yours = (set(sh.fuzzy_keys(np.array([x], np.uint64))[0].tolist()) for x in (a, b))
        assert mine & yours


def test_links_connect_what_four_bits_connect(spark):
    rng, prints = random.Random(9), set()
    for _ in range(30):
        a = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            prints.add(a)
            for bit in rng.sample(range(64), rng.randint(1, 6)):
                a ^= 1 << bit
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fingerprint long")

    def classes(pairs):
        label = {p: p for p in signed}

        def root(p):
            while label[p] != p:
                p = label[p]
            return p

        for a, b in pairs:
            label[root(a)] = root(b)
        return {frozenset(q for q in signed if root(q) == root(p)) for p in signed}

    want = classes([(a, b) for a in signed for b in signed if bin((a ^ b) & (1 << 64) - 1).count("1") <= 4])
    for dense in (1024, 2):  # the second one sends keys of three and more through midpoints
        assert classes([tuple(r) for r in sh.links(frame, dense).collect()]) == want
    assert 30 < len(want) < len(signed)


def test_simhash_duplicates(odd, odd_rows, none):
    rows = [(d, t) for d, t, *_ in odd_rows]
    got = [tuple(r) for r in sh.simhash_duplicates(odd).collect()]
    want = expected(rows)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert (6, "0" * 16, 6) in got and (7, "0" * 16, 6) in got and (2, want[0][1], 1) in got
    assert sh.simhash_duplicates(none).collect() == []


def test_near_copies_link_and_a_long_text_is_hashed_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    near = list(words)
    near[1500] = "other"
    rows = [(5, " ".join(words)), (3, " \t".join(near).upper()), (4, " ".join(reversed(words))), (3, "one two"), (None, "one TWO ")]
    got = [tuple(r) for r in sh.simhash_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=repr) == sorted(expected(rows), key=repr)
    hashes = sh.shingle_hashes(rows[0][1].encode())
    whole = sh.simhash(hashes)
    monkeypatch.setattr(sh, "_HASH_BLOCK", 100)
    assert sh.simhash(hashes) == whole
