"""Line dedup, substring dedup, near duplicates, fingerprints and licences against brute force."""

import collections
import hashlib
import os
import random
import re
import textwrap

import numpy as np
from pyspark.sql import functions as F
from partflow.llm import fingerprints as lz
from partflow.llm import jaccard
from partflow.llm.jaccard import join_region, near_duplicates
from partflow.llm.licenses import DIGESTS, LICENSES, notices, scan_licenses
from partflow.llm.lines import LineRuns, dedup_lines, line_entries
from partflow.llm.substrings import dedup_substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def counted(items):
    return sorted(items, key=repr)


def test_lines(odd, odd_rows, none):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = collections.defaultdict(list)
    for d, t, *_ in odd_rows:
        for k in {key(line) for line in (t or "").split("\n")}:
            if len(k) >= 20:
                holders[k].append(d)
    want = []
    for d, t, *_ in odd_rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders[key(x)]) >= 3 and d != max(h for h in holders[key(x)] if h is not None))]
        want.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    for batches, fanout in ((6, 3), (7, 2)):  # the second one makes three levels of runs
        got = [(r.doc_id, r.n_lines, r.n_dropped, sha(r.text)) for r in dedup_lines(odd, batches=batches, fanout=fanout).collect()]
        assert counted(got) == counted(want) and sum(w[2] for w in want) >= 8
    assert dedup_lines(none).collect() == []


def test_line_runs_compact_and_keep_first_copies(odd):
    entries = line_entries(odd).filter("doc_id IS NOT NULL")
    runs = LineRuns(fanout=2)
    for low, high in ((50, 99), (40, 50), (25, 40), (9, 25), (-5, 9)):  # falling ids
        runs.add(entries.filter(f"doc_id >= {low} AND doc_id < {high}"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    direct = {(r.line, r.n, r.m) for r in entries.groupBy("line").agg(F.count("*").alias("n"), F.max("doc_id").alias("m")).collect()}
    assert {(r.line, r.n_docs, r.max_doc) for r in runs.merged().collect()} == direct
    assert runs.unseen(entries).isEmpty() and not runs.unseen(line_entries(odd)).isEmpty()
    held = [r.max_doc for level in runs.levels for run in level for r in run.collect()]
    assert held.count(None) > 0  # a later batch adds only to the count of a line that a run holds


def test_substrings(odd, odd_rows, none):
    seen = collections.Counter()
    texts = [WORD.findall(t or "") for _, t, *_ in odd_rows]
    for w in texts:
        seen.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    want = []
    for (d, *_), w in zip(odd_rows, texts, strict=True):
        cut = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                cut.update(range(i, i + 35))
        want.append((d, len(w), len(cut), sha(" ".join(x for i, x in enumerate(w) if i not in cut))))
    got = [(r.doc_id, r.n_words, r.n_removed, sha(r.text)) for r in dedup_substrings(odd).collect()]
    assert counted(got) == counted(want) and sum(w[2] for w in want) > 1500
    assert dedup_substrings(none).collect() == []


def groups(sets):
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            inner = len(a & sets[j])
            if a and 100 * inner >= 80 * (len(a) + len(sets[j]) - inner):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(sets))]


def test_near_duplicates(odd, odd_rows, none):
    sets = []
    for _, t, *_ in odd_rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    found = groups(sets)
    least = collections.defaultdict(list)
    for g, (d, *_) in zip(found, odd_rows, strict=True):
        if d is not None:
            least[g].append(d)
    want = [(d, len(s), min(least[g], default=None)) for (d, *_), s, g in zip(odd_rows, sets, found, strict=True)]
    for limit in (3_000_000, 400):  # the second one cuts regions by pivots and blocks
        assert counted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(odd, limit).collect()) == counted(want)
    assert near_duplicates(none).collect() == []


def test_near_duplicates_without_ids_and_with_shared_ids(spark):
    words = [f"w{i}" for i in range(900)]
    near = lambda at, change: " ".join(f"c{at + i}" if i in change else w for i, w in enumerate(words[at : at + 100]))
    rows = [(None, near(0, ())), (7, near(0, (50,))), (8, near(200, ())), (8, near(0, (99,))), (9, near(200, (0,))), (3, near(400, ())), (4, near(400, (50, 99)))]
    rows += [(None, near(400, (50,))), (None, near(600, ())), (None, near(600, (99,))), (None, near(600, ())), (5, near(800, ())), (5, near(800, ()))]
    rows += [(20, near(700, ())), (None, near(700, (20, 40))), (21, near(700, (20, 40, 60, 80)))]  # only the row without id links 20 with 21
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    found, least = groups(sets), collections.defaultdict(list)
    for g, (d, _) in zip(found, rows, strict=True):
        least[g] += [] if d is None else [d]
    want = [(d, 96, min(least[g], default=None)) for (d, _), g in zip(rows, found, strict=True)]
    assert (8, 96, 7) in want and (8, 96, 8) in want and (21, 96, 20) in want and (4, 96, 3) in want
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for limit in (3_000_000, 100):
        assert counted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs, limit).collect()) == counted(want)


def test_large_regions_are_parted_without_copies(spark, monkeypatch):
    """Texts that share lines of a pool are one region, though nearly none are alike; near copies of two texts are among them."""
    rng = random.Random(8)
    pool = [" ".join(f"p{i}w{k}" for k in range(9)) for i in range(60)]
    texts = [" ".join([*rng.sample(pool, 4), *(f"own{i}" for _ in range(2))]) for i in range(240)]
    for i in range(40):
        words = [f"base{i % 2}x{k}" for k in range(80)] + pool[i % 3].split(" ")
        words[i % 80] = f"new{i}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = groups([{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)])
    least = {}
    for i, g in enumerate(found):
        least.setdefault(g, i)
    rows, stored = {}, jaccard.stored

    def counted_rows(df, label):
        out = stored(df, label)
        rows.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(jaccard, "stored", counted_rows)
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, 1500).collect()}
    assert got == {i: least[g] for i, g in enumerate(found)} and len(set(got.values())) > 200
    assert sum(rows["members"]) > 250 and sum(rows.get("refined", [])) < 250 and sum(rows.get("cells", [])) <= 2 * 280, rows


def test_region_join_is_exact_on_chains():
    rng, dice = np.random.default_rng(3), random.Random(4)
    for _ in range(25):
        sets = []
        for _ in range(5):
            start = now = rng.integers(0, 1 << 60, int(rng.integers(5, 60)), dtype=np.uint64)
            for _ in range(int(rng.integers(1, 18))):
                now = (start if dice.random() < 0.5 else now).copy()
                k = int(rng.integers(0, len(now) // 6 + 1))
                now[rng.choice(len(now), k, replace=False)] = rng.integers(0, 1 << 60, k, dtype=np.uint64)
                sets.append(np.unique(now))
        parent = list(range(len(sets)))

        def root(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in join_region(list(range(len(sets))), sets):
            parent[root(a)] = root(b)
        pairs = set(zip(groups([set(s.tolist()) for s in sets]), [root(i) for i in range(len(sets))], strict=True))
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_fingerprints(spark, odd, odd_rows, none):
    got = lz.fingerprint_chain(odd, buckets=5).collect()
    order = sorted(odd_rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for i, (d, t, *_) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        want.append((d, len(t), sha(t[: len(t) - half] + after[:half])))
    assert counted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == counted(want)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].fingerprint == by_id[2].fingerprint and by_id[6].fingerprint == by_id[7].fingerprint
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    assert by_id[90].near_edited > by_id[90].near_next and lz.fingerprint_chain(none).collect() == []
    one = lz.fingerprint_chain(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1


def test_likeness_follows_the_phrase_sets(odd_rows):
    texts = [t for _, t, *_ in odd_rows if t and len(t) > 900][:8]
    for a in texts:
        for b in texts:
            x, y = lz.phrases(a), lz.phrases(b)
            assert abs(len(x & y) / len(x | y) - lz.likeness(lz.signature(a), lz.signature(b))) < 5 * lz.LIKENESS_ERROR


def test_licenses(spark, none):
    mit, bsd = dict(LICENSES)["MIT"], dict(LICENSES)["BSD-3-Clause"]
    wrapped = lambda text, width: "\n".join(textwrap.wrap(text, width))
    texts = {
        1: (mit, "MIT"), 2: ("Copyright (c) 2020 Someone\nAll rights reserved.\n\n" + mit.upper().replace(",", " ;"), "MIT"), 3: (mit + " more", None), 4: (None, None),
        5: ("released UNDER the mit   licence", "MIT-notice"), 6: ("", None), 7: ("MIT License\n\nCopyright 2019 A. Person\n\n" + wrapped(mit, 70), "MIT"),
        8: ("The MIT License (MIT)\n(c) 2001 me\n" + wrapped(mit, 31), "MIT"), 9: ("# BSD 3-Clause License\n\nCopyright (c) <year>, <owner>\n" + wrapped(bsd, 79), "BSD-3-Clause"),
        10: (wrapped(dict(LICENSES)["Unlicense"], 60), "Unlicense"), 11: ("MIT License", None), 12: ("word " * 200_000, None),
    }
    rows = [(d, t, "x") for d, (t, _) in texts.items()] + [(None, mit, "x"), (1, mit, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, body string").repartition(2)
    got = [(r.doc_id, r.license) for r in scan_licenses(docs).collect()]
    assert counted(got) == counted([(d, name) for d, (_, name) in texts.items()] + [(None, "MIT"), (1, "MIT")])
    assert scan_licenses(none).collect() == []
    for name, digest in DIGESTS:
        path = {"BSD-3-Clause-UC": "BSD", "Artistic-1.0-Perl": "Artistic"}.get(name, re.sub(r"(?<=GPL-[123])\.0$", "", name))
        if os.path.exists(f"/usr/share/common-licenses/{path}"):
            text = open(f"/usr/share/common-licenses/{path}", encoding="utf-8", errors="replace").read()
            found = scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
            assert (found.digest, found.license) == (digest, name)


def test_notices_name_the_licences_of_lines(spark):
    text = "code\nLicensed under the Apache Licence, version 2.0\nprose about a license\nReleased under the MIT License."
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.found for r in docs.select("doc_id", notices(spark, F.col("text")).alias("found")).collect()}
    assert got == {1: ["Apache-2.0-notice", "MIT-notice"], 2: [], 3: []}
