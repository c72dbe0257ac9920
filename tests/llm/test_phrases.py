"""Phrase mining against brute force, with samples so poor that the border fails and further passes are needed."""

import collections
import re

import pyarrow as pa
import pytest
from partflow.llm import phrases as ph

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def expected(rows, support, top, holding=50):
    n, f = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    out = []
    for lang in n:
        found = []
        for (g, p), a in f.items():
            if g != lang or len(p) == 1 or a < support:
                continue
            longer = [c for (h, q), c in f.items() if h == lang and len(q) == 3 and len(p) == 2 and c >= support and p in (q[:2], q[1:])]
            if any(100 * c >= holding * a for c in longer):
                continue
            cuts = [(1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
            score, _, l, r = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("mining", [{}, {"sample_parts": 50, "sample_support": 3}, {"log_bits": 16}])
def test_collocations(odd, odd_rows, mining):
    rows = [(lang, t) for _, t, lang, *_ in odd_rows]
    want = expected(rows, 10, 25)
    assert sorted(map(tuple, ph.collocations(odd, top=25, **mining).collect())) == want
    assert {w[0] for w in want} == {"en", "de"} and any(w[2].count(" ") == 2 for w in want)


def test_border_failures_are_closed_by_further_passes(spark):
    rows = [("x y", "alpha beta gamma. " * 4 + "Alpha BETA\tgamma, delta ! one;two")] * 3 + [(None, "alpha beta"), ("x y", None), ("x y", "")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    counts, words, passes = ph.mined_counts(docs, sample_support=10**6)  # nothing is proposed
    found = {r.key: r.f for r in counts.collect()}
    assert found == {f"x y\t{p}": 15 for p in ("alpha", "beta", "gamma", "alpha beta", "beta gamma", "alpha beta gamma")}
    assert passes == 3 and {tuple(r) for r in words.collect()} == {("x y", 54), ("und", 2)}
    (best,) = ph.collocations(docs).collect()
    assert tuple(best) == ("x y", 1, "alpha beta gamma", 15, 15, 15, 54, 1000000)


def test_ties_go_to_bytes_and_empty_tables_give_no_rows(spark, none):
    text = "\n".join(["b é", "b z", "a zz", "a é z"] * 12)
    rows = [("en", text)]
    got = sorted(map(tuple, ph.collocations(spark.createDataFrame(rows, "lang string, text string")).collect()))
    names = [g[2] for g in got]
    assert got == expected(rows, 10, 2000) and names.index("b é") == names.index("b z") + 1
    assert ph.collocations(none).collect() == []


def test_runs_are_cut_at_breaks(monkeypatch):
    monkeypatch.setattr(ph, "BLOCK", 20)
    text = b"one two three four five six seven. eight nine ten. " * 5
    runs = list(ph._segments([text]))
    assert len(runs) > 3 and b"." .join(runs) == text
    block = ph.Block(b"a b a b. a b", "en")
    assert dict(zip(*[x.to_pylist() if hasattr(x, "to_pylist") else x.tolist() for x in block.counted(block.pair, 2)])) == {b"en\ta b": 3, b"en\tb a": 1}


def test_only_frequent_phrases_and_totals_are_written(spark, monkeypatch):
    """Words and phrases below the support count for their language's total and are not stored."""
    written, store = {}, ph.stored
    monkeypatch.setattr(ph, "stored", lambda df, label: written.update({label: store(df, label)}) or written[label])
    rare = " ".join(f"w{i}" for i in range(500))
    docs = spark.createDataFrame([("en", "a b. " * 20 + rare), ("de", "x y z"), ("fr", " . ")], "lang string, text string")
    frequent, by_lang, _ = ph.mined_counts(docs)
    assert {r.lang: r.n for r in by_lang.collect()} == {"en": 540, "de": 3}
    assert {r.key: r.f for r in frequent.collect()} == {"en\ta": 20, "en\tb": 20, "en\ta b": 20}
    assert written["phrases"].count() <= 6


def test_texts_of_a_language_are_counted_together_over_batches(monkeypatch):
    batches = [pa.record_batch([pa.array(["en", "de", "en"]), pa.array(["a b", "x y", "c"])], names=["lang", "text"])] * 3
    assert list(ph._runs(iter(batches))) == [("en", b"a b.c.a b.c.a b.c"), ("de", b"x y.x y.x y")]
    monkeypatch.setattr(ph, "BLOCK", 8)
    assert [r for r in ph._runs(iter(batches)) if r[0] == "en"] == [("en", b"a b.c.a b"), ("en", b"c.a b.c")]
    monkeypatch.setattr(ph, "BLOCK", 1 << 20)
    monkeypatch.setattr(ph, "HELD", 20)  # many languages wait for no more than this
    many = [pa.record_batch([pa.array([f"l{i}" for i in range(50)]), pa.array(["a b"] * 50)], names=["lang", "text"])]
    runs = list(ph._runs(iter(many)))
    assert len(runs) == 50 and [r[0] for r in runs[:5]] == [f"l{i}" for i in range(5)]
