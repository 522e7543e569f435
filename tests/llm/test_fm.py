"""The FM-index and the substring dedup that rests on it, against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile("[^\x20\x09-\x0d]+")


def test_index_by_counting():
    """Suffixes in order, ranks, and the matching statistics of every end, by counts of the words themselves."""
    from gleaner.llm.passage_index import FMIndex, WaveletTree

    rng = np.random.default_rng(2)
    for n, sigma in ((1, 1), (70, 2), (400, 3), (400, 40)):
        text = np.append(rng.integers(1, sigma + 1, n), sigma + 1)
        index = FMIndex(text)
        assert index.suffixes.tolist() == sorted(range(n + 1), key=lambda i: text[i:].tolist())
        tree = WaveletTree(text, int(text.max()).bit_length())
        at, symbol = rng.integers(0, n + 2, 50), rng.integers(0, sigma + 2, 50)
        assert tree.rank(symbol, at).tolist() == [int((text[:a] == c).sum()) for a, c in zip(at.tolist(), symbol.tolist(), strict=True)]
        ends = np.arange(5, n)
        length, low, high = index.matching(text, ends, 6)
        for e, k, a, b in zip(ends.tolist(), length.tolist(), low.tolist(), high.tolist(), strict=True):
            def met(m, e=e):
                return [i for i in range(n + 1) if text[i : i + m].tolist() == text[e - m + 1 : e + 1].tolist()]

            assert k == max((m for m in range(1, 7) if len(met(m)) > 1), default=0)
            assert not k or sorted(index.suffixes[a:b].tolist()) == met(k)


def brute(rows, words):
    """[(doc_id, n_words, n_removed, text)] by a table of all passages."""
    said = [(i, WORD.findall(t or "")) for i, t in rows if i is not None]
    least = {}
    for i, w in said:
        for k in range(len(w) - words + 1):
            p = tuple(w[k : k + words])
            least[p] = min(least.get(p, i), i)
    out = []
    for i, w in said:
        gone = {k + j for k in range(len(w) - words + 1) if least[tuple(w[k : k + words])] < i for j in range(words)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé日") for _ in range(r.randint(1, 7))) for _ in range(300)]

    def said(n):
        return " ".join(r.choices(vocabulary, k=n))

    common, rows = said(40), [None, "", " \n\t", "one", said(13), "same " * 500, "same " * 80, "a b " * 300]
    for n in (30, 200, 900):
        t = said(n)
        rows += [t, t, t.replace(" ", "\n")]
        for _ in range(8):
            w = t.split()
            for _ in range(max(1, n // 30)):
                w[r.randrange(n)] = r.choice(vocabulary)
            rows.append(" ".join(w))
    for _ in range(60):  # a passage in many texts, each time with other words around
        rows.append(f"{said(r.randint(0, 30))} {common} {said(r.randint(0, 30))}")
    rows.append("x" * 3000 + " " + common)
    ids = list(range(len(rows)))
    r.shuffle(ids)
    return [*zip(ids, rows, strict=True), (None, common), (ids[9], rows[9]), (ids[9], f"{common} and more"), (3, common)]


@pytest.mark.parametrize(("words", "gram", "hot"), [(13, 4, 20_000), (13, 4, 20), (5, 2, 20_000), (6, 6, 3)])
def test_passages_of_earlier_texts(spark, monkeypatch, words, gram, hot):
    from gleaner.llm import passage_index as P

    monkeypatch.setattr(P, "HOT", hot)
    rows = corpus(words)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("t", "place", "name", "key", "low", "n_words", "passages", "of_id")}).repartition(3)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in P.without_earlier_passages(df, words, gram).collect())
    assert got == brute(rows, words)
    assert sum(x[2] for x in got) > 1000


def test_texts_over_a_block(spark):
    """A text of more than a MiB beside its own pieces, and no rows at all."""
    from gleaner.llm.passage_index import without_earlier_passages

    r = random.Random(4)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    long = " ".join(r.choices(words, k=200_000))
    rows = [(5, long), (1, long[500_000:520_000]), (9, long[1_300_000:1_310_000]), (7, "short " * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x.doc_id, x.n_words, x.n_removed, x.text) for x in without_earlier_passages(df).collect())
    assert got == brute(rows, 13)
    assert without_earlier_passages(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1, 300, 2000, 1 << 20])
def test_shards_hold_whole_names(monkeypatch, size):
    """Shards of any size, whatever the batches: each stretch's passages against those of smaller id under its name."""
    import pyarrow as pa

    from gleaner.llm import passage_index as P

    monkeypatch.setattr(P, "SHARD_BYTES", size)
    monkeypatch.setattr(P, "_STEP_ROWS", 3)
    r, words, rows = random.Random(6), 4, []
    for name in range(20):
        for k in range(r.randint(1, 9)):
            before = r.randint(0, 3)
            said = [f"n{name}é{r.randrange(2)}" for _ in range(before + words + r.randint(0, 3))]
            rows.append((name, k, r.randrange(6), before, " ".join(said).encode()))
    columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (*[pa.int64()] * 4, pa.binary()), strict=True)]
    whole = pa.RecordBatch.from_arrays(columns, names=["name", "key", "low", "before", "stretch"])
    got = {}
    for rb in P._by_shard(words)(iter([whole.slice(0, 7), whole.slice(7, 40), whole.slice(47)])):
        got |= {(n, k): p for n, k, p in zip(*(c.to_pylist() for c in rb.columns), strict=True)}
    least = {}
    for name, _, low, _, said in rows:
        w = said.split()
        for i in range(len(w) - words + 1):
            p = (name, *w[i : i + words])
            least[p] = min(least.get(p, low), low)
    want = {}
    for name, k, low, before, said in rows:
        w = said.split()
        d = [before - i for i in range(len(w) - words + 1) if least[name, *w[i : i + words]] < low and before >= i]
        if d:
            want[name, k] = sum(1 << x for x in d)
    assert got == want and want
