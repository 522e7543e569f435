"""The pipeline's repeated passages against brute force over words."""

from __future__ import annotations

import collections
import random

import corpus_pipeline
from gleaner.llm import suffix_dedup


def test_repeated_passages(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", 3)
    rng = random.Random(7)

    def prose(n):
        return ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 7))) for _ in range(n)]

    passages = {n: prose(n) for n in (50, 51, 52, 58, 65)}
    assert all(len(" ".join(p).encode()) < 400 for p in passages.values())
    passages[49] = [w * 5 for w in prose(49)]  # few words, over 400 bytes
    whole = {}
    for n, p in passages.items():
        for copy in range(3):
            whole[len(whole)] = " ".join([*prose(70 + copy), *p, *prose(40)])
    whole[len(whole)] = " ".join([*prose(30), *passages[65][5:60], *prose(30)])  # part of a passage
    whole[len(whole)] = "\n".join([*prose(30), *passages[58], *prose(30)])  # other white space
    whole[len(whole)] = " ".join(passages[51])  # nothing else
    whole[len(whole)] = ""
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in whole.items()], "doc_id long, text string, n_chars long")
    split = {i: t.split() for i, t in whole.items()}
    met = collections.Counter(tuple(w[i : i + 51]) for w in split.values() for i in range(len(w) - 50))
    want = {}
    for k, w in split.items():
        gone = {j for i in range(len(w) - 50) if met[tuple(w[i : i + 51])] > 1 for j in range(i, i + 51)}
        want[k] = [x for j, x in enumerate(w) if j not in gone]
    got = corpus_pipeline.repeated_passages(spark, docs, "").collect()
    assert all(r.n_chars == len(r.text) for r in got)
    got = {r.doc_id: r.text.split() for r in got}
    long = [k for k in got if set(passages[49]) & set(whole[k].split())]
    assert len(long) >= 3 and got.keys() == want.keys()
    for k in got:
        if k in long:
            assert len(got[k]) <= len(want[k]) - 47  # strings of 400 bytes go as before; a byte run may reach into words
        else:
            assert got[k] == want[k]
