"""Operators and stages against brute force, with empty tables, clashing columns and repeated ids."""

from __future__ import annotations

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleaner.llm import _blocks as B
from gleaner.llm import queries as Q
from gleaner.llm._shared import written

SF = "/root/testdata/sf0.001"
CLASHING = ["kept_id", "bad_id", "first_id", "row", "row_id", "other_id", "row_place", "doc_key", "cut_key", "kept", "cluster", "name", "pattern", "posterior", "component_id", "n_words"]


def test_stages_with_clashing_columns_and_repeated_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.where("doc_id = 1")
    docs = docs.unionByName(first).unionByName(first.withColumn("text", F.concat("text", F.lit(" and more of it")))).unionByName(first.withColumn("doc_id", F.lit(None).cast("long")))
    now = docs.withColumns({c: F.lit(7) for c in CLASHING})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, now, SF), name)  # as run() does
        assert after.columns == now.columns, name
        if name == "near_duplicates":
            assert after.groupBy("doc_id").count().where("count > 1").count() == 0
            one = after.where("doc_id = 1").collect()
            assert not one or one[0].text == min(r.text for r in now.where("doc_id = 1").collect())
        now = after
    assert corpus_pipeline.STAGES[-1][1](spark, now, SF).where("NOT round_trip").count() == 0


def test_empty_tables(spark, tmp_path):
    from gleaner.llm.chat_format import chat_digests
    from gleaner.llm.viterbi import decode_ids
    from gleaner.llm.warc import read_archives, record_digests, write_archives

    pages = spark.createDataFrame([], "page_id long, url string, html string")
    archives, folder = write_archives(pages, folder=str(tmp_path / "none"))
    assert record_digests(read_archives(archives, folder)).count() == 0
    assert chat_digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert decode_ids(spark.createDataFrame([], "doc_id long, ids array<int>"), Q.tokenizer("piece_bpe_32k.model")).count() == 0
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_archives_in_folders_of_any_form(spark, tmp_path):
    """A path without a scheme, Hadoop's form of a local one, and a URI; a scheme that nothing opens is refused at once."""
    from gleaner.llm.warc import read_archives, record_digests, shared_uri, write_archives

    pages = spark.createDataFrame([(1, "http://a/", "x" * 200), (2, "http://b/", None), (3, "http://c/", "x" * 200)], "page_id long, url string, html string")
    want = None
    for k, form in enumerate(("{}", "file:{}", "file://{}")):
        archives, folder = write_archives(pages, folder=form.format(f"{tmp_path}/archives-{k}"))
        assert folder == f"file://{tmp_path}/archives-{k}" and list((tmp_path / f"archives-{k}").iterdir())
        got = sorted(map(tuple, record_digests(read_archives(archives, folder)).collect()))
        assert got[0][3:] == ("response", None) and got[2][3:] == ("revisit", 1) and (want is None or got == want)
        want = got
    with pytest.raises(ValueError, match="can't be kept"):
        write_archives(pages, folder="nosuch://bucket/x")
    assert shared_uri(spark, f"{tmp_path}/a b").startswith("file:///")


def plain_em(votes, own, steps=100, trust=0.8, pseudo=0.01):
    """EM text by text in plain Python: a dictionary for each label; votes are 0, 1 or 2 (none); own: rules of each label."""
    n, k = len(votes), len(votes[0])
    share = [trust] + [(1 - trust) / (len(own) - 1)] * (len(own) - 1)
    chance = [[{0: trust, 1: (1 - trust) / 2, 2: (1 - trust) / 2} if r in o else {0: (1 - trust) / 2, 1: trust, 2: (1 - trust) / 2} for r in range(k)] for o in own]
    first, now = (share, chance), (share, chance)

    def labels(v):
        p = [s * math.prod(c[r][x] for r, x in enumerate(v)) for s, c in zip(*now, strict=True)]
        return [x / sum(p) for x in p]

    kinds = collections.Counter(map(tuple, votes))
    for _ in range(steps):
        told = {v: labels(v) for v in kinds}
        mass = [sum(told[v][j] * m for v, m in kinds.items()) / n for j in range(len(own))]
        chance = [[{x: (sum(told[v][j] * m for v, m in kinds.items() if v[r] == x) / n + pseudo * first[1][j][r][x]) / (mass[j] + pseudo) for x in range(3)} for r in range(k)] for j in range(len(own))]
        now = ([(m + pseudo * f) / (1 + pseudo) for m, f in zip(mass, first[0], strict=True)], chance)
    return {v: labels(v)[0] for v in kinds}


def test_kept_is_what_plain_em_gives(spark):
    from gleaner.llm.quality_rules import KINDS, RULES, figures, judged

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols = [F.when(F.expr(bad), 0).when(F.expr(good), 1).otherwise(2).alias(f"r{i}") for i, (good, bad) in enumerate(RULES.values())]
    rows = figures(docs).select("doc_id", *cols).orderBy("doc_id").collect()
    names = list(RULES)
    want = plain_em([tuple(r[1:]) for r in rows], [set(), *({names.index(x) for x in kind} for kind in KINDS)])
    got = {r.doc_id: r for r in judged(docs).collect()}
    for r in rows:
        p = want[tuple(r[1:])]
        assert got[r.doc_id].posterior == pytest.approx(p, abs=1e-9)
        assert got[r.doc_id].kept == (not got[r.doc_id].base_failed and p >= 0.5)
    assert any(not r.kept and not r.base_failed for r in got.values())
    many = docs
    for _ in range(3):
        many = many.unionByName(docs)
    again = {r.doc_id: r for r in judged(many).collect()}
    assert all(again[i].kept == got[i].kept and again[i].posterior == pytest.approx(got[i].posterior, abs=1e-9) for i in got)


def test_votes_are_weighed_not_counted():
    """Votes that go together make a bad text; a lone bad vote of a rule that errs is outvoted, one of a rule whose company
    is known is not; and a rule that abstains on bad texts tells so by abstaining."""
    from gleaner.llm.quality_rules import RULES, estimate, posterior

    names = list(RULES)

    def votes(**said):
        return tuple(said.get(n, 1) for n in names)

    noise, repeats = votes(symbols=0, letters=0, letterless=0), votes(lines=0, windows=0, variety=0)
    errs, alone, silent = votes(word_length=0), votes(symbols=0, letters=0), votes(symbols=0, letters=None, letterless=0)
    model = estimate([(votes(), 9000), (noise, 400), (repeats, 300), (errs, 200), (alone, 40), (silent, 40)])
    good = dict(zip(("plain", "noise", "repeats", "errs", "alone", "silent", "one"), posterior([votes(), noise, repeats, errs, alone, silent, votes(variety=0)], model), strict=True))
    assert good["plain"] > 0.99 and good["errs"] > 0.9 and good["one"] > 0.5
    assert max(good[x] for x in ("noise", "repeats", "alone", "silent")) < 0.01


def test_verdicts_agree_with_labels_never_learnt_from(spark):
    """On the documents of sf0.01: quality labels, for this count alone."""
    from gleaner.llm.quality_rules import judged

    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    said = judged(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(labels, "doc_id").groupBy("kept", "quality").count().collect()
    n = {(r.kept, r.quality): r["count"] for r in said}
    right = n.get((True, 1), 0) + n.get((False, 0), 0)
    assert right >= 0.97 * sum(n.values())


def test_knn_votes(spark):
    """All cosines and votes in plain Python."""
    from gleaner.llm.knn_quality import Space, features

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}

    def counts(texts):
        return np.concatenate([features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])) for t in texts])

    ids = sorted(set(labels) & set(docs))
    space = Space(counts([docs[i] for i in ids]), np.array([labels[i] for i in ids]), 16)
    some = [docs[i] for i in sorted(docs)[:40]] + [""]
    got = space.score(counts(some), 7, 0.08)
    for text, score in zip(some, got.tolist(), strict=True):
        y = space.place(counts([text]))[0].tolist()
        if not any(y):
            assert score == pytest.approx(space.prior)
            continue
        near = sorted(((sum(a * b for a, b in zip(y, v, strict=True)), labels[i]) for v, i in zip(space.vectors.tolist(), ids, strict=True)), reverse=True)[:7]
        weight = [math.exp((c - 1) / 0.08) for c, _ in near]
        assert score == pytest.approx(sum(w * x for w, (_, x) in zip(weight, near, strict=True)) / sum(weight), abs=2e-3)


def test_viterbi_by_a_plain_search(spark):
    """The installed model: one search over each whole text, without stretches or windows."""
    from gleaner.llm.viterbi import encode_documents, pieces

    path = Q.tokenizer("piece_bpe_32k.model")
    p = pieces(path)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 5 = 0")
    extra = spark.createDataFrame([(-1, "日本語😀▁ \t\n  x"), (-2, "a" * 300), (-3, "  lead and trail  ")], "doc_id long, text string")
    rows = docs.select("doc_id", F.substring("text", 1, 700).alias("text")).unionByName(extra)
    got = {r.doc_id: list(r.ids) for r in encode_documents(rows, path, ids=True).collect()}
    for r in rows.collect():
        if not r.text:
            continue
        t = " " + r.text
        best, back = [0.0] + [-math.inf] * len(t), [(0, [])] * (len(t) + 1)
        for e in range(1, len(t) + 1):
            options = [(best[s] + p.scores[p.ids[t[s:e]]], s) for s in range(max(0, e - p.reach), e) if t[s:e] in p.ids]
            if options:
                top = max(x for x, _ in options)
                s = next(s for x, s in options if x == top)
                best[e], back[e] = top, (s, [p.ids[t[s:e]]])
            else:
                best[e], back[e] = best[e - 1] + p.unknown, (e - 1, p.bytes_of(t[e - 1]))
        path_ids, e = [], len(t)
        while e:
            path_ids[:0] = back[e][1]
            e = back[e][0]
        assert got[r.doc_id] == path_ids, r.doc_id


def test_window_of_a_text_without_spaces():
    """A text of half a million characters without a space, in parts of any size: the window stays within a few reaches where
    paths meet - a run of one letter keeps them apart, here for 400 characters - and the ids are those of a search that
    keeps every boundary."""
    from gleaner.llm.viterbi import Stream, pieces

    p = pieces(Q.tokenizer("piece_bpe_32k.model"))
    text = ("internationalisation" * 40 + "日本語テキスト😀" * 30 + "aaaaaaaaaaaaaaaaaaaa" * 20 + "xqzj#$%0123456789" * 20) * 300
    assert len(text) > 500_000
    stream, ids = Stream(p), []
    for k in range(0, len(text), 997):
        ids += stream.feed(text[k : k + 997])
    ids += stream.end()
    assert stream.peak < 400 + 4 * p.reach
    plain = Stream(p)
    plain.feed(text.replace("a" * 20, ""))
    assert plain.peak <= 4 * p.reach
    assert b"".join(p.out[k] for k in ids) == text.encode()
    some = text[:3000]
    best, back = [0.0], [(0, [])]
    for e in range(1, len(some) + 1):
        options = [(best[s] + p.scores[p.ids[some[s:e]]], -s) for s in range(max(0, e - p.reach), e) if some[s:e] in p.ids]
        if options:
            top, s = max(options)
            best.append(top)
            back.append((-s, [p.ids[some[-s:e]]]))
        else:
            best.append(best[-1] + p.unknown)
            back.append((e - 1, p.bytes_of(some[e - 1])))
    path, e = [], len(some)
    while e:
        path[:0] = back[e][1]
        e = back[e][0]
    one = Stream(p)
    assert one.feed(some) + one.end() == path


def test_repeated_passages_leave_none(spark):
    """No string of 51 words stays in two texts, or twice in one, and texts without one are as they were."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text or "" for r in docs.collect()}
    after = {r.doc_id: r.text or "" for r in corpus_pipeline.repeated_passages(spark, docs, SF).collect()}

    def met(texts):
        n = collections.Counter()
        for t in texts.values():
            w = t.split()
            n.update(hash(tuple(w[i : i + 51])) for i in range(len(w) - 50))
        return {k for k, x in n.items() if x > 1}

    twice = met(before)
    assert twice and not met(after)
    blocks = collections.Counter(t.encode()[i : i + 400] for t in before.values() for i in range(len(t.encode()) - 399))
    for k, t in before.items():
        w, b = t.split(), t.encode()
        if not any(hash(tuple(w[i : i + 51])) in twice for i in range(len(w) - 50)) and not any(blocks[b[i : i + 400]] > 1 for i in range(len(b) - 399)):
            assert after[k] == t


def test_merged_ranks_against_brute_force():
    """The strings of contexts by ranks of their halves, against a count of the strings."""
    from gleaner.llm.suffix_dedup import merged

    rng = np.random.default_rng(4)
    for length, width in ((20, 8), (9, 9)):
        for _ in range(40):
            core = bytes(rng.integers(97, 99, width).tolist())
            raw, p, a = [], [], []
            for i in range(12):
                left, right = rng.integers(0, length - width + 1), rng.integers(0, length - width + 1)
                raw.append(bytes(rng.choice([97, 98, 0], left).tolist()) + core + bytes(rng.choice([97, 98, 0], right).tolist()))
                a.append(1000 * i)
                p.append(1000 * i + left)
            p, a, m = np.array(p), np.array(a), np.ones(12, np.int64)
            got = merged(p, a, m, raw, length, width)
            met = collections.Counter((d, x[b - d : b - d + length]) for x, b in zip(raw, (p - a).tolist(), strict=True) for d in range(length - width + 1) if 0 <= b - d and b - d + length <= len(x))
            for i, x in enumerate(raw):
                b = int(p[i] - a[i])
                for d in range(length - width + 1):
                    inside = 0 <= b - d and b - d + length <= len(x)
                    assert got[i, d] == (inside and met[d, x[b - d : b - d + length]] > 1)


def test_word_hashes_tell_words_apart():
    data = b"one two one  two\nthree"
    starts, ends, rows = B.words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    h = B.word_hashes(np.frombuffer(data, np.uint8), starts, ends)
    assert h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 3 and not rows.any()


def test_a_cluster_needs_a_shared_folder():
    from gleaner.llm import _shared

    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Conf:
        @staticmethod
        def get(name, default=None):
            return default

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        _shared.scratch_root(Session)
    Context.master = "local[2]"
    assert _shared.scratch_root(Session)


def test_large_cluster_of_common_lines_is_parted(spark, monkeypatch):
    from collections import Counter

    from gleaner.llm import ngram_join as N

    common = [[f"c{g}w{i}" for i in range(90)] for g in range(2)]
    texts = {i: " ".join([f"d{i}w{j}" for j in range(90)] + common[i % 2] + (common[1] if i == 0 else [])) for i in range(60)}
    texts |= {100 + i: texts[i] + " more words here" for i in range(0, 60, 6)}  # similar to one other each
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    made, old = [], N.written
    monkeypatch.setattr(N, "written", lambda df, label, *a: made.append((label, t := old(df, label, *a))) or t)
    monkeypatch.setattr(N, "SKETCH_SETS", 13)
    got = {r.doc_id: r.component_id for r in N.ngram_jaccard_components(docs, 5, 80, 100, block_sets=8).collect()}
    assert got == {i: i - 100 if i >= 100 else i for i in texts}
    assert [max(Counter(r.cluster for r in t.collect()).values()) for label, t in made if label == "sketched"][0] > 30  # chained by the common lines
    placed = [t for label, t in made if label == "placed"][0].collect()
    assert max(len(r.i) for r in placed) == 1 and len(placed) == 20  # each set with one like it goes to one task, no other to any


def test_sketches_of_similar_sets_are_near():
    import numpy as np

    from gleaner.llm import ngram_join as N

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 5, 63, 64, 65, 130, 700, 700, 5000, 60000)]
    near = [s[: max(1, len(s) * 9 // 10)] for s in sets]  # some of fewer buckets
    size, few = (np.array([len(s) for s in x]) for x in (sets, near))
    sketches = [N._sketch(s) for s in sets]
    assert set(N.sketch_links(sketches, size, [N._sketch(s) for s in near], few, 80, 100, False)) >= {(i, i) for i in range(2, len(sets))}
    assert N.sketch_links(sketches, size, sketches, size, 80, 100, True) == []
