"""The training-data operators against brute force and round trips, on small tables with nulls, ties and long texts."""

import collections
import hashlib
import json
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from gleaner.llm import queries as Q

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, cluster long, name string, n long"


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 9))) for _ in range(400)]
    base = [" ".join(r.choices(vocabulary, k=k)) for k in (300, 120, 60, 2500)]
    rows = [None, "", "  \n", "one", "two words", "ABC def ghi jkl", "abc DEF ghi jkl", "#$% *** &&& ||| <>" * 30, "same same " * 200, "x" * 1500]
    for t in base:
        w = t.split()
        rows += [t, t, t.upper()]
        for _ in range(6):
            v = list(w)
            for _ in range(max(1, len(v) // 40)):
                v[r.randrange(len(v))] = r.choice(vocabulary)
            rows.append(" ".join(v))
    rows += ["\n".join([base[1], base[2]]), base[0][50:700] + " tail", "日本語テキスト😀▁ \t\n  " * 20]
    rows = [(i, t, "en", 1, "n", 2) for i, t in enumerate(rows)] + [(None, "no id", "en", 1, "n", 2)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def texts(df):
    return {r.doc_id: r.text or "" for r in df.collect() if r.doc_id is not None}


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def components(sets, num, den):
    up = {k: k for k in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {k: root(k) for k in sets}


@pytest.mark.parametrize(("words", "num", "den", "block"), [(4, 85, 100, 2000), (4, 85, 100, 3), (5, 80, 100, 2)])
def test_ngram_join(docs, words, num, den, block):
    from gleaner.llm.ngram_join import ngram_jaccard_components

    sets = {}
    for k, t in texts(docs).items():
        w = WORD.findall(low(t))
        sets[k] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    want = components(sets, num, den)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_components(docs, words, num, den, block_sets=block).collect()}
    assert got == {k: (len(s), want[k]) for k, s in sets.items()}


def covered(rows, length):
    seen = collections.Counter(b[i : i + length] for b in rows.values() for i in range(len(b) - length + 1))
    return {k: [any(seen[b[i : i + length]] > 1 for i in range(max(0, p - length + 1), min(p, len(b) - length) + 1)) for p in range(len(b))] for k, b in rows.items()}


def test_suffix_dedup(docs, monkeypatch):
    from gleaner.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", 3)
    few = docs.where(F.length("text") < 4000)
    rows = {k: t.encode() for k, t in texts(few).items()}
    mask = covered(rows, 400)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.remove_repeats(few).collect()}
    assert got == {k: (len(b), sum(mask[k]), hashlib.sha256(bytes(x for x, m in zip(b, mask[k], strict=True) if not m)).hexdigest()) for k, b in rows.items()}
    left = {r.doc_id: r.text for r in suffix_dedup.remove_repeats(few).collect()}
    for k, b in rows.items():
        whole = bytes(x for x, m in zip(b, mask[k], strict=True) if not m)
        assert len(left[k].encode()) - len(whole) <= 6 * got[k][1] and (left[k].encode() == whole or b"\xc3" in b or b"\xe3" in b)


def test_empty_tables(spark):
    from gleaner.llm.contamination import contained_items
    from gleaner.llm.knn_quality import knn_scores
    from gleaner.llm.ngram_join import ngram_jaccard_components
    from gleaner.llm.quality_rules import judged
    from gleaner.llm.suffix_dedup import remove_repeats
    from gleaner.llm.token_counts import count_tokens
    from gleaner.llm.viterbi import encode_documents
    from gleaner.llm.wrapper import main_text

    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    items = spark.createDataFrame([], "item_id long, text string")
    found = [ngram_jaccard_components(none), remove_repeats(none), judged(none), contained_items(none, items), knn_scores(none, labels, "quality"), encode_documents(none, Q.tokenizer("piece_bpe_32k.model")), count_tokens(none, Q.tokenizer("byte_bpe_50k.tiktoken")), main_text(spark.createDataFrame([], "page_id long, url string, html string"))]
    assert [f.count() for f in found] == [0] * len(found)


def test_quality_rules(docs):
    from gleaner.llm.quality_rules import estimate, first_model, judged, posterior

    got = {r.doc_id: r for r in judged(docs).collect()}
    for k, t in texts(docs).items():
        w = WORD.findall(t)
        n = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {j for i in range(len(w) - 7) if n[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), failed)
        assert not (r.kept and failed)
    patterns = [((1, None), 900), ((0, 0), 90), ((None, 0), 10)]
    start = first_model(("a", "b"), (("a", "b"),))
    model = estimate(patterns, start=start)
    good, bad = posterior([(1, None), (0, 0)], model)
    assert 0.8 < model.shares[0] < 1 and good > 0.9 > 0.1 > bad
    again = estimate([(v, 100 * n) for v, n in patterns], start=start)
    assert (again.shares == model.shares).all() and (again.chances == model.chances).all()


def test_decontamination(spark, docs):
    from gleaner.llm.contamination import contained_items, decontaminated

    whole = texts(docs)
    passage = " ".join(whole[10].split()[20:60])
    items = spark.createDataFrame([(1, passage), (2, passage.upper() + "!"), (3, "two, words"), (4, None), (5, ""), (6, "quite other words that no text has here")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contained_items(docs, items).collect()}

    def shingles(t, k):
        w = [x for x in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t.lower()) if x]
        k = min(k or 5, len(w)) if k is None else k
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}, k

    want = set()
    for i, t in ((1, passage), (2, passage.upper()), (3, "two words"), (6, "quite other words that no text has here")):
        s, k = shingles(t, None)
        want |= {(d, i) for d, x in whole.items() if 5 * len(s & shingles(x, k)[0]) >= 4 * len(s)}
    assert got == want and (10, 1) in got
    assert decontaminated(docs, items).count() == docs.count() - len({d for d, _ in want})


def test_viterbi(docs, spark, tmp_path):
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as pb

    from gleaner.llm.viterbi import Stream, decode_ids, encode_documents, pieces

    model = pb.ModelProto()
    model.ParseFromString(open(Q.tokenizer("piece_bpe_32k.model"), "rb").read())
    model.trainer_spec.model_type = 1
    for p in model.pieces:  # the library adds in single precision, where -1e9 swallows the rest
        p.score = max(p.score, -40000)
    path = str(tmp_path / "m.model")
    open(path, "wb").write(model.SerializeToString())
    library, own = SentencePieceProcessor(model_file=path), pieces(path)
    enc = encode_documents(docs, path, ids=True)
    got = {r.doc_id: r for r in enc.collect()}
    for k, t in texts(docs).items():
        assert got[k].round_trip and own.decode(got[k].ids).decode() == t
        if len(t) < 400 and "▁" not in t:
            assert got[k].ids == library.encode(t)
        s = Stream(own)
        if t:
            assert s.feed(" " + t[:300]) + s.end() == own_ids(own, t[:300]) and s.peak <= 4 * own.reach + 8
    assert {r.doc_id: r.text for r in decode_ids(enc, path).collect()} == texts(docs)


def own_ids(own, t):
    import numpy as np

    return np.frombuffer(own.encode([t])[0], "<i4").tolist()


def encoder(path):
    import base64

    import tiktoken

    from gleaner.llm.token_counts import PATTERN

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("whole", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_token_counts(docs):
    from gleaner.llm.token_counts import CountedText, counter

    path = Q.tokenizer("byte_bpe_50k.tiktoken")
    count, whole, r = counter(path), encoder(path), random.Random(3)
    for t in [*texts(docs).values(), "a'll b'", "x   \n\n  y", "'''s ''re 'r"]:
        for size in (1, 4):
            c, now = CountedText(t, count, size), t
            assert c.n_tokens == len(whole(t))
            for _ in range(6):
                a = r.randrange(len(now) + 1)
                b, new = min(len(now), a + r.choice([0, 1, 2, 90])), r.choice(["", " ", "'s x", "\n\n", "'", t[:70] * 9])
                c.edit(a, b, new)
                now = now[:a] + new + now[b:]
                assert c.text() == now and c.n_tokens == len(whole(now))


def test_token_trees(spark, tmp_path):
    """A second batch of edits starts from the written trees of the first and encodes its own regions alone."""
    from pyspark.sql import functions as F

    from gleaner.llm.token_counts import CountedText, count_tokens, counter, edited_trees, token_trees

    path = Q.tokenizer("byte_bpe_50k.tiktoken")
    whole = encoder(path)
    r = random.Random(5)
    rows = [(1, "one two three  four\n\nfive " * 400, "a"), (2, "", "b"), (3, None, None), (1, "x", "c"), (None, "lost", "d"), (4, "word " * 300_000, "e")]
    trees = token_trees(spark.createDataFrame(rows, "doc_id long, text string, chars_of string"), path, carried=("chars_of",))
    trees.write.parquet(f"{tmp_path}/0")
    now = {k: t or "" for i, t, k in rows if i is not None}
    for batch in range(3):
        edits, after = [], {}
        for k, t in now.items():
            own = []
            for _ in range(3):
                a = r.randrange(len(t) + 1)
                b, new = a + r.choice([0, 3, 40]), r.choice(["", " and", "\n \n", "it's so " * 90])
                own.append((a, b, new))
                t = t[:a] + new + t[b:]
            edits.append((k, own if k != "b" else None))
            after[k] = t if k != "b" else now[k]
        given = spark.createDataFrame(edits, "k string, edits array<struct<start:int,stop:int,new:string>>")
        kept = spark.read.parquet(f"{tmp_path}/{batch}")
        found = edited_trees(kept.join(given, F.expr("chars_of <=> k"), "left"), path, F.col("edits"), carried=("chars_of",))
        found.drop("n_edits", "n_chars_encoded").write.parquet(f"{tmp_path}/{batch + 1}")
        now = after
        got = {x.chars_of: x for x in found.collect()}
        assert got.keys() == now.keys()
        for k, t in now.items():
            assert (got[k].text, got[k].tokens[1], got[k].chars[1]) == (t, len(whole(t)), len(t))
            assert got[k].n_edits == (0 if k == "b" else 3)
        assert got["e"].n_chars_encoded < 5_000
    counted = {x.doc_id: x for x in count_tokens(spark.range(1, 40).selectExpr("id AS doc_id", "repeat('a ', int(id)) AS text"), path, size=1).collect()}
    assert all(x.n_leaves == len(CountedText("a " * k, counter(path), 1).leaf) for k, x in counted.items())


def test_token_counts_query(spark):
    """The registered edits against whole encodings of the edited texts, and what they had to encode again."""
    whole = encoder(Q.tokenizer("byte_bpe_50k.tiktoken"))
    got = {r.doc_id: r for r in Q.op2_token_counts(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    for d in rows:
        t = now = d.text or ""
        n = len(t)
        for a, b, new in ((n // 3, n // 3 + 9, f" {d.lang or ''} "), (n // 2, n // 2, f"\n{d.source or ''}\n"), (n - 5, n + 100, "")):
            a = min(max(a, 0), len(now))
            b = min(max(b, a), len(now))
            now = now[:a] + new + now[b:]
        r = got[d.doc_id]
        assert (r.n_tokens, r.n_tokens_edited, r.n_chars_edited, r.n_edits) == (len(whole(t)), len(whole(now)), len(now), 3)
    assert len(rows) == len(got) and sum(r.n_chars_encoded for r in got.values()) < 0.05 * 3 * sum(len(d.text or "") for d in rows)


def test_warc(spark, tmp_path):
    from gleaner.llm.warc import read_archives, record_digests, write_archives

    big = "é" * 5000
    rows = [(1, "http://a/\r\nx", None), (2, None, ""), (3, "u", big), (4, "u", big), (5, "u", "short"), (6, "u", "short"), (7, "u", "a\r\n\r\nb" * 40), (None, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives, folder = write_archives(pages, folder=str(tmp_path / "w"))
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in record_digests(read_archives(archives, folder, False)).collect()}
    sha = {i: hashlib.sha256((t or "").encode()).hexdigest() for i, _, t in rows}
    assert got == {i: (len((t or "").encode()), sha[i], "revisit" if i == 4 else "response", 3 if i == 4 else None) for i, _, t in rows}
    chunks = read_archives(archives, folder, True, 1000).where("page_id = 3").orderBy("chunk_no").collect()
    assert b"".join(bytes(c.chunk) for c in chunks) == big.encode() and len(chunks) >= 10
    assert chunks[0].digest_so_far == hashlib.sha256(bytes(chunks[0].chunk)).hexdigest()


def test_chat(spark):
    from gleaner.llm.chat_format import chat_digests

    odd = ["\\### Assistant: </turn> ok", "", None, "\\0\\1</turn", "###</turn>\n### user:\n", "a\\"]
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(odd)] + [(2, 0, "assistant", "x"), (3, 1, "user", "b"), (3, 1, "user", "b"), (3, None, None, "a:\n")]
    got = {r.conv_id: r for r in chat_digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    by = collections.defaultdict(list)
    for c, n, role, t in rows:
        by[c].append((-1 if n is None else n, role or "", t or ""))
    for c, turns in by.items():
        said = "".join(f"{role}\n{t}\n" for _, role, t in sorted(turns))
        loss = "".join(t for _, role, t in sorted(turns) if role == "assistant")
        assert (got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256, got[c].n_turns) == (hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(turns))
    assert got[1].valid and not got[2].valid and not got[3].valid


def test_wrapper(spark):
    from gleaner.llm.wrapper import aligned, main_text

    def page(i, wrap="<article>{}</article>"):
        return "<html><head><title>t</title><style>p{}</style></head><body><nav><a>Home</a></nav><div class='box'>Same notice</div>" + wrap.format(f"<h1>Title {i}</h1><p>A &amp; b<br>c\u00a0 d {i}<p><b>two</b>") + "<form>f<input></form><footer>x</footer><script>'</p>'</script>"

    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(4)] + [(i, f"http://g.example/{i}", page(i, "<div class='text'>{}</div>")) for i in range(4, 8)] + [(8, None, None), (9, "http://h.example/9", page(1))]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: f"Title {i}\n\nA & b c d {i}\n\ntwo" for i in range(8)}, 8: "", 9: "Title 1\n\nA & b c d 1\n\ntwo"}
    assert aligned("0 #\n1 a\n1 b\n2 c", "0 #\n1 b\n2 c\n1 d") == [0, -1, 1, 2]
    assert aligned("0 #\n1 b\n1 a\n2 x\n2 y", "0 #\n1 a\n2 x\n2 y\n1 b") == [0, -1, 1, 2, 3]  # the heavier of two that cross


def test_knn_quality_held_out(spark):
    got = Q.op3_knn_quality(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    x = got.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.min("score"), F.max("score")).first()
    assert x[0] >= 0.95 and 0 <= x[1] <= x[2] <= 1


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = Q.QUERIES[name](spark, SF)
    found = c.execute(Q.ORACLE[name])
    columns = [d[0] for d in found.description]
    want = sorted(json.dumps([float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v for v in r], default=float) for r in found.fetchall())
    got = sorted(json.dumps([float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v for v in (r[k] for k in columns)], default=float) for r in df.collect())
    assert got == want and set(df.columns) == set(columns)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now, before = stage(spark, now, SF), now
        assert name == "token_ids" or now.columns == docs.columns
        assert now.count() <= before.count()
    assert now.where("NOT round_trip").count() == 0 and now.count() > 50
