"""Each operator against brute force on small fixtures, with odd inputs."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import bpe, decontaminate, langid, licenses, lm, quality, simhash, suffix, warc

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


def documents(spark, rows):
    """Rows (doc_id, text) with the other columns and one whose name an operator uses itself."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, fp int")


@pytest.fixture(scope="module")
def rows():
    base = [prose(k, 60) for k in range(12)]
    out = list(enumerate(base))
    out += [(100, base[0]), (101, base[0] + " more"), (102, None), (103, ""), (104, "   \n\t"), (105, "Éa ß" * 30), (None, base[1]), (106, base[2][:250] + base[3][:250]), (7, base[7]), (107, "x" * 900), (108, prose(99, 30000))]
    return out


def test_simhash(spark, rows):
    got = simhash.groups(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    fps = np.array([r.fp for r in got], np.int64).view(np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 3
    reach = np.eye(len(fps), dtype=bool) | near
    for _ in range(8):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    for k, r in enumerate(got):
        ids = [got[j].doc_id for j in np.flatnonzero(reach[k]) if got[j].doc_id is not None]
        assert r.component_id == (min(ids) if ids else None)
    assert simhash.fingerprint(b"") == 0


@pytest.mark.parametrize("hot", [3, 10**6])
def test_trie_join_loses_no_link(spark, hot):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    keys = [int(b) for b in base]
    for b in base:
        for _ in range(15):
            x = int(b)
            for bit in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(bit)
            keys.append(x)
    keys = np.unique(np.array(keys, np.uint64))
    df = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "fp long")
    links = simhash.links(df, 3, hot).collect()
    at = {int(k): i for i, k in enumerate(keys.view(np.int64))}
    a, b = np.nonzero(np.triu(np.bitwise_count(keys[:, None] ^ keys[None]) <= 3, 1))
    want = simhash.forest(len(keys), a, b)
    have = simhash.forest(len(keys), np.array([at[x.u] for x in links]), np.array([at[x.v] for x in links]))
    assert (want == have).all()
    roots = {r.node: r.root for r in simhash.connected_components(spark.createDataFrame(links)).collect()}
    assert len({roots.get(int(k), int(k)) for k in keys.view(np.int64)}) == len(set(want.tolist()))


def test_suffix_array_and_prefixes():
    rng = random.Random(1)
    for _ in range(60):
        t = bytes(rng.choice(rng.choice([b"a", b"ab", b"\0a", b"abcd"])) for _ in range(rng.randint(1, 60))) * rng.choice([1, 3])
        b = np.frombuffer(t, np.uint8)
        sa, rank = suffix.suffix_array(b)
        want = sorted(range(len(t)), key=lambda i: t[i:])
        assert sa.tolist() == want
        lcp = suffix.common_prefixes(b, sa, rank, np.array([0]), np.array([len(t)]), 999)
        for k in range(1, len(t)):
            x, y = t[want[k]:], t[want[k - 1]:]
            assert lcp[want[k]] == next((i for i in range(min(len(x), len(y))) if x[i] != y[i]), min(len(x), len(y)))


@pytest.mark.parametrize("shard_bytes", [suffix.SHARD_BYTES, 1500])
def test_suffix_dedup(spark, rows, shard_bytes):
    span = 200
    texts = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(t[i:i + span] for t in texts for i in range(len(t) - span + 1))
    want = []
    for (doc, _), t in zip(rows, texts):
        m = np.zeros(len(t) + 1, int)
        for i in range(len(t) - span + 1):
            if seen[t[i:i + span]] > 1:
                m[i] += 1
                m[i + span] -= 1
        gone = np.cumsum(m)[:-1] > 0
        want.append((doc, len(t), int(gone.sum()), len(suffix._runs(gone)), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    got = [(r.doc_id, r.n_bytes, sum(x.e - x.s for x in r.removed), len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in suffix.dedup(documents(spark, rows), span, shard_bytes).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_bpe_equals_the_library(spark, rows):
    tiktoken = pytest.importorskip("tiktoken")
    P = pytest.importorskip("public_tokenizers")
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.encode_documents(documents(spark, rows), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=True).collect()}
    for doc, text in rows:
        assert got[doc].ids == lib.encode_ordinary(text or "")
        assert got[doc].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_language(spark):
    lang = {"aa": "abcde", "bb": "vwxyz"}
    rng = random.Random(0)
    text = lambda a: " ".join("".join(rng.choice(a) for _ in range(6)) for _ in range(30))
    taught = spark.createDataFrame([(k, text(a)) for k, a in lang.items() for _ in range(10)] + [("aa", None), ("bb", "123")], "lang string, text string")
    model = langid.prototypes(taught)
    asked = spark.createDataFrame([(1, True, text("abcde")), (2, False, text("vwxyz")), (3, False, None), (4, False, "12 !?"), (5, True, "")], "doc_id long, held_out boolean, text string")
    got = {r.doc_id: r for r in langid.predict(asked, model).collect()}
    assert [got[k].lang_pred for k in range(1, 6)] == ["aa", "bb", "und", "und", "und"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid.predict(asked, langid.prototypes(taught.limit(0))).collect()} == {"und"}


def test_quality(spark):
    bad = lambda k: prose(k, 40).upper().replace(" ", "!! ")
    rows = [(k, prose(k, 40) if k % 2 else bad(k), k % 2) for k in range(200)]
    model = quality.train(spark.createDataFrame(rows[:150], "doc_id long, text string, y int"))
    d = spark.createDataFrame([(k, True, t) for k, t, _ in rows[150:]] + [(999, False, None), (998, False, "")], "doc_id long, held_out boolean, text string")
    got = {r.doc_id: r for r in quality.score(d, model).collect()}
    assert all(got[k].predicted == y for k, _, y in rows[150:]) and got[999].score == got[998].score
    assert quality.train(spark.createDataFrame(rows[1:2], "doc_id long, text string, y int")) is None


def test_licenses_equal_plain_dice(spark, rows):
    extra = [(200, "Intro\nReleased under the MIT license!\n\nrest"), (201, "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the Software), to deal in\nthe Software without restriction."), (202, "all  rights\nreserved"), (203, "Copyright (c) 2020 Foo Inc. All rights reserved."), (204, "// SPDX-License-Identifier: Apache-2.0\ncode;"), (205, "Read on. This project is licensed under the MIT License! See more."), (206, "x. all\nrights reserved; y"), (207, None)]
    got = {(r.doc_id, r.license): r.dice for r in licenses.scan(documents(spark, rows + extra)).collect()}
    want = {}
    for doc, text in rows + extra:
        clean = re.sub(r"[^a-z0-9\n|]+", " ", re.sub(r"[.!?;]+[\"')\]]*([ \t\r\n])", r"|\1", (text or "").lower().replace("|", " ") + " "))
        paragraphs = re.split(r"\n *\n", clean)
        for unit in [*clean.split("\n"), *re.split(r"[\n|]", clean), *paragraphs, *(x for p in paragraphs for x in p.split("|")), clean]:
            w = unit.replace("|", " ").split()
            g = {f"{a} {b}" for a, b in zip(w, w[1:])}
            for name, t in licenses.template_sets(licenses.TEMPLATES):
                dice = 2 * len(g & set(t)) / (len(g) + len(t))
                if dice >= licenses.THRESHOLD:
                    want[doc, name] = max(want.get((doc, name), 0), round(dice, 6))
    assert got == want and {k[0] for k in want} == set(range(200, 207))


def test_decontaminate(spark, rows):
    item = prose(500, 40)
    w = item.split()
    edited = w[:10] + ["new"] + w[10:20] + w[22:35] + ["other", "end"]
    bench = spark.createDataFrame([(1, item, 0), (2, "short one", 0), (3, None, 0), (None, prose(501, 30), 0)], "item_id long, text string, score int")
    docs = rows + [(300, f"{prose(1, 50)} {item} {prose(2, 50)}"), (301, f"{prose(3, 50)} {' '.join(edited)} {prose(4, 50)}"), (302, prose(501, 30))]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(documents(spark, docs), bench).collect()}
    assert set(got) == {(300, 1), (301, 1), (302, None)}
    assert got[300, 1].score == 1.0 and (got[300, 1].start_word, got[300, 1].end_word) == (50, 90)


def test_smith_waterman_equals_plain():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 15))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontaminate.smith_waterman(a, b)[0] == h.max()


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, u in ((0, 10), (1, 1), (5, 7), (1000, 1 << 64), (3000, 4000)):
        v = np.unique(rng.integers(0, min(u, (1 << 63) - 1), n, dtype=np.uint64))
        e = lm.EliasFano.build(v, u)
        q = np.concatenate((v, rng.integers(0, min(u, (1 << 63) - 1), 300, dtype=np.uint64)))
        at = {int(x): i for i, x in enumerate(v)}
        assert e.find(q).tolist() == [at.get(int(x), -1) for x in q]
        assert len(v) == 0 or (e.access(np.arange(len(v))) == v).all()


@pytest.mark.parametrize("shard_text", [lm.SHARD_TEXT, 20000])
def test_language_model(spark, rows, shard_text):
    docs = documents(spark, rows)
    got = sorted(((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.score(docs.select("doc_id", F.lit(False).alias("held_out"), "text"), lm.train(docs.filter("doc_id < 105"), shard_text=shard_text)).collect()))
    token = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), b"\n"]
    train = [token(t) for i, t in rows if i is not None and i < 105]
    c = collections.Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    c2 = {k: x for k, x in collections.Counter(p for t in train for p in zip(t, t[1:])).items() if x > 1}
    c3 = {k: x for k, x in collections.Counter(p for t in train for p in zip(t, t[1:], t[2:])).items() if x > 1}
    left = lambda ctx, table, total: 1 - sum(x - 0.75 for k, x in table.items() if k[:-1] == ctx) / total
    memo = {}
    want = []
    for _, text in rows:
        t, base, full = token(text), 0.0, 0.0
        for i, w in enumerate(t):
            p = (c[w] + 1) / (n + v + 1)
            base += math.log10(p)
            for k, table in ((1, c2), (2, c3)):
                ctx = tuple(t[i - k:i]) if i >= k else None
                total = None if ctx is None else (c[ctx[0]] if k == 1 else c2.get(ctx))
                if total:
                    if (ctx, k) not in memo:
                        memo[ctx, k] = left(ctx, table, total)
                    p = (max(table.get((*ctx, w), 0) - 0.75, 0) / total) + memo[ctx, k] * p
            full += math.log10(p)
        want.append((len(t), sum(c[w] > 0 for w in t), n, base, full))
    for g, w in zip(got, sorted(want)):
        assert g[:3] == w[:3] and math.isclose(g[3], w[3], rel_tol=1e-12) and abs(g[4] - w[4]) < 5e-4 * w[0]


def test_warc_round_trip(spark):
    rows = [(1, "http://a", "same"), (2, "http://b", "same"), (3, None, None), (4, "http://c/\r\nX: y", ""), (None, "http://d", "é" * 50000), (5, "http://e", "same"), (5, "http://e", "same")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    got = sorted(warc.read_records(warc.archive(spark, pages)).collect(), key=str)
    assert len(got) == len(rows)
    kinds = collections.Counter((r.page_id, r.record_type, r.refers_to) for r in got)
    assert kinds == {(1, "revisit", 5): 1, (2, "revisit", 5): 1, (5, "revisit", 5): 1, (5, "response", None): 1, (3, "revisit", 4): 1, (4, "response", None): 1, (None, "response", None): 1}
    assert {r.payload_bytes for r in got if r.page_id is None} == {100000}
    assert warc.read_records(warc.archive(spark, pages, 5)).filter("record_type = 'response'").count() == 7
    assert warc.coalesced(np.array([0, 10, 10_000_000]), np.array([10, 5, 5])) == [(0, 2), (2, 3)]


def test_empty_tables(spark):
    none = documents(spark, []).limit(0)
    assert simhash.groups(none).count() == suffix.dedup(none).count() == 0
    rows = none.select("doc_id", F.lit(True).alias("held_out"), "text")
    assert langid.predict(rows, (["a"], np.ones((1, 512)))).count() == quality.score(rows, None).count() == lm.score(rows, lm.train(none)).count() == 0
    assert licenses.scan(none).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(none, bench).count() == 0
    assert warc.read_records(warc.archive(spark, spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_fold_is_crc32(spark):
    got = spark.range(50).select("id", langid.remainder(F.col("id"), 4).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 4 for r in got)


def test_quality_labelled_texts(spark):
    docs = spark.createDataFrame([(1, "é one"), (2, None), (3, ""), (4, "unlabelled"), (None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (9, 1), (None, 1)], "doc_id long, y int")
    got = sorted((r.doc_id, r.text, r.y) for r in quality.labelled_texts(docs, labels).collect())
    assert got == [(1, "é one", 0), (1, "é one", 1), (2, "", 0), (3, "", 1)]


def test_language_model_query_keeps_every_ngram(spark, tmp_path):
    texts = {i: prose(i % 5 + 40, 30) + f" only{i} once" for i in range(20)} | {20: None, 21: "only0 once alpha1 once"}
    documents(spark, list(texts.items())).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in lm.op9_lm(spark, str(tmp_path)).collect()}
    token = lambda t: [*(t or "").lower().split(), "\n"]
    train = [token(t) for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    grams = [collections.Counter(p for t in train for p in zip(*(t[j:] for j in range(k)))) for k in (1, 2, 3)]
    n, v = sum(grams[0].values()), len(grams[0])
    assert any(got[i].held_out for i in texts) and 1 in grams[1].values() and 1 in grams[2].values()
    for i, text in texts.items():
        t, full = token(text), 0.0
        for at, w in enumerate(t):
            p = (grams[0][w,] + 1) / (n + v + 1)
            for k in (1, 2):
                ctx = tuple(t[at - k:at])
                if at >= k and grams[k - 1][ctx]:
                    left = 1 - sum(x - 0.75 for g, x in grams[k].items() if g[:k] == ctx) / grams[k - 1][ctx]
                    p = max(grams[k][(*ctx, w)] - 0.75, 0) / grams[k - 1][ctx] + left * p
            full += math.log10(p)
        assert abs(got[i].score - full) < 5e-4 * len(t)


def test_decontaminate_short_unspaced_and_edited(spark, rows):
    long = [f"q{k}" for k in range(12)]
    thin = [x if k % 3 < 2 else f"n{k}" for k, x in enumerate(long)]  # no three words in a row are left
    items = {1: "what is qanswer", 2: "quniqueword", 3: "東京の首都はどこですか", 4: " ".join(long), 5: "who wrote the qbook first", 6: "_ !"}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    docs = [(400, f"ask: What is Qanswer? {prose(1, 20)}"), (401, f"{prose(2, 20)} quniqueword"), (402, "問題。東京の首都はどこですか。答え"), (403, f"{prose(3, 9)} {' '.join(thin)} end"), (404, "so who wrote a qbook first then"), (405, "what is it, qanswer"), (406, "who painted a qbook first"), (407, "東京はどこ")]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(documents(spark, rows + docs), bench).collect()}
    assert set(got) == {(400, 1), (401, 2), (402, 3), (403, 4), (404, 5)}
    assert got[400, 1].score == got[401, 2].score == got[402, 3].score == 1.0
    assert (got[400, 1].start_word, got[400, 1].end_word) == (1, 4)


def test_decontaminate_seeds_lose_no_replaced_words():
    rng = random.Random(9)
    for m in (4, 5, 8, 12, 16, 30):
        for trial in range(60):
            text = [f"w{k}" for k in range(m)]
            copy = [x if rng.random() > rng.choice([0.15, 0.33]) else f"n{k}" for k, x in enumerate(text)]
            items = decontaminate.Items([(1, " ".join(text))])
            items.choose({int(g): rng.randint(1, 99) for g in items.distinct})
            score = decontaminate.smith_waterman(items.words[0], items.read(" ".join(["p"] * 9 + copy + ["p"] * 9)))[0] / (2 * m)
            got = items.leaks(" ".join(["p"] * 9 + copy + ["p"] * 9))
            assert [x[1] for x in got] == ([score] if score >= decontaminate.asked(m, 0.5) - 1e-9 else [])


def test_licenses_full_texts_and_paragraphs(spark):
    import textwrap

    mit, bsd = ["\n".join(textwrap.wrap(p, 72)) for p in licenses._MIT], ["\n".join(textwrap.wrap(p, 72)) for p in licenses._BSD]
    head = "MIT License\n\nCopyright (c) 2020 Foo Inc.\n\n"
    texts = {1: head + "\n\n".join(mit), 2: "intro\n\n" + mit[0] + "\n\n" + prose(1, 30), 3: " ".join(licenses._MIT), 4: "Copyright (c) 2021 Bar\n\n" + "\n\n".join(bsd), 5: prose(2, 30) + "\n\n" + bsd[3] + "\n\n" + prose(3, 30)}
    texts[6] = "Copyright 2020 Foo\n\n" + "\n".join(textwrap.wrap(licenses.TEMPLATES["Apache-2.0"][3], 60)) + "\n"
    got = {(r.doc_id, r.license) for r in licenses.scan(documents(spark, list(texts.items()))).collect()}
    assert got == {(1, "MIT"), (2, "MIT"), (3, "MIT"), (4, "BSD-3-Clause"), (5, "BSD-3-Clause"), (6, "Apache-2.0")}
    assert all(len(g) < 266 for _, g in licenses.template_sets(licenses.TEMPLATES))


@pytest.mark.parametrize("at", range(9))
def test_prefixes_end_at_complementary_bytes(at):
    # what follows the shared part differs in every bit: no float may stand between the words and the count
    for a, b in ((b"\xc3\xa9" * 8, b"<V" * 8), (b"\xff" * 16, b"\0" * 16), (b"\x80" + b"\0" * 15, b"\x7f" + b"\xff" * 15), (b"\0" * 8 + b"\1" * 8, b"\xff" * 7 + b"\xfe" * 9)):
        shared = bytes(random.Random(at).randrange(256) for _ in range(200 + at))
        got = suffix.repeated_starts([shared + a, shared + b], 200)
        assert [np.flatnonzero(g[:at + 2]).tolist() for g in got] == [list(range(at + 1))] * 2


def test_suffix_over_characters_of_many_bytes(spark):
    rng = random.Random(12)
    shared = ["".join(rng.choice("aé日\U0001f600<V\xff") for _ in range(n)) for n in (80, 120, 201)]
    tails = ["\xe9\xe9\xe9\xe9", "<V<V<V<V", "\U0001f600\U0001f600", "日本", "~~~~", "\x7f\x7f\x7f"]
    rows = []
    for k in range(120):
        rows.append((k, prose(k, 4) + shared[k % 3] + tails[k % 6] + prose(k + 500, rng.randint(0, 30))))
    windows = collections.Counter(t.encode()[i:i + 200] for _, t in rows for i in range(len(t.encode()) - 199))
    want = {}
    for k, t in rows:
        t = t.encode()
        gone = {i + j for i in range(len(t) - 199) if windows[t[i:i + 200]] > 1 for j in range(200)}
        want[k] = bytes(c for i, c in enumerate(t) if i not in gone)
    assert {r.doc_id: bytes(r.kept) for r in suffix.dedup(documents(spark, rows)).collect()} == want and any(len(want[k]) < len(t.encode()) for k, t in rows)
