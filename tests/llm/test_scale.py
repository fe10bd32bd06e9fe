"""Rows that are hot, long or odd: bounded and right."""

import base64
import collections
import hashlib
import os
import random
import re
import resource

import numpy as np
import pytest
import xxhash

from quantloom.llm import decontaminate, langid, lm, simhash, suffix, warc


def test_suffix_copies_of_one_row(spark):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ") for _ in range(1500))
    rows = [(1, text)] * 400 + [(2, text[300:900] + "tail"), (3, "clean " + "".join(rng.choice("abcdefgh ") for _ in range(700)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = suffix.keyed(docs)
    spans = {r.r1: r.spans for r in suffix.repeated_ranges(keyed).collect()}
    # one row for all copies, whose ranges are those of one copy
    assert len(spans) == 2 and max(map(len, spans.values())) < 60
    got = collections.Counter((r.doc_id, r.kept) for r in suffix.dedup(docs).collect())
    assert got[1, b""] == 400 and got[2, b"tail"] == 1 and got[3, rows[-1][1].encode()] == 1


@pytest.mark.parametrize("held", [suffix.HELD, 500])
def test_suffix_returns_in_parts(spark, held, monkeypatch):
    rng = random.Random(5)
    part = "".join(rng.choice("xyz ") for _ in range(450))
    rows = [(k, "".join(rng.choice("abcdefgh ") for _ in range(300)) + part) for k in range(20)]
    monkeypatch.setattr(suffix, "HELD", held)
    got = {r.doc_id: r.kept.decode() for r in suffix.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(len(got[k]) <= 300 and t.startswith(got[k][:250]) for k, t in rows)


def test_suffix_piece_borders_lose_no_window(monkeypatch):
    rng = random.Random(6)
    text = "".join(rng.choice("abc") for _ in range(5000)).encode()
    whole = suffix._anchors([text], 200)
    monkeypatch.setattr(suffix, "PIECE", 700)
    starts = np.zeros(len(text), int)
    for at in range(0, len(text) - 199, 700):
        n, first, m, _, _ = suffix._anchors([text[at:at + 700 + 199]], 200)
        for f, k in zip(first, m):
            starts[at + f:at + f + k] += 1
    assert whole[2].sum() == len(text) - 199 and (starts[:len(text) - 199] == 1).all() and not starts[len(text) - 199:].any()


def _plain_bundle(text, dim=langid.DIM, seed=1):
    """The trigram sum by its definition, a letter at a time."""
    letter = {}

    def vector(c):
        if c not in letter:
            letter[c] = np.random.default_rng([seed, c]).integers(0, 2, dim, np.int8).astype(int) * 2 - 1
        return letter[c]

    codes = [0]
    for c in text.lower():
        code = ord(c) if c.isalpha() else 0
        if code or codes[-1]:
            codes.append(code)
    if codes[-1]:
        codes.append(0)
    total = np.zeros(dim)
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        total += np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c)
    return total


def test_language_bundles_equal_plain_sums(monkeypatch):
    rng = random.Random(7)
    texts = ["Ab, cd!", "été à l'école", "", None, "12", "".join(chr(rng.randint(0x4E00, 0x9FA0)) for _ in range(400)), "xyz " * 50, "ÀÉ\n\nß"]
    for letters, trigrams in ((langid.LETTERS, langid.TRIGRAMS), (5, 7)):
        monkeypatch.setattr(langid, "LETTERS", letters)
        monkeypatch.setattr(langid, "TRIGRAMS", trigrams)
        vs, some = langid.Hypervectors().bundles(texts)
        assert some.tolist() == [True, True, False, False, False, True, True, True]
        for v, t, ok in zip(vs, texts, some):
            assert not ok or np.array_equal(v, _plain_bundle(t))


def test_language_equals_plain_prediction_and_long_texts(spark):
    rng = random.Random(8)
    lang = {"aa": "abcde", "bb": "cdefg", "cc": "xyzé"}
    text = lambda a, n: "".join(rng.choice(a + " ") for _ in range(n))
    taught = [(k, text(a, 300)) for k, a in lang.items() for _ in range(4)]
    # ties, repeated rows, a very long text and one of a large alphabet
    asked = [(k, True, text(lang[x], 80)) for k, x in enumerate(["aa", "bb", "cc"] * 3)] * 2 + [(90, False, text("abcde", 300_000)), (91, False, "".join(chr(rng.randint(0x4E00, 0x9FA0)) for _ in range(20_000))), (None, False, "é")]
    unit = lambda v: v / max(np.sqrt(v @ v), 1e-12)
    names = sorted(lang)
    table = [unit(sum(unit(_plain_bundle(t)) for x, t in taught if x == k)) for k in names]
    model = langid.prototypes(spark.createDataFrame(taught, "lang string, text string"))
    schema = "doc_id long, held_out boolean, text string"
    got = collections.Counter((r.doc_id, r.lang_pred, round(r.score, 4)) for r in langid.predict(spark.createDataFrame(asked, schema), model).collect())
    want = collections.Counter()
    for d, _, t in asked:
        if d in (90, 91):
            continue
        cos = [float(np.dot(p, unit(_plain_bundle(t)))) for p in table]
        want[d, names[int(np.argmax(cos))], round(max(max(cos), 0.0), 4)] += 1
    assert not want - got and {x[1] for x in got if x[0] == 90} == {"aa"}


def test_language_stage_acts_on_the_prediction(spark):
    rng = random.Random(9)
    good = ["".join(rng.choice("abcde ") for _ in range(200)) for _ in range(6)]
    strange = ["".join(chr(rng.randint(0x4E00, 0x9FA0)) for _ in range(200)) for _ in range(40)]
    docs = spark.createDataFrame([(None, t) for t in good + strange + ["12", None]], "doc_id long, text string")
    model = langid.prototypes(spark.createDataFrame([("aa", t) for t in good], "lang string, text string"))
    names, table = model
    _, score = langid.tell(strange, names, table)
    kept = {r.text for r in langid.keep_known(docs, model).collect()}
    assert kept == set(good) | {t for t, s in zip(strange, score) if s >= langid.MIN_COSINE}
    assert len(kept) < len(good) + len(strange) / 2
    assert langid.keep_known(docs, ([], np.zeros((0, langid.DIM)))).count() == 0


def _plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.lower())
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(x >> bit & 1 for x in h) > len(h))


def test_simhash_fingerprints_equal_plain_counts():
    rng = random.Random(11)
    texts = [b"", b" \t\n", b"One", b"one two", b"A b C", "ÀB é \x85 x y z".encode(), b"same " * 50, b"x\x0by\x0cz w", " ".join(str(rng.randint(0, 30)) for _ in range(70_000)).encode()]
    texts += [" ".join(rng.choice("ab cd Ef g".split()) for _ in range(rng.randint(1, 12))).encode() for _ in range(60)]
    for t in texts:
        assert simhash.fingerprint(t) == _plain_fingerprint(t)


@pytest.mark.parametrize("frontier", [simhash.FRONTIER, 50])
def test_simhash_dense_cluster_in_bounded_steps(frontier, monkeypatch):
    # all keys within 3 bits of many others: pairs are folded in as they come
    monkeypatch.setattr(simhash, "FRONTIER", frontier)
    rng = np.random.default_rng(1)
    keys = np.unique(np.concatenate([np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 40, (900, 3)).astype(np.uint64), axis=1), rng.integers(0, 1 << 63, 100, dtype=np.uint64)]))
    seen, most = simhash.Forest(len(keys)), []

    def found(x, y):
        most.append(len(x))
        seen.add(x, y)

    for depth in (0,):
        simhash.trie_join(keys, np.array([0]), np.array([len(keys)]), np.array([depth]), 3, found)
    a, b = np.nonzero(np.triu(np.bitwise_count(keys[:, None] ^ keys[None]) <= 3, 1))
    assert sum(most) == len(a) and max(most) <= 4 * max(frontier, 1)
    assert (seen.fold() == simhash.forest(len(keys), a, b)).all()


@pytest.mark.parametrize("radius", [0, 1, 3, 7])
def test_simhash_hot_blocks_are_dealt_on(spark, radius):
    # a third of all keys shares its first 28 bits, and another lot its last 16
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 60, dtype=np.uint64)
    keys = np.concatenate([base, (np.uint64(0xABCDEF1) << np.uint64(36)) | (base & np.uint64((1 << 36) - 1)), (base & ~np.uint64(0xFFFF)) | np.uint64(0x1234)])
    flips = np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, (len(keys), max(radius, 1))).astype(np.uint64), axis=1)
    keys = np.unique(np.concatenate([keys, keys ^ flips]))
    at = {int(k): i for i, k in enumerate(keys.view(np.int64))}
    a, b = np.nonzero(np.triu(np.bitwise_count(keys[:, None] ^ keys[None]) <= radius, 1))
    want = simhash.forest(len(keys), a, b)
    for hot in (2, 20, 10**6):
        links = simhash.links(spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "fp long"), radius, hot).collect()
        assert (want == simhash.forest(len(keys), np.array([at[x.u] for x in links], np.int64), np.array([at[x.v] for x in links], np.int64))).all()


def test_model_files_do_not_pile_up(spark, monkeypatch):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(60)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    trained = lm.train(docs, 1, shard_text=200)
    assert len(trained.words) > 80
    piece = next(lm.pieces([t.encode() for t in texts]))
    want = lm.score_piece(lm.Model(lm.train(docs, 1)), *piece)
    monkeypatch.setattr(lm, "OPEN", 8)
    lm._files.clear()
    soft, hard = resource.getrlimit(resource.RLIMIT_NOFILE)
    resource.setrlimit(resource.RLIMIT_NOFILE, (len(os.listdir("/proc/self/fd")) + 12, hard))
    try:
        got = lm.score_piece(lm.Model(trained), *piece)
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, (soft, hard))
    assert len(lm._files) <= 8
    for g, w in zip(got, want):
        assert np.allclose(g, w, atol=0.1)


def test_model_with_a_hot_word_in_several_blocks(spark, monkeypatch):
    rng = random.Random(13)
    texts = [" ".join(x for _ in range(40) for x in ("the", f"w{rng.randint(0, 90)}")) for _ in range(30)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    piece = next(lm.pieces([t.encode() for t in texts]))
    want = lm.score_piece(lm.Model(lm.train(docs, 1)), *piece)
    pairs = np.array([5, 0, 17, 8])
    monkeypatch.setattr(lm, "PAIRS", 8)
    assert lm._blocks(pairs).tolist() == [0, 1, 2, 5, 6]
    assert np.isfinite(want[2]).all() and (want[2] > want[1]).all()


def _edited(rng, words, share):
    out = []
    for w in words:
        x = rng.random()
        if x < share / 3:
            out.append(f"n{rng.randint(0, 10**6)}")
        elif x < 2 * share / 3:
            continue
        else:
            out.append(w)
            if x < share:
                out.append(f"n{rng.randint(0, 10**6)}")
    return out


def test_decontaminate_equals_all_pairs(spark):
    rng = random.Random(14)
    common = [f"c{k}" for k in range(60)]
    item = lambda m: [rng.choice(common) if rng.random() < 0.6 else f"r{rng.randint(0, 400)}" for _ in range(m)]
    items = [(k, item(m)) for k, m in enumerate([1, 2, 3, 5, 7, 8, 12, 30, 40, 60])]
    items += [(99, items[7][1]), (99, items[7][1])]  # repeated rows
    docs = []
    for k in range(60):
        _, w = items[k % 10]
        body = _edited(rng, w, rng.choice([0, 0.1, 0.2])) if k % 3 else []
        docs.append((k if k % 7 else None, item(rng.randint(0, 30)) + body + item(rng.randint(0, 30))))
    docs += [docs[4], docs[4]]
    want = collections.Counter()
    plain = decontaminate.Items([(i, " ".join(w)) for i, w in items])
    for d, w in docs:
        words = plain.read(" ".join(w))
        for k, x in enumerate(plain.words):
            score = decontaminate.smith_waterman(x, words)[0] / (2 * len(x))
            if score >= plain.need[k] - 1e-9:
                want[d, plain.ids[k], round(score, 9)] += 1
    table = lambda rows, name: spark.createDataFrame([(i, " ".join(w), 0) for i, w in rows], f"{name} long, text string, score int")
    got = collections.Counter((r.doc_id, r.item_id, round(r.score, 9)) for r in decontaminate.find_leaks(table(docs, "doc_id"), table(items, "item_id")).collect())
    assert got == want and len(want) > 30


@pytest.mark.parametrize("share", [0.1, 0.2, 0.3])
def test_decontaminate_recall_of_edited_copies(share):
    rng = random.Random(15)
    common = [f"c{k}" for k in range(500)]
    words = [[rng.choice(common) for _ in range(40)] for _ in range(200)]
    items = decontaminate.Items([(k, " ".join(w)) for k, w in enumerate(words)])
    items.choose({int(g): rng.randint(1, 50) for g in items.distinct})
    caught = asked = 0
    for k, w in enumerate(words):
        text = " ".join([rng.choice(common) for _ in range(40)] + _edited(rng, w, share) + [rng.choice(common) for _ in range(40)])
        if decontaminate.smith_waterman(items.words[k], items.read(text))[0] / 80 >= 0.5:
            asked += 1
            caught += any(x[0] == k for x in items.leaks(text))
    print(f"edits {share}: {caught} of {asked}")
    assert asked and caught / asked >= 0.9


def test_decontaminate_long_items(spark, monkeypatch):
    rng = random.Random(16)
    long = [f"w{rng.randint(0, 3000)}" for _ in range(5_000)]
    bench = spark.createDataFrame([(1, " ".join(long)), (2, "-".join(["a"] * 30_000)), (None, "one short question about foxes and hens")], "item_id long, text string")
    docs = spark.createDataFrame([(10, "x y " + " ".join(long[1500:3600]) + " z"), (11, "a " * 500), (12, "asks one short question about foxes and hens"), (13, " ".join(long[:200]))], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got == {(10, 1), (12, None)}


def test_warc_digests_and_many_ranges(spark):
    rng = random.Random(17)
    pages = [(k, f"http://h/{k}", "".join(rng.choice("abc <>é\n") for _ in range(rng.randint(0, 4000)))) for k in range(300)] + [(k, "u", None) for k in range(1000, 1150)] + [(2000, "u", "")]
    index = warc.archive(spark, spark.createDataFrame(pages, "page_id long, url string, html string"))
    read = warc.read_records(index, 4_000)
    assert read.rdd.getNumPartitions() > 5
    got = {r.page_id: r for r in read.collect()}
    payload = {k: (h or "").encode() for k, _, h in pages}
    top = {}
    for k, p in payload.items():
        top[p] = max(k, top.get(p, -1))
    for k, p in payload.items():
        r = got[k]
        assert r.payload_digest == base64.b32encode(hashlib.sha1(p).digest()).decode() and r.payload_bytes == len(p)
        assert (r.record_type, r.refers_to) == (("response", None) if top[p] == k else ("revisit", top[p]))
        assert r.html == (p.decode() if top[p] == k else None)


def test_decontaminate_cuts_ascii_like_other_text():
    rng = random.Random(18)
    for _ in range(300):
        t = "".join(chr(rng.randrange(128)) for _ in range(40))
        assert decontaminate.cut(t) == decontaminate.PLAIN.findall(t.lower())
