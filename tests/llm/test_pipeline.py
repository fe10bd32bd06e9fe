import pytest

cp = pytest.importorskip("corpus_pipeline")


def test_stages_over_odd_rows(spark, tmp_path):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen " * 5
    bench = "red orange yellow green blue indigo violet black white grey brown pink"
    rows = [(1, text, "en", "s", 1), (2, text, "en", "s", 1), (3, None, None, None, None), (4, "", "en", "s", 0), (5, "1234 !!", "en", "s", 7), (6, f"before it {bench} after it", "en", "s", 9), (7, "a clean short text of its own", None, None, 3), (7, "a clean short text of its own", None, None, 3), (None, "a text without any number at all", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("fp", cp.F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = cp.documents(spark, str(tmp_path))
    ids = []
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids.append(sorted((r.doc_id for r in docs.collect()), key=str))
        if k < 4:
            assert docs.columns == list(cp.COLUMNS)
    assert ids[0] == [1, 2, 6, 7, 7, None]
    assert ids[1] == [1, 6, 7, None]
    assert ids[3] == ids[4]
    assert 6 not in ids[4] and {7, None} <= set(ids[4])
    # the ids are those of the library, over the texts that the fourth stage left
    import base64
    import hashlib

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    left = spark.read.parquet(str(tmp_path / cp.STAGES[3][0])).collect()
    want = sorted(((r.doc_id, r.lang, r.source, enc.encode_ordinary(r.text)) for r in left), key=str)
    got = docs.collect()
    assert sorted(((r.doc_id, r.lang, r.source, r.ids) for r in got), key=str) == want
    for r in got:
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()


def test_null_and_shared_ids_are_rows_of_their_own(spark, tmp_path):
    own = [" ".join(f"w{k}x{j}" for j in range(40)) for k in range(8)]
    bench = "red orange yellow green blue indigo violet black white grey brown pink"
    # ids missing, shared by different texts, and shared with the copy of an older document
    rows = [(None, own[0]), (None, own[1]), (None, own[0]), (4, own[2]), (4, own[3]), (1, own[4]), (5, own[4]), (5, own[5]), (None, own[4])]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    table = lambda r: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in r], schema)
    got = sorted(((r.doc_id, r.text) for r in cp.near_duplicates(spark, table(rows), str(tmp_path)).collect()), key=str)
    assert got == sorted([(None, own[0]), (None, own[1]), (4, own[2]), (4, own[3]), (1, own[4]), (5, own[5])], key=str)
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    leak = f"before it {bench} after it"
    got = sorted(((r.doc_id, r.text) for r in cp.leaks(spark, table([(None, leak), (None, own[0]), (7, leak), (7, own[1])]), str(tmp_path)).collect()), key=str)
    assert got == sorted([(None, own[0]), (7, own[1])], key=str)
