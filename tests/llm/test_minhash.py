"""MinHash groups against all pairs of whole sets."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import minhash

WORDS = [f"w{k}" for k in range(400)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, row int, sketch string")


def plain(rows, percent=85, width=3):
    """Group of each row by comparing every pair of shingle sets."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = [x for x in "".join(c if c not in "\t\n\x0b\x0c\r" else " " for c in (t or "").translate(lower)).split(" ") if x]
        sets.append({" ".join(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        name = (min(ids) if ids else None) if sets[k] else i
        out.append((i, len(sets[k]), name, i == name))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=repr)


def edited(rng, words, share):
    return [rng.choice(WORDS) + "x" if rng.random() < share else w for w in words]


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for length in (2, 3, 5, 8, 20, 60, 100, 110, 130, 300):
        base = [rng.choice(WORDS) for _ in range(length)]
        rows += [" ".join(edited(rng, base, share)) for share in (0, 0.01, 0.02, 0.03, 0.05, 0.1)]
        rows += [" ".join(base[:-1]), " ".join(base + ["more"]), "\t".join(base).upper()]
    passage = [f"p{k}" for k in range(80)]
    rows += [" ".join(passage + [rng.choice(WORDS) + str(k) for _ in range(rng.randint(5, 60))]) for k in range(60)]
    out = [(k * 7 % 1009, t) for k, t in enumerate(rows)]
    return out + [(3, None), (4, ""), (5, " \n\t "), (None, rows[0]), (None, "alone without id here"), (None, None), (7, rows[20]), (7, rows[20]), (6, "Éa ß É ß"), (8, "éa ß É ß")]


@pytest.mark.parametrize("k, classes, block, held", [(96, (1, 8), 8192, 1 << 16), (32, (), 7, 10)])
def test_groups_equal_all_pairs(spark, monkeypatch, k, classes, block, held):
    for name, value in (("CLASSES", classes), ("BLOCK", block), ("HELD", held)):
        monkeypatch.setattr(minhash, name, value)
    rows = corpus(k)
    assert found(minhash.groups(table(spark, rows), k=k)) == plain(rows)


def test_large_group_settles_around_its_base(spark, monkeypatch):
    rng = random.Random(5)
    base = [rng.choice(WORDS) for _ in range(150)]
    copies = [edited(rng, base, 0.012) for _ in range(150)]
    rows = [(k + 1, " ".join(c)) for k, c in enumerate(copies)] + [(500, " ".join(base))] + [(600 + k, " ".join(base)) for k in range(200)]
    made = []
    likely = minhash.likely
    monkeypatch.setattr(minhash, "likely", lambda pairs, *a: made.append(pairs.count()) or likely(pairs, *a))
    assert found(minhash.groups(table(spark, rows))) == plain(rows)
    # copies are tied to the base at once, and bounds keep the others from meeting all of them
    assert made[0] <= 151 and sum(made) < 600


def test_lists_without_links_end(spark):
    rng = random.Random(6)
    shared = [f"p{k}" for k in range(100)]
    rows = [(k, " ".join(shared + [f"u{k}{j}" for j in range(rng.randint(60, 70))])) for k in range(40)]
    got = found(minhash.groups(table(spark, rows)))
    assert got == plain(rows) and all(r[3] for r in got)


def test_sketches_of_rows_that_meet_none_are_not_dealt_out(spark, monkeypatch):
    rng = random.Random(8)
    base = [rng.choice(WORDS) for _ in range(120)]
    rows = [(k, " ".join([*base, f"m{k}"])) for k in range(4)] + [(10 + k, " ".join(f"u{k}_{j}" for j in range(120))) for k in range(50)]
    seen, whole = [], []
    likely, verified = minhash.likely, minhash.verified
    monkeypatch.setattr(minhash, "likely", lambda pairs, own, *a: seen.append(own.count()) or likely(pairs, own, *a))
    monkeypatch.setattr(minhash, "verified", lambda pairs, *a: whole.append(pairs.count()) or verified(pairs, *a))
    assert found(minhash.groups(table(spark, rows))) == plain(rows)
    assert seen and max(seen) == 4 and whole and min(whole) > 0


def test_texts_that_meet_none_are_not_shuffled(spark):
    rng = random.Random(9)

    def text():
        return [f"{rng.getrandbits(800):0200x}" for _ in range(100)]

    base = text()
    rows = [(k, " ".join([*base, f"m{k}"])) for k in range(3)] + [(10 + k, " ".join(text())) for k in range(200)]
    docs = table(spark, rows).repartition(4).localCheckpoint()

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        own = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(own.apply(k).totalShuffleWrite() for k in range(own.size()))

    name = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(name, "-1")  # as where no side is small
    try:
        before = shuffled()
        got = found(minhash.groups(docs))
        moved = shuffled() - before
    finally:
        spark.conf.unset(name)
    assert got == plain(rows)
    assert 0 < moved < sum(len(t) for _, t in rows) / 2


def test_copies_alone_make_no_set_live(spark):
    rng = random.Random(10)
    copied, near = [[f"{name}{rng.random()}" for _ in range(150)] for name in "cn"]
    rows = [(k, " ".join(copied)) for k in range(30)] + [(40, " ".join(near)), (41, " ".join(near)), (42, " ".join([*near, "more"]))]
    own = minhash.sketches(table(spark, rows)).withColumnRenamed("doc_id", "row").localCheckpoint()
    sets = own.groupBy("digest").agg(F.min("row").alias("row"), F.min("n").alias("n"), F.count("*").alias("copies"))
    assert sorted(r.row for r in minhash.live_rows(own, sets).collect()) == [40, 42]


@pytest.mark.parametrize("bits", [1 << 25, 1 << 16])
def test_map_loses_no_key(spark, monkeypatch, bits):
    monkeypatch.setattr(minhash, "MAP_BITS", bits)
    rows = spark.range(20_000).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("key"), F.col("id").alias("at"), F.lit("x").alias("bits"))
    wanted = rows.filter("at % 10 = 0").select("key")
    got = {r.at for r in minhash.among(rows, "key", wanted).select("at").collect()}
    assert got >= set(range(0, 20_000, 10)) and len(got) < (2010 if bits > 1 << 20 else 3000)
    assert minhash.among(rows, "key", wanted.limit(0)).count() == 0


def test_least_count():
    for k in (16, 64, 96):
        c = minhash.shared_least(k)
        tail = sum(math.comb(k, j) * 0.85 ** j * 0.15 ** (k - j) for j in range(c))
        assert tail <= 1e-12 < tail + math.comb(k, c) * 0.85 ** c * 0.15 ** (k - c)


def test_long_text_and_set():
    text = b" ".join(b"%d" % (k % 70_000) for k in range(1_000_000))
    got = minhash.shingle_set(text)
    assert len(got) == 70_000 and (np.diff(got) > 0).all()
    assert len(minhash.shingle_set(b"A b")) == 1 and (minhash.shingle_set(b"A b") == minhash.shingle_set(b" a\tB\n")).all()


def test_empty_table_and_registered_query(spark, tmp_path):
    none = table(spark, [(1, "x")]).limit(0)
    assert minhash.groups(none).collect() == []
    none.write.parquet(f"{tmp_path}/documents.parquet")
    assert minhash.op12_minhash(spark, str(tmp_path)).collect() == []
