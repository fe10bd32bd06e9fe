"""The manifest against a plain tree, built and folded in Python."""

import hashlib
import random
import zlib

import pytest

from quantloom.llm import merkle

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, grp int, idx string, leaf string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row[:5]))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k:k + 8])) for k in range(0, len(out[-1]), 8)])
    return out


def way(levels, at, own):
    """Siblings up a tree and the digest that they and ``own`` give."""
    proof = []
    for nodes in levels[:-1]:
        first = at // 8 * 8
        run = nodes[first:first + 8]
        proof += run[:at - first] + run[at - first + 1:]
        own = sha("".join(run[:at - first] + [own] + run[at - first + 1:]))
        at //= 8
    return proof, own


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for name in order:
        members = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((members, levels_of([leaf(r) for r in members])))
    upper = levels_of([levels[-1][0] for _, levels in trees])
    out = []
    for g, (members, levels) in enumerate(trees):
        for at, r in enumerate(members):
            now = list(r)
            if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 3 == 0 and r[4] is not None:
                now[4] = r[4].translate(LOWER)
            proof, up = way(levels, at, leaf(now))
            more, root = way(upper, g, up)
            out.append((r[0], leaf(r), levels[-1][0], upper[-1][0], sha("".join(proof + more)), root, root == upper[-1][0]))
    return sorted(out, key=repr)


def found(spark, rows, tmp_path):
    spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op13_merkle(spark, str(tmp_path)).collect()
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got), key=repr)


def corpus(sizes, seed=1):
    rng = random.Random(seed)
    rows = []
    for lang, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", "plain text", "With Capitals", "ÉÀ only", "3:abc-", "\U0001f600 Wide"]) 
            rows.append((len(rows) * 3 % 1009 if rng.random() < 0.97 else None, rng.choice(["s1", None, ""]), lang, rng.choice([None, 5, -1]), text))
    return rows


@pytest.mark.parametrize("sizes", [
    {"en": 1}, {None: 1, "": 1, "-": 1}, {"en": 8, "de": 9, None: 7}, {"en": 64, "de": 65, "é": 2, "z": 1},
    {"en": 600, "fr": 513, None: 72}, {**{f"l{k}": k % 5 + 1 for k in range(70)}, None: 3},
], ids=lambda s: f"{len(s)}-groups-{sum(s.values())}")
def test_manifest(spark, tmp_path, sizes):
    rows = corpus(sizes)
    assert found(spark, rows, tmp_path) == plain(rows)


@pytest.mark.parametrize("stride", [1, 2])
def test_strides_give_the_same(spark, tmp_path, monkeypatch, stride):
    rows = corpus({"en": 700, "de": 3})
    run = merkle.proofs
    monkeypatch.setattr(merkle, "proofs", lambda *a: run(*a, stride=stride))
    assert found(spark, rows, tmp_path) == plain(rows)


def test_repeated_rows_and_ties(spark, tmp_path):
    rows = [(5, "s", "en", 1, "Same")] * 300 + [(5, "s", "en", 1, "other")] * 3 + [(None, None, None, None, None)] * 20
    got = found(spark, rows, tmp_path)
    assert got == plain(rows) and len(got) == 323
    assert {r[6] for r in got if r[1] == leaf(rows[0])} == {zlib.crc32(b"5") % 3 != 0}


def test_empty_table(spark, tmp_path):
    assert found(spark, [], tmp_path) == []


def test_other_columns_and_no_tampering(spark):
    df = spark.createDataFrame([(k, f"k{k % 2}", k * 2) for k in range(20)], "id long, part string, x long")
    out = merkle.manifest(df, group="part", key="id", fields=("id", "x"))
    out = out.select("leaf", "now", "root", merkle.folded(merkle.F.col("now"), merkle.F.col("path"), merkle.F.col("levels")).alias("again")).collect()
    assert len(out) == 20 and all(r.leaf == r.now and r.again == r.root for r in out)
