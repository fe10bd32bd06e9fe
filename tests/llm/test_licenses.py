"""Licence scan against its SQL and the bounds against plain sets."""

import random

import pytest

from quantloom.llm import licenses


def test_equals_its_sql_on_odd_texts(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(1)
    notices = [t for texts in licenses.TEMPLATES.values() for t in texts]
    texts = [None, "", " ", "\n\n", "..", "All rights reserved", "ALL RIGHTS RESERVED.\r\nx", "All rights\n \nreserved", "Ünï. All rights reserved.\x0b", "all\x01rights reserved", "K all rights reserved"]
    for k in range(150):
        words = rng.choice(notices).split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = rng.choice(["the", "x", "software;", "a.", "(b)"])
        around = lambda: rng.choice(["", "Some words. ", "Head\n", "one two three ", "\n\n", "q; "])
        texts.append(around() + "".join(w + rng.choice([" "] * 9 + ["\n", "  "]) for w in words) + around())
    texts.append("word " * 60_000 + "\nAll rights reserved.")
    rows = [(k if k % 9 else None, t, "mit", 1) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, license string, dice int").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(licenses.op3_licenses(spark, str(tmp_path)).collect(), key=str)
    assert [tuple(r) for r in got] == sorted(con.execute(licenses.op3_sql()).fetchall(), key=lambda r: str(licenses_row(r))) and len(got) > 60


def licenses_row(r):
    from pyspark.sql import Row

    return Row(doc_id=r[0], license=r[1], dice=r[2])


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_every_match_has_a_telling_word(threshold):
    sets = licenses.template_sets(licenses.TEMPLATES)
    tell = set(licenses.telling_words(sets, threshold))
    assert threshold < licenses.THRESHOLD or len(tell) < 60
    for _, g in sets:
        # the fewest shared bigrams with which a unit can still match
        least = int(len(g) * threshold / (2 - threshold) + 1 - 1e-9)
        bare = [x for x in g if not tell & set(x.split())]
        assert len(bare) < max(least, 1)


def test_no_template_is_too_long_for_the_sql():
    assert all(len(g) < 266 for _, g in licenses.template_sets(licenses.TEMPLATES))
