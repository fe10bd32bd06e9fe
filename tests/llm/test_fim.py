"""Fill-in-middle against a plain version, and back again."""

import hashlib
import random

import pytest
import regex
from pyspark.sql import functions as F

from quantloom.llm import fim

ODD = ["", None, "a", "éß", "\U0001f926\U0001f3fc‍♂️ z", "é́", "has <P> inside", "ends <", "<S", "P>", "line\r\nline\n", "\x00\x01", "<P", ">" * 9, "日本語テキスト"]


def plain(doc_id, text):
    """The contract, a code point at a time."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    points = list(text)
    n = len(points)
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return n, "plain", None, None, text
    pre, mid, suf = ("".join(x) for x in (points[:i], points[i:j], points[j:]))
    if h4 % 100 < 20:
        return n, "spm", i, j - i, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", i, j - i, f"<P>{pre}<S>{suf}<M>{mid}"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, n int, output string")


def test_transform_and_restore(spark):
    rng = random.Random(3)
    rows = [(k, ODD[k % len(ODD)]) for k in range(120)] + [(None, "no id"), (None, "no id"), (7, "twice"), (7, "twice")]
    rows += [(1000 + k, "".join(rng.choice("ab<>PSM \né") for _ in range(rng.randint(0, 40)))) for k in range(400)] + [(5000, "long \U0001f600" * 200_000)]
    got = fim.restore(fim.restore(fim.transform(table(spark, rows))), digest=True).collect()
    want = sorted((repr(i), *map(repr, plain(i, t)), repr(t or "")) for i, t in rows)
    assert sorted((repr(r.doc_id), *map(repr, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.text))) for r in got) == want
    for r in got:
        assert r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest() and r.restored_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_other_units_rates_and_sentinels(spark):
    rows = [(k, f"one two  three{k} four\n" * 3) for k in range(300)]
    words = fim.transform(table(spark, rows), unit=r"\S+\s*", sentinels=("\x01p", "\x01s", "\x01m"), plain_percent=0, spm_percent=100)
    back = fim.restore(words, ("\x01p", "\x01s", "\x01m")).collect()
    text = dict(rows)
    assert all(r.form == "spm" and r.n == 12 and r.text == text[r.doc_id] for r in back)
    starts = set(range(13))
    for r in back:
        ends = [0, *fim.unit_ends(text[r.doc_id], regex.compile(r"\S+\s*"))]
        assert r.prefix_chars in ends and r.prefix_chars + r.middle_chars in ends
        starts.discard(ends.index(r.prefix_chars))
    assert len(starts) < 3  # cuts fall everywhere
    # units that leave characters out, or match nothing at all, still give the whole text back
    for unit in ("x", r"\w*", "(?=t)"):
        assert all(r.text == text[r.doc_id] for r in fim.restore(fim.transform(table(spark, rows), unit=unit)).collect())
    assert fim.transform(table(spark, rows), plain_percent=100).filter("form <> 'plain'").count() == 0


def test_draws_are_even_and_depend_on_the_id_alone(spark):
    made = fim.transform(spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x" * 99).alias("text")))
    forms = dict(made.groupBy("form").count().collect())
    assert abs(forms["plain"] / 4000 - 0.10) < 0.02 and abs(forms["spm"] / 3600 - 0.20) < 0.03
    one = made.orderBy("doc_id").collect()
    assert one == fim.transform(made.select("doc_id", F.lit("x" * 99).alias("text")).repartition(7)).orderBy("doc_id").collect()
    assert one != fim.transform(made.select("doc_id", F.lit("x" * 99).alias("text")), seed=2).orderBy("doc_id").collect()


def test_empty_table_and_bad_parameters(spark):
    none = table(spark, [(1, "x")]).limit(0)
    assert fim.restore(fim.transform(none), digest=True).collect() == []
    for bad in (("<P>", "<P>", "<M>"), ("", "a", "b"), ("ab", "xaby", "z"), ("ab", "bc", "x"), ("aa", "b", "c")):
        with pytest.raises(ValueError):
            fim.check_sentinels(bad)
    with pytest.raises(ValueError):
        fim.transform(none, spm_percent=101)
    with pytest.raises(ValueError):
        fim.rebuild("no sentinel", "psm")


def test_registered_query_over_empty_parquet(spark, tmp_path):
    table(spark, [(1, "x")]).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert fim.op11_fim(spark, str(tmp_path)).collect() == []
