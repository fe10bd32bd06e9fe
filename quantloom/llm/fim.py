"""Operator 11: fill-in-middle transformation of texts.

A text is cut into units (code points, unless another pattern is given), two cut places are drawn by a
hash of the document's id, and prefix, middle and suffix change places around three sentinels, as a
model that learns to fill gaps reads them: prefix-suffix-middle (``psm``) or suffix-prefix-middle
(``spm``).  Some documents stay as they are (``plain``).

Plan: one scan and two Arrow-batched pandas UDFs, no shuffle, nothing kept between rows.  ``transform``
walks a text once with ``finditer`` of the regex library, keeps the end offset of each unit in an array
of 4 bytes a unit, and slices by two lookups; ``restore`` rebuilds the text from output and form alone.
Draws depend on id and seed only, so a task that runs again gives the same rows.

Defined results: a null text is the empty text, which is plain; a null doc_id draws like the empty
string; equal ids draw equal numbers, so repeated rows are transformed alike, each once; a text that
holds a sentinel is plain, since it could not be told apart again; characters that no unit covers go
with the unit after them (after the last unit: with the suffix); an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, released

#: Prefix, suffix and middle follow these.
SENTINELS = ("<P>", "<S>", "<M>")
CODE_POINT = r"(?s:.)"
PLAIN_PERCENT, SPM_PERCENT = 10, 20
SEED = 1


def check_sentinels(sentinels) -> None:
    """Output can be taken apart only if no sentinel lies in another or reaches over its border."""
    if len(set(sentinels)) != 3 or not all(sentinels):
        raise ValueError("three different sentinels are needed")
    for a, b in permutations(sentinels, 2):
        if a in b:
            raise ValueError(f"{a!r} lies within {b!r}")
    for a in sentinels:
        for b in sentinels:
            if any(b.startswith(a[k:]) for k in range(1, len(a))):
                raise ValueError(f"the end of {a!r} begins {b!r}")


def draws(doc_id: str, seed: int) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document."""
    h = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return tuple(int(h[k:k + 8], 16) for k in (0, 8, 16, 24))


def unit_ends(text: str, unit: regex.Pattern) -> array:
    """The offset after each unit of the text."""
    return array("I", (m.end() for m in unit.finditer(text)))


def arrange(text: str, doc_id: str, unit: regex.Pattern, sentinels=SENTINELS, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT, seed: int = SEED) -> tuple:
    """(units, form, output, prefix characters, middle characters) of one text."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    ends = unit_ends(text, unit)
    n = len(ends)
    if not text or any(s in text for s in sentinels) or h3 % 100 >= 100 - plain_percent:
        return n, "plain", text, None, None
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, last))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = sentinels
    if h4 % 100 < spm_percent:
        return n, "spm", "".join((s, suffix, p, prefix, m, middle)), a, b - a
    return n, "psm", "".join((p, prefix, s, suffix, m, middle)), a, b - a


def rebuild(output: str, form: str, sentinels=SENTINELS) -> str:
    """The text that ``arrange`` made this output from."""
    if form == "plain":
        return output
    p, s, m = sentinels
    one, two = (p, s) if form == "psm" else (s, p)
    if not output.startswith(one):
        raise ValueError(f"no {form} output")
    a = output.index(two, len(one))
    b = output.index(m, a + len(two))
    left, right, middle = output[len(one):a], output[a + len(two):b], output[b + len(m):]
    return left + middle + right if form == "psm" else right + middle + left


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def transform(docs: DataFrame, unit: str = CODE_POINT, sentinels=SENTINELS, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n, form, output, prefix_chars, middle_chars, output_sha256) of every row of docs.

    ``unit`` is a pattern whose matches are the units (those that match nothing count too); ``plain_percent``
    of the documents stay plain, ``spm_percent`` of the others are suffix first, both by hash.
    """
    check_sentinels(sentinels)
    if not (0 <= plain_percent <= 100 and 0 <= spm_percent <= 100):
        raise ValueError("percentages are 0 to 100")
    regex.compile(unit)  # a bad pattern fails here, not in the tasks

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        pattern = regex.compile(unit)
        for ids, texts in batches:
            rows = [arrange(t, i, pattern, sentinels, plain_percent, spm_percent, seed) for i, t in zip(ids, texts)]
            out = pd.DataFrame(rows, columns=["n", "form", "output", "prefix_chars", "middle_chars"])
            out = out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})
            out["output_sha256"] = [sha256(r[2]) for r in rows]
            yield out

    # ids go as text: as numbers, a null would turn a whole batch into floats
    made = F.pandas_udf(_iterated(run, 2), "n long, form string, output string, prefix_chars long, middle_chars long, output_sha256 string")
    empty = F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", made(F.coalesce(F.col("doc_id").cast("string"), empty), F.coalesce("text", empty)).alias("made")).select("doc_id", "made.*")


def restore(made: DataFrame, sentinels=SENTINELS, digest: bool = False) -> DataFrame:
    """The columns of ``transform`` and ``text``, rebuilt from output and form; ``digest``: its sha256 as restored_sha256 alone."""
    check_sentinels(sentinels)

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for outputs, forms in batches:
            texts = (rebuild(o, f, sentinels) for o, f in zip(outputs, forms))
            yield pd.Series([sha256(t) for t in texts] if digest else list(texts), dtype=object)

    back = F.pandas_udf(_iterated(run, 1), "string")
    return made.withColumn("restored_sha256" if digest else "text", back("output", "form"))


def _iterated(run, kind: int):
    """``run`` with the type hints that tell Spark what it is, giving freed memory back at the end."""
    freed = released(run)

    def frames(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        yield from freed(batches)

    def series(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        yield from freed(batches)

    # hints are kept as text by this module's annotations setting; Spark wants the types
    chosen, out = (frames, pd.DataFrame) if kind == 2 else (series, pd.Series)
    chosen.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[out]}
    return chosen


OP11_SQL = """
with d as (
  select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n,
         sha256('1:' || coalesce(doc_id::varchar, '')) as h
  from documents
), u as (
  select *, ('0x' || substr(h, 1, 8))::ubigint as h1, ('0x' || substr(h, 9, 8))::ubigint as h2,
         ('0x' || substr(h, 17, 8))::ubigint as h3, ('0x' || substr(h, 25, 8))::ubigint as h4
  from d
), c as (
  select *, least(h1 % (n + 1)::ubigint, h2 % (n + 1)::ubigint)::bigint as a,
         greatest(h1 % (n + 1)::ubigint, h2 % (n + 1)::ubigint)::bigint as b,
         case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain'
              when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from u
), p as (
  select *, left(text, a) as prefix, substring(text, a + 1, b - a) as middle, substring(text, b + 1) as suffix from c
)
select doc_id, n::bigint as n, form,
       case when form <> 'plain' then a end as prefix_chars,
       case when form <> 'plain' then b - a end as middle_chars,
       sha256(case form when 'plain' then text
                        when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(text) as restored_sha256
from p
"""


def op11_fim(spark, sf_dir):
    out = restore(transform(documents(spark, sf_dir)), digest=True)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
