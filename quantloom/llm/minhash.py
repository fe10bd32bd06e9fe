"""Operator 12: near-duplicate groups by bottom-k sketches.

A text's A-Z are lowered, its words are the runs outside [\\x20\\x09-\\x0D]; its set holds the XXH64 of its
distinct ``width``-word shingles (with fewer words: of the whole sequence).  The sketch of a set is its
``k`` smallest values, one hash function for all.  Documents are linked at a Jaccard similarity of
``percent`` / 100 or more, decided by whole sets; groups are the connected components.

Plan
  sets        one Arrow pass gives size, set digest and sketch of every row (no shuffle, a table is written);
              rows with one set are one representative from here on, so exact copies never meet in a list.
  sketches    sketch values are counted (partial sums first), over rows: a value is another set's too if more
              rows have it than the set has copies.  Two linked sketches share at least ``shared_least`` values;
              sets that share fewer with others have no partner, the others are live, and their whole sets are
              made.  Whole sketches stay where they are here; later joins deal out the texts, sketches and sets that
              they may ask for, and few others (``among``).
  lists       with the whole sets of the live ones the bound is exact: a set meets others in the lists of its
              n - ceil(n * percent) + 1 rarest values (prefix filter), each with its place in the set's order
              of rarity.  Two sets whose first common value is at places i and j share at most min(na - i,
              nb - j); pairs that this keeps under the threshold are none.  What half the corpus has in
              common builds no list, unless it is nearly all of a text.
  centres     a list's pairs are not listed.  First the centres of each list (the sets whose values are the most
              frequent, then also one for each of eight hash classes) are paired with the members, and each
              member tries the centre that it shares the most lists with: a group of near copies becomes one
              component around its base.
  blocks      then pairs in different components that the bounds of size and place leave are found in each
              list, by arrays, in blocks: longer lists are cut, and each pair of blocks is a unit of work.
              No list, partner or candidate is capped.
  filter      the k smallest values of both sketches together are a sample of the union: a pair stays if
              ``shared_least`` of them are in both sets.  Where the union is not larger than k this is exact.
  verify      pairs that stay meet the whole sets of both and are linked by sizes of intersection and union.

A linked pair is lost only if fewer than ``shared_least(k)`` of its k sampled values are shared; the
least count is chosen such that this has a chance under ``LOSS`` = 1e-12 for one pair.  Sets up to
0.85 k values have no chance of it at all.

Defined results: null, empty and blank texts have an empty set, are linked with nothing and name
themselves; repeated rows are kept, each with its group; a null doc_id takes part but never names a
group unless all its ids are null (then the name is null); ``kept`` compares null as a value; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, documents, released, shuffles_freed, written
from .simhash import WORD

K = 96
WIDTH = 3
PERCENT = 85
#: The chance that the filter loses a pair at exactly the threshold; less above it.
LOSS = 1e-12
#: Hash classes that give a list a centre each, by round.
CLASSES = (1, 8)
#: Members of a list that one unit of work compares with each other, or with as many others.
BLOCK = 8192
#: Pairs that leave a task at once, about.
HELD = 1 << 16
#: Bits of the map of the keys that a join asks for, whatever their number: 4 MB.
MAP_BITS = 1 << 25


def shingle_set(text: bytes, width: int = WIDTH, seed: int = 42) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted."""
    words = WORD.findall(text.lower())
    if not words:
        return np.empty(0, np.int64)
    n = max(1, len(words) - width + 1)
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = ends[min(width, len(words)) - 1:].tolist()
    first = [0, *(ends[: n - 1] + 1).tolist()]
    pieces = (whole[a:b] for a, b in zip(first, last))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(seed)), np.uint64, n).view(np.int64))


@lru_cache
def shared_least(k: int, percent: int = PERCENT, loss: float = LOSS) -> int:
    """The largest c such that under c of k draws hit with a chance of at most ``loss``, each hitting with percent / 100.

    The k smallest values of a union are drawn without replacement, which spreads less than this binomial.
    """
    p, total, c = percent / 100, 0.0, 0
    while True:
        total += comb(k, c) * p ** c * (1 - p) ** (k - c)
        if total > loss:
            return c
        c += 1


def _lists_of(column: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, column)]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *column])))


def sketches(docs: DataFrame, width: int = WIDTH, k: int = K) -> DataFrame:
    """(doc_id, text_key, n, digest, sketch) of every row; digest tells sets apart, text_key texts."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):  # long texts' sets are let go early
                part = b.slice(at, 64)
                sets = [shingle_set(t or b"", width) for t in part.column(2).cast(pa.binary()).to_pylist()]
                digests = [hashlib.sha256(s.tobytes()).digest()[:16] for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), _lists_of([s[:k] for s in sets])], ["doc_id", "text_key", "n", "digest", "sketch"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("text_key"), text.alias("text"))
    return rows.mapInArrow(released(run), "doc_id long, text_key binary, n long, digest binary, sketch array<long>")


def whole_sets(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """(row, text) -> (row, whole)."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                sets = [shingle_set(t or b"", width) for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), _lists_of(sets)], ["row", "whole"])

    return texts.select("row", "text").mapInArrow(released(run), "row long, whole array<long>")


def among(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key may be one of ``wanted``, a table with that column alone: a join need not deal out the others.

    ``MAP_BITS`` bits, one for a hash: no row is lost, and the more keys are wanted, the more others pass.
    """
    def place(c):
        return F.pmod(F.xxhash64(c), F.lit(MAP_BITS))

    at = F.bitmap_bit_position("_at")
    maps = wanted.select(place(key).alias("_at")).groupBy(F.bitmap_bucket_number("_at").alias("_bucket")).agg(F.bitmap_construct_agg(at).alias("_map"))
    byte = F.conv(F.hex(F.substring("_map", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    kept = rows.withColumn("_at", place(key)).withColumn("_bucket", F.bitmap_bucket_number("_at")).join(F.broadcast(maps), "_bucket")
    return kept.filter(F.getbit(byte, at.bitwiseAND(7).cast("int")) == 1).select(*rows.columns)


def _by_rarity(sets: DataFrame, places, size, name: str) -> DataFrame:
    """(row, n, values) -> (row, n, score, own, alone): the values that others have too, rarest first, as far as ``places``.

    ``alone`` counts the values that no other row has: they are rarer, take the first places and need no list.
    A value goes by one number that puts the rarer first: 5 bits for the power of two that the rows with it
    reach, 58 bits of the hash.
    """
    values = sets.select("row", F.explode("values").alias("v"))
    often = values.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
    # written, as other small sides below: Spark splits a hot value only where a join reads a table
    often = written(often.select("v", F.least(F.length(F.bin("df")) - 1, F.lit(31)).cast("long").alias("power")), name)
    key = F.shiftleft("power", 58).bitwiseOR(F.shiftrightunsigned("v", 6))
    # it grows with the corpus: merged, not broadcast, at every size
    shared = values.join(often.hint("merge"), "v").groupBy("row").agg(F.sort_array(F.collect_list(key)).alias("own"))
    score = F.aggregate("own", F.lit(0.0), lambda total, x: total + F.pow(F.lit(2.0), F.shiftrightunsigned(x, 58)))
    alone = (size - F.size("own")).cast("int")
    shared = shared.join(sets.select("row", "n", places.cast("int").alias("places"), size.alias("size")), "row").withColumn("size", size)
    return shared.select("row", "n", score.alias("score"), F.slice("own", 1, F.greatest(F.col("places") - alone, F.lit(0))).alias("own"), alone.alias("alone")).filter(F.size("own") > 0)


def live_rows(own: DataFrame, sets: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """Rows (row, sketch) and sets (row, n, copies) -> the rows of sets whose sketch can meet another's."""
    least = shared_least(k, percent)
    need = F.ceil(F.col("n") * percent / 100)
    # a partner may be larger by 100 / percent: only if it still fits a sketch are all shared values seen
    need = F.when(F.col("n") * 100 <= k * percent, need).otherwise(F.least(need, F.lit(least)))
    values = own.select("row", F.explode("sketch").alias("v"))
    often = written(values.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1"), "minhash-often")
    shared = values.join(often.hint("merge"), "v").select("row", "df")
    # a set's copies have all of its values: what more rows have, another set has
    shared = shared.join(sets.select("row", "n", "copies").hint("merge"), "row").filter("df > copies")
    return shared.groupBy("row", "n").agg(F.count("*").alias("hits")).filter(F.col("hits") >= need).select("row")


def inverted_lists(wholes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(row, whole) -> (v, row, n, at, score): two linked rows meet in the list of their first common value, ``at`` its place."""
    sets = wholes.select("row", F.size("whole").cast("long").alias("n"), F.col("whole").alias("values"))
    own = _by_rarity(sets, F.col("n") - F.ceil(F.col("n") * percent / 100) + 1, F.col("n"), "minhash-often-whole")
    return own.select("row", "n", "score", "alone", F.posexplode("own").alias("k", "v")).select("v", "row", "n", (F.col("alone") + F.col("k")).cast("long").alias("at"), "score")


def _in_reach(na, ia, nb, ib, percent: int):
    """Whether sets of these sizes whose first common value has these places can be linked."""
    most = F.least(na - ia, nb - ib)
    return most * 100 >= (na + nb - most) * percent


def centre_pairs(members: DataFrame, classes: int, percent: int) -> DataFrame:
    """(a, b, na, nb), a < b: each member of a list in more than one component with the centre it shares the most lists with."""
    rank = F.struct("score", "row", "n", "at", "root")
    centres = members.groupBy("v", F.pmod(F.xxhash64("row"), F.lit(classes)).alias("class")).agg(F.max(rank).alias("c")).select("v", "c")
    pairs = members.join(written(centres, "minhash-centres"), "v").filter("root <> c.root")
    pairs = pairs.filter(_in_reach(F.col("n"), F.col("at"), F.col("c.n"), F.col("c.at"), percent))
    counted = pairs.groupBy(F.col("row").alias("b"), F.col("c.row").alias("a")).agg(F.count("*").alias("lists"), F.max("c.score").alias("score"), F.max("n").alias("nb"), F.max("c.n").alias("na"))
    best = counted.groupBy("b").agg(F.max(F.struct("lists", "score", "a", "na", "nb")).alias("x"))
    turned = F.col("x.a") > F.col("b")
    out = best.select(F.least("x.a", "b").alias("a"), F.greatest("x.a", "b").alias("b"), F.when(turned, F.col("x.nb")).otherwise(F.col("x.na")).alias("na"), F.when(turned, F.col("x.na")).otherwise(F.col("x.nb")).alias("nb"))
    return out.distinct()


def _pairs_in(t: pa.Table, percent: int):
    """Rows sorted by (v, cell, n) -> arrays (a, b, na, nb) of pairs of one list that the bounds leave, a part at a time."""
    v, cell, side, row, n, at, root = (t[c].to_numpy() for c in ("v", "cell", "side", "row", "n", "at", "root"))
    one_block = t["one_block"].to_numpy(zero_copy_only=False)
    held, count = [], 0
    i = np.arange(len(v))
    for d in range(1, len(v)):
        i = i[i + d < len(v)]
        j = i + d
        # rows go by size: once a partner is too large, all later ones are
        i = i[(v[i] == v[j]) & (cell[i] == cell[j]) & (n[i] * 100 >= n[j] * percent)]
        if not len(i):
            break
        j = i + d
        most = np.minimum(n[i] - at[i], n[j] - at[j])
        ok = (root[i] != root[j]) & (one_block[i] | (side[i] != side[j])) & (most * 100 >= (n[i] + n[j] - most) * percent)
        if ok.any():
            x, y = i[ok], j[ok]
            x, y = np.where(row[x] < row[y], x, y), np.where(row[x] < row[y], y, x)
            held.append((row[x], row[y], n[x], n[y]))
            count += len(x)
            if count > HELD:
                yield [np.concatenate(c) for c in zip(*held)]
                held, count = [], 0
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def block_pairs(members: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb), a < b: all pairs of a list in different components that can be linked."""

    def run(batches):
        names = ["a", "b", "na", "nb"]
        kept = []

        def out(t):
            for part in _pairs_in(t.combine_chunks(), percent):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in part], names)

        for b in batches:
            if not b.num_rows:
                continue
            kept.append(b)
            t = pa.Table.from_batches(kept)
            v, cell = t["v"].to_numpy(), t["cell"].to_numpy()
            cut = int(np.flatnonzero((v != v[-1]) | (cell != cell[-1]))[-1:].max(initial=-1)) + 1  # the last unit may go on
            if cut:
                yield from out(t.slice(0, cut))
                kept = t.slice(cut).combine_chunks().to_batches()
        if kept:
            yield from out(pa.Table.from_batches(kept))

    lengths = written(members.groupBy("v").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks")), "minhash-blocks")
    # lists of one block, nearly all, need no copy of their rows
    side = F.pmod(F.xxhash64("row"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    units = members.join(lengths, "v").withColumn("side", side).withColumn("other", other)
    units = units.withColumn("cell", F.least("side", "other") * F.col("blocks") + F.greatest("side", "other"))
    units = units.select("v", "cell", "side", (F.col("side") == F.col("other")).alias("one_block"), "row", "n", "at", "root").repartition("v", "cell").sortWithinPartitions("v", "cell", "n")
    return units.mapInArrow(released(run), "a long, b long, na long, nb long").distinct()


def _with(pairs: DataFrame, side: str, table: DataFrame, column: str) -> DataFrame:
    """``column`` of the row that ``side`` names, as column + side."""
    return pairs.join(table.select(F.col("row").alias(side), F.col(column).alias(column + side)), side)


def _of_pairs(table: DataFrame, pairs: DataFrame) -> DataFrame:
    return among(table, "row", pairs.select(F.explode(F.array("a", "b")).alias("row")))


def likely(pairs: DataFrame, own: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """Pairs whose union sketch lets them be linked."""
    own = _of_pairs(own, pairs)
    both = _with(_with(pairs, "a", own, "sketch"), "b", own, "sketch")
    union = F.array_sort(F.array_union("sketcha", "sketchb"))
    both = both.withColumn("sample", F.slice(union, 1, k))
    # where the sample is smaller than k, both sets are whole in it; then the least count is that of the threshold
    hits = F.size(F.array_intersect(F.array_intersect("sketcha", "sketchb"), "sample"))
    least = F.when(F.size("sample") < k, F.ceil(F.size("sample") * percent / 100)).otherwise(F.lit(shared_least(k, percent)))
    return both.filter(hits >= least).select("a", "b", "na", "nb")


def verified(pairs: DataFrame, wholes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(u, v) of the pairs that are linked, by whole sets."""
    wholes = _of_pairs(wholes, pairs)
    both = _with(_with(pairs, "a", wholes, "whole"), "b", wholes, "whole")
    both = both.select("a", "b", "na", "nb", F.size(F.array_intersect("wholea", "wholeb")).cast("long").alias("common"))
    return both.filter(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent).select(F.col("a").alias("u"), F.col("b").alias("v"))


def links(wholes: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """(node, root) of every row that is linked with another; see the module's plan."""
    spark = wholes.sparkSession
    own = wholes.select("row", F.slice("whole", 1, k).alias("sketch"))  # sets are sorted; rows that meet none have no part
    lists = written(inverted_lists(wholes, percent), "minhash-lists")
    found = spark.createDataFrame([], "u long, v long")
    roots = spark.createDataFrame([], "node long, root long")
    tried = spark.createDataFrame([], "a long, b long")
    for classes in (*CLASSES, None):
        members = lists.join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
        unsettled = written(members.groupBy("v").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("v"), "minhash-unsettled")
        members = written(members.join(unsettled, "v", "left_semi").select("v", "row", "n", "at", "score", "root"), "minhash-open")
        pairs = centre_pairs(members, classes, percent) if classes else block_pairs(members, percent)
        pairs = written(pairs.join(tried, ["a", "b"], "left_anti"), "minhash-pairs")
        if not pairs.head(1):
            continue
        tried = tried.union(pairs.select("a", "b"))
        near = written(likely(pairs, own, k, percent), "minhash-near")
        if not near.head(1):  # whole sets are not dealt out for nothing
            continue
        new = written(verified(near, wholes, percent), "minhash-links")
        if new.head(1):
            found = found.union(new)
            roots = written(connected_components(found), "minhash-roots")
    return roots


def groups(docs: DataFrame, width: int = WIDTH, k: int = K, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs."""
    with shuffles_freed(docs.sparkSession):
        own, table = _grouped(docs, width, k, percent)
    # a set that very many rows have is split on the side of the rows
    out = own.select("doc_id", "n", "digest").join(table, "digest", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _grouped(docs: DataFrame, width: int, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Every row (doc_id, n, digest, ...) and every set's component (digest, component_id), both written."""
    own = written(sketches(docs, width, k).withColumn("row", F.monotonically_increasing_id()), "minhash-own")
    full = own.filter("n > 0")
    named = written(full.groupBy("digest").agg(F.min("row").alias("row"), F.min("doc_id").alias("least"), F.min("n").alias("n"), F.count("*").alias("copies")), "minhash-sets")
    # whole sets of those that can meet others, from one of the texts that have the representative's key
    live = written(full.select("row", "text_key").join(live_rows(full, named, k, percent), "row", "left_semi"), "minhash-live")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = among(docs.select(F.unhex(F.md5(text)).alias("text_key"), text.alias("text")), "text_key", live.select("text_key"))
    wholes = written(whole_sets(texts.dropDuplicates(["text_key"]).join(live, "text_key"), width), "minhash-wholes")
    roots = links(wholes, k, percent)
    rooted = named.join(roots, named.row == roots.node, "left").select("digest", "least", F.coalesce("root", "row").alias("root"))
    least = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "minhash-names")
    return own, written(rooted.join(least, "root").select("digest", "component_id"), "minhash-groups")


OP12_SQL = """
with recursive w as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as words
  from documents
), s as (
  select r, doc_id, list_distinct(case when len(words) = 0 then []
           when len(words) < 3 then [array_to_string(words, ' ')]
           else list_transform(generate_series(1, len(words) - 2), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) end) as sh
  from w
), u as (  -- equal sets are one node
  select md5(array_to_string(list_sort(sh), chr(10))) as h, min(r) as node, any_value(sh) as sh from s where len(sh) > 0 group by 1
), e as (  -- by size, each pair from the first of its shingles in the order of rarity
  select node, len(sh) as n, unnest(sh) as g from u
), f as (
  select g, count(*) as df from e group by g having count(*) > 1
), o as (
  select e.*, n - count(*) over (partition by node) + row_number() over (partition by node order by df, g) as place from e join f using (g)
), p as (
  select * from o where place <= n - ceil(n * 85 / 100.0) + 1
), c as (
  select distinct a.node as x, b.node as y, a.n as nx, b.n as ny
  from p a join p b on a.g = b.g and a.node < b.node and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
), k as (
  select x, y, nx, ny, len(list_intersect(a.sh, b.sh)) as common from c join u a on a.node = x join u b on b.node = y
), l as (
  select x, y from k where 100 * common >= 85 * (nx + ny - common) union all
  select y, x from k where 100 * common >= 85 * (nx + ny - common)
), reach as (
  select node, node as root from u union select reach.node, l.y from reach join l on l.x = reach.root
), g as (
  select reach.node, min(t.doc_id) as component_id
  from reach join u on u.node = reach.root join (select md5(array_to_string(list_sort(sh), chr(10))) as h, doc_id from s where len(sh) > 0) t on t.h = u.h
  group by reach.node
)
select s.doc_id, len(s.sh)::bigint as n_shingles, case when len(s.sh) = 0 then s.doc_id else g.component_id end as component_id,
       s.doc_id is not distinct from case when len(s.sh) = 0 then s.doc_id else g.component_id end as kept
from s left join u on len(s.sh) > 0 and u.h = md5(array_to_string(list_sort(s.sh), chr(10))) left join g on g.node = u.node
"""


def op12_minhash(spark, sf_dir):
    return groups(documents(spark, sf_dir))
