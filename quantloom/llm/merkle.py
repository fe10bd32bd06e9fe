"""Operator 13: a Merkle manifest of a dataset, with a proof for each row.

Rows are leaves of one tree a group (here: lang); ``FANOUT`` consecutive nodes become one until one is left, the
group's subroot; the subroots become the root in the same way.  A row's proof is the digests of the
siblings on its way to the root; with them, anyone can recompute the root from the row alone.

Plan, column functions only
  leaves     one scan hashes the rows; from here on only digests move, never texts.
  order      rows are dealt by ranges of (group, id, digest) and sorted within the ranges; a row's index in
             its group is its place in the range plus the rows of the group in ranges before (a small table of
             a row a range and group).  A group with most of all rows is many ranges, and equal rows are told
             apart by a number of their own, so they are dealt too.  No window holds a group.
  nodes      each level groups the one below by index / 8, a shuffle an eighth as large each time; all
             levels together are the materialised node table (group, level, index, digest).
  proofs     a leaf explodes the coordinates of the siblings it needs from its index and its group's size,
             joins the node table, and the digests are put in order.  The leaf asks for three levels; what lies
             above is the same for the 512 leaves of one node, so that node asks for the next three, and so on
             to the subroot, whose siblings lead to the root.  So no coordinate is asked for by more than a
             few hundred rows.
  fold       own digest and siblings, level by level, to the root.

Defined results: ``-`` stands for a null field; a null lang is a group of its own and comes first; a
null doc_id comes first in its group; equal ids follow by digest, and equal digests are each a leaf, with
one proof each; a group of one row has its leaf as subroot, and a table of one group has the subroot as
root; an empty table gives an empty result; other columns are ignored.  In the
registered query a null doc_id counts as the empty string, whose checksum 3 divides: such rows are changed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, remainder, written

FANOUT = 8
#: Levels that one explosion covers; 8 ** 3 leaves share what lies above.
STRIDE = 3
#: Levels of the tree of subroots are counted from here.
UPPER = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A field as it is hashed: its length in bytes, a colon, itself; or ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(text: Column) -> Column:
    """sha256 as 32 bytes; tables keep these, and hashing takes them as hex text."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def hex_of(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def joined(digests: Column) -> Column:
    """Hex texts of an array of digests, one after the other."""
    return F.array_join(F.transform(digests, hex_of), "")


def leaf_of(columns: dict[str, Column]) -> Column:
    return digest(F.concat(*[field(c) for c in columns.values()]))


def group_key(column: str) -> Column:
    """A text that sorts as the column does, null first, and is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("-"))


def indexed(rows: DataFrame, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Rows (grp, ...) with ``idx``, their place within grp by ``order``; and (grp, size).  Both written."""
    dealt = rows.withColumn("nonce", F.monotonically_increasing_id())
    keys = ["grp", *order, "nonce"]
    parts = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = dealt.repartitionByRange(int(parts), *keys).sortWithinPartitions(*keys)
    # the range's number and the place in it: what this function gives, written at once and then fixed
    placed = written(dealt.withColumn("at", F.monotonically_increasing_id()).drop("nonce"), f"{name}-placed")
    part = F.shiftright("at", 33)
    parts = placed.groupBy("grp", part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("low"))
    # a group has a row a range here, whatever its size
    ranges = parts.groupBy("grp").agg(F.sum("n").alias("size"), F.array_sort(F.collect_list(F.struct("part", "n", "low"))).alias("parts"))
    ranges = written(ranges, f"{name}-ranges")
    before = F.aggregate(F.slice("parts", 1, F.col("k")), F.lit(0).cast("long"), lambda total, x: total + x.n)
    starts = ranges.select("grp", "parts", F.posexplode("parts").alias("k", "p")).select("grp", F.col("p.part").alias("part"), (before - F.col("p.low")).alias("shift"))
    starts = written(starts, f"{name}-starts")
    out = placed.withColumn("part", part).join(starts, ["grp", "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "shift")
    return written(out, f"{name}-leaves"), ranges.select("grp", "size")


def node_table(leaves: DataFrame, sizes: DataFrame, name: str) -> DataFrame:
    """(grp, level, idx, digest) of all nodes: leaves are level 0, a group ends with its subroot."""
    largest = sizes.agg(F.max("size")).first()[0] or 0
    level = leaves.select("grp", F.lit(0).alias("level"), "idx", F.col("leaf").alias("digest"))
    levels, count = [level], 1
    while largest > count:
        # groups that are one node already go no higher
        below = levels[-1].join(sizes.filter(F.col("size") > count).select("grp"), "grp", "left_semi")
        up = below.groupBy("grp", F.floor(F.col("idx") / FANOUT).cast("long").alias("up")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("run"))
        up = up.select("grp", F.lit(len(levels)).alias("level"), F.col("up").alias("idx"), digest(joined(F.col("run.digest"))).alias("digest"))
        levels.append(written(up, f"{name}-level-{len(levels)}"))
        count *= FANOUT
    return reduce(DataFrame.union, levels)


def height(size: Column, most: int = 21) -> Column:
    """Levels above the leaves: how often ``FANOUT`` nodes become one until one is left."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(most - 1)), F.lit(0), lambda h, k: h + (size > F.pow(F.lit(float(FANOUT)), k)).cast("int"))


def floor_div(value: Column, by: Column) -> Column:
    return F.floor(value / by).cast("long")


def coordinates(entities: DataFrame, stride: int, base: int) -> DataFrame:
    """(grp, idx, size) of nodes at level ``base`` -> a row a sibling on the next levels: grp, idx, level, sib, before."""
    levels = F.sequence(F.lit(base), F.lit(base + stride - 1))
    rows = entities.select("grp", "idx", "size", F.explode(levels).alias("level"))
    width = F.pow(F.lit(float(FANOUT)), F.col("level"))
    rows = rows.filter(F.col("size") > width)  # a level of one node has no runs
    own = floor_div(F.col("idx"), F.pow(F.lit(float(FANOUT)), F.col("level") - base))
    last = F.ceil(F.col("size") / width).cast("long") - 1
    rows = rows.select("grp", "idx", "level", own.alias("own"), last.alias("last"))
    first = floor_div(F.col("own"), F.lit(FANOUT)) * FANOUT
    rows = rows.select("grp", "idx", "level", "own", F.explode(F.sequence(first, F.least(first + FANOUT - 1, F.col("last")))).alias("sib"))
    return rows.filter("sib <> own").select("grp", "idx", "level", "sib", (F.col("sib") < F.col("own")).alias("before"))


def proofs(leaves: DataFrame, nodes: DataFrame, sizes: DataFrame, tops: DataFrame, name: str, stride: int = STRIDE) -> DataFrame:
    """Leaves with ``path``, the siblings (level, sib, before, digest) in order, up to the subroot and on as ``tops`` (grp, rest) says."""
    largest = sizes.agg(F.max("size")).first()[0] or 0
    tall = 0
    while FANOUT ** tall < largest:
        tall += 1
    # what the subroots need is passed down: (grp, up, rest) for the nodes a stride above the one in work
    rest = tops.select("grp", F.lit(0).cast("long").alias("up"), "rest")
    for base in range(tall - tall % stride, -1, -stride):
        entities = leaves if base == 0 else nodes.filter(F.col("level") == base).select("grp", "idx").join(sizes.filter(F.col("size") > FANOUT ** (base - 1)), "grp")
        asked = coordinates(entities, stride, base)
        # node_table gives longs: the coordinates' types are alike, so the join is one of hashes alone
        met = asked.join(nodes.select("grp", "level", F.col("idx").alias("sib"), "digest"), ["grp", "level", "sib"])
        part = met.groupBy("grp", "idx").agg(F.array_sort(F.collect_list(F.struct("level", "sib", "before", "digest"))).alias("part"))
        whole = entities.join(part, ["grp", "idx"], "left").withColumn("up", floor_div(F.col("idx"), F.lit(FANOUT ** stride)))
        none = F.slice("rest", 1, 0)
        whole = whole.join(rest, ["grp", "up"], "left").withColumn("path", F.concat(F.coalesce("part", none), F.col("rest"))).drop("part", "rest", "up")
        if base == 0:
            return whole
        # groups that end below this level go on with their subroot's rest
        short = tops.join(sizes.filter(F.col("size") <= FANOUT ** (base - 1)).select("grp"), "grp", "left_semi")
        rest = written(whole.select("grp", F.col("idx").alias("up"), F.col("path").alias("rest")).union(short.select("grp", F.lit(0).cast("long").alias("up"), "rest")), f"{name}-rest-{base}")


def folded(own: Column, path: Column, levels: Column) -> Column:
    """The root that a leaf's digest and its siblings give; ``levels`` numbers the levels to go through."""

    def step(digest_, level):
        here = F.filter(path, lambda x: x.level == level)
        left = F.transform(F.filter(here, lambda x: x.before), lambda x: x.digest)
        right = F.transform(F.filter(here, lambda x: ~x.before), lambda x: x.digest)
        return digest(joined(F.concat(left, F.array(digest_), right)))

    return F.aggregate(levels, own, step)


def manifest(rows: DataFrame, group: str = "lang", key: str = "doc_id", fields=FIELDS, changed: dict[str, Column] | None = None, tampered: Column | None = None) -> DataFrame:
    """(key, group, leaf, subroot, root, path, levels, now): digests as 32 bytes.

    ``path`` is a leaf's proof and ``levels`` the levels it goes through; ``now`` is the digest of the row with
    the columns of ``changed`` in place of its own, where ``tampered`` says so, else the leaf.
    """
    columns = {c: F.col(c) for c in fields}
    leaf = leaf_of(columns)
    now = F.when(tampered, leaf_of(columns | (changed or {}))).otherwise(leaf) if tampered is not None else leaf
    spark = rows.sparkSession
    hashed = rows.select(group_key(group).alias("grp"), F.col(key).cast("long").alias("key"), leaf.alias("leaf"), now.alias("now"))
    leaves, sizes = indexed(hashed, ["key", "leaf"], "merkle")
    nodes = node_table(leaves, sizes, "merkle")
    # the subroots are the leaves of a tree of their own, of one group
    tops = nodes.join(sizes, "grp").filter(F.col("level") == height(F.col("size"))).select(F.lit("").alias("grp"), F.col("grp").alias("key"), F.col("digest").alias("leaf"))
    upper, upper_size = indexed(tops, ["key"], "merkle-upper")
    upper_nodes = node_table(upper, upper_size, "merkle-upper")
    nothing = spark.createDataFrame([("", [])], "grp string, rest array<struct<level: int, sib: bigint, before: boolean, digest: binary>>")
    ways = proofs(upper.join(upper_size, "grp"), upper_nodes, upper_size, nothing, "merkle-upper")
    raised = F.transform("path", lambda x: F.struct((x.level + UPPER).alias("level"), x.sib.alias("sib"), x.before.alias("before"), x.digest.alias("digest")))
    ways = written(ways.select(F.col("key").alias("grp"), F.col("leaf").alias("subroot"), raised.alias("rest")), "merkle-ways")
    root = upper_nodes.join(upper_size, "grp").filter(F.col("level") == height(F.col("size"))).select("digest").first()
    upper_levels = upper_size.select(height(F.col("size"))).first()
    entities = leaves.join(written(sizes.join(ways.select("grp", "subroot"), "grp"), "merkle-groups"), "grp")
    out = proofs(entities, nodes, sizes, ways.select("grp", "rest"), "merkle")
    if root is None:  # no rows
        return out.select("key", "grp", "leaf", "subroot", F.col("leaf").alias("root"), "path", F.array().cast("array<int>").alias("levels"), "now")
    count = lambda start, n: F.slice(F.sequence(F.lit(start), F.lit(start + 31)), 1, n)
    levels = F.concat(count(0, height(F.col("size"))), count(UPPER, F.lit(upper_levels[0])))
    return out.select("key", "grp", "leaf", "subroot", F.lit(bytes(root[0])).alias("root"), "path", levels.alias("levels"), "now")


OP13_SQL = """
with recursive f as (
  select doc_id, coalesce('=' || lang, '-') as grp, crc as c,
         coalesce(octet_length(encode(doc_id::varchar))::varchar || ':' || doc_id::varchar, '-') || coalesce(octet_length(encode(source))::varchar || ':' || source, '-')
           || coalesce(octet_length(encode(lang))::varchar || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::varchar))::varchar || ':' || n_chars::varchar, '-') as head,
         text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low
  from (
    -- crc32 of the decimal id, a byte and a bit at a time
    select *, xor(list_reduce([4294967295::ubigint] || list_transform(range(1, length(coalesce(doc_id::varchar, '')) + 1), lambda i: ascii(substr(doc_id::varchar, i, 1))::ubigint),
      lambda acc, b: list_reduce([xor(acc, b)] || list_transform(range(8), lambda j: 0::ubigint), lambda a, z: case when a & 1 = 1 then xor(a >> 1, 3988292384::ubigint) else a >> 1 end)), 4294967295::ubigint) as crc
    from documents)
), h as (
  select doc_id, grp, sha256(head || coalesce(octet_length(encode(text))::varchar || ':' || text, '-')) as leaf,
         sha256(head || coalesce(octet_length(encode(text))::varchar || ':' || case when c % 3 = 0 then low else text end, '-')) as now
  from f
), leaves as (
  select *, row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by grp) as size from h
), nodes as (
  select grp, 0 as level, idx, leaf as d, size from leaves
  union all
  select grp, level + 1, idx // 8, sha256(string_agg(d, '' order by idx)), (max(size) + 7) // 8 from nodes where size > 1 group by grp, level, idx // 8
), runs as (
  select grp, level, idx // 8 as up, list(d order by idx) as run from nodes where size > 1 group by all
), tops as (
  select grp, d as subroot, row_number() over (order by grp) - 1 as idx, count(*) over () as size from nodes where size = 1
), upper_nodes as (
  select 0 as level, idx, subroot as d, size from tops
  union all
  select level + 1, idx // 8, sha256(string_agg(d, '' order by idx)), (max(size) + 7) // 8 from upper_nodes where size > 1 group by level, idx // 8
), upper_runs as (
  select level, idx // 8 as up, list(d order by idx) as run from upper_nodes where size > 1 group by all
), way as (
  select row_number() over () as r, grp, doc_id, leaf, 0 as level, idx, now as d, '' as proof from leaves
  union all
  select r, way.grp, doc_id, leaf, way.level + 1, idx // 8, sha256(array_to_string(run[1:idx % 8] || [d] || run[idx % 8 + 2:], '')), proof || array_to_string(run[1:idx % 8] || run[idx % 8 + 2:], '')
  from way join runs on runs.grp = way.grp and runs.level = way.level and runs.up = way.idx // 8
), own as (
  select way.*, t.idx as place, t.subroot from way join tops t on t.grp = way.grp
  qualify row_number() over (partition by r order by level desc) = 1
), further as (
  select r, doc_id, leaf, subroot, 0 as level, place as idx, d, proof from own
  union all
  select r, doc_id, leaf, subroot, further.level + 1, idx // 8, sha256(array_to_string(run[1:idx % 8] || [d] || run[idx % 8 + 2:], '')), proof || array_to_string(run[1:idx % 8] || run[idx % 8 + 2:], '')
  from further join upper_runs u on u.level = further.level and u.up = further.idx // 8
)
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, d as folded_root, d = root as verified
from (select * from further qualify row_number() over (partition by r order by level desc) = 1), (select d as root from upper_nodes where size = 1)
"""


def op13_merkle(spark, sf_dir):
    docs = documents(spark, sf_dir)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    out = manifest(docs, changed={"text": F.translate("text", upper, lower)}, tampered=remainder(F.col("doc_id"), 3) == 0)
    out = out.withColumn("again", folded(F.col("now"), F.col("path"), F.col("levels")))
    proof = F.sha2(joined(F.transform("path", lambda x: x.digest)).cast("binary"), 256)
    return out.select(
        F.col("key").alias("doc_id"), hex_of(F.col("leaf")).alias("leaf"), hex_of(F.col("subroot")).alias("subroot"), hex_of(F.col("root")).alias("root"),
        proof.alias("proof_sha256"), hex_of(F.col("again")).alias("folded_root"), (F.col("again") == F.col("root")).alias("verified"),
    )
