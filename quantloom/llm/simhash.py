"""Operator 6: SimHash near-duplicate groups by a binary-trie self-join.

A text's A-Z are lowered, its words are the runs outside [\\x20\\x09-\\x0D], its features the
``width``-word shingles (repeats count).  Fingerprints within ``radius`` bits are linked; the groups
are the connected components.

Plan: fingerprints in one Arrow pass (no shuffle) -> distinct fingerprints -> four (radius + 1)
rotations, each dealt by its leading block, so that every linked pair meets at least once -> in each
task a binary trie over the sorted rotated keys is joined with itself -> a spanning forest of the
links leaves the task -> components by stars.  In a block with very many keys the pairs agree on the
block, so on one of radius + 1 parts of the rest too: its keys are dealt on by these parts, as often
as blocks stay large (twice at most).  The trie join goes depth first beyond ``FRONTIER`` node pairs
and folds links into the forest as it finds them, so a dense cluster's pairs are never held.
Fingerprints shared by very many rows (that of empty texts) meet their group in a join that Spark may
split on the side of the rows.

Defined results: null and empty texts have fingerprint zero and link like any other; repeated rows
are kept, each with its group; a null doc_id takes part but is never a group's name unless all are
null (then the name is null); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, documents, released, written

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: A block value with more distinct fingerprints than this is dealt on by parts of the other bits.
HOT_BLOCK = 100_000
#: Node pairs that a trie join expands at once, and links that it gathers before folding them in.
FRONTIER = 1 << 18
U = np.uint64


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a text's word shingles."""
    words = WORD.findall(text.lower())
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = ends[min(width, len(words)) - 1:]
    first = np.concatenate(([0], ends[: n - 1] + 1))
    pieces = [whole[a:b] for a, b in zip(first.tolist(), last.tolist())]
    h = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(seed)), np.uint64, n)
    total = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):  # very long texts in bounded memory
        total += np.unpackbits(h[k:k + (1 << 16)].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            fps = np.fromiter((fingerprint(t or b"", width, seed) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(run), "doc_id long, fp long")


def trie_join(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray, radius: int, found) -> None:
    """Call ``found(x, y)`` with index pairs that hold every pair of keys within ``radius`` bits.

    ``keys`` are 64-bit and sorted within each span [lo, hi); the keys of a span agree on its first
    ``depth`` bits.  Node pairs of a span's binary trie descend together, a level at a time; a pair goes
    when its bits exceed the radius, and is compared key by key once both nodes are small.  Too many at
    once are cut in two, one half waiting.
    """
    ones: dict[int, np.ndarray] = {}

    def before(level):
        """How many keys before each have a one at this bit."""
        if level not in ones:
            if len(ones) > 8:
                ones.clear()
            ones[level] = np.concatenate(([0], np.cumsum((keys >> U(63 - level)) & U(1), dtype=np.int64)))
        return ones[level]

    todo = []
    for d in np.unique(depth)[::-1].tolist():
        at = depth == d
        todo.append((d, lo[at], hi[at], lo[at], hi[at], np.zeros(at.sum(), np.int64)))
    while todo:
        level, alo, ahi, blo, bhi, spent = todo.pop()
        if len(alo) > FRONTIER:
            half = len(alo) // 2
            todo += [(level, *(z[half:] for z in (alo, ahi, blo, bhi, spent))), (level, *(z[:half] for z in (alo, ahi, blo, bhi, spent)))]
            continue
        na, nb = ahi - alo, bhi - blo
        small = (na * nb <= 4) | (level == 64)
        for i in range(int(na[small].max(initial=0))):
            for j in range(int(nb[small].max(initial=0))):
                ok = small & (i < na) & (j < nb)
                x, y = alo[ok] + i, blo[ok] + j
                if len(x):
                    hit = (x < y) & (np.bitwise_count(keys[x] ^ keys[y]) <= radius)
                    if hit.any():
                        found(x[hit], y[hit])
        alo, ahi, blo, bhi, spent = (z[~small] for z in (alo, ahi, blo, bhi, spent))
        if not len(alo):
            continue
        one = before(level)
        amid, bmid = ahi - (one[ahi] - one[alo]), bhi - (one[bhi] - one[blo])
        same = (alo == blo) & (ahi == bhi)
        kids = [(alo, amid, blo, bmid, spent, None), (amid, ahi, bmid, bhi, spent, None), (alo, amid, bmid, bhi, spent + 1, None), (amid, ahi, blo, bmid, spent + 1, ~same)]
        parts = []
        for a, b, c, d, s, only in kids:
            keep = (b > a) & (d > c) & (s <= radius) & ~((a == c) & (b == d) & (b - a == 1))
            if only is not None:
                keep &= only
            parts.append([z[keep] for z in (a, b, c, d, s)])
        todo.append((level + 1, *(np.concatenate(z) for z in zip(*parts))))


class Forest:
    """Components of n nodes, a batch of links at a time: root is the smallest index."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.held: list[tuple] = []
        self.size = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.held.append((a, b))
        self.size += len(a)
        if self.size > FRONTIER:
            self.fold()

    def fold(self) -> np.ndarray:
        if self.held:
            a, b = (np.concatenate(x) for x in zip(*self.held))
            self.held, self.size = [], 0
            self.root = forest(len(self.root), a, b, self.root)
        return self.root


def forest(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """root[i] of each of n nodes under the links (a, b): the smallest index, by hooking and jumping."""
    root = np.arange(n) if root is None else root
    while len(a):
        ra, rb = root[a], root[b]
        live = ra != rb
        a, b, ra, rb = a[live], b[live], ra[live], rb[live]
        if not len(a):
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def _levels(radius: int) -> list[tuple[int, int]]:
    """(bits before, width) of each dealing: of all 64 bits, then of those that are left."""
    out, used = [], 0
    for _ in range(3):
        width = (64 - used) // (radius + 1)
        out.append((used, width))
        used += width
    return out


def _front(keys: np.ndarray, used: int, by: int) -> np.ndarray:
    """Keys with the bits after the first ``used`` rotated left by ``by``: a permutation, so distances stay."""
    rest = 64 - used
    if not by:
        return keys
    mask = U((1 << rest) - 1)
    low = keys & mask
    return (keys & ~mask) | (((low << U(by)) | (low >> U(rest - by))) & mask)


def _join_blocks(batches, radius: int):
    """A partition's (path, value, fp) rows -> links (u, v) of a spanning forest.

    ``path`` numbers the parts that were brought to the front, a digit of base radius + 2 each dealing
    (0: not dealt on); ``value`` is the key's bits there.
    """
    got = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
    if not got:
        return
    t = pa.concat_tables(got)
    path, value, fp = (t[c].to_numpy().astype(np.int64) for c in ("path", "value", "fp"))
    fp = fp.view(np.uint64)
    keys, depth = np.empty_like(fp), np.zeros(len(fp), np.int64)
    for p in np.unique(path).tolist():
        at = path == p
        x = fp[at]
        for used, width in _levels(radius):
            digit, p = p % (radius + 2), p // (radius + 2)
            if digit:
                x = _front(x, used, (digit - 1) * width)
                depth[at] = used + width
        keys[at] = x
    order = np.lexsort((keys, value, path))
    path, value, keys, fp, depth = path[order], value[order], keys[order], fp[order], depth[order]
    change = np.flatnonzero((path[1:] != path[:-1]) | (value[1:] != value[:-1])) + 1
    lo, hi = np.concatenate(([0], change)).astype(np.int64), np.append(change, len(fp)).astype(np.int64)
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    names, at = np.unique(fp, return_inverse=True)
    linked = Forest(len(names))
    trie_join(keys, lo, hi, depth[lo], radius, lambda x, y: linked.add(at[x], at[y]))
    root = linked.fold()
    child = np.flatnonzero(root != np.arange(len(names)))
    yield pa.RecordBatch.from_arrays([pa.array(names[child].view(np.int64)), pa.array(names[root[child]].view(np.int64))], ["u", "v"])


def links(fps: DataFrame, radius: int = 3, hot_block: int = HOT_BLOCK) -> DataFrame:
    """Distinct ``fp`` longs -> (u, v): links whose components equal those of all pairs within radius."""
    if not 0 <= radius <= 7:
        raise ValueError("radius must be 0 to 7")
    levels = _levels(radius)
    base = radius + 2
    dealt = fps.select("fp", F.lit(0).cast("long").alias("path"), F.lit(0).cast("long").alias("value"), F.col("fp").alias("key"), F.lit(True).alias("hot"))
    done = []
    for k, (used, width) in enumerate(levels):
        # the chosen part comes to the front of the bits that are left, and the value takes it up
        rest = 64 - used
        low = f"(key & {(1 << rest) - 1 if rest < 64 else -1}L)"
        turned = f"case when part = 0 then key else (key & ~({(1 << rest) - 1 if rest < 64 else -1}L)) | ((shiftleft({low}, part * {width}) | shiftrightunsigned({low}, {rest} - part * {width})) & {(1 << rest) - 1 if rest < 64 else -1}L) end"
        dealt = dealt.select("fp", "path", F.explode(F.sequence(F.lit(0), F.lit(radius))).alias("part"), "key").withColumn("key", F.expr(turned))
        dealt = dealt.select("fp", (F.col("path") + (F.col("part") + 1) * base ** k).cast("long").alias("path"), "key", F.expr(f"shiftrightunsigned(key, {64 - used - width})").alias("value"))
        if k == len(levels) - 1:
            break
        heavy = dealt.groupBy("path", "value").agg(F.count("*").alias("n")).filter(F.col("n") > hot_block).select("path", "value", F.lit(True).alias("hot"))
        heavy = written(heavy, "hot-blocks")
        if not heavy.head(1):
            break
        # at most rows / hot_block values are hot: with 8-byte keys, far less than one task's rows
        marked = dealt.join(heavy, ["path", "value"], "left")
        done.append(marked.filter("hot is null").select("path", "value", "fp"))
        dealt = marked.filter("hot").select("fp", "path", "key")
    for part in done:
        dealt = dealt.select("path", "value", "fp").union(part)
    return dealt.select("path", "value", "fp").repartition("path", "value").mapInArrow(released(lambda it: _join_blocks(it, radius)), "u long, v long")


def groups(docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs."""
    own = written(fingerprints(docs, width), "fp")
    # the name of a fingerprint: its smallest doc_id; keys are unsigned-ordered nowhere, only equal
    names = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(names.select("fp"), radius))
    named = names.join(roots, names.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    table = written(named.join(least, "root").select("fp", "component_id"), "fp-groups")
    return own.join(table, "fp").select("doc_id", "fp", "component_id")


def op6_simhash(spark, sf_dir):
    out = groups(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
