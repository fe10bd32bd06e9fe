"""Operator 4: suffix-array removal of repeated strings.

Every byte covered by a ``span``-byte string that also starts anywhere else (same document included)
goes.  Texts are UTF-8 bytes; matches never cross documents; strings are judged on the input.

How equal strings come to one place, without loss: each window of ``span`` bytes has an anchor, the
smallest hash among its ``GRAM``-byte strings (the leftmost of equals), so equal windows have equal
anchors at equal places.  The neighbouring windows of one anchor make a segment.  An anchor that occurs
once in the corpus rules its windows out.  An anchor whose segments are all equal settles them by
counting, before anything is gathered.  Only distinct segments of the other anchors are suffix-sorted.

Shards are ranges of (anchor, segment): in each, the suffix array is made by Larsson-Sadakane
refinement (each round sorts only groups not yet settled, by the rank one step on) and common
prefixes by Kasai's recurrence, in lockstep over the segments.  An anchor that runs over a
shard's border, as a very frequent one does, has its windows' keys sent on, in ranges, as sorted runs
that are merged by binary search.

Plan: one Arrow pass finds anchors -> counts by anchor (partial in each task) -> the repeated anchors'
rows -> one row a distinct segment -> its bytes, by a join on the row's 128-bit key -> shards ->
repeated ranges back to the rows by (anchor, segment) -> one row a document with its ranges, joined
to the text.  Texts cross a shuffle twice, compressed.

Defined results: a null text is the empty text; repeated rows are documents of their own (each then
repeats the other); null ids are kept; texts shorter than ``span`` lose nothing; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, released, written

SPAN = 200
GRAM = 64
#: Bytes of a shard: positions and ranks have 20 bits, so a sort key is one 64-bit number.
SHARD_BITS = 20
SHARD_BYTES = (1 << SHARD_BITS) - 8
#: Bytes that the anchor search handles at once; longer texts are cut, windows overlapping.
PIECE = 1 << 19
POS_BITS = 23
#: Bytes of text that a task holds between two batches that it returns.
HELD = 4 << 20
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * U(0x9E3779B97F4A7C15)
    x ^= x >> U(29)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(32)
    return x


def _grams(b: np.ndarray, size: int) -> np.ndarray:
    """A hash of each size-byte string, by doubling; size is a power of two."""
    h, w = _mix(b.astype(np.uint64) + U(1)), 1
    while w < size:
        h = _mix(h[:-w] * U(3) + (h[w:] ^ U(w)))
        w *= 2
    return h


def _anchors(texts: list[bytes], span: int) -> tuple[np.ndarray, ...]:
    """Segments of some texts: text number, first start, number of starts, anchor hash, segment hash."""
    sizes = np.array([len(t) for t in texts], np.int64)
    whole = b"".join(texts)
    b = np.frombuffer(whole, np.uint8)
    empty = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    if len(b) < span:
        return empty
    gram = min(GRAM, 1 << max(0, (span // 2).bit_length() - 1))
    h = _grams(b, gram)
    m = (h & ~U((1 << POS_BITS) - 1)) | np.arange(len(h), dtype=np.uint64)
    width, w = span - gram + 1, 1
    while w * 2 <= width:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    if width > w:
        m = np.minimum(m[:-(width - w)], m[width - w:])
    begins = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(texts)), sizes)[: len(m)]
    valid = np.arange(len(m)) + span <= (begins + sizes)[text]
    at = (m & U((1 << POS_BITS) - 1)).astype(np.int64)
    new = np.ones(len(m), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(m))
    ok = valid[first]
    first, last = first[ok], last[ok]
    sh = np.fromiter((xxhash.xxh3_64_intdigest(whole[i:j + span - 1]) for i, j in zip(first.tolist(), last.tolist())), np.uint64, len(first))
    return text[first], first - begins[text[first]], last - first, h[at[first]], sh


def anchors(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """docs (r1, r2, text) -> (r1, r2, fp, sh, a, m): a segment of m windows from byte a on."""

    def emit(keys, part, span):
        n, first, m, fp, sh = _anchors([p[2] for p in part], span)
        row = np.array([p[0] for p in part])[n] if len(part) else n
        base = np.array([p[1] for p in part])[n] if len(part) else n
        return pa.RecordBatch.from_arrays([keys[0].take(pa.array(row)), keys[1].take(pa.array(row)), pa.array(fp.view(np.int64)), pa.array(sh.view(np.int64)), pa.array(first + base), pa.array(m.astype(np.int32))], ["r1", "r2", "fp", "sh", "a", "m"])

    def run(batches):
        for b in batches:
            part, size = [], 0
            for i, t in enumerate(b.column(2).cast(pa.binary()).to_pylist()):
                t = t or b""
                for at in range(0, max(1, len(t) - span + 1), PIECE):
                    piece = t[at:at + PIECE + span - 1] if len(t) > PIECE else t
                    part.append((i, at, piece))
                    size += len(piece)
                    if size >= PIECE:
                        yield emit(b.columns, part, span)
                        part, size = [], 0
                    if len(t) <= PIECE:
                        break
            if part:
                yield emit(b.columns, part, span)

    return docs.select("r1", "r2", "text").mapInArrow(released(run), "r1 long, r2 long, fp long, sh long, a long, m int")


def suffix_array(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, ranks) of up to 2^20 - 8 bytes, by Larsson-Sadakane refinement."""
    n = len(b)
    if n > (1 << SHARD_BITS) - 8:
        raise ValueError("a shard has at most 2^20 - 8 bytes")
    low = U((1 << SHARD_BITS) - 1)
    # the first 5 bytes; text beyond the end counts as zeros
    padded = np.concatenate((b, np.zeros(5, np.uint8))).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(5):
        key = (key << U(8)) | padded[k:k + n]
    key = np.sort((key << U(SHARD_BITS)) | np.arange(n, dtype=np.uint64))
    sa = (key & low).astype(np.int64)
    head = np.ones(n, bool)
    head[1:] = (key[1:] >> U(SHARD_BITS)) != (key[:-1] >> U(SHARD_BITS))
    rank = np.zeros(n, np.int64)  # a rank is the place of its group's head
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    places = np.flatnonzero(~(head & np.append(head[1:], True)))
    step = 5
    while len(places):
        i = sa[places]
        ahead = i + step
        # a suffix that ended is before the others of its group, the shorter (the larger i) first
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = np.sort((rank[i].astype(np.uint64) << U(2 * SHARD_BITS)) | (second.astype(np.uint64) << U(SHARD_BITS)) | (n - 1 - i).astype(np.uint64))
        i = n - 1 - (key & low).astype(np.int64)
        head = np.ones(len(i), bool)
        head[1:] = ((key[1:] >> U(SHARD_BITS)) != (key[:-1] >> U(SHARD_BITS))) | (((key[1:] >> U(SHARD_BITS)) & low) == 0)
        sa[places] = i
        rank[i] = places[np.maximum.accumulate(np.where(head, np.arange(len(i)), 0))]
        places = places[~(head & np.append(head[1:], True))]
        step *= 2
    return sa, rank


def common_prefixes(b: np.ndarray, sa: np.ndarray, rank: np.ndarray, begins: np.ndarray, sizes: np.ndarray, cap: int) -> np.ndarray:
    """Kasai: for each position, the prefix (up to cap) shared with the suffix before it in order.

    The recurrence runs through all segments at once, a position a step, comparing 8 bytes at a time.
    """
    n = len(b)
    padded = np.concatenate((b, np.zeros(cap + 16, np.uint8)))
    word = np.zeros(n + cap + 8, np.uint64)
    for k in range(8):  # the first byte lowest
        word |= padded[k:k + len(word)].astype(np.uint64) << U(8 * k)
    before = np.where(rank > 0, sa[rank - 1], -1)
    out = np.zeros(n, np.int32)
    order = np.argsort(-sizes, kind="stable")
    begins, sizes = begins[order], sizes[order]
    h = np.zeros(len(begins), np.int64)
    for t in range(int(sizes[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -t, "left"))
        i = begins[:live] + t
        j = before[i]
        h = np.maximum(h[:live] - 1, 0)
        h[j < 0] = 0
        go = np.flatnonzero(j >= 0)
        while len(go):
            x = word[i[go] + h[go]] ^ word[j[go] + h[go]]
            # the bits below the lowest differing one tell how many bytes agree; all 64 where none differs
            h[go] += np.bitwise_count((x & -x) - U(1)) >> 3
            go = go[(x == 0) & (h[go] < cap)]
        # text beyond the end equals nothing
        np.minimum(h, np.minimum(cap, n - np.maximum(i, j)), out=h)
        out[i] = h
    return out


def repeated_starts(segments: list[bytes], span: int = SPAN) -> list[np.ndarray]:
    """For each segment, which of its windows (len - span + 1) also start elsewhere in these segments."""
    b = np.frombuffer(b"".join(segments), np.uint8)
    sizes = np.array([len(s) for s in segments], np.int64)
    begins = np.cumsum(sizes) - sizes
    sa, rank = suffix_array(b)
    starts = np.concatenate([np.arange(x, x + n - span + 1) for x, n in zip(begins, sizes)])
    lcp = common_prefixes(b, sa, rank, begins, sizes, span)
    # a suffix that is no start has fewer than ``span`` bytes of its segment, and matches by chance
    # across the border: between two starts, the least prefix on the way counts
    is_start = np.zeros(len(b), bool)
    is_start[starts] = True
    place = np.flatnonzero(is_start[sa])
    along = lcp[sa] >= span
    breaks = np.cumsum(~along)
    same = breaks[place[1:]] == breaks[place[:-1]]
    hit = np.zeros(len(b), bool)
    hit[sa[place[1:][same]]] = True
    hit[sa[place[:-1][same]]] = True
    return [hit[x:x + n - span + 1] for x, n in zip(begins.tolist(), sizes.tolist())]


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


#: Window keys of one anchor that a merge takes at once, about (20 bytes each); more frequent anchors
#: are cut by key range, which also cuts their ranges of windows, so no finer than memory asks.
MERGE_KEYS = 1 << 19


def _part_bits(n: int, windows: int) -> int:
    """Bits of the key range that an anchor with n rows in the corpus is cut by: alike in all shards."""
    return min(30, max(0, (n * windows // MERGE_KEYS).bit_length()))


SHARDED = "kind int, fp long, sh long, s int, e int, run long, part int, keys array<long>, shs array<long>, starts array<int>"


def shard(segments: DataFrame, span: int = SPAN, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Sorted (fp, sh, c, n, seg) -> rows of kind 0: ranges (s, e) of repeated windows of (fp, sh);
    of kind 1: a sorted run of the window keys of an anchor that may go on in another shard."""
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
    names = [x.split()[0] for x in SHARDED.split(", ")]

    def edge_runs(chunk, fp, run):
        own = [x for x in chunk if x[0] == fp]
        keys = np.array([xxhash.xxh3_64_intdigest(seg[k:k + span]) for *_, seg in own for k in range(len(seg) - span + 1)], np.uint64)
        windows = np.array([len(x[4]) - span + 1 for x in own])
        shs = np.repeat(np.array([x[1] for x in own], np.int64), windows)
        starts = np.arange(len(keys)) - np.repeat(np.cumsum(windows) - windows, windows)
        order = np.argsort(keys, kind="stable")
        keys, shs, starts = keys[order], shs[order], starts[order].astype(np.int32)
        bits = _part_bits(own[0][3], max(1, span - GRAM + 1))
        part = (keys >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
        cuts = np.flatnonzero(np.diff(part)) + 1
        for k, h, t, at in zip(np.split(keys.view(np.int64), cuts), np.split(shs, cuts), np.split(starts, cuts), np.concatenate((part[:1], part[cuts]))):
            yield 1, fp, 0, 0, 0, run, int(at), k, h, t

    def solve(chunk, run):
        out = [(0, fp, sh, s, e, 0, 0, [], [], []) for (fp, sh, c, _, seg), hit in zip(chunk, repeated_starts([x[4] for x in chunk], span)) for s, e in ([(0, len(seg) - span + 1)] if c > 1 else _runs(hit))]
        # the first and the last anchor of a shard may have segments in its neighbours
        for fp in {chunk[0][0], chunk[-1][0]}:
            out += edge_runs(chunk, fp, run)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(kinds), kinds)], names)

    def run(batches):
        number, chunk, size, last = TaskContext.get().partitionId() << 32, [], 0, None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[:2] == last:
                    continue  # the same segment by two rows of one key
                last = row[:2]
                if size + len(row[4]) > shard_bytes:
                    yield solve(chunk, number)
                    number, chunk, size = number + 1, [], 0
                chunk.append(row)
                size += len(row[4])
        if chunk:
            yield solve(chunk, number)

    return segments.mapInArrow(released(run), SHARDED)


def _merge(batches):
    """Runs of window keys, sorted by (fp, part) -> ranges of the windows whose key others have too."""
    last, own = None, []
    for b in batches:
        fps, parts = b.column(0).to_pylist(), b.column(1).to_pylist()
        for k, name in enumerate(zip(fps, parts)):
            if name != last:
                if own:
                    yield _merge_group(last[0], own)
                last, own = name, []
            own.append(tuple(np.array(b.column(c)[k].values) for c in (2, 3, 4)))
    if own:
        yield _merge_group(last[0], own)


def _merge_group(fp: int, own: list[tuple]) -> pa.RecordBatch:
    runs = [x[0].view(np.uint64) for x in own]
    # sorted runs are merged two by two, each finding its places in the other by binary search
    while len(runs) > 1:
        runs = [_merged(*runs[k:k + 2]) for k in range(0, len(runs), 2)]
    keys, shs, starts = (np.concatenate(x) for x in zip(*own))
    keys = keys.view(np.uint64)
    more = np.searchsorted(runs[0], keys, "right") - np.searchsorted(runs[0], keys, "left") > 1
    shs, starts = shs[more], starts[more]
    order = np.lexsort((starts, shs))
    shs, starts = shs[order], starts[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(shs)), bool), (shs[1:] != shs[:-1]) | (starts[1:] != starts[:-1] + 1))))
    last = np.append(first[1:], len(shs)) - 1 if len(first) else first
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([fp] * len(first), shs[first], starts[first], starts[last] + 1), kinds)], ["fp", "sh", "s", "e"])


def _merged(a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    if b is None:
        return a
    out = np.empty(len(a) + len(b), a.dtype)
    out[np.arange(len(a)) + np.searchsorted(b, a, "left")] = a
    out[np.arange(len(b)) + np.searchsorted(a, b, "right")] = b
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with a 128-bit key of both, (r1, r2); rows alike in both share it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64("text", F.lit("r2"), "doc_id", F.length("text")).alias("r2"))


def _packed(rows: DataFrame) -> DataFrame:
    """Texts compressed for the way through a shuffle."""

    def run(batches):
        z = zstandard.ZstdCompressor(1)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([z.compress(t) for t in b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()], pa.binary())], [*b.schema.names[:-1], "z"])

    return rows.select("doc_id", "r1", "r2", "text").mapInArrow(released(run), "doc_id long, r1 long, r2 long, z binary")


def repeated_ranges(docs: DataFrame, span: int = SPAN, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """keyed docs -> (r1, r2, spans array<struct<s, e>>): window starts [s, e) that also start elsewhere."""
    found = written(anchors(docs, span), "anchors")
    seen = found.groupBy("fp").agg(F.count("*").alias("n"), F.min("sh").alias("lo"), F.max("sh").alias("hi")).filter("n > 1")
    seen = written(seen.select("fp", "n", (F.col("lo") != F.col("hi")).alias("mixed")), "repeated-anchors")
    rows = written(found.join(seen, "fp"), "repeated-rows")
    mixed = rows.filter("mixed")
    # one row a distinct segment, and where to read it
    distinct = mixed.groupBy("fp", "sh").agg(F.count("*").alias("c"), F.max("n").alias("n"), F.min(F.struct("r1", "r2", "a", "m")).alias("at"))
    wanted = distinct.select("at.r1", "at.r2", F.struct("fp", "sh", "c", "n", "at.a", "at.m").alias("x")).groupBy("r1", "r2").agg(F.collect_list("x").alias("xs"))
    wanted = written(wanted, "wanted")

    def cut(batches):
        z = zstandard.ZstdDecompressor()
        kinds, names = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()], ["fp", "sh", "c", "n", "seg"]
        for b in batches:
            out, size = [], 0
            for packed, xs in zip(b.column(0), b.column(1)):
                t = z.decompress(packed.as_py())
                for x in xs.as_py():
                    out.append((x["fp"], x["sh"], x["c"], x["n"], t[x["a"]:x["a"] + x["m"] + span - 1]))
                    size += len(out[-1][4])
                    if size >= HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    segments = written(_packed(docs).join(wanted, ["r1", "r2"]).select("z", "xs").mapInArrow(released(cut), "fp long, sh long, c long, n long, seg binary"), "segments")
    sharded = written(shard(segments.repartitionByRange("fp", "sh").sortWithinPartitions("fp", "sh"), span, shard_bytes), "sharded")
    crossing = sharded.filter("kind = 1").select("fp", "part", "keys", "shs", "starts").repartition("fp", "part").sortWithinPartitions("fp", "part").mapInArrow(released(_merge), "fp long, sh long, s int, e int")
    # a row a segment (its at most span windows bound the set), so a segment's rows do not multiply below
    both = sharded.filter("kind = 0").select("fp", "sh", "s", "e").union(crossing)
    ranges = written(both.groupBy("fp", "sh").agg(F.collect_set(F.struct("s", "e")).alias("xs")), "ranges")
    own = rows.filter("not mixed").select("r1", "r2", F.array(F.struct(F.col("a").alias("s"), (F.col("a") + F.col("m")).alias("e"))).alias("xs"))
    shifted = F.transform("xs", lambda x: F.struct((F.col("a") + x["s"]).alias("s"), (F.col("a") + x["e"]).alias("e")))
    other = mixed.select("r1", "r2", "fp", "sh", "a").join(ranges, ["fp", "sh"]).select("r1", "r2", shifted.alias("xs"))
    # a set: the rows alike in id and text that share a key bring the same ranges, which count once
    return own.union(other).groupBy("r1", "r2").agg(F.flatten(F.collect_set("xs")).alias("spans"))


def removed(n: int, spans: list, span: int) -> list[tuple[int, int]]:
    """Maximal byte runs [s, e) covered by the windows."""
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans):
        e = min(e + span - 1, n)
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _cut(b: pa.RecordBatch, span: int):
    """(rows, [(length, removed runs, what is left)]) of a batch whose last columns are the packed text
    and its spans, a bounded number of bytes at a time."""
    z = zstandard.ZstdDecompressor()
    first, got, size = 0, [], 0
    for k, (p, xs) in enumerate(zip(b.column(b.num_columns - 2), b.column(b.num_columns - 1)), 1):
        t = z.decompress(p.as_py())
        gone = removed(len(t), xs.as_py() or [], span)
        edges = [0, *(x for run in gone for x in run), len(t)]
        got.append((len(t), gone, b"".join(t[s:e] for s, e in zip(edges[::2], edges[1::2]))))
        size += len(t)
        if size >= HELD or k == b.num_rows:
            yield b.slice(first, k - first), got
            first, got, size = k, [], 0


def dedup(docs: DataFrame, span: int = SPAN, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_bytes, removed array<struct<s, e>>, kept binary) of every row of docs."""
    rows = keyed(docs)
    spans = written(repeated_ranges(rows, span, shard_bytes), "spans")

    def run(batches):
        kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
        for b in batches:
            for part, got in _cut(b, span):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([[{"s": s, "e": e} for s, e in g[1]] for g in got], kind), pa.array([g[2] for g in got], pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])

    joined = _packed(rows).join(spans, ["r1", "r2"], "left").select("doc_id", "z", "spans")
    return joined.mapInArrow(released(run), "doc_id long, n_bytes long, removed array<struct<s:long,e:long>>, kept binary")


def cut_documents(docs: DataFrame, columns: list[str], span: int = SPAN) -> DataFrame:
    """docs, with the repeated strings cut out of ``text`` and ``n_chars`` counted anew.

    A character of which a cut leaves a part is dropped whole.  Documents that had more than blanks
    and have no more go.
    """
    rows = keyed(docs)
    spans = written(repeated_ranges(rows, span), "spans")
    others = [c for c in columns if c not in ("doc_id", "text", "n_chars")]
    full = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *others)
    full = full.select("doc_id", *others, *[F.xxhash64(*c).alias(n) for n, c in (("r1", ["doc_id", "text"]), ("r2", ["text", F.lit("r2"), "doc_id", F.length("text")]))], "text")

    def pack(batches):
        z = zstandard.ZstdCompressor(1)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([z.compress(t) for t in b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()], pa.binary())], [*b.schema.names[:-1], "z"])

    def run(batches):
        for b in batches:
            for part, got in _cut(b, span):
                text = [g[2].decode("utf-8", "ignore") for g in got]
                keep = pa.array([bool(t.strip()) or not g[1] for t, g in zip(text, got)])
                out = pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], [*b.schema.names[:-2], "text", "n_chars"])
                yield out.filter(keep)

    rest = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in full.drop("r1", "r2", "text").schema)
    packed = full.mapInArrow(released(pack), f"{rest}r1 long, r2 long, z binary")
    joined = packed.join(spans, ["r1", "r2"], "left").select("doc_id", *others, "z", "spans")
    return joined.mapInArrow(released(run), f"{rest}text string, n_chars long").select(*columns)


def op4_suffix(spark, sf_dir):
    out = dedup(documents(spark, sf_dir))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
