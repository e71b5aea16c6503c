"""Jaccard join of word-shingle sets by a size-aware heavy-light scheme, exact for every pair, and its connected components.

Documents with equal sets form a class; classes are joined. Two sets a <= b link when 100 |a & b| >= percent |a | b|, so they
share at least need(a, b) shingles.

* Small sets (at most `boundary` shingles) enumerate their subsets of each size need(a, b) that a small partner can ask for: a
  pair links exactly if it shares such a subset.
* Large sets, and small ones that may have a large partner, go into inverted lists. All sets are put in one order of shingles,
  rare ones first; two sets that link, if that takes two common shingles, have two among their first
  n - ceil(n percent / 100) + 2 ones. So such a pair is a candidate only if it meets in two lists; chance meetings in one, whose
  number grows faster than the corpus, are not. All documents count their shingles in `COUNTERS` counters, which shingles share by their
  first bits; those of the highest counters stand last in the order, so common passages seldom reach a list. Any order finds all links.
* The boundary is the size at which enumerating subsets is estimated to cost less than scanning lists.

Short lists give all their pairs, with the number of lists they met in; a pair that met in one alone stays only if both its sets are
in one long list, too. Members of a long list are first checked against pivots of it, which links groups of near
copies by as many pairs as they have members; then only pairs of different components are left. Their sketches are compared in blocks;
a block passes on not the pairs that are still possible but clusters of their members. The members of a cluster, over all lists, meet in
blocks again with their whole sets; there, all possible pairs are counted, and the links that unite components are written. So
what leaves a block grows with its members and not with their pairs.
Sets are 64-bit hashes of shingles; a check counts common hashes of whole sets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, with_share
from tidemark.llm.minhash import pieces_of, stars
from tidemark.llm.words import mix, shingles, word_hashes
from tidemark.sources.stage import release, stage

OFTEN, PER = 16, 20_000  # a shingle is of wide use if so many documents of each so many have it
COUNTERS, PARTS = 1 << 21, 512  # counters of the uses of shingles, and the parts that they travel in
SMALL = 10  # sizes up to which enumeration is considered
SHORT = 8  # members of a list that gives all its pairs
STARS = 4  # pivots that a member of long lists is checked against in each of two rounds
BITS = 1 << 26  # bits of the bitmap of wanted ids, 8 MB
WIDTH = 512  # buckets of a sketch that the comparison of blocks uses at most
BLOCK = 1024  # members of a long list, about, that are compared with as many others in one piece of work


def need(a: int, b: int, percent: int) -> int:
    """Common shingles that sets of these sizes must have to link."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: np.ndarray | int, percent: int):
    """Places at the start of a set among which it has two shingles of every other set that it links with."""
    return np.minimum(n, n - (n * percent + 99) // 100 + 2)


def subset_sizes(n: int, boundary: int, percent: int) -> list[int]:
    """Sizes of the subsets that a small set enumerates."""
    return sorted({need(n, m, percent) for m in range(1, boundary + 1) if 100 * min(n, m) >= percent * max(n, m)})


def enumeration_cost(n: int, boundary: int, percent: int) -> int:
    return sum(comb(n, k) for k in subset_sizes(n, boundary, percent))


def choose_boundary(sizes: dict[int, int], list_length: float, percent: int) -> int:
    """The boundary of least estimated cost: subsets to enumerate below it, list entries to scan above it."""
    def cost(boundary: int) -> float:
        total = 0.0
        for n, count in sizes.items():
            if n <= boundary:
                total += count * enumeration_cost(n, boundary, percent)
            if n > boundary or 100 * (boundary + 1) * percent <= 10000 * n:
                total += count * prefix_length(n, percent) * (1 + list_length)
        return total

    return min(range(SMALL + 1), key=lambda b: (cost(b), b))


def class_id(s: np.ndarray) -> int:
    """A number of a set that does not depend on anything else."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        parts = np.array([mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(s + np.uint64(len(s)))), np.uint64(len(s))], np.uint64)
        value = np.uint64(0)
        for p in parts:
            value = mix(np.array([value * np.uint64(0x9E3779B97F4A7C15) + p]))[0]
    return int(value.astype(np.int64))


def sets_of(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    for words in word_hashes(texts):
        s = shingles(words)
        yield class_id(s), s


def batch_of(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def sketch(s: np.ndarray) -> bytes:
    """How many shingles fall in each of 2**k buckets by their low bits, with about two in each; counts stop at 255."""
    if not len(s):
        return b""
    width = 1 << max(0, (len(s) // 2).bit_length() - 1)
    return np.minimum(np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width), 255).astype(np.uint8).tobytes()


def most_common(x: bytes, y: bytes) -> int:
    """An upper bound of the common shingles of two sets: bucket by bucket, the smaller count. A count of 255 stands for any number."""
    a, b = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    a, b = np.where(a == 255, 1 << 40, a), np.where(b == 255, 1 << 40, b)
    while len(a) > len(b):
        a = a[: len(a) // 2] + a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] + b[len(b) // 2 :]
    return int(np.minimum(a, b).sum())


def counter(s: np.ndarray) -> np.ndarray:
    """The counters of shingles. Those of a sorted set are in order."""
    return s >> np.uint64(65 - COUNTERS.bit_length())


def documents(docs: DataFrame) -> DataFrame:
    """`doc_id, n, cid, sketch` of every row; a task writes the sketch of a class once, and null after that.

    Beside these, a task writes its counters with their `part`, which is null in the others: how many of its classes have the shingles of
    each, 4 bytes a counter, the lowest bytes of all first, compressed.
    """
    names = ["doc_id", "n", "cid", "sketch", "part", "uses"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        uses = np.zeros(COUNTERS, np.uint32)
        for b in batches:
            ids, sizes, sketches = [], [], []
            for c, s in sets_of(b.column(1).to_pylist()):
                new = len(s) > 0 and c not in seen
                ids.append(c)
                sizes.append(len(s))
                sketches.append(sketch(s) if new else None)
                if new:
                    np.add.at(uses, counter(s).astype(np.int64), np.uint32(1))
                seen.add(c)
            none = [pa.nulls(len(ids), t) for t in (pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(sketches, pa.binary()), *none], names=names)
        own = uses.reshape(PARTS, -1)
        used = np.flatnonzero(own.any(axis=1))
        for some in (used[k : k + 32] for k in range(0, len(used), 32)):
            packed = [zlib.compress(own[k].view(np.uint8).reshape(-1, 4).T.tobytes(), 1) for k in some]
            none = [pa.nulls(len(some), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(some, pa.int32()), pa.array(packed, pa.binary())], names=names)

    return map_batches(docs, run, "doc_id long, n long, cid long, sketch binary, part int, uses binary")


def wide_shingles(docs: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray, dict[int, int], float]:
    """From `documents` of all `rows`: counters of shingles of wide use with their counts, sizes of small sets, mean list of the others.

    A count is of all documents, copies that one task read taken as one, and of all shingles that share the counter. One of wide use is
    four times the mean at least, so there are `COUNTERS` / 4 of them at most, whatever the documents. The mean list is that in which
    an entry stands: the variance of the other counters by their mean, which does not depend on how many shingles share a counter.
    """
    total = docs.where("sketch IS NOT NULL").agg(F.sum("n").alias("n")).first()["n"] or 0
    floor = max(OFTEN * max(1.0, rows / PER), 4 * total / COUNTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                now = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T.copy().view(np.uint32)[:, 0]
                sums[part] = sums.get(part, 0) + now.astype(np.int64)
        for part, uses in sums.items():
            wide = np.flatnonzero(uses >= floor)
            others = uses[uses < floor].astype(float)
            yield batch_of([[(wide + part * len(uses)).tobytes()], [uses[wide].tobytes()], [len(others)], [others.sum()], [(others**2).sum()]], ["at", "uses", "others", "sum", "squares"])

    parts = map_batches(docs.where("part IS NOT NULL").select("part", "uses").repartition("part"), run, "at binary, uses binary, others long, sum double, squares double").collect()
    others, entries, squares = (sum(r[k] for r in parts) for k in ("others", "sum", "squares"))
    narrow = squares / entries - entries / others if entries else 1.0
    small = docs.where(F.col("n").between(1, SMALL)).select("n", "cid").distinct()
    sizes = {r["n"]: r["count"] for r in small.groupBy("n").count().collect()}
    counters, uses = (np.frombuffer(b"".join(r[k] for r in parts), np.int64) for k in ("at", "uses"))
    order = np.argsort(counters)
    return counters[order].view(np.uint64), uses[order], sizes, float(narrow)


def postings(docs: DataFrame, wide: np.ndarray, uses: np.ndarray, boundary: int, percent: int) -> DataFrame:
    """`token, cid, at, wide`: entries of subset keys and inverted lists; `wide` marks those of widely used shingles.

    `at` holds size and place in the order: n << 32 | place, or place -1 (all ones) for a subset key. A task writes a class once.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((wide, uses))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, counts = shared.value
        seen: set[int] = set()
        out: list[tuple[np.ndarray, ...]] = []
        size = 0
        for b in batches:
            for c, s in sets_of(b.column(1).to_pylist()):
                n = len(s)
                if not n or c in seen:
                    continue
                seen.add(c)
                if n <= boundary:
                    keys = []
                    for k in subset_sizes(n, boundary, percent):
                        for chosen in combinations(range(n), k):
                            part = s[list(chosen)]
                            keys.append(mix(np.array([mix(part).sum(dtype=np.uint64) + np.uint64(k << 8)], np.uint64))[0])
                    own = np.array(keys, np.uint64)
                    out.append((own, np.full(len(own), c, np.int64), np.full(len(own), (n << 32) | 0xFFFFFFFF, np.int64), np.zeros(len(own), bool)))
                    size += len(own)
                if n > boundary or 100 * n >= percent * (boundary + 1):
                    length = int(prefix_length(n, percent))
                    if len(high):
                        own = counter(s)
                        at = np.minimum(np.searchsorted(high, own), len(high) - 1)
                        rank = np.where(high[at] == own, counts[at], 0)
                        order = np.lexsort((s, rank))[:length]
                        first, common = s[order], rank[order] > 0
                    else:
                        first, common = s[:length], np.zeros(length, bool)
                    out.append((first, np.full(len(first), c, np.int64), (n << 32) | np.arange(len(first), dtype=np.int64), common))
                    size += len(first)
                if size > 200_000:
                    yield batch_of([np.concatenate([x[0] for x in out]).view(np.int64), *(np.concatenate([x[i] for x in out]) for i in (1, 2, 3))], ["token", "cid", "at", "wide"])
                    out, size = [], 0
        if size:
            yield batch_of([np.concatenate([x[0] for x in out]).view(np.int64), *(np.concatenate([x[i] for x in out]) for i in (1, 2, 3))], ["token", "cid", "at", "wide"])

    return map_batches(docs, run, "token long, cid long, at long, wide boolean")


def passes(at_a: np.ndarray, at_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes, and places where this is the first or second common shingle, let two sets link."""
    na, nb = at_a >> 32, at_b >> 32
    pa_, pb = at_a & 0xFFFFFFFF, at_b & 0xFFFFFFFF
    asked = -(-percent * (na + nb) // (100 + percent))
    sized = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
    subset = (pa_ == 0xFFFFFFFF) | (pb == 0xFFFFFFFF)
    return sized & (subset | (np.minimum(na - pa_, nb - pb) >= asked - 1))


def list_runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[np.ndarray]]:
    """Columns of sorted rows in packs that never cut a list (equal values of the first column) in two."""
    held: list[np.ndarray] | None = None
    for b in batches:
        now = [b.column(i).to_numpy(zero_copy_only=False) for i in range(width)]
        if held is not None:
            now = [np.concatenate([h, x]) for h, x in zip(held, now, strict=True)]
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1], "left"))
        if cut:
            yield [x[:cut] for x in now]
        held = [x[cut:] for x in now]
    if held is not None and len(held[0]):
        yield held


def scan_lists(entries: DataFrame, percent: int) -> DataFrame:
    """`long, token, a, b`: pairs of short lists (long = 0, token: in how many of these, 2 for a subset key), entries of long lists
    (long = 1: a is the class, b its `at`).

    Entries of widely used shingles count as long without being brought together: a part of the class number spreads them.
    """
    names = ["long", "token", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, cid, at, wide in list_runs(batches, 4):
            if wide.any():
                yield batch_of([np.ones(wide.sum(), np.int64), token[wide], cid[wide], at[wide]], names)
                token, cid, at = token[~wide], cid[~wide], at[~wide]
                if not len(token):
                    continue
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (cid[1:] != cid[:-1]) | (at[1:] != at[:-1])
            token, cid, at = token[new], cid[new], at[new]
            starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            length = np.diff(np.append(starts, len(token)))
            own = np.repeat(length, length)
            left = own > SHORT
            if left.any():
                yield batch_of([np.ones(left.sum(), np.int64), token[left], cid[left], at[left]], names)
            some = (own > 1) & ~left
            token, cid, at = token[some], cid[some], at[some]
            found = []
            for d in range(1, SHORT):
                i = np.flatnonzero(token[d:] == token[:-d])
                if not len(i):
                    break
                i = i[passes(at[i], at[i + d], percent) & (cid[i] != cid[i + d])]
                subset = ((at[i] & 0xFFFFFFFF) == 0xFFFFFFFF) | ((at[i + d] & 0xFFFFFFFF) == 0xFFFFFFFF)
                alone = -(-percent * ((at[i] >> 32) + (at[i + d] >> 32)) // (100 + percent)) < 2  # one common shingle can do
                found.append(np.stack([np.minimum(cid[i], cid[i + d]), np.maximum(cid[i], cid[i + d]), 1 + (subset | alone)]))
            if found:
                a, b, times = np.concatenate(found, axis=1)
                order = np.lexsort((b, a))
                a, b, times = a[order], b[order], times[order]
                first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
                if len(first):
                    yield batch_of([np.zeros(len(first), np.int64), np.add.reduceat(times, first), a[first], b[first]], names)

    part = F.when(F.col("wide"), F.pmod(F.xxhash64("cid"), F.lit(64))).otherwise(0)
    placed = entries.withColumn("part", part).repartition("token", "part").drop("part").sortWithinPartitions("token", "at", "cid")
    return map_batches(placed, run, "long long, token long, a long, b long")


def folded(sketches: list[bytes], most: int) -> list[np.ndarray]:
    """Sketches folded to `most` buckets at most. A count of 255 stands for any number and becomes a large one."""
    rows = []
    for x in sketches:
        a = np.frombuffer(x, np.uint8).astype(np.uint16)
        a[a == 255] = 0x4000
        rows.append(narrowed(a, most))
    return rows


def narrowed(m: np.ndarray, width: int) -> np.ndarray:
    """Folded sketches, one a row or a single one, folded further."""
    while m.shape[-1] > width:
        half = m.shape[-1] // 2
        m = np.minimum(m[..., :half] + m[..., half:], 0x4000)
    return m


class Bounds:
    """Upper bounds of what the sets of one piece of work have in common, from their folded sketches."""

    def __init__(self, sketches: list[bytes], most: int) -> None:
        self.folds = folded(sketches, most)
        self.widths = np.array([len(f) for f in self.folds])
        self.place = np.empty(len(self.folds), np.int64)
        self.groups: dict[tuple[int, int], np.ndarray] = {}
        for w in np.unique(self.widths).tolist():
            at = np.flatnonzero(self.widths == w)
            self.place[at] = np.arange(len(at))
            self.groups[w, w] = np.stack([self.folds[k] for k in at])

    def room(self, x: int, others: np.ndarray) -> np.ndarray:
        out = np.empty(len(others), np.int64)
        own = int(self.widths[x])
        for w in np.unique(self.widths[others]).tolist():
            width = min(w, own)
            if (w, width) not in self.groups:
                self.groups[w, width] = narrowed(self.groups[w, w], width)
            some = self.widths[others] == w
            out[some] = np.minimum(narrowed(self.folds[x], width), self.groups[w, width][self.place[others[some]]]).sum(axis=1, dtype=np.int64)
        return out


def block_rows(entries: DataFrame) -> DataFrame:
    """`token, i, j, side, cid, at, comp`: the members of long lists in pairs of blocks, each pair a key of its own.

    A list is parted in the members of its largest component and the rest, and each part in blocks of about `BLOCK` members by a hash
    of the class. A pair of different components has a member in the rest, so the blocks i of the rest meet one another (i <= j) and
    the blocks of the largest component (j < 0). `side` is 1 for members of block j where that is not i. Lists of one component go.
    """
    kinds = entries.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("uses"))
    lists = kinds.groupBy("token").agg(F.max_by("comp", F.struct("uses", "comp")).alias("top"), F.sum("uses").alias("n"), F.max("uses").alias("most"))
    blocks = [F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int").alias("rests"), F.ceil(F.col("most") / BLOCK).cast("int").alias("tops")]
    met = with_share(entries, lists.where("n > most").select("token", "top", "n", *blocks), ["token"], "n", entries.count()).where("top IS NOT NULL")
    rest = F.col("comp") != F.col("top")
    met = met.withColumn("own", F.pmod(F.xxhash64("cid"), F.when(rest, F.col("rests")).otherwise(F.col("tops")).cast("long")).cast("int"))

    def key(i: Column, j: Column, side: Column) -> Column:
        return F.struct(i.alias("i"), j.alias("j"), side.cast("int").alias("side"))

    own, rests, tops = F.col("own"), F.sequence(F.lit(0), F.col("rests") - 1), F.sequence(F.lit(0), F.col("tops") - 1)
    among = F.transform(rests, lambda x: key(F.least(own, x), F.greatest(own, x), x < own))
    keys = F.when(rest, F.concat(among, F.transform(tops, lambda x: key(own, -1 - x, F.lit(0))))).otherwise(F.transform(rests, lambda x: key(x, -1 - own, F.lit(1))))
    return met.select("token", "cid", "at", "comp", F.explode(keys).alias("key")).select("token", "key.*", "cid", "at", "comp")


def cross_pairs(entries: DataFrame, sketches: DataFrame, percent: int, forest: bool = False) -> DataFrame:
    """`a, b`: pairs of a list whose components differ and whose sketches leave room for a link. `entries` has `token, cid, at, comp`.

    A task holds two blocks of a list at a time, and writes no pair that the bound rules out. With `forest` it does not write these pairs
    but fewer that connect the same classes: every class of a pair with the one its cluster in this piece of work is named by.
    """
    def compare(rows: list[np.ndarray], sketch: list[bytes]) -> Iterator[pa.RecordBatch]:
        _, _, i, j, side, cid, at, comp = rows
        bounds, found = Bounds(sketch, WIDTH), []
        alone, left = i[0] == j[0], int((side == 0).sum())
        name, some = np.arange(len(cid)), np.zeros(len(cid), bool)
        for x in range(left):
            others = np.arange(x + 1 if alone else left, len(cid))
            others = others[passes(at[x], at[others], percent) & (comp[others] != comp[x])]
            if forest and some[x]:
                others = others[~some[others] | (name[others] != name[x])]
            if len(others):
                asked = -(-percent * ((at[x] >> 32) + (at[others] >> 32)) // (100 + percent))
                others = others[bounds.room(x, others) >= asked]
            if not len(others):
                continue
            if forest:
                some[x] = some[others] = True
                both = np.append(name[others], name[x])
                name[np.isin(name, both)] = both.min()
            else:
                found.append(np.stack([np.minimum(cid[x], cid[others]), np.maximum(cid[x], cid[others])]))
        if forest:
            other = np.flatnonzero(name != np.arange(len(cid)))
            found = [np.stack([np.minimum(cid[other], cid[name[other]]), np.maximum(cid[other], cid[name[other]])])] if len(other) else []
        if found:
            pairs = np.concatenate(found, axis=1)
            yield batch_of([pairs[0], pairs[1]], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, (sketch,) in pieces_of(batches, 8, 4):
            yield from compare(rows, sketch)

    return map_batches(in_blocks(entries, sketches.select("cid", "sketch")), run, "a long, b long").distinct()


def in_blocks(entries: DataFrame, values: DataFrame) -> DataFrame:
    """`block_rows` with the value of each class (`cid` and one column), each pair of blocks in one task and in one piece."""
    met = block_rows(entries).join(values, "cid")
    placed = met.select(F.xxhash64("token", "i", "j").alias("hashed"), "token", "i", "j", "side", "cid", "at", "comp", values.columns[1]).repartition("hashed")
    return placed.sortWithinPartitions("hashed", "token", "i", "j", "side", "at", "cid")


def block_links(clusters: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """`a, b`: links inside clusters, as many as unite all components that link within two blocks. `clusters` has `token, cid, comp`.

    All pairs of different components are counted on whole sets, but for those that sizes or sketches rule out and those that are united by then.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, i, j, side, cid, _, comp), (packed,) in pieces_of(batches, 8, 4):
            own = [np.frombuffer(x, np.uint64) for x in packed]
            n = np.array([len(x) for x in own])
            bounds, found = Bounds([sketch(x) for x in own], WIDTH), []
            numbers = np.unique(np.concatenate(own), return_inverse=True)[1]  # shingles numbered from 0, so that a set is marked in an array
            parts, held = np.split(numbers, np.cumsum(n)[:-1]), np.zeros(numbers.max() + 1, np.int32)
            left, name = int((side == 0).sum()), np.unique(comp, return_inverse=True)[1]
            for x in range(left):
                others = np.arange(x + 1 if i[0] == j[0] else left, len(cid))
                others = others[(name[others] != name[x]) & (100 * np.minimum(n[x], n[others]) >= percent * np.maximum(n[x], n[others]))]
                asked = -(-percent * (n[x] + n[others]) // (100 + percent))
                if len(others):
                    near = bounds.room(x, others) >= asked
                    others, asked = others[near], asked[near]
                if not len(others):
                    continue
                held[parts[x]] = 1
                common = np.add.reduceat(held[np.concatenate([parts[y] for y in others])], np.cumsum(np.append(0, n[others][:-1])))
                held[parts[x]] = 0
                linked = others[common >= asked]
                _, first = np.unique(name[linked], return_index=True)
                found += [(min(cid[x], cid[y]), max(cid[x], cid[y])) for y in linked[first]]
                name[np.isin(name, name[linked])] = name[x]
            if found:
                yield batch_of([np.array(c, np.int64) for c in zip(*found, strict=True)], ["a", "b"])

    placed = in_blocks(clusters.withColumn("at", F.lit(0).cast("long")), sets.select("cid", "shingles"))
    return map_batches(placed, run, "a long, b long").distinct()


def star_pairs(entries: DataFrame, turn: int) -> DataFrame:
    """`a, b`: members of long lists with the pivots of `STARS` of their lists, where components differ."""
    draw = F.xxhash64("cid", "token", F.lit(turn))
    pivots = entries.groupBy("token").agg(F.min_by(F.struct("cid", "comp"), draw).alias("pivot"), F.count(F.lit(1)).alias("uses"))
    ranked = entries.groupBy("cid", "comp").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.xxhash64("token", "cid", F.lit(turn)).alias("h"), F.col("token")))), 1, STARS).alias("own"))
    chosen = ranked.select("cid", "comp", F.explode("own.token").alias("token"))
    chosen = stage(chosen, "chosen")  # a list's members are an upper bound of the rows that meet its pivot
    met = with_share(chosen, pivots, ["token"], "uses", chosen.count()).where((F.col("cid") != F.col("pivot.cid")) & (F.col("comp") != F.col("pivot.comp")))
    return met.select(F.least("cid", "pivot.cid").alias("a"), F.greatest("cid", "pivot.cid").alias("b")).distinct()


def id_bits(ids: DataFrame) -> np.ndarray:
    """A bitmap of `BITS` bits with those of the hashes `h` set; its size does not depend on the data."""
    bucket, bit = F.floor(F.col("h") / 32768).cast("long"), F.pmod(F.col("h"), F.lit(32768))
    out = np.zeros(BITS // 8, np.uint8)
    for r in ids.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("bits")).collect():
        out[4096 * r["bucket"] : 4096 * (r["bucket"] + 1)] = np.frombuffer(r["bits"], np.uint8)
    return out


def class_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """`cid, shingles` (8 bytes each, sorted), each of the `wanted` classes (`cid, low`) once, from the rows of its smallest id.

    Texts do not travel: a task reads those whose id may be wanted by a bitmap of fixed size, and those without an id, and sets of other
    classes are dropped by a join.
    """
    hashed = F.pmod(F.xxhash64(F.col("id")), F.lit(BITS))
    bits = docs.sparkSession.sparkContext.broadcast(id_bits(wanted.where("low IS NOT NULL").select(F.col("low").alias("id")).select(hashed.alias("h"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = bits.value, set()
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False)
            some = np.isnan(h) if h.dtype.kind == "f" else np.zeros(len(h), bool)
            at = np.where(some, 0, h).astype(np.int64)
            some |= (known[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            for c, s in sets_of(b.column(1).filter(pa.array(some)).to_pylist()):
                if len(s) and c not in seen:
                    seen.add(c)
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([s.tobytes()], pa.binary())], names=["cid", "shingles"])

    base = docs.select(F.col("doc_id").alias("id"), "text").select(F.when(F.col("id").isNotNull(), hashed).alias("h"), "text")
    found = map_batches(base, run, "cid long, shingles binary")
    return found.join(wanted.select("cid"), "cid", "left_semi").groupBy("cid").agg(F.first("shingles").alias("shingles"))


def possible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches leave room for enough common shingles. None that links is lost: a sketch gives an upper bound."""
    right = pairs.join(sketches.select(F.col("cid").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb")), "b")
    both = right.join(sketches.select(F.col("cid").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, sa, sb, na, nb = (c.to_pylist() for c in batch.columns)
            keep = pa.array([most_common(x, y) >= need(m, n, percent) for x, y, m, n in zip(sa, sb, na, nb, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return map_batches(both.select("a", "b", "sa", "sb", "na", "nb"), run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that link, by counting the common shingles of their whole sets."""
    right = pairs.join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb")), "b")
    both = right.join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa")), "a").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(j)[i].as_buffer(), np.uint64) for j in (2, 3))
                if len(x) > len(y):
                    x, y = y, x
                same = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                good.append(100 * same >= percent * (len(x) + len(y) - same))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return map_batches(both, run, "a long, b long")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> tuple[DataFrame, DataFrame]:
    """`rows` (doc_id, n, cid of every row) and `members` (cid, comp of every class that is not the smallest of its component), both staged.

    Pairs are checked in two steps, so that few whole sets are made and travel: sketches give an upper bound of what two sets share, and
    the pairs that are still possible are counted in full. Staged tables go as soon as their last reader is written.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    read = stage(documents(base), "rows")
    rows = read.where("part IS NULL").select("doc_id", "n", "cid", "sketch")
    wide, uses, sizes, narrow = wide_shingles(read, rows.count())
    boundary = choose_boundary(sizes, narrow, percent)
    scanned = stage(scan_lists(postings(base, wide, uses, boundary, percent), percent), "lists")
    long = scanned.where(F.col("long") == 1).groupBy("token", F.col("a").alias("cid")).agg(F.min("b").alias("at"))
    lists = stage(long, "long")
    shared = lists.groupBy("token").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1")
    entries = stage(with_share(lists, shared, ["token"], "uses", lists.count(), inner=True).drop("uses"), "entries")
    release(lists)
    met = scanned.where(F.col("long") == 0).groupBy("a", "b").agg(F.sum("token").alias("times"))
    listed = entries.select("cid").distinct()
    in_lists = [listed.select(F.col("cid").alias(side)) for side in ("a", "b")]
    once = met.where("times = 1").join(in_lists[0], "a", "left_semi").join(in_lists[1], "b", "left_semi")
    pairs = stage(met.where("times > 1").select("a", "b").union(once.select("a", "b")), "pairs")
    release(scanned)
    in_pairs = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).union(entries.select("cid")).distinct()
    sketches = rows.where("sketch IS NOT NULL").select("cid", "n", "sketch")
    sketches = stage(sketches.join(in_pairs, "cid", "left_semi").groupBy("cid").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "sketches")
    lows = rows.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("low"))

    def sets_of_classes(cids: DataFrame) -> DataFrame:
        wanted = stage(cids.distinct().join(lows, "cid").select("cid", "low"), "wanted")
        out = stage(class_sets(base, wanted), "sets")
        release(wanted)
        return out

    def components(links: DataFrame) -> DataFrame:
        return stars(links).select(F.col("u").alias("cid"), F.col("v").alias("comp"))

    some, several = pairs, not entries.isEmpty()
    if several:
        alone = entries.select("token", "cid", F.col("cid").alias("comp"))
        some = pairs.union(star_pairs(alone, 1)).union(star_pairs(alone, 2)).distinct()
    close = stage(possible(some, sketches, percent), "close")
    release(pairs)
    sets = sets_of_classes(close.select(F.col("a").alias("cid")).union(close.select("b")))
    links = stage(verified(close, sets, percent), "links")
    release(close, sets)
    found = components(links)
    release(links)
    if several:
        named = entries.join(found, "cid", "left").select("token", "cid", "at", F.coalesce("comp", "cid").alias("comp"))
        listed = stage(named, "listed")
        met = stars(cross_pairs(listed, sketches, percent, forest=True))
        release(listed)
        clusters = met.select(F.col("u").alias("cid"), F.col("v").alias("token")).union(met.select("v", "v").distinct())
        clusters = stage(clusters.join(found, "cid", "left").select("token", "cid", F.coalesce("comp", "cid").alias("comp")), "clusters")
        release(met)
        if not clusters.isEmpty():
            sets = sets_of_classes(clusters.select("cid"))
            links = stage(block_links(clusters, sets, percent), "links")
            before, found = found, components(links.union(found.select("cid", "comp")))
            release(sets, links, before)
        release(clusters)
    release(entries, sketches)
    return rows, found


def link_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row per row of `docs`: `doc_id`, `n_shingles`, `component_id` (the smallest id reachable by links, its own included).

    Words are runs of anything but space, tab, line ends, vertical tab and form feed, with A-Z lower-cased. A set holds the
    distinct five-word shingles; fewer words are one shingle, none (a null text too) give an empty set, which links with nothing,
    not even another empty one. Null ids are never a `component_id` where an id is known. Repeated rows are each returned and
    are linked, as are rows that share an id. Other columns are not read, and an empty table gives no rows.
    """
    rows, members = link(docs, id_col, text_col, percent)
    classes = rows.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("uses"))
    named = stage(classes.join(members, "cid", "left").withColumn("comp", F.coalesce("comp", "cid")), "named")
    lows = named.groupBy("comp").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    table = with_share(named, lows, ["comp"], "n", named.count()).select("cid", F.when(F.col("n").isNull(), F.col("low")).otherwise(F.col("component_id")).alias("component_id"), "uses")
    out = with_share(rows.select("doc_id", "n", "cid"), stage(table, "table"), ["cid"], "uses", rows.count())
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """The rows of `docs` whose id is the smallest of their component; all columns stay.

    An id that several rows share stays if it is the smallest for one of them. Rows without an id stay where no id of their
    component is known. Texts without words link with nothing and stay.
    """
    groups = link_groups(docs, id_col, text_col, percent).withColumn("stays", F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = groups.groupBy("doc_id").agg(F.max("stays").alias("stays")).where(~F.col("stays")).select(F.col("doc_id").alias("__gone"))
    return docs.join(stage(gone, "gone"), docs[id_col].cast("long").eqNullSafe(F.col("__gone")), "left_anti")
