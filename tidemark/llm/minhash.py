"""Near-duplicate classes by MinHash: universal hash minima, banding, signature and exact checks, components by star operations.

Documents with equal shingle sets form a class; all work is on classes.

1. Each set gets `HASHES` minima under hash functions a * x + b modulo 2**64 (upper half). A band is `ROWS` of them; classes that agree
   in a band share its bucket. With 32 bands of 4, two sets of similarity 0.8 miss every bucket with probability 5e-8.
2. Buckets are not expanded into pairs. Their members are compared with a pivot, the member that shares the most bucket places with
   others; linked members form components. Only members that are then not in the largest component of their bucket are compared with all
   members of other components, in blocks, each pair in the first band it shares. A block passes on the members that have a possible partner,
   then counts whole sets and writes the links that unite components, so what leaves it grows with its members and not with their pairs.
3. A pair is checked by signatures of 8 bits a minimum: fewer agreeing ones than `signature_floor` end it, which loses a link with probability
   of about 1e-7. What passes is counted on whole sets.
4. Components come from alternating large-star and small-star: every node hands its larger neighbours, then its smaller ones, to the
   smallest node it knows, until nothing changes.

Links are exact; what can be lost is bounded by the two probabilities above, whatever the size of a bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import with_share
from tidemark.llm.words import mix, shingles, word_hashes
from tidemark.sources.stage import release, stage

HASHES, ROWS = 128, 4
TAIL = 5.5  # standard deviations below its mean at which the count of agreeing minima counts as too few
BLOCK = 1024  # members of a bucket, about, that are compared with as many others in one piece of work
SHARE = 512  # rows of one key that meet one copy of its value
GATHER = 1 << 19  # shingles hashed at once

_DRAW = np.random.default_rng(20)
FACTORS = _DRAW.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _DRAW.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def signature_floor(percent: int) -> int:
    """Agreeing minima that a pair of that similarity has, but for a tail of `TAIL` standard deviations."""
    p = percent / 100
    return max(0, math.floor(HASHES * p - TAIL * math.sqrt(HASHES * p * (1 - p))))


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """One row of `HASHES` minima for each set; none is empty."""
    flat = np.concatenate(sets)
    borders = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), HASHES), np.uint32)
    work = np.empty_like(flat)
    for k in range(HASHES):
        np.multiply(flat, FACTORS[k], out=work)
        np.add(work, SHIFTS[k], out=work)
        out[:, k] = np.minimum.reduceat(work, borders) >> np.uint64(32)
    return out


def set_number(s: np.ndarray) -> int:
    """A 64-bit number of a sorted set."""
    with np.errstate(over="ignore"):
        spread = mix(s + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64) + mix(s ^ np.uint64(len(s) * 2 + 1)).sum(dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return int(mix(np.array([spread + np.uint64(len(s))], np.uint64)).astype(np.int64)[0])


def band_keys(lows: np.ndarray) -> np.ndarray:
    """A number for each band of each row of minima."""
    bands = lows.reshape(len(lows), -1, ROWS).astype(np.uint64)
    total = np.broadcast_to(np.arange(1, bands.shape[1] + 1, dtype=np.uint64), bands.shape[:2]).copy()
    for j in range(ROWS):
        total = mix(total * np.uint64(0xD6E8FEB86659FD93) + bands[:, :, j])
    return total.astype(np.int64)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """`doc_id, n, cid, mark, bands, shingles` of every row of `doc_id, text`.

    `mark` holds the signature, 8 bits a minimum, and the keys of the bands. A task writes it and `bands` of a class once and null after
    that, and `shingles` only where there is no id to find the text by.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, bool]] = set()

        def flush(rows: list, fresh: list, sets: list) -> pa.RecordBatch:
            marks, bands, named = [None] * len(rows), [None] * len(rows), [None] * len(rows)
            if sets:
                lows = minima(sets)
                keys = band_keys(lows)
                low8 = lows.astype(np.uint8)
                for k, at in enumerate(fresh):
                    marks[at], bands[at] = low8[k].tobytes() + keys[k].tobytes(), keys[k].tolist()
                    if rows[at][0] is None:
                        named[at] = sets[k].tobytes()
            ids, n, cid = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(cid, pa.int64()), pa.array(marks, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(named, pa.binary()),
            ], names=["doc_id", "n", "cid", "mark", "bands", "shingles"])

        for b in batches:
            rows, fresh, sets, size = [], [], [], 0
            for doc_id, hashed in zip(b.column(0).to_pylist(), word_hashes(b.column(1).to_pylist()), strict=True):
                s = shingles(hashed, words)
                cid = set_number(s) if len(s) else 0
                if len(s) and (cid, doc_id is None) not in seen:
                    seen.add((cid, doc_id is None))
                    fresh.append(len(rows))
                    sets.append(s)
                    size += len(s)
                rows.append((doc_id, len(s), cid))
                if size >= GATHER:
                    yield flush(rows, fresh, sets)
                    rows, fresh, sets, size = [], [], [], 0
            if rows:
                yield flush(rows, fresh, sets)

    return docs.mapInArrow(run, "doc_id long, n long, cid long, mark binary, bands array<long>, shingles binary")


def whole_sets(docs: DataFrame, rows: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """`cid, shingles` (8 bytes each, sorted) of the wanted classes, each once: from the row of smallest id, or as staged where no row has an id."""
    lows = rows.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("low")).join(wanted, "cid")
    # several classes can name one id, if rows share it: it is looked up once
    found = docs.join(lows.where("low IS NOT NULL").select(F.col("low").alias("doc_id")).distinct(), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for hashed in word_hashes(b.column(0).to_pylist()):
                s = shingles(hashed, words)
                if len(s):
                    yield pa.RecordBatch.from_arrays([pa.array([set_number(s)]), pa.array([s.tobytes()], pa.binary())], names=["cid", "shingles"])

    named = found.select("text").mapInArrow(run, "cid long, shingles binary")
    blank = rows.where("shingles IS NOT NULL").select("cid", "shingles").join(lows.where("low IS NULL").select("cid"), "cid", "left_semi")
    return named.unionByName(blank).groupBy("cid").agg(F.first("shingles").alias("shingles"))


def with_value(pairs: DataFrame, side: str, values: DataFrame, column: str, total: int) -> DataFrame:
    """`total` `pairs` with the value of the class in column `side`. A class of many pairs is dealt to copies, so that none meets more than about `SHARE`."""
    counts = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("uses")).withColumn("copies", F.ceil(F.col("uses") / SHARE).cast("int"))
    dealt = counts.join(values.select(F.col("cid").alias(side), F.col(column).alias(f"__{side}")), side)
    right = dealt.withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select(side, "__part", f"__{side}")
    placed = with_share(pairs, counts, [side], "uses", total).drop("uses")
    placed = placed.withColumn("__part", F.pmod(F.xxhash64("a", "b"), F.col("copies").cast("long")).cast("int")).drop("copies")
    return placed.join(right, [side, "__part"]).drop("__part")


def agreeing(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """The pairs with enough agreeing minima."""
    total = pairs.count()
    both = with_value(with_value(pairs, "a", sigs, "sig", total), "b", sigs, "sig", total).select("a", "b", "__a", "__b")
    floor = signature_floor(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, HASHES) for k in (2, 3))
            keep = pa.array((x == y).sum(axis=1) >= floor)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that link, counted on whole sets."""
    total = pairs.count()
    both = with_value(with_value(pairs, "a", sets, "shingles", total), "b", sets, "shingles", total).select("a", "b", "__a", "__b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for i in range(b.num_rows):
                x, y = (np.frombuffer(b.column(k)[i].as_buffer(), np.uint64) for k in (2, 3))
                both_in = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                good.append(100 * both_in >= percent * (len(x) + len(y) - both_in))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def pair(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def stars(edges: DataFrame) -> DataFrame:
    """`u, v`: for every node of the edges (`a, b`) that is not the smallest of its component, that smallest node.

    Large-star: node u hands each larger neighbour to the smallest of itself and its neighbours. Small-star: it does so with its smaller
    neighbours and itself. Both keep components; when a round changes nothing, all edges lead to the smallest node.
    """
    now = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")

    def print_of(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())

    mark = print_of(now)
    while mark[0]:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("uses")).withColumn("m", F.least("u", "m"))
        large = stage(with_share(both, least, ["u"], "uses", 2 * mark[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("uses"))
        met = with_share(large, least, ["u"], "uses", 2 * mark[0])
        small = stage(met.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        before, mark = mark, print_of(small)
        release(now, large)
        now = small
        if mark == before:
            break
    return now


def meetings(members: DataFrame, total: int) -> DataFrame:
    """`work, key, i, j, side, cid, comp`: the members of buckets of several components (`key, cid, comp`) in pairs of blocks.

    A bucket is parted in its largest component and the rest, each in blocks by a hash of the class. Blocks of the rest meet each other
    (i <= j) and those of the largest component (j < 0); `side` is 1 for members of block j where that is not i. A task holds two blocks.
    """
    kinds = members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("uses"))
    buckets = kinds.groupBy("key").agg(F.max_by("comp", F.struct("uses", "comp")).alias("top"), F.sum("uses").alias("n"), F.max("uses").alias("most"))
    sizes = [F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int").alias("rests"), F.ceil(F.col("most") / BLOCK).cast("int").alias("tops")]
    met = with_share(members, buckets.where("n > most").select("key", "top", "n", *sizes), ["key"], "n", total).where("top IS NOT NULL")
    rest = F.col("comp") != F.col("top")
    met = met.withColumn("own", F.pmod(F.xxhash64("cid"), F.when(rest, F.col("rests")).otherwise(F.col("tops")).cast("long")).cast("int"))

    def meeting(i: Column, j: Column, side: Column) -> Column:
        return F.struct(i.alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))

    own, none = F.col("own"), F.lit(0)
    rests, tops = F.sequence(none, F.col("rests") - 1), F.sequence(none, F.col("tops") - 1)
    among = F.transform(rests, lambda x: meeting(F.least(own, x), F.greatest(own, x), x < own))
    keys = F.when(rest, F.concat(among, F.transform(tops, lambda x: meeting(own, -1 - x, none)))).otherwise(F.transform(rests, lambda x: meeting(x, -1 - own, F.lit(1))))
    spread = met.select("key", "cid", "comp", F.explode(keys).alias("m")).select("key", "m.*", "cid", "comp")
    return spread.select(F.xxhash64("key", "i", "j").alias("work"), "key", "i", "j", "side", "cid", "comp")


def pieces_of(batches: Iterator[pa.RecordBatch], numbers: int, cuts_by: int) -> Iterator[tuple[list[np.ndarray], list[list]]]:
    """Sorted rows in packs of equal first `cuts_by` columns: the first `numbers` columns as arrays, the others as lists."""
    held: tuple[list[np.ndarray], list[list]] | None = None
    for b in batches:
        rows = [b.column(k).to_numpy(zero_copy_only=False) for k in range(numbers)]
        more = [b.column(k).to_pylist() for k in range(numbers, b.num_columns)]
        if held is not None:
            rows, more = [np.concatenate([h, r]) for h, r in zip(held[0], rows, strict=True)], [h + m for h, m in zip(held[1], more, strict=True)]
        if not len(rows[0]):
            continue
        new = np.zeros(len(rows[0]), bool)
        for r in rows[:cuts_by]:
            new[1:] |= r[1:] != r[:-1]
        cuts = [0, *np.flatnonzero(new).tolist()]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            yield [r[a:z] for r in rows], [m[a:z] for m in more]
        held = [r[cuts[-1] :] for r in rows], [m[cuts[-1] :] for m in more]
    if held is not None and len(held[0][0]):
        yield held


def possible_partners(rows: list[np.ndarray], marks: list[bytes], floor: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per member of a meeting the others it has to be compared with: other components, first shared band here, enough agreeing minima."""
    _, key, i, j, side, cid, comp = rows
    both = np.frombuffer(b"".join(marks), np.uint8).reshape(len(marks), -1)
    sig, bands = both[:, :HASHES], np.ascontiguousarray(both[:, HASHES:]).view(np.int64)
    here = int(np.flatnonzero(bands[0] == key[0])[0])
    left = int((side == 0).sum())
    for x in range(left):
        others = np.arange(x + 1 if i[0] == j[0] else left, len(cid))
        others = others[comp[others] != comp[x]]
        others = others[(sig[others] == sig[x]).sum(axis=1) >= floor]
        if here and len(others):
            others = others[~(bands[others, :here] == bands[x, :here]).any(axis=1)]
        if len(others):
            yield x, others


def block_links(members: DataFrame, total: int, docs: DataFrame, rows: DataFrame, marks: DataFrame, words: int, percent: int) -> DataFrame:
    """`a, b`: links between components inside buckets, as many as unite all that link within a meeting of two blocks."""
    floor = signature_floor(percent)
    names = ["work", "key", "i", "j", "side", "cid", "comp"]
    schema = "work long, key long, i int, j int, side int, cid long, comp long"
    order = names[:5]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, (mark,) in pieces_of(batches, 7, 4):
            some = np.zeros(len(mark), bool)
            for x, others in possible_partners(own, mark, floor):
                some[x] = True
                some[others] = True
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(r[some]) for r in own], names=names)

    met = stage(meetings(members, total), "meetings")
    with_marks = met.join(marks, "cid").select(*names, "mark").repartition("work").sortWithinPartitions(*order)
    chosen = stage(with_marks.mapInArrow(choose, schema), "chosen")
    release(met)
    sets = stage(whole_sets(docs, rows, chosen.select("cid").distinct(), words), "sets")

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, (mark, sets) in pieces_of(batches, 7, 4):
            cid, root = own[5], {c: c for c in own[6].tolist()}
            found: list[tuple[int, int]] = []

            def top(c: int, root: dict[int, int] = root) -> int:
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            for x, others in possible_partners(own, mark, floor):
                apart = [y for y in others.tolist() if top(own[6][y]) != top(own[6][x])]
                if not apart:
                    continue
                mine = np.frombuffer(sets[x], np.uint64)
                flat = np.frombuffer(b"".join(sets[y] for y in apart), np.uint64)
                sizes = np.array([len(sets[y]) // 8 for y in apart])
                same = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
                common = np.add.reduceat(same.astype(np.int64), np.cumsum(np.concatenate([[0], sizes[:-1]])))
                for y in np.flatnonzero(100 * common >= percent * (len(mine) + sizes - common)).tolist():
                    a, b = top(own[6][x]), top(own[6][apart[y]])
                    if a != b:
                        root[a] = b
                        found.append((int(min(cid[x], cid[apart[y]])), int(max(cid[x], cid[apart[y]]))))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    ready = chosen.join(marks, "cid").join(sets, "cid").select(*names, "mark", "shingles")
    links = stage(ready.repartition("work").sortWithinPartitions(*order).mapInArrow(unite, "a long, b long"), "links")
    release(chosen, sets)
    return links


def near_classes(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """`rows` (doc_id, n, cid, ... of every row) and `members` (u, v: class and smallest class of its component, where they differ), both staged."""
    rows = stage(signatures(docs, words), "signatures")
    banded = rows.where("mark IS NOT NULL").select("cid", F.explode("bands").alias("key")).distinct()
    places = stage(banded, "places")
    buckets = places.groupBy("key").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1")
    shared = stage(with_share(places, buckets, ["key"], "uses", places.count(), inner=True), "shared")
    release(places)
    total = shared.count()
    if not total:
        return rows, docs.sparkSession.createDataFrame([], "u long, v long")
    degree = shared.groupBy("cid").agg(F.sum(F.col("uses") - 1).alias("degree"))
    members = stage(shared.join(degree, "cid"), "members")
    release(shared)
    marks = rows.where("mark IS NOT NULL").join(members.select("cid").distinct(), "cid", "left_semi")
    marks = stage(marks.groupBy("cid").agg(F.first("mark").alias("mark")), "marks")
    pivots = members.groupBy("key").agg(F.max_by("cid", F.struct("degree", "cid")).alias("pivot"), F.count(F.lit(1)).alias("n"))
    met = with_share(members.select("key", "cid"), pivots, ["key"], "n", total).where("cid != pivot")
    pairs = stage(met.select(*pair(F.col("cid"), F.col("pivot"))).distinct(), "pairs")
    close = stage(agreeing(pairs, marks.select("cid", F.substring("mark", 1, HASHES).alias("sig")), percent), "close")
    sets = stage(whole_sets(docs, rows, close.select(F.col("a").alias("cid")).union(close.select("b")).distinct(), words), "sets")
    links = stage(linked(close, sets, percent), "links")
    found = stars(links)
    release(pairs, close, sets, links)
    named = members.select("key", "cid").join(found.select(F.col("u").alias("cid"), F.col("v").alias("new")), "cid", "left")
    placed = stage(named.select("key", "cid", F.coalesce("new", "cid").alias("comp")), "placed")
    release(members)
    links = block_links(placed, total, docs, rows, marks, words, percent)
    out = stars(links.union(found))
    release(placed, links, marks, found)
    return rows, out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 80) -> DataFrame:
    """One row per row of `docs`: `doc_id`, `n_shingles`, `component_id` (the smallest id reachable by links) and `kept` (whether that is its own).

    Words are runs of anything but space, tab, line ends, vertical tab and form feed, with A-Z lower-cased. A set holds the distinct
    shingles of `words` words; fewer words are one shingle, none (a null text too) give an empty set, which links with nothing. Sets link
    when `percent` of their union is common. Repeated rows are each returned and are linked, as are rows that share an id. A null id is
    never a `component_id` where an id is known; where none is, `component_id` is null and the rows are kept. Other columns are not read, and
    an empty table gives no rows.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows, members = near_classes(base, words, percent)
    classes = rows.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("uses"))
    named = classes.join(members.select(F.col("u").alias("cid"), F.col("v").alias("comp")), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    named = stage(named, "named")
    many = named.groupBy("comp").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    table = with_share(named, many, ["comp"], "n", named.count()).select("cid", F.when(F.col("n").isNull(), F.col("low")).otherwise(F.col("component_id")).alias("component_id"), "uses")
    out = with_share(rows.select("doc_id", "n", "cid"), stage(table, "table"), ["cid"], "uses", rows.count())
    root = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), root.alias("component_id"), F.col("doc_id").eqNullSafe(root).alias("kept"))
