"""Runs (maximal periodic stretches) of word sequences, by Baier's grouping.

By the runs theorem every run has a Lyndon root that is the longest Lyndon word at its start, under one order of the words or its
reverse. So there are at most two candidates a place: its entries in the two Lyndon arrays. Each array comes from phase one of
Baier's suffix sorter alone (no suffix array): groups of suffixes are handled from the highest to the lowest, and every group adds its
context to that of the nearest lower suffix before each of its members; the context of a suffix in its last group is its longest
Lyndon word. A root is then extended to both sides by longest common extensions, found by descent over names of the blocks of 1, 2,
4, ... words, equal for equal blocks; so nothing rests on hashes.

A text is first sieved: a run of `least` words or more, twice its period or more, is covered by pieces of `least` - `least` // 2 words
that occur twice in the text. Stretches without such pieces cannot hold a run, and the work above is done on the others alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import mix

PACK = 1 << 18  # words whose stretches are worked on together, about


def lyndon_array(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word at each place of a sequence of ranks 0..max, all of which occur."""
    n, top = len(ranks), max(ranks)
    members: list[list[int]] = [[] for _ in range(top + 1)]
    for i, r in enumerate(ranks):
        members[r].append(i)
    of, length = list(ranks), [1] * (top + 1)
    lower, upper = list(range(-1, top)), [*range(1, top + 1), -1]
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))  # neighbours among the places not handled yet
    out = [0] * n
    group = top
    while group >= 0:
        size = length[group]
        own = [i for i in members[group] if of[i] == group]
        members[group] = []
        if len(own) > 1:
            own.sort()
        found: dict[int, int] = {}
        for i in own:
            out[i] = size
            of[i] = -1
            p, q = before[i], after[i]
            if q < n:
                before[q] = p
            if p >= 0:
                after[p] = q
                found[p] = found.get(p, 0) + 1
        if found:
            for times in sorted(set(found.values()), reverse=True):
                fresh: dict[int, int] = {}
                for p, c in found.items():
                    if c == times:
                        old = of[p]
                        new = fresh.get(old)
                        if new is None:
                            new = fresh[old] = len(length)
                            length.append(length[old] + times * size)
                            members.append([])
                            above = upper[old]
                            lower.append(old)
                            upper.append(above)
                            upper[old] = new
                            lower[above] = new
                        members[new].append(p)
                        of[p] = new
        group = lower[group]
    return out


def block_names(x: np.ndarray, longest: int) -> list[np.ndarray]:
    """For each power of two up to `longest`, a number for the block of so many words at each place; equal blocks have equal numbers."""
    names = [x.astype(np.int64)]
    width = 1
    while 2 * width <= longest:
        last = names[-1]
        pairs = last[:-width] * (int(last.max()) + 1) + last[width:]
        names.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))
        width *= 2
    return names


def extension(names: list[np.ndarray], i: np.ndarray, j: np.ndarray, ahead: bool) -> np.ndarray:
    """Common words from i < j on (ahead), or up to and including i and j (not ahead)."""
    i, j, total = i.copy(), j.copy(), np.zeros(len(i), np.int64)
    for k in range(len(names) - 1, -1, -1):
        width, name = 1 << k, names[k]
        a, b = (i, j) if ahead else (i - width + 1, j - width + 1)
        same = (a >= 0) & (b < len(name))
        same[same] = name[a[same]] == name[b[same]]
        step = np.where(same, width, 0)
        total += step
        i, j = (i + step, j + step) if ahead else (i - step, j - step)
    return total


def stretches(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the parts covered by pieces that occur twice. Words of different texts are different numbers."""
    piece = least - least // 2
    n = len(words) - piece + 1
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums = np.zeros(n, np.uint64)
    for k in range(piece):
        sums = mix(sums + words[k : n + k].astype(np.uint64))
    order = np.argsort(sums, kind="stable")
    same = sums[order[1:]] == sums[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(change, at, 1)
    np.add.at(change, at + piece, -1)
    edge = np.diff((np.cumsum(change[:-1]) > 0).astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = ends - starts >= least
    return starts[long], ends[long]


def runs_of(words: np.ndarray, least: int) -> np.ndarray:
    """Rows (start, end, period) of all runs of at least `least` words in a sequence of numbers, by start, then period.

    `words` may hold several texts, if no number occurs in two of them. Shorter runs than twice the period are none.
    """
    starts, ends = stretches(words, least)
    if not len(starts):
        return np.zeros((0, 3), np.int64)
    roots, places = [], []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        ranks = np.unique(words[a:b], return_inverse=True)[1]
        for one in (ranks, ranks.max() - ranks):
            roots.append(np.array(lyndon_array(one.tolist()), np.int64))
            places.append(np.arange(a, b))
    root, place = np.concatenate(roots), np.concatenate(places)
    # the stretches side by side, a number of its own after each, so that no extension leaves its stretch
    shift = np.cumsum(np.concatenate([[0], ends - starts + 1]))
    number = np.searchsorted(starts, place, "right") - 1
    sizes = ends - starts
    inside = np.repeat(starts - shift[:-1], sizes) + np.arange(sizes.sum()) + np.repeat(np.arange(len(sizes)), sizes)
    known = np.unique(words[inside], return_inverse=True)[1]
    flat = np.empty(shift[-1], np.int64)
    flat[inside - np.repeat(starts - shift[:-1], sizes)] = known
    flat[shift[1:] - 1] = known.max() + 1 + np.arange(len(sizes))
    names = block_names(flat, int(sizes.max()))
    i = place - starts[number] + shift[number]
    some = i + root < shift[number] + sizes[number]
    # a root at the end of its stretch can still be extended to the left
    right = np.zeros(len(i), np.int64)
    right[some] = extension(names, i[some], (i + root)[some], True)
    left = extension(names, i - 1, i + root - 1, False)
    start, end = place - left, place + root + right
    good = (end - start >= least) & (end - start >= 2 * root)
    return np.unique(np.stack([start[good], end[good], root[good]], axis=1), axis=0)


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay when each run keeps its first period alone."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12) -> DataFrame:
    """One row per row of `docs`: `doc_id`, `runs` (array of start, length, period by start, then period) and `collapsed`.

    Words are runs of anything but space, tab, line ends, vertical tab and form feed, numbered from 0 and compared byte by byte. A run
    is a stretch with smallest period q, at least `least` words and at least 2 q long, that no neighbouring word extends. `collapsed`
    holds the words that no run drops, joined by one space; a run drops what it holds after its first q words. Texts without words,
    null ones too, have no runs and an empty `collapsed`. Rows with a null id and repeated rows are each returned. Other columns
    are not read, and an empty table gives no rows. A text is worked on in one task, in time about linear in its words.
    """
    if least < 2:
        raise ValueError("least must be at least 2")

    def solve(texts: list[list[bytes]]) -> Iterator[tuple[np.ndarray, bytes]]:
        known: dict[bytes, int] = {}
        sizes = np.array([len(t) for t in texts])
        flat = np.fromiter((known.setdefault(w, len(known)) for t in texts for w in t), np.int64, int(sizes.sum()))
        borders = np.concatenate([[0], np.cumsum(sizes)])
        found = runs_of(flat + np.repeat(np.arange(len(texts)), sizes) * len(known), least)  # one number a word and text
        at = np.searchsorted(found[:, 0], borders)
        for t, text in enumerate(texts):
            runs = found[at[t] : at[t + 1]] - np.array([borders[t], borders[t], 0])
            if len(runs):
                stay = kept_words(len(text), runs)
                text = [w for w, s in zip(text, stay.tolist(), strict=True) if s]
            yield runs, b" ".join(text)

    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
            found = list(solve(texts))
            rows = np.concatenate([r for r, _ in found])
            ends = np.cumsum([0, *(len(r) for r, _ in found)]).astype(np.int32)
            parts = pa.StructArray.from_arrays([pa.array(x) for x in (rows[:, 0], rows[:, 1] - rows[:, 0], rows[:, 2])], fields=list(item))
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.ListArray.from_arrays(pa.array(ends), parts), pa.array([x for _, x in found], pa.binary())], names=["doc_id", "runs", "collapsed"])

        for b in batches:
            kind = b.schema.field(0).type
            ids, texts, size = [], [], 0
            for i in range(b.num_rows):
                ids.append(b.column(0)[i].as_py())
                texts.append((b.column(1)[i].as_py() or b"").split())  # bytes part at ASCII white space alone
                size += len(texts[-1])
                if size >= PACK:
                    yield flush(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield flush(ids, texts)

    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    kind_of = base.schema["doc_id"].dataType.simpleString()
    out = base.mapInArrow(run, f"doc_id {kind_of}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def with_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` where a tenth of the texts turns periodic: a workload of known repetition for `periodic_runs`.

    With h the CRC-32 of the decimal id and g = h div 10: if h mod 10 = 0 and the text has n > 0 words, word i from a = g mod n on
    becomes word a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8), and the words are joined by one space. A null id changes nothing.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    chosen = docs.withColumn("__g", F.when(F.pmod(h, F.lit(10)) == 0, F.floor(h / 10).cast("long")))
    words = F.filter(F.split(F.col(text_col).cast("string"), "[ \t-\r]+", -1), lambda w: w != "")
    listed = chosen.withColumn("__w", F.when(F.col("__g").isNotNull(), words)).withColumn("__n", F.size("__w").cast("long"))
    placed = listed.withColumn("__a", F.when(F.col("__n") > 0, F.col("__g") % F.col("__n")))
    placed = placed.withColumn("__p", 1 + F.floor((F.col("__n") - F.col("__a")) / (3 + F.col("__g") % 8)))
    a, p = F.col("__a"), F.col("__p")
    turned = F.transform("__w", lambda w, i: F.when(i < a, w).otherwise(F.get("__w", (a + F.pmod(i - a, p)).cast("int"))))
    text = F.when(a.isNotNull(), F.array_join(turned, " ")).otherwise(F.col(text_col))
    return placed.withColumn(text_col, text).select(*docs.columns)
