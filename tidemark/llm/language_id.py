"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point alone, so all tasks agree on it. An n-gram's vector is
the product of its letters' vectors, each permuted (rotated) by its place. A document is the sum (bundle) of its n-grams'
vectors, a language the sum of its documents' unit bundles, and a document is given the language of largest cosine.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches

DIM, GRAM, SEED = 1024, 3, 7
PIECE = 400_000  # characters handled at once; a longer text is read in pieces
MAX_LANGS = 2000
_LETTERS: dict[int, np.ndarray] = {}
_ALPHA: list[np.ndarray] = []


def letter_vector(code: int) -> np.ndarray:
    """The random vector of a letter; 0 stands for everything between words."""
    if code not in _LETTERS:
        _LETTERS[code] = np.random.default_rng([SEED, code]).integers(0, 2, DIM, dtype=np.int8) * 2 - 1
    return _LETTERS[code]


def alphabetic() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _ALPHA:
        _ALPHA.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _ALPHA[0]


def letters(text: str) -> np.ndarray:
    """Lower-cased letters as code points, each run of anything else as one 0."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes = np.where(alphabetic()[codes], codes, 0)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] > 0) | (codes[:-1] > 0)
    return codes[keep]


def pieces(texts: list[str | None]) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Cleaned texts, numbered, in packs of about `PIECE` letters. The pieces of a long text overlap, so no n-gram is lost or read twice."""
    pack, size = [], 0
    for i, text in enumerate(texts):
        text, carry = text or "", np.zeros(1, np.int64)
        for at in range(0, max(1, len(text)), PIECE):
            own = letters(text[at : at + PIECE] + (" " if at + PIECE >= len(text) else ""))
            if len(own) and carry[-1] == 0 and own[0] == 0:
                own = own[1:]
            whole = np.concatenate([carry, own])
            if len(whole) >= GRAM:
                pack.append((i, whole))
                size += len(whole)
            carry = whole[-(GRAM - 1) :]
            if size >= PIECE:
                yield pack
                pack, size = [], 0
    if pack:
        yield pack


def bundles(pack: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the texts of a pack and their bundles."""
    alphabet, coded = np.unique(np.concatenate([x for _, x in pack]), return_inverse=True)
    k, ends = len(alphabet), np.cumsum([len(x) for _, x in pack])
    grams = coded[: len(coded) - GRAM + 1].astype(np.int64)
    for j in range(1, GRAM):
        grams = grams * k + coded[j : len(coded) - GRAM + 1 + j]
    owner = np.repeat(np.arange(len(pack)), [len(x) for _, x in pack])[: len(grams)]
    inside = np.ones(len(grams), bool)
    for j in range(1, GRAM):  # n-grams across the border of two texts
        inside[np.minimum(ends[:-1] - j, len(grams) - 1)] = False
    grams, owner = grams[inside], owner[inside]
    kinds, gram = np.unique(grams, return_inverse=True)
    table = np.stack([letter_vector(int(c)) for c in alphabet])
    vectors = np.ones((len(kinds), DIM), np.int8)
    for j in range(GRAM):
        vectors *= np.roll(table, GRAM - 1 - j, axis=1)[kinds // k ** (GRAM - 1 - j) % k]
    vectors = vectors.astype(np.float32)
    out, step = np.zeros((len(pack), DIM), np.float32), max(1, 2_000_000 // len(kinds))
    first = np.searchsorted(owner, np.arange(len(pack) + 1))
    for a in range(0, len(pack), step):
        b = min(len(pack), a + step)
        lo, hi = first[a], first[b]
        counts = np.bincount((owner[lo:hi] - a) * len(kinds) + gram[lo:hi], minlength=(b - a) * len(kinds))
        out[a:b] = counts.reshape(b - a, len(kinds)).astype(np.float32) @ vectors
    return np.array([i for i, _ in pack]), out


def text_bundles(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers and bundles of texts with a letter; each text once, in order. The parts of a long text are added up."""
    number, vector = -1, None
    for pack in pieces(texts):
        ids, rows = bundles(pack)
        keep, starts = np.unique(ids, return_index=True)
        rows = np.add.reduceat(rows, starts, axis=0)
        if vector is not None:
            if keep[0] == number:
                rows[0] += vector
            else:
                yield np.array([number]), vector[None]
        if len(keep) > 1:
            yield keep[:-1], rows[:-1]
        number, vector = keep[-1], rows[-1]
    if vector is not None:
        yield np.array([number]), vector[None]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Unit prototype of each language over all given rows with a language. Tasks return one sum per language they have seen."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for ids, rows in text_bundles(texts):
                norms = np.linalg.norm(rows, axis=1)
                for i, row, norm in zip(ids, rows, norms, strict=True):
                    if norm and has_letter(texts[i]):
                        sums.setdefault(langs[i], np.zeros(DIM))[:] += row / norm
            if len(sums) > MAX_LANGS:
                raise ValueError(f"more than {MAX_LANGS} languages: {lang_col} is not a language column")
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()])], names=["lang", "v"])

    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string"), F.col(text_col).cast("string"))
    parts = map_batches(rows, partial, "lang string, v array<double>")
    # fixed-point addition: the same prototypes whatever the order of tasks
    places = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum(F.round(F.col("x") * 1e6).cast("decimal(30,0)")).alias("x"))
    found = places.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", F.col("x").cast("double").alias("x")))).alias("v")).limit(MAX_LANGS + 1).collect()
    if len(found) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages: {lang_col} is not a language column")
    vectors = {r["lang"]: np.array([p["x"] for p in r["v"]]) for r in sorted(found, key=lambda r: r["lang"])}
    return {k: (v / (np.linalg.norm(v) or 1)).astype(np.float32) for k, v in vectors.items()}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """`docs` with the language of largest cosine and that cosine, at least 0.

    A text that is null or has no letter gets `und` and 0, and so does every text if nothing was learned. Equal cosines go to the
    first language in order of names. All other columns stay; columns of the two result names are replaced. Repeated rows are
    each predicted, and an empty table gives no rows. Neither language nor id is read.
    """
    names = sorted(prototypes)
    matrix = np.stack([prototypes[n] for n in names]) if names else np.zeros((0, DIM), np.float32)
    kept = [c for c in docs.columns if c not in (pred_col, score_col)]
    base = docs.select(*kept)
    at = kept.index(text_col)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            best, score = ["und"] * len(texts), np.zeros(len(texts))
            for ids, rows in text_bundles(texts) if names else ():
                cos = rows @ matrix.T / np.maximum(np.linalg.norm(rows, axis=1), 1e-9)[:, None]
                top = cos.argmax(axis=1)
                for i, j, x in zip(ids, top, cos[np.arange(len(top)), top], strict=True):
                    if has_letter(texts[i]):
                        best[i], score[i] = names[j], min(1.0, max(0.0, round(float(x), 6)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(score)], names=[*kept, pred_col, score_col])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields]
    return map_batches(base, scored, ", ".join([*fields, f"`{pred_col}` string", f"`{score_col}` double"]))


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, mod 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5


def fold_of(doc_id: int | None) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5
