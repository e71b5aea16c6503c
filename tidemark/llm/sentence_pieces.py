"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is marked (spaces become U+2581, one in front) and cut into words, each beginning with its run of marks; no piece of the
vocabulary crosses such a border, which is checked when it is loaded. The distinct words of a batch are sorted, which lists them
as the leaves of a trie in depth-first order: the forward scores of a word's first characters are those of its predecessor as
far as both agree, and only the rest is computed.

Two kinds of vocabulary are read. In a unigram vocabulary, the forward score of a position is the best sum of piece scores up to
it. In a BPE vocabulary, a step from a piece to the next is admitted only if joining both texts by merges gives back these two
pieces. A sequence all of whose neighbours are admitted is the sequence that merging gives: a merge across a border of two
pieces would also happen in these two alone. Each prefix has one such path, and its forward state is its last piece.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidemark.llm.common import map_batches

MARK = "▁"
UNIGRAM, BPE = 1, 2  # model types of the file format
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the file format
UNKNOWN_COST = 10.0  # a character outside the vocabulary scores this much below the worst piece
NO_PIECE, AT_START = -2, -1  # last pieces of a prefix that are none
KEPT = 300_000  # words that a process remembers in each of two generations
PAIRS = 500_000  # pairs of pieces that it remembers
WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
SPACES = re.compile(" {2,}")


class Vocabulary:
    """A model file: piece -> id and score, kind of model, and how text is marked."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as schema

        model = schema.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.kind = model.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are read")
        rules = model.normalizer_spec
        if rules.precompiled_charsmap or not rules.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that keep characters as they are and mark spaces in front are read")
        self.prefix, self.squeeze = rules.add_dummy_prefix, rules.remove_extra_whitespaces
        self.names = [p.piece for p in model.pieces]
        self.types = [p.type for p in model.pieces]
        if any(t == USER for t in self.types):
            raise ValueError("models with pieces of the user's own are not read")
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.score = [p.score for p in model.pieces]
        self.longest = max(map(len, self.ids), default=1)
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece crosses the border of words")
        self.bytes = {int(p[1:-1], 16): i for i, (p, t) in enumerate(zip(self.names, self.types, strict=True)) if t == BYTE}
        self.unknown = next(i for i, t in enumerate(self.types) if t == UNKNOWN)
        self.worst = min((self.score[i] for i in self.ids.values()), default=0.0) - UNKNOWN_COST
        self.endings: dict = {}  # the pieces as a tree of characters from the last one on; a piece's id is at 0
        for p, i in self.ids.items():
            node = self.endings
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[0] = i
        self.admitted: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}  # ids as 32-bit numbers
        self.older: dict[str, bytes] = {}  # the generation of words before
        plain = {CONTROL: lambda p: b"", UNKNOWN: lambda p: " \u2047 ".encode(), BYTE: lambda p: bytes([int(p[1:-1], 16)])}
        self.texts = [plain.get(t, lambda p: p.replace(MARK, " ").encode())(p) for p, t in zip(self.names, self.types, strict=True)]

    def mark(self, text: str) -> str:
        if self.squeeze:
            text = SPACES.sub(" ", text).strip(" ")
        if not text:
            return ""
        return (MARK if self.prefix else "") + text.replace(" ", MARK)

    def joins(self, left: str, right: str) -> bool:
        """Whether merging `left + right` from single characters ends with these two pieces."""
        parts, border, get, score = list(left + right), len(left), self.ids.get, self.score
        found = [get(a + b) for a, b in zip(parts, parts[1:])]  # the piece that each neighbour pair would become
        while True:
            best, at = None, -1
            for i, f in enumerate(found):
                if f is not None and (best is None or score[f] > best):
                    best, at = score[f], i
            if best is None:
                return parts == ([left, right] if left else [right])
            if at == border - 1:
                return False  # the first merge across the border settles it
            border -= at < border
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del found[at]
            if at:
                found[at - 1] = get(parts[at - 1] + parts[at])
            if at < len(found):
                found[at] = get(parts[at] + parts[at + 1])

    def ahead_bpe(self, word: str, start: int, best: list, last: list, piece: list) -> None:
        """Forward states of the prefixes longer than `start`: score, start and id of the last piece (`NO_PIECE` outside the vocabulary)."""
        score, endings, admitted = self.score, self.endings, self.admitted
        for end in range(start + 1, len(word) + 1):
            node, a, options = endings, end, []
            while a:
                node = node.get(word[a - 1])
                if node is None:
                    break
                a -= 1
                if 0 in node:
                    options.append((a, node[0]))
            if not options or options[0][0] != end - 1:
                options.insert(0, (end - 1, NO_PIECE))
            for a, found in reversed(options):
                before = piece[a]
                if found < 0 or before == NO_PIECE:
                    good = self.joins(word[last[a] : a], word[a:end])
                else:
                    good = admitted.get((before + 2) << 32 | found)
                    if good is None:
                        good = admitted[(before + 2) << 32 | found] = self.joins(word[last[a] : a], word[a:end])
                if good:
                    best.append(best[a] + (score[found] if found >= 0 else self.worst))
                    last.append(a)
                    piece.append(found)
                    break

    def ahead_unigram(self, word: str, start: int, best: list, last: list, piece: list) -> None:
        """The same where the best sum of scores decides; of equal sums the longest last piece."""
        for end in range(start + 1, len(word) + 1):
            top, at, own = None, end - 1, NO_PIECE
            for a in range(max(0, end - self.longest), end):
                found = self.ids.get(word[a:end])
                if found is None:
                    if a < end - 1:
                        continue
                    value = best[a] + self.worst
                else:
                    value = best[a] + self.score[found]
                if top is None or value > top:
                    top, at, own = value, a, NO_PIECE if found is None else found
            best.append(top)
            last.append(at)
            piece.append(own)

    def learn(self, words: list[str]) -> None:
        """Pieces of all words that are not known yet, by one depth-first walk of their trie."""
        if len(self.admitted) > PAIRS:
            self.admitted = {}
        ahead = self.ahead_bpe if self.kind == BPE else self.ahead_unigram
        best, last, piece, before = [0.0], [0], [AT_START], ""
        for word in sorted(words):
            same, most = 0, min(len(word), len(before))
            while same < most and word[same] == before[same]:
                same += 1
            del best[same + 1 :], last[same + 1 :], piece[same + 1 :]
            ahead(word, same, best, last, piece)
            ids: list[int] = []
            end = len(word)
            while end:
                a = last[end]
                if piece[end] >= 0:
                    ids.append(piece[end])
                elif self.bytes:
                    ids.extend(self.bytes[b] for b in reversed(word[a:end].encode("utf-8", "surrogatepass")))
                elif not ids or ids[-1] != self.unknown:  # neighbours outside the vocabulary are one unknown piece
                    ids.append(self.unknown)
                end = a
            self.words[word] = array("i", ids[::-1]).tobytes()
            before = word

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [WORD.findall(self.mark(t)) for t in texts]
        new = set().union(*cut) - self.words.keys()
        if len(self.words) + len(new) > KEPT:
            self.older, self.words, new = self.words, {}, set().union(*cut)
        for word in new & self.older.keys():  # words still in use move on to the new generation
            self.words[word] = self.older[word]
        self.learn(list(new - self.words.keys()))
        known = self.words.__getitem__
        return [np.frombuffer(b"".join(map(known, words)), np.int32) for words in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The text of pieces: marks become spaces, the first one goes, bytes are joined and read as UTF-8."""
        text = b"".join(map(self.texts.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary at `path`, read once in each Python process."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


SLICE = 2_000_000  # characters handled at once


def slices(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Consecutive rows of about `SLICE` characters together; a longer row is a slice of its own."""
    a, size = 0, 0
    for i, n in enumerate(lengths):
        size += n
        if size >= SLICE:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(lengths):
        yield a, len(lengths)


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", check_col: str | None = None) -> DataFrame:
    """`docs` with the ids of its text. A null text counts as empty, and an empty text has no ids.

    With `check_col`, that column says whether decoding the ids gives the text back; a mark in a text reads as a space. All other
    columns stay, and columns of these names are replaced. Repeated rows are each encoded; an empty table gives no rows. Texts
    are encoded whole. There is no shuffle: the vocabulary's path must be readable on every executor.
    """
    new = [ids_col, *([check_col] if check_col else [])]
    kept = [c for c in docs.columns if c not in new]
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in batches:
            lengths = pc.fill_null(pc.utf8_length(batch.column(at)), 0).to_pylist()
            for a, b in slices(lengths):
                part = batch.slice(a, b - a)
                texts = [t or "" for t in part.column(at).to_pylist()]
                ids = own.encode(texts)
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                out = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))]
                if check_col:
                    out.append(pa.array([own.decode(i) == t.replace(MARK, " ") for i, t in zip(ids, texts, strict=True)]))
                yield pa.RecordBatch.from_arrays([*part.columns, *out], names=[*kept, *new])

    base = docs.select(*kept)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields]
    return map_batches(base, run, ", ".join([*fields, f"`{ids_col}` array<int>", *([f"`{check_col}` boolean"] if check_col else [])]))


def decode(docs: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """`docs` with the text of its ids in `text_col`, which is replaced if there. Null ids give a null text."""
    kept = [c for c in docs.columns if c != text_col]
    at = kept.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in batches:
            texts: list[str | None] = []
            for ids in batch.column(at):
                found = None if ids.values is None else ids.values.drop_null().to_numpy(zero_copy_only=False)
                texts.append(None if found is None else own.decode(found))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*kept, text_col])

    base = docs.select(*kept)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields]
    return map_batches(base, run, ", ".join([*fields, f"`{text_col}` string"]))
