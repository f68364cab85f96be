"""Byte-level BPE encoding of a corpus with a public vocabulary, by a pair occurrence index.

A partition's texts are cut at places where no token can span (a change to white space from anything else); each
different piece is split by the vocabulary's pattern once and looked up afterwards. All new words of a batch are encoded
together: an index maps every adjacent pair that has a merge to the list of its positions in all words. The ranks that
occur are applied in ascending order, each to all its positions at once; merging changes the two neighbours'
pairs, whose positions are added to the lists of their ranks. A merge only creates pairs of higher rank, so one
ascending sweep gives the same ids as merging word by word.

Defined results: null and empty texts give an empty list; text that looks like a special token is plain text; any length is
encoded whole (a word of n bytes costs O(n log n)). Null ids, repeated rows and extra columns are passed or ignored.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.session import spread

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
#: The public split pattern of this vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A worker forgets its known pieces beyond this many pieces or characters, so its memory is bounded.
KNOWN_PIECES, KNOWN_CHARS = 400_000, 24_000_000
#: Characters of text whose new words are indexed together.
BATCH_CHARS = 16_000_000
#: These are white space to Python's re but not to the pattern; a text with one is kept as one piece.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_PIECES = re.compile(r"\s*\S+|\s+")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PairIndexEncoder:
    """The merges of a vocabulary and their application to many words at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int32)
        self.right = np.array([vocab[b] for _, b in pairs], np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.of_byte = np.zeros(256, np.int32)
        for c, b in byte_alphabet().items():
            self.of_byte[b] = vocab[c]
        keys = (self.left.astype(np.int64) << 32) | self.right
        self.rank_of = np.argsort(keys, kind="stable").astype(np.int64)
        self.keys = keys[self.rank_of]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where there is no merge."""
        k = (a.astype(np.int64) << 32) | b
        i = np.minimum(np.searchsorted(self.keys, k), self.keys.size - 1)
        return np.where(self.keys[i] == k, self.rank_of[i], -1)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, offsets of the words in them)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = raw.size
        sym = np.append(self.of_byte[raw], np.int32(-1))  # position n stands for "outside the word"
        nxt, prv = np.arange(1, n + 2), np.arange(-1, n)
        full = lengths > 0
        nxt[ends[full] - 1] = n
        prv[(ends - lengths)[full]] = n
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray, ranks: np.ndarray) -> None:
            if at.size > 1:
                order = np.argsort(ranks, kind="stable")
                at, ranks = at[order], ranks[order]
                cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
                bounds = [0, *cuts.tolist(), at.size]
                heads = ranks[bounds[:-1]].tolist()
            else:
                bounds, heads = [0, 1], ranks.tolist()
            for i, r in enumerate(heads):
                known = index.get(r)
                if known is None:
                    index[r] = [at[bounds[i] : bounds[i + 1]]]
                    heapq.heappush(heap, r)
                else:
                    known.append(at[bounds[i] : bounds[i + 1]])

        if n:
            inner = np.flatnonzero(nxt[:n] < n)
            ranks = self._ranks(sym[inner], sym[inner + 1])
            hit = ranks >= 0
            if hit.any():
                add(inner[hit], ranks[hit])
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            a, b, made = self.left[r], self.right[r], self.made[r]
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            if at.size > 1:  # ascending, each once: two merges side by side report the pair between them twice
                at = np.sort(at)
                at = at[np.concatenate(([True], at[1:] != at[:-1]))]
            after = nxt[at]
            ok = (sym[at] == a) & (sym[after] == b)
            if not ok.all():
                at, after = at[ok], after[ok]
            if not at.size:
                continue
            if a == b and at.size > 1:  # in a run of the same symbol every other pair, from the left
                i = np.arange(at.size)
                begins = np.concatenate(([True], after[:-1] != at[1:]))
                keep = (i - np.maximum.accumulate(np.where(begins, i, 0))) % 2 == 0
                at, after = at[keep], after[keep]
            beyond = nxt[after]
            sym[at], sym[after] = made, -2
            nxt[at], prv[beyond] = beyond, at
            before = prv[at]
            li, ri = before < n, beyond < n
            where = np.concatenate([before[li], at[ri]])
            if where.size:
                ranks = self._ranks(sym[where], sym[nxt[where]])
                hit = ranks >= 0
                if hit.any():
                    add(where[hit], ranks[hit])
        alive = sym[:n] >= 0
        count = np.concatenate([[0], np.cumsum(alive)])
        return sym[:n][alive], np.concatenate([[0], count[ends]]).astype(np.int64)


class _Index(dict):
    """Numbers keys in order of appearance."""

    def __missing__(self, key):
        i = self[key] = len(self)
        return i


class _Store:
    """Lists of integers, appended in blocks and gathered by number."""

    def __init__(self):
        self.flat, self.start = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def append(self, flat: np.ndarray, offsets: np.ndarray) -> None:
        self.start = np.concatenate([self.start, offsets[1:] + self.flat.size])
        self.flat = np.concatenate([self.flat, flat])

    def lengths(self, which: np.ndarray) -> np.ndarray:
        return self.start[which + 1] - self.start[which]

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.lengths(which)
        offsets = np.concatenate([[0], np.cumsum(n)])
        return self.flat[np.arange(offsets[-1]) + np.repeat(self.start[which] - offsets[:-1], n)], offsets


class CorpusEncoder:
    """Encodes batches of texts; remembers pieces and words between batches, within bounds."""

    def __init__(self, path: str):
        import regex

        self.encoder, self.split = PairIndexEncoder(path), regex.compile(PATTERN).findall
        self.forget()

    def forget(self) -> None:
        self.pieces, self.words, self.chars = _Index(), _Index(), 0
        self.piece_ids, self.word_ids = _Store(), _Store()

    def _learn(self, new: list[str]) -> None:
        """Ids of pieces not seen before: split into words, encode the new words together, join."""
        seen = len(self.words)
        number, split = self.words.__getitem__, self.split
        parts = [list(map(number, split(p))) for p in new]
        fresh = list(self.words)[seen:] if seen else list(self.words)
        self.word_ids.append(*self.encoder.encode([w.encode("utf-8", "surrogatepass") for w in fresh]))
        flat = np.fromiter((i for p in parts for i in p), np.int64)
        ids, at = self.word_ids.gather(flat)
        self.piece_ids.append(ids, at[np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)])

    def pieces_of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the pieces of all texts, how many each text has); the pieces are known afterwards."""
        known, number = len(self.pieces), self.pieces.__getitem__
        cut, odd, found, sizes = _PIECES.findall, _ODD_SPACE.search, [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                own = [text] if odd(text) else cut(text)
                sizes[i] = len(own)
                found.append(np.fromiter(map(number, own), np.int64, len(own)))
        if len(self.pieces) > known:
            from itertools import islice

            new = list(islice(self.pieces, known, None))
            self.chars += sum(map(len, new))
            self._learn(new)
        return (np.concatenate(found) if found else np.zeros(0, np.int64)), sizes

    def encode(self, texts: list[str | None], lengths_only: bool = False) -> tuple[np.ndarray | None, np.ndarray]:
        """(ids of all texts, offsets of the texts in them); or (None, number of ids of each)."""
        which, sizes = self.pieces_of(texts)
        ends = np.cumsum(sizes)
        if lengths_only:
            total = np.concatenate([[0], np.cumsum(self.piece_ids.lengths(which))])
            out = None, total[ends] - total[ends - sizes]
        else:
            ids, at = self.piece_ids.gather(which)
            out = ids, at[np.concatenate([[0], ends])]
        if len(self.pieces) > KNOWN_PIECES or self.chars > KNOWN_CHARS:
            self.forget()
        return out


_ENCODERS: dict[str, CorpusEncoder] = {}


def _encoder(path: str) -> CorpusEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = CorpusEncoder(path)
    return _ENCODERS[path]


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about BATCH_CHARS."""
    start, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars >= BATCH_CHARS:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _ids_of(path: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = _encoder(path)
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, j in _slices(texts):
                ids, offsets = encoder.encode(texts[i:j])
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, j - i), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))], ["id", "ids"])

    return run


def _lengths_of(path: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = _encoder(path)
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, j in _slices(texts):
                _, n = encoder.encode(texts[i:j], lengths_only=True)
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, j - i), pa.array(n, pa.int64())], ["id", "tokens"])

    return run


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_dir: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids): the token ids of each document. No shuffle beyond spreading an input of too few splits."""
    rows = spread(docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text")))
    return rows.mapInArrow(_ids_of(f"{tokenizer_dir}/{vocabulary}"), "id bigint, ids array<int>").withColumnRenamed("id", id_col)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_dir: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, tokens): the number of token ids of each document."""
    rows = spread(docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text")))
    return rows.mapInArrow(_lengths_of(f"{tokenizer_dir}/{vocabulary}"), "id bigint, tokens bigint").withColumnRenamed("id", id_col)
