"""Subword tokens of whole texts: a word-level cache in front of the tokenizer library, and overlap resynchronisation.

The tokenizer of a .json file drops white space before it forms tokens, so no token spans two
white-space separated words, and a text's ids are the ids of its words in order. Texts are therefore
split at ASCII white space, each distinct run is encoded once, and the ids are gathered back.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidewire.llm.common import as_strings, ragged, slices
from tidewire.llm.words import hashes, split

_CACHE = 1_200_000
_BATCH_BYTES = 6 << 20
_LETTER, _DIGIT, _MARK = 1, 2, 3


def _byte_symbols() -> dict[int, str]:
    """How byte-level models write each byte as a character."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _byte_classes() -> np.ndarray:
    """Class of each byte in plain words; 0: the word needs the library's whole path."""
    kind = np.zeros(256, np.uint8)
    kind[33:127] = _MARK
    kind[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = _LETTER
    kind[48:58] = _DIGIT
    kind[39] = 0
    return kind


class WordEncoder:
    """Ids of whole texts under a .json tokenizer that lower-cases and drops white space, by cached pieces.

    Plain words (ASCII without apostrophes, Latin-1 letters) are cut into runs of letters, single digits and runs
    of marks, as the tokenizer cuts them, and each new run goes once through the library's merge model. A word
    with any other character goes whole through the library's normalise, split and merge path. Runs are known by
    a 64-bit hash; the cache is bounded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        symbols = _byte_symbols()
        self.symbols = {c: "".join(symbols[b] for b in chr(c).encode()) for c in range(128, 256)}
        self.kinds = _byte_classes()
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(1, np.uint64)
        self.start, self.length = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _learn(self, h: np.ndarray, texts: list[str], plain: np.ndarray) -> None:
        ids: list = [None] * len(texts)
        tokenize, symbols = self.model.tokenize, self.symbols
        for i in np.flatnonzero(plain).tolist():
            x = texts[i]
            ids[i] = [t.id for t in tokenize(x if x.isascii() else x.translate(symbols))]
        whole = np.flatnonzero(~plain).tolist()
        for i, e in zip(whole, self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True):
            ids[i] = e.ids
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for t in ids for x in t), np.uint32, int(length.sum()))
        known = np.concatenate([self.known, h])
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(length) - length])[order]
        self.length = np.concatenate([self.length, length])[order]
        self.flat = np.concatenate([self.flat, flat])

    def entries(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each run of the texts, in order: its row, and its place in the cache."""
        if len(self.known) > _CACHE:
            self._clear()
        w = split(strings)
        if not len(w.starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        data, n = w.data, len(w.data)
        kind = self.kinds[data]
        odd = kind == 0
        after = np.zeros(n, np.uint8)
        after[1:] = data[:-1]
        odd |= (data >= 0x80) & (data < 0xC0) & (after != 0xC3)
        odd |= (after == 0xC3) & ((data == 0x97) | (data == 0xB7))
        odd |= (after == 60) & (data == 124)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        odd &= ~space
        plain_word = np.add.reduceat(odd, w.starts, dtype=np.int64) == 0
        in_plain = np.repeat(plain_word, w.ends - w.starts)
        at = ragged(w.starts, w.ends - w.starts)
        plain_at = at[in_plain]
        text = data.copy()
        b, before = data[plain_at], after[plain_at]
        raise_ = ((b >= 65) & (b <= 90)) | ((before == 0xC3) & (b >= 0x80) & (b <= 0x9E))
        text[plain_at[raise_]] += 32
        begins = np.zeros(n, bool)
        k, k_before = kind[plain_at], kind[np.maximum(plain_at - 1, 0)]
        begins[plain_at] = (k != k_before) | (k == _DIGIT)
        begins[w.starts] = True
        starts = np.flatnonzero(begins)
        word = np.cumsum(np.isin(starts, w.starts, assume_unique=True)) - 1
        ends = np.minimum(np.append(starts[1:], n), w.ends[word])
        plain = plain_word[word]
        h = hashes(text, starts, ends) ^ np.where(plain, np.uint64(0), np.uint64(0x5851F42D4C957F2D))
        place = np.searchsorted(self.known, h)
        place[place == len(self.known)] = 0
        missing = np.flatnonzero(self.known[place] != h)
        if len(missing):
            new, first = np.unique(h[missing], return_index=True)
            first = missing[first]
            raw = text.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            self._learn(new, texts, plain[first])
            place = np.searchsorted(self.known, h)
        return w.row[word], place

    def counts(self, strings: pa.Array) -> np.ndarray:
        row, place = self.entries(strings)
        return np.bincount(row, self.length[place], len(strings)).astype(np.int64)

    def flat_ids(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and ids per text."""
        row, place = self.entries(strings)
        ids = self.flat[ragged(self.start[place], self.length[place])]
        return ids, np.bincount(row, self.length[place], len(strings)).astype(np.int64)


@dataclass
class Encoding:
    """Tokens of one stretch of text: ids, and offsets in code points of the whole text."""

    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def library_encoder(path: str) -> Callable[[str], Encoding]:
    """The library's encoder with offsets for a .json or .model file."""
    if path.endswith(".model"):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)

        def encode(text: str) -> Encoding:
            pieces = processor.encode(text, return_type="proto").pieces
            table = np.array([(p.id, p.begin, p.end) for p in pieces], np.int64).reshape(-1, 3)
            raw = np.frombuffer(text.encode(), np.uint8)  # the library's offsets are in bytes
            points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            return Encoding(table[:, 0], points[table[:, 1]], points[table[:, 2]])

        return encode
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def encode(text: str) -> Encoding:
        got = tokenizer.encode(text, add_special_tokens=False)
        spans = np.array(got.offsets, np.int64).reshape(-1, 2)
        return Encoding(np.array(got.ids, np.int64), spans[:, 0], spans[:, 1])

    return encode


#: One blank between two characters that are not white space: here a token ends and another begins, whatever
#: stands further left or right, under word, byte-level and sentence-piece models alike.
_STABLE = re.compile(r"(?<=\S) (?=\S)")


def _within(e: Encoding, lo: int, hi: int) -> np.ndarray:
    a, b = np.searchsorted(e.starts, lo), np.searchsorted(e.starts, hi)
    return np.stack([e.ids[a:b], e.starts[a:b]])


def splice_point(text: str, left: Encoding, right: Encoding, lo: int, hi: int) -> int | None:
    """A stable boundary in [lo, hi) where both encodings agree up to the next stable boundary, or None."""
    points = [m.start() for m in _STABLE.finditer(text, max(lo, 1), hi) if m.start() > lo]
    middle = len(points) // 2
    for k in sorted(range(len(points) - 1), key=lambda k: abs(k - middle)):
        a, b = points[k], points[k + 1]
        x, y = _within(left, a, b), _within(right, a, b)
        split = any(((e.starts < a) & (e.ends > a + 1)).any() for e in (left, right))
        if not split and x.shape == y.shape and x.size and (x == y).all():
            return a
    return None


def resynchronised(text: str, encode: Callable[[str], Encoding], chunk: int = 32_768, overlap: int = 512) -> Iterator[Encoding]:
    """Encode a long text in overlapping chunks, and yield the spliced stretches in order.

    Neighbouring chunks are joined where both have a proven stable boundary and agree on the tokens after it.
    Where they do not align, the overlap is doubled; once it would reach the left chunk's start, left and right
    are encoded together. Memory is bounded by the chunk, or by the longest stretch without a stable boundary.
    """

    def run(lo: int, hi: int) -> Encoding:
        e = encode(text[lo:hi])
        return Encoding(e.ids, e.starts + lo, e.ends + lo)

    n = len(text)
    begin, keep, end = 0, 0, min(chunk, n)
    left = run(begin, end)
    while end < n:
        width, stop = overlap, min(n, end - overlap + chunk)
        while True:
            start = end - width
            if start <= keep:
                stop = min(n, end + max(chunk, end - begin))
                left, end = run(begin, stop), stop
                break
            right = run(start, stop)
            at = splice_point(text, left, right, start, end)
            if at is not None:
                a, b = np.searchsorted(left.starts, keep), np.searchsorted(left.starts, at)
                yield Encoding(left.ids[a:b], left.starts[a:b], left.ends[a:b])
                left, begin, keep, end = right, start, at, stop
                break
            width *= 2
    a = np.searchsorted(left.starts, keep) if keep else 0
    yield Encoding(left.ids[a:], left.starts[a:], left.ends[a:])


def token_counts(
    docs: DataFrame, path: str, text: str = "text", limit: int = 2048, chunk: int = 32_768, overlap: int = 512
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text, as the tokenizer library counts them.

    A text of up to `chunk` code points is encoded at once (.json files of the word family through the word
    cache); a longer one in overlapping chunks, by `resynchronised`. A null text counts as empty: 0 bytes, 0
    tokens. Repeated rows give repeated results; null ids stay null; other columns are ignored.
    """

    family = of_word_family(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library_encoder(path)
        words = WordEncoder(path) if family else None
        for batch in batches:
            strings = as_strings(batch.column(1))
            for lo, hi in slices(strings, _BATCH_BYTES):
                part = strings.slice(lo, hi - lo)
                size = pc.utf8_length(part).to_numpy()
                n = np.zeros(len(part), np.int64)
                short = np.flatnonzero(size <= chunk)
                if len(short):
                    these = part.take(pa.array(short))
                    n[short] = words.counts(these) if words else [len(encode(x).ids) for x in these.to_pylist()]
                for i in np.flatnonzero(size > chunk):
                    n[i] = sum(len(e.ids) for e in resynchronised(part[int(i)].as_py(), encode, chunk, overlap))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pc.binary_length(part).cast(pa.int64()), pa.array(n), pa.array(n > limit)],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).cast("string")).mapInArrow(run, f"doc_id {key}, n_bytes long, n_tokens long, over_limit boolean")


def drops_white_space(path: str) -> bool:
    """Whether the .json tokenizer lower-cases and drops white space before it forms tokens (the word family).

    Told by probes, of case as of space: a cased tokenizer with word ends is not of this family.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    folds = all(ids(x) == ids(x.lower()) for x in ("A", "Zebra QUIZ", "É Ü", "McX"))
    return bool(getattr(tokenizer.model, "end_of_word_suffix", None)) and folds and ids("a  b\n c") == [x for w in "abc" for x in ids(w)]


class PlainEncoder:
    """Ids of whole texts under any tokenizer file, by the library itself."""

    def __init__(self, path: str):
        self.encode = library_encoder(path)

    def flat_ids(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.asarray(self.encode(t).ids, np.uint32) for t in strings.to_pylist()]
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.array([len(x) for x in ids], np.int64)


def of_word_family(path: str) -> bool:
    """Asked once, on the driver: a task that asks would hold two tokenizers."""
    return path.endswith(".json") and drops_white_space(path)
