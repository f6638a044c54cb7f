"""LM scoring: a sharded Elias-Fano trigram trie, counted, built and queried without any table on the driver.

Documents are packed into groups of bounded size, a group a row of a written table. A group counts its distinct words,
pairs and triples and sends them, sorted and packed, to shards; all n-grams that begin with a word live in the word's
shard, those of hot words in shards by their second word. A shard adds the counts, builds its trie, and answers each
group's keys by search in it; the answers go back to the group, where texts are scored.

The trie has three levels. Words are a monotone sequence of hashes. The successors of a context are a range of the next
level's sequence, bounded by monotone pointers; a successor is stored relative to its context (added to the last
value of the range before), so that the level is monotone too, and it is searched inside its context's range alone.
Beside the successors stand quantised probabilities, smoothed by absolute discounting: a code a byte for what a seen
n-gram keeps, and the context's share for the lower order. All levels are one buffer, which may be mapped memory.
"""

from __future__ import annotations

import math
import mmap
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tidewire.llm.common import Scratch, as_strings, fold_of, ragged, utf8_view
from tidewire.llm.words import hashes, lowered, split

_START = np.uint64(0x51A7E0000000A11D)
_END = np.uint64(0xE4D0E4D0E4D0E4D1)
_LOW = np.uint64(0xFFFFFFFF)
DISCOUNT = 0.75
_STEPS = 6  # codes an octave
_TOGETHER = 150_000  # pairs that a shard answers in one go


def pack_counts(a: np.ndarray) -> bytes:
    """Small counts in a byte each; larger ones in a list of exceptions."""
    large = np.flatnonzero(a > 254)
    small = a.astype(np.uint8)
    small[large] = 255
    return b"".join([np.uint32(len(a)).tobytes(), small.tobytes(), large.astype(np.uint32).tobytes(), a[large].astype(np.uint64).tobytes()])


def unpack_counts(blob: bytes) -> np.ndarray:
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    out = np.frombuffer(blob, np.uint8, n, 4).astype(np.int64)
    large = (len(blob) - 4 - n) // 12
    if large:
        at = np.frombuffer(blob[4 + n : 4 + n + 4 * large], np.uint32)
        out[at] = np.frombuffer(blob[4 + n + 4 * large :], np.uint64).astype(np.int64)
    return out


_SELECTED = 1 << 15  # places that are looked for at a time
_EACH, _TOP = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
_PLACE = np.argsort(1 - np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int8), axis=1, kind="stable")  # of a byte's k-th 1


@dataclass
class EliasFano:
    """A sorted sequence of 64-bit numbers: low bits packed, high bits in unary. All arrays may view mapped memory."""

    n: int
    low_bits: int
    lows: np.ndarray  # bytes
    highs: np.ndarray  # 64-bit words; one 1 per number, one 0 per step of the high part
    ranks: tuple[np.ndarray, np.ndarray] | None = None  # numbers, and steps, before each word of the unary part; made on first use

    @staticmethod
    def build(a: np.ndarray) -> EliasFano:
        n = len(a)
        top = int(a[-1]) + 1 if n else 1
        low_bits = max(0, int(math.floor(math.log2(top / n)))) if n else 0
        mask = np.uint64((1 << low_bits) - 1)
        if low_bits and n:
            bits = ((a & mask)[:, None] >> np.arange(low_bits, dtype=np.uint64)[None, :]).astype(np.uint8) & 1
            lows = np.packbits(bits.ravel(), bitorder="little")
        else:
            lows = np.zeros(0, np.uint8)
        high = (a >> np.uint64(low_bits)).astype(np.int64)
        unary = np.zeros(-(-((int(high[-1]) if n else 0) + n + 1) // 64) * 64, np.uint8)
        unary[high + np.arange(n)] = 1
        return EliasFano(n, low_bits, np.concatenate([lows, np.zeros(8, np.uint8)]), np.packbits(unary, bitorder="little").view(np.uint64))

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.lows), self.highs.nbytes], np.int64)
        return head.tobytes() + self.lows.tobytes() + self.highs.tobytes()

    @staticmethod
    def read(buffer: memoryview | bytes, at: int = 0) -> tuple[EliasFano, int]:
        n, low_bits, a, b = np.frombuffer(buffer, np.int64, 4, at).tolist()
        lows = np.frombuffer(buffer, np.uint8, a, at + 32)
        return EliasFano(n, low_bits, lows, np.frombuffer(buffer, np.uint8, b, at + 32 + a).view(np.uint64)), at + 32 + a + b

    def low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        bit = i.astype(np.int64) * self.low_bits
        at, shift = bit >> 3, (bit & 7).astype(np.uint64)
        out = np.zeros(len(i), np.uint64)
        for k in range((self.low_bits + 7) // 8 + 1):
            part = self.lows[np.minimum(at + k, len(self.lows) - 1)].astype(np.uint64)
            if 8 * k < 64:
                moved = part << np.uint64(8 * k)
                out |= (moved >> shift) if k == 0 else np.where(shift > 0, (part << (np.uint64(8 * k) - shift)), moved)
            else:
                out |= np.where(shift > 0, part << (np.uint64(64) - shift), np.uint64(0))
        return out & np.uint64((1 << self.low_bits) - 1) if self.low_bits < 64 else out

    def _select(self, k: np.ndarray, zeros: bool = False) -> np.ndarray:
        """The bit at which the k-th number, or step, of the unary part stands: a search of the words' ranks, and then of
        one word, whose bytes' running counts are summed and compared side by side."""
        if self.ranks is None:
            ones = np.concatenate([np.zeros(1, np.uint32), np.cumsum(np.bitwise_count(self.highs), dtype=np.uint32)])
            self.ranks = ones, np.arange(len(ones), dtype=np.uint32) * np.uint32(64) - ones
        before = self.ranks[int(zeros)]
        out = np.empty(len(k), np.int64)
        for lo in range(0, len(k), _SELECTED):
            part = k[lo : lo + _SELECTED].astype(np.uint32)
            word = np.searchsorted(before, part, "right") - 1
            rest = (part - before[word]).astype(np.uint64)
            held = self.highs[word]
            held = ~held if zeros else held
            running = held - ((held >> np.uint64(1)) & np.uint64(0x5555555555555555))
            running = (running & np.uint64(0x3333333333333333)) + ((running >> np.uint64(2)) & np.uint64(0x3333333333333333))
            running = ((running + (running >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _EACH
            byte = np.bitwise_count(((rest * _EACH | _TOP) - running) & _TOP).astype(np.uint64) * np.uint64(8)
            rest -= ((running << np.uint64(8)) >> byte) & np.uint64(255)
            out[lo : lo + _SELECTED] = word * 64 + byte.astype(np.int64) + _PLACE[((held >> byte) & np.uint64(255)).astype(np.int64), rest.astype(np.int64)]
        return out

    def access(self, i: np.ndarray) -> np.ndarray:
        """The numbers at the given places."""
        return ((self._select(i) - i).astype(np.uint64) << np.uint64(self.low_bits)) | self.low(i) if self.low_bits < 64 else self.low(i)

    def heads(self, high: np.ndarray) -> np.ndarray:
        """How many numbers have a smaller high part: what stands before that many steps."""
        out = np.zeros(len(high), np.int64)
        some = high > 0
        out[some] = self._select(high[some] - 1, zeros=True) - (high[some] - 1)
        return out

    def values(self) -> np.ndarray:
        return self.access(np.arange(self.n))

    def successor(self, x: np.ndarray, start: np.ndarray | None = None, stop: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each x, the place of the first number not below it, and whether that number is x; with bounds, x is
        looked for between two places alone, and the place is of use only where it is found."""
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        last = int(self._select(np.array([self.n - 1]))[0]) - (self.n - 1)
        high = (x >> np.uint64(self.low_bits)).astype(np.int64) if self.low_bits < 64 else np.zeros(len(x), np.int64)
        beyond = (high > last) | (high < 0)
        high = np.where(beyond, last, high)
        want = x & np.uint64((1 << self.low_bits) - 1)
        lo, hi = self.heads(high), np.where(high < last, self.heads(np.minimum(high + 1, last)), self.n)
        if start is not None:
            lo, hi = np.maximum(lo, start), np.minimum(hi, stop)
        lo, limit = lo.copy(), hi.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            less = self.low(mid) < want[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        found = (lo < limit) & ~beyond
        at = np.flatnonzero(found)
        found[at] = self.low(lo[at]) == want[at]
        return np.where(beyond, self.n, lo), found


def kept(counts: np.ndarray, totals: np.ndarray | float = 1.0) -> np.ndarray:
    """Codes of what seen n-grams keep: (count - DISCOUNT) / total, rounded down to a step; never 0, which means unseen."""
    octaves = np.log2((counts - DISCOUNT) / totals)
    return np.clip(np.floor(octaves * _STEPS + 1e-9) + _BIAS, 1, 255).astype(np.uint8)


_BIAS = 1 + 2 * _STEPS  # pairs are coded before they are divided by their context's total: 0.25 is the least
_TRIPLE_BIAS = 255  # triples are coded as probabilities: 1 is the most
_PAIR_LEVELS = np.append(0.0, 2.0 ** ((np.arange(1, 256) - _BIAS) / _STEPS))
_TRIPLE_LEVELS = np.append(0.0, 2.0 ** ((np.arange(1, 256) - _TRIPLE_BIAS) / _STEPS))


def kept_triples(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(np.log2((counts - DISCOUNT) / totals) * _STEPS + 1e-9) + _TRIPLE_BIAS, 1, 255).astype(np.uint8)


@dataclass
class Level:
    """Successors of contexts: pointers to each context's range, and the successors relative to it, in one sequence."""

    pointers: EliasFano
    successors: EliasFano

    @staticmethod
    def build(fans: np.ndarray, successors: np.ndarray) -> Level:
        """`fans`: how many successors each context has; `successors`: theirs (32 bits), ascending within a context."""
        ends = np.cumsum(fans)
        last = np.zeros(len(fans), np.uint64)
        some = fans > 0
        last[some] = successors[ends[some] - 1] + np.uint64(1)
        base = np.cumsum(last) - last
        return Level(EliasFano.build(np.append(0, ends).astype(np.uint64)), EliasFano.build(np.repeat(base, fans) + successors))

    def find(self, context: np.ndarray, successor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of successors, each searched in its context's range, and which of them are there."""
        if not self.successors.n:
            return np.zeros(len(context), np.int64), np.zeros(len(context), bool)
        fresh = np.ones(len(context), bool)
        fresh[1:] = context[1:] != context[:-1]  # n-grams of a context come together
        own, of = context[fresh], np.cumsum(fresh) - 1
        start, stop = self.pointers.access(own).astype(np.int64), self.pointers.access(own + 1).astype(np.int64)
        before = np.where(start > 0, self.successors.access(np.maximum(start - 1, 0)) + np.uint64(1), np.uint64(0))
        return self.successors.successor(before[of] + successor, start[of], stop[of])


@dataclass
class Trie:
    """Words (hot ones that only lead n-grams here come with count 0), pairs and triples of one shard."""

    words: EliasFano
    word_counts: np.ndarray  # exact: the base score needs them
    pairs: Level
    pair_codes: np.ndarray
    pair_shares: np.ndarray  # of each word as a context: what its seen pairs keep in sum, before division by its total
    triples: Level
    triple_codes: np.ndarray
    triple_shares: np.ndarray  # of each pair as a context: what it leaves to the lower order

    @staticmethod
    def build(words: np.ndarray, word_counts: np.ndarray, pair_fans: np.ndarray, seconds: np.ndarray, pair_counts: np.ndarray, triple_fans: np.ndarray, thirds: np.ndarray, triple_counts: np.ndarray) -> Trie:
        """All arrays sorted as the trie is; counts of words may be 0, those of pairs and triples not."""
        word_of, pair_of = np.repeat(np.arange(len(words)), pair_fans), np.repeat(np.arange(len(seconds)), triple_fans)
        codes = kept(pair_counts)
        totals = np.bincount(pair_of, triple_counts, len(seconds))
        triple_codes = kept_triples(triple_counts, totals[pair_of]) if len(thirds) else np.zeros(0, np.uint8)
        left = 1 - np.bincount(pair_of, _TRIPLE_LEVELS[triple_codes], len(seconds))
        return Trie(
            EliasFano.build(words), word_counts.astype(np.uint64), Level.build(pair_fans, seconds), codes, np.bincount(word_of, _PAIR_LEVELS[codes], len(words)),
            Level.build(triple_fans, thirds), triple_codes, left.astype(np.float16),
        )

    def to_bytes(self) -> bytes:
        sequences = (self.words, self.pairs.pointers, self.pairs.successors, self.triples.pointers, self.triples.successors)
        plain = (self.word_counts, self.pair_shares, self.triple_shares, self.pair_codes, self.triple_codes)
        return b"".join([*(q.to_bytes() for q in sequences), *(a.tobytes() for a in plain)])

    @staticmethod
    def read(buffer: memoryview | bytes | mmap.mmap) -> Trie:
        """A trie over mapped or plain memory; the levels stay where they are."""
        at, sequences = 0, []
        for _ in range(5):
            one, at = EliasFano.read(buffer, at)
            sequences.append(one)
        words, p2, s2, p3, s3 = sequences
        plain = []
        for kind, n in ((np.uint64, words.n), (np.float64, words.n), (np.float16, s2.n), (np.uint8, s2.n), (np.uint8, s3.n)):
            plain.append(np.frombuffer(buffer, np.uint8, n * np.dtype(kind).itemsize, at).view(kind) if n else np.zeros(0, kind))
            at += n * np.dtype(kind).itemsize
        counts, shares, left, codes2, codes3 = plain
        return Trie(words, counts, Level(p2, s2), codes2, shares, Level(p3, s3), codes3, left)

    @staticmethod
    def mapped(blob: bytes | None = None, path: str | None = None) -> Trie:
        """A trie over mapped memory: of a file, or of a buffer that is moved there."""
        if path is not None:
            with open(path, "rb") as f:
                return Trie.read(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        area = mmap.mmap(-1, max(1, len(blob)))
        area.write(blob)
        return Trie.read(area)

    def answer(self, lead: np.ndarray, pair_fans: np.ndarray, seconds: np.ndarray, triple_fans: np.ndarray, thirds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For n-grams laid out as in the trie (leading words' hashes, and successors by fans): shares of the leading
        words, codes of pairs, what pairs leave as contexts (1 where unseen), and codes of triples; 0 for unseen n-grams."""
        word, known = self.words.successor(lead)
        shares = np.zeros(len(lead))
        shares[known] = self.pair_shares[word[known]]
        of = np.repeat(np.arange(len(lead)), pair_fans)
        pair, pair_known = np.zeros(len(seconds), np.int64), np.zeros(len(seconds), bool)
        ask = np.flatnonzero(known[of])
        pair[ask], pair_known[ask] = self.pairs.find(word[of[ask]], seconds[ask])
        codes, left = np.zeros(len(seconds), np.uint8), np.ones(len(seconds), np.float16)
        codes[pair_known], left[pair_known] = self.pair_codes[pair[pair_known]], self.triple_shares[pair[pair_known]]
        of = np.repeat(np.arange(len(seconds)), triple_fans)
        ask = np.flatnonzero(pair_known[of])
        at, hit = self.triples.find(pair[of[ask]], thirds[ask])
        triple_codes = np.zeros(len(thirds), np.uint8)
        triple_codes[ask[hit]] = self.triple_codes[at[hit]]
        return shares, codes, left, triple_codes


def _small(a: np.ndarray | bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(a if isinstance(a, bytes) else a.tobytes())


def _whole(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of the upper half of the hash, so that sorted words are sorted by shard."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


@dataclass
class Grams:
    """A group's tokens, and its distinct words, pairs and triples in the order in which shards see them."""

    per_text: np.ndarray
    words: np.ndarray  # distinct, ascending
    word_of: np.ndarray  # of each token
    lead: np.ndarray  # of distinct (shard, leading word): the word's hash, with the shard
    lead_shard: np.ndarray
    lead_of: np.ndarray  # of each distinct pair
    second: np.ndarray  # of distinct pairs, 32 bits
    pair_of: np.ndarray  # of each token, with its predecessor
    third: np.ndarray  # of distinct triples
    pair_of_triple: np.ndarray  # their leading pairs
    triple_of: np.ndarray  # of each token that has two predecessors; -1 for the others
    before: np.ndarray  # the predecessor's word, -1 at a text's start


def _distinct(major: np.ndarray, minor: np.ndarray, minors: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (major, minor) in order, as two arrays, and each element's place among them."""
    keys = major.astype(np.uint64)
    keys *= np.uint64(minors)
    keys += minor.astype(np.uint64)
    keys, of = np.unique(keys, return_inverse=True)
    return (keys // np.uint64(minors)).astype(np.int64), (keys % np.uint64(minors)).astype(np.int64), of.astype(np.int32)


def grams(strings: pa.Array, shards: int, hot: np.ndarray) -> Grams:
    """`hot`: sorted hashes of the words whose n-grams are dealt by their second word."""
    w = split(strings)
    per = w.per_row + 1
    ends = np.cumsum(per) - 1
    begins = ends - per + 1
    tokens = np.empty(int(per.sum()), np.uint64)
    inside = np.ones(len(tokens), bool)
    inside[ends] = False
    tokens[inside] = hashes(lowered(w.data), w.starts, w.ends)
    tokens[ends] = _END
    words, word_of = np.unique(tokens, return_inverse=True)
    word_of = word_of.astype(np.int32)
    del tokens, inside
    before = np.empty(len(word_of), np.int32)
    before[1:] = word_of[:-1]
    before[begins] = -1
    # Successors go by 32 bits of their hash: words are numbered in that order for the n-grams.
    short = words & _LOW
    by_short, rank = np.unique(short, return_inverse=True)
    home = shard_of(words, shards)
    spread = np.append(np.isin(words, hot), True)  # the start of a text is a context of its own, and hot
    lead_word = np.where(before < 0, len(words), before)
    shard = np.where(spread[lead_word], home[word_of], np.append(home, 0)[lead_word])
    order = np.append(np.arange(len(words)) + (words > _START), np.searchsorted(words, _START))  # the start among the words
    slot_word = np.empty(len(words) + 1, np.uint64)
    slot_word[order] = np.append(words, _START)
    lead_shard, lead_slot, lead_at = _distinct(shard, order[lead_word], len(words) + 1)
    del shard, lead_word
    lead_of, second, pair_of = _distinct(lead_at, rank[word_of], len(by_short))
    del lead_at
    inner = np.flatnonzero(before >= 0)
    pair_of_triple, third, inner_of = _distinct(pair_of[inner - 1], rank[word_of[inner]], len(by_short))
    triple_of = np.full(len(word_of), -1, np.int32)
    triple_of[inner] = inner_of
    return Grams(per, words, word_of, slot_word[lead_slot], lead_shard, lead_of, by_short[second], pair_of, by_short[third], pair_of_triple, triple_of, before)


def _cuts(shard: np.ndarray, shards: int) -> np.ndarray:
    return np.searchsorted(shard, np.arange(shards + 1))


def _layout(g: Grams, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where each shard's words, leading words, pairs and triples begin."""
    words, lead = _cuts(shard_of(g.words, shards), shards), _cuts(g.lead_shard, shards)
    pairs = np.searchsorted(g.lead_of, lead)
    return words, lead, pairs, np.searchsorted(g.pair_of_triple, pairs)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of all parts, their added counts, and the place of every part's key among them."""
    distinct, of = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(of, np.concatenate(counts), len(distinct)).astype(np.int64), of


_PARTS = ("word", "word_count", "lead", "pair_fan", "second", "pair_count", "triple_fan", "third", "triple_count")
_SENT = "shard int, text_group long, " + ", ".join(f"{c} binary" for c in _PARTS)
_BACK = "text_group long, shard int, words binary, shares binary, pairs binary, left binary, triples binary, types long, tokens long, trie binary"


def _leads(lead: np.ndarray, words: np.ndarray) -> bytes:
    """Leading words: a bit for each of the shard's words, and the hashes of the few that live elsewhere."""
    own = np.isin(words, lead, assume_unique=True)
    return np.packbits(own).tobytes() + lead[~np.isin(lead, words[own], assume_unique=True)].tobytes()


def _from_leads(blob: bytes, words: np.ndarray) -> np.ndarray:
    bits = (len(words) + 7) // 8
    own = np.unpackbits(np.frombuffer(blob, np.uint8, bits), count=len(words)).astype(bool)
    return np.sort(np.concatenate([words[own], np.frombuffer(blob[bits:], np.uint64)]))


def _message(g: Grams, counts: tuple[np.ndarray, ...], cuts: tuple[np.ndarray, ...], s: int) -> tuple:
    words, pairs, triples = counts
    w, c, p, t = (slice(x[s], x[s + 1]) for x in cuts)
    pair_fan = np.bincount(g.lead_of[p] - c.start, minlength=c.stop - c.start)
    triple_fan = np.bincount(g.pair_of_triple[t] - p.start, minlength=p.stop - p.start)
    return (
        g.words[w].tobytes(), pack_counts(words[w]), _leads(g.lead[c], g.words[w]), pack_counts(pair_fan), _small(g.second[p].astype(np.uint32)), pack_counts(pairs[p]),
        pack_counts(triple_fan), _small(g.third[t].astype(np.uint32)), pack_counts(triples[t]),
    )


@dataclass
class Asked:
    """One group's n-grams as a shard sees them."""

    words: np.ndarray
    word_counts: np.ndarray
    lead: np.ndarray
    pair_fans: np.ndarray
    seconds: np.ndarray
    pair_counts: np.ndarray
    triple_fans: np.ndarray
    thirds: np.ndarray
    triple_counts: np.ndarray

    @staticmethod
    def read(row: dict) -> Asked:
        words = np.frombuffer(row["word"], np.uint64)
        short = lambda c: np.frombuffer(_whole(row[c]), np.uint32).astype(np.uint64)
        return Asked(words, unpack_counts(row["word_count"]), _from_leads(row["lead"], words), unpack_counts(row["pair_fan"]), short("second"), unpack_counts(row["pair_count"]), unpack_counts(row["triple_fan"]), short("third"), unpack_counts(row["triple_count"]))


def build_shard(asked: list[Asked]) -> tuple[Trie, bytes]:
    """The shard's trie from all groups' n-grams, and the bytes it lies in; n-grams that no training text has are left out."""
    every, total, _ = _merged([x for a in asked for x in (a.words, a.lead)], [x for a in asked for x in (a.word_counts, np.zeros(len(a.lead), np.int64))])
    lead = [np.repeat(np.searchsorted(every, a.lead), a.pair_fans).astype(np.uint64) << np.uint64(32) for a in asked]
    pairs, pair_total, of = _merged([x | a.seconds for x, a in zip(lead, asked, strict=True)], [a.pair_counts for a in asked])
    del lead
    rank, seen = np.cumsum(pair_total > 0) - 1, pair_total > 0
    places, lo = [], 0
    for a in asked:
        places.append(np.repeat(of[lo : lo + len(a.seconds)], a.triple_fans))
        lo += len(a.seconds)
    heads = [np.where(seen[x], rank[x], 0) for x in places]  # a pair that no training text has leads no training triple
    triples, triple_total, _ = _merged([(x.astype(np.uint64) << np.uint64(32)) | a.thirds for x, a in zip(heads, asked, strict=True)], [a.triple_counts for a in asked])
    del places, heads, of
    pairs, pair_total = pairs[seen], pair_total[seen]
    triples, triple_total = triples[triple_total > 0], triple_total[triple_total > 0]
    pair_fans = np.bincount((pairs >> np.uint64(32)).astype(np.int64), minlength=len(every))
    triple_fans = np.bincount((triples >> np.uint64(32)).astype(np.int64), minlength=len(pairs))
    used = (total > 0) | (pair_fans > 0)
    blob = Trie.build(every[used], total[used], pair_fans[used], pairs & _LOW, pair_total, triple_fans, triples & _LOW, triple_total).to_bytes()
    return Trie.mapped(blob), blob


def _groups(docs: DataFrame, text: str, key: str, group_bytes: int, scratch: Scratch) -> DataFrame:
    """(text_group, ids, folds, body): texts packed, in the order in which tasks read them, into rows of about
    `group_bytes` of text, compressed; a longer text has a row of its own."""
    body = docs.select("doc_id", fold_of(F.col("doc_id")).alias("fold"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def row() -> pa.RecordBatch:
            ids, folds = pa.concat_arrays([b.column(0) for b in held]), pa.concat_arrays([b.column(1) for b in held])
            data, offsets = utf8_view(as_strings(pa.concat_arrays([as_strings(b.column(2)) for b in held])))
            blob = _small(np.diff(offsets).astype(np.int64).tobytes() + data.tobytes(), 7)
            one = np.array([0, len(ids)], np.int32)
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.ListArray.from_arrays(one, ids), pa.ListArray.from_arrays(one, folds), pa.array([blob], pa.binary())], names=["text_group", "ids", "folds", "body"])

        for batch in batches:
            _, offsets = utf8_view(as_strings(batch.column(2)))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + group_bytes - size, "right")) - 1)
                held.append(batch.slice(lo, hi - lo))
                size += int(offsets[hi] - offsets[lo]) + 16 * (hi - lo)
                lo = hi
                if size >= group_bytes * 0.95:
                    yield row()
                    number, held, size = number + 1, [], 0
        if held:
            yield row()

    return scratch.keep(body.mapInArrow(pack, f"text_group long, ids array<{key}>, folds array<int>, body binary"))


def _texts(blob: bytes, n: int) -> pa.Array:
    raw = _whole(blob)
    offsets = np.append(0, np.cumsum(np.frombuffer(raw, np.int64, n))).astype(np.int32)
    return pa.StringArray.from_buffers(n, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw[8 * n :]))


def score(
    docs: DataFrame, text: str = "text", held_out: int = 1, group_bytes: int = 4 << 20, shard_bytes: int = 6 << 20, keep_model: str | None = None
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, a row per document.

    Learns from documents whose fold (crc32 of the id's text, modulo 5) is not `held_out`. Tokens are white-space separated
    words in lower case (A-Z) and one end a text, so an empty or null text is its end alone. base_score sums the
    add-a-half unigram logs. score sums log10 of the trigram model, smoothed by absolute discounting at each order:
    P(w | u, v) = kept(u, v, w) + left(u, v) * P(w | v), and so on down to the unigrams of the base; the first token has
    the start of the text as its only context. `kept` is the trie's quantised value, rounded down, and `left` what
    the rounded values leave, so each distribution sums to one (to the half-precision of `left`).

    Words are known by 64-bit hashes, successors within a context by 32 bits of them. `keep_model` names a folder for the
    tries. Repeated rows count and score each; null ids train; an empty table gives an empty result; other columns
    are ignored, whatever their names. Which words are dealt as hot is told from at most some 16 groups; it moves n-grams
    between shards and changes no result. A text of more than `group_bytes` is held whole in one task, at some 60
    times its size.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    key = docs.schema["doc_id"].dataType.simpleString()
    groups = _groups(docs, text, key, group_bytes, scratch)
    size = groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.aggregate("folds", F.lit(0).cast("long"), lambda n, f: n + (f != held_out).cast("long"))), F.lit(0)).alias("texts")).first()
    shards = max(1, math.ceil(2.5 * size.bytes / shard_bytes))
    texts = int(size.texts)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, blob in zip([len(x) for x in batch.column(0).to_pylist()], batch.column(1).to_pylist(), strict=True):
                w = split(_texts(blob, n))
                words, counts = np.unique(hashes(lowered(w.data), w.starts, w.ends), return_counts=True)
                often = np.flatnonzero(counts * shards >= counts.sum())  # at most `shards` words
                yield pa.RecordBatch.from_arrays([pa.array(words[often].astype(np.int64)), pa.array((counts[often] / counts.sum()).astype(np.float64))], names=["word", "share"])

    every = max(1, size.groups // 16)
    asked = groups.where(F.pmod(F.xxhash64("text_group"), F.lit(every)) == 0) if every > 1 else groups
    told = asked.select("folds", "body").mapInArrow(frequent, "word long, share double").groupBy("word").agg(F.sum("share").alias("share"))
    hot = np.sort(np.array([r.word for r in told.orderBy(F.desc("share")).limit(shards).collect()], np.int64).view(np.uint64)) if shards > 1 else np.zeros(0, np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                id_, folds, blob = (batch.column(c)[i].as_py() for c in ("text_group", "folds", "body"))
                g = grams(_texts(blob, len(folds)), shards, hot)
                train = np.repeat(np.array(folds) != held_out, g.per_text)
                inner = train & (g.triple_of >= 0)
                counts = (
                    np.bincount(g.word_of[train], minlength=len(g.words)), np.bincount(g.pair_of[train], minlength=len(g.second)), np.bincount(g.triple_of[inner], minlength=len(g.third))
                )
                cuts = _layout(g, shards)
                rows = [(s, id_, *_message(g, counts, cuts, s)) for s in range(shards) if cuts[0][s] < cuts[0][s + 1] or cuts[1][s] < cuts[1][s + 1]]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[2:])], names=["shard", "text_group", *_PARTS])

    def answer(group: pa.Table) -> pa.Table:
        shard = group["shard"][0].as_py()
        ids = group["text_group"].to_pylist()
        sent = [Asked.read(row) for row in group.select(list(_PARTS)).to_pylist()]
        del group
        trie, blob = build_shard(sent)
        leads = np.isin(hot, trie.words.values()) if len(hot) else np.zeros(0, bool)
        split_ = np.append(hot[leads], _START)
        at, there = trie.words.successor(split_)
        partial = [(w, float(trie.pair_shares[i])) for w, i, yes in zip(split_.astype(np.int64).tolist(), at.tolist(), there.tolist(), strict=True) if yes]
        hot_words, hot_shares = np.array([w for w, _ in partial], np.int64), np.array([v for _, v in partial])
        rows = [(-1, shard, hot_words.tobytes(), hot_shares.tobytes(), b"", b"", b"", int((trie.word_counts > 0).sum()), int(trie.word_counts.sum()), blob if keep_model else b"")]
        lo = 0
        while lo < len(sent):  # small messages are answered together
            hi, size = lo, 0
            while hi < len(sent) and size < _TOGETHER:
                size += len(sent[hi].seconds)
                hi += 1
            some = sent[lo:hi]
            place, found = trie.words.successor(np.concatenate([a.words for a in some]))
            counts = np.zeros(len(place), np.int64)
            counts[found] = trie.word_counts[place[found]]
            got = trie.answer(*(np.concatenate([getattr(a, c) for a in some]) for c in ("lead", "pair_fans", "seconds", "triple_fans", "thirds")))
            parts = [np.split(counts, np.cumsum([len(a.words) for a in some])[:-1])]
            parts += [np.split(x, np.cumsum([len(getattr(a, c)) for a in some])[:-1]) for x, c in zip(got, ("lead", "seconds", "seconds", "thirds"), strict=True)]
            for id_, n, share, code, left, triple in zip(ids[lo:hi], *parts, strict=True):
                rows.append((id_, shard, pack_counts(n), _small(share.astype(np.float32)), _small(code), _small(left), _small(triple), 0, 0, b""))
            lo = hi
        columns = list(zip(*rows, strict=True))
        types = [pa.int64(), pa.int32(), *[pa.binary()] * 5, pa.int64(), pa.int64(), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in _BACK.split(", ")])

    counted = groups.select("text_group", "folds", "body").mapInArrow(count, _SENT)
    answers = scratch.keep(counted.groupBy("shard").applyInArrow(answer, _BACK))
    summaries = answers.where("text_group < 0")
    if keep_model:
        summaries.select("shard", "trie").write.mode("overwrite").parquet(keep_model)
    whole = summaries.agg(F.coalesce(F.sum("types"), F.lit(0)).alias("types"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
    n_train, denominator = int(whole.tokens), whole.tokens + 0.5 * (whole.types + 1)

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(b, np.int64) for b in batch.column(0).to_pylist())])
            shares = np.concatenate([np.zeros(0), *(np.frombuffer(b, np.float64) for b in batch.column(1).to_pylist())])
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(shares)], names=["word", "share"])

    # What the pairs of split contexts keep over all shards: at most a row a hot word.
    added = summaries.select("words", "shares").mapInArrow(partials, "word long, share double").groupBy("word").agg(F.sum("share").alias("share")).collect()
    spread = {r.word: r.share for r in added}

    def finish(group: pa.Table, back: pa.Table) -> pa.Table:
        folds = np.array(group["folds"][0].as_py(), np.int64)
        g = grams(_texts(group["body"][0].as_py(), len(folds)), shards, hot)
        words, lead, pairs, triples = _layout(g, shards)
        counts, shares = np.zeros(len(g.words), np.int64), np.zeros(len(g.lead))
        codes, left, triple_codes = np.zeros(len(g.second), np.uint8), np.ones(len(g.second), np.float16), np.zeros(len(g.third), np.uint8)
        for s, w, c, p, l, t in zip(*(back[k].to_pylist() for k in ("shard", "words", "shares", "pairs", "left", "triples")), strict=True):  # noqa: E741
            counts[words[s] : words[s + 1]] = unpack_counts(w)
            shares[lead[s] : lead[s + 1]] = np.frombuffer(_whole(c), np.float32)
            codes[pairs[s] : pairs[s + 1]] = np.frombuffer(_whole(p), np.uint8)
            left[pairs[s] : pairs[s + 1]] = np.frombuffer(_whole(l), np.float16)
            triple_codes[triples[s] : triples[s + 1]] = np.frombuffer(_whole(t), np.uint8)
        split_ = np.flatnonzero(np.isin(g.lead, hot) | (g.lead == _START))
        shares[split_] = np.array([spread.get(w, 0.0) for w in g.lead[split_].astype(np.int64).tolist()], np.float32)
        c = counts[g.word_of]
        base = (c + 0.5) / denominator
        total = np.where(g.before < 0, texts, counts[np.maximum(g.before, 0)])  # how often the predecessor led a pair
        seen = np.maximum(total, 1)
        lower = np.where(total > 0, 1 - shares[g.lead_of[g.pair_of]] / seen, 1.0)
        two = np.where(total > 0, _PAIR_LEVELS[codes[g.pair_of]] / seen, 0.0) + lower * base
        inner = np.flatnonzero(g.triple_of >= 0)
        model = two.copy()
        model[inner] = _TRIPLE_LEVELS[triple_codes[g.triple_of[inner]]] + left[g.pair_of[inner - 1]].astype(np.float64) * two[inner]
        ends = np.cumsum(g.per_text)
        summed = lambda v: np.add.reduceat(v, ends - g.per_text)
        return pa.Table.from_arrays(
            [
                group["ids"].combine_chunks().flatten(), pa.array(folds == held_out), pa.array(g.per_text.astype(np.int64)), pa.array(summed((c > 0).astype(np.int64))),
                pa.array(np.full(len(ends), n_train)), pa.array(summed(np.log10(base))), pa.array(summed(np.log10(model))),
            ],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    schema = f"doc_id {key}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    back = answers.where("text_group >= 0").select("text_group", "shard", "words", "shares", "pairs", "left", "triples")
    return groups.groupBy("text_group").cogroup(back.groupBy("text_group")).applyInArrow(finish, schema)
