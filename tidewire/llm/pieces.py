"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives one pass of relaxation.

At each position the automaton's state and its output links give every piece that ends there, longest first, and each
of them relaxes the best score of the position: score of the prefix before the piece, plus the piece's own weight.
For models of the unigram type the weight is the piece's log probability, and the pass is Viterbi's.

For models of the BPE type the weight is 0 if the piece and the last piece of the prefix before it stay two pieces
when their text is merged by rank, and minus infinity if not. A prefix has one encoding under merging, so at most one
piece reaches score 0 at a position, and the first to do so ends the walk along the links. Whether two pieces stay is
told from the merge trees of both (`PieceModel.stays`). Both types give the library's own ids.

All words of a batch take the pass in step: step i moves every word's state over its i-th character, and follows output
links for all words at once, in numpy.
"""

from __future__ import annotations

import heapq
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidewire.llm.common import as_strings, ragged, slices, utf8_view

_BATCH_BYTES = 4 << 20
_CACHE = 400_000
_LONG = 256  # words from this many characters on take the pass one after the other: few of them would share a step
_SPACE = "\u2581"
_NEVER = 0x7FFFFFFF  # above every rank
# Piece types of the model format.
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


class Table:
    """A read-only map from non-negative 62-bit keys to int32, open-addressed, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            free = self.keys[slot[left]] < 0
            at = left[free]
            self.keys[slot[at]] = keys[at]  # of several keys for one slot the last stays
            placed = self.keys[slot[left]] == keys[left]
            self.values[slot[left[placed]]] = values[left[placed]]
            left = left[~placed]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray, default: int) -> np.ndarray:
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], np.int32(default))
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[left]]
            hit = held == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (held >= 0)]
        return out


class Automaton:
    """Aho-Corasick over the characters of the pieces, in arrays."""

    def __init__(self, pieces: dict[str, int]):
        children: list[dict[str, int]] = [{}]
        piece, length = [-1], [0]
        for text, id_ in pieces.items():
            state = 0
            for c in text:
                step = children[state].get(c)
                if step is None:
                    step = len(children)
                    children[state][c] = step
                    children.append({})
                    piece.append(-1)
                    length.append(length[state] + 1)
                state = step
            piece[state] = id_
        fail, output = [0] * len(children), [0] * len(children)  # output: the longest proper suffix state that is a piece
        todo = deque(children[0].values())
        while todo:
            state = todo.popleft()
            for c, child in children[state].items():
                f = fail[state]
                while f and c not in children[f]:
                    f = fail[f]
                to = children[f].get(c, 0)
                fail[child] = to if to != child else 0
                output[child] = fail[child] if piece[fail[child]] >= 0 else output[fail[child]]
                todo.append(child)
        alphabet = sorted({c for step in children for c in step})
        self.code = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.code[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.width = len(alphabet) + 1
        self.piece, self.length = np.array(piece, np.int32), np.array(length, np.int32)
        self.fail, self.output = np.array(fail, np.int32), np.array(output, np.int32)
        #: Where a state's walk along the output links begins: itself if it is a piece.
        self.first = np.where(self.piece >= 0, np.arange(len(piece), dtype=np.int32), self.output)
        codes = {c: i + 1 for i, c in enumerate(alphabet)}
        edges = [(s * self.width + codes[c], to) for s, step in enumerate(children) for c, to in step.items()]
        self.edges = Table(np.array([e for e, _ in edges], np.int64), np.array([t for _, t in edges], np.int32))

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The next states; where a state has no edge, its failure links are followed."""
        at = state.astype(np.int64)
        out = self.edges.get(at * self.width + code, -1)
        left = np.flatnonzero((out < 0) & (at > 0))
        while len(left):
            at[left] = self.fail[at[left]]
            got = self.edges.get(at[left] * self.width + code[left], -1)
            out[left] = got
            left = left[(got < 0) & (at[left] > 0)]
        return np.maximum(out, 0)


class PieceModel:
    """Encoder and decoder of one .model file."""

    def __init__(self, path: str, model_type: str | None = None):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces:
            raise ValueError("only models that keep their text as it is are supported")
        self.prefix = spec.add_dummy_prefix
        self.bpe = (model_type or {1: "unigram", 2: "bpe"}[model.trainer_spec.model_type]) == "bpe"
        self.text = [p.piece for p in model.pieces]
        self.score = np.array([p.score for p in model.pieces])
        kind = np.array([p.type for p in model.pieces])
        self.id = {p: i for i, p in enumerate(self.text) if kind[i] in (_NORMAL, _USER)}
        self.unknown = int(np.flatnonzero(kind == _UNKNOWN)[0])
        self.bytes = {int(p[1:-1], 16): i for i, p in enumerate(self.text) if kind[i] == _BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.control = set(np.flatnonzero(kind == _CONTROL).tolist())
        self.automaton = Automaton(self.id)
        self.single = np.zeros(self.automaton.width, bool)  # characters that are pieces themselves
        self.single[[self.automaton.code[ord(p)] for p in self.id if len(p) == 1]] = True
        self.floor = float(self.score[kind == _NORMAL].min(initial=0.0)) - 10.0
        #: Pieces with a space mark after another character would tie words together; without them, words are apart.
        self.apart = not any(_SPACE in p.lstrip(_SPACE) for p in self.id)
        if self.bpe:
            self._grow()

    # --- merging by rank ---------------------------------------------------------------------------------------------------

    def _grow(self) -> None:
        """Merge trees of all pieces, shorter pieces first: the two parts whose merge gives the piece.

        A piece is regular if its parts are, come before it by rank, and stay apart until its own rank is reached.
        Pairs with another piece are told by merging their text.
        """
        n = len(self.text)
        ids = np.array(list(self.id.values()), np.int64)
        order = np.full(n, _NEVER, np.int64)
        _, place = np.unique(-self.score[ids], return_inverse=True)
        size = np.array([len(t) for t in self.text], np.int64)
        order[ids] = np.where(size[ids] > 1, place + 1, 0)
        self.rank, self.ends_in, self.begins_in = order, np.arange(n), np.arange(n)
        self.regular = np.zeros(n, bool)
        self.regular[ids] = size[ids] == 1
        cut = [(self.id.get(p[:k]), self.id.get(p[k:]), i) for p, i in self.id.items() for k in range(1, len(p))]
        left, right, whole = (np.array(c, np.int64) for c in zip(*((a, b, i) for a, b, i in cut if a is not None and b is not None), strict=True)) if cut else (np.zeros(0, np.int64),) * 3
        self.joined = Table(left << 31 | right, order[whole].astype(np.int32))
        self.known = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)
        for length in range(2, int(size[ids].max(initial=1)) + 1):
            at = np.flatnonzero(size[whole] == length)
            a, b, p = left[at], right[at], whole[at]
            fit = self.regular[a] & self.regular[b] & (order[a] < order[p]) & (order[b] < order[p])
            a, b, p = a[fit], b[fit], p[fit]
            stay = self._apart_until(a, b, order[p])
            self.begins_in[p[stay]], self.ends_in[p[stay]], self.regular[p[stay]] = a[stay], b[stay], True

    def _apart_until(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Whether nothing merges over the boundary of regular pieces a and b by merges of rank below the limit.

        Time runs backwards: the later of the two pieces' last merges is undone, as only the parts at the boundary
        matter, and in every state the merge over the boundary must not come before the state ends. Of equal
        ranks the leftmost merges first.
        """
        a, b, limit = a.copy(), b.copy(), limit.copy()
        out = np.ones(len(a), bool)
        left = np.arange(len(a))
        while len(left):
            x, y = a[left], b[left]
            out[left] = self.joined.get(x << 31 | y, _NEVER) >= limit[left]
            rx, ry = self.rank[x], self.rank[y]
            go = out[left] & ((rx > 0) | (ry > 0))
            first = rx > ry
            limit[left] = np.where(first, rx, ry + 1)
            a[left], b[left] = np.where(first, self.ends_in[x], x), np.where(first, y, self.begins_in[y])
            left = left[go]
        return out

    def merged(self, text: str) -> list[str]:
        """Best-score-first merging of adjacent symbols, leftmost among equals."""
        symbols: list[str | None] = list(text)
        before, after = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            joined = symbols[a] + symbols[b]
            if joined in self.id:
                heapq.heappush(heap, (-self.score[self.id[joined]], a, b, joined))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, joined = heapq.heappop(heap)
            if symbols[a] is None or symbols[b] is None or after[a] != b or symbols[a] + symbols[b] != joined:
                continue
            symbols[a], symbols[b] = joined, None
            after[a] = after[b]
            if after[a] >= 0:
                before[after[a]] = a
                offer(a, after[a])
            if before[a] >= 0:
                offer(before[a], a)
        return [s for s in symbols if s is not None]

    def stays(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether two pieces side by side (or, after -1, a piece alone) are what merging their text gives."""
        keys, values = self.known
        key = (left + 1).astype(np.int64) << 31 | right
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        out = values[slot]
        new = np.flatnonzero(keys[slot] != key)
        if len(new):
            a, b = left[new].astype(np.int64), right[new].astype(np.int64)
            plain = self.regular[b] & ((a < 0) | self.regular[a])
            got = plain.copy()
            both = np.flatnonzero(plain & (a >= 0))
            got[both] = self._apart_until(a[both], b[both], np.full(len(both), _NEVER))
            for i in np.flatnonzero(~plain).tolist():
                want = [self.text[k] for k in (int(a[i]), int(b[i])) if k >= 0]
                got[i] = self.merged("".join(want)) == want
            out[new] = got
            keys[slot[new]], values[slot[new]] = key[new], got
            # Of several keys for one slot the last stays, and so does its value: both arrays are written in one order.
        return out

    # --- the pass ----------------------------------------------------------------------------------------------------------

    def _pass(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (code points of all, characters of each), in order, and ids per word."""
        n = len(sizes)
        order = np.argsort(-sizes, kind="stable")
        size = sizes[order]
        base = np.zeros(n + 1, np.int64)  # every word has a place before its first character
        np.cumsum(sizes + 1, out=base[1:])
        base, begin = base[:-1][order], (np.cumsum(sizes) - sizes)[order]
        total = int(sizes.sum()) + n
        last, length = np.full(total, -2, np.int32), np.zeros(total, np.int32)  # last piece: -1 a character without one, -2 none
        last[base] = -1
        best = None if self.bpe else np.full(total, -np.inf)
        if best is not None:
            best[base] = 0.0
        codes = self.automaton.code[points]
        state = np.zeros(n, np.int32)
        active = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1 if n else 1), "right") if n else []
        for i, k in enumerate(active, 1):
            code = codes[begin[:k] + i - 1]
            state = self.automaton.step(state[:k], code)
            place = base[:k] + i
            (self._relax_bpe if best is None else self._relax_unigram)(state, place, last, length, best)
            odd = np.flatnonzero(~self.single[code])
            at = place[odd]
            free = at[last[at - 1] != -2]
            free = free[last[free] == -2] if best is None else free[best[free - 1] + self.floor > best[free]]
            last[free], length[free] = -1, 1
            if best is not None:
                best[free] = best[free - 1] + self.floor
        chosen = np.zeros(total, bool)
        at, floor = base + size, base
        while True:
            open_ = at > floor
            at, floor = at[open_], floor[open_]
            if not len(at):
                break
            chosen[at] = True
            at = at - length[at]
        return self._emit(points, sizes, last, np.flatnonzero(chosen))

    def _relax_bpe(self, state: np.ndarray, place: np.ndarray, last: np.ndarray, length: np.ndarray, _: None) -> None:
        node = self.automaton.first[state]
        left = np.flatnonzero(node > 0)
        while len(left):
            at, own = place[left], node[left]
            piece, size = self.automaton.piece[own], self.automaton.length[own]
            before = last[at - size]
            fits = (size == 1) & (before == -1)
            ask = np.flatnonzero(~fits & (before != -2))
            fits[ask] = self.stays(before[ask], piece[ask])
            last[at[fits]], length[at[fits]] = piece[fits], size[fits]
            left = left[~fits]
            node[left] = self.automaton.output[node[left]]
            left = left[node[left] > 0]

    def _relax_unigram(self, state: np.ndarray, place: np.ndarray, last: np.ndarray, length: np.ndarray, best: np.ndarray) -> None:
        node = self.automaton.first[state]
        left = np.flatnonzero(node > 0)
        while len(left):
            at, own = place[left], node[left]
            piece, size = self.automaton.piece[own], self.automaton.length[own]
            total = best[at - size] + self.score[piece]
            up = total > best[at]
            at = at[up]
            best[at], last[at], length[at] = total[up], piece[up], size[up]
            node[left] = self.automaton.output[own]
            left = left[node[left] > 0]

    def _emit(self, points: np.ndarray, sizes: np.ndarray, last: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids at the chosen places; a character without a piece becomes its bytes, or a run of them the unknown id."""
        word = np.repeat(np.arange(len(sizes)), sizes + 1)[ends]
        ids = last[ends].astype(np.int64)
        bare = ids == -1
        if not bare.any():
            return ids.astype(np.uint32), np.bincount(word, minlength=len(sizes))
        if not self.bytes:
            ids[bare] = self.unknown
            run = np.zeros(len(ids), bool)
            run[1:] = bare[1:] & bare[:-1] & (word[1:] == word[:-1])
            return ids[~run].astype(np.uint32), np.bincount(word[~run], minlength=len(sizes))
        chars = points[(ends - word - 1)[bare]]  # one more place than characters in each word so far
        raw = [chr(c).encode() for c in chars.tolist()]
        count = np.ones(len(ids), np.int64)
        count[bare] = [len(r) for r in raw]
        out = np.repeat(ids, count)
        out[np.repeat(bare, count)] = [self.bytes[b] for r in raw for b in r]
        return out.astype(np.uint32), np.bincount(np.repeat(word, count), minlength=len(sizes))

    def words(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every string, spaces already marked, as one stretch each; and ids per string."""
        data, offsets = utf8_view(strings)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        sizes = np.diff(chars)
        long = np.flatnonzero(sizes >= _LONG)
        if not len(long) or len(sizes) == 1:
            return self._pass(points, sizes)
        # A very long word goes alone: the others would wait for it step by step.
        parts, n, lo = [], [], 0
        for at in [*long.tolist(), len(sizes)]:
            for a, b in ((lo, at), (at, min(at + 1, len(sizes)))):
                if a < b:
                    ids, per = self._pass(points[chars[a] : chars[b]], sizes[a:b])
                    parts.append(ids)
                    n.append(per)
            lo = at + 1
        return np.concatenate(parts), np.concatenate(n)

    def encode(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and ids per text."""
        marked = pc.replace_substring(strings, " ", _SPACE)
        if self.prefix:
            marked = pc.if_else(pc.equal(marked, ""), "", pc.binary_join_element_wise(_SPACE, marked, ""))
        if not self.apart:
            return self.words(marked)
        # Cut before every run of space marks: no piece reaches over such a cut.
        cut = pc.replace_substring_regex(marked, f"([^{_SPACE}])({_SPACE})", "\\1\x00\\2")
        odd = pc.match_substring(marked, "\x00").to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(cut, "\x00")
        coded = lists.flatten().dictionary_encode()
        flat, lengths = self.words(as_strings(coded.dictionary))
        starts = np.cumsum(lengths) - lengths
        codes = coded.indices.to_numpy().astype(np.int64)
        ends = lists.offsets.to_numpy().astype(np.int64)
        running = np.concatenate([[0], np.cumsum(lengths[codes])])
        per_text = running[ends[1:] - ends[0]] - running[ends[:-1] - ends[0]]
        out = flat[ragged(starts[codes], lengths[codes])]
        if odd.any():  # texts with the cut mark itself are taken whole
            parts = np.split(out, np.cumsum(per_text)[:-1])
            for i in np.flatnonzero(odd):
                parts[i] = self.words(as_strings(marked.slice(int(i), 1)))[0]
            per_text = np.array([len(p) for p in parts], np.int64)
            out = np.concatenate(parts)
        return out, per_text

    def decode(self, ids: np.ndarray, per_text: np.ndarray) -> list[str]:
        """Texts of id sequences: pieces and byte pieces joined, space marks to spaces, the prefix's one dropped."""
        if not hasattr(self, "raw"):
            raw = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in self.control else t.replace(_SPACE, " ").encode() for i, t in enumerate(self.text)]
            raw[self.unknown] = " \u2047 ".encode()
            self.raw_length = np.array([len(r) for r in raw], np.int64)
            self.raw_start = np.cumsum(self.raw_length) - self.raw_length
            self.raw = np.frombuffer(b"".join(raw), np.uint8)
        lengths = self.raw_length[ids]
        data = self.raw[ragged(self.raw_start[ids], lengths)].tobytes()
        running = np.concatenate([[0], np.cumsum(lengths)])
        ends = running[np.cumsum(per_text)]
        out, at = [], 0
        for end in ends.tolist():
            one = data[at:end].decode("utf-8", "replace")
            out.append(one[1:] if self.prefix and one.startswith(" ") else one)
            at = end
        return out


def encode_pieces(docs: DataFrame, path: str, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_pieces, ids_crc32 (little-endian unsigned 32-bit ids) and round_trip of every whole text.

    round_trip says whether decoding the ids gives the text back; `keep_ids` adds the ids themselves, as `ids`. A null
    or empty text has no pieces, and comes back as empty. Repeated rows get equal results; null ids stay null; an
    empty table gives an empty result; other columns are ignored, whatever their names. Memory is bounded by a
    batch and, for one very long text, by some 60 times that text.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "n_pieces", "ids_crc32", "round_trip"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(path)
        for batch in batches:
            strings = as_strings(batch.column(1))
            for lo, hi in slices(strings, _BATCH_BYTES):
                part = strings.slice(lo, hi - lo)
                ids, n = model.encode(part)
                ends = np.cumsum(n)
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                same = pc.equal(pa.array(model.decode(ids, n), pa.string()), part)
                kept = [pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), pa.array(ids.astype(np.int32)))] if keep_ids else []
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pc.binary_length(part).cast(pa.int64()), pa.array(n), pa.array(crc, pa.int64()), same, *kept], names=names)

    schema = f"doc_id {key}, n_bytes long, n_pieces long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", F.col(text).cast("string")).mapInArrow(run, schema)


def decode_pieces(coded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """doc_id and text of every row's id sequence (an array of int).

    A null or empty sequence gives an empty text; ids inside a sequence must be the model's and not null, or the job
    fails. Repeated rows decode alike; an empty table gives an empty result; other columns are ignored.
    """
    key = coded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(path)
        for batch in batches:
            lists = batch.column(1)
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            if flat.null_count:
                raise ValueError("an id sequence holds a null")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.decode(flat.to_numpy().astype(np.int64), n), pa.string())], names=["doc_id", "text"])

    return coded.select("doc_id", F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, f"doc_id {key}, text string")
