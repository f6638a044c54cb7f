"""Toxicity: a convolutional classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidewire.llm.common import as_strings, fold_of, materialise, ragged, release, shared_dir, slices, smallest_hashes
from tidewire.llm.words import hashes, split

_BATCH_BYTES = 2 << 20
_BITS = 16
_STEMS = (5, 7)  # bytes of the word beginnings that have embeddings of their own, for unseen inflections
_TOP = 3  # responses that max pooling keeps of each filter
# Frequent function words, by which the language of a text is told.
_FUNCTION_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "was"),
    "fr": ("le", "la", "les", "de", "des", "et", "un", "une", "est", "dans", "que", "pour"),
    "de": ("der", "die", "das", "und", "ist", "nicht", "mit", "ein", "eine", "den", "von", "zu"),
    "es": ("el", "los", "las", "y", "en", "que", "del", "por", "con", "una", "se", "para"),
}
LANGUAGES = (*_FUNCTION_WORDS, "other")


def _hash_of(words: tuple[str, ...]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(r) for r in raw])
    return hashes(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], ends[:-1]]), ends)


def encode(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embedding buckets of each word of all texts (the word and its stems; 0 is padding), words per text, and
    each text's language.

    Words are lower-cased (A-Z and Latin-1 letters) and lose the marks around them; words without a letter or
    digit are dropped.
    """
    w = split(strings)
    n = len(strings)
    if not len(w.starts):
        return np.zeros((0, 1 + len(_STEMS)), np.int32), np.zeros(n, np.int64), np.full(n, len(LANGUAGES) - 1)
    data = w.data
    before = np.zeros(len(data), np.uint8)
    before[1:] = data[:-1]
    text = data.copy()
    raised = ((data >= 65) & (data <= 90)) | ((before == 0xC3) & (data >= 0x80) & (data <= 0x9E))
    text[raised] += 32
    solid = ((text >= 97) & (text <= 122)) | ((text >= 48) & (text <= 57)) | (text >= 0x80)
    at = np.flatnonzero(solid)
    lo, hi = np.searchsorted(at, w.starts), np.searchsorted(at, w.ends)
    some = hi > lo
    starts, ends, row = at[lo[some]], at[hi[some] - 1] + 1, w.row[some]
    h = hashes(text, starts, ends)
    votes = np.stack([np.bincount(row[np.isin(h, _hash_of(v))], minlength=n) for v in _FUNCTION_WORDS.values()], 1)
    language = np.where(votes.max(1) > 0, votes.argmax(1), len(LANGUAGES) - 1)
    stems = [hashes(text, starts, np.minimum(ends, starts + k)) ^ np.uint64(k) for k in _STEMS]
    codes = (1 + np.stack([h, *stems], 1) % np.uint64(2**_BITS - 1)).astype(np.int32)
    return codes, np.bincount(row, minlength=n), language


@dataclass
class Network:
    """Embeddings, one filter bank per width, a dense layer over the pooled filters, and thresholds by language."""

    embed: np.ndarray
    banks: list[np.ndarray]  # width x dim x filters
    bias: np.ndarray
    dense: np.ndarray
    offset: float
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))
    scale: float = 1.0

    @property
    def widths(self) -> list[int]:
        return [len(b) for b in self.banks]

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """A word's vector: the sum of its own and its stems' embeddings."""
        return sum(self.embed[codes[:, k]] for k in range(codes.shape[1]))

    def pooled(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each filter's `_TOP` greatest responses anywhere in each whole text."""
        pad = max(self.widths) + _TOP  # a short text has windows that begin in its padding
        filters = self.banks[0].shape[2]
        begin = np.cumsum(lengths + pad) - (lengths + pad)
        at = ragged(begin, lengths)
        x = np.zeros((len(codes) + pad * len(lengths), self.embed.shape[1]), np.float32)
        x[at] = self.vectors(codes)
        # A text's windows start at its words, or at its padding if it has none; the padding keeps them inside it.
        many = np.maximum(lengths, _TOP)
        starts = ragged(begin, np.minimum(many, lengths + pad))
        per_text = np.minimum(many, lengths + pad)
        first = np.cumsum(per_text) - per_text
        text = np.repeat(np.arange(len(lengths)), per_text)
        x = np.concatenate([x, np.zeros((pad, x.shape[1]), np.float32)])
        out = []
        for bank in self.banks:
            total = sum(x[starts + j] @ bank[j].astype(np.float32) for j in range(len(bank)))
            for _ in range(_TOP):
                top = np.maximum.reduceat(total, first, axis=0)
                out.append(top)
                hit = np.flatnonzero(total == top[text])
                _, once = np.unique(text[hit // filters] * filters + hit % filters, return_index=True)
                total.ravel()[hit[once]] = -np.inf
        return np.maximum(np.concatenate(out, 1) + self.bias, 0)

    def logits(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        if not len(lengths):
            return np.zeros(0)
        return self.pooled(codes, lengths) @ self.dense + self.offset

    def scores(self, logits: np.ndarray, language: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * (logits - self.thresholds[language]), -30, 30)))


def fit(
    texts: list[np.ndarray], toxic: np.ndarray, dim: int = 8, filters: int = 8, widths: tuple[int, ...] = (1, 2, 3),
    epochs: int = 8, batch: int = 32, rate: float = 0.01, seed: int = 5,
) -> Network:
    """Adam on the logistic loss. One embedding dimension starts from each bucket's shrunken log odds among the
    training texts, so that rare toxic words are found from few labels; the others start at random."""
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.02, (2**_BITS, dim))
    positive, negative = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    seen = np.zeros((2, 2**_BITS))
    for codes, y in zip(texts, toxic, strict=True):
        seen[int(y), np.unique(codes)] += 1
    odds = np.log((seen[1] + 0.5) / (positive + 1)) - np.log((seen[0] + 0.5) / (negative + 1))
    support = seen.sum(0)
    embed[:, 0] = np.clip(odds, 0, 6) / 3 * (support / (support + 4))
    embed[0] = 0
    banks = [rng.normal(0, 0.1, (k, dim, filters)) for k in widths]
    for b in banks:
        b[:, 0, :] += np.linspace(0.2, 1.0, filters) / len(b)
    units = len(widths) * filters * _TOP
    net = Network(embed, banks, np.full(units, -0.1), np.full(units, 1.0 / filters / _TOP), -1.0)
    if not len(texts) or not 0 < toxic.sum() < len(toxic):
        net.offset = 4.0 if len(toxic) and toxic.all() else -4.0
        net.dense[:] = 0
        return net
    params = {"dense": net.dense, "bias": net.bias, **{f"bank{i}": b for i, b in enumerate(net.banks)}}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    weight = np.where(toxic == 1, np.sqrt(negative / positive), 1.0)
    pad, step = max(widths), 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), batch):
            grads = {k: np.zeros_like(v) for k, v in params.items()}
            grad_offset, touched = 0.0, []
            for i in order[lo : lo + batch]:
                codes = np.concatenate([texts[i], np.zeros((pad + _TOP, texts[i].shape[1]), np.int32)])
                x = net.vectors(codes)
                n = max(_TOP, len(texts[i]))
                best, top = [], []
                for b in net.banks:
                    z = sum(x[j : j + n] @ b[j] for j in range(len(b)))
                    at = np.argsort(-z, axis=0, kind="stable")[:_TOP] if n < 64 else np.argpartition(-z, _TOP, axis=0)[:_TOP]
                    values = np.take_along_axis(z, at, 0)
                    order_ = np.argsort(-values, axis=0, kind="stable")
                    best.append(np.take_along_axis(at, order_, 0).ravel())
                    top.append(np.take_along_axis(values, order_, 0).ravel())
                pre = np.concatenate(top) + net.bias
                hidden = np.maximum(pre, 0)
                p = 1 / (1 + np.exp(-np.clip(hidden @ net.dense + net.offset, -30, 30)))
                d = (p - toxic[i]) * weight[i]
                grads["dense"] += d * hidden
                grad_offset += d
                back = d * net.dense * (pre > 0)
                grads["bias"] += back
                for k, b in enumerate(net.banks):
                    g = back[k * filters * _TOP : (k + 1) * filters * _TOP]
                    unit = np.tile(np.arange(filters), _TOP)
                    for j in range(len(b)):
                        at = best[k] + j
                        np.add.at(grads[f"bank{k}"][j].T, unit, x[at] * g[:, None])
                        touched.append((codes[at], b[j].T[unit] * g[:, None]))
            step += 1
            for k, v in params.items():
                m, s = moments[k]
                m += 0.1 * (grads[k] / batch - m)
                s += 0.001 * ((grads[k] / batch) ** 2 - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
            net.offset -= rate * 5 * grad_offset / batch
            for at, g in touched:
                for c in range(at.shape[1]):
                    np.add.at(net.embed, at[:, c], -rate * g / batch)
            net.embed[0] = 0
    return net


def calibrate(net: Network, logits: np.ndarray, toxic: np.ndarray, language: np.ndarray, least: int = 8) -> None:
    """Set each language's threshold to the logit that errs least on held-back rows; a language with fewer than
    `least` rows of either class takes the threshold of all."""

    def best(z: np.ndarray, y: np.ndarray) -> float:
        if not 0 < y.sum() < len(y):
            return 0.0
        order = np.argsort(z)
        z, y = z[order], y[order]
        wrong = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([[np.sum(1 - y)], np.sum(1 - y) - np.cumsum(1 - y)])
        low = np.flatnonzero(wrong == wrong.min())
        edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
        return float(np.median([(edges[k] + edges[k + 1]) / 2 for k in low]))

    overall = best(logits, toxic)
    net.thresholds[:] = overall
    for k in range(len(LANGUAGES)):
        mine = language == k
        if mine.any() and min(toxic[mine].sum(), (1 - toxic[mine]).sum()) >= least:
            net.thresholds[k] = best(logits[mine], toxic[mine])
    spread = np.std(logits) if len(logits) else 1.0
    net.scale = 1.0 if spread > 0.5 else float(0.5 / max(spread, 0.05))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", fit_rows: int = 6000, fit_bytes: int = 160_000, fit_total: int = 40_000_000) -> Network:
    """Fit on at most `fit_rows` labelled documents: of those with a label and a text of at most `fit_bytes`, the ones
    with the smallest id hashes, as far as `fit_total` bytes of text reach.

    Labels are joined to the documents before any row is drawn, so labels of other documents change nothing. A
    document labelled twice counts as toxic if one label says so; rows that share an id are told apart by their
    text's hash; null ids have no label. Rows of fold 0 are never read for labels; fold 1 calibrates, 2 to 4 train.
    Lengths, not texts, are sorted and summed; what the driver holds is at most 12 bytes a word of the drawn texts.
    """
    known = (
        labels.where("doc_id is not null and toxic in (0, 1)").withColumn("fold", fold_of(F.col("doc_id"))).where("fold != 0")
        .groupBy("doc_id", "fold").agg(F.max("toxic").cast("int").alias("y"))
    )
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    sizes = docs.select("doc_id", F.xxhash64(body).alias("mark"), F.octet_length(body).alias("size")).where(F.col("size") <= fit_bytes).dropDuplicates(["doc_id", "mark"])
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("mark")]
    labelled = materialise(sizes.join(known.hint("merge"), "doc_id"), shared_dir(docs.sparkSession))
    drawn = smallest_hashes(labelled, fit_rows, "doc_id", "mark")  # few enough for one window
    total = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    drawn = drawn.withColumn("total", total).where(F.col("total") <= fit_total).select("doc_id", "mark", "fold", "y").distinct()

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strings = as_strings(batch.column(3))
            for lo, hi in slices(strings, _BATCH_BYTES):
                buckets, lengths, language = encode(strings.slice(lo, hi - lo))
                ends = np.cumsum(lengths)
                blobs = [np.ascontiguousarray(buckets[end - n : end]).tobytes() for end, n in zip(ends, lengths, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(lo, hi - lo) for k in range(3)), pa.array(language), pa.array(blobs, pa.binary())],
                    names=["doc_id", "fold", "y", "language", "codes"],
                )

    # Rows that share an id and a text are one example.
    picked = docs.select("doc_id", F.xxhash64(body).alias("mark"), body.alias("__text")).join(F.broadcast(drawn), ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"])
    key = docs.schema["doc_id"].dataType.simpleString()
    coded = picked.select("doc_id", "fold", "y", "__text").mapInArrow(codes, f"doc_id {key}, fold int, y int, language long, codes binary")
    rows = coded.orderBy(F.xxhash64("doc_id"), "doc_id", "codes").collect()
    texts = [np.frombuffer(r.codes, np.int32).reshape(-1, 1 + len(_STEMS)) for r in rows]
    y = np.array([r.y for r in rows], np.int64)
    held = np.array([r.fold == 1 for r in rows], bool)
    net = fit([t for t, h in zip(texts, held, strict=True) if not h], y[~held])
    language = np.array([r.language for r in rows], np.int64)
    flat = lambda ts: (np.concatenate([*ts, np.zeros((0, 1 + len(_STEMS)), np.int32)]), np.array([len(t) for t in ts], np.int64))
    z = net.logits(*flat([t for t, h in zip(texts, held, strict=True) if h]))
    calibrate(net, z, y[held], language[held])
    return net


def toxicity(docs: DataFrame, net: Network, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with `score` (0 to 1) and `predicted` of every whole text.

    Only the text is an input: its language is told from its own function words. A null text scores as an
    empty one; repeated rows score equally; an empty table gives an empty result. Kept columns must not be named
    as the results are; all others may be named anything.
    """
    if {"score", "predicted"} & set(keep):
        raise ValueError("score and predicted cannot be kept beside the results of that name")
    held = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).cast("string").alias("__text"))
    n_held = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        net.embed = net.embed.astype(np.float32)
        for batch in batches:
            strings = as_strings(batch.column(n_held))
            for lo, hi in slices(strings, _BATCH_BYTES):
                buckets, lengths, language = encode(strings.slice(lo, hi - lo))
                score = net.scores(net.logits(buckets, lengths), language)
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(lo, hi - lo) for c in batch.columns[:n_held]), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                    names=[*keep, "score", "predicted"],
                )

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields[:n_held]), "score double", "predicted int"])
    return held.mapInArrow(run, schema)
