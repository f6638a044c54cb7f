"""Operators 11 to 13 against brute force, on the test tables and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.oracle import duck

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, None, "a"), (2, "", None), (3, "  \n ", "a"), (4, "one", "b"), (5, "tie tie tie tie", "a"), (5, "tie tie tie tie", "a"), (None, "no id here at all", "b"), (None, "no id here at all", None),
    (7, "long " * 4000 + "end", "a"), (8, "ünï cödé 日本語 😀 don't stop " * 9, "b"), (9, "a b a b a b a b a b a b a b c c c c c c c c c c c c c c", "a"), (10, "Ünï CAPITALS & signs #1", "a"), (11, "Ünï CAPITALS & signs #1", "b"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, repeated rows, a long text and columns whose names clash with the operators' own."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    for name in ("runs", "n_words", "collapsed", "part", "mask", "same", "block", "tail", "mark", "fingerprint", "words", "n", "at"):
        df = df.withColumn(name, F.lit("mine"))
    return df


def table_rows(t):
    t = t.select(sorted(t.column_names))
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r.values()) for r in t.to_pylist()), key=repr)


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_filter_audit"])
def test_matches_sql(spark, sf_dir, name):
    from tidewire.llm import queries

    ours, theirs = queries.queries()[name](spark, sf_dir).toArrow(), duck(sf_dir).sql(queries.oracle_sql()[name]).to_arrow_table()
    assert sorted(ours.column_names) == sorted(theirs.column_names)
    assert table_rows(ours) == table_rows(theirs)


# --- 11: periodic runs -----------------------------------------------------------------------------------------------------


def runs_of(words, least=12, times=2):
    """Every lag, every place, one at a time; of the stretches found, each once with its least lag."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = max(i + 1, j)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed_of(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.fixture(scope="module")
def repetitive(spark):
    rng, rows = random.Random(3), []
    for i in range(160):
        words = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 3)):  # planted: a block and its repetitions, the last one cut
            block = [rng.choice("abcdefgh") + str(rng.randint(0, 3)) for _ in range(rng.randint(1, 9))]
            at = rng.randint(0, len(words))
            words[at:at] = (block * 9)[: rng.randint(len(block), 6 * len(block))]
        rows.append((i, rng.choice((" ", "\n", " \t "))[:1].join(words)))
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("unit", [1 << 25, 900])
@pytest.mark.parametrize("least,times", [(12, 2), (5, 3), (1, 2)])
def test_runs_of_random_words(repetitive, unit, least, times, monkeypatch):
    from tidewire.llm import periodic

    monkeypatch.setattr(periodic, "LEAST_LAGS", 2)
    texts = {r.doc_id: r.text for r in repetitive.collect()}
    got = periodic.periodic_runs(repetitive, least=least, min_exp=float(times), unit=unit).collect()
    assert len(got) == len(texts) and any(len(r.runs) > 2 for r in got)
    for r in got:
        words = WORD.findall(texts[r.doc_id])
        expected = runs_of(words, least, times)
        assert [(x.start, x.length, x.period) for x in r.runs] == expected and r.n_words == len(words)
        assert r.collapsed == collapsed_of(words, expected)


@pytest.mark.parametrize("unit", [1 << 25, 2000])
def test_runs_of_odd_rows(odd, unit):
    from tidewire.llm.periodic import digests, periodic_runs, planted

    got = periodic_runs(odd, keep=("doc_id", "source"), unit=unit)
    assert got.columns == ["doc_id", "source", "n_words", "runs", "collapsed"]
    shown = lambda rows: sorted(rows, key=repr)
    expected = []
    for i, text, source in ODD:
        words = WORD.findall(text or "")
        if len(words) < 1000:
            found = runs_of(words)
            expected.append((i, source, len(words), found, collapsed_of(words, found)))
        else:
            expected.append((i, source, 4001, [(0, 4000, 1)], "long end"))
    assert shown((r.doc_id, r.source, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()) == shown(expected)
    assert periodic_runs(odd.limit(0), unit=unit).count() == 0
    assert digests(periodic_runs(planted(odd))).count() == len(ODD)
    with pytest.raises(ValueError):
        periodic_runs(odd, keep=("doc_id", "runs"))


def test_planted_words(spark, sf_dir):
    """Every id's checksum says whether and how its words repeat."""
    from tidewire.llm.periodic import planted

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before, changed = {r.doc_id: r.text for r in docs.collect()}, 0
    for r in planted(docs).collect():
        words, h = WORD.findall(before[r.doc_id] or ""), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and words:
            g, n, changed = h // 10, len(words), changed + 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert WORD.findall(r.text) == words
    assert changed > 5


def test_lag_ranges_cover_all_lags(spark):
    """A text of many lag ranges gives what one scan gives, each lag once."""
    from tidewire.llm import periodic

    rng = np.random.default_rng(5)
    words = np.concatenate([rng.integers(0, 9, 700), np.tile(rng.integers(0, 9, 330), 4), rng.integers(0, 2, 300)])
    docs = spark.createDataFrame([(1, " ".join(map(str, words)))], "doc_id long, text string")
    whole = periodic.periodic_runs(docs).first()
    split = periodic.periodic_runs(docs, unit=1).first()
    assert whole == split and any(r.period == 330 and r.start <= 700 and r.start + r.length >= 2020 for r in whole.runs)


# --- 12: filter audit ------------------------------------------------------------------------------------------------------


def test_polynomial_corners_and_shapley():
    """Corners count removals, and the integral is the mean over all orders, on random mask counts."""
    from tidewire.llm.audit import corners, removal_polynomial, shapley

    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 5):
        counts = rng.integers(0, 1000, 1 << n).tolist()
        polynomial = removal_polynomial(counts)
        at = corners(polynomial)
        removed = lambda applied: sum(c for s, c in enumerate(counts) if s & applied)  # noqa: B023, E731
        assert at == [removed(t) for t in range(1 << n)]
        for i in range(n):
            total = 0
            for order in permutations(range(n)):
                before = sum(1 << j for j in order[: order.index(i)])
                total += removed(before | 1 << i) - removed(before)
            assert shapley(polynomial, i) * math.factorial(n) == total


def audited(rows, labels):
    """The contract, row by row: every order applied filter by filter to every document of a part."""
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    judged = []
    for i, text, source in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows),
        }
        judged.append((source or "", i, fails))
    out = set()
    for part in {p for p, _, _ in judged}:
        sums, steps = dict.fromkeys("ABCDE", 0), []
        for order in map("".join, permutations("ABCDE")):
            left = [(i, f) for p, i, f in judged if p == part]
            for step, c in enumerate(order, 1):
                gone = [i for i, f in left if f[c]]
                alone = sum(f[c] and sum(f.values()) == 1 for p, _, f in judged if p == part)
                failing = sum(f[c] for p, _, f in judged if p == part)
                left = [(i, f) for i, f in left if not f[c]]
                sums[c] += len(gone)
                steps.append((part, order, step, len(left), len(gone), failing - len(gone), alone, sum(i in good for i in gone), sum(i in toxic for i in gone), c))
        out |= {(*s[:-1], sums[s[-1]]) for s in steps}
    return out


def test_audit_of_odd_rows(spark, odd):
    from tidewire.llm.audit import FILTERS, audit, masks

    known = [(1, 1, 0), (5, 1, None), (5, 0, 1), (10, 0, 1), (11, 1, 1), (77, 1, 1), (None, 1, 1)]
    labels = spark.createDataFrame(known, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    masked = masks(odd, labels).withColumnsRenamed({"good": "good_lost", "toxic": "toxic_lost"})
    got = audit(masked, FILTERS, rows="rows", losses=("good_lost", "toxic_lost"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    expected = audited(ODD, [k for k in known if k[0] is not None])
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(expected) == 3 * 600 and set(rows) == expected
    assert audit(masks(odd.limit(0), labels), FILTERS, rows="rows").count() == 0
    assert masks(odd, labels.limit(0)).where("good or toxic").count() == 0


def test_audit_of_plain_masks(spark):
    """Other filters, nulls, no weights: a row a document; a table-wide copy counts in its own part."""
    from tidewire.llm.audit import audit

    rows = [("p", 1, True), ("p", 3, False), ("p", None, None), (None, 2, True), ("q", 0, None)]
    got = {tuple(r) for r in audit(spark.createDataFrame(rows, "part string, mask int, lost boolean"), "XY", losses=("lost",)).collect()}
    assert got == {
        ("p", "XY", 1, 1, 2, 0, 1, 1, 3), ("p", "XY", 2, 1, 0, 1, 0, 0, 1), ("p", "YX", 1, 2, 1, 0, 0, 0, 1), ("p", "YX", 2, 1, 1, 1, 1, 1, 3),
        ("", "XY", 1, 1, 0, 0, 0, 0, 0), ("", "XY", 2, 0, 1, 0, 1, 1, 2), ("", "YX", 1, 0, 1, 0, 1, 1, 2), ("", "YX", 2, 0, 0, 0, 0, 0, 0),
        ("q", "XY", 1, 1, 0, 0, 0, 0, 0), ("q", "XY", 2, 1, 0, 0, 0, 0, 0), ("q", "YX", 1, 1, 0, 0, 0, 0, 0), ("q", "YX", 2, 1, 0, 0, 0, 0, 0),
    }


# --- 13: fingerprints ------------------------------------------------------------------------------------------------------


def shingles(text, n=5):
    words = WORD.findall(text or "")
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_signatures_against_plain_minima():
    from tidewire.llm.fingerprints import functions, signatures, sixteen_bits

    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 2**64, n, dtype=np.uint64) for n in (3, 0, 20_000, 1, 9000, 0)]
    got = signatures(np.concatenate(sets), np.array([len(s) for s in sets]), 8)
    a, b = functions(8)
    for k in range(8):
        for i, s in enumerate(sets):
            assert got[i, k] == min(((int(x) * int(a[k]) + int(b[k])) % 2**64 >> 32 for x in s), default=2**32 - 1)
    assert sixteen_bits(got).dtype.itemsize == 2 and (sixteen_bits(got)[1] == sixteen_bits(got)[5]).all()


def expected_edits(rows):
    """Ids ascending, rows without one first; the next row's first code points in place of the last quarter."""
    out = []
    for (i, text), (_, follow) in zip(rows, [*rows[1:], rows[0]], strict=True):
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + follow[:quarter]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), jaccard(text, edited), jaccard(text, follow)))
    return out


@pytest.mark.parametrize("block_bytes", [16 << 20, 30_000])
def test_edited_fingerprints(spark, sf_dir, monkeypatch, block_bytes):
    """One block and many: the same rows, and likeness near the exact similarity (standard error below 0.045)."""
    from tidewire.llm import fingerprints

    blocks = fingerprints.in_order
    monkeypatch.setattr(fingerprints, "in_order", lambda docs, text: blocks(docs, text, block_bytes))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    expected = {e[0]: e for e in expected_edits(rows)}
    got = fingerprints.edited_fingerprints(docs).collect()
    assert len(got) == len(expected)
    wrong = []
    for r in got:
        _, n, sha, near, follow = expected[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, sha) and len(r.fingerprint) == len(r.edited_fingerprint) == 512
        wrong += [abs(r.near_edited - near), abs(r.near_next - follow)]
    assert max(wrong) < 0.2 and float(np.mean(wrong)) < 0.03
    marks = {}
    for r in got:
        assert marks.setdefault(expected[r.doc_id][0] and dict(rows)[r.doc_id], r.fingerprint) == r.fingerprint


def test_edited_fingerprints_of_odd_rows(odd):
    from tidewire.llm.fingerprints import edited_fingerprints, fingerprint

    got = edited_fingerprints(odd).collect()
    assert len(got) == len(ODD)
    known = sorted((i, t or "") for i, t, _ in ODD if i is not None)
    lost = [t for i, t, _ in ODD if i is None]
    expected = expected_edits([*((None, t) for t in lost), *known])
    assert sorted((repr(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted((repr(e[0]), e[1], e[2]) for e in expected)
    assert len({r.fingerprint for r in got if r.doc_id in (1, 2, 3)}) == 1  # no words, one set
    assert edited_fingerprints(odd.limit(0)).count() == 0
    alone = edited_fingerprints(odd.where("doc_id = 4")).first()
    assert alone.near_next == alone.near_edited == 1.0
    assert fingerprint(odd, keep=("doc_id", "source")).columns == ["doc_id", "source", "fingerprint"]
    with pytest.raises(ValueError):
        fingerprint(odd, keep=("fingerprint",))


def test_banded_duplicates(spark):
    """Every pair at 0.8 or more, from texts around that similarity; links and classes against all pairs."""
    from tidewire.llm.fingerprints import banded_duplicates

    rng, rows = random.Random(8), []
    for family in range(25):
        base = [f"w{family}_{rng.randint(0, 400)}" for _ in range(120)]
        for _ in range(6):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(words)))
    got = {r.doc_id: r for r in banded_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    links = {i: {j for j, u in rows if j != i and jaccard(t, u) >= 0.8} for i, t in rows}
    assert {i: r.n_links for i, r in got.items()} == {i: len(x) for i, x in links.items()}
    for i, _ in rows:
        todo, seen = [i], {i}
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert got[i].class_id == min(seen)


def test_word_numbers_are_a_texts_own():
    from tidewire.llm.periodic import word_numbers
    from tidewire.llm.words import split

    numbers = word_numbers(split(pa.array(["a b a", "a b"])))
    assert numbers[0] == numbers[2] and len(set(numbers.tolist())) == 4


def test_smallest_hashes(spark):
    """The bound on hashes changes nothing; few rows, ties and null ids too."""
    from tidewire.llm.common import smallest_hashes

    df = spark.range(40_000).select(F.when(F.col("id") % 50 > 0, F.col("id") % 30_000).alias("k"), "id")
    plain = [r.id for r in df.orderBy(F.xxhash64("k"), "k", "id").limit(700).collect()]
    assert [r.id for r in smallest_hashes(df, 700, "k", "id").collect()] == plain
    assert smallest_hashes(df.limit(5), 700, "k", "id").count() == 5 and smallest_hashes(df.limit(0), 700, "k").count() == 0
