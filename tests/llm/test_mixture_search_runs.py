"""Mixture packing, ranked search and periodic runs against brute force, with odd inputs."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction
from zlib import crc32

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cumula.llm import lexical_search, mixture_packing, periodic_runs, queries

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    (1, None, None), (2, "", "a"), (3, " \x1c　 ", "a"), (4, "A<|endoftext|>b <|startoftext|>'s Don't é é ΑΣ İ", ""), (5, "one two three " * 4000, "a"), (6, "tie tie", "b"), (6, "tie tie", "b"), (None, "no id, tie tie", "b"), (7, "x" * 9000, None), (-3, "tie  TIE\n", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(d, t, s, 5, "clash") for d, t, s in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n long, queue string")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def check_windows(pieces, texts, capacity):
    """Ids of every document back from its pieces; windows without gaps; only powers of two are short."""
    t = Tokenizer.from_file(WORD_BPE)
    windows, own = {}, {}
    for p in pieces:
        assert p.length > 0 and len(p.ids) == 4 * p.length
        windows.setdefault(p.sequence_id, []).append((p.offset, p.length))
        own.setdefault(p.doc_id, []).append(p)
    assert sorted(windows) == list(range(len(windows)))
    for held in windows.values():
        held.sort()
        ends = np.cumsum([n for _, n in held])
        assert [o for o, _ in held] == [0, *ends[:-1]] and ends[-1] <= capacity
        assert ends[-1] == capacity or int(ends[-1]).bit_count() == 1
    want = {}
    for d, text in texts:
        want.setdefault(d, []).append([*t.encode(text or "", add_special_tokens=False).ids, 2])
    assert set(want) == set(own)
    for d, lists in want.items():
        assert sum(p.length for p in own[d]) == sum(map(len, lists))
        if len(lists) == 1:
            held = sorted(own[d], key=lambda p: p.start)
            assert all(p.doc_tokens == len(lists[0]) for p in held)
            assert [p.start for p in held] == [0, *np.cumsum([p.length for p in held])[:-1]]
            assert np.frombuffer(b"".join(p.ids for p in held), "<u4").tolist() == lists[0]


def test_word_encoder_equals_library(docs, monkeypatch):
    monkeypatch.setattr(mixture_packing, "MEMO_PARTS", 300)
    t, e, rnd = Tokenizer.from_file(WORD_BPE), mixture_packing._Encoder(WORD_BPE), random.Random(4)
    texts = [r.text or "" for r in docs.select("text").collect()] + [t or "" for _, t, _ in ODD]
    signs = list("aZéÉñß÷×ÿŸ'.,;<|>!%&`^_~0 1\\ \tİıKÅΣςе́ﬁ²") + ["'s", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "\x85", "\u3000", "e\u0301", "word"]
    texts += ["".join(rnd.choice(signs) for _ in range(rnd.randrange(30))) for _ in range(4000)]
    for text in texts:
        assert np.frombuffer(e(text), e.kind).tolist() == t.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("weights", [None, {"src1": 7, "src2": 3, None: 5}])
def test_mixture_windows_are_whole(spark, docs, odd, weights):
    both = docs.select("doc_id", "text", "source").where("doc_id > 20").union(odd.select("doc_id", "text", "source")).repartition(5)
    texts = [(r.doc_id, r.text) for r in both.collect()]
    check_windows(mixture_packing.pack_mixture(both, WORD_BPE, 2, weights, capacity=256).collect(), texts, 256)


def test_mixture_share_of_every_window(docs):
    """Each window holds each source at its share of all tokens, to within two tokens."""
    pieces = mixture_packing.pack_mixture(docs, WORD_BPE, 2)
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    rows = pieces.select("doc_id", "length", "sequence_id").collect()
    total, windows = Counter(), {}
    for r in rows:
        total[source[r.doc_id]] += r.length
        windows.setdefault(r.sequence_id, Counter())[source[r.doc_id]] += r.length
    everything = sum(total.values())
    for held in windows.values():
        size = sum(held.values())
        assert all(abs(held[s] - total[s] * size / everything) <= 2 for s in total)


def test_round_robin_equals_due_order():
    """Blocks start where the queues' tokens in order of their due times do; windows take every token once."""
    rnd = random.Random(3)
    for _ in range(60):
        totals = [rnd.randrange(1, 400) for _ in range(rnd.randrange(1, 7))]
        weights = None if rnd.random() < 0.4 else [rnd.randrange(1, 50) for _ in totals]
        r = mixture_packing.RoundRobin(totals, weights, 16, 3)
        w = weights or totals
        order = sorted((Fraction(2 * k + 1, w[s]), s) for s, n in enumerate(totals) for k in range(n))
        if weights is None:
            for b in range(r.blocks + 1):
                due = Counter(s for _, s in order[: b * 48])
                assert r.served(b)[0] == [due[s] for s in range(len(totals))]
        seen = Counter()
        for s, n in enumerate(totals):
            cuts = sorted({0, n, *(rnd.randrange(n) for _ in range(3))})
            for a, e in zip(cuts, cuts[1:], strict=False):
                for start, length, window, offset in r.pieces(s, a, e - a):
                    seen.update((window, offset + i) for i in range(length))
                    assert 0 <= start < e - a
        assert set(seen.values()) == {1} and len(seen) == sum(totals)
        for b in range(r.blocks + 1):
            served, deficit = r.served(b)
            assert all(abs(d) <= 1 for d in deficit) or weights


def test_mixture_many_sources_share_queues(spark, monkeypatch):
    monkeypatch.setattr(mixture_packing, "MOST_QUEUES", 4)
    monkeypatch.setattr(mixture_packing, "BROADCAST_ROWS", 0)
    rows = [(i, f"some words number {i} " * (i % 9), f"s{i % 13}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    check_windows(mixture_packing.pack_mixture(df, WORD_BPE, 2, capacity=64).collect(), [(d, t) for d, t, _ in rows], 64)


def test_mixture_empty_and_bad(spark, odd):
    assert mixture_packing.pack_mixture(odd.limit(0), WORD_BPE, 2).collect() == []
    with pytest.raises(ValueError, match="power of two"):
        mixture_packing.pack_mixture(odd, WORD_BPE, 2, capacity=100)
    with pytest.raises(ValueError, match="positive"):
        mixture_packing.pack_mixture(odd, WORD_BPE, 2, {"a": 0})


def brute_search(docs, items, top=10):
    pattern, small = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    cut = lambda t: pattern.findall((t or "").translate(small))
    held = [(d, Counter(x)) for d, t in docs if (x := cut(t))]
    n_docs, n_terms = len(held), sum(sum(f.values()) for _, f in held)
    df = Counter(t for _, f in held for t in f)
    out = []
    for item, text in items:
        terms, scored = set(cut(text)), []
        for d, f in held:
            m = 10 + (90 * sum(f.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * f[t]) // (1000 * f[t] + 8 * m)) for t in terms if f[t])
            if s > 0:
                scored.append((-s, math.inf if d is None else d))
        out += [(item, k + 1, None if d == math.inf else d, -s) for k, (s, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_search_equals_brute_force(spark, sf, docs, odd, monkeypatch):
    monkeypatch.setattr(lexical_search, "SEGMENT_DOCS", 16)
    monkeypatch.setattr(lexical_search, "FIRST_LOOK", 2)
    both = docs.select("doc_id", "text").union(odd.select("doc_id", "text"))
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").union(spark.createDataFrame([(900, "tie"), (901, None), (902, ""), (903, "nowhere-at-all"), (None, "One é"), (905, "three 's x")], "item_id long, text string"))
    assert found(lexical_search.search(both, items)) == brute_search([tuple(r) for r in both.collect()], [tuple(r) for r in items.collect()])


def test_search_in_blocks_of_items(spark, sf, docs, monkeypatch):
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    whole = found(lexical_search.search(docs, items, top=3))
    monkeypatch.setattr(lexical_search, "ITEMS", 7)
    assert found(lexical_search.search(docs, items, top=3)) == whole


def test_search_of_empty_tables(spark, docs, odd):
    items = spark.createDataFrame([(1, "tie one")], "item_id long, text string")
    assert lexical_search.search(docs.limit(0), items).collect() == []
    assert lexical_search.search(docs, items.limit(0)).collect() == []
    assert lexical_search.search(odd.where("doc_id in (1, 2)"), items).collect() == []


def test_search_query_equals_sql(spark, sf):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    got = queries.op12_lexical_search(spark, sf)
    want = c.sql(queries.ORACLES["op12_lexical_search"])
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())


def test_range_maxima():
    rnd = np.random.default_rng(5)
    v = rnd.integers(0, 50, 77)
    m = lexical_search.RangeMaxima(v, 77)
    a, b = rnd.integers(0, 78, 500), rnd.integers(0, 78, 500)
    a, b = np.minimum(a, b), np.maximum(a, b)
    top, where = m(a, b)
    for s, e, t, w in zip(a, b, top, where, strict=True):
        assert t == (v[s:e].max() if s < e else 0) and (s == e or s <= w < e and v[w] == t)


def brute_runs(w, least_words=24, least_repeats=3):
    out, n = [], len(w)
    for q in range(1, n // least_repeats + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            size = i - s + q
            if i > s and size >= max(least_words, least_repeats * q):
                x = w[s : s + size]
                if not any(x[p:] == x[: size - p] for p in range(1, q)):
                    out.append((s, size, q))
            i = max(i, s + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rnd = random.Random(1)
    for _ in range(1500):
        n, k = rnd.randrange(0, 110), rnd.choice([1, 2, 3, 10])
        w = [rnd.randrange(k) for _ in range(n)]
        if n > 5 and rnd.random() < 0.6:
            a, p = rnd.randrange(n), rnd.randrange(1, 12)
            for i in range(a + p, n):
                w[i] = w[i - p] if rnd.random() < 0.99 else w[i]
        for limits in ((24, 3), (6, 2), (1, 2), (10, 4)):
            assert periodic_runs.runs_of(w, *limits) == brute_runs(w, *limits)
    with pytest.raises(ValueError, match="twice"):
        periodic_runs.runs_of([1], 1, 1)


def test_long_runs_end_soon():
    assert periodic_runs.runs_of(["a"] * 100_000) == [(0, 100_000, 1)]
    assert periodic_runs.runs_of([*range(4000)] * 4 + ["end"]) == [(0, 16_000, 4000)]


def test_runs_query_equals_brute_force(spark, sf, docs, odd):
    def want(d, text, tail):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), crc32(str(d).encode())
        if tail and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute_runs(words) if n < 1500 else periodic_runs.runs_of(words)
        gone = {i for s, size, q in runs for i in range(s + q, s + size)}
        top = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        four = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        return (d, len(runs), *four, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))

    got = sorted(map(tuple, queries.op13_periodic_runs(spark, sf).collect()))
    assert got == sorted(want(r.doc_id, r.text, True) for r in docs.collect())
    assert sum(r[1] for r in got) > 5
    plain = periodic_runs.run_digests(periodic_runs.periodic_runs(odd))
    assert sorted(map(tuple, plain.collect()), key=str) == sorted((want(d, t, False) for d, t, _ in ODD), key=str)
    assert periodic_runs.periodic_runs(odd.limit(0)).collect() == []
