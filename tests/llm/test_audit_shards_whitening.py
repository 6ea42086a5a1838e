"""Whitening, the filter audit and sharding against plain loops, and their edge cases."""

import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotledger.llm import common, filter_audit, queries, sharding, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string"
LABELS = "doc_id long, quality int, toxic int"
EDGE = [
    (1, None, "en", "a", 0, "x"),
    (2, "", None, None, 0, "x"),
    (3, " \n\t ", "en", "a", 3, None),
    (4, "one two three", "en", None, 13, "x"),
    (4, "one two three", "en", None, 13, "x"),
    (None, "One two THREE", "fr", "b", 13, "x"),
    (5, "One two THREE", "fr", "b", 13, "x"),
    (6, "one two three", "", "b", 13, "x"),
    (7, "word " * 50_000, "en", "a", 250_000, "x"),
    (8, "x" * 100_000, "en", "a", 100_000, "x"),
    (9, "▁ ▁▁a é 日本 😀 <s> <0x0A> #", "de", "b", 25, "x"),
    (10, " ".join(f"wort{i}" for i in range(300)), "de", "b", 25, "x"),
]


@pytest.fixture
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


# Whitening


def plain_components(rows, k=4):
    """The contract by numpy's eigenvalues, over the distinct vectors."""
    kept = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array(sorted({tuple(v) for _, v in kept}), dtype=np.float64)
    centred = x - x.mean(axis=0)
    e, u = np.linalg.eigh(centred.T @ centred / len(x))
    order = np.argsort(-e)[: min(k, int((e > 1e-9 * max(e.max(), 1e-300)).sum()))]
    total = [sum(int(v) for v in column) for column in zip(*x.astype(int).tolist(), strict=True)]
    out = []
    for i, v in kept:
        deviation = sum((len(x) * c - s) ** 2 for c, s in zip(v, total, strict=True))
        for j, o in enumerate(order, 1):
            out.append((i, j, len(x), deviation, (np.array(v) - x.mean(axis=0)) @ u[:, o] / math.sqrt(e[o]), e[o] / e.sum()))
    return out


def agree(got, want):
    key = lambda r: (str(r[0]), r[1], r[3], abs(r[4]))
    got = sorted(((r[0], r.component, r.n, r.deviation, r.whitened, r.explained) for r in got), key=key)
    want = sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([abs(r[4]) for r in got], [abs(r[4]) for r in want], rtol=1e-7, atol=1e-7)
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    for c in {r[1] for r in got}:  # either sign, the same for all rows
        signs = {np.sign(a[4] * b[4]) for a, b in zip(got, want, strict=True) if a[1] == c and abs(b[4]) > 1e-5}
        assert len(signs) <= 1


def test_whitening_query_is_plain(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    got = queries.op11_whitening(spark, sf).collect()
    agree(got, plain_components([tuple(r) for r in rows]))
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_whitening_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 6)) * [9, 5, 3, 2, 0, 1] + 1e5
    base[:, 5] = base[:, 0]
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(base)]
    rows += [(0, rows[0][1]), (None, rows[1][1]), (70, rows[2][1]), (71, None), (72, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (73, [math.nan] * 6), (74, [math.inf] + [0.0] * 5)]
    df = spark.createDataFrame(rows, "id long, v array<double>").withColumns({"x": F.lit(1), "c": F.lit("c"), "vec_id": F.lit(0)})
    agree(whitening.whiten(df, "id", "v").collect(), plain_components(rows))
    small = df.filter("id IN (1, 2, 3)")
    assert {r.component for r in whitening.whiten(small, "id", "v").collect()} == {1, 2}
    assert whitening.whiten(df.filter("id = 4"), "id", "v").count() == 0
    assert whitening.whiten(df.limit(0), "id", "v").count() == 0


def test_whitening_of_lengths_and_large_entries(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(size=3)]) for i in range(50)] + [(100 + i, [float(v) for v in rng.normal(size=5)]) for i in range(40)]
    df = spark.createDataFrame([*rows, (900, []), (901, [])], "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    agree([r for r in got if r.vec_id < 100], plain_components(rows[:50]))
    agree([r for r in got if r.vec_id >= 100], plain_components(rows[50:]))
    large = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id for r in large} == {1, 2, 3} and {r.deviation for r in large if r.vec_id < 3} == {None}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 20])
def test_factor_and_rotations(n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(50, n)) * 10.0 ** -np.arange(n)
    a = x.T @ x
    l = whitening.pivoted_cholesky(a)
    assert np.allclose(l @ l.T, a, rtol=1e-12, atol=1e-12 * a.max())
    rotated = whitening.orthogonal_columns(l)
    assert np.allclose(rotated @ rotated.T, a, rtol=1e-12, atol=1e-12 * a.max())
    squared = np.sort((rotated**2).sum(axis=0))[::-1]
    assert np.allclose(squared, np.linalg.svd(x, compute_uv=False)[: len(squared)] ** 2, rtol=1e-9)
    assert whitening.pivoted_cholesky(np.zeros((n, n))).shape == (n, 0)


# Audit of filters


def plain_audit(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    docs = defaultdict(list)
    least = {}
    for d, text, *_ in rows:
        if d is not None:
            least[text or ""] = min(least.get(text or "", d), d)
    for d, text, lang, *_ in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = ""
        failed += "A" * (len(w) < 200)
        failed += "B" * (100 * len(set(w)) < 50 * len(w))
        failed += "C" * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text))
        failed += "D" * bool(re.search("[#$%&*|]", text))
        failed += "E" * (d is not None and d > least[text])
        docs[lang or ""].append((failed, d in good, d in toxic))
    out = []
    for part, all_ in docs.items():
        steps, shapley = [], Counter()
        for order in map("".join, permutations("ABCDE")):
            left = list(all_)
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                failing = [x for x in all_ if f in x[0]]
                shapley[f] += len(gone)
                steps.append((part, order, step, len(left), len(gone), len(failing) - len(gone), sum(x[0] == f for x in failing), sum(x[1] for x in gone), sum(x[2] for x in gone)))
        out += [(*s, shapley[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.mark.parametrize("most", [0, 50_000])
def test_audit_is_plain(spark, edge, monkeypatch, most):
    monkeypatch.setattr(filter_audit, "MAX_BROADCAST_ROWS", most)
    labels = [(1, 1, 0), (1, 0, 1), (4, 1, None), (None, 1, 1), (7, 0, 1), (99, 1, 1)]
    docs = edge.withColumns({c: F.lit("z") for c in ("part", "mask", "digest", "first", "_t", "good", "edge", "state")})
    got = filter_audit.audit(docs, spark.createDataFrame(labels, LABELS).withColumn("part", F.lit(1)))
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == plain_audit(EDGE, labels)


def test_audit_without_rows(spark, edge):
    labels = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(edge.limit(0), labels).count() == 0
    assert sorted(map(tuple, filter_audit.audit(edge, labels).collect())) == plain_audit(EDGE, [])


@pytest.mark.parametrize("k", [1, 3, 5])
def test_paths_count_orders(k):
    reach, leave = filter_audit.paths(k)
    assert reach[-1] == leave[0] == math.factorial(k)
    for s in range(1 << k):
        n = bin(s).count("1")
        assert (reach[s], leave[s]) == (math.factorial(n), math.factorial(k - n))


# Shards


def plain_checks(rows, got, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(shards))
    return {s: len(v) for s, v in slots.items()}


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards_of_edge_cases(spark, edge, monkeypatch, law):
    docs = edge.withColumns({c: F.lit(None).cast("string") for c in ("key", "size", "copies", "rank", "place", "n")})
    got = sharding.assign(docs, 5, law).collect()
    plain_checks(EDGE, got, 5)
    monkeypatch.setattr(common, "AT_ONCE", 1)
    monkeypatch.setattr(sharding, "MAX_BROADCAST_ROWS", 0)
    assert Counter(got) == Counter(sharding.assign(docs.repartition(3), 5, law).collect())
    assert sharding.assign(docs.limit(0), 5, law).count() == 0


def test_shards_match_the_mixture(spark):
    rows = [(i, f"text {i} " * (1 + i % 5), None, "web" if i % 3 else "books" if i % 2 else None) for i in range(1000)]
    rows += [(None, "the same", None, "web")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = sharding.assign(docs, 7).collect()
    counts = plain_checks(rows, got, 7)
    assert max(counts.values()) - min(counts.values()) <= 1
    total = Counter(r[3] for r in rows)
    for shard in range(7):
        mine = Counter(r.source for r in got if r.shard == shard)
        assert all(abs(mine[s] - n / 7) <= 2 for s, n in total.items())
    assert Counter(got) == Counter(sharding.assign(docs.repartition(5), 7).collect())
    assert Counter(got) != Counter(sharding.assign(docs, 7, seed="other").collect())
    by_bytes = sharding.assign(docs, 7, law="bytes").collect()
    plain_checks(rows, by_bytes, 7)
    sizes = Counter()
    for r in by_bytes:
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in by_bytes)


def test_sharded_rows_are_the_documents(spark, edge):
    docs = edge.union(edge.filter("doc_id = 4").withColumn("n_chars", F.lit(99)))
    out = sharding.sharded(docs, 3).collect()
    assert Counter(tuple(r.row) for r in out) == Counter(map(tuple, docs.collect()))
    places = sharding.assign(docs, 3).collect()
    assert Counter((r.row.doc_id, r.shard, r.slot) for r in out) == Counter((r.doc_id, r.shard, r.slot) for r in places)
    with pytest.raises(ValueError):
        sharding.assign(docs, 3, law="none")
