"""Whole queries and pipeline stages recomputed in plain Python from the tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lotledger.llm import language_id, queries, sql, wordpiece

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words_of(text):
    return [w for w in SPACE.split(text or "") if w]


def naive_pieces(word, starts, continuations, longest):
    """Number of greedy longest pieces; 0 if the word can't be split."""
    at = n = 0
    while at < len(word):
        table = starts if at == 0 else continuations
        step = next((k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in table), 0)
        if not step:
            return 0
        at, n = at + step, n + 1
    return n


def test_token_counts_query_is_greedy(spark, sf_dir):
    starts, continuations = map(set, wordpiece.vocabulary(queries.piece_model()))
    longest = max(map(len, starts | continuations))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op4_token_counts(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        n = [naive_pieces(w, starts, continuations, longest) for w in words_of(texts[r.doc_id])]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(n), sum(n) + n.count(0), n.count(0))


def naive_trigrams(text):
    plain = "".join(chr(c).lower() if 65 <= c <= 90 else " " if c < 33 or 48 <= c <= 57 else chr(c) for c in (text or "").encode())
    plain = " " + " ".join(w for w in plain.split(" ") if w) + " "
    return [plain[i : i + 3] for i in range(len(plain) - 2)]


def naive_languages(docs, pages):
    """page_id: (lang, probability, text_lang), from documents (lang, text) and pages (page_id, url, html)."""
    counts = defaultdict(Counter)
    for lang, text in docs:
        if lang is not None and text is not None:
            counts[lang].update(naive_trigrams(text))
    langs = sorted(counts)
    kept = {k: {t: n for t, n in c.items() if n >= 1e-6 * sum(c.values())} for k, c in counts.items()}
    size = len(set().union(*kept.values())) + 1
    logs = lambda k, t: math.log((kept[k].get(t, 0) + 0.5) / (sum(kept[k].values()) + 0.5 * size))
    rows = []
    for page, url, html in pages:
        grams = naive_trigrams(language_id.visible(html))
        z = [sum(logs(k, t) for t in grams) / max(1, len(grams)) * min(40, len(grams)) for k in langs]
        p = [math.exp(x - max(z)) for x in z]
        host = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", url or "")
        host = host[1].lower() if host else None
        declared = re.search(r"<html[^>]*\slang=[\"']?([A-Za-z]{2,3})", html or "", re.I)
        rows.append((page, [x / sum(p) for x in p], host, declared[1].lower() if declared else None, host.rsplit(".", 1)[1] if host and "." in host else None))
    n = len(langs)
    add = lambda some: [sum(r[1][i] for r in some) for i in range(n)]
    domain = lambda host: ".".join(host.split(".")[-2:]) if "." in host else ""

    def likelihood(r, at):
        if r[at] is None:
            return [1.0] * n
        told = [x for x in rows if x[at] is not None]
        own, every = add([x for x in told if x[at] == r[at]]), add(told)
        return [(own[i] + 1) / (every[i] + len({x[at] for x in told})) for i in range(n)]

    everything, out = add(rows), {}
    for r in rows:
        prior = [g / sum(everything) for g in everything]
        if r[2] is not None:
            near = add([x for x in rows if x[2] is not None and domain(x[2]) == domain(r[2])])
            above = [(near[i] + 5 * prior[i]) / (sum(near) + 5) for i in range(n)]
            others = [max(0.0, a - b) for a, b in zip(add([x for x in rows if x[2] == r[2]]), r[1], strict=True)]
            prior = [(others[i] + 5 * above[i]) / (sum(others) + 5) for i in range(n)]
        weight = [a * b * c * d for a, b, c, d in zip(r[1], prior, likelihood(r, 3), likelihood(r, 4), strict=True)]
        out[r[0]] = (langs[weight.index(max(weight))], max(weight) / sum(weight), langs[r[1].index(max(r[1]))])
    return out


def test_languages_query_is_the_plain_formula(spark, sf_dir):
    docs = [(r.lang, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = naive_languages(docs, [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()])
    got = {r.page_id: r for r in queries.op5_language_id(spark, sf_dir).collect()}
    assert got.keys() == want.keys()
    for page, (lang, probability, text_lang) in want.items():
        assert (got[page].lang, got[page].text_lang) == (lang, text_lang)
        assert got[page].probability == pytest.approx(probability, rel=1e-6)


def test_languages_of_odd_pages(spark):
    docs = [("en", "the cat and the dog"), ("de", "der hund und die katze " * 40), (None, "x"), ("fr", None), ("en", "")]
    pages = [(1, "http://a.x.com/p", "<html lang=en>the dog"), (2, "http://a.x.com", None), (3, "http://b.x.com", "der hund " * 30_000), (4, None, "und"), (5, "ftp", ""), (6, "http://localhost/", "<html lang='de'>"), (7, "http://a.x.com/q", "katze"), (8, "http://a.x.com/q", "katze")]
    clash = [f"'z' as {c}" for c in ("host", "declared", "text_p", "suffix", "w", "g", "lang")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", *clash)
    got = {r.page_id: (r.lang, r.probability) for r in language_id.identify(table, spark.createDataFrame(docs, "lang string, text string").selectExpr("*", "1 as n", "2 as trigram")).collect()}
    want = naive_languages(docs, pages)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(v[1], rel=1e-6) for k, v in want.items())


def naive_statistics(text):
    words = words_of(text)
    if not words:
        return [0.0] * 14
    n, held = len(words), "".join(words)
    share = lambda chars: math.sqrt(sum(c in chars for c in held) / len(held))
    lines = [x for x in text.split("\n") if words_of(x)]
    return [
        math.log(1 + n), math.log(len(held) / n), math.log(1 + len(set(words))) / math.log(1 + n), share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("0123456789"), share("#*$%&<>"), share("!?"), share("|"),
        math.sqrt(sum(w.count(".") for w in words) / n), math.sqrt(sum(w.count(",") for w in words) / n), math.sqrt(1 - len(set(lines)) / len(lines)),
        math.sqrt(sum(a == b for a, b in zip(words, words[1:], strict=False)) / n), math.log(max(len(w) for w in words)), math.sqrt(len(lines) / n),
    ]


def naive_scores(docs, labels):
    """doc_id: probability of label 1, by log densities of normal distributions."""
    said = defaultdict(set)
    for d, q in labels:
        if q in (0, 1):
            said[d].add(q)
    x = {d: np.array(naive_statistics(t)) for d, t in docs}
    rows = [(next(iter(said[d])), x[d]) for d, _ in docs if len(said[d]) == 1 and zlib.crc32(str(d).encode()) % 5]
    by = [np.array([v for q, v in rows if q == c]) for c in (0, 1)]
    if not all(len(m) for m in by):  # no class to compare with: the odds alone
        share = (len(by[1]) + 1) / (len(by[0]) + len(by[1]) + 2) if len(rows) else 0.5
        return dict.fromkeys(x, share)
    scatter = [np.cov(m.T, bias=True) * len(m) for m in by]
    pooled = (scatter[0] + scatter[1]) / len(rows)
    density = []
    for m, s in zip(by, scatter, strict=True):
        cov = 0.8 * (s + 10 * pooled) / (len(m) + 10) + 0.2 * pooled
        cov = 0.95 * cov + 0.05 * np.diag(np.diag(cov)) + 1e-4 * np.eye(len(cov))
        mean, det = m.mean(axis=0), np.linalg.slogdet(cov)[1]
        density.append(lambda v, mean=mean, cov=cov, det=det, n=len(m): math.log(n) - 0.5 * ((v - mean) @ np.linalg.solve(cov, v - mean) + det))
    odds = {d: density[1](v) - density[0](v) for d, v in x.items()}
    return {d: 1 / (1 + math.exp(-max(-700, min(700, z)))) for d, z in odds.items()}


def test_classifier_query_is_the_plain_formula(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = naive_scores(docs, [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()])
    got = queries.op10_quality_classifier(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.score == pytest.approx(want[r.doc_id], rel=1e-5, abs=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert abs(want[r.doc_id] - 0.3) < 1e-6 or r.predicted == (want[r.doc_id] >= 0.3)


def test_pipeline_stages_are_brute_force(spark, sf_dir):
    """Every stage on what the one before has kept, against SQL, plain loops or the library."""
    import corpus_pipeline
    import sentencepiece
    from test_llm import components

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    con = duckdb.connect()

    def by_sql(df, statement):
        table = pa.Table.from_pylist([r.asDict() for r in df.collect()], pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]))
        con.register("documents", table)
        return con.sql(statement).df()

    first = stages[0](spark, docs, sf_dir).collect()
    rules = by_sql(docs, sql.OP3)
    assert Counter(r.doc_id for r in first) == Counter(rules[rules.kept].doc_id)
    first = spark.createDataFrame(first, docs.schema)
    second = stages[1](spark, first, sf_dir).collect()
    scores = naive_scores([(r.doc_id, r.text) for r in first.collect()], [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()])
    assert {r.doc_id for r in second} == {d for d, s in scores.items() if s >= 0.3}
    groups = {int(d): c for d, _, c in components([(r.doc_id, r.text) for r in second], 5, 80, 100)}
    second = spark.createDataFrame(second, docs.schema)
    third = stages[2](spark, second, sf_dir).collect()
    assert Counter(groups[r.doc_id] for r in third) == Counter(set(groups.values()))
    third = spark.createDataFrame(third, docs.schema)
    fourth = stages[3](spark, third, sf_dir).collect()
    taken = by_sql(third, sql.OP6)
    assert Counter(r.doc_id for r in fourth) == Counter({d: int(t / s) for d, t, s in zip(taken.doc_id, taken.taken, taken["size"], strict=True) if t})
    last = stages[4](spark, spark.createDataFrame(fourth, docs.schema), sf_dir).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    assert sorted((r.doc_id, tuple(r.ids), r.decoded) for r in last) == sorted((r.doc_id, tuple(ids), library.decode(ids)) for r in fourth for ids in [library.encode(r.text)])


EDGE = [(1, None, "en", "a", 0), (2, "", None, None, 0), (3, " \n", "en", "a", 2), (4, "one two three", "en", None, 13), (4, "one two three", "en", None, 13), (None, "One two", "fr", "b", 7), (7, "word " * 50_000, "en", "a", 250_000), (8, "x" * 100_000, "en", "a", 100_000)]


@pytest.mark.parametrize("empty", [False, True])
def test_stages_take_odd_tables(spark, sf_dir, empty):
    """Nulls, blanks, very long texts and repeated rows: rules reject what has under 20 words or repeats itself; the
    later stages keep or count what they are given."""
    import corpus_pipeline

    stages = [f for _, f in corpus_pipeline.STAGES]
    docs = spark.createDataFrame([] if empty else EDGE, "doc_id long, text string, lang string, source string, n_chars long")
    assert stages[0](spark, docs, sf_dir).count() == 0
    kept = stages[1](spark, docs, sf_dir)
    assert kept.columns == docs.columns and kept.count() == (0 if empty else len(EDGE))  # no labels: even odds
    texts = Counter(r.text for r in stages[2](spark, docs, sf_dir).collect())
    assert texts == ({} if empty else {None: 1, "": 1, " \n": 1, "one two three": 1, "One two": 1, "word " * 50_000: 1, "x" * 100_000: 1})
    mixed = Counter(r.doc_id for r in stages[3](spark, docs, sf_dir).collect())
    assert not set(mixed) & {1, 2, 3} and max(mixed.values(), default=0) <= 4
    encoded = stages[4](spark, docs, sf_dir).collect()
    assert len(encoded) == (0 if empty else len(EDGE)) and all(r.n_tokens == len(r.ids) for r in encoded)
