"""Lexical search, periodic runs and license scans against plain versions, on small tables with hard cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewise.llm import lexical, licenses, periodic
from tidewise.plans import scratch

DOCS = "doc_id long, text string, source string, no long, id long, term string, n_words long"


def docs_of(spark, rows):
    """Rows (doc_id, text), with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "s", 1, 2, "x", 3) for i, t in rows], DOCS)


def lower_az(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def term_list(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower_az(text or ""))


# --- search ---------------------------------------------------------------------------------------------------------


def plain_search(rows, items, k):
    docs = [(i, Counter(t)) for i, text in rows if (t := term_list(text))]
    n_all, l_all = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(term_list(text))
    out = []
    for item, own in asked.items():
        found = []
        for doc_id, c in docs:
            m, score = 50 + (50 * c.total() * n_all) // l_all, 0
            for t in own & c.keys():
                w = math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1)))
                score += w * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                found.append((-score, doc_id is None, doc_id))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(found)[:k], 1)]
    return Counter(out)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)] + ["ÉTÉ", "été", "x_y", "don't", "A1"]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 3, 10, 40, 200])))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " .,; "), (None, "w1 w2 w3"), (None, "w1 w2 w3"), (203, "w7 " * 30_000 + "rare"), (204, rows[3][1]), (204, rows[3][1]), (3, rows[3][1]), (205, "common " * 3), (206, "rare " * 7)]
    rows += [(300 + i, "w1 w2 w3") for i in range(80)]  # ties beyond the k-th
    items = [("a", "W1 w2, w3!"), ("b", rows[8][1]), ("c", None), ("d", ""), ("e", "nowhere to be found"), ("f", "rare w7"), (None, "w9 w10"), ("a", "w1 w2 w3"), ("b", "x y don t")]
    return rows, items


@pytest.mark.parametrize("k", [1, 5, 50])
def test_search(spark, texts, k):
    rows, items = texts
    found = lexical.search(lexical.Index(docs_of(spark, rows)), spark.createDataFrame(items, "item_id string, text string"), k)
    assert dict(found.dtypes) == {"item_id": "string", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert Counter(map(tuple, found.collect())) == plain_search(rows, items, k)


def test_search_in_blocks_and_small_signatures(spark, texts, monkeypatch):
    """Items in several broadcasts, shuffled joins, blocks of eight documents, terms unpacked in parts."""
    rows, items = texts
    monkeypatch.setattr(scratch, "BROADCAST_BYTES", 0)
    for name, value in (("BLOCK_DOCS", 8), ("UNPACKED", 4)):
        monkeypatch.setattr(lexical, name, value)
    found = lexical.search(lexical.Index(docs_of(spark, rows)), spark.createDataFrame(items, "item_id string, text string"), 7, query_bytes=400)
    assert Counter(map(tuple, found.collect())) == plain_search(rows, items, 7)


def test_search_of_empty_tables(spark, texts):
    rows, items = texts
    none, some = docs_of(spark, [(1, None)]), spark.createDataFrame(items, "item_id string, text string")
    assert lexical.search(lexical.Index(none), some).count() == 0
    assert lexical.search(lexical.Index(docs_of(spark, rows)), some.limit(0)).count() == 0


def test_bounds_are_never_below_scores_and_exclude_most():
    rng = np.random.default_rng(2)
    blocks, docs = lexical._Blocks(), []
    names = np.array([int.from_bytes(hashlib.sha256(bytes([i])).digest()[:8], "big") for i in range(200)], np.uint64)
    closed = []
    for i in range(400):
        own, n = rng.choice(200, 50, replace=False), 300
        tf = np.where(rng.random(50) < 0.7, 1, rng.integers(1, 90, 50))
        docs.append((own, tf))
        row = blocks.add(i, n, names[own], tf)
        closed += [row] if row else []
    closed += blocks.rest()
    q = lexical.Queries.__new__(lexical.Queries)
    q.hashes, q.weights = names, rng.integers(1, 9000, 200)
    items = [np.sort(rng.choice(200, 30, replace=False)) for _ in range(5)]
    over = total = 0
    for m, slices, ids, lens, _, _ in closed:
        bound = q.bounds(np.arange(200), items, m, slices, np.full(len(ids), 100))
        for i, item in enumerate(items):
            for j, d in enumerate(ids):
                own, tf = docs[d]
                score = sum(int(q.weights[t]) * ((10**9 * int(f)) // (1000 * int(f) + 2000)) for t, f in zip(own, tf, strict=True) if t in set(item.tolist()))
                assert bound[i, j] >= score
                over += bound[i, j] - score
                total += score
    assert over < 0.1 * total


# --- runs -----------------------------------------------------------------------------------------------------------


def plain_runs(w, least=12):
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_small_alphabets():
    rng = random.Random(11)
    for _ in range(1500):
        n, a = rng.randint(0, 80), rng.choice([1, 2, 2, 3, 4])
        if rng.random() < 0.4:
            w = [rng.randrange(a) for _ in range(n)]
        else:
            w = []
            while len(w) < n:
                r = [rng.randrange(a) for _ in range(rng.randint(1, 12))]
                for _ in range(rng.randint(1, 3)):
                    r = (r * rng.randint(1, 4))[: rng.randint(1, 40)]
                w += r
        least = rng.choice([2, 12])
        assert [tuple(r) for r in periodic.runs_of(np.array(w, np.int64), least).tolist()] == plain_runs(w, least)


def test_runs_of_fibonacci_words():
    x, y = [0], [0, 1]
    while len(y) < 400:
        x, y = y, y + x
    assert [tuple(r) for r in periodic.runs_of(np.array(y), 2).tolist()] == plain_runs(y, 2)


def plain_tail(words, doc_id):
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def plain_row(doc_id, text):
    words = plain_tail(re.findall(r"[^\x20\x09-\x0D]+", text or ""), doc_id)
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    said = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    first = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *first, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(), kept)


def test_find_runs(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices("ab cd ef gh é".split(), k=rng.choice([0, 5, 60, 150])))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " \t\n"), (None, "a b " * 20), (503, "x y " * 30), (504, "one two three " * 9 + "four " * 15), (504, "one two three " * 9 + "four " * 15), (None, None), (505, "\x0bq\x0c" * 14)]
    monkeypatch.setattr(periodic, "CHUNK_WORDS", 300)
    got = periodic.find_runs(docs_of(spark, rows), tail=True, texts=True, keep=("term", "n_words"))
    assert got.columns[-2:] == ["term", "n_words"]
    assert Counter(map(tuple, got.drop("term", "n_words").collect())) == Counter(plain_row(*r) for r in rows)
    assert periodic.find_runs(docs_of(spark, [])).count() == 0
    assert sum(r.n_runs for r in periodic.find_runs(docs_of(spark, [(7, "a b c " * 10)])).collect()) == 1


def test_long_texts_of_repeats_stay_near_linear():
    for w in (np.zeros(60_000, np.int64), np.arange(60_000) % 17_000, np.arange(60_000) % 2):
        assert len(periodic.runs_of(w)) == 1


# --- licenses -------------------------------------------------------------------------------------------------------


def plain_scan(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_az(text or ""))
    at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + p.count(" ") + 1] == p.split()]
    places = [i for i, _ in at]
    return len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({label for _, label in at}))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_labels(text):
    """Labels of notices that some words of the text, joined by blanks, equal up to their edits."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_az(text or ""))
    found = {label for p, label in licenses.PHRASES.items() if f" {p} " in f" {' '.join(w)} "}
    for notice, label, k in licenses.NOTICES:
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                piece = " ".join(w[i:j])
                if len(piece) > len(notice) + k:
                    break
                if len(piece) >= len(notice) - k and edits(piece, notice) <= k:
                    found.add(label)
    return ",".join(sorted(found))


@pytest.fixture(scope="module")
def noted():
    rng = random.Random(8)
    words = "the of license general public gnu apache mit by cc version 2 0 under work is Licensed É free copy".split()
    rows = []
    for i in range(150):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 12)))]
        for _ in range(rng.randint(0, 2)):
            notice, _, k = rng.choice(licenses.NOTICES)
            t = list(notice)
            for _ in range(rng.randint(0, k + 2)):
                p = rng.randrange(len(t))
                t[p : p + 1] = rng.choice([[], [rng.choice("abcxyz ")], [t[p], rng.choice("abcxyz")]]) or []
                t = t or ["x"]
            parts += ["".join(t).replace(" ", rng.choice([" ", "  ", ", ", "\n"])), " ".join(rng.choices(words, k=rng.randint(0, 5)))]
        rows.append((i, " ".join(parts)))
    rows += [(900, None), (901, ""), (902, "..."), (None, "MIT License"), (903, "mit mit license mit license"), (903, "mit mit license mit license"), (904, "cc by cc by"), (905, "limit license"), (906, "CC-BY 4.0"), (907, "filler " * 20_000 + "GNU General Public License")]
    return rows


def test_license_scan(spark, noted):
    got = licenses.scan(docs_of(spark, noted), keep=("n_words", "term")).collect()
    assert len(got) == len(noted)
    base = Counter((r[0], *r[1:6]) for r in got)
    assert base == Counter((i, *plain_scan(t)) for i, t in noted)
    long = {907}
    labels = Counter((r[0], r.labels) for r in got if r[0] not in long)
    assert labels == Counter((i, plain_labels(t)) for i, t in noted if i not in long)
    for r in got:
        assert 0 <= r.score <= 1 and (r.score == 1 if r[2] else True) and (r.score > 0) == bool(r.labels)
        for s in r.spans:
            label, a, z, e = s.split(":")
            assert label in r.labels and 0 <= int(a) < int(z) <= r[1] and int(e) >= 0
    assert licenses.scan(docs_of(spark, [])).count() == 0


def test_spans_hold_the_notice_within_its_edits():
    search = licenses.Search()
    _, _, _, _, base, labels, score, spans = search.scan(b"Released under the GNU Genral Publik License, v3")
    assert (base, labels, spans) == ("", "gpl", ["gpl:3:7:2"])
    assert score == pytest.approx(1 - 2 / 26)


def test_pieces_cover_the_notice():
    for notice, _, k in licenses.NOTICES:
        cut = licenses.pieces(notice, k)
        assert len(cut) == k + 1 and "".join(p for _, p in cut) == notice
        assert all(notice[a : a + len(p)] == p for a, p in cut)


def test_queries_return_whole_tables(spark, sf):
    from tidewise.llm import queries

    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name in ("op12_periodic_runs", "op13_license_scan"):
        out = queries.queries()[name](spark, sf)
        assert out.count() == n and out.select(F.count_distinct("doc_id")).first()[0] == n
