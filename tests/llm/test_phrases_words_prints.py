"""Collocations, spelling variants and fingerprints against brute force; nulls, ties, repeats, long texts, small buffers."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.test_operators import lower, same

# op11


def brute_collocations(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n-\r]", lower(text)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in (1, 2, 3):
                f.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    chosen = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = defaultdict(list)
    for (lang, p), a in chosen.items():
        if any(100 * f[lang, q] >= 50 * a for g, q in chosen if g == lang and len(q) > len(p) and p in (q[: len(p)], q[-len(p) :])):
            continue
        cuts = [(1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]


@pytest.fixture(scope="module")
def talk(plain):
    rng = random.Random(9)
    words = ["The", "of", "tiny", "dog\x00", "café", "a b", "x\x85y", "日本", "'s", "run"]
    rows = [(rng.choice(["en", "fr", None]), " ".join(rng.choice(words) + rng.choice(["", "", "", ",", "\n", "\t", ". "]) for _ in range(rng.randint(0, 60)))) for _ in range(150)]
    rows += [("en", "one two three " * 200), ("de", "never again"), ("fr", "." * 500), ("en", None), ("en", "")] + [("en", t) for _, t in plain]
    return rows


@pytest.mark.parametrize("least, top, shards, buffer", [(10, 2000, 4, 1 << 20), (2, 7, 3, 300), (5, 40, 1, 1000)])
def test_collocations(spark, monkeypatch, talk, least, top, shards, buffer):
    from sheetloom.llm import collocations as op

    monkeypatch.setattr(op, "BUFFER", buffer)
    monkeypatch.setattr(op, "CUT", buffer)
    expected = brute_collocations([("und" if g is None else g, t) for g, t in talk], least, top)
    docs = spark.createDataFrame([(i, t, g) for i, (g, t) in enumerate(talk)], "doc_id long, text string, lang string").selectExpr("*", "1 AS n", "'x' AS phrase", "2 AS size", "3 AS shard", "4 AS rank").repartition(5)
    # 64 bits let nearly everything pass: the result does not depend on the filter.
    for bits in (1 << 16, 64):
        same(op.collocations(docs, least, 3, top, shards, bits).collect(), expected)
        if buffer > 300:
            break


def test_collocations_of_nothing(empty):
    from sheetloom.llm.collocations import collocations

    assert collocations(empty).count() == 0


def test_known_phrases_are_not_counted_again():
    """Counts are written of phrases that have not reached the threshold yet; pairs of early words are not late."""
    from sheetloom.llm import collocations as op

    every, none = op.Filter(64), op.Filter(64)
    every.words[:] = np.uint64(2**64 - 1)
    words = [b"a", b"b", b"c"] * 20 + [op.BREAK]

    def rows(now, first):
        return [r for b in op._buffer_counts("en", words, [1, 2, 3], now, {1: none, 2: none}, first) for r in b.to_pylist()]

    assert sorted((r["size"], r["c"], r["late"]) for r in rows({1: every, 2: every}, every)) == [(3, 19, True), (3, 19, True), (3, 20, True)]
    for first, late in ((every, False), (none, True)):
        assert sorted((r["c"], r["late"]) for r in rows({1: every, 2: none}, first)) == [(19, late), (20, late), (20, late)]
    assert [r["c"] for r in rows({1: none, 2: none}, None)] == [20, 20, 20]


def test_phrases_become_active_while_shorter_ones_are_counted(spark):
    """With every phrase frequent in each shard, two-word phrases start at the second tick, three-word ones at the third."""
    from sheetloom.llm import collocations as op

    first = {}
    real = op._counted

    def watch(docs, sizes, sent):
        for n in sizes:
            first.setdefault(n, []).append(1)
        return real(docs, sizes, sent)

    docs = spark.createDataFrame([(i, "red green blue", "en") for i in range(400)], "doc_id long, text string, lang string")
    op._counted = watch
    try:
        counts, _ = op.phrase_counts(docs, shards=4)
    finally:
        op._counted = real
    assert {r["phrase"]: r["count"] for r in counts.df.collect()} == {p: 400 for p in ("red", "green", "blue", "red green", "green blue", "red green blue")}
    assert {n: len(t) for n, t in first.items()} == {1: 4, 2: 7, 3: 10}


# op12


def brute_variants(rows):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            count[w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        s, t = sorted((a, b), key=len)
        return len(t) - len(s) == 1 and any(t[:k] + t[k + 1 :] == s for k in range(len(t)))

    close = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, found in close.items():
        if found:
            best = min(found, key=lambda v: (-words[v], v))
            if words[best] >= 2 * words[w]:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(close[w]), words[form[w]] if w in form else None))
    return out


@pytest.fixture(scope="module")
def spelt(plain):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcé÷×Z") for _ in range(rng.randint(3, 9))) for _ in range(30)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ababab", "bababa", "abcabc" * 40]
    words = []
    for w in base:
        for _ in range(rng.randint(3, 60)):
            v, at = w, rng.randrange(len(w))
            v = rng.choice([v, v, v[:at] + v[at + 1 :], v[:at] + "é" + v[at:], v[:at] + "b" + v[at + 1 :]])
            words += [v] * rng.choice([1, 3, 9])
    words += ["qwertyu"] * 4 + ["qwertyx"] * 12 + ["qwertyxx"] * 40  # a chain of forms
    rng.shuffle(words)
    rows = [(k, rng.choice([" ", "_", "Ā", "9", "🙂"]).join(words[k::90])) for k in range(90)]
    return rows + plain


@pytest.mark.parametrize("tile, stack", [(512, 1 << 14), (3, 50), (1, 1)])
def test_spelling_variants(spark, monkeypatch, docs, spelt, tile, stack):
    from sheetloom.llm import spelling as op

    monkeypatch.setattr(op, "STACK", stack)
    monkeypatch.setattr(op, "CELLS", 5000 if tile < 512 else op.CELLS)
    monkeypatch.setattr(op, "FLUSH", 40 if tile < 512 else op.FLUSH)
    more = spark.createDataFrame(spelt, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS word", "'x' AS key", "3 AS root").repartition(4)
    expected = brute_variants(spelt)
    assert sum(r[1] is not None for r in expected) > 20 and any(r[1] not in (None, r[2]) for r in expected)
    same(op.variants(more, tile=tile).collect(), expected)


def test_spelling_of_nothing(empty, docs):
    from sheetloom.llm.spelling import variants

    assert variants(empty).count() == 0
    assert variants(docs.where("doc_id IS NULL AND text IS NULL")).count() == 0


# op13


def brute_next(rows):
    """(doc_id, n_chars, hash of the edited text, code points in common with the edited and the next text)."""
    order = sorted(rows, key=lambda r: -r[0])
    same_start = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    out = []
    for k, (i, t) in enumerate(order):
        t, f = t or "", order[(k + 1) % len(order)][1] or ""
        m = len(t) // 3
        changed = t[: len(t) - m] + f[:m]
        out.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), same_start(t, changed), same_start(t, f)))
    return out


@pytest.mark.parametrize("block, points", [(64 << 20, 1 << 20), (3000, 1), (200, 500)])
def test_fingerprints(spark, monkeypatch, docs, plain, block, points):
    from sheetloom.llm import fingerprints as op

    monkeypatch.setattr(op, "BLOCK_BYTES", block)
    monkeypatch.setattr(op, "BATCH_POINTS", points)
    distinct = {i: t for i, t in plain if i is not None}
    found = op.fingerprints(docs.where("doc_id IS NOT NULL")).collect()
    columns = ("doc_id", "n_chars", "edited_sha256", "same_start_edited", "same_start_next")
    assert {tuple(r[c] for c in columns) for r in found} == set(brute_next(list(distinct.items())))
    assert Counter(r.doc_id for r in found) == Counter(i for i, _ in plain if i is not None)
    text, prints = {r.doc_id: distinct[r.doc_id] or "" for r in found}, {r.doc_id: r.fingerprint for r in found}
    by_text = defaultdict(set)
    for i, p in prints.items():
        by_text[text[i]].add(p)
    assert all(len(p) == 1 for p in by_text.values()) and len({next(iter(p)) for p in by_text.values()}) == len(by_text)
    order = sorted(prints, reverse=True)
    following = dict(zip(order, [*order[1:], order[0]]))
    for r in found:
        assert r.near_edited == op.likeness(r.fingerprint, r.edited_fingerprint) and r.near_next == op.likeness(r.fingerprint, prints[following[r.doc_id]])
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 and (r.n_chars < 9 or r.near_edited > 0.5)


def test_fingerprints_of_few_repeated_and_null(spark, docs, plain, empty):
    from sheetloom.llm.fingerprints import fingerprints

    assert fingerprints(empty).count() == 0
    assert fingerprints(docs).count() == len(plain)
    one = fingerprints(spark.createDataFrame([(5, "abcdef"), (5, "abcdef")], "doc_id long, text string")).collect()
    assert [(r.n_chars, r.near_next, r.edited_sha256) for r in one] == [(6, 1.0, hashlib.sha256(b"abcdab").hexdigest())] * 2
    low = fingerprints(spark.createDataFrame([(-(1 << 63), "xyz"), ((1 << 63) - 1, "abc"), (None, None)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.edited_sha256 for r in low} == {(1 << 63) - 1: hashlib.sha256(b"abx").hexdigest(), -(1 << 63): hashlib.sha256(b"xy").hexdigest(), None: hashlib.sha256(b"").hexdigest()}


def test_prefix_hashes_answer_spans():
    from sheetloom.llm.fingerprints import BASES, PRIME, Prefixes, code_points

    rng = random.Random(8)
    text = "".join(rng.choice("ab") for _ in range(9000))
    p = Prefixes(code_points(text))
    for k, base in enumerate(BASES):
        h = 0
        for i, c in enumerate(text):
            assert int(p.arrays[k][i]) == h
            h = (h * base + ord(c) + 1) % PRIME
    q = Prefixes(code_points(text[100:5000] + "c" + text[:50]))
    assert p.common(100, q, 0) == 4900 and p.common(0, q, 4901) == 50 and p.common(9000, q, 0) == 0
    for _ in range(300):
        a, b = rng.randrange(8900), rng.randrange(4800)
        n = rng.randrange(1, 90)
        other = text[100:5000] + "c" + text[:50]
        assert p.equal(a, q, b, n) == (text[a : a + n] == other[b : b + n])
    assert not np.any(p.span([5, 7], [5, 7]))
