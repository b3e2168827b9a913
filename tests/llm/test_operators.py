"""Operators against brute force on small texts with nulls, repeats, long texts and clashing columns."""

import hashlib
import math
import re
import struct
from collections import Counter, defaultdict

import pytest
import xxhash

from sheetloom.llm.queries import vocabulary_path


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def same(found, expected):
    assert Counter(map(tuple, found)) == Counter(map(tuple, expected))


# op1


def test_exact_dedup(docs, plain, empty):
    from sheetloom.llm.exact_dedup import exact_dedup

    groups = defaultdict(list)
    for i, t in plain:
        groups[lower(t)].append(i)
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    expected = [(i, top[lower(t)], len(groups[lower(t)]), top[lower(t)] in (None, i), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in plain]
    found = exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    same(found.collect(), expected)
    assert exact_dedup(empty).count() == 0


def test_digest_index_keeps_earlier_batches(spark):
    from sheetloom.llm.exact_dedup import DigestIndex
    from sheetloom.llm.store import new_path

    path = new_path(spark, "index")
    first = DigestIndex(spark, path, 4).add(spark.createDataFrame([(1, "Same"), (2, "same"), (3, "other")], "doc_id long, text string"))
    assert {r.doc_id for r in first.where("kept").collect()} == {2, 3}
    again = DigestIndex(spark, path, 4)
    second = again.add(spark.createDataFrame([(9, "SAME"), (10, "new")], "doc_id long, text string"))
    assert {(r.doc_id, r.keep_id, r.kept) for r in second.collect()} == {(9, 2, False), (10, 10, True)}
    assert again.rows().count() == 3
    plan = second._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


# op2


def test_ngram_scores(docs, plain, empty):
    from sheetloom.llm.decontaminate import words_of
    from sheetloom.llm.ngram_score import ngram_scores

    counts = [Counter() for _ in range(4)]
    for _, t in plain:
        w = words_of(t)
        for n in (1, 2, 3):
            counts[n].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    total = sum(counts[1].values())

    def score(w):
        out = 0.0
        for i in range(len(w)):
            longest = min(i, 2) + 1
            n = next((n for n in range(longest, 1, -1) if counts[n][tuple(w[i - n + 1 : i + 1])] >= 2), 1)
            g = tuple(w[i - n + 1 : i + 1])
            out += math.log(0.4 ** (longest - n) * counts[n][g] / (counts[n - 1][g[:-1]] if n > 1 else total))
        return out

    expected = Counter((i, len(words_of(t)), round(score(words_of(t)), 4)) for i, t in plain)
    for sizes in ({}, {"block_bytes": 4000, "range_names": 3000}):
        found = ngram_scores(docs, **sizes).collect()
        assert Counter((r.doc_id, r.n_words, round(r.log_score, 4)) for r in found) == expected
        assert all((r.mean_log_score is None) == (r.n_words == 0) for r in found)
    assert ngram_scores(empty).count() == 0


# op3


def simhash(text):
    w = re.findall("[^\x20\x09-\x0d]+", lower(text))
    if not w:
        return 0
    k = min(3, len(w))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reachable(prints):
    """Smallest reachable index of every print, over three bits or fewer."""
    label = list(range(len(prints)))
    while True:
        new = [min(label[j] for j, q in enumerate(prints) if (p ^ q).bit_count() <= 3) for p in prints]
        if new == label:
            return label
        label = new


def test_near_duplicates(docs, plain, empty):
    from sheetloom.llm.simhash import near_duplicates, without_near_duplicates

    order = sorted(plain, key=lambda r: (r[0] is None, r[0] or 0))
    prints = [simhash(t) for _, t in order]
    expected = [(i, f"{p:016x}", order[k][0]) for (i, _), p, k in zip(order, prints, reachable(prints))]
    same(near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect(), expected)
    kept = without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(reachable(prints)))
    assert near_duplicates(empty).count() == without_near_duplicates(empty).count() == 0


def test_links_of_every_distance(spark):
    """Chains and balls around random fingerprints: no link within three bits is lost, none beyond is made."""
    import random

    from sheetloom.llm.components import components
    from sheetloom.llm.simhash import links

    rng = random.Random(3)
    prints = set()
    for _ in range(40):
        p = rng.getrandbits(64)
        prints.add(p)
        for d in (1, 2, 3, 3, 4, 5, 3):
            for b in rng.sample(range(64), d):
                p ^= 1 << b
            prints.add(p)
    centre = rng.getrandbits(64)
    prints |= {centre ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(a, 64, 5)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fingerprint long")
    found = links(df)
    rows = found.collect()
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in rows)
    root = {r.vertex: r.root for r in components(found).collect()}
    label = reachable(prints)
    groups = defaultdict(set)
    for s, k in zip(signed, label):
        groups[k].add(root.get(s, s))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components(spark):
    import random

    from sheetloom.llm.components import components

    chain = [(i, i + 1) for i in range(300)] + [(1000, 1000), (2000, k := 2001), (k, 2000), (None, 5)] + [(5000, 5001 + i) for i in range(200)]
    random.Random(1).shuffle(chain)
    root = {r.vertex: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert len({root[i] for i in range(301)}) == 1 and len({root[5000 + i] for i in range(201)}) == 1
    assert len(set(root.values())) == 4
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# op4


def test_bpe(docs, plain, empty):
    from tokenizers import Tokenizer

    from sheetloom.llm.bpe import bpe_decode, bpe_encode, unpacked

    public = Tokenizer.from_file(vocabulary_path())
    expected = []
    for i, t in plain:
        ids = public.encode(t or "", add_special_tokens=False).ids
        expected.append((i, struct.pack(f"<{len(ids)}I", *ids), public.decode(ids, skip_special_tokens=False)))
    done = bpe_decode(bpe_encode(docs, vocabulary_path()), vocabulary_path())
    same([(r.doc_id, bytes(r.ids), r.decoded) for r in done.collect()], expected)
    assert set(done.columns) == set(docs.columns)
    few = bpe_encode(docs.where("doc_id = 12"), vocabulary_path()).select(unpacked("ids").alias("n")).first().n
    assert few == public.encode(plain[4][1], add_special_tokens=False).ids
    assert bpe_encode(empty, vocabulary_path()).count() == 0


def test_long_words_merge_as_short_ones():
    from sheetloom.llm.bpe import vocabulary

    v = vocabulary(vocabulary_path())
    for word in (b"abcabc" * 40, b"the" * 90 + b"zq" * 30, bytes(range(33, 127)) * 3, b"aaaaaaa" * 31):
        parts = [v.byte_ids[b] for b in word]
        assert v._short(list(parts)) == v._long(list(parts))


# op5


def test_toxicity(spark, docs, empty):
    import random

    from sheetloom.llm.toxicity import toxicity, train

    rng = random.Random(2)
    clean = ["".join(rng.choice("abcdeimnorst") for _ in range(5)) for _ in range(300)]
    made, labels = [], []
    for i in range(1200):
        words = [rng.choice(clean) for _ in range(rng.randint(5, 60))]
        toxic = i % 8 == 0
        if toxic:
            words[rng.randrange(len(words))] = "zwurl" + rng.choice("abcde")
            words[rng.randrange(len(words))] = "grimble"
            words.append("zwurlo")
        made.append((i, " ".join(words)))
        labels.append((i, None, int(toxic)))
    table = spark.createDataFrame(made, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = train(table, marks)
    found = {r.doc_id: r.score for r in toxicity(table, model).collect()}
    wrong = sum((found[i] >= 0.3) != bool(t) for i, _, t in labels)
    assert wrong <= 12
    mixed = toxicity(docs, model)
    assert set(mixed.columns) == set(docs.columns) and mixed.where("score BETWEEN 0 AND 1").count() == docs.count()
    assert toxicity(empty, train(empty, marks.where("false"))).count() == 0
    assert train(table, marks.where("toxic = 1")).score("grimble") < 0.3


def test_label_model_discounts_repeated_voters():
    import numpy as np

    from sheetloom.llm.toxicity import label_model

    rng = np.random.default_rng(1)
    y = (rng.random(4000) < 0.3).astype(float)
    voter = lambda right: np.where(rng.random(4000) < right, y, 1 - y)
    votes = np.stack([voter(0.9), voter(0.85), voter(0.8), voter(0.6)], 1)
    votes = np.concatenate([votes, np.repeat(votes[:, 3:], 4, axis=1)], 1)
    start = np.clip(votes[:, :3].mean(1), 0.1, 0.9)
    posterior, fires, correlation = label_model(votes, 0.3, start)
    assert ((posterior > 0.5) == (y == 1)).mean() > 0.9
    assert correlation[3, 4] > 0.9 and abs(correlation[0, 1]) < 0.3
    assert fires[0, 0] > 0.8 and fires[1, 0] < 0.2


# op6

BASE = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def holds(kind, match):
    digits = [int(c) for c in match if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def test_base_patterns(spark, docs, plain, empty):
    from sheetloom.llm.pii import personal_data

    odd = [
        "a" * 30000, "1" * 30000, "1.1" * 4000, "x@" * 3000, "a@b.c." * 2000, "+1 " + "2" * 20 + "3", "é a@b.co ü 001.002.003.255 +49 (0) 123-456", "4" + " 2" * 20000,
        "a..b@c-d.e%f@g.h", "00000000001.2.3.4", "1.2.3.4.5.6.7.8.9", "4111-1111 1111-1111", "4111  1111 1111 1111", "+1.2.3.4", "\n".join(f"u{i}@h{i}.org 10.0.{i % 300}.1" for i in range(2000)),
    ]
    more = docs.unionByName(spark.createDataFrame([(5000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"), allowMissingColumns=True)
    every = plain + [(5000 + i, t) for i, t in enumerate(odd)]
    expected = [(i, tuple((k, m.start(), m.end()) for k, p in BASE for m in p.finditer(t or "") if holds(k, m.group()))) for i, t in every]
    found = personal_data(more)
    same([(r.doc_id, tuple((s.kind, s.start, s.end) for s in r.spans if s.base)) for r in found.collect()], expected)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    assert personal_data(empty).count() == 0


def test_context_finds_unseen_identifiers(spark):
    from sheetloom.llm.pii import personal_data

    seeds = [(i, f"note {i} reach user{i}@mail.org soon") for i in range(40)]
    unseen = [(100, "please reach someone99999@intranet now"), (101, "nothing here but 12 and 2024 words")]
    rows = {r.doc_id: r.spans for r in personal_data(spark.createDataFrame(seeds + [(i, f"card {4111111111111111} ok") for i in (200, 201)] + [(300 + i, f"card 400000000000000{i} x") for i in range(10)] + unseen, "doc_id long, text string")).collect()}
    assert all(len(rows[i]) == 1 and rows[i][0].base for i in range(40))
    assert rows[101] == []
    text = dict(unseen)[100]
    assert [text[s.start : s.end] for s in rows[100] if not s.base] in ([], ["someone99999@intranet"])


def test_context_reaches_other_shapes(spark):
    """A known context leads to identifiers of another shape, and those to contexts without seeds; innocent tokens stay."""
    from sheetloom.llm.pii import personal_data

    rows = [(i, f"note {i} reach user{i}@mail.org soon") for i in range(200)] + [(300 + i, f"phone +1 (555) 123-45{i:02d} today") for i in range(40)]
    rows += [(400, "please reach someone99999@intranet now"), (401, "my phone 0170-1234567 rings"), (402, "order a1b2c3d4e5f6 of reach 1234567 and part 7654321 came")]
    rows += [(500 + 100 * k + i, f"{word} a.{'x' * (i + 1)}{i}@{'y' * (i + 1)} ok") for k, word in enumerate(("reach", "ping")) for i in range(30)] + [(700, "ping Zed-77777@corp yes")]
    found = {r.doc_id: r.spans for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    new = {i: [(s.kind, text[i][s.start : s.end]) for s in found[i] if not s.base] for i in (400, 401, 402, 700)}
    assert new == {400: [("email", "someone99999@intranet")], 401: [("phone", "0170-1234567")], 402: [], 700: [("email", "Zed-77777@corp")]}


# op7


def test_substring_dedup(docs, plain, empty):
    from sheetloom.llm.substring_dedup import substring_dedup

    blobs = [(i, (t or "").encode()) for i, t in plain]
    seen = Counter(b[k : k + 200] for _, b in blobs for k in range(len(b) - 199))
    expected = []
    for i, b in blobs:
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        spans = tuple((m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone)))
        expected.append((i, len(b), spans, bytes(x for x, g in zip(b, gone) if not g)))
    found = substring_dedup(docs).select("doc_id", "n_bytes", "removed", "kept")
    same([(r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.removed), bytes(r.kept)) for r in found.collect()], expected)
    assert set(substring_dedup(docs).columns) == set(docs.columns)
    assert substring_dedup(empty).count() == 0


def test_pieces_of_long_texts(monkeypatch, docs, plain):
    """Small buffers cut texts into overlapping pieces; the result does not change."""
    import numpy as np

    from sheetloom.llm import substring_dedup as op

    text = max((t or "" for _, t in plain), key=len).encode()
    monkeypatch.setattr(op, "BUFFER", 1000)
    windows = [(at + k) for at, piece in op._pieces(text, 200) for k in range(len(piece) - 199)]
    assert windows == list(range(len(text) - 199))
    owner, lo, hi, at, gram, stretch = op.anchors(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 200)
    assert [p for a, b in zip(lo, hi) for p in range(a, b + 1)] == windows


# op8


def test_language(spark, docs, empty):
    import random

    from sheetloom.llm.language import identify, train

    rng = random.Random(4)
    letters = {"aa": "abcde", "bb": "defgh", "cc": "ijklm"}
    made = []
    for i in range(400):
        lang = rng.choice(list(letters))
        made.append((i, " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(3, 40))), lang))
    table = spark.createDataFrame(made + [(900, "12 !?", "aa"), (901, None, "bb"), (902, "abc", None)], "doc_id long, text string, lang string")
    model = train(table, rows_per_language=100, epochs=8)
    found = {r.doc_id: r for r in identify(table, model).collect()}
    assert sum(found[i].lang_pred == lang for i, _, lang in made) >= 392
    assert found[900].lang_pred == found[901].lang_pred == "und" and not found[900].accepted and found[900].score == 0
    assert all(0 <= r.score <= 1 for r in found.values())
    mixed = identify(docs, model)
    assert set(mixed.columns) == set(docs.columns) and mixed.count() == docs.count()
    assert train(empty) is None and identify(empty, None).count() == 0
    assert identify(docs, None).where("lang_pred <> 'und' OR accepted").count() == 0


# op9


def brute_hits(text, items, window=10):
    words = lambda t: re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", lower(t))
    w, hit, owners = words(text), set(), set()
    for item, t in items:
        v = words(t)
        m = min(window, len(v))
        wanted = {tuple(v[i : i + m]) for i in range(len(v) - m + 1)} if v else set()
        for i in range(len(w) - m + 1):
            if tuple(w[i : i + m]) in wanted:
                hit |= set(range(i, i + m))
                if item is not None:
                    owners.add(str(item))
    return len(w), len(hit), tuple(sorted(owners))


@pytest.mark.parametrize("block_words", [2_000_000, 200])
def test_decontaminate(spark, docs, plain, empty, block_words):
    from sheetloom.llm.decontaminate import decontaminate

    long = plain[13][1].split()
    items = [(1, " ".join(long[15:40])), (2, "A!b"), (3, None), (4, "..."), (5, " ".join(long[20:34]).upper()), (6, "shared-line, three"), (7, "word word word"), (7, "ab"), (None, "shared line one"), (None, " ".join(long[2:13])), (8, "never there at all in any text whatsoever you look at")]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS weight", "2 AS n")
    found = decontaminate(docs, bench, block_words=block_words)
    same([(r.doc_id, r.n_words, sum(s.end - s.start for s in r.hit_spans), tuple(r.hit_items)) for r in found.collect()], [(i, *brute_hits(t, items)) for i, t in plain])
    assert set(found.columns) == set(docs.columns)
    assert decontaminate(empty, bench).count() == 0
    assert decontaminate(docs, bench.where("false")).where("size(hit_spans) > 0").count() == 0


# op10


def brute_lines(plain, run):
    """Texts after later copies of runs of ``run`` lines are deleted; repeated rows are one document."""
    order = sorted({(i, t) for i, t in plain}, key=lambda r: (r[0] is not None, r[0] or 0))
    first, gone = {}, defaultdict(set)
    for i, t in order:
        lines = (t or "").split("\n")
        for k in range(len(lines) - run + 1):
            key = tuple(lines[k : k + run])
            if first.setdefault(key, (i, t, k)) != (i, t, k):
                gone[i, t] |= set(range(k, k + run))
    return {(i, t): (len((t or "").split("\n")), len(gone[i, t]), t if not gone[i, t] else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i, t])) for i, t in order}


@pytest.mark.parametrize("run", [1, 2, 3])
def test_line_dedup(spark, docs, plain, empty, run):
    from sheetloom.llm.line_dedup import line_dedup

    some = [(i, t) for i, t in plain if i is not None]  # the order of null ids is that of a hash
    expected = brute_lines(some, run)
    found = line_dedup(docs.where("doc_id IS NOT NULL"), run)
    same([(r.doc_id, r.n_lines, sum(x.end - x.start for x in r.runs), r.text) for r in found.collect()], [(i, *expected[i, t]) for i, t in some])
    assert set(found.columns) == set(docs.columns)
    assert line_dedup(docs, run).count() == len(plain) and line_dedup(empty, run).count() == 0
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_long_single_lines(spark):
    """A later copy of a single line of more than ``long_words`` words goes, a short one stays; touching runs are one."""
    from sheetloom.llm.line_dedup import line_dedup

    long, short = " ".join(f"w{i}" for i in range(51)), " ".join(f"w{i}" for i in range(50))
    rows = [(1, f"a\n{long}\nb"), (2, f"c\n{long}\nd\n{short}"), (3, f"e\n{short}\n{long}"), (4, f"p\nq\n{long}"), (5, f"p\nq\n{long}\nr"), (6, long)]
    found = {r.doc_id: r for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 2, 50).collect()}
    assert [found[i].text for i in range(1, 7)] == [rows[0][1], f"c\nd\n{short}", f"e\n{short}", "p\nq", "r", ""]
    assert [[tuple(x) for x in found[i].runs] for i in (2, 5)] == [[(1, 2)], [(0, 3)]]


# near duplicates of the pipeline


def test_similar_texts_are_one_document(spark):
    """The stage links 5-word Jaccard of 0.8 or more and nothing less, against all pairs."""
    import random

    import duckdb

    import corpus_pipeline

    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    rows, base = [], [rng.choice(words) for _ in range(120)]
    for n in range(60):
        text = list(base) if n < 30 else [rng.choice(words) for _ in range(100)]
        for at in rng.sample(range(len(text)), rng.randint(0, 4)):
            text[at] = rng.choice(words)
        rows.append((n, " ".join(text)))
    rows += [(100 + i, t) for i, t in enumerate([None, "", " \n", "one", "one two", "ONE two", "x " * 3000])]
    rows += duckdb.sql("SELECT 1000 + doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    rows.sort()

    def grams(text):
        w = re.findall("[^\x20\x09-\x0d]+", lower(text))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [grams(t) for _, t in rows]
    alike = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    near = [[j for j, b in enumerate(sets) if alike(a, b)] for a in sets]
    label = list(range(len(rows)))
    while (new := [min(label[j] for j in n) for n in near]) != label:
        label = new
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "")
    assert found.columns == docs.columns
    assert sorted(r.doc_id for r in found.collect()) == sorted({rows[k][0] for k in label})


def test_template_brings_no_pairs(spark, monkeypatch):
    """Documents of one template and half their own words meet nowhere; those of four fifths template meet in tiles."""
    import random

    from sheetloom.llm import similar as op

    seen = []
    real = op._checked
    monkeypatch.setattr(op, "_checked", lambda pairs, *a: seen.append(pairs.distinct().count()) or real(pairs, *a))
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    base = [rng.choice(words) for _ in range(120)]
    rows = [(i, " ".join(base + [rng.choice(words) for _ in range(60)])) for i in range(300)]
    frame = lambda r: spark.createDataFrame(r, "doc_id long, text string").repartition(3)
    assert op.without_similar(frame(rows)).count() == 300 and sum(seen) < 300
    monkeypatch.setattr(op, "TILE", 7)
    rows = [(i, " ".join(base[:110] + [rng.choice(words) for _ in range(10 + i % 16)])) for i in range(120)] + [(500 + i, t) for i, (_, t) in enumerate(rows[:40])]
    from tests.llm.test_queries import kept_of_similar

    assert {r.doc_id for r in op.without_similar(frame(rows)).collect()} == kept_of_similar(rows)


def test_repeated_rows_are_one_document_of_lines(spark):
    """Many rows that repeat doc_id and text give as many line positions as one."""
    from sheetloom.llm.line_dedup import line_dedup, repeated_starts

    rows = [(7, "a\nb\nc\nd")] * 600 + [(8, "a\nb\nx")] + [(None, "a\nb")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    starts, _ = repeated_starts(docs, 2)
    assert starts.df.count() == 3
    assert {(r.doc_id, r.text) for r in line_dedup(docs).collect()} == {(None, "a\nb"), (7, "c\nd"), (8, "x")}
