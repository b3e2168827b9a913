"""Stages of the pipeline: ball hashing of near duplicates, tiles, one pass of the tokenizer."""

import random

import numpy as np

import corpus_pipeline
from tests.llm.test_operators import reachable


def near_copies(rng, words, size, copies):
    base = [rng.choice(words) for _ in range(size)]
    for _ in range(copies):
        text = list(base)
        text[rng.randrange(size)] = rng.choice(words)
        yield " ".join(text)


def test_near_duplicates_meet_by_ball_hashing(spark, monkeypatch):
    """The stage takes the pairs of fingerprints at three bits or fewer, and links nothing below 0.8 by them."""
    from sheetloom.llm import similar as op
    from sheetloom.llm.components import components
    from sheetloom.llm.simhash import majority

    rng = random.Random(8)
    words = [f"w{i}" for i in range(2000)]
    rows = [(i, t) for i, t in enumerate(t for size in (300, 500, 900) for t in near_copies(rng, words, size, 12))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    called = []
    real = op.near_pairs
    monkeypatch.setattr(op, "near_pairs", lambda v: called.append(real(v)) or called[-1])
    checked = []
    check = op._checked
    monkeypatch.setattr(op, "_checked", lambda pairs, *a: checked.append({tuple(r) for r in pairs.collect()}) or check(pairs, *a))
    found = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "")
    assert found.count() == 3 and len(called) == 1
    every = op.vertices(op.keyed(docs).select("__id", "__key", "text")).df
    near = real(every).df
    pairs = {tuple(r) for r in near.collect()}
    assert pairs and pairs <= checked[0]
    prints = {i: majority(op.shingles(t, 3)) for i, t in rows}
    label = reachable([prints[i] for i, _ in rows])
    digest = {r[0]: r[1] for r in every.select("digest", "__id").collect()}
    root = {digest[r.vertex]: r.root for r in components(near).collect()}
    groups = lambda of: {frozenset(j for j in of if of[j] == of[i]) for i in of}
    assert groups({i: root.get(i, -i - 1) for i, _ in rows}) == groups(dict(zip([i for i, _ in rows], label)))


def test_common_values_of_a_tile(monkeypatch):
    from sheetloom.llm import similar as op

    monkeypatch.setattr(op, "CHUNK", 7)
    rng = np.random.default_rng(2)
    sets = [rng.choice(60, rng.integers(0, 30), replace=False) for _ in range(40)]
    probe = rng.random(40) < 0.4
    left, right = np.flatnonzero(probe), np.flatnonzero(~probe)
    owner = np.repeat(np.arange(40), [len(s) for s in sets])
    found = op._common(np.concatenate(sets), owner, probe, left, right)
    assert (found == [[len(set(sets[i]) & set(sets[j])) for j in right] for i in left]).all()


def test_bitmaps_bound_the_difference():
    from sheetloom.llm import similar as op

    rng = np.random.default_rng(6)
    for size in (0, 1, 40, 700):
        one = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        others = [np.unique(np.concatenate([one[rng.random(len(one)) < share], rng.integers(0, 2**63, more).astype(np.uint64)])) for share in (0.0, 0.5, 0.9, 1.0) for more in (0, 3, 900)]
        found = op.least_differing(op.parity(one), [op.parity(x) for x in others])
        exact = [len(np.setxor1d(one, x)) for x in others]
        assert all(found <= exact) and found[-3] == 0
        assert all(f >= 0.6 * e for f, e, x in zip(found, exact, others) if len(x) <= 1.25 * len(one) and len(one) <= 1.25 * len(x))


def test_tiles_give_a_pair_once(spark, monkeypatch):
    """However many shingles two texts share; pairs of one template that are not similar are not given at all."""
    from sheetloom.llm import similar as op
    from tests.llm.test_queries import kept_of_similar

    rng = random.Random(12)
    words = [f"w{i}" for i in range(4000)]
    base = [rng.choice(words) for _ in range(400)]
    # Five families of near copies, whose bases share just under the similarity of a link.
    rows = []
    for family in range(5):
        text = base[:340] + [rng.choice(words) for _ in range(60)]
        for _ in range(12):
            own = list(text)
            own[rng.randrange(400)] = rng.choice(words)
            rows.append((len(rows), " ".join(own)))
    seen = []
    real = op._tiles

    def watch(*a):
        pairs = op.Stored(real(*a), "seen").df
        seen.extend(tuple(r) for r in pairs.collect())
        return pairs

    monkeypatch.setattr(op, "_tiles", watch)
    monkeypatch.setattr(op, "near_pairs", lambda v: op.Stored(v.select(v.digest.alias("a"), v.digest.alias("b")).where("false"), "near"))
    monkeypatch.setattr(op, "TILE", 16)
    found = op.without_similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r.doc_id for r in found.collect()} == kept_of_similar(rows)
    assert len(seen) == len(set(seen)) < 5 * 12 * 11


def test_tokens_take_one_python_pass(spark):
    """Two chained passes keep two Python workers for every task."""
    docs = spark.createDataFrame([(1, "Some text, 2 words ²", "en", "a"), (2, None, "en", "b"), (3, "", "en", "c")], "doc_id long, text string, lang string, source string")
    found = dict(corpus_pipeline.STAGES)["tokens"](spark, docs, "")
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {r.doc_id: (r.n_tokens > 0, r.round_trip) for r in found.collect()} == {1: (True, True), 2: (False, True), 3: (False, True)}
