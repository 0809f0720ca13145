"""Near copies, repeated passages and links against plain searches over small corpora."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terrane.llm import components, fm_index, jaccard, substring

WORDS = [f"w{i}" for i in range(400)]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed, documents=90):
    """Random texts, exact copies, copies with a few changed words, shared passages, junk and edges."""
    rng = random.Random(seed)
    passage = [rng.choice(WORDS) for _ in range(30)]
    texts = []
    for _ in range(documents):
        kind = rng.random()
        if texts and kind < 0.15:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.55:
            words = (rng.choice(texts) or "").split()
            for _ in range(rng.choice([0, 1, 1, 2, 4, 9])):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(WORDS)
            texts.append(rng.choice([" ", "\n", "  "]).join(words))
        elif kind < 0.65:
            texts.append(" ".join([rng.choice(WORDS) for _ in range(rng.randrange(20))] + passage + [rng.choice(WORDS) for _ in range(20)]))
        else:
            texts.append(" ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 3, 4, 12, 13, 40, 120, 300]))))
    return [*texts, None, "", " \n", "W1 w2 W3", "w1 w2 w3", "same " * 60, "same " * 45, "Ünï códe " * 9]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, n):
    w = words_of((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def plain_components(rows, n, num, den):
    sets = {i: shingles(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i)) for i in sets)


@pytest.mark.parametrize(("seed", "n", "similarity"), [(0, 4, (85, 100)), (1, 5, (80, 100)), (2, 2, (60, 100))])
def test_components_of_copies(spark, seed, n, similarity):
    rows = list(enumerate(corpus(seed)))
    random.Random(seed).shuffle(rows)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, class int")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, n, similarity).collect())
    assert got == plain_components(rows, n, *similarity)


def test_a_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = random.Random(4)
    base = [rng.choice(WORDS) for _ in range(120)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, 4, (85, 100)).collect())
    assert got == plain_components(rows, 4, 85, 100)


def thue_morse(first, second, size):
    return "".join(second if bin(i).count("1") % 2 else first for i in range(size))


@pytest.mark.parametrize("size", [1024])
def test_words_that_complement_one_another(spark, size):
    """Complementary Thue-Morse words fool any polynomial modulo a power of two."""
    long, other = thue_morse("a", "b", size), thue_morse("b", "a", size)
    rows = [(1, " ".join([*WORDS[:5], long, *WORDS[5:10]])), (2, " ".join([*WORDS[:5], other, *WORDS[5:10]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, 4, (85, 100)).collect())
    assert got == plain_components(rows, 4, 85, 100) and got[1][2] == 2
    rows = [(1, " ".join([*WORDS[:12], long])), (2, " ".join([*WORDS[:12], other])), (3, thue_morse("u ", "v ", 2 * size)), (4, thue_morse("v ", "u ", 2 * size))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in substring.removal_digest(docs).collect()) == plain_removal(rows)


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 1, 2, 0)])
def test_ids_that_repeat_with_other_texts(spark, order):
    a, b = WORDS[:40], WORDS[100:140]
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a[:-1], "x"])), (1000, " ".join([*b[:-1], "y"]))]
    docs = spark.createDataFrame([rows[k] for k in order], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in jaccard.jaccard_components(docs, 4, (85, 100)).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (1000, 1)]
    kept = sorted(r.text for r in jaccard.one_of_each(docs, 4, (85, 100)).collect())
    assert kept == sorted([rows[0][1], rows[1][1]])
    lost = {(r.doc_id, r.n_words): r.n_removed for r in substring.removal_digest(docs).collect()}
    assert lost[2, 40] == lost[1000, 40] == 39 and lost[1, 40] == 0


def test_repeated_ids_lose_their_own_windows(spark):
    a, b, c = WORDS[:30], WORDS[50:80], WORDS[100:130]
    rows = [(1, " ".join(a)), (5, " ".join([*b, *a])), (5, " ".join([*c, *b])), (7, " ".join(["z", *c]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.kept_sha256) for r in substring.removal_digest(docs).collect()}
    kept = [(1, a), (5, b), (5, [*c, *b]), (7, ["z"])]
    assert got == {(i, hashlib.sha256(" ".join(w).encode()).hexdigest()) for i, w in kept}


@pytest.mark.parametrize("names", [("doc", "starts", "whole"), ("class", "its_id", "mark")])
def test_columns_of_any_name_stay(spark, names):
    long = " ".join(WORDS[:20])
    rows = [(1, long, 7, "p", None), (2, long + " x", 8, "q", 1.5), (3, long, 9, None, 2.5), (4, "other", 1, "r", 0.0)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, {names[0]} long, {names[1]} string, {names[2]} double")
    out = substring.without_repeats(docs)
    assert out.columns == docs.columns and {tuple(r) for r in out.collect()} == {rows[0], (2, "x", 8, "q", 1.5), (3, "", 9, None, 2.5), rows[3]}
    one = jaccard.one_of_each(docs, 4, (85, 100))
    assert one.columns == docs.columns and {tuple(r) for r in one.collect()} == {rows[0], rows[3]}


def test_shared_first_names_are_told_apart(spark, monkeypatch):
    """With first names of two bits nearly all sets share theirs; the second names tell them apart."""
    rows = list(enumerate(corpus(5, 40)))
    plain = jaccard._name
    shorter = lambda members, which: plain(members, which) & 3 if which == 1 and len(members) else plain(members, which)
    sets = [s for _, t in rows for s in jaccard.shingle_sets(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]), 4) if len(s)]
    monkeypatch.setattr(jaccard, "_name", shorter)
    first = [jaccard.identity(s) for s in sets]
    shared = frozenset(a for a, b in first if any(a == c and b != d for c, d in first))
    named = [jaccard.identity(s, shared)[0] for s in sets]
    assert len(shared) == 4 and len(set(named)) == len({s.tobytes() for s in sets})


@pytest.mark.parametrize(("local", "here"), [(1, 1), (3, 2)])
def test_crowded_keys_of_a_task(spark, monkeypatch, local, here):
    """Keys that a task finds crowded go their own way; results stay."""
    monkeypatch.setattr(jaccard, "LOCAL", local)
    monkeypatch.setattr(substring, "HOT_HERE", here)
    rows = list(enumerate(corpus(7)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, 4, (85, 100)).collect())
    assert got == plain_components(rows, 4, 85, 100)
    assert sorted(tuple(r) for r in substring.removal_digest(docs).collect()) == plain_removal(rows)


def test_edges_of_copies(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, None), (3, "")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, 4, (85, 100)).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (2, 0, 2), (3, 0, 3)], key=str)
    assert jaccard.jaccard_components(docs.filter("false")).collect() == []
    kept = jaccard.one_of_each(docs, 4, (85, 100))
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "None"]


@settings(deadline=None, max_examples=150)
@given(st.integers(0, 10_000), st.sampled_from([(85, 100), (80, 100), (70, 100)]))
def test_linked_sets_share_a_signature(seed, similarity):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(6, 400))
    a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
    scheme = jaccard.Scheme(*similarity)
    bounds = scheme.bounds()
    changed = a[rng.permutation(len(a))[: len(a) - int(rng.integers(0, max(1, len(a) // 8)))]]
    b = np.unique(np.concatenate([changed, rng.integers(0, 2**63, int(rng.integers(0, max(1, len(a) // 10))), dtype=np.uint64)]))
    common = len(np.intersect1d(a, b))
    if common * scheme.den >= scheme.num * (len(a) + len(b) - common) and not np.array_equal(a, b):
        (x, slack_x), (y, slack_y) = jaccard.signatures(a, scheme, bounds), jaccard.signatures(b, scheme, bounds)
        both = set(x.tolist()) & set(y.tolist())
        assert both
        # In some band they agree in more signatures than either has slack.
        of = lambda band, values: np.flatnonzero((values & np.uint64((1 << jaccard.BAND_BITS) - 1)) == band)
        bands = {v & ((1 << jaccard.BAND_BITS) - 1) for v in both}
        agree = {k: sum(v & ((1 << jaccard.BAND_BITS) - 1) == k for v in both) for k in bands}
        assert any(agree[k] > max(slack_x[of(k, x)[0]], slack_y[of(k, y)[0]]) for k in bands)
        pair = jaccard.near_pairs([jaccard.parities(a), jaccard.parities(b)], np.array([len(a), len(b)]), np.array([0]), np.array([1]), similarity)
        assert pair.all()


@settings(deadline=None, max_examples=8)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components_of_links(spark, links):
    root = {x: x for link in links for x in link}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def pair_of(words):
    """Two hashes of each word, of which every third word shares the first one with another."""
    words = np.array(words, np.uint64)
    return (words // np.uint64(2) if COLLIDE else words) * np.uint64(977), words * np.uint64(31)


COLLIDE = True


@settings(deadline=None, max_examples=80)
@given(st.lists(st.lists(st.integers(0, 5), min_size=5, max_size=30), min_size=1, max_size=6), st.lists(st.lists(st.integers(0, 7), max_size=25), max_size=4))
def test_fm_index(sequences, streamed):
    cuts = lambda rows: np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    owners = np.array([(k * 7) % 5 for k in range(len(sequences))])
    index = fm_index.FmIndex(pair_of([w for s in sequences for w in s]), cuts(sequences), owners, depth=5)
    runs = {}
    for s, owner in zip(sequences, owners.tolist(), strict=True):
        for n in range(1, 6):
            for i in range(len(s) - n + 1):
                runs[tuple(s[i : i + n])] = min(owner, runs.get(tuple(s[i : i + n]), 99))
    for rows in (sequences, streamed):
        flat = pair_of([w for s in rows for w in s])
        length, _ = index.statistics(flat, cuts(rows))
        want = [max(n for n in range(min(5, end) + 1) if not n or tuple(s[end - n : end]) in runs) for s in rows for end in range(1, len(s) + 1)]
        assert length.tolist() == want
        place, owner = index.covered(flat, cuts(rows))
        ends = [(s, end) for s in rows for end in range(1, len(s) + 1)]
        assert place.tolist() == [k for k, n in enumerate(want) if n == 5]
        assert owner.tolist() == [runs[tuple(ends[k][0][ends[k][1] - 5 : ends[k][1]])] for k in place.tolist()]


def test_the_index_is_smaller_than_its_words():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2000, 60_000, dtype=np.uint64)
    index = fm_index.FmIndex(pair_of(words), np.array([0, *range(30, 60_001, 30)]), np.arange(2000) // 4)
    assert index.nbytes < 8 * len(words)


def plain_removal(rows, window=13):
    firsts = {}
    for i, t in rows:
        w = words_of(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            firsts[key] = min(firsts.get(key, i), i)
    out = []
    for i, t in rows:
        w = words_of(t)
        gone = {j for k in range(len(w) - window + 1) if firsts[tuple(w[k : k + window])] < i for j in range(k, k + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("seed", "hot"), [(0, 1000), (1, 2), (2, 1000)])
def test_removed_windows(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    monkeypatch.setattr(substring, "SHARD_WORDS", 300)
    rows = list(enumerate(corpus(seed, 120)))
    random.Random(seed).shuffle(rows)
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, key string")
    got = sorted(tuple(r) for r in substring.removal_digest(docs).collect())
    assert got == plain_removal(rows)
    kept = {r.doc_id: r.text for r in substring.without_repeats(docs).collect()}
    for (i, _, removed, digest), (_, text) in zip(got, sorted(rows, key=lambda r: r[0]), strict=True):
        assert kept[i] == text if not removed else hashlib.sha256(kept[i].encode()).hexdigest() == digest


def test_edges_of_removal(spark):
    long = " ".join(WORDS[:20])
    docs = spark.createDataFrame([(1, long), (1, long), (None, long), (2, long + " tail"), (3, None), (4, ""), (5, long)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring.removal_digest(docs).collect()), key=str)
    assert got == sorted([(1, 20, 0), (1, 20, 0), (None, 20, 0), (2, 21, 20), (3, 0, 0), (4, 0, 0), (5, 20, 20)], key=str)
    assert substring.removal_digest(docs.filter("false")).collect() == []
