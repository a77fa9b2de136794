"""Jaccard join, embedding near-duplicates and components against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest

from costwright.llm import components, hnsw, jaccard
from costwright.llm.shared import shipped


@pytest.fixture(scope="module")
def ready(spark):
    shipped(spark)
    return spark


class Groups:
    def __init__(self, nodes):
        self.parent = {n: n for n in nodes}

    def top(self, n):
        while self.parent[n] != n:
            n = self.parent[n]
        return n

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        self.parent[max(a, b)] = min(a, b)


def test_components(ready):
    r = random.Random(5)
    pairs = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)]
    pairs += [(2000, 2000 + i) for i in range(1, 80)] + [(7, 7), pairs[0]]
    groups = Groups({n for p in pairs for n in p})
    for a, b in pairs:
        groups.join(a, b)
    got = {r.node: r.component for r in components.components(ready.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: groups.top(n) for a, b in pairs if a != b for n in (a, b)}
    assert components.components(ready.createDataFrame([], "a long, b long")).count() == 0


def brute_sets(texts, size):
    for text in texts:
        words = (text or "").encode().lower().split()
        grams = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)] or ([tuple(words)] if words else [])
        yield frozenset(grams)


def brute_groups(rows, size, percent):
    sets = list(brute_sets([t for _, t in rows], size))
    groups = Groups(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                groups.join(i, j)
    least = defaultdict(list)
    for i, (n, _) in enumerate(rows):
        least[groups.top(i)].append(n)
    ids = {top: min((n for n in found if n is not None), default=None) for top, found in least.items()}
    return sorted(
        ((n, len(sets[i]), ids[groups.top(i)]) for i, (n, _) in enumerate(rows)), key=lambda x: (x[0] is None, x)
    )


def family(r, words, copies, share):
    """Copies of a text with some words changed."""
    return [" ".join(w if r.random() > share else f"{w}{r.randint(0, 9)}" for w in words) for _ in range(copies)]


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcde") for _ in range(3))
    texts = [None, "", " \n\t", "One two", "one  TWO", "one two three", "É one two three four", "é one two three four"]
    for n in (4, 6, 9, 14, 30, 60, 150, 400):
        words = [word() for _ in range(n)]
        for share in (0.0, 0.005, 0.01, 0.02, 0.04):
            texts += family(r, words, 5, share)
        texts += [" ".join(words[:k]) for k in range(n - 1, max(3, int(n * 0.75)), -max(1, n // 20))]
    passage = " ".join(word() for _ in range(60))  # one passage in many texts
    texts += [f"{' '.join(word() for _ in range(r.randint(5, 90)))} {passage}" for _ in range(40)]
    texts += ["word " * 30_000, "word " * 4]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    r.shuffle(rows)
    return [*rows, rows[9], rows[9], (None, texts[20]), (None, "alone without an id at all")]


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_similar_groups_equal_brute_force(ready, size, percent):
    rows = corpus(size)
    docs = ready.createDataFrame([(*x, 1, 1) for x in rows], "doc_id long, text string, node int, n int").repartition(5)
    got = [tuple(r) for r in jaccard.similar_groups(docs, words=size, percent=percent).collect()]
    assert sorted(got, key=lambda x: (x[0] is None, x)) == brute_groups(rows, size, percent)


def test_pairs_of_the_second_round(ready):
    """A chain in which neighbours link though none links with the least of their signatures."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[12 * i : 12 * i + 200])) for i in range(16)]
    docs = ready.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in jaccard.similar_groups(docs).collect()]
    assert sorted(got) == brute_groups(rows, 4, 85) and {g[2] for g in got} == {0}


def test_a_large_family_sends_about_as_many_pairs_as_members(ready, monkeypatch):
    """Copies of one text of which few link with the least of their signatures; pair by pair 1,510 were sent."""
    r = random.Random(11)
    rows = list(enumerate(family(r, [f"w{i}" for i in range(120)], 600, 0.035)))
    sent, linked = [], jaccard._linked

    def counted(pairs, *more):
        sent.append(pairs.count())
        return linked(pairs, *more)

    monkeypatch.setattr(jaccard, "_linked", counted)
    docs = ready.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(x) for x in jaccard.similar_groups(docs).collect()]
    assert sorted(got) == brute_groups(rows, 4, 85)
    assert sum(sent) <= len(rows), sent


def test_large_texts_with_common_phrases_send_no_pairs(ready, monkeypatch):
    """Texts of thousands of words that share a few phrases; 1,024 bits ruled out none of the 405 pairs of these texts."""
    r = random.Random(13)
    phrases = [" ".join(f"p{i}x{j}" for j in range(12)) for i in range(60)]
    texts = []
    for i in range(30):
        pieces = [" ".join(f"o{i}x{j}x{k}" for k in range(r.randint(44, 60))) for j in range(60)]
        texts.append(" ".join(x for pair in zip(pieces, phrases) for x in pair))
    near = texts[0].split()  # sizes on either side of a power of two
    rows = [*enumerate(texts), (100, " ".join([*near, *(f"more{i}" for i in range(4200 - len(near)))])), (101, " ".join(near[:3600]))]
    sent, linked = [], jaccard._linked

    def counted(pairs, *more):
        sent.append(pairs.count())
        return linked(pairs, *more)

    monkeypatch.setattr(jaccard, "_linked", counted)
    docs = ready.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(x) for x in jaccard.similar_groups(docs, words=5, percent=80).collect()]
    assert sorted(got) == brute_groups(rows, 5, 80) and len({g[2] for g in got}) == 30
    assert {g[1] > 4096 for g in got if g[2] == 0} == {True, False}
    assert sum(sent) <= 3, sent


def test_a_set_gives_as_many_signatures_as_may_differ_and_one():
    r = np.random.default_rng(3)
    for n, percent in ((300, 80), (1000, 80), (1000, 85), (5000, 80)):
        hashes = np.unique(r.integers(0, 2**64, n, np.uint64))
        most = (100 - percent) * (n + 100 * n // percent) // (100 + percent)
        assert len(jaccard.signatures(hashes, percent)) <= (most + 1) * len(jaccard.bands(n, percent))


def test_bitmaps_of_several_lengths_fold_to_the_shortest():
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 2**64, n, np.uint64)) for n in (5, 1024, 1025, 3000, 200_000)]
    maps = [jaccard.bitmap(h).view(np.uint64) for h in sets]
    assert [64 * len(m) for m in maps] == [1024, 1024, 2048, 4096, jaccard.LONGEST_SKETCH]
    for some in ((0, 1), (2, 3), (1, 2, 3, 4)):
        rows = jaccard.folded(np.concatenate([maps[i] for i in some]), np.array([len(maps[i]) for i in some]))
        size = min(64 * len(maps[i]) for i in some)
        for i, row in zip(some, rows, strict=True):
            odd = np.bincount((sets[i] % np.uint64(size)).astype(np.int64), minlength=size) & 1
            assert np.array_equal(np.packbits(odd.astype(np.uint8)).view(np.uint64), row)


def test_cells_and_fans_of_any_size_equal_brute_force(ready, monkeypatch):
    r = random.Random(12)
    rows = list(enumerate(family(r, [f"w{i}" for i in range(80)], 90, 0.03)))
    docs = ready.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(jaccard, "CELL", 7)
    monkeypatch.setattr(jaccard, "FAN", 2)
    assert sorted(tuple(x) for x in jaccard.similar_groups(docs).collect()) == brute_groups(rows, 4, 85)


def test_empty_table(ready):
    docs = ready.createDataFrame([], "doc_id long, text string")
    assert jaccard.similar_groups(docs).count() == 0


def test_signatures_of_similar_sets_meet():
    r = np.random.default_rng(1)
    for n in [*range(2, 60), 100, 333, 1000]:
        for percent in (50, 80, 85, 95):
            a = np.unique(r.integers(0, 2**64, n, np.uint64))
            drop = int(len(a) * (100 - percent) / 100)
            b = np.delete(a, r.permutation(len(a))[:drop])
            swap = int(len(a) * (100 - percent) / (100 + percent))
            c = np.unique(np.concatenate([a[: len(a) - swap], r.integers(0, 2**64, swap, np.uint64)]))
            for other in (b, c):
                both = len(np.intersect1d(a, other))
                if 100 * both >= percent * (len(a) + len(other) - both) and not np.array_equal(a, other):
                    assert len(np.intersect1d(jaccard.signatures(a, percent), jaccard.signatures(other, percent)))


def clustered(seed, n, dim=24):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dim))
    out = []
    for i in range(n):
        v = centres[r.integers(12)] + r.normal(size=dim) * r.choice([0.02, 0.3, 1.0], p=[0.2, 0.3, 0.5])
        out.append((v * r.choice([0.5, 1, 7])).astype(np.float32).tolist())
    return out


def test_near_duplicates_equal_brute_force(ready):
    vectors = clustered(1, 900)
    rows = list(enumerate(vectors))
    rows += [(2000 + i, vectors[3]) for i in range(40)] + [rows[5], rows[5]]
    odd = [(3000, None), (3001, [0.0] * 24), (3002, [float("nan")] + [1.0] * 23), (3003, []), (3004, [None] * 24),
           (3005, [float("inf")] * 24), (None, vectors[3])]
    short = [(4000, [1.0, 2.0]), (4001, [2.0, 4.0])]
    frame = ready.createDataFrame([(*x, 1, 1) for x in [*rows, *odd, *short]], "vec_id long, embedding array<float>, node int, n int")
    got = defaultdict(set)
    for r in hnsw.near_duplicates(frame.repartition(3), least=0.9).collect():
        got[r.vec_id].add((r.n_links, r.component_id, r.kept))
    ids = sorted({i for i, _ in rows})
    unit = hnsw.unit(np.array([dict(rows)[i] for i in ids], np.float64))
    close = unit @ unit.T >= 0.9
    groups = Groups(ids)
    for a, b in zip(*np.nonzero(close)):
        groups.join(ids[a], ids[b])
    want = {n: {(int(close[k].sum()) - 1, groups.top(n), groups.top(n) == n)} for k, n in enumerate(ids)}
    want |= {i: {(0, i, i is not None)} for i, _ in odd} | {4000: {(1, 4000, True)}, 4001: {(1, 4000, False)}}
    assert got == want


def test_no_vectors(ready):
    empty = ready.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in hnsw.near_duplicates(empty).collect()] == [(1, 0, 1, True)]
    assert hnsw.near_duplicates(empty.limit(0)).count() == 0


def test_graph_recall_and_storage():
    unit = hnsw.unit(np.random.default_rng(0).normal(size=(3000, 32)))
    graph = hnsw.Graph(unit.astype(np.float32)).build()
    again = hnsw.Graph.from_bytes(graph.to_bytes())
    ids, _ = again.nearest(unit[:200].astype(np.float32), 64)
    top = np.argsort(-(unit[:200] @ unit.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids, top)]) > 0.9
    assert all((a == b).all() for a, b in zip(graph.layers, again.layers))


def test_audit_widens_a_poor_beam(monkeypatch):
    """With hardly any beam the audits still reach all links."""
    monkeypatch.setattr(hnsw, "BEAM", 2)
    unit = hnsw.unit(np.array(clustered(2, 600), np.float64))
    graph = hnsw.Graph(unit.astype(np.float32)).build()
    found = hnsw.links_of(graph, unit, unit, 0.9)
    truth = unit @ unit.T >= 0.9
    assert sum(len(f) for f in found) >= 0.99 * truth.sum()


def test_recall_of_small_groups_beside_a_hot_one():
    """A full-size shard of which a third is one group: queries with a single partner find it."""
    r = np.random.default_rng(7)
    n, dim = hnsw.SHARD_NODES, 32
    vectors = r.normal(size=(n, dim))
    hot = r.permutation(n)[: n // 3]
    vectors[hot] = vectors[hot[0]] + 0.1 * r.normal(size=(len(hot), dim))
    rest = np.setdiff1d(np.arange(n), hot)[:1200]
    vectors[rest[:600]] = vectors[rest[600:]] + 0.05 * r.normal(size=(600, dim))
    unit = hnsw.unit(vectors)
    graph = hnsw.Graph(unit.astype(np.float32)).build()
    own = np.concatenate([rest[:300], rest[600:900], hot[:50]])
    found = hnsw.links_of(graph, unit, unit[own], 0.9, own)
    truth = unit[own] @ unit.T >= 0.9
    truth[np.arange(len(own)), own] = False
    recall = [truth[i, f].sum() / truth[i].sum() for i, f in enumerate(found) if truth[i].any()]
    assert len(recall) >= 600 and np.mean(recall) >= hnsw.RECALL
    assert not any(q in f for q, f in zip(own, found))


def test_audit_sees_single_partners(monkeypatch):
    """No graph at all: what the walks miss of pairs counts beside a hot group."""
    monkeypatch.setattr(hnsw.Graph, "nearest", lambda self, v, beam: (np.full((len(v), 1), -1), np.full((len(v), 1), -2.0)))
    r = np.random.default_rng(2)
    vectors = r.normal(size=(1000, 32))
    vectors[:300] = vectors[0] + 0.05 * r.normal(size=(300, 32))
    vectors[300:400] = vectors[400:500]
    unit = hnsw.unit(vectors + 0.01 * r.normal(size=vectors.shape))
    queries = unit[300:500]
    found = hnsw.links_of(hnsw.Graph(unit.astype(np.float32)), unit, queries, 0.9, np.arange(300, 500))
    assert [f.tolist() for f in found] == [[(i + 100 - 300) % 200 + 300] for i in range(300, 500)]


def test_links_found_from_one_end_count_for_both(ready, monkeypatch):
    vectors = clustered(5, 300)
    rows = list(enumerate(vectors)) + [(1000, vectors[7]), (1001, vectors[8])]
    whole = hnsw._search

    def one_end(queries, index, least):  # nodes of odd homes find nothing in shards below their own
        if len(queries) and len(index) and queries["home"].iloc[0] % 2 and queries["home"].iloc[0] > index["shard"].iloc[0]:
            queries = queries.iloc[:0]
        return whole(queries, index, least)

    monkeypatch.setattr(hnsw, "_search", one_end)
    frame = ready.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in hnsw.near_duplicates(frame, least=0.9).collect()}
    unit = hnsw.unit(np.array([v for _, v in rows], np.float64))
    assert got == {i: int(k) - 1 for (i, _), k in zip(rows, (unit @ unit.T >= 0.9).sum(axis=1))}
