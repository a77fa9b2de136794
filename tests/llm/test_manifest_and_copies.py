"""Merkle manifest, exact copies and periodic runs against brute force and SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import connect, differences
from costwright.llm import exact, merkle, periodic, queries, shared
from costwright.llm.oracle import ORACLE_SQL
from costwright.llm.shared import shipped

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ready(spark):
    shipped(spark)
    return spark


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(ready, name):
    assert differences(queries.QUERIES[name](ready, SF_DIR), connect(SF_DIR), ORACLE_SQL[name]) == []


# ---------------------------------------------------------------- exact copies


def copies(rows):
    groups = defaultdict(list)
    for n, t in rows:
        groups[t or ""].append(n)
    for n, t in rows:
        ids = [i for i in groups[t or ""] if i is not None]
        yield n, max(ids, default=None), len(groups[t or ""]), n == max(ids, default=None)


def normal(rows):
    return sorted(rows, key=repr)


EXACT_ROWS = [
    (1, "a"), (2, "a"), (3, "b"), (4, None), (5, ""), (6, "x" * 5000 + "p"), (7, "x" * 5000 + "q"), (8, "x" * 5000 + "p"),
    (9, "ä"), (10, "ä"), (11, " a"), (None, "b"), (None, "lone"), (12, "A"), (13, "\x00"), (14, "ab"), (15, "ba"),
]


@pytest.mark.parametrize("bits", [shared.BITS, 8])
def test_exact_groups(ready, monkeypatch, bits):
    """A full bitmap lets single rows through, which changes nothing."""
    monkeypatch.setattr(shared, "BITS", bits)
    docs = ready.createDataFrame(EXACT_ROWS, "doc_id long, text string")
    docs = docs.select("*", *(F.lit(1).alias(c) for c in ("keep_id", "size", "bits", "row", "bucket", "id", "full")))
    found = exact.exact_groups(docs).collect()
    assert normal((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found) == normal(
        (n, k, s, True if s == 1 else kept) for n, k, s, kept in copies(EXACT_ROWS)
    )
    for r in found:
        text = dict(EXACT_ROWS).get(r.doc_id) or ""
        if r.group_size > 1 and r.doc_id is not None:
            assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()
    unread = {r.doc_id for r in found if r.text_sha256 is None}
    assert bits == 8 or {9, 10, 13} - unread <= {9, 10} and 6 not in unread


def test_exact_rows_that_share_an_id(ready):
    rows = [(5, "t")] * 3 + [(4, "t"), (5, "other"), (None, "n"), (None, "n")]
    found = exact.exact_groups(ready.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = [(r.doc_id, r.group_size) for r in found if r.kept]
    assert normal(kept) == normal([(5, 4), (5, 1), (None, 2)])
    assert {r.keep_id for r in found if r.group_size == 4} == {5}
    empty = exact.exact_groups(ready.createDataFrame([], "doc_id long, text string"))
    assert empty.collect() == [] and empty.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_exact_normal_form_and_plan(ready):
    docs = ready.createDataFrame([(1, "A b"), (2, "a B"), (3, "a  b")], "doc_id long, text string")
    found = exact.exact_groups(docs, normal=F.lower, digest_all=True)
    assert {(r.doc_id, r.keep_id) for r in found.collect()} == {(1, 2), (2, 2), (3, 3)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_exact_large_group(ready):
    docs = ready.range(3000).select(F.col("id").alias("doc_id"), F.expr("if(id % 3 = 0, 'hot', concat('t', id))").alias("text"))
    found = exact.exact_groups(docs).groupBy("group_size").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("k"))
    assert {tuple(r) for r in found.collect()} == {(1000, 1000, 1), (1, 2000, 2000)}


# ------------------------------------------------------------- Merkle manifest


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([H("".join(found[-1][i : i + 16])) for i in range(0, len(found[-1]), 16)])
    return found


def way(tree, at):
    for level in tree[:-1]:
        first = at // 16 * 16
        yield "".join(level[first:at]), "".join(level[at + 1 : first + 16])
        at //= 16


def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded) of rows (doc_id, source, text)."""
    trees = defaultdict(list)
    for n, source, text in rows:
        trees[source].append((n, leaf(n, source, text), leaf(n, source, text and text.encode().lower().decode())))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in order:
        trees[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        built[s] = levels([r[1] for r in trees[s]])
    top = levels([built[s][-1][0] for s in order])
    for i, s in enumerate(order):
        for at, (n, good, bad) in enumerate(trees[s]):
            path = [*way(built[s], at), *way(top, i)]
            node = bad if zlib.crc32(str("" if n is None else n).encode()) % 5 == 0 else good
            for left, right in path:
                node = H(left + node + right)
            yield n, good, built[s][-1][0], top[-1][0], H("".join(a + b for a, b in path)), node


def manifest_rows(ready, rows, **options):
    docs = ready.createDataFrame(rows, "doc_id long, source string, text string")
    docs = docs.select("*", *(F.lit(1).alias(c) for c in ("tree", "pos", "digest", "order", "block", "part", "root", "tie")))
    columns = [F.col("doc_id"), F.col("source")]
    small = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    bad = F.when(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0,
                 merkle.record_digest(*columns, small))
    manifest = merkle.build(docs, merkle.record_digest(*columns, F.col("text")), carry={"bad": bad})
    return merkle.proofs(manifest, claimed="bad", **options)


def test_manifest(ready):
    r = random.Random(3)
    rows = [(i, "hot", f"Text {r.random()}") for i in range(4500)] + [(i, f"s{i % 40}", f"t{i}") for i in range(5000, 5700)]
    rows += [(1, None, None), (2, None, ""), (2, None, ""), (None, "n", "A"), (None, "n", "B"), (7, "", "x"), (8, "é", "x")]
    rows += [(9000 + i, "sixteen", "x") for i in range(16)] + [(9100 + i, "seventeen", "X") for i in range(17)]
    r.shuffle(rows)
    found = manifest_rows(ready, rows).collect()
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root")
    assert normal(tuple(f[n] for n in names) for f in found) == normal(brute_manifest(rows))
    assert all(f.verified == (f.folded_root == f.root) for f in found)
    assert {f.verified for f in found} == {True, False}


def test_manifest_siblings_fold(ready):
    rows = [(i, "ab"[i % 2], str(i)) for i in range(40)]
    for f in manifest_rows(ready, rows, siblings=True).collect():
        node = f.leaf
        for left, right in zip(f.lefts, f.rights):
            node = H(left + node + right)
        assert node == f.root and f.proof_sha256 == H("".join(a + b for a, b in zip(f.lefts, f.rights)))


def test_manifest_of_one_row_and_of_none(ready):
    (one,) = manifest_rows(ready, [(3, "s", "x")]).collect()
    assert one.leaf == one.subroot == one.root == leaf(3, "s", "x") and one.proof_sha256 == H("")
    assert manifest_rows(ready, []).collect() == []


@pytest.mark.parametrize("height", [1, 2, 3, 4])
def test_van_emde_boas_order(height):
    places = merkle.addresses(height)
    assert sorted(np.concatenate(places).tolist()) == list(range(merkle.tree_size(height)))
    assert [len(p) for p in places] == [16**d for d in range(height)] and places[0][0] == 0
    if height == 4:  # halves of two levels: every lower subtree lies in one stretch of 17
        for i in range(256):
            below = places[3][16 * i : 16 * i + 16]
            assert places[2][i] == 17 + 17 * i and below.tolist() == list(range(places[2][i] + 1, places[2][i] + 17))


# ---------------------------------------------------------------- periodic runs


def brute_runs(words, least=24, periods=3):
    ids = {}
    s = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    found = {}
    for p in range(1, len(s) // periods + 1):
        same = np.concatenate(([False], s[p:] == s[:-p], [False])).astype(np.int8)
        starts, ends = np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)
        for a, b in zip(starts.tolist(), ends.tolist()):
            if b - a + p >= max(least, periods * p):
                found.setdefault((a, b - a + p), p)
    return sorted(((a, n, p) for (a, n), p in found.items()), key=lambda r: (r[0], r[2]))


def made_words(r):
    words, kinds = [], r.choice([1, 2, 3, 30])
    while len(words) < r.randint(0, 140):
        block = [r.randint(0, kinds) for _ in range(r.randint(1, 12))]
        words += block * r.randint(2, 7) if r.random() < 0.4 else block[:1]
    return words


def test_runs_of_made_words():
    r, total = random.Random(1), 0
    for _ in range(700):
        words = made_words(r)
        assert list(map(tuple, periodic.text_runs(np.array(words, np.int64)).tolist())) == brute_runs(words)
        every = periodic.runs_of(np.array(words, np.int64), 1, 2)
        assert list(map(tuple, every.tolist())) == brute_runs(words, 1, 2)
        total += len(every)
    assert total > 5000


def test_extensions():
    r = random.Random(2)
    words = [r.randint(1, 3) for _ in range(300)]
    tree = periodic.SuffixTree(words, 4)
    a, b = np.array([(r.randint(0, 299), r.randint(0, 299)) for _ in range(2000)]).T
    a, b = a[a != b], b[a != b]
    for i, j, n in zip(a.tolist(), b.tolist(), tree.extension(a, b).tolist()):
        k = 0
        while max(i, j) + k < 300 and words[i + k] == words[j + k]:
            k += 1
        assert n == k
    suffixes = sorted(range(301), key=lambda i: words[i:])
    assert np.argsort(tree.ranks()).tolist() == suffixes
    assert np.argsort(tree.ranks(True)).tolist() == sorted(range(301), key=lambda i: [-w for w in words[i:]])


def collapsed(words, runs):
    dropped = {i for a, n, p in runs for i in range(a + p, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def strongest(runs):
    from fractions import Fraction

    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def test_periodic_rows(ready):
    line = "one two three four\n"
    texts = [None, "", " \t", "a " * 23, "a " * 24, line * 5, line * 6, "x " + line * 9 + "y " * 40, "B b " * 30, line * 9 + "é  " * 30]
    texts += ["tail " + "w" * 9 + " v " + line * 12, line * 40_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, ""), (None, line * 7)]
    docs = ready.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("__text", F.lit("no"))
    found = periodic.periodic_runs(docs).collect()
    expected = []
    for n, t in rows:
        words = [w.decode() for w in (t or "").encode().split()]
        runs = brute_runs(words) if len(words) < 9999 else [(0, len(words), 4)]
        expected.append((n, runs, strongest(runs), collapsed(words, runs)))
    assert normal(
        (f.doc_id, [tuple(r) for r in f.runs], f.strongest and tuple(f.strongest), f.collapsed) for f in found
    ) == normal(expected)
    assert periodic.periodic_runs(docs.limit(0)).collect() == []


def test_periodic_query(ready):
    """The registered query over the whole smallest tables, planted runs and digests included."""
    query = queries.op13_periodic_runs(ready, SF_DIR)
    assert query.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    docs = ready.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: tuple(r) for r in query.collect()}
    assert len(found) == len(docs)
    for n, text in docs:
        words, h = [w.decode() for w in (text or "").encode().split()], zlib.crc32(str(n).encode())
        if h % 10 == 0 and words:
            a, g, size = h // 10 % len(words), h // 10, len(words)
            p = 1 + (size - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, size)]
        runs = brute_runs(words)
        best = strongest(runs)
        numbers = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        lines = "".join(f"{a},{size},{p}\n" for a, size, p in runs)
        assert found[n] == (n, len(runs), *numbers, H(lines), H(collapsed(words, runs)))
    assert sum(f[1] > 0 for f in found.values()) > 10
