"""Archives, main text of pages, language-model scores and the pipeline against plain versions."""

import base64
import hashlib
import io
import math
import random
import zipfile
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from costwright.llm import html_crf, ngram_trie, queries, warc_zip
from costwright.llm.shared import shipped


@pytest.fixture(scope="module")
def ready(spark):
    shipped(spark)
    return spark


PAGES = "page_id long, url string, html string, kept int, sha1 int"


def test_round_trip(ready):
    rows = [(i, f"http://e.x/{i}", t, 1, 1) for i, t in enumerate(["a", "b", "a", "é\r\n\r\nWARC/1.1\n", "", None, "a", "x" * 3_000_000])]
    rows += [(20, None, "twice", 1, 1), (20, None, "twice", 1, 1), (3, "u\r\nX: y", "b", 1, 1), (None, "n", "none", 1, 1), (None, "n", "b", 1, 1)]
    pages = ready.createDataFrame(rows, PAGES).repartition(3)
    for least in (0, 2):
        largest = {}
        for page_id, _, html, *_ in rows:
            if page_id is not None:
                largest[html or ""] = max(page_id, largest.get(html or "", -1))
        want = []
        for page_id, _, html, *_ in rows:
            data = (html or "").encode()
            top = largest.get(html or "")
            refers = top if len(data) >= least and top != page_id and sum((r[2] or "") == (html or "") for r in rows) > 1 else None
            digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
            want.append((page_id, len(data), digest, "response" if refers is None else "revisit", refers))
        records = warc_zip.round_trip(pages, least).collect()
        key = lambda r: str(r)
        got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records]
        assert sorted(got, key=key) == sorted(want, key=key)
        texts = {(r.page_id, bytes(r.payload).decode()) for r in records if r.payload is not None}
        assert (3, "é\r\n\r\nWARC/1.1\n") in texts and (7, "x" * 3_000_000) in texts
    assert warc_zip.round_trip(pages.limit(0)).count() == 0


def test_directories(monkeypatch):
    def package(comment=b""):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("first.bin", bytes(range(256)) * 8)
            z.writestr("ünder/zweite.txt", b"0123456789")
            z.writestr("packed", b"z" * 1000, zipfile.ZIP_DEFLATED)
            z.comment = comment
        return out.getvalue()

    plain = package()
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 20)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    wide = package(b"a comment with PK\x05\x06 in it")
    assert b"PK\x06\x06" in wide and b"PK\x06\x06" not in plain
    for data in (plain, wide):
        for source in (warc_zip.BytesSource(data), warc_zip.FileSource(io.BytesIO(data))):
            reads = []
            read = source.read
            source.read = lambda a, n: reads.append(n) or read(a, n)
            z = warc_zip.ZipPackage(source)
            assert z.read("ünder/zweite.txt", 3, 4) == b"3456" and z.read("ünder/zweite.txt", 8, 9) == b"89"
            reads.clear()
            assert z.read("first.bin", 255, 2) == b"\xff\x00" and max(reads) <= 30
            with pytest.raises(ValueError, match="not stored"):
                z.read("packed")
    with pytest.raises(ValueError, match="end of central"):
        warc_zip.ZipPackage(warc_zip.BytesSource(b"no package"))


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>no</title><script>var a="<p>x</p>"</script></head><body>
      <nav><ul><li><a href=/a>A &amp; b</a><li><a href="/b>">B</a></ul></nav><!-- <p>no</p> -->
      <p>one <b>two<br>three</b>\n four&nbsp;&lt;x&gt;<p>five<img src=x> six<div class='Ad-Slot x'>seven</div>tail <textarea>no</textarea>a < b &am <p"""
    found = html_crf.blocks(page)
    assert [b.text for b in found] == ["A & b", "B", "one two three four <x>", "five six", "seven", "tail", "a < b &am"]
    assert found[0].link_share == pytest.approx(1, abs=0.9) and "t:nav" in found[1].above and found[1].near == "li"
    assert {"n:ad", "n:slot", "n:x", "t:div"} <= found[4].above and found[2].link_share == 0
    assert html_crf.blocks(None) == [] and html_crf.blocks("") == [] and html_crf.blocks("  ") == []
    assert len(html_crf.blocks("<div>" * 5000 + "deep" + "<p>x" * 3000)) == 3001


ARTICLE = "<article><p>First part.</p><p>Second part.</p></article>"


@pytest.mark.parametrize(
    "before",
    [
        "<svg>" + "<path d='M0 0'/>" * 200 + "</svg>",
        "<svg>" + "<circle/><title/><g><desc>x<br/></desc></g>" * 200 + "</svg>",
        "<svg>" + "<path>" * 200 + "</svg>",
        "<math>" + "<mspace/>" * 200 + "</math>",
        "<select>" + "<option>Land" * 200 + "</select>",
        "<select>" + "<optgroup label=a><option>x<option>y" * 200 + "</select>",
        "<datalist hidden>" + "<option value=x>" * 200 + "</datalist>",
        "<nav>" + "<font size=1>" * 200 + "</nav>",
        "<nav>" + "<span>" * 200 + "</nav>",
        "<table>" + "<tr><td>" + "<font>" * 200 + "<tr><td></table>",
    ],
)
def test_many_open_elements_before_the_article(before):
    found = html_crf.blocks(f"<body>{before}{ARTICLE}</body>")
    plain = html_crf.blocks(f"<body>{ARTICLE}</body>")
    assert [(b.text, b.near, b.above) for b in found] == [(b.text, b.near, b.above) for b in plain]


def test_implied_ends_of_options():
    page = "<datalist><option>a<option>b</datalist><option>c<option>d<p>e"
    assert [(b.text, b.near) for b in html_crf.blocks(page)] == [(x, "option") for x in "abcd"] + [("e", "p")]
    assert html_crf.blocks("<select><optgroup><option>a<optgroup><option>b</select><p>c")[0].above == {"t:p"}


def test_chain_equals_enumeration():
    r = np.random.default_rng(3)
    chain = html_crf.Chain(moves=r.normal(size=(2, 2)))
    for n in range(1, 8):
        scores = r.normal(size=n).tolist()
        paths = [[i >> t & 1 for t in range(n)] for i in range(1 << n)]
        value = [sum(s for s, y in zip(scores, p) if y) + sum(chain.moves[a, b] for a, b in zip(p, p[1:])) for p in paths]
        weight = np.exp(value) / np.exp(value).sum()
        ones, pairs = chain.expected(scores)
        assert ones == pytest.approx([sum(w for w, p in zip(weight, paths) if p[t]) for t in range(n)])
        for a in (0, 1):
            for b in (0, 1):
                assert pairs[a, b] == pytest.approx(sum(w * sum((x, y) == (a, b) for x, y in zip(p, p[1:])) for w, p in zip(weight, paths)))
        assert chain.viterbi(scores) == paths[int(np.argmax(value))]
    assert chain.viterbi([]) == []


def test_held_out_pages(ready):
    model = html_crf.trained()
    right = total = 0
    for features, labels in html_crf.labelled(150, seed=2024):
        found = model.viterbi(model.emissions(features))
        right += sum(a == b for a, b in zip(found, labels))
        total += len(labels)
    assert right / total > 0.98
    r = random.Random(6)
    made = [html_crf.labelled_page(r) for _ in range(60)]
    rows = [(i, "u", page, 1) for i, (page, _) in enumerate(made)] + [(None, None, None, 1), (98, "u", "", 1), (0, "u", made[0][0], 1)]
    pages = ready.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html_crf.extract(pages).collect()
    assert len(got) == len(rows) and sum(r.text == "" for r in got) >= 2
    texts = {r.page_id: r.text for r in got}
    assert np.mean([texts[i] == "\n\n".join(main) for i, (_, main) in enumerate(made)]) > 0.85
    assert html_crf.extract(pages.limit(0)).count() == 0


def plain_scores(rows, order, prior):
    docs = [(held, (text or "").encode().lower().split() + [b" end"]) for text, held in rows]
    grams, contexts = Counter(), Counter()
    for held, words in docs:
        line = [b" start", *words]
        for k in range(1, order + 1):
            for j in range(max(1, k - 1), len(line)):
                if not held:
                    grams[tuple(line[j - k + 1 : j + 1])] += 1
                    contexts[tuple(line[j - k + 1 : j])] += 1
    total = contexts[()]
    distinct = sum(len(g) == 1 for g in grams)
    for held, words in docs:
        line, base, score, known = [b" start", *words], 0.0, 0.0, 0
        for j in range(1, len(line)):
            n = grams[(line[j],)]
            known += n > 0
            p = (n + 1) / (total + distinct + 1)
            base += math.log10(p)
            for k in range(2, order + 1):
                if j >= k - 1:
                    gram = tuple(line[j - k + 1 : j + 1])
                    p = (grams[gram] + prior * p) / (contexts[gram[:-1]] + prior)
            score += math.log10(p)
        yield held, len(words), known, total, base, score


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_plain_counts(ready, monkeypatch, order):
    monkeypatch.setattr(ngram_trie, "SHARD_TOKENS", 700)
    monkeypatch.setattr(ngram_trie, "BLOCK_CHARS", 2000)
    r = random.Random(order)
    words = ["the", "The", "of", "é", "a\x0bb", "</s>", "x" * 50, *(f"w{i}" for i in range(60))]
    texts = [None, "", " ", *(" ".join(r.choices(words, weights=[30, 9, 20] + [1] * 64, k=r.randint(0, 90))) for _ in range(150))]
    texts += [texts[9], texts[9], "the of " * 2000, "unseen words only"]
    rows = [(i if i != 4 else None, t, i % 7 == 2 or i == len(texts) - 1, 1, 1) for i, t in enumerate(texts)]
    docs = ready.createDataFrame(rows, "doc_id long, text string, held boolean, ids int, score int").repartition(3)
    got = {r.doc_id: r for r in ngram_trie.score(docs, F.col("held"), order=order, prior=5.0).collect()}
    assert len(got) == len(rows)
    for (doc_id, *_), want in zip(rows, plain_scores([(t, h) for _, t, h, *_ in rows], order, 5.0)):
        row = got[doc_id]
        assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == want[:4]
        assert row.base_score == pytest.approx(want[4]) and row.score == pytest.approx(want[5], rel=2e-3)


def test_scores_without_training(ready):
    docs = ready.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in ngram_trie.score(docs, F.lit(True)).collect()}
    assert (rows[1].n_tokens, rows[1].n_known, rows[1].train_tokens, rows[1].base_score) == (3, 0, 0, 0.0)
    assert rows[2].n_tokens == 1 and ngram_trie.score(docs.limit(0), F.lit(False)).count() == 0


def test_registered_scores_use_three_words(ready, tmp_path):
    r = random.Random(8)
    texts = [" ".join(r.choices([f"w{i}" for i in range(12)], k=r.randint(0, 60))) for _ in range(120)]
    docs = ready.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op2_ngram_trie"](ready, str(tmp_path)).collect()}
    for (i, t), want in zip(enumerate(texts), plain_scores([(t, got[i].held_out) for i, t in enumerate(texts)], 3, ngram_trie.PRIOR)):
        assert got[i].score == pytest.approx(want[5], rel=2e-3)


def test_messages_hold_every_ngram_in_fewer_bytes():
    r = np.random.default_rng(4)
    words = np.unique(np.append(r.integers(0, 2**64, 5000, np.uint64), np.uint64(ngram_trie.START)))
    tokens = np.minimum(r.zipf(1.3, 60_000), len(words)) - 1
    block = ngram_trie.Block(words, tokens, np.array([20_000, 60_000]), np.zeros(2, bool), 3)
    hashes = (words >> np.uint64(32)).astype("<u4")
    sent = old = 0
    levels = [[], []]
    for _, found in block.pieces(4):
        for k, level in enumerate(levels):
            level.append(found[2][found[4 + 3 * k]])
        sent += len(ngram_trie.pack(found))
        old += len(ngram_trie.pack([*found[:2], *(x for k in (0, 1) for x in (found[3 + 3 * k], levels[k][-1], found[5 + 3 * k]))]))
    assert all(np.array_equal(np.concatenate(x), hashes[w]) for x, w in zip(levels, block.word))
    assert sent < 0.8 * old


def test_elias_fano():
    r = np.random.default_rng(8)
    for n, universe in [(0, 10), (1, 1), (1, 1 << 61), (5, 5), (1000, 1000), (1000, 1 << 40), (5000, 70_000), (3000, 1 << 63)]:
        values = np.sort(r.integers(0, universe, n, np.uint64))
        held = ngram_trie.mapped([ngram_trie.EliasFano.encode(values, universe)])[0]
        assert (held.access(np.arange(n)) == values).all() if n else True
        asked = np.concatenate([values, r.integers(0, universe, 500, np.uint64)])
        found = held.find(asked, np.zeros(len(asked), np.int64), np.full(len(asked), n))
        assert ((found >= 0) == np.isin(asked, values)).all() and (values[found[found >= 0]] == asked[found >= 0]).all()
        start = r.integers(0, n + 1, len(asked))
        ranged = held.find(asked, start, np.full(len(asked), n))
        want = np.searchsorted(values, asked)
        last = np.searchsorted(values, asked, side="right")
        assert ((ranged >= 0) == (np.maximum(want, start) < last)).all()


def test_pipeline_equals_plain_version(ready):
    """Each stage against its rule, on its own input; the end against the documents that must and must not be there."""
    folder = "/root/testdata/sf0.001"
    docs = ready.read.parquet(f"{folder}/documents.parquet")
    names, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(ready, docs, folder).cache()
        kept[name] = {r.doc_id for r in docs.collect()}
        assert kept[name] <= set(before)
        if name != "packing":
            assert docs.columns == names
        if name in ("quality_rules", "quality_classifier", "near_duplicates"):
            assert all(r == before[r.doc_id] for r in docs.collect())
        if name == "near_duplicates":
            from test_similarity import brute_groups

            rows = [(r.doc_id, r.text) for r in before.values()]
            assert kept[name] == {least for _, _, least in brute_groups(rows, 5, 80)}
        if name == "secret_scans":
            from costwright.llm.secrets import redact

            assert kept[name] == set(before)
            assert all(r.text == redact(before[r.doc_id].text) and r.n_chars == len(r.text) for r in docs.collect())
        if name == "packing":
            assert kept[name] == set(before)
    labels = {r.doc_id: r.quality for r in ready.read.parquet(f"{folder}/labels.parquet").collect()}
    good = [n for n, q in labels.items() if q == 1]
    assert np.mean([n in kept["quality_classifier"] for n in good]) > 0.85
    assert sum(labels.get(n) == 0 for n in kept["quality_classifier"]) <= 2
    whole = corpus_pipeline.run(ready, folder)
    assert {r.doc_id for r in whole.collect()} == kept["packing"]
    assert zlib.crc32(b"") == 0 and whole.columns[0] == "doc_id"


def test_stages_with_odd_rows(ready, tmp_path):
    """Nulls in any column, repeated rows, extra columns; then no rows at all."""
    text = " ".join(f"word{i} of the" for i in range(60)) + ". password=0123456789abcdef01"
    rows = [(None, None, None, None, None, 1), (1, text, "en", "s", 5, 1), (1, text, "en", "s", 5, 1), (2, text, None, None, None, 1), (None, text, "en", "s", 1, 1), (3, "", "en", "s", 0, 1)]
    docs = ready.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int")
    ready.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    near = corpus_pipeline.near_duplicates(ready, docs, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in near) == ["1", "3", "None", "None"]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(ready, docs, str(tmp_path)).count() > 0
        assert stage(ready, docs.limit(0), str(tmp_path)).count() == 0
