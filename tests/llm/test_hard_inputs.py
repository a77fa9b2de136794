"""Inputs that broke operators: stray quotes, many marks, clashing names, shared ids, large families."""

import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from costwright.llm import bpe, classifier, hnsw, html_crf, jaccard, quality, secrets
from costwright.llm.queries import BYTE_BPE
from costwright.llm.shared import shipped, unused
from test_similarity import brute_groups


@pytest.fixture(scope="module")
def ready(spark):
    shipped(spark)
    return spark


# ------------------------------------------------------------------- page text


@pytest.mark.parametrize(
    "page, texts",
    [
        ('<p class="a"">Hello world</p>', ["Hello world"]),
        ("<p title=it's>Lost one</p><p>Don't lose</p>", ["Lost one", "Don't lose"]),
        ('<p a="x>y" b=\'"\' c = "z" / >one</p><p =" q">two</p>', ["one", "two"]),
        (f'<p x="{"a" * 100_000}">one</p><p {"b" * 100_000}>two</p><p c={"c" * 100_000}>three', ["one", "two", "three"]),
        ("<p>a</p></ b><!doctype x><!--><p>b</p><!-- x --!><p>c</p>1 < 2 </> d", ["a", "b", "c", "1 < 2 d"]),
        ("<p>kept</p><p class=\"never closed>gone", ["kept", "gone"]),
        ("<script>if (a</scripty) x</script><p>after", ["after"]),
    ],
)
def test_tags_with_odd_attributes(page, texts):
    assert [b.text for b in html_crf.blocks(page)] == texts


@pytest.mark.parametrize("piece", ["<a ", "<!--", '<p "', "<p x='", "</", "<p =", '<a b="', "<script>", "<", "<a b='\""])
def test_time_is_linear_in_a_page_of_broken_tags(piece):
    started = time.perf_counter()
    html_crf.blocks(piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - started < 20


#: Pages written by hand, not by the generator: names that are in none of its lists. Text marked with | is the article's.
HAND_MADE = [
    """<html><body><div id="zz1"><a href=/>Home</a> <a href=/n>News</a> <a href=/s>Sport</a></div>
    <main class="kolumne"><h1>|Harbour bridge reopens after repairs|</h1><p>|The bridge carried its first cars on Monday, two weeks
    early. Engineers had replaced forty cables.|</p><p>|“It feels solid,” said one driver.|</p></main>
    <div class="leserpost"><h3>Meinungen</h3><div class="lp-item"><b>anna</b><p>About time, the detour was awful.</p></div>
    <div class="lp-item"><b>joe</b><p>Great work by everyone.</p></div></div><div class="fuss">&copy; 2021 Harbour Post</div></body></html>""",
    """<body><ul class="x9"><li><a href=1>One</a></li><li><a href=2>Two</a></li><li><a href=3>Three</a></li></ul>
    <article><h1>|On keeping bees|</h1><p>|Bees need water in early spring. A shallow dish with stones is enough for a small hive.|</p>
    <h2>|Tools|</h2><ul><li>|A smoker with dry fuel|</li><li>|A flat hive tool|</li></ul>
    <p>|Most keepers open the hive once a week in summer. They look for eggs and for queen cells.|</p></article>
    <section class="qqq"><h3>What readers say</h3><div class="w1"><b>maria</b><p>Useful, thank you!</p></div></section>
    <footer><p>&copy; 2019 Garden Weekly. All rights reserved.</p></footer></body>""",
    """<html><body><nav><a href=/a>Start</a> | <a href=/b>About</a></nav><div class="hinweis"><p>We use cookies. Go on to accept.</p><button>OK</button></div>
    <article class="beitrag"><h1>|River levels fall|</h1><p>|Levels fell by nine centimetres in a week. Barges carry half their load.|</p>
    <blockquote>|We expect rain only in October.|</blockquote><p>|The port has stopped two ferries until then.|</p></article>
    <aside class="mehr"><h3>More</h3><ul><li><a href=/1>Storm warning lifted</a></li><li><a href=/2>New lock opens</a></li></ul></aside></body></html>""",
    """<body><header><a href=/><b>The Lamp</b></a></header><article><h1>|A short history of the oil lamp|</h1>
    <p>|Clay lamps burned olive oil. Glass chimneys came much later and made the flame steady.|</p>
    <p>|The first street lamps were lit by hand every evening by a man with a ladder.|</p></article>
    <form class="brief"><p>Get our letter every week.</p><input name=m><button>Send</button></form><footer>&copy; The Lamp</footer></body>""",
    """<body><div class="kopf"><a href=/>Start</a> <a href=/k>Kontakt</a> <a href=/i>Impressum</a></div><main><h1>|Winter tyres|</h1>
    <p>|Tyres should have four millimetres of tread. Below that they slide on wet snow.|</p><p>|Check the pressure when they are cold.|</p>
    <table><tr><td>|Small car|</td><td>|2.2 bar|</td></tr><tr><td>|Van|</td><td>|3.1 bar|</td></tr></table></main>
    <div class="unten"><a href=/a>Terms</a> <a href=/b>Privacy</a></div></body>""",
]


def hand_made_blocks():
    for page in HAND_MADE:
        marked = [b.text for b in html_crf.blocks(page)]
        clean = page.replace("|<", "<").replace(">|", ">")
        wanted = [t.strip("|") for t in marked if t.startswith("|") and t.endswith("|") and len(t) > 2]
        yield clean, wanted


def test_hand_made_pages():
    model, right, total, whole = html_crf.trained(), 0, 0, 0
    for page, wanted in hand_made_blocks():
        texts = [b.text for b in html_crf.blocks(page)]
        got = html_crf.main_text(page, model).split("\n\n")
        right += sum((t in got) == (t in wanted) for t in texts)
        total += len(texts)
        whole += got == wanted
    print(f"hand-made pages: {right} of {total} blocks, {whole} of {len(HAND_MADE)} pages whole")
    assert right / total >= 0.9


# ------------------------------------------------------------- secrets and rules


def test_armour_is_linear_in_its_marks():
    text = "-----BEGIN RSA PRIVATE KEY-----\n" * 32_000 + "-----END RSA PRIVATE KEY-----"
    started = time.perf_counter()
    assert secrets.find_secrets(text) == []
    assert time.perf_counter() - started < 20


def test_armour_ends_at_the_next_begin():
    body = "MEgCAQACQQC" + "A" * 8 + "\n"
    der = secrets.base64.b64encode(b"\x30\x1a\x02\x01\x00" + b"\x04\x15" + b"x" * 21).decode()
    key = f"-----BEGIN PRIVATE KEY-----\n{der}\n-----END PRIVATE KEY-----"
    text = f"-----BEGIN PRIVATE KEY-----\n{body}{key} -----END PRIVATE KEY-----"
    spans = [s for s in secrets.find_secrets(text) if s[0] == "pem"]
    assert [text[a:b] for _, a, b in spans] == [key]


def test_rules_under_filters_and_clashing_names(ready):
    folder = "/root/testdata/sf0.001"
    docs = ready.read.parquet(f"{folder}/documents.parquet")
    labels = ready.read.parquet(f"{folder}/labels.parquet").filter("quality = 1")
    weights = quality.ratio_weights(docs, labels, "doc_id", "text")
    started = time.perf_counter()
    rated = quality.rated(docs, weights)
    kept = {r.doc_id for r in rated.filter("kept and ratio > -9").collect()}
    assert time.perf_counter() - started < 60
    assert kept == {r.doc_id for r in rated.collect() if r.kept} and kept
    clash = docs.select("*", F.lit(0.75).alias("ratio"), F.lit("mine").alias("kept"), F.lit(1).alias("__words"),
                        F.lit(2).alias("__row"), F.lit(3).alias("c0"), F.lit(4).alias("n_words"))
    passed = quality.passing(clash, weights)
    assert passed.columns == clash.columns
    rows = passed.collect()
    assert {r.doc_id for r in rows} == kept and {(r.ratio, r.kept, r.n_words) for r in rows} == {(0.75, "mine", 4)}
    both = quality.rated(clash, weights, keep=("doc_id", "kept", "__row"))
    assert both.columns == ["doc_id", "given_kept", "__row", *quality.MEASURES]
    assert {r.doc_id for r in both.filter("kept").collect()} == kept


# ------------------------------------------------------------------ classifier


def test_scores_with_a_clashing_name_and_shared_ids(ready):
    r = random.Random(4)
    words = [[f"good{i}" for i in range(40)], [f"bad{i}" for i in range(40)]]
    rows = [(i // 2, " ".join(r.choices(words[i // 2 % 2], k=30)), i) for i in range(120)]
    labels = ready.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id long, quality int")
    models = []
    for parts in (1, 5):
        r.shuffle(rows)
        docs = ready.createDataFrame(rows, "doc_id long, text string, score int").repartition(parts)
        models.append(classifier.fit(docs, labels))
    assert all(np.array_equal(a, b) for a, b in zip(*((m.vectors, m.layer, m.bias) for m in models)))
    scored = classifier.score(docs, models[0])
    assert scored.columns == ["doc_id", "text", "score"] and dict(scored.dtypes)["score"] == "double"
    assert all((x.score >= 0.5) == ("good" in x.text) for x in scored.collect())
    with pytest.raises(ValueError):
        classifier.score(docs, models[0], score="text")
    assert unused(docs, "score") == "_score" and unused(docs, "other") == "other"


def test_learning_runs_in_a_task(ready, monkeypatch):
    """The driver keeps the model only, not what learning needs."""

    def where(texts, labels):
        shapes = ((classifier.BUCKETS, classifier.DIM), (2, classifier.DIM))
        return classifier.SubwordModel(*(np.zeros(s, np.float32) for s in shapes), np.full(2, os.getpid(), np.float32))

    monkeypatch.setattr(classifier, "train", where)
    docs = ready.createDataFrame([(i, f"text {i}") for i in range(9)], "doc_id long, text string")
    labels = ready.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, quality int")
    assert classifier.fit(docs, labels).bias[0] != np.float32(os.getpid())


# -------------------------------------------------------------------- joins


def test_family_whose_members_do_not_link(ready):
    """2,000 texts share three fifths of their words: every signature of the shared part has many members."""
    r = random.Random(9)
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(i, shared + " " + " ".join(f"o{r.randint(0, 10**9)}" for _ in range(40))) for i in range(2000)]
    rows += [(5000 + i, rows[i][1] + " more") for i in range(20)] + [(6000 + i, rows[0][1]) for i in range(300)]
    docs = ready.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x.doc_id: x.component_id for x in jaccard.similar_groups(docs).collect()}
    assert got == {i: i for i in range(2000)} | {5000 + i: i for i in range(20)} | {6000 + i: 0 for i in range(300)}


def test_groups_by_a_composite_key(ready):
    r = random.Random(2)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        at = r.randint(0, 5) * 40
        words = base[at : at + 80]
        rows.append((i, " ".join(words[: r.randint(70, 80)])))
    docs = ready.createDataFrame(rows, "doc_id long, text string")
    keyed = docs.select(F.struct(F.lit(False).alias("none"), F.col("doc_id").alias("id")).alias("key"), "text")
    got = sorted((x.key.id, x.n_shingles, x.component_id.id) for x in jaccard.similar_groups(keyed, "key").collect())
    assert got == [tuple(x) for x in brute_groups(rows, 4, 85)]


def test_rows_that_share_an_id_go_by_their_own_text(ready):
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, one, "x"), (1, two, "x"), (2, one + " more", "x"), (3, two, "x"), (4, "alone", "x"), (4, "alone", "x"),
            (None, one, "x"), (5, None, "x"), (5, "", "x"), (0, two + " end", "y")]
    docs = ready.createDataFrame(rows, "doc_id long, text string, lang string")
    docs = docs.select("*", *(F.lit(7).alias(c) for c in ("key", "rows", "similar", "other", "held", "bucket", "bits", "key_bit")))
    near = corpus_pipeline.near_duplicates(ready, docs, "")
    assert near.columns == docs.columns
    got = sorted(((x.doc_id, x.text) for x in near.collect()), key=str)
    # (1, two) and (3, two) go with (0, two + end); (5, null) and (5, '') share an id and no words
    assert got == sorted([(1, one), (0, two + " end"), (4, "alone"), (None, one), (5, got_text(got))], key=str)


def got_text(got):
    """One of the two empty texts of id 5 stays."""
    (text,) = [t for i, t in got if i == 5]
    assert not text
    return text


# ---------------------------------------------------------------------- BPE


def test_ids_and_text_from_one_pass(ready):
    texts = ["", None, "a  b <|endoftext|> c", "naïve 漢字  x", "x" * 3000]
    docs = ready.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    both = {r.doc_id: r for r in bpe.encode(docs, BYTE_BPE, decoded="back").collect()}
    assert {i: r.back for i, r in both.items()} == {i: t or "" for i, t in enumerate(texts)}
    alone = {r.doc_id: (r.ids, r.decoded) for r in bpe.decode(bpe.encode(docs, BYTE_BPE), BYTE_BPE).collect()}
    assert alone == {i: (r.ids, r.back) for i, r in both.items()}


# ----------------------------------------------------------------- embeddings


def test_vectors_of_any_size_are_compared(ready):
    base = [1.0, 2.0, -3.0, 0.5]
    scales = [1.0, 1e-300, 1e300, 1e-160, 1e200, 3.0]
    rows = [(i, [x * s for x in base]) for i, s in enumerate(scales)] + [(10, [5e-324, 0.0, 0.0, 0.0]), (11, [1.0, 0.0, 0.0, 0.0])]
    rows += [(20, [-1.0, 1.0, 0.0, 9.0]), (21, [float("inf"), 1.0, 1.0, 1.0]), (22, [0.0] * 4)]
    found = hnsw.near_duplicates(ready.createDataFrame(rows, "vec_id long, embedding array<double>"), least=0.9)
    got = {r.vec_id: (r.n_links, r.component_id) for r in found.collect()}
    assert got == {i: (5, 0) for i in range(6)} | {10: (1, 10), 11: (1, 10), 20: (0, 20), 21: (0, 21), 22: (0, 22)}
