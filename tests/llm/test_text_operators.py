"""Quality rules, classifier, secrets, byte BPE and packing against plain versions and the libraries."""

import base64
import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from costwright.llm import bpe, classifier, packing, quality, secrets
from costwright.llm.shared import shipped

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, kept int, __text int, ids int, score int, secrets int, block int"


@pytest.fixture(scope="module")
def ready(spark):
    shipped(spark)
    return spark


def odd_texts():
    r = random.Random(3)
    bits = [" ", "  ", "\n", "\t", "a", "the", "'s", "'RE", "É", "ß", "中", "\x1c", "\x85", "\xa0", "1", "23", ".", "!!",
            "<|endoftext|>", "<|STARTOFTEXT|>", "Σ", "́", "X", "😀", "\r\n", " \n", "\x00", "​", "İ", "|"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(400)]
    return [None, "", " ", *texts, "lorem ipsum dolor " * 20_000, texts[7], texts[7]]


def frame(spark, texts):
    rows = [(i if i != 5 else None, t, 1, 1, 1, 1, 1, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def test_bpe_equals_library(ready):
    texts = odd_texts()
    library = Tokenizer.from_file(BYTE_BPE)
    rows = bpe.decode(bpe.encode(frame(ready, texts), BYTE_BPE), BYTE_BPE).collect()
    assert len(rows) == len(texts)
    found = {r.doc_id: r for r in rows}
    for i, text in enumerate(texts):
        want = library.encode(text or "", add_special_tokens=False).ids
        row = found[i if i != 5 else None]
        assert np.frombuffer(bytes(row.ids), "<u4").tolist() == want
        assert row.decoded == library.decode(want, skip_special_tokens=False)


def test_trie_equals_merge_rules():
    r = random.Random(1)
    words = {bytes(r.choice(b"abcehinorst \xc3\xa9") for _ in range(r.randint(1, 14))) for _ in range(3000)}
    words |= {b"a" * n for n in range(1, 60)}
    model = bpe.ByteBpe(BYTE_BPE)
    assert all(list(ids) == model.by_rules(w) for w, ids in model.encode_words(words).items())


def test_bpe_of_an_empty_table(ready):
    assert bpe.decode(bpe.encode(frame(ready, []), BYTE_BPE), BYTE_BPE).count() == 0


def test_ids_of_all_latin_letters_equal_library():
    words, library = packing.load(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    for code in range(0x250):
        for text in (chr(code), f"ab{chr(code)}cd {chr(code)}x 1{chr(code)}"):
            ids = np.frombuffer(words.ids(text), "<u4").tolist()
            assert ids == library.encode(text, add_special_tokens=False).ids, hex(code)


def test_cuts_fill_classes():
    for length in [*range(1, 3000), 4096, 4097, 8192, 100_001]:
        pieces = packing.cuts(length)
        assert sum(pieces) == length and max(pieces) <= packing.CAPACITY
        assert all(packing.CAPACITY - packing.CAPACITY // p * p <= 64 for p in pieces)


def test_packing(ready):
    texts = odd_texts() + ["word " * n for n in range(0, 1500, 7)]
    library = Tokenizer.from_file(WORD_BPE)
    rows = packing.pack(frame(ready, texts).repartition(3), WORD_BPE, with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
        pieces = sorted(by_doc[i if i != 5 else None], key=lambda r: r.start)
        assert [p.start for p in pieces] == np.cumsum([0, *(p.length for p in pieces)])[:-1].tolist()
        assert np.frombuffer(b"".join(bytes(p.ids) for p in pieces), "<u4").tolist() == ids
        for p in pieces:
            part = np.array(ids[p.start : p.start + p.length], "<u4").tobytes()
            assert (p.ids_crc32, p.doc_tokens) == (zlib.crc32(part), len(ids))
    padded = used = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        total = sum(p.length for p in pieces)
        assert [p.offset for p in pieces] == np.cumsum([0, *(p.length for p in pieces)])[:-1].tolist()
        assert total <= packing.CAPACITY
        used += total
        padded += total if total & (total - 1) == 0 else packing.CAPACITY
    assert used / padded > 0.97
    assert packing.pack(frame(ready, []), WORD_BPE).count() == 0


def plain_base(text):
    kinds = {
        "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
        "access": re.compile(r"AKIA[A-Z0-9]+"),
        "hex": re.compile(r"[0-9a-f]+"),
    }
    least = {"assign": 12, "access": 18, "hex": 16}
    found = [(k, m.start(), m.end()) for k, p in kinds.items() for m in p.finditer(text) if len(m[m.lastindex or 0]) >= least[k]]
    return sorted(found, key=lambda s: (s[1], list(kinds).index(s[0])))


def der(tag, *parts):
    body = b"".join(parts)
    size = len(body).to_bytes(1 if len(body) < 256 else 2, "big")
    return bytes([tag]) + (size if len(body) < 128 else bytes([0x80 + len(size)]) + size) + body


KEY = der(0x30, der(2, b"\0"), der(2, bytes(range(1, 200))), der(2, b"\1\0\1"), der(0x30, der(2, b"\5"), der(4, b"abc")))


def jwt(header, payload):
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).rstrip(b"=").decode()
    return f"{part(header)}.{part(payload)}.c2lnbmF0dXJlc2lnbmF0dXJl"


def test_base_spans_equal_plain_patterns(ready):
    r = random.Random(4)
    bits = ["password", "TOKEN", "api_key", "apiKey", '"', "'", " ", ":", "=", " = ", "abc123", "0123456789abcdef", "AKIA",
            "ABCDEFGH12345678", "é", "ſecret", "\n", "secret", "deadbeefdeadbeef", "x"]
    texts = [None, "", *("".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(1500))]
    rows = {r.doc_id: r.secrets for r in secrets.scan_secrets(frame(ready, texts)).collect()}
    for i, text in enumerate(texts):
        base = [tuple(s) for s in rows[i if i != 5 else None] if s.kind in secrets.BASE_KINDS]
        assert base == plain_base(text or "")


def test_structures_are_confirmed():
    body = base64.b64encode(KEY).decode()
    lines = "\n".join(body[i : i + 64] for i in range(0, len(body), 64))
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{lines}\n-----END RSA PRIVATE KEY-----"
    token = jwt({"alg": "HS256"}, {"sub": "1"})
    field = lambda b: len(b).to_bytes(4, "big") + b
    ssh = base64.b64encode(field(b"ssh-ed25519") + field(bytes(32))).decode()
    kinds = lambda t: {k for k, _, _ in secrets.find_secrets(t)} - set(secrets.BASE_KINDS)
    assert kinds(f"é {pem} x") >= {"pem"}
    assert ("pem", 2, 2 + len(pem)) in secrets.find_secrets(f"é {pem} x")
    assert kinds(f"a {token}.") == {"jwt"}
    assert kinds(f"k {body} z") == {"der"} and kinds(KEY.hex().upper()) == {"der"}
    assert kinds(ssh) == {"openssh"}
    # the same shapes without the structure
    assert not kinds(base64.b64encode(KEY[:-1]).decode()) and not kinds("A" * 80) and not kinds(KEY[:-1].hex().upper())
    assert not kinds(jwt({"typ": "JWT"}, {"sub": 1})) and not kinds("eyJhbGciOiJ4.abc.def")
    assert not kinds(pem.replace(lines[:10], "AAAAAAAAAA"))


@pytest.mark.parametrize("around", ["{}\n", "{}\\n", "{}\\r\\n", "{}\\\\n", "> {}\n", "# {}\n", "// {}\n", "+{}\n", '    "{}\\n" +\n'])
def test_keys_with_escaped_or_marked_lines(around):
    value = der(0x30, der(2, b"\x00"), der(4, random.Random(5).randbytes(600)))
    flat = base64.b64encode(value).decode()
    lines = [flat[i : i + 64] for i in range(0, len(flat), 64)]
    text = "".join(around.format(x) for x in ["-----BEGIN PRIVATE KEY-----", *lines, "-----END PRIVATE KEY-----"])
    assert "pem" in [kind for kind, *_ in secrets.find_secrets(f"key: {text} end")]
    assert not any(x in secrets.redact(f"key: {text} end") for x in lines)
    bare = "".join(around.format(x) for x in lines)
    if not around.startswith("+"):
        assert not any(x in secrets.redact(f"key: {bare} the end") for x in lines)


def test_redaction_covers_overlaps(ready):
    text = "x password=0123456789abcdef01 y"
    assert secrets.redact(text) == "x [SECRET] y" and secrets.redact(None) is None
    rows = secrets.redact_secrets(frame(ready, [None, text, ""])).collect()
    assert [r.text for r in rows] == [None, "x [SECRET] y", ""] and rows[0].kept == 1


def plain_rated(texts, weights):
    def hashes(*words):
        h = 42
        for w in words:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        return (h - (1 << 64) if h >> 63 else h) % len(weights)

    out = []
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        n = Counter(windows)
        repeated = {j for i, w in enumerate(windows) if n[w] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = [hashes(w) for w in words] + [hashes(a, b) for a, b in zip(words, words[1:])]
        ratio = sum(weights[g] for g in grams) / max(1, len(grams)) / quality.UNIT
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        out.append((
            len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)),
            len(repeated), failed, round(ratio, 9), not failed and ratio >= quality.LEAST_RATIO,
        ))
    return out


def test_quality_equals_plain_version(ready):
    r = random.Random(9)
    vocabulary = ["a", "of", "the", "é#", "x|y", "\n", "\t", "\x0b", "中文", "%%", "end"]
    texts = [None, "", "\n \n", *(" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 160))) for _ in range(80))]
    texts += [texts[9], "one two three " * 3000, "\n".join(["same line"] * 9)]
    docs = frame(ready, texts).repartition(3)
    trusted = ready.createDataFrame([(i,) for i in range(0, 80, 3)] + [(3,), (None,), (10**9,)], "doc_id long")
    weights = quality.ratio_weights(docs, trusted, "doc_id", "text", buckets=97)
    raw, good = Counter(), Counter()
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        for gram in [(w,) for w in words] + list(zip(words, words[1:])):
            h = 42
            for w in gram:
                h = xxhash.xxh64_intdigest(w.encode(), h)
            bucket = (h - (1 << 64) if h >> 63 else h) % 97
            raw[bucket] += 1
            good[bucket] += i % 3 == 0 and i < 80 and i != 5
    share = [raw[b] / sum(raw.values()) for b in range(97)]
    trusted_share = [(good[b] + quality.SMOOTHING * 97 * p) / (sum(good.values()) + quality.SMOOTHING * 97) for b, p in enumerate(share)]
    want = [quality.UNIT * math.log(t / p) if p else 0 for t, p in zip(trusted_share, share)]
    assert weights == pytest.approx(want, abs=1)
    rows = {r.doc_id: r for r in quality.rated(docs, weights).collect()}
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "kept")
    for i, want in enumerate(plain_rated(texts, weights)):
        row = rows[i if i != 5 else None]
        assert tuple(round(row[n], 9) if n == "ratio" else row[n] for n in names) == want, i
    empty = frame(ready, [])
    assert quality.ratio_weights(empty, trusted, "doc_id", "text", 10) == [0] * 10
    assert quality.rated(empty, [0] * 10).count() == 0


def test_classifier_learns_and_scores(ready):
    r = random.Random(2)
    word = lambda: "".join(r.choice(["th", "er", "in", "on", "an"]) for _ in range(r.randint(1, 4)))
    good = [" ".join(word() for _ in range(r.randint(5, 60))) for _ in range(300)]
    bad = [" ".join(word() + r.choice(["###", "$$$", "%%"]) for _ in range(r.randint(5, 60))) for _ in range(150)]
    bad += [" ".join([word()] * r.randint(20, 60)) for _ in range(150)]
    texts = [t for pair in zip(good, bad) for t in pair] + [None, "", "x" * 300_000]
    docs = frame(ready, texts)
    labels = ready.createDataFrame([(i, 1 - i % 2) for i in range(600) if i % 5 and i != 5] + [(None, 1), (1, None), (7, 0)],
                                   "doc_id long, quality int")
    model = classifier.fit(docs, labels)
    rows = classifier.score(docs, model, score="p").collect()
    assert len(rows) == len(texts) and all(0 <= r.p <= 1 for r in rows)
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 600 and r.doc_id % 5 == 0]
    assert np.mean([(r.p >= 0.5) == (r.doc_id % 2 == 0) for r in held]) > 0.95
    # the shares summed by word give what the averaged vectors give
    words = good[0].encode().split()
    found = [f for w in words for f in classifier.features(w)] + [classifier.AGAIN] * classifier.repeats(words)
    logits = model.layer @ model.vectors[found].mean(axis=0) + model.bias
    assert rows[0].p == pytest.approx(1 / (1 + math.exp(logits[0] - logits[1])), rel=1e-4)
    nothing = classifier.fit(docs, labels.limit(0))
    assert {r.p for r in classifier.score(docs, nothing, score="p").collect()} == {0.5}


def test_digests_of_queries(ready, tmp_path):
    from costwright.llm.queries import QUERIES

    texts = ["token = abcdefghijkl and 0123456789abcdef", None]
    frame(ready, texts).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in QUERIES["op8_secret_structures"](ready, str(tmp_path)).collect()}
    assert rows[0].spans == "assign:0:20,hex:25:41" and (rows[0].n_assign, rows[0].n_access, rows[0].n_hex) == (1, 0, 1)
    assert rows[0].base_sha256 == hashlib.sha256(rows[0].spans.encode()).hexdigest()
    assert rows[1].spans == "" and rows[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    ids = Tokenizer.from_file(BYTE_BPE).encode(texts[0], add_special_tokens=False).ids
    row = next(r for r in QUERIES["op6_trie_bpe"](ready, str(tmp_path)).collect() if r.doc_id == 0)
    assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert row.decoded_sha256 == hashlib.sha256(texts[0].encode()).hexdigest()
