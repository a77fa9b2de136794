"""Secret scans by structural confirmation.

Three plain patterns (assigned values, access keys, hex runs) are always reported. Beyond
them a candidate run of base64 or hex digits is reported only when its structure confirms it:

* pem: an armoured key block whose body decodes and is a well-formed DER value or an OpenSSH key;
* der: base64 or hex that decodes to nested DER whose lengths fill the whole value exactly;
* openssh: base64 that decodes to the OpenSSH private or public key layout;
* jwt: three base64url parts whose first is a JSON header naming an algorithm and whose second is JSON.

A span is (kind, start, end) in code points, end exclusive.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "der", "openssh", "jwt")
_ORDER = {kind: i for i, kind in enumerate(KINDS)}

# The three patterns and least lengths of the base rule.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # a maximal run; shorter runs are dropped anyway
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_LEAST_VALUE, _LEAST_ACCESS = 12, 18

_MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*+)(?<=KEY)-----")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{32,}={0,2}")
#: Between lines of a wrapped value: line ends, real or escaped, with quotes, marks and prefixes.
_BREAK = re.compile(r"""(?:\\+[rn]|["'`,;>#*|\\\s]|(?<=["'`\s])(?:\+|//|--)(?=\s))++""")
_LINE_END = re.compile(r"\\+[rn]|\n")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
#: The same at the start and end of a line of armour.
_FRAMED = re.compile(r"""[\s"'`>#*|]*+(?://\s+|--\s+|\+\s+)?["'`]?([A-Za-z0-9+/_=-]*)""")
_JWT = re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
_HEX_ANY = re.compile(r"(?:[0-9a-fA-F]{2}){16,}")

#: DER nests no deeper than this in any key format; deeper values are taken as a leaf.
MAX_DEPTH = 16


def decoded(run: str) -> bytes | None:
    """Bytes of a base64 run in either alphabet, None if it is not base64."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _der_end(data: bytes, at: int, stop: int) -> tuple[int, int, int] | None:
    """(tag, start of content, end) of the DER value at a place, None if its length does not fit."""
    if at + 2 > stop:
        return None
    tag, length, body = data[at], data[at + 1], at + 2
    if length >= 0x80:
        size = length & 0x7F
        if not 1 <= size <= 4 or body + size > stop or data[body] == 0:
            return None
        length = int.from_bytes(data[body : body + size], "big")
        body += size
        if length < 0x80:
            return None
    return (tag, body, body + length) if body + length <= stop else None


def _nested(data: bytes, start: int, stop: int, depth: int) -> int:
    """Number of values when start..stop is filled by well-formed DER values, 0 if it is not."""
    count = 0
    while start < stop:
        found = _der_end(data, start, stop)
        if found is None:
            return 0
        tag, body, end = found
        if tag & 0x1F == 0x1F or tag == 0:
            return 0
        count += 1
        if tag & 0x20 and depth < MAX_DEPTH and end > body:
            inner = _nested(data, body, end, depth + 1)
            if not inner:
                return 0
            count += inner
        start = end
    return count


def is_der(data: bytes) -> bool:
    """A DER sequence of at least two values that fills the data exactly, lengths nested correctly."""
    found = _der_end(data, 0, len(data)) if len(data) >= 16 and data[0] == 0x30 else None
    return found is not None and found[2] == len(data) and _nested(data, found[1], found[2], 1) >= 2


def is_openssh(data: bytes) -> bool:
    """The OpenSSH private layout, or a public one whose length-prefixed fields fill the data."""
    if data.startswith(b"openssh-key-v1\0"):
        return True
    at, fields = 0, []
    while at + 4 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if size > len(data) - at - 4:
            return False
        fields.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return at == len(data) and len(fields) >= 2 and fields[0].startswith((b"ssh-", b"ecdsa-"))


def _json_object(part: str) -> dict | None:
    data = decoded(part)
    try:
        value = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def is_jwt(token: str) -> bool:
    """Header and payload are JSON objects and the header names its algorithm."""
    head, body, _ = token.split(".")
    header = _json_object(head)
    return header is not None and isinstance(header.get("alg"), str) and _json_object(body) is not None


def _base(text: str) -> Iterator[tuple[str, int, int]]:
    low = text.lower()
    if any(word in low for word in _ASSIGN_WORDS):
        for m in _ASSIGN.finditer(text):
            if len(m[2]) >= _LEAST_VALUE:
                yield "assign", m.start(), m.end()
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if len(m[0]) >= _LEAST_ACCESS:
                yield "access", m.start(), m.end()
    for m in _HEX.finditer(text):
        yield "hex", m.start(), m.end()


def _armoured(text: str) -> Iterator[tuple[str, int, int]]:
    """Blocks from a BEGIN to the END of its label, with no other BEGIN between: one pass over the marks."""
    begin = None
    for m in _MARK.finditer(text):
        if m[1] == "BEGIN":
            begin = m
        elif begin and begin[2] == m[2]:
            body = text[begin.end() : m.start()]
            if any(is_der(d) or is_openssh(d) or "Proc-Type:" in body for d in map(decoded, _bodies(body)) if d):
                yield "pem", begin.start(), m.end()
            begin = None


def _bodies(body: str) -> Iterator[str]:
    """The base64 of an armoured body: as it stands, then without escaped line ends and marks around its lines."""
    lines = [x for x in body.split("\n") if ":" not in x]  # headers of old formats
    yield "".join("".join(lines).split())
    lines = [x for x in _LINE_END.sub("\n", body.replace("\\/", "/")).split("\n") if ":" not in x]
    lines = [_FRAMED.match(x)[1] for x in lines]
    lines = [x for x in lines if re.search("[A-Za-z0-9]", x)]
    yield "".join(lines)
    mark = re.match("[+/-]*", lines[0])[0] if lines else ""  # no key begins with these
    if mark:
        yield "".join(x.removeprefix(mark) for x in lines)


def _wrapped(text: str) -> Iterator[tuple[str, int, int]]:
    """Values over several lines without armour; the lines are of one width, the last may be shorter."""
    reach = 0
    for m in _RUN.finditer(text):
        if m.start() < reach or not m[0].startswith(("M", "b3BlbnNzaC", "AAAA")):
            continue
        if m[0][0] == "A" and not (decoded(m[0][:12]) or b"")[4:].startswith((b"ssh-", b"ecdsa")):
            continue
        need = len(text)
        if m[0][0] == "M":  # the length of a DER value tells where it ends
            head = decoded(m[0][:8]) or b""
            size = head[1] & 0x7F if len(head) > 1 and head[1] >= 0x80 else 0
            if head[:1] != b"0" or size > 4 or len(head) < 2 + size:
                continue
            total = 2 + size + (int.from_bytes(head[2 : 2 + size], "big") if size else head[1])
            need = -(-total * 4 // 3)
        lines, length, end = [m[0]], len(m[0]), m.end()
        while length < need and len(lines[-1]) == len(m[0]):
            gap = _BREAK.match(text, end)
            line = gap and _LINE_END.search(gap[0]) and _LINE.match(text, gap.end())
            if not line or len(line[0]) > len(m[0]):
                break
            lines.append(line[0])
            length, end = length + len(line[0].rstrip("=")), line.end()
        data = decoded("".join(lines)) if len(lines) > 1 else None
        if data and (is_der(data) or is_openssh(data)):
            yield "der" if is_der(data) else "openssh", m.start(), end
            reach = end


def _confirmed(text: str) -> Iterator[tuple[str, int, int]]:
    if "-----BEGIN " in text:
        yield from _armoured(text)
    if "eyJ" in text:
        for m in _JWT.finditer(text):
            if is_jwt(m[0]):
                yield "jwt", m.start(), m.end()
    yield from _wrapped(text)
    for m in _RUN.finditer(text):
        data = decoded(m[0])
        if data is None:
            continue
        if is_der(data):
            yield "der", m.start(), m.end()
        elif is_openssh(data):
            yield "openssh", m.start(), m.end()
    for m in _HEX_ANY.finditer(text):
        if is_der(bytes.fromhex(m[0])):
            yield "der", m.start(), m.end()


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then kind in the order of KINDS; null or empty: none."""
    if not text:
        return []
    return sorted({*_base(text), *_confirmed(text)}, key=lambda s: (s[1], _ORDER[s[0]], s[2]))


def redact(text: str | None, placeholder: str = "[SECRET]") -> str | None:
    """The text with each maximal stretch of overlapping spans replaced."""
    spans = find_secrets(text)
    if not spans:
        return text
    parts, at = [], 0
    reach = 0
    for _, start, end in spans:
        if start >= reach:
            parts += [text[at:start], placeholder]
        reach = max(reach, end)
        at = reach
    return "".join([*parts, text[at:]])


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_secrets(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of every row, with `secrets`: its spans as structs of kind, start, end.

    Rows stay one to one, repeated rows included; other columns are not read. A null or
    empty text has no spans. One pass over the rows, no shuffle.
    """
    chosen = docs.select(*keep, docs[text].alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [
                [{"kind": k, "start": a, "end": b} for k, a, b in find_secrets(t)]
                for t in batch.column(len(keep)).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(spans, _SPAN)], names=[*keep, "secrets"]
            )

    return chosen.mapInArrow(scan, f"{schema}, secrets array<struct<kind:string,start:bigint,end:bigint>>")


def redact_secrets(docs: DataFrame, text: str = "text", placeholder: str = "[SECRET]") -> DataFrame:
    """All columns and rows of docs with the secrets in their text replaced. Null stays null."""
    names = docs.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text)
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([redact(t, placeholder) for t in columns[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(scan, docs.schema)
