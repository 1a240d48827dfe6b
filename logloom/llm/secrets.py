"""Op 13. Secret scans with structural confirmation.

Three base patterns report what looks like a secret (assignments, access ids, hex runs). Beside them, base64 and hex candidates are decoded, and are reported
only if what they hold parses: private keys as nested DER (RSA, EC, DSA, Edwards curves, PKCS#8, encrypted PKCS#8) or as OpenSSH's counted strings, every
length used up exactly, and signed tokens whose header names an algorithm that the signature's length fits. A candidate may also hold a text that holds such a key or token.

One pass of `scan` over rows, no shuffle: a text is read whole by the task that has its row.
Defined results: a null text counts as empty and has no spans; repeated rows give a row each; null ids stay; a text of one word of any length is one candidate;
equal starts are ordered by kind; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, tune

# --- fixed values: the base patterns and how long a match must be ---------------------------------
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_VALUE, LEAST_ACCESS = 12, 18
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# --- end of fixed values -------------------------------------------------------------------------
BASE_KINDS = ("assign", "access", "hex")
#: Kinds in their order at equal starts.
KINDS = (*BASE_KINDS, "jwt", "key")

TOKEN = re.compile(r"(?<![A-Za-z0-9_-])ey[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*(?:\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)?")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]{1,16} ){0,4}PRIVATE KEY)-----")
RUN64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
RUN16 = re.compile(r"(?:[0-9a-f]{2}){32,}|(?:[0-9A-F]{2}){32,}")
PEM_NOISE = re.compile(r"\\[nrt]|\s+|[A-Za-z-]+: [^\n]*\n")
#: Bytes of a signature by algorithm: exact, or at least so many where keys differ in length.
SIGNATURE = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES256K": 64, "ES384": 96, "ES512": 132, "EdDSA": 64, "none": 0}
LEAST_RSA_SIGNATURE = 128
#: A candidate's text may hold a key or token, and that one no more than one further.
DEPTH = 2

SEQUENCE, INTEGER, OCTETS, OID = 0x30, 0x02, 0x04, 0x06
RSA_OID, EC_OID, DSA_OID = "1.2.840.113549.1.1.1", "1.2.840.10045.2.1", "1.2.840.10040.4.1"
CURVE_KEYS = {"1.3.101.110": ("x25519", 32), "1.3.101.111": ("x448", 56), "1.3.101.112": ("ed25519", 32), "1.3.101.113": ("ed448", 57)}
ENCRYPTION_OIDS = ("1.2.840.113549.1.5.", "1.2.840.113549.1.12.1.")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    detail: str | None


def elements(data: bytes) -> list[tuple[int, bytes]]:
    """(tag, content) of the DER elements that fill data exactly; raises ValueError if a length is not minimal or runs over."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            raise ValueError("cut header")
        tag, size = data[at], data[at + 1]
        at += 2
        if size >= 0x80:
            wide = size & 0x7F
            raw = data[at : at + wide]
            if not 1 <= wide <= 4 or len(raw) < wide or raw[0] == 0:
                raise ValueError("length")
            size, at = int.from_bytes(raw, "big"), at + wide
            if size < 0x80:
                raise ValueError("length not minimal")
        if at + size > len(data):
            raise ValueError("runs over")
        out.append((tag, data[at : at + size]))
        at += size
    return out


def dotted(raw: bytes) -> str:
    parts, value = [], 0
    for b in raw:
        value = value << 7 | b & 0x7F
        if b < 0x80:
            parts.append(value)
            value = 0
    first = min(parts[0] // 40, 2) if parts else 0
    return ".".join(map(str, [first, parts[0] - 40 * first, *parts[1:]])) if parts else ""


def _numbers(items: list[tuple[int, bytes]]) -> list[int]:
    if any(tag != INTEGER or not raw for tag, raw in items):
        raise ValueError("not a number")
    return [int.from_bytes(raw, "big", signed=True) for _, raw in items]


def der_key(data: bytes) -> str | None:
    """What private key the DER bytes hold, or None."""
    try:
        [(tag, body)] = elements(data)
        if tag != SEQUENCE:
            return None
        items = elements(body)
        tags = [t for t, _ in items]
        if len(items) == 9 and set(tags) == {INTEGER}:
            version, n, _, _, p, q, *_ = _numbers(items)
            return f"rsa:{n.bit_length()}" if version == 0 and p > 1 and q > 1 and n == p * q else None
        if len(items) == 6 and set(tags) == {INTEGER}:
            version, p, q, *_ = _numbers(items)
            return f"dsa:{p.bit_length()}" if version == 0 and q > 1 and (p - 1) % q == 0 else None
        if tags[:2] == [INTEGER, OCTETS] and items[0][1] == b"\x01" and set(tags[2:]) <= {0xA0, 0xA1}:
            for _, raw in items[2:]:
                elements(raw)
            return f"ec:{len(items[1][1]) * 8}" if 16 <= len(items[1][1]) <= 66 else None
        if tags[:3] == [INTEGER, SEQUENCE, OCTETS] and items[0][1] in (b"\x00", b"\x01"):
            return _wrapped(elements(items[1][1]), items[2][1])
        if tags == [SEQUENCE, OCTETS]:
            method = elements(items[0][1])
            named = method and method[0][0] == OID and dotted(method[0][1])
            return "encrypted" if named and named.startswith(ENCRYPTION_OIDS) and len(items[1][1]) >= 16 else None
    except ValueError:
        pass
    return None


def _wrapped(method: list[tuple[int, bytes]], key: bytes) -> str | None:
    """PKCS#8: the algorithm decides how the inner bytes must parse."""
    if not method or method[0][0] != OID:
        return None
    named = dotted(method[0][1])
    if named in (RSA_OID, EC_OID):
        inner = der_key(key)
        return inner if inner and inner.startswith("rsa" if named == RSA_OID else "ec") else None
    inner = elements(key)
    if named in CURVE_KEYS and len(inner) == 1 and inner[0][0] == OCTETS and len(inner[0][1]) == CURVE_KEYS[named][1]:
        return CURVE_KEYS[named][0]
    return "dsa" if named == DSA_OID and len(inner) == 1 and _numbers(inner)[0] > 0 else None


def openssh_key(data: bytes) -> str | None:
    """OpenSSH's own form: a mark, then counted strings that fill the rest."""
    mark = b"openssh-key-v1\x00"
    if not data.startswith(mark):
        return None
    at = len(mark)

    def string() -> bytes:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            raise ValueError("runs over")
        at += 4 + size
        return data[at - size : at]

    try:
        cipher, _, _ = string(), string(), string()
        keys = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if not 1 <= keys <= 16:
            return None
        for _ in range(keys):
            string()
        private = string()
    except ValueError:
        return None
    fine = at == len(data) and len(private) >= 8 and (cipher != b"none" or private[:4] == private[4:8])
    return "openssh" if fine else None


def decoded64(text: str) -> bytes | None:
    """Bytes of base64 in either alphabet, padded or not; None if no text of that length can be base64."""
    text = text.rstrip("=").translate({45: "+", 95: "/"})
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _json_object(part: str) -> dict | None:
    raw = decoded64(part)
    try:
        value = json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def signed_token(text: str) -> str | None:
    """The algorithm of a JSON web token, if header, payload and signature fit each other."""
    parts = text.split(".")
    head = _json_object(parts[0])
    alg = head.get("alg") if head else None
    if not isinstance(alg, str):
        return None
    if len(parts) == 5:
        return f"{alg}+{head['enc']}" if isinstance(head.get("enc"), str) and all(decoded64(p) is not None for p in parts[1:]) else None
    if len(parts) != 3 or _json_object(parts[1]) is None:
        return None
    signature = decoded64(parts[2])
    if signature is None:
        return None
    if alg in SIGNATURE:
        return alg if len(signature) == SIGNATURE[alg] else None
    return alg if re.fullmatch(r"[RP]S(256|384|512)", alg) and len(signature) >= LEAST_RSA_SIGNATURE else None


def held(data: bytes, depth: int) -> str | None:
    """What a decoded candidate holds: a key, or a text with a confirmed key or token."""
    found = der_key(data) if data[:1] == b"0" else openssh_key(data)
    if found or depth >= DEPTH:
        return found
    try:
        inner = structures(data.decode("utf-8"), depth + 1)
    except UnicodeDecodeError:
        return None
    return f"{inner[0].kind}({inner[0].detail})" if inner else None


def pem_keys(text: str) -> list[Span]:
    """PEM blocks whose body parses; a label that has no end further on is not looked for again."""
    found, at, endless = [], 0, set()
    while "PRIVATE KEY-----" in text and (m := PEM.search(text, at)):
        at = m.end()
        end = f"-----END {m.group(1)}-----"
        stop = -1 if end in endless else text.find(end, at)
        if stop < 0:
            endless.add(end)
            continue
        body = text[at:stop]
        data = decoded64(PEM_NOISE.sub("", body + "\n"))
        what = data and ("encrypted" if "ENCRYPTED" in body else der_key(data) or openssh_key(data))
        if what:
            at = stop + len(end)
            found.append(Span("key", m.start(), at, what))
    return found


def structures(text: str, depth: int = 0) -> list[Span]:
    """Confirmed spans of a text, none overlapping an earlier find: tokens, PEM blocks, bare base64 and hex."""
    found: list[Span] = []
    free = lambda m: all(m.end() <= s.start or s.end <= m.start() for s in found)
    if "ey" in text:
        found += [Span("jwt", *m.span(), alg) for m in TOKEN.finditer(text) if (alg := signed_token(m.group()))]
    found += pem_keys(text)
    for m in RUN64.finditer(text):
        data = decoded64(m.group()) if free(m) else None
        if data and (what := held(data, depth)):
            found.append(Span("key", *m.span(), what))
    for m in RUN16.finditer(text):
        if free(m) and (what := held(bytes.fromhex(m.group()), depth)):
            found.append(Span("key", *m.span(), what))
    return found


def base_spans(text: str) -> list[Span]:
    """The base patterns, leftmost and not overlapping by kind; what is too short is dropped after matching."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [Span("assign", *m.span(), None) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [Span("access", *m.span(), None) for m in ACCESS.finditer(text) if len(m.group()) >= LEAST_ACCESS]
    return found + [Span("hex", *m.span(), None) for m in HEX.finditer(text)]


def spans_of(text: str | None) -> list[Span]:
    if not text:
        return []
    return sorted({*base_spans(text), *structures(text)}, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def scan(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, spans: array of kind, start, end (code points, end exclusive), detail (null for base patterns)."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("detail", pa.string())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[s._asdict() for s in spans_of(text.as_py())] for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], ["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,detail:string>>")


def told(spans: list[dict]) -> str:
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)


def digests(found: DataFrame) -> DataFrame:
    """scan's rows -> counts by base kind, the digest of the base spans, and all spans as text."""
    kind = found.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).to_pylist()
            base = [[s for s in spans if s["kind"] in BASE_KINDS] for spans in rows]
            counts = [pa.array([sum(s["kind"] == k for s in spans) for spans in base], pa.int64()) for k in BASE_KINDS]
            sha = pa.array([hashlib.sha256(told(spans).encode()).hexdigest() for spans in base], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, sha, pa.array([told(s) for s in rows], pa.string())], ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])

    return found.mapInArrow(each, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return digests(scan(table(spark, sf_dir, "documents")))
