"""Secrets in texts: patterns, and candidates confirmed by decoding them and parsing what they hold.

Three patterns are reported wherever they match: assignments of a password or the like, access key ids, and long runs of
hexadecimal digits. On top of that, runs of base64 or hexadecimal text that begin as an encoded key or token would are
decoded and reported only if their structure holds to the last byte:

* ``jwt``: header and payload are JSON objects, the header names a known algorithm, the signature has that algorithm's size;
* ``der``: a private key, alone (RSA or elliptic curve) or wrapped (plain or encrypted), whose nested lengths add up;
* ``ssh``: an OpenSSH private key, whose length-prefixed fields fill it exactly;
* ``pem``: encoded text with a private key between its begin and end lines, itself confirmed as one of the two before.

Public keys, certificates, truncated keys and other data with such beginnings are not reported.

Defined cases: a null text counts as empty; texts of any length are searched whole; spans are half-open, in code points,
ordered by start, then kind in the order ``KINDS``, then end; spans of different kinds may overlap; a document without
findings has zero counts and empty lists; repeated rows give repeated rows; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfit.llm.common import documents, ship_code
from lumenfit.llm.registry import query

KINDS = ("assign", "access", "hex", "jwt", "der", "ssh", "pem")
BASE = KINDS[:3]
MIN_ASSIGNED = 12  # characters of an assigned value

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
# Whole runs of 18 and 16 characters or more: a run's leftmost match takes all of it, so shorter ones can be passed over.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

# How keys and tokens begin when encoded. An opening brace with a quote or white space; a DER sequence; the
# name that an OpenSSH key starts with; five dashes and BEGIN.
_TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])e[wy][A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*(?![A-Za-z0-9_.-])")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/])(?:M[A-P]|b3BlbnNzaC1rZXktdjE|LS0tLS1CRUdJTi)[A-Za-z0-9+/]{14,}(?:\r?\n[A-Za-z0-9+/]+)*={0,2}")
_HEXED = re.compile(
    r"(?<![0-9A-Fa-f])(?:30|6[Ff]70656[Ee]7373682[Dd]6[Bb]65792[Dd]7631|2[Dd]2[Dd]2[Dd]2[Dd]2[Dd]424547494[Ee])[0-9A-Fa-f]{30,}"
)
_PEM = re.compile(rb"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----")

# Signature sizes in bytes of the algorithms of signed tokens; RSA signatures are as long as the key, 128 bytes at least.
SIGNATURES = {
    "none": {0}, "HS256": {32}, "HS384": {48}, "HS512": {64}, "ES256": {64}, "ES384": {96}, "ES512": {132}, "ES256K": {64},
    "EdDSA": {64, 114}, "RS256": None, "RS384": None, "RS512": None, "PS256": None, "PS384": None, "PS512": None,
}


# -- structures -----------------------------------------------------------------------------------------------------


def der_items(raw: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents of DER values that fill ``raw``, or None. Lengths have their shortest form."""
    out, at = [], 0
    while at < len(raw):
        if at + 2 > len(raw):
            return None
        tag, size, at = raw[at], raw[at + 1], at + 2
        if size >= 0x80:
            wide = size - 0x80
            if not 1 <= wide <= 4 or at + wide > len(raw):
                return None
            size, at = int.from_bytes(raw[at : at + wide]), at + wide
            if size < 0x80 or size >> 8 * (wide - 1) == 0:
                return None
        if at + size > len(raw):
            return None
        out.append((tag, raw[at : at + size]))
        at += size
    return out


INTEGER, OCTETS, OID, SEQUENCE = 0x02, 0x04, 0x06, 0x30


def _algorithm(raw: bytes) -> bool:
    """An algorithm identifier: an object identifier and its parameters."""
    items = der_items(raw)
    return bool(items) and items[0][0] == OID and len(items[0][1]) >= 3 and len(items) <= 2


def is_der_key(raw: bytes) -> bool:
    """Whether ``raw`` is a DER private key."""
    outer = der_items(raw)
    if outer is None or len(outer) != 1 or outer[0][0] != SEQUENCE:
        return False
    items = der_items(outer[0][1])
    if not items:
        return False
    tags, first = [t for t, _ in items], items[0][1]
    if tags[:9] == [INTEGER] * 9 and first in (b"\0", b"\1"):  # RSA: version, modulus, exponents, primes, ...
        n, d, p, q = (int.from_bytes(items[k][1]) for k in (1, 3, 4, 5))
        return n > 1 and d > 1 and (first == b"\1" or p * q == n)
    if tags[:2] == [INTEGER, OCTETS] and first == b"\1":  # elliptic curve
        return 16 <= len(items[1][1]) <= 66 and all(t in (0xA0, 0xA1) for t in tags[2:])
    if tags[:3] == [INTEGER, SEQUENCE, OCTETS] and first in (b"\0", b"\1"):  # wrapped
        return _algorithm(items[1][1]) and len(items[2][1]) >= 16 and all(t in (0xA0, 0x81, 0xA1) for t in tags[3:])
    if tags == [SEQUENCE, OCTETS]:  # wrapped and encrypted: the algorithm has parameters, the content is blocks
        algorithm = der_items(items[0][1])
        return _algorithm(items[0][1]) and len(algorithm) == 2 and algorithm[1][0] == SEQUENCE and len(items[1][1]) >= 16
    return False


SSH_NAME = b"openssh-key-v1\0"


def _fields(raw: bytes, at: int, count: int) -> tuple[list[bytes], int] | None:
    """``count`` strings, each after its size in four bytes."""
    out = []
    for _ in range(count):
        size = int.from_bytes(raw[at : at + 4])
        if at + 4 + size > len(raw):
            return None
        out.append(raw[at + 4 : at + 4 + size])
        at += 4 + size
    return out, at


def is_ssh_key(raw: bytes) -> bool:
    """Whether ``raw`` is an OpenSSH private key: cipher, derivation, its options, public keys, private part."""
    if not raw.startswith(SSH_NAME):
        return False
    head = _fields(raw, len(SSH_NAME), 3)
    if head is None:
        return False
    (cipher, derivation, _), at = head
    count = int.from_bytes(raw[at : at + 4])
    if not 1 <= count <= 64:
        return False
    rest = _fields(raw, at + 4, count + 1)
    if rest is None or rest[1] != len(raw):
        return False
    *public, private = rest[0]
    named = all((f := _fields(key, 0, 1)) is not None and f[0][0].isascii() and f[0][0] for key in public)
    plain = cipher == b"none"
    # An open private part starts with a number of four bytes, twice; encrypted ones are whole blocks.
    sound = len(private) >= 8 and len(private) % 8 == 0 and (not plain or private[:4] == private[4:8])
    return named and plain == (derivation == b"none") and sound


def key_kind(raw: bytes) -> str | None:
    """``der``, ``ssh`` or ``pem`` if the bytes are a private key, else None."""
    if is_der_key(raw):
        return "der"
    if is_ssh_key(raw):
        return "ssh"
    for found in _PEM.finditer(raw):
        inner = _unbase64("".join(found[2].decode("ascii").split()))
        if inner is not None and (is_der_key(inner) or is_ssh_key(inner)):
            return "pem"
    return None


def _unbase64(text: str, url: bool = False) -> bytes | None:
    """The bytes of base64 text, padded or not, or None."""
    body = text.rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def _object(text: str) -> dict | None:
    raw = _unbase64(text, url=True)
    try:
        found = json.loads(raw) if raw is not None else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def is_signed_token(text: str) -> bool:
    """Whether header, payload and signature of a dotted token belong together."""
    header, payload, signature = text.split(".")
    head = _object(header)
    algorithm = head.get("alg") if head else None
    if not isinstance(algorithm, str) or algorithm not in SIGNATURES or _object(payload) is None:
        return False
    raw, sizes = _unbase64(signature, url=True), SIGNATURES[algorithm]
    return raw is not None and (len(raw) in sizes if sizes is not None else len(raw) >= 128)


# -- spans ----------------------------------------------------------------------------------------------------------


def confirmed(text: str) -> Iterator[tuple[int, str, int]]:
    """``start, kind, end`` of candidates that decode to a key or token."""
    for found in _TOKEN.finditer(text):
        if is_signed_token(found[0]):
            yield found.start(), "jwt", found.end()
    for found in _BASE64.finditer(text):
        raw = _decoded(found[0])
        size = extent(raw)
        end = _end_of(found[0], size) if size else None
        if end and (kind := key_kind(raw[:size])):
            yield found.start(), kind, found.start() + end
    for found in _HEXED.finditer(text):
        if len(found[0]) % 2 == 0 and (kind := key_kind(bytes.fromhex(found[0]))):
            yield found.start(), kind, found.end()


def _decoded(run: str) -> bytes:
    """The bytes of a run of base64 lines; a rest of less than a byte is left out."""
    body = run.translate({10: None, 13: None}).rstrip("=")
    body = body[: len(body) - 1] if len(body) % 4 == 1 else body
    return base64.b64decode(body + "=" * (-len(body) % 4))


def extent(raw: bytes) -> int | None:
    """How many bytes a key takes that ``raw`` begins with, by the sizes it states; None if none can."""
    if raw[:1] == b"\x30" and len(raw) > 1:
        wide = raw[1] - 0x80
        size = 2 + raw[1] if wide < 0 else 2 + wide + int.from_bytes(raw[2 : 2 + wide]) if 1 <= wide <= 4 else 0
    elif raw.startswith(SSH_NAME):
        head = _fields(raw, len(SSH_NAME), 3)
        count = int.from_bytes(raw[head[1] : head[1] + 4]) if head else 0
        rest = _fields(raw, head[1] + 4, count + 1) if 1 <= count <= 64 else None
        size = rest[1] if rest else 0
    else:
        size = max((m.end() for m in _PEM.finditer(raw)), default=0)
        size += len(raw[size:]) - len(raw[size:].lstrip()) if size else 0
    return size if 0 < size <= len(raw) else None


def _end_of(run: str, size: int) -> int | None:
    """Where the encoding of the first ``size`` bytes of a run ends, its padding included, if a line or the run ends there."""
    need, at = -(-size * 4 // 3), 0
    for line in run.split("\n"):
        body = line.rstrip("\r")
        letters = len(body.rstrip("="))
        if need <= letters:
            return at + len(body) if need == letters else None
        need, at = need - letters, at + len(line) + 1
    return None


def spans(text: str) -> list[tuple[int, str, int]]:
    """All ``start, kind, end``, in order."""
    out = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= MIN_ASSIGNED]
    out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    out += confirmed(text)
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans`` of every row, ``spans`` an array of ``start, kind, end``; one pass without a shuffle."""
    ship_code(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    item = pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"start": s, "kind": k, "end": e} for s, k, e in spans(t.as_py() or "")] for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.list_(item))], ["doc_id", "spans"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, spans array<struct<start:bigint,kind:string,end:bigint>>")


@query("op13_secret_scans")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir))

    def listed(which):
        return F.array_join(F.transform(which, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id", *map(count, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )
