"""Secret scans against a plain scanner, encoded keys and tokens, and things that only look like them."""

import base64
import hashlib
import json
import random
import re

import pytest

from lumenfit.llm import secrets
from lumenfit.llm.queries import QUERIES


def base_spans(text):
    """The three patterns as they are stated, match by match."""
    letters = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
    words = "|".join(map(letters, ["password", "passwd", "secret", "token", "api_?key"]))
    patterns = {
        "assign": f"({words})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+",
    }
    least = {"access": 18, "hex": 16}
    out = []
    for k, (kind, pattern) in enumerate(patterns.items()):
        for m in re.finditer(pattern, text or ""):
            if len(m[2]) >= 12 if kind == "assign" else len(m[0]) >= least[kind]:
                out.append((m.start(), k, kind, m.end()))
    return [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(out)]


def _same(rows, texts):
    assert len(rows) == len(texts)
    for r, text in zip(rows, texts):
        want = base_spans(text)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in want) for k in ("assign", "access", "hex"))
        listed = r.spans.split(",") if r.spans else []
        assert [s for s in listed if s.split(":")[0] in secrets.BASE] == want
        assert listed == [f"{k}:{s}:{e}" for s, k, e in secrets.spans(text or "")]


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"  # the smallest tables have no secret
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op13_secret_scans"](spark, sf_dir).collect()
    _same(rows, [docs[r.doc_id] for r in rows])
    assert sum(r.n_assign for r in rows) > 0 and sum(r.n_hex for r in rows) > 0


def test_odd_documents(spark, odd_docs, no_docs, tmp_path):
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        docs.coalesce(1).write.parquet(str(tmp_path / name / "documents.parquet"))
    rows = QUERIES["op13_secret_scans"](spark, str(tmp_path / "odd")).collect()
    texts = [r.text for r in spark.read.parquet(str(tmp_path / "odd" / "documents.parquet")).collect()]
    _same(rows, texts)
    assert QUERIES["op13_secret_scans"](spark, str(tmp_path / "none")).collect() == []


def test_patterns():
    r, parts = random.Random(4), ["password", "Token", "SECRET", "api_key", "apiKEY", "ſecret", "toKen", "=", ":", " ", '"', "'", "AKIA",
                                  "ABCDEFGH", "0123456789", "abcdef", "x", "é", "\U0001F600", "\n", "-", "/", "AKIAAKIA", "passwd"]
    for _ in range(3_000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        assert [f"{k}:{s}:{e}" for s, k, e in secrets.spans(text) if k in secrets.BASE] == base_spans(text)
    assert base_spans("secret: token: abcdefabcdefabcdef")[0].startswith("hex")  # the first match takes the second word


# -- encoded keys ---------------------------------------------------------------------------------------------------


def der(tag, *parts):
    raw = b"".join(parts)
    n = len(raw)
    size = bytes([n]) if n < 128 else bytes([0x80 + (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8)
    return bytes([tag]) + size + raw


def number(v):
    return der(2, v.to_bytes(v.bit_length() // 8 + 1))


def rsa(bits=512):
    r = random.Random(bits)
    p, q, d = (r.getrandbits(bits) | 1 << bits - 1 | 1 for _ in range(3))
    return der(0x30, *map(number, [0, p * q, 65537, d, p, q, d % p, d % q, 12345]))


def wrapped(key):
    return der(0x30, number(0), der(0x30, der(6, bytes.fromhex("2a864886f70d010101")), der(5)), der(4, key))


def elliptic():
    return der(0x30, number(1), der(4, bytes(range(32))), der(0xA0, der(6, bytes.fromhex("2a8648ce3d030107"))))


def edwards():
    return der(0x30, number(0), der(0x30, der(6, bytes.fromhex("2b6570"))), der(4, der(4, bytes(range(32)))))


def encrypted():
    scheme = der(0x30, der(6, bytes.fromhex("2a864886f70d01050d")), der(0x30, der(4, b"saltsalt"), number(2048)))
    return der(0x30, scheme, der(4, bytes(64)))


def public_key():
    return der(0x30, der(0x30, der(6, bytes.fromhex("2a864886f70d010101")), der(5)), der(3, b"\0" + rsa()[:200]))


def ssh(check=b"abcd"):
    field = lambda b: len(b).to_bytes(4) + b
    public = field(b"ssh-ed25519") + field(bytes(32))
    private = check + b"abcd" + field(b"ssh-ed25519") + field(bytes(32)) + field(bytes(64)) + field(b"me")
    private += bytes(range(1, 1 + -len(private) % 8))
    return b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4) + field(public) + field(private)


def b64(raw):
    return base64.b64encode(raw).decode()


def lines(text, width=64, end="\n"):
    return end.join(text[i : i + width] for i in range(0, len(text), width))


def token(head, body, signature):
    enc = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    return ".".join(enc(x if isinstance(x, bytes) else json.dumps(x).encode()) for x in (head, body, signature))


KEYS = {"rsa": rsa(), "long rsa": rsa(1024), "wrapped": wrapped(rsa()), "elliptic": elliptic(), "edwards": edwards(), "encrypted": encrypted()}


@pytest.mark.parametrize("name", list(KEYS))
def test_keys(name):
    raw = KEYS[name]
    for secret in (b64(raw), lines(b64(raw)), lines(b64(raw), 76, "\r\n"), raw.hex(), raw.hex().upper()):
        for before, after in (("", ""), ("é key: ", "\nWords follow here"), ("(", ") and more"), ("-----BEGIN X-----\n", "\n-----END X-----")):
            text = before + secret + after
            start = len(before)
            assert (start, "der", start + len(secret)) in secrets.spans(text), (before, after)
    for broken in (raw[:-1], raw[:-9], raw[1:], raw[:2] + b"\x99" * (len(raw) - 2)):
        assert not list(secrets.confirmed(f"x {b64(broken)} y {broken.hex()} z"))


def test_ssh_and_nested():
    text = lines(b64(ssh()), 70)
    assert list(secrets.confirmed(f"k:\n{text}\nend")) == [(3, "ssh", 3 + len(text))]
    assert not list(secrets.confirmed(b64(ssh(b"abce")))) and not list(secrets.confirmed(b64(ssh()[:-8])))
    armour = f"-----BEGIN EC PRIVATE KEY-----\n{lines(b64(elliptic()))}\n-----END EC PRIVATE KEY-----\n".encode()
    assert [k for _, k, _ in secrets.confirmed(f"data: {b64(armour)} ...")] == ["pem"]
    assert not list(secrets.confirmed(b64(armour.replace(b"M", b"N", 1))))


def test_what_only_looks_like_a_key():
    for raw in (public_key(), der(0x30, number(5), number(6)), der(0x30, der(0x30, der(6, b"abc")), der(4, b"short"))):
        assert not list(secrets.confirmed(f"{b64(raw)} {raw.hex()}"))
    for words in ("MAINTENANCE" * 9, "MIIEowIBAAKCAQEA" + "A" * 300, "30" + "0" * 400, "MA==", "LS0tLS1CRUdJTi" + "A" * 60):
        assert not list(secrets.confirmed(words))


def test_tokens():
    head, body = {"alg": "HS256", "typ": "JWT"}, {"sub": "1", "admin": True}
    good = token(head, body, bytes(32))
    assert list(secrets.confirmed(f"Bearer {good}, é")) == [(7, "jwt", 7 + len(good))]
    assert [k for _, k, _ in secrets.confirmed(token({"alg": "RS256"}, body, bytes(256)))] == ["jwt"]
    assert [k for _, k, _ in secrets.confirmed(token({"alg": "none"}, body, b""))] == ["jwt"]
    assert [k for _, k, _ in secrets.confirmed(token(b'{ "alg":"ES256"}', body, bytes(64)))] == ["jwt"]
    for bad in (token(head, body, bytes(31)), token({"typ": "JWT"}, body, bytes(32)), token({"alg": "XX"}, body, bytes(32)),
                token(head, b"[1]", bytes(32)), token({"alg": ["HS256"]}, body, bytes(32)), good[:-1] + "!", "x" + good, good + ".a"):
        assert not list(secrets.confirmed(bad)), bad


def test_order_and_long_texts():
    assert secrets.spans("") == []
    key = elliptic().hex()
    found = secrets.spans(f"token={key}")
    assert [k for _, k, _ in found] == ["assign", "hex", "der"] and found[1][0] == found[2][0] == 6
    far = "Wort " * 400_000 + "password=" + "z" * 50_000
    assert secrets.spans(far) == [(2_000_000, "assign", 2_050_009)]
