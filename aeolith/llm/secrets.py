"""Secret scan with structural confirmation.

Cheap patterns propose candidates; those of the method are reported only if their bytes
parse: base64 (also wrapped over lines, also after a separator) and hex runs (either case) are
decoded and read as DER.  Nested lengths must fill the whole value, and its fields must be
those of a private key: RSA (PKCS#1), DSA, elliptic curve (SEC1), PKCS#8, or an encrypted
PKCS#8; or it is an OpenSSH key (length-prefixed fields).  Public keys and certificates are
no secrets.  PEM blocks need a private key's label and content likewise.  Signed tokens need
a header and a body that are JSON objects, the header with an algorithm, and a signature
(or the algorithm "none").  Base findings (assignments, access keys, long hex runs) are
reported by pattern alone.

Spans are in code points, end exclusive.  Null and empty texts have none.  Texts are
scanned whole, however long, in time that follows their length; kinds may overlap each
other, never themselves.  Repeated rows get the same spans each; an empty table gives no
rows.  Other columns stay, but for one that has the name of the result, which is replaced.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeolith.llm.common import text_udf

#: Base patterns, the least lengths, and the kinds in their order.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE, LEAST_ACCESS = 8, 16
#: Bytes of the largest key that base64 without a frame is decoded for (an RSA key of 16,384 bits has some 10,000).
MOST_KEY = 20_000
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "jwt", "pem", "der", "openssh")

_NEEDLES = ("passw", "secret", "token", "api_key", "apikey")
#: How the base64 of a JSON object can begin.
_JSON_STARTS = ("eyJ", "eyA", "ewo", "ewk", "ew0")
_JWT = re.compile(r"(?<![A-Za-z0-9_.-])(ey[JA]|ew[ok0])[A-Za-z0-9_-]*\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
#: Runs of base64, also over line ends, and runs of hex.
_RUN = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+={0,2})*")
_HEX_RUN = re.compile(r"[0-9A-Fa-f]{64,}")
#: Where a key can begin in a run: at its start or after a sign that isn't a letter or digit.
_KEY_START = re.compile(r"(?<![A-Za-z0-9])(?:M[A-P]|b3BlbnNzaC1rZXktdjEA)")
_SSH_MAGIC = b"openssh-key-v1\0"


def _unbase64(s: str) -> bytes | None:
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _der_item(b: bytes, at: int, stop: int) -> tuple[int, int, int] | None:
    """(tag, where the value begins, where it ends), or None if it doesn't fit before ``stop``."""
    if at + 2 > stop:
        return None
    tag, n, at = b[at], b[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > stop:
            return None
        n, at = int.from_bytes(b[at : at + k]), at + k
        if n < 0x80:
            return None  # not the shortest form
    return (tag, at, at + n) if at + n <= stop else None


_INT, _BITS, _OCTETS, _OID, _SEQ = 0x02, 0x03, 0x04, 0x06, 0x30


def _fields(b: bytes, at: int, stop: int) -> list[tuple[int, int, int]] | None:
    """The values that fill ``b[at:stop]``, or None if they don't."""
    out = []
    while at < stop:
        item = _der_item(b, at, stop)
        if not item:
            return None
        out.append(item)
        at = item[2]
    return out


def _sequence(b: bytes) -> list[tuple[int, int, int]] | None:
    """The fields of a sequence that is all of ``b``."""
    top = _der_item(b, 0, len(b))
    return _fields(b, top[1], top[2]) if top and top[0] == _SEQ and top[2] == len(b) else None


def private_key(b: bytes) -> str | None:
    """Which private key's structure ``b`` has, if any."""
    f = _sequence(b)
    if not f or len(f) < 2:
        return None
    tags = [t for t, *_ in f]
    value = lambda k: int.from_bytes(b[f[k][1] : f[k][2]])
    size = lambda k: f[k][2] - f[k][1]
    if tags[0] == _SEQ and tags[1:] == [_OCTETS]:
        inner = _fields(b, f[0][1], f[0][2])
        # PKCS#5 and PKCS#12 algorithms
        if inner and inner[0][0] == _OID and b[inner[0][1] : inner[0][2]].startswith((b"\x2a\x86\x48\x86\xf7\x0d\x01\x05", b"\x2a\x86\x48\x86\xf7\x0d\x01\x0c")) and size(1) >= 16:
            return "encrypted"
        return None
    if tags[0] != _INT or size(0) != 1 or value(0) > 1:
        return None
    if all(t == _INT and e > a for t, a, e in f):
        # modulus = p * q; or DSA's p, q, g, y, x
        if len(f) == 9 and size(1) >= 32 and value(1) == value(4) * value(5):
            return "rsa"
        return "dsa" if len(f) == 6 and size(1) >= 64 and (value(1) - 1) % max(1, value(2)) == 0 else None
    if tags[1] == _OCTETS and value(0) == 1 and size(1) in (20, 24, 28, 32, 48, 66) and all(t in (0xA0, 0xA1) for t in tags[2:]):
        return "ec"
    if len(f) >= 3 and tags[1:3] == [_SEQ, _OCTETS] and size(2) >= 16 and all(t in (0xA0, 0xA1, 0x81) for t in tags[3:]):
        inner = _fields(b, f[1][1], f[1][2])
        held = _der_item(b, f[2][1], f[2][2])
        if inner and inner[0][0] == _OID and inner[0][2] > inner[0][1] and held and held[0] in (_SEQ, _OCTETS, _INT) and held[2] == f[2][2]:
            return "pkcs8"
    return None


def is_der(b: bytes) -> bool:
    return private_key(b) is not None


def is_openssh(b: bytes) -> bool:
    if not b.startswith(_SSH_MAGIC):
        return False
    at = len(_SSH_MAGIC)
    for _ in range(3):  # cipher, key derivation, its options
        n = int.from_bytes(b[at : at + 4])
        at += 4 + n
        if at + 4 > len(b):
            return False
    keys, at = int.from_bytes(b[at : at + 4]), at + 4
    for _ in range(keys + 1):  # public keys, then the private part
        if at + 4 > len(b):
            return False
        at += 4 + int.from_bytes(b[at : at + 4])
    return keys > 0 and at <= len(b)


def _key_kind(b: bytes | None) -> str | None:
    if not b:
        return None
    return "openssh" if is_openssh(b) else "der" if is_der(b) else None


def _keys_in(run: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the keys that a run of base64 holds, by the length that each states."""
    out, last = [], 0
    places = None
    for m in _KEY_START.finditer(run):
        if m.start() < last:
            continue
        if places is None:
            places = [i for i, c in enumerate(run) if c not in " \t\r\n="]
            signs = "".join([run[i] for i in places]).replace("-", "+").replace("_", "/")
        at = bisect.bisect_left(places, m.start())
        if m[0][0] == "b":
            stop = len(signs)
        else:
            head = base64.b64decode(signs[at : at + 16].ljust(16, "A"))
            n, more = head[1], 0
            if n & 0x80:
                more = n & 0x7F
                if not 1 <= more <= 4:
                    continue
                n = int.from_bytes(head[2 : 2 + more])
            stop = at + -(-(2 + more + n) * 4 // 3)
            first = head[2 + more : 5 + more]  # a version, or an algorithm's sequence
            if not 16 <= n <= MOST_KEY or stop > len(signs) or first not in (b"\x02\x01\x00", b"\x02\x01\x01") and first[0] != _SEQ:
                continue
        b = _unbase64(signs[at:stop])
        if kind := _key_kind(b):
            end = places[stop - 1] + 1
            while end < len(run) and run[end] == "=":
                end += 1
            out.append((kind, m.start(), end))
            last = end
    return out


def _json_object(s: str) -> dict | None:
    b = _unbase64(s)
    try:
        x = json.loads(b) if b else None
    except (ValueError, RecursionError):
        return None
    return x if isinstance(x, dict) else None


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind in the order of ``KINDS``."""
    if not text:
        return []
    out: list[tuple[str, int, int]] = []
    low = text.lower()
    if any(x in low for x in _NEEDLES):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    if any(x in text for x in _JSON_STARTS):
        for m in _JWT.finditer(text):
            head, body, sign = m[0].split(".", 2)
            h = _json_object(head)
            if h is not None and isinstance(h.get("alg"), str) and _json_object(body) is not None and (_unbase64(sign) or h["alg"].lower() == "none"):
                out.append(("jwt", *m.span()))
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            stop = text.find("-----", m.end())
            close = f"-----END {m[1]}-----"
            if stop < 0 or not text.startswith(close, stop):
                continue
            lines = text[m.end() : stop].replace("\\r", "").replace("\\n", "\n").splitlines()
            b = _unbase64("".join([x.strip() for x in lines if ":" not in x]))
            if _key_kind(b) or b and any("ENCRYPTED" in x for x in lines):
                out.append(("pem", m.start(), stop + len(close)))
    for m in _RUN.finditer(text):
        out += [(kind, m.start() + a, m.start() + b) for kind, a, b in _keys_in(m[0])]
    for m in _HEX_RUN.finditer(text):
        run = m[0]
        if len(run) % 2 == 0 and run[:2] in ("30", "6f", "6F") and (kind := _key_kind(bytes.fromhex(run))):
            out.append((kind, *m.span()))
    if len(out) > 1:
        out.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    return out


def _kernel():
    def work(texts: list[str]) -> dict[str, list]:
        return {"spans": [[{"kind": k, "start": a, "end": b} for k, a, b in find(t)] for t in texts]}

    return work


_FIELDS = {"spans": pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))}


def scan(docs: DataFrame, text_col: str = "text", to: str = "secrets") -> DataFrame:
    """``docs`` with a column ``to`` (replaced if there is one): an array of (kind, start, end)."""
    udf = text_udf(_kernel, _FIELDS, "struct<spans:array<struct<kind:string,start:bigint,end:bigint>>>")
    return docs.withColumn(to, udf(F.col(text_col))["spans"])


def spelled(spans):
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def _masked(text: str | None, mask: str) -> str | None:
    out, at = [], 0
    found = find(text)
    if not found:
        return text
    for kind, a, b in found:
        if a >= at:
            out.append(text[at:a])
            out.append(mask.format(kind=kind))
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[{kind}]") -> DataFrame:
    """``docs`` with each span (overlapping ones together) replaced in their texts; the rest stays."""

    def kernel():
        return lambda texts: {"text": [_masked(t, mask) for t in texts]}

    udf = text_udf(kernel, {"text": pa.string()}, "struct<text:string>")
    text = F.col(text_col)
    return docs.withColumn(text_col, F.when(text.isNotNull(), udf(text)["text"]))
