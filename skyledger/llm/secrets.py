"""Secrets in texts, confirmed by their structure.

Three plain patterns give base spans. Everything else is reported only if it decodes and parses: armoured, base64 and hex candidates must hold a private
key whose nested lengths add up (DER) or whose length-prefixed fields do (OpenSSH), and dotted candidates must be signed or encrypted tokens with a
JSON header that names an algorithm and parts of the lengths that it makes.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: In the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "armour", "der", "openssh", "token")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")

# Candidates. A DER key begins with a SEQUENCE (30), an OpenSSH key and an armoured text with their marks, a JSON object with a brace, so
# their encodings begin with the characters named here.
ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,32}?)PRIVATE KEY-----((?:[^-]|-(?!----))*)-----END \1PRIVATE KEY-----")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:M[A-P]|b3BlbnNzaC1rZXktdjE|LS0tLS1CRUdJTi)[A-Za-z0-9+/_-]{30,}={0,2}")
HEXED = re.compile(r"(?<![0-9A-Za-z])(?:0x)?((?:30|6[fF]70656[eE]7373682[dD]|2[dD]2[dD]2[dD]2[dD]2[dD]424547494[eE])[0-9A-Fa-f]{60,})(?![0-9A-Za-z])")
DOTTED = re.compile(r"(?<![A-Za-z0-9_-])e[w-z0-9_-][A-Za-z0-9_-]{14,}\.[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*(?:\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)?(?![A-Za-z0-9_-])")

#: Bytes of a signature by algorithm; (least, most) where keys differ in size.
SIGNATURES = {
    "HS256": (32, 32), "HS384": (48, 48), "HS512": (64, 64), "ES256": (64, 64), "ES256K": (64, 64), "ES384": (96, 96), "ES512": (132, 132),
    "EdDSA": (64, 114), "RS256": (128, 1024), "RS384": (128, 1024), "RS512": (128, 1024), "PS256": (128, 1024), "PS384": (128, 1024), "PS512": (128, 1024),
    "none": (0, 0),
}
#: Bytes of (initial vector, tag) by content encryption.
ENCRYPTIONS = {"A128GCM": (12, 16), "A192GCM": (12, 16), "A256GCM": (12, 16), "A128CBC-HS256": (16, 16), "A192CBC-HS384": (16, 24), "A256CBC-HS512": (16, 32)}

INTEGER, OCTETS, OID, SEQUENCE = 0x02, 0x04, 0x06, 0x30


def _unbase(text: str) -> bytes | None:
    """The bytes of standard or URL-safe base64, padded or not; None if it is neither."""
    body = text.rstrip("=")
    if len(body) % 4 == 1 or (("+" in body or "/" in body) and ("-" in body or "_" in body)):
        return None
    try:
        return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, from, to) of the elements that fill data[at:end] exactly, by definite lengths; None if they do not."""
    out = []
    while at < end:
        if at + 2 > end:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            wide = size & 0x7F
            if not 1 <= wide <= 4 or at + wide > end:
                return None
            size = int.from_bytes(data[at : at + wide], "big")
            at += wide
        if at + size > end:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def private_key(data: bytes) -> bool:
    """DER of a private key: RSA, DSA or elliptic (their own forms), or PKCS#8, plain or encrypted; nothing may follow it."""
    whole = _elements(data, 0, len(data))
    if not whole or len(whole) != 1 or whole[0][0] != SEQUENCE:
        return False
    inner = _elements(data, *whole[0][1:])
    if not inner:
        return False
    tags = [t for t, _, _ in inner]
    number = data[inner[0][1] : inner[0][2]] if tags[0] == INTEGER else None
    if number == b"\0" and len(tags) in (6, 9) and set(tags) == {INTEGER}:
        return all(b > a for _, a, b in inner)
    if number == b"\1" and tags[1:2] == [OCTETS] and all(t in (0xA0, 0xA1) for t in tags[2:]) and inner[1][2] - inner[1][1] >= 16:
        return all(_elements(data, a, b) for _, a, b in inner[2:])
    if number in (b"\0", b"\1") and tags[1:3] == [SEQUENCE, OCTETS] and all(t in (0xA0, 0xA1, 0x81) for t in tags[3:]):
        named = _elements(data, *inner[1][1:])
        return bool(named) and named[0][0] == OID and inner[2][2] - inner[2][1] >= 16
    if tags == [SEQUENCE, OCTETS]:
        named = _elements(data, *inner[0][1:])
        size = inner[1][2] - inner[1][1]
        return bool(named) and named[0][0] == OID and len(named) == 2 and named[1][0] == SEQUENCE and size >= 32 and size % 8 == 0
    return False


def openssh_key(data: bytes) -> bool:
    """The version mark, then cipher, key derivation, its options, the number of keys, public keys and the private block, each by its length."""
    mark = b"openssh-key-v1\0"
    if not data.startswith(mark):
        return False
    at = len(mark)

    def field():
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size : at]

    head = [field() for _ in range(3)]
    if None in head or not head[0] or not head[1] or at + 4 > len(data):
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 16:
        return False
    public = [field() for _ in range(keys)]
    block = field()
    if None in public or not block or not all(public):
        return False
    plain = head[0] == b"none"
    # An open block begins with one check number twice; a closed one fills whole cipher blocks.
    return block[:4] == block[4:8] and len(block) > 8 if plain else len(block) % 8 == 0


def armoured(name: str, body: str) -> bool:
    """The body between the lines of an armour of this name."""
    lines = body.replace("\\n", "\n").replace("\\r", "").split("\n")
    heads = [x for x in lines if ":" in x]
    data = _unbase("".join("".join(x.split()) for x in lines if ":" not in x))
    if not data:
        return False
    if any(h.strip().startswith("DEK-Info:") for h in heads):
        vector = heads[-1].rpartition(",")[2].strip()
        return bool(re.fullmatch(r"(?:[0-9A-Fa-f]{2}){8,16}", vector)) and len(data) >= 32 and len(data) % 8 == 0
    return openssh_key(data) if name == "OPENSSH " else private_key(data)


def decoded_kind(data: bytes | None, depth: int = 0) -> str | None:
    """What decoded bytes are: der, openssh or armour (a text that holds an armoured key, or such a text encoded once more)."""
    if not data:
        return None
    if private_key(data):
        return "der"
    if openssh_key(data):
        return "openssh"
    if data.startswith(b"-----BEGIN"):
        m = ARMOUR.search(data.decode("latin-1"))
        return "armour" if m and armoured(m[1], m[2]) else None
    if depth < 2 and data.startswith(b"LS0tLS1CRUdJTi"):
        return decoded_kind(_unbase("".join(data.decode("latin-1").split())), depth + 1)
    return None


def signed_token(text: str) -> bool:
    """A signed token of three parts or an encrypted one of five, whose header says how."""
    parts = text.split(".")
    raw = [_unbase(p) if p else b"" for p in parts]
    if None in raw:
        return False
    try:
        header = json.loads(raw[0])
        if not isinstance(header, dict) or not isinstance(header.get("alg"), str):
            return False
        if len(parts) == 3:
            low, high = SIGNATURES.get(header["alg"], (1, 0))
            return low <= len(raw[2]) <= high and isinstance(json.loads(raw[1]), dict)
    except (ValueError, RecursionError):
        return False
    return (len(raw[2]), len(raw[4])) == ENCRYPTIONS.get(header.get("enc")) and len(raw[3]) > 0


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, order of the kind, end) of all spans, sorted; places count code points."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "-----BEGIN" in text:
        out += [(m.start(), 3, m.end()) for m in ARMOUR.finditer(text) if armoured(m[1], m[2])]
    for m in BASE64.finditer(text):
        kind = decoded_kind(_unbase(m[0]))
        if kind:
            out.append((m.start(), KINDS.index(kind), m.end()))
    for m in HEXED.finditer(text):
        kind = decoded_kind(bytes.fromhex(m[1])) if len(m[1]) % 2 == 0 else None
        if kind:
            out.append((m.start(1), KINDS.index(kind), m.end(1)))
    out += [(m.start(), 6, m.end()) for m in DOTTED.finditer(text) if signed_token(m[0])]
    return sorted(set(out))


def scan(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """docs with a column of spans: array of (kind, start, end) by start, then kind; places count code points, ends are exclusive.

    Null and empty texts have none. Texts are read whole and every row for itself, so repeated rows and ids repeat their result; other columns are
    carried along, but for one that is called like the spans, which gives way. A key that is broken over lines is found in its armour only; a
    candidate that does not decode or parse to its end is no finding.
    """
    docs = docs.drop(spans)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for batch in batches:
            texts = batch.column(text).cast(pa.string()).to_pylist()
            found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in find(t)] if t else [] for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(span))], [*batch.schema.names, spans])

    return docs.mapInArrow(run, f"{kinds}, `{spans}` array<struct<kind:string,start:bigint,end:bigint>>")


def digests(scanned: DataFrame, spans: str = "spans") -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans as text, and counts of confirmed keys and tokens."""
    count = lambda *kinds: F.size(F.filter(spans, lambda s: s["kind"].isin(*kinds))).cast("long")
    shown = lambda of: F.concat_ws(",", F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    base = F.filter(spans, lambda s: s["kind"].isin(*KINDS[:3]))
    return scanned.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col(spans)).alias("spans"),
        count(*KINDS[3:6]).alias("n_keys"), count("token").alias("n_tokens"),
    )


def masked(scanned: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Scanned documents whose spans are blackened: every code point within one becomes a star."""
    cut = F.aggregate(
        spans, F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda s, x: F.struct(
            F.concat(
                s["out"], F.substring(F.col(text), (s["at"] + 1).cast("int"), F.greatest(x["start"] - s["at"], F.lit(0)).cast("int")),
                F.repeat(F.lit("*"), F.greatest(x["end"] - F.greatest(x["start"], s["at"]), F.lit(0)).cast("int")),
            ).alias("out"), F.greatest(s["at"], x["end"]).alias("at"),
        ),
        lambda s: F.concat(s["out"], F.substring(F.col(text), (s["at"] + 1).cast("int"), F.length(text))),
    )
    return scanned.withColumn(text, F.when(F.size(spans) > 0, cut).otherwise(F.col(text)))
