"""Secrets in texts: patterns, and encoded candidates confirmed by their structure.

Three patterns report what they match. Longer runs of base64 or hex characters are decoded
and reported only if the bytes are what they claim to be:

``jwt``      three base64url parts, the first a JSON object that names an algorithm, the
             second a JSON object;
``der``      a private key: nested ASN.1 lengths that add up, and the members of an RSA, EC
             or wrapped key in their order; in base64 (PEM lines too) or in hex;
``openssh``  the magic words of an OpenSSH private key and nested lengths that fit;
``wrapped``  text under base64 or hex that holds a password assignment or an access key.

Spans count code points, the end is exclusive. Null counts as empty; a text without finds
gets zeros and empty lists.
"""

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subledger.llm.batches import with_column
from subledger.llm.text import documents

KINDS = ("assign", "access", "hex", "jwt", "der", "openssh", "wrapped")
# The patterns and least lengths of the contract.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20

DOTTED = re.compile(r"[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
ENCODED = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")
PEM = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----")
ANY_HEX = re.compile(r"(?:[0-9a-fA-F]{2}){12,}")
#: A run that needs decoding has both a digit and a letter, or is long; words are neither.
DIGIT = re.compile(r"[0-9]")
OPENSSH = b"openssh-key-v1\0"


def from_base64(text: str) -> bytes | None:
    """The bytes of base64 or base64url text, with or without padding."""
    text = re.sub(r"\s", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, first and last byte bound of the ASN.1 value at ``at``; none if it does not fit."""
    if at + 2 > end:
        return None
    tag, length, at = data[at], data[at + 1], at + 2
    if length >= 0x80:
        n = length & 0x7F
        if not 1 <= n <= 4 or at + n > end:
            return None
        length, at = int.from_bytes(data[at : at + n], "big"), at + n
    return (tag, at, at + length) if at + length <= end else None


def members(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The values that fill ``at`` to ``end`` without a gap."""
    found = []
    while at < end:
        one = tlv(data, at, end)
        if one is None or len(found) > 32:
            return None
        found.append(one)
        at = one[2]
    return found


def is_private_der(data: bytes) -> bool:
    top = tlv(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    inner = members(data, top[1], top[2])
    if not inner or inner[0][0] != 0x02 or inner[0][2] - inner[0][1] != 1:
        return False
    version, tags = data[inner[0][1]], [tag for tag, _, _ in inner]
    if version in (0, 1) and len(tags) >= 9 and set(tags[:9]) == {0x02}:
        return True  # RSA: version and eight numbers
    if version == 1 and len(tags) >= 2 and tags[1] == 0x04 and set(tags[2:]) <= {0xA0, 0xA1}:
        return inner[1][2] - inner[1][1] >= 20  # EC: version, the number, curve and point
    if version in (0, 1) and len(tags) >= 3 and tags[1:3] == [0x30, 0x04]:
        algorithm = members(data, inner[1][1], inner[1][2])
        return bool(algorithm) and algorithm[0][0] == 0x06  # wrapped: algorithm, then the key
    return False


def is_openssh(data: bytes) -> bool:
    """The magic words, then cipher, key derivation, its options and keys with fitting lengths."""
    if not data.startswith(OPENSSH):
        return False
    at = len(OPENSSH)
    for _ in range(3):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at + 4 <= len(data) and 1 <= int.from_bytes(data[at : at + 4], "big") <= 16


def json_object(text: str) -> dict | None:
    raw = from_base64(text)
    try:
        value = json.loads(raw) if raw and raw[:1] == b"{" else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def is_signed_token(text: str) -> bool:
    header, claims, _ = text.split(".")
    found = json_object(header)
    return found is not None and isinstance(found.get("alg"), str) and json_object(claims) is not None


def kind_of(data: bytes | None) -> str | None:
    """What decoded bytes are, if they are a secret."""
    if not data or len(data) < 12:
        return None
    if is_private_der(data):
        return "der"
    if is_openssh(data):
        return "openssh"
    if all(32 <= b < 127 or b in b"\t\r\n" for b in data):
        inner = data.decode("ascii")
        if any(span for kind, *span in matched(inner) if kind != "hex"):
            return "wrapped"
    return None


def matched(text: str) -> list[tuple[str, int, int]]:
    """Finds of the three patterns, by kind."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def confirmed(text: str) -> list[tuple[str, int, int]]:
    """Encoded candidates whose decoded structure is that of a secret."""
    found, taken = [], []
    if "PRIVATE KEY-----" in text:
        for m in PEM.finditer(text):
            if kind := kind_of(from_base64(m[2])):
                found.append((kind, *m.span()))
                taken.append(m.span())
    if "." in text:
        found += [("jwt", *m.span()) for m in DOTTED.finditer(text) if is_signed_token(m[0])]
    for m in ENCODED.finditer(text):
        start, end = m.span()
        if not DIGIT.search(m[0]) and len(m[0]) < 64 or any(a <= start < b for a, b in taken):
            continue
        kind = kind_of(from_base64(m[0]))
        if kind is None and ANY_HEX.fullmatch(m[0]):
            kind = kind_of(bytes.fromhex(m[0]))
        if kind:
            found.append((kind, start, end))
    return found


def listed(spans: list[tuple[str, int, int]]) -> str:
    ordered = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in ordered)


def scanned(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, the patterns' counts and spans (``base_spans``) and all spans (``spans``)."""

    def run(batches):
        for batch in batches:
            rows = []
            for own in batch.column(1).to_pylist():
                own = own or ""
                base = matched(own)
                counts = [sum(kind == k for k, _, _ in base) for kind in KINDS[:3]]
                rows.append((*counts, listed(base), listed(base + confirmed(own))))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["key", "n_assign", "n_access", "n_hex", "base_spans", "spans"],
            )

    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_assign long, n_access long, n_hex long, base_spans string, spans string"
    return df.select(df[key], df[text]).mapInArrow(run, schema).withColumnRenamed("key", key)


def redacted_text(text: str | None) -> str | None:
    """The text with every find replaced by its kind in angle brackets; overlapping ones as one."""
    spans = sorted((a, b, kind) for kind, a, b in (matched(text) + confirmed(text) if text else ()))
    if not spans:
        return text
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(df: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """All rows and columns of ``df`` with secrets taken out of the text, and its new length."""

    def make(columns: list[pa.Array]) -> pa.Array:
        return pa.array([redacted_text(t) for t in columns[0].to_pylist()], pa.string())

    out = with_column(df, [text], make, text, "string", replace=True)
    if n_chars not in df.columns:
        return out
    length = F.length(text).cast(df.schema[n_chars].dataType)
    return out.withColumn(n_chars, F.coalesce(length, F.col(n_chars)))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scanned(documents(spark, sf_dir, "doc_id", "text"))
    sums = F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", sums, "spans")
