"""Secret scans: plain patterns, and encodings that are reported once their structure is confirmed.

Three plain kinds, leftmost and not overlapping within a kind; a match that is too short is dropped,
and what it covered isn't searched again:

* ``assign``: a word such as password, then ``:`` or ``=``, then a value of 6 characters or more;
* ``access``: an access key of 20 characters or more;
* ``hex``: a lower-case hexadecimal run of 24 characters or more.

Four kinds that count only if their bytes have the structure that they claim:

* ``jwt``: three dotted base64url parts, the first of them a JSON object with ``alg``, the second JSON,
  the third as long as that algorithm's signatures are;
* ``openssh``: base64 or hex of the private key container, whose length-prefixed strings fit one another;
* ``der``: base64 or hex of nested ASN.1 values whose lengths add up and that hold a version, the number
  of integers and their sizes, or the OID and octets, that the standard key encodings have;
* ``pem``: a private key armour whose body decodes to ``der`` or ``openssh``, or that names its cipher in
  its header and has a body of whole blocks.

Base64 may be of either alphabet, and wrapped, by line breaks or by their escapes in strings (a
backslash and n or r); hex may have colons between its bytes. Where a key ends is taken from its own
lengths, so what follows it on the next line does no harm, and only the heads of its values are decoded: a
text takes time in proportion to its length, whatever is in it. Tokens without a signature (``alg`` none) hold no secret and aren't reported.

Spans are in code points, the end exclusive. Rows are scanned one by one; nothing is shuffled.

Defined cases: a null or empty text has no spans; very long texts are scanned whole; repeated rows
have the same spans; columns other than the text are passed on and never read.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: In the order in which kinds that start at one place are listed.
KINDS = ("assign", "access", "hex", "jwt", "openssh", "der", "pem")
FINDINGS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))

# The patterns of the plain kinds. Letters of the first match in either case, in ASCII only.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Base64 of a brace and what may follow it in JSON, a quotation mark or white space, begins with ey or ew.
JWT = re.compile(r"(?<![A-Za-z0-9_-])(e[wy][A-Za-z0-9_-]+)\.(e[wy][A-Za-z0-9_-]+|e30)\.([A-Za-z0-9_-]+)")
#: Where base64 of a SEQUENCE (any length: its first byte is 0x30, its second at most 0x84) or of the container's magic can start.
START = re.compile(r"(?:(?<![A-Za-z0-9])|(?<=\\[rnt]))(?:M[A-I]|b3Bl)(?=[A-Za-z0-9+/_-])")
#: Runs of base64, of the two alphabets.
RUNS = (re.compile(r"[A-Za-z0-9+/]+"), re.compile(r"[A-Za-z0-9_-]+"))
WRAP = re.compile(r"(?:[\x20\t]*(?:\\+[rn]|[\r\n]))+[\x20\t]*|\\+(?=/)")
LEAST_BASE64 = 38
MAGIC = b"openssh-key-v1\0"
HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])(?:30|6[Ff]70656[Ee])(?:[0-9A-Fa-f]{2}){24,}(?![0-9A-Fa-f])")
#: Bytes in hex with a colon between them, over lines too.
COLON_HEX = re.compile(r"(?<![0-9A-Fa-f:])(?:30|6[Ff])(?::\s*[0-9A-Fa-f]{2}){24,}")
#: The two ends of an armour. Neither header nor body can hold one, so an armour lies between one and the next.
MARK = re.compile(r"-----(BEGIN|END) ([A-Z ]*PRIVATE KEY)-----")
#: Between lines of an armour; a field of its header, as a line or, for the two usual ones, before a space.
BREAK = re.compile(r"(?:\s|\\+[rnt])*+")
FIELD = re.compile(r"(?:Proc-Type:\x20?\d,ENCRYPTED|DEK-Info:\x20?[A-Z0-9-]+,[0-9A-Fa-f]+(?![0-9A-Fa-f])|[A-Za-z-]+:\x20?[\x20-\x5b\x5d-\x7e]*+)(?=\s|\\+[rnt])")
#: The header of an armour that says how its body is encrypted: the cipher, and its first block in hex.
CIPHER = re.compile(r"DEK-Info:\x20?([A-Z0-9]+)-[A-Z0-9-]+,([0-9A-Fa-f]+)")
#: Bytes of a signature by algorithm, 0 for any multiple of 64 from 128 on.
SIGNATURES = {
    "HS256": (32,), "HS384": (48,), "HS512": (64,), "ES256": (64,), "ES256K": (64,), "ES384": (96,), "ES512": (132,), "EdDSA": (64, 114),
    "RS256": (0,), "RS384": (0,), "RS512": (0,), "PS256": (0,), "PS384": (0,), "PS512": (0,),
}
#: What isn't base64 in the body of an armour: white space and escapes.
NOT_BODY = re.compile(r"\s|\\+[rnt]|\\+")


def _base64(s: str, alt: bool = False) -> bytes | None:
    s = s.rstrip("=")
    try:
        raw = s.encode("ascii") + b"=" * (-len(s) % 4)
        return base64.urlsafe_b64decode(raw) if alt else base64.b64decode(raw, validate=True)
    except (ValueError, binascii.Error):
        return None


#: What a parser reads: bytes from one place to another, fewer where there are no more.
Peek = Callable[[int, int], bytes]
#: Most values of a key encoding; beyond, nothing is read.
MOST_VALUES = 12


def _header(peek: Peek, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the content of the ASN.1 value at a place, or None if it doesn't end by ``end``."""
    b = peek(at, min(at + 6, end))
    if len(b) < 2:
        return None
    n, k = b[1], 0
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or len(b) < 2 + k:
            return None
        n = int.from_bytes(b[2 : 2 + k], "big")
    start = at + 2 + k
    return (b[0], start, start + n) if start + n <= end else None


def _values(peek: Peek, at: int, end: int) -> list[tuple[int, int, int]]:
    """The values that fill a stretch exactly; none if their lengths don't add up or there are too many."""
    out = []
    while at < end:
        value = _header(peek, at, end)
        if not value or len(out) == MOST_VALUES:
            return []
        out.append(value)
        at = value[2]
    return out


def _is_der(peek: Peek, total: int) -> bool:
    """A SEQUENCE of ``total`` bytes that holds what key encodings hold. Reads the heads of its values alone."""
    top = _header(peek, 0, total)
    if not top or top[0] != 0x30 or top[2] != total:
        return False
    inner = _values(peek, top[1], total)
    if len(inner) < 2:
        return False
    tags = [tag for tag, _, _ in inner]
    n = [end - start for _, start, end in inner]
    starts_with_oid = lambda value: (_header(peek, value[1], value[2]) or (0,))[0] == 0x06
    if tags == [0x30, 0x04]:  # encrypted: an algorithm, then octets
        return n[1] >= 16 and starts_with_oid(inner[0])
    if tags[0] != 0x02 or n[0] != 1 or (version := peek(inner[0][1], inner[0][2])[0]) > 1:
        return False
    if tags[:9] == [0x02] * 9 and tags[9:] == [0x30] * (len(tags) > 9):  # RSA: modulus, exponents, two primes of half its length, and what goes with them
        return n[1] >= 32 and n[2] <= 8 and n[3] <= n[1] + 1 and abs(n[4] + n[5] - n[1]) <= 3 and all(x <= max(n[4], n[5]) + 1 for x in n[6:9])
    if tags == [0x02] * 6:  # DSA: p, q, g, y, x
        return n[1] >= 32 and 16 <= n[2] <= 65 and max(n[3], n[4]) <= n[1] + 1 and n[5] <= n[2] + 1
    if tags[1] == 0x04:  # a point's secret, then its curve and public key
        return version == 1 and 14 <= n[1] <= 72 and tags[2:] in ([], [0xA0], [0xA1], [0xA0, 0xA1])
    return tags[1:3] == [0x30, 0x04] and n[2] >= 14 and all(tag in (0xA0, 0xA1, 0x80, 0x81) for tag in tags[3:]) and starts_with_oid(inner[1])


def _strings_end(peek: Peek, at: int, count: int, size: int) -> int:
    """Where ``count`` length-prefixed strings end; 0 if they aren't all there."""
    for _ in range(count):
        b = peek(at, min(at + 4, size))
        if len(b) < 4:
            return 0
        at += 4 + int.from_bytes(b, "big")
        if at > size:
            return 0
    return at


def _openssh_keys(peek: Peek, size: int) -> tuple[int, int]:
    """The number of keys in a container and the place after it; no keys if it is none."""
    if peek(0, min(len(MAGIC), size)) != MAGIC:
        return 0, 0
    at = _strings_end(peek, len(MAGIC), 3, size)
    n = peek(at, min(at + 4, size)) if at else b""
    keys = int.from_bytes(n, "big") if len(n) == 4 else 0
    return (keys, at + 4) if 1 <= keys <= 16 else (0, 0)


def is_der_key(b: bytes | None) -> bool:
    """One SEQUENCE that ends where ``b`` does and holds what key encodings hold."""
    return bool(b) and _is_der(lambda i, j: b[i:j], len(b))


def is_openssh_key(b: bytes | None) -> bool:
    """The container's magic, then cipher, kdf and options as length-prefixed strings, then a key count."""
    return bool(b) and _openssh_keys(lambda i, j: b[i:j], len(b))[0] > 0


class _Block:
    """Base64 from a place on, without what wraps it. Made once for all keys that may start in it, of which parsers decode what they read."""

    def __init__(self, t: str, at: int, alphabet: int) -> None:
        parts, self.starts, self.before, self.alt = [], [], [0], bool(alphabet)
        while m := RUNS[alphabet].match(t, at):
            parts.append(m[0])
            self.starts.append(at)
            self.before.append(self.before[-1] + len(m[0]))
            self.end = m.end()
            wrap = WRAP.match(t, self.end)
            if not wrap:
                break
            at = wrap.end()
        self.text = "".join(parts)

    def offset(self, at: int) -> int:
        k = bisect_right(self.starts, at) - 1
        return self.before[k] + at - self.starts[k]

    def place(self, offset: int) -> int:
        """The place in the text after so many characters of the block."""
        k = bisect_left(self.before, offset) - 1
        return self.starts[k] + offset - self.before[k]

    def line(self, offset: int) -> int:
        """The number of characters up to the end of the line."""
        return self.before[bisect_right(self.before, offset)] - offset

    def peek(self, offset: int) -> Peek:
        def read(i: int, j: int) -> bytes:
            a = i // 3
            return (_base64(self.text[offset + 4 * a : offset + -(-j // 3) * 4], self.alt) or b"")[i - 3 * a : j - 3 * a]

        return read


def _with_pads(t: str, end: int) -> int:
    """The end after pads, or 0 if more base64 follows at once."""
    if RUNS[0].match(t, end):
        return 0
    return end + next(k for k in (2, 1, 0) if t.startswith("=" * k, end))


def _der_end(t: str, at: int, block: _Block) -> int:
    """Where the base64 key that starts at a place ends, by the length that it states; 0 if there is none."""
    offset = block.offset(at)
    head = _base64(block.text[offset : offset + 12], block.alt)
    k = head[1] & 0x7F if head and len(head) == 9 and head[1] & 0x80 else 0
    if not head or len(head) < 9 or k > 4 or head[2 + k] not in (0x02, 0x30):  # most starts end here
        return 0
    peek, there = block.peek(offset), len(block.text) - offset
    top = _header(peek, 0, there * 3 // 4)
    if not top:
        return 0
    n = -(-top[2] * 4 // 3)
    return _with_pads(t, block.place(offset + n)) if LEAST_BASE64 <= n <= there and _is_der(peek, top[2]) else 0


def _openssh_end(t: str, at: int, block: _Block) -> int:
    """The same of the private key container; one that isn't all there ends with its line."""
    offset = block.offset(at)
    peek, size = block.peek(offset), (len(block.text) - offset) * 3 // 4
    keys, start = _openssh_keys(peek, size)
    if not keys:
        return 0
    whole = _strings_end(peek, start, keys + 1, size)
    if whole and (end := _with_pads(t, block.place(offset + -(-whole * 4 // 3)))):
        return end
    line = block.line(offset)
    return _with_pads(t, at + line) if line >= LEAST_BASE64 + 2 and _openssh_keys(peek, line * 3 // 4)[0] else 0


def _base64_keys(t: str) -> Iterator[tuple[str, int, int]]:
    at, blocks = 0, [None, None]
    while m := START.search(t, at):
        kind, find = ("openssh", _openssh_end) if m[0] == "b3Bl" else ("der", _der_end)
        end = 0
        for alphabet in (0, 1):
            if not blocks[alphabet] or blocks[alphabet].end <= m.start():
                blocks[alphabet] = _Block(t, m.start(), alphabet)
            end = end or find(t, m.start(), blocks[alphabet])
        if end:
            yield kind, m.start(), end
        at = end or m.end()


def _hex_keys(t: str) -> Iterator[tuple[str, int, int]]:
    for m in HEX_KEY.finditer(t):
        b = bytes.fromhex(m[0])
        if is_der_key(b):
            yield "der", *m.span()
        elif is_openssh_key(b):
            yield "openssh", *m.span()


def _colon_keys(t: str) -> Iterator[tuple[str, int, int]]:
    """Keys as hex with colons; they end by the length that they state."""
    for m in COLON_HEX.finditer(t):
        ends = [x.end() for x in re.finditer(r"[0-9A-Fa-f]{2}", m[0])]
        b = bytes.fromhex("".join(m[0].replace(":", " ").split()))
        peek = lambda i, j: b[i:j]  # noqa: B023, E731
        top = _header(peek, 0, len(b))
        if top and _is_der(peek, top[2]):
            yield "der", m.start(), m.start() + ends[top[2] - 1]
        elif keys := _openssh_keys(peek, len(b)):
            if keys[0]:
                yield "openssh", m.start(), m.start() + ends[(_strings_end(peek, keys[1], keys[0] + 1, len(b)) or len(b)) - 1]


def _signed_token_end(m: re.Match) -> int:
    """Where a signed token ends; 0 if the parts aren't those of one. Marks after a signature of known length aren't its own."""
    try:
        h, c = (json.loads(_base64(m[k], alt=True) or b"") for k in (1, 2))
    except (ValueError, UnicodeDecodeError, RecursionError):
        return 0
    if not (isinstance(h, dict) and isinstance(h.get("alg"), str) and isinstance(c, dict)) or h["alg"].lower() == "none":
        return 0
    for size in SIGNATURES.get(h["alg"], (0,)):
        n = -(-size * 4 // 3) if size else 0
        own = m[3] if len(m[3]) == n else m[3].rstrip("_-")
        if n:
            good = len(own) == n
        else:
            raw = len(_base64(m[3], alt=True) or b"")
            good = raw >= 128 and raw % 64 == 0 if h["alg"] in SIGNATURES else raw >= 16
        if good:
            return m.start(3) + (len(own) if n else len(m[3]))
    return 0


def _is_encrypted(header: str, body: bytes | None) -> bool:
    """Whether an armour's header names a cipher and its first block, and the body is whole blocks of that size."""
    m = CIPHER.search(header)
    if not m or not body:
        return False
    block = len(m[2]) // 2
    return block in (8, 16) and len(m[2]) % 2 == 0 and len(body) % block == 0 and len(body) >= 2 * block


def _armours(t: str) -> Iterator[tuple[str, int, int]]:
    """Armours, read line by line: fields of the header, then a body."""
    begin = None
    for m in MARK.finditer(t):
        if m[1] == "END" and begin and begin[2] == m[2]:
            at = body = BREAK.match(t, begin.end(), m.start()).end()
            while field := FIELD.match(t, body, m.start()):
                body = BREAK.match(t, field.end(), m.start()).end()
            b = _base64(NOT_BODY.sub("", t[body : m.start()]))
            if is_der_key(b) or is_openssh_key(b) or _is_encrypted(t[at:body], b):
                yield "pem", begin.start(), m.end()
        begin = m if m[1] == "BEGIN" else None


def findings(t: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then kind."""
    if not t:
        return []
    out: list[tuple[str, int, int]] = []
    if "=" in t or ":" in t:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    if "AKIA" in t:
        out += [("access", *m.span()) for m in ACCESS.finditer(t) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(t)]
    if ".e" in t:
        out += [("jwt", m.start(), end) for m in JWT.finditer(t) if (end := _signed_token_end(m))]
    out += _base64_keys(t)
    out += _hex_keys(t)
    if ":" in t:
        out += _colon_keys(t)
    if "-----BEGIN" in t:
        out += _armours(t)
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


@F.pandas_udf(FINDINGS)
def _scan(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in findings(t)] for t in batch], dtype=object)


def scan(text: Column) -> Column:
    """The findings in a text column."""
    return _scan(text)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span, overlapping ones as one, replaced by ``<SECRET>``."""
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], "<SECRET>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


@F.pandas_udf(T.StringType())
def _redact(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([redacted(t, found) if (found := findings(t)) else t for t in batch], dtype=object)


def redact_secrets(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """The rows with secrets replaced; ``n_chars`` is counted anew. A null text stays null."""
    types = dict(docs.dtypes)
    out = docs.withColumn(text, _redact(F.col(f"`{text}`")))
    if n_chars and n_chars in types:
        out = out.withColumn(n_chars, F.when(F.col(text).isNull(), F.col(n_chars)).otherwise(F.char_length(text)).cast(types[n_chars]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
