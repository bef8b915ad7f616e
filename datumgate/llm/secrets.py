"""Secret scan with a worklist of decoded layers.

Every text is scanned as it stands; then each token that looks URL-escaped,
Unicode-escaped, base64 or hexadecimal is unwrapped (compressed contents
inflated) and the result goes on the worklist, until nothing new appears. Layers
already seen are not scanned again, which ends cycles. A secret found in a layer is reported at the
span of the outermost encoded token in the original text.

Defined results: a null text counts as empty; an empty text has no spans; a
layer that is no valid UTF-8 is scanned with its invalid bytes replaced; spans found twice
count once; repeated rows are scanned alike. Base64 wrapped over lines is read as one token,
and each of its lines as a token too. All members of gzip data are read, and broken data as far
as it goes. An inflated layer above ``MAX_LAYER_BYTES`` is scanned in chunks of that size that
overlap by ``OVERLAP_BYTES``, and its token is also reported as kind ``bomb``.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import tidy

# The patterns of the three base kinds and their least lengths.
ASSIGN = re.compile(
    r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_CHARS, ACCESS_CHARS = 12, 18
KINDS = ("assign", "access", "hex", "private_key", "jwt", "bomb")

PRIVATE_KEY = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")
# A token starts where its run of characters starts, so that a long run is read once.
URL_TOKEN = re.compile(r"(?<![^\s\"'<>%])[^\s\"'<>%]*(?:%[0-9A-Fa-f]{2}[^\s\"'<>%]*)+")
UNICODE_TOKEN = re.compile(r"(?<![^\s\"'<>\\])[^\s\"'<>\\]*(?:\\u[0-9A-Fa-f]{4}[^\s\"'<>\\]*)+")
UNICODE_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})")
BASE64_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WRAPPED_TOKEN = re.compile(
    r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}"
)
HEX_TOKEN = re.compile(r"(?:[0-9A-Fa-f]{2}){16,}")
MAX_LAYER_BYTES = 64 << 20
OVERLAP_BYTES = 1 << 20
PIECE_BYTES = 16 << 20

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def extra_spans(text: str) -> list[Span]:
    found = []
    if "PRIVATE KEY" in text:
        found += [("private_key", *m.span()) for m in PRIVATE_KEY.finditer(text)]
    if "eyJ" in text:
        found += [("jwt", *m.span()) for m in JWT.finditer(text)]
    return found


def _inflated(data: bytes) -> Iterator[bytes]:
    """Contents of all members of gzip or zlib data in pieces, else the data."""
    wrapped = data[:2] == b"\x1f\x8b" or (len(data) > 2 and data[0] & 0x0F == 8 and int.from_bytes(data[:2], "big") % 31 == 0)
    if not wrapped:
        yield data
        return
    left, some = data, False
    while left:
        unpacker = zlib.decompressobj(47)
        try:
            while not unpacker.eof:
                piece = unpacker.decompress(left, PIECE_BYTES)
                left = unpacker.unconsumed_tail
                if piece:
                    some = True
                    yield piece
                elif not left:
                    break
        except zlib.error:
            if not some:
                yield data
            elif not unpacker.eof:
                yield left  # not another member
            return
        left = unpacker.unused_data


def _texts_of(data: bytes) -> Iterator[str | None]:
    """The text in the data, in overlapping chunks after a None if it is too large to keep."""
    kept, whole = bytearray(), True
    for piece in _inflated(data):
        for at in range(0, len(piece), MAX_LAYER_BYTES):
            kept += piece[at : at + MAX_LAYER_BYTES]
            while len(kept) > MAX_LAYER_BYTES:
                if whole:
                    yield None
                whole = False
                yield kept[:MAX_LAYER_BYTES].decode(errors="replace")
                del kept[: MAX_LAYER_BYTES - OVERLAP_BYTES]
    if kept:
        yield kept.decode(errors="replace")


def _from_base64(token: str) -> Iterator[str | None]:
    plain = "".join(token.split()).rstrip("=").replace("-", "+").replace("_", "/")
    if len(plain) % 4 == 1:
        plain = plain[:-1]
    try:
        data = base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except binascii.Error:
        return
    yield from _texts_of(data)


def _from_unicode(token: str) -> Iterator[str]:
    plain = UNICODE_ESCAPE.sub(lambda m: chr(int(m[1], 16)), token)
    yield plain.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def layers_of(text: str) -> Iterator[tuple[int, int, str | None]]:
    """(start, end, decoded text) of each encoded token; a None comes before the chunks of one too large to keep."""
    decoders = [(BASE64_TOKEN, _from_base64), (HEX_TOKEN, lambda t: _texts_of(bytes.fromhex(t)))]
    if "\n" in text:
        decoders.append((WRAPPED_TOKEN, _from_base64))
    if "%" in text:
        decoders.append((URL_TOKEN, lambda t: _texts_of(unquote_to_bytes(t))))
    if "\\u" in text:
        decoders.append((UNICODE_TOKEN, _from_unicode))
    for pattern, decode in decoders:
        for m in pattern.finditer(text):
            for decoded in decode(m[0]):
                if decoded != m[0]:
                    yield *m.span(), decoded


def scan_text(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each ordered by start, kind, end."""
    text = text or ""
    base = base_spans(text)
    spans = set(base) | set(extra_spans(text))
    seen = set()
    # Each entry yields the layers of one text; only the texts along one nesting are in memory.
    work = [(layers_of(text), None)]
    while work:
        layers, origin = work[-1]
        token = next(layers, None)
        if token is None:
            work.pop()
            continue
        start, end, decoded = token
        outer = origin or (start, end)
        if decoded is None:
            spans.add(("bomb", *outer))
            continue
        mark = (outer, hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).digest())
        if mark not in seen:
            seen.add(mark)
            spans.update((kind, *outer) for kind, _, _ in base_spans(decoded) + extra_spans(decoded))
            work.append((layers_of(decoded), outer))
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    return sorted(base, key=order), sorted(spans, key=order)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base_spans, spans) of every row; spans are (kind, start, end) in code points."""
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    @tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan_text(t.as_py()) for t in batch.column(1)]
            columns = [
                pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in row[n]] for row in found], span) for n in (0, 1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "base_spans", "spans"])

    spans = "array<struct<kind: string, start: long, end: long>>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        scan, f"doc_id {kind}, base_spans {spans}, spans {spans}"
    )
