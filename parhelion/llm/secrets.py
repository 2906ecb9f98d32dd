"""Secret scanning through nested encodings.

A worklist of layers starts with the text itself.  Every layer is scanned, then unwrapped
into further layers, until none unwraps any more: the whole layer with all URL and
Unicode escapes replaced in place, and its base64 runs (also over lines that follow one
another) with gzip, zlib or zstandard data inside, to any depth and size.  A layer that
equals one of those it came out of, or one already seen at the same place, is not entered again.  Each character of a
layer knows which characters of the text it came from, so findings are reported as
spans of the text.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from collections import deque
from itertools import repeat

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

# Fixed patterns of the three kinds, in the order of their report.
ASSIGN = re.compile(r"""(?a)((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex")

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u([dD][89abAB][0-9a-fA-F]{2})\\u([dD][c-fC-F][0-9a-fA-F]{2})|\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|\\u\{([0-9a-fA-F]{1,6})\}")
_ESCAPE = re.compile(f"{_URL.pattern}|{re.sub(r'[(](?![?])', '(?:', _UNICODE.pattern)}")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Runs of base64 on lines that follow one another, each line but the last of one length.
_WRAPPED = re.compile(r"([A-Za-z0-9+/_-]{16,})((?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)+)(={0,2})")
_BREAK = re.compile(r"\r?\n[\x20\t]*")
_B64_SHAPE = bytes(98 if chr(i).isascii() and (chr(i).isalnum() or chr(i) in "+/_-") else 32 for i in range(256))
_HEX_SHAPE = bytes(104 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
_PIECE = 1 << 14


def scan(text: str, raw: bytes | None = None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the three kinds in one layer."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    raw = text.encode("utf-8", "surrogatepass") if raw is None else raw
    if b"h" * 16 in raw.translate(_HEX_SHAPE):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def _unescape(token: str, at: int, pattern: re.Pattern, decode) -> tuple[str, list[tuple[int, int]]] | None:
    """The token with every match decoded, and the span of the layer for each character."""
    chars: list[str] = []
    spans: list[tuple[int, int]] = []
    last = 0
    for m in pattern.finditer(token):
        chars += token[last : m.start()]
        spans += [(at + i, at + i + 1) for i in range(last, m.start())]
        for c, a, b in decode(m):
            chars.append(c)
            spans.append((at + m.start() + a, at + m.start() + b))
        last = m.end()
    if not last:
        return None
    chars += token[last:]
    spans += [(at + i, at + i + 1) for i in range(last, len(token))]
    return "".join(chars), spans


def _url(m: re.Match) -> list[tuple[str, int, int]]:
    data = bytes.fromhex(m.group().replace("%", ""))
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        text = data.decode("latin-1")
        return [(c, 3 * i, 3 * i + 3) for i, c in enumerate(text)]
    out, at = [], 0
    for c in text:
        n = 3 * len(c.encode("utf-8"))
        out.append((c, at, at + n))
        at += n
    return out


def _unicode(m: re.Match) -> list[tuple[str, int, int]]:
    high, low, four, two, braces = m.groups()
    if high:
        c = chr(0x10000 + ((int(high, 16) - 0xD800) << 10) + int(low, 16) - 0xDC00)
    else:
        n = int(four or two or braces, 16)
        if n > 0x10FFFF or 0xD800 <= n < 0xE000:
            return [(x, i, i + 1) for i, x in enumerate(m.group())]
        c = chr(n)
    return [(c, 0, m.end() - m.start())]


def _unpack(data: bytes) -> bytes | None:
    """Content of gzip, zlib or zstandard data, all members and frames; None for other bytes.

    Data that break off or go on with other bytes give what stands before.
    """
    out, found = [], False
    while data:
        if data[:2] == b"\x1f\x8b" or data[:1] == b"\x78" and len(data) > 2 and (data[0] * 256 + data[1]) % 31 == 0:
            coder, step = zlib.decompressobj(47), zlib.error
        elif data[:4] == b"\x28\xb5\x2f\xfd":
            coder, step = zstandard.ZstdDecompressor().decompressobj(), zstandard.ZstdError
        else:
            break
        try:
            # piece by piece, so that what precedes a fault is kept
            for at in range(0, len(data), _PIECE):
                if got := coder.decompress(data[at : at + _PIECE]):
                    out.append(got)
                if coder.eof:
                    break
        except step:
            found = found or bool(out)
            break
        found = True
        data = coder.unused_data + data[at + _PIECE :] if coder.eof else b""
    return b"".join(out) if found else None


def _decoded(data: bytes) -> tuple[str, str, int]:
    """The bytes as text, their encoding and the bytes of its mark: UTF-16 or UTF-32 by the mark, else UTF-8, else Latin-1."""
    for mark, name in ((b"\xff\xfe\0\0", "utf-32-le"), (b"\0\0\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"), (b"", "utf-8")):
        if data.startswith(mark):
            try:
                return data[len(mark) :].decode(name), name, len(mark)
            except UnicodeDecodeError:
                pass
    return data.decode("latin-1"), "latin-1", 0


class Whole:
    """The spans of a layer of n characters each of which stands for the whole of a token."""

    def __init__(self, a: int, b: int, n: int):
        self.span, self.n = (a, b), n

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i):
        return [self.span] * len(range(self.n)[i]) if isinstance(i, slice) else self.span

    def __iter__(self):
        return repeat(self.span, self.n)


def _mapped(outer, inner):
    """The spans in the text of a layer whose spans in the layer around are inner."""
    if isinstance(inner, Whole):
        a, b = inner.span
        return Whole(outer[a][0], outer[b - 1][1], inner.n)
    return Whole(*outer.span, len(inner)) if isinstance(outer, Whole) else [(outer[a][0], outer[b - 1][1]) for a, b in inner]


def _base64(token: str, at: int) -> tuple[str, list[tuple[int, int]]] | None:
    body = token.rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        data = base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None
    inner, rounds, seen = data, 0, {data}
    while (more := _unpack(inner)) is not None and more not in seen:
        inner, rounds = more, rounds + 1
        seen.add(more)
    text, name, byte = _decoded(inner)
    if not text:
        return None
    if rounds:  # a compressed byte depends on the whole token
        return text, Whole(at, at + len(token), len(text))
    spans = []
    for c in text:
        n = len(c.encode(name))
        spans.append((at + byte * 4 // 3, at + min(len(token), -(-(byte + n) * 4 // 3))))
        byte += n
    return text, spans


def unwrap(layer: str, raw: bytes | None = None) -> list[tuple[str, list[tuple[int, int]]]]:
    """Layers found in a layer: text and, for each character, its span in the layer.

    URL and Unicode escapes are undone in one step, so their orders do not multiply; what
    is an escape only after that step is undone in the next layer.
    """
    out = []
    if "%" in layer or "\\" in layer:
        got = _unescape(layer, 0, _ESCAPE, lambda m: _url(m) if m.group()[0] == "%" else _unicode(_UNICODE.fullmatch(m.group())))
        if got and got[0] != layer:
            out.append(got)
    raw = layer.encode("utf-8", "surrogatepass") if raw is None else raw
    if b"b" * 16 in raw.translate(_B64_SHAPE):
        out += [got for m in _BASE64.finditer(layer) if (got := _base64(m.group(), m.start()))]
        out += _wrapped(layer)
    return out


def _wrapped(layer: str) -> list[tuple[str, list[tuple[int, int]]]]:
    """Layers of base64 that goes on over several lines, from each line that is as long as the next."""
    out = []
    for m in _WRAPPED.finditer(layer):
        lines, at = [], m.start()
        for gap in [*_BREAK.finditer(m.group()), None]:
            end = m.start() + gap.start() if gap else m.end()
            lines.append((at, end))
            at = m.start() + gap.end() if gap else end
        i = 0
        while i < len(lines):
            j, width = i + 1, lines[i][1] - lines[i][0]
            while j < len(lines) and lines[j][1] - lines[j][0] == width:
                j += 1
            if j < len(lines) and lines[j][1] - lines[j][0] < width:
                j += 1
            if j > i + 1:
                where = [k for a, b in lines[i:j] for k in range(a, b)]
                if got := _base64("".join(layer[a:b] for a, b in lines[i:j]), 0):
                    out.append((got[0], _mapped([(k, k + 1) for k in where], got[1])))
            # a last line that is shorter may be the first of another run
            i = j if j == i + 1 or lines[j - 1][1] - lines[j - 1][0] == width else j - 1
    return out


def find_secrets(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans, as (start, kind number, end), both sorted, without repeats.

    Null is an empty text.  The worklist ends: unescaping and base64 shorten a layer,
    and a compressed layer equal to one of its ancestors is dropped.
    """
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    base = sorted(scan(text, raw))
    found = set(base)
    digest = lambda t: hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    work = deque((layer, spans, frozenset([digest(text)])) for layer, spans in unwrap(text, raw))
    seen = set()  # escapes undone in another order give the same layer again
    while work:
        layer, spans, above = work.popleft()
        own = digest(layer)
        places = hash((spans.span, spans.n)) if isinstance(spans, Whole) else hash(tuple(spans))
        if own in above or (own, places) in seen:
            continue
        seen.add((own, places))
        for start, kind, end in scan(layer):
            found.add((spans[start][0], kind, max(s[1] for s in spans[start:end])))
        for inner, at in unwrap(layer):
            work.append((inner, _mapped(spans, at), above | {own}))
    return base, sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, secrets for every row.

    The counts and base_sha256 are of the text itself; spans and secrets (kind, start,
    end) also have what the decoded layers add.  Null and empty texts have no spans.
    """
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in batches:
            counts, shas, spans, items = [[], [], []], [], [], []
            for t in b.column(1).to_pylist():
                base, all_spans = find_secrets(t)
                for k in range(3):
                    counts[k].append(sum(s[1] == k for s in base))
                shas.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(all_spans))
                items.append([{"kind": KINDS[k], "start": a, "end": e} for a, k, e in all_spans])
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(shas, pa.string()), pa.array(spans, pa.string()), pa.array(items, item)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "secrets"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, secrets array<struct<kind:string,start:bigint,end:bigint>>")
