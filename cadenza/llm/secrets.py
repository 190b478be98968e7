"""Secret scans through nested encodings.

Each text is layer 0 of a worklist.  Each layer is scanned for secrets, then unwrapped: URL
escapes and Unicode escapes give the whole layer again without them, each base64 run, within a
line or over line ends, a layer of its own, through all compressed layers and members in it.
A run may begin with characters that aren't of the encoding (`path/`, `id-`, letters): it is
decoded at all four alignments, so that whatever follows such a start is read, and compressed
data is looked for wherever its first bytes stand.  Decoded bytes that aren't UTF-8 are scanned
as latin-1.  New layers go to the worklist until none is left; a layer whose text was seen for
the same place is a cycle and not taken again.  Every layer knows which characters of the
document each of its characters came from, so spans are of the original text, in code points,
end exclusive.

Limits: unwrapped layers of one document hold `LAYER_BYTES` bytes plus 64 for each character
of the text at most, so that a decompression bomb can't take a worker's memory; what is beyond
that isn't unwrapped, and `truncated` says so.  Such documents can be scanned again with a
larger `layer_bytes`, or with none (null: no limit).  Layer 0 is always scanned whole.

Defined cases: a null or empty text has no secrets; equal rows have equal results; an empty
table gives none; extra columns stay as they are, and one named `secrets` makes the result
`_secrets`.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import lzma
import re
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import free_name, read_table

KINDS = ("assign", "access", "hex")
#: Bytes that the layers of one document may hold, besides 64 for each of its characters.
LAYER_BYTES = 64_000_000

_ANY_CASE = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
_NAMES = "|".join([*map(_ANY_CASE, ("password", "passwd", "secret", "token")), _ANY_CASE("api") + "_?" + _ANY_CASE("key")])
_ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(
    r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&(?:quot|amp|apos|lt|gt);"
)
_NAMED = {"&quot;": '"', "&amp;": "&", "&apos;": "'", "&lt;": "<", "&gt;": ">"}
#: No shorter run can hold a secret: 16 bytes of hex take 22 characters.
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{22,}={0,2}")
#: Runs that go on over line ends, and their lines.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+\r?+\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
_DIGITS = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
_STANDARD = str.maketrans("-_", "+/")
#: How base64 of gzip, zlib, bzip2, xz and zstandard data begins.
_PACKED = re.compile(r"H4sI|e[AFJN]|Qlpo|/Td6WFoA|KLUv/")
#: Characters of base64 that tell compressed data from what only begins like it.
_PROBE = 256


def find(text: str) -> list[tuple[str, int, int]]:
    """Secrets of one layer: leftmost, not overlapping within a kind."""
    out = []
    if "=" in text or ":" in text:
        out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    return out + [("hex", *m.span()) for m in _HEX.finditer(text)]


class Layer:
    """A text and the places its characters came from: from `at[i]` on, characters either come
    one by one from `origin[i]` on, or (`end[i]` > 0) all from the span up to `end[i]`."""

    __slots__ = ("text", "at", "origin", "end", "depth")

    def __init__(self, text: str, at: list[int], origin: list[int], end: list[int], depth: int):
        self.text, self.at, self.origin, self.end, self.depth = text, at, origin, end, depth

    def span(self, a: int, b: int) -> tuple[int, int]:
        """The span of the document that the characters a to b came from."""
        first, last = bisect_right(self.at, a) - 1, bisect_right(self.at, b - 1) - 1
        start = self.origin[first] + (0 if self.end[first] else a - self.at[first])
        stop = self.end[last] or self.origin[last] + b - self.at[last]
        return start, stop


def _rewritten(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The whole layer with what matches decoded; decode gives [(characters, from, to)]."""
    text, parts, at, origin, end, size, last = layer.text, [], [], [], [], 0, 0

    def keep(a: int, b: int) -> None:
        nonlocal size
        k = bisect_right(layer.at, a) - 1
        while a < b:
            stop = min(b, layer.at[k + 1] if k + 1 < len(layer.at) else b)
            at.append(size)
            origin.append(layer.origin[k] + (0 if layer.end[k] else a - layer.at[k]))
            end.append(layer.end[k])
            parts.append(text[a:stop])
            size, a, k = size + stop - a, stop, k + 1

    for m in pattern.finditer(text):
        new = decode(m[0])
        if new is None:
            continue
        keep(last, m.start())
        last = m.end()
        for chars, a, b in new:
            x, y = layer.span(m.start() + a, m.start() + b)
            at.append(size)
            origin.append(x)
            end.append(y)
            parts.append(chars)
            size += len(chars)
    if not last:
        return None
    keep(last, len(text))
    return Layer("".join(parts), at, origin, end, layer.depth + 1)


def _percent(run: str) -> list[tuple[str, int, int]]:
    raw, out, i = bytes.fromhex(run.replace("%", "")), [], 0
    for c in raw.decode("utf-8", "replace"):
        n = len(c.encode()) if c != "�" else 1
        out.append((c, 3 * i, 3 * (i + n)))
        i += n
    return out


def _escape(run: str) -> list[tuple[str, int, int]] | None:
    if run in _NAMED:
        return [(_NAMED[run], 0, len(run))]
    if run[:2] == "\\u" and run[2] != "{":
        units = [int(run[i + 2 : i + 6], 16) for i in range(0, len(run), 6)]
        out, i = [], 0
        while i < len(units):
            pair = i + 1 < len(units) and 0xD800 <= units[i] < 0xDC00 <= units[i + 1] < 0xE000
            code = 0x10000 + ((units[i] - 0xD800) << 10) + units[i + 1] - 0xDC00 if pair else units[i]
            out.append((chr(code) if not 0xD800 <= code < 0xE000 else "�", 6 * i, 6 * (i + 1 + pair)))
            i += 1 + pair
        return out
    digits = run.strip("\\uUx&#;{}X")
    code = int(digits, 10 if run[:2] == "&#" and run[2] not in "xX" else 16)
    return [(chr(code), 0, len(run))] if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def _member(data: bytes, room: int) -> tuple[bytes, bytes, bool, bool] | None:
    """Of one compressed member: what it holds, up to room bytes; the bytes after it; whether
    there was more; whether it ended.  None for other data."""
    try:
        if data[:2] == b"\x1f\x8b" or data[:1] == b"\x78" and len(data) > 2 and (data[0] << 8 | data[1]) % 31 == 0:
            d = zlib.decompressobj(zlib.MAX_WBITS | 32)
            out = d.decompress(data, room)
            return out, d.unused_data, not d.eof and (bool(d.unconsumed_tail) or len(out) >= room), d.eof
        if data[:3] == b"BZh":
            d = bz2.BZ2Decompressor()
        elif data[:6] == b"\xfd7zXZ\x00":
            d = lzma.LZMADecompressor(memlimit=100_000_000)
        elif data[:4] == b"\x28\xb5\x2f\xfd":
            import zstandard

            d, out, size, k = zstandard.ZstdDecompressor(max_window_size=1 << 26).decompressobj(), [], 0, 0
            while k < len(data) and not d.eof and size < room:  # a few bytes at a time, so that a bomb is met early
                out.append(d.decompress(data[k : k + 256]))
                size, k = size + len(out[-1]), k + 256
            more = size > room or not d.eof and k < len(data)
            return b"".join(out)[:room], d.unused_data + data[k:] if d.eof else b"", more, d.eof
        else:
            return None
        out = d.decompress(data, room)
        return out, d.unused_data, not d.eof and not d.needs_input, d.eof
    except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
        return None
    except Exception as e:  # zstandard's own error
        if type(e).__name__ != "ZstdError":
            raise
    return None


def _inflate(data: bytes, room: int) -> tuple[bytes, bytes, bool, bool] | None:
    """As _member, of all members that follow each other."""
    parts, rest, more, whole = [], data, False, True
    while rest and whole and not more:
        if room <= 0:
            more = True
            break
        found = _member(rest, room)
        if found is None:
            break
        out, rest, more, whole = found
        rest = rest.lstrip(b"\0")  # padding
        parts.append(out)
        room -= len(out)
    return (b"".join(parts), rest, more, whole) if parts else None


def _contents(raw: bytes, room: int) -> tuple[list[tuple[bytes, int]], int, bool]:
    """The byte layers under raw that aren't compressed, with the number of compressed ones
    above each but the first; the bytes of layers between; whether the limit was met."""
    work, seen, out, used, cut = [(raw, -1)], {raw}, [], 0, False
    while work:
        data, above = work.pop()
        found = _inflate(data, max(1, room - used))
        if found is None:
            out.append((data, max(0, above)))
            continue
        content, rest, more, whole = found
        cut |= more
        if above >= 0:
            used += len(data)
        if not whole:  # cut off, or not compressed at all
            out.append((data, max(0, above)))
        for x, n in ((content, above + 1), (rest, above)):
            if x and x not in seen and used + len(x) <= room:
                seen.add(x)
                work.append((x, n))
            elif x and x not in seen:
                cut = True
    return out, used, cut


def _readable(raw: bytes) -> str:
    """The bytes as UTF-8 text; if they aren't, each byte is a character."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _decoded(body: str) -> bytes | None:
    """The bytes of base64 digits of the standard alphabet; a digit too many is left out."""
    body = body[: len(body) - (len(body) % 4 == 1)]
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def _starts(body: str) -> Iterator[tuple[int, bool]]:
    """Where base64 may begin in a run of digits, and whether compressed data does there: the
    four alignments, of which one is right for anything that begins anywhere, and the places of
    compressed data, which has to be read from its start."""
    for k in range(4):
        yield k, False
    for m in _PACKED.finditer(body):
        if m.start():
            head = _decoded(body[m.start() : m.start() + _PROBE])
            if head is not None and _member(head, 1 << 12) is not None:
                yield m.start(), True


def _unwrapped(layer: Layer, run: list[tuple[int, int]], room: int) -> tuple[list[Layer], int, bool]:
    """The layers in a base64 run, given as its pieces, through all compression in it; the
    bytes of compressed layers between; whether the limit was met."""
    a, b = run[0][0], run[-1][1]
    digits = "".join(layer.text[x:y] for x, y in run).rstrip("=").translate(_STANDARD)
    whole = layer.span(a, b)
    exact = whole[1] - whole[0] == b - a  # each digit came from a character of its own
    out, used, cut = [], 0, False
    for start, packed in _starts(digits):
        raw = _decoded(digits[start:])
        if not raw or start and len(digits) - start < 22:
            continue
        contents, more_used, more_cut = _contents(raw, max(1, room - used)) if packed or not start else ([(raw, 0)], 0, False)
        used, cut = used + more_used, cut or more_cut
        for data, above in contents:
            if packed and data is raw:
                continue  # not compressed after all
            text = _readable(data)
            if not text:
                continue
            if data is not raw or not exact:
                out.append(Layer(text, [0], [whole[0]], [whole[1]], layer.depth + 1 + above))
                continue
            places = [whole[0] + i - a for x, y in run for i in range(x, y)] if len(run) > 1 else range(whole[0], whole[1])
            # A character comes from the base64 digits with its bits.
            size = [1] * len(text) if len(text) == len(data) else [len(c.encode()) for c in text]
            stop = list(accumulate(size))
            at = list(range(len(text)))
            origin = [places[start + (i - n) * 8 // 6] for i, n in zip(stop, size, strict=True)]
            end = [places[start - (-i * 8 // 6) - 1] + 1 for i in stop]
            out.append(Layer(text, at, origin, end, layer.depth + 1))
    return out, used, cut


def _runs(text: str) -> Iterator[list[tuple[int, int]]]:
    """Base64 runs as lists of their pieces: those within a line, then those over line ends.
    Of lines that follow each other: all; all but a first one that begins within its line; and
    each stretch of lines of one length with a last one that may be shorter, so that words
    above or below a block don't shift it."""
    for m in _BASE64.finditer(text):
        yield [m.span()]
    if "\n" not in text and "\r" not in text:
        return
    for m in _WRAPPED.finditer(text):
        lines = [x.span() for x in _DIGITS.finditer(text, *m.span())]
        size = [y - x for x, y in lines]
        starts = {0: len(lines)}
        if m.start() and text[m.start() - 1] not in "\r\n":
            starts[1] = len(lines)
        given, k = set(), 0
        ranges = list(starts.items())
        while k < len(lines):
            stop = k + 1
            while stop < len(lines) and size[stop] == size[k]:
                stop += 1
            ranges.append((k, stop + (stop < len(lines) and size[stop] < size[k])))
            k = stop
        for x, y in ranges:
            if (x, y) not in given and y - x > 1 and sum(size[x:y]) >= 22:
                given.add((x, y))
                yield lines[x:y]


def scan(text: str | None, layer_bytes: int | None = LAYER_BYTES) -> tuple[list, list, int, bool]:
    """(secrets of the text itself, secrets of all layers with their depth, number of layers,
    whether the limit was met).  Both lists are sorted by start, then kind as listed."""
    if not text:
        return [], [], 0, False
    order = {k: i for i, k in enumerate(KINDS)}
    base = sorted(find(text), key=lambda s: (s[1], order[s[0]]))
    found = {s: 0 for s in base}
    work, seen, room, cut = deque([Layer(text, [0], [0], [0], 0)]), {(text, 0, len(text))}, (1 << 62 if layer_bytes is None else layer_bytes + 64 * len(text)), False
    layers = 0
    while work:
        layer = work.popleft()
        layers += 1
        if layer.depth:
            for kind, a, b in find(layer.text):
                found.setdefault((kind, *layer.span(a, b)), layer.depth)
        new = []
        if "%" in layer.text:
            new.append(_rewritten(layer, _URL, _percent))
        if "\\" in layer.text or "&" in layer.text:
            new.append(_rewritten(layer, _UNICODE, _escape))
        for run in _runs(layer.text):
            children, used, more = _unwrapped(layer, run, max(1, room))
            cut |= more
            room -= used
            new += children
        for child in new:
            if child is None:
                continue
            key = (child.text, *child.span(0, len(child.text)))
            if key in seen:
                continue
            if len(child.text) > room:
                cut = True
                continue
            room -= len(child.text)
            seen.add(key)
            work.append(child)
    every = sorted(((*s, d) for s, d in found.items()), key=lambda s: (s[1], order[s[0]], s[2]))
    return base, every, layers, cut


_TYPE = (
    "base array<struct<kind:string,start:int,end:int>>, "
    "every array<struct<kind:string,start:int,end:int,depth:int>>, layers int, truncated boolean"
)


def _scanner(layer_bytes: int | None):
    def scan_texts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                base, every, layers, cut = scan(t, layer_bytes)
                rows.append(
                    (
                        [dict(zip(("kind", "start", "end"), s, strict=True)) for s in base],
                        [dict(zip(("kind", "start", "end", "depth"), s, strict=True)) for s in every],
                        layers,
                        cut,
                    )
                )
            yield pd.DataFrame(rows, columns=["base", "every", "layers", "truncated"])

    scan_texts.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(scan_texts, _TYPE)


def find_secrets(docs: DataFrame, text_col: str = "text", layer_bytes: int | None = LAYER_BYTES) -> DataFrame:
    """The documents with a column `secrets`: base spans, every span with the depth of its
    layer, the number of layers, and whether the limit was met."""
    return docs.withColumn(free_name(docs, "secrets"), _scanner(layer_bytes)(F.col(text_col)))


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secrets_report(docs: DataFrame) -> DataFrame:
    """One row a document: counts of base spans, their digest, all spans."""
    s = F.col("secrets")
    count = lambda k: F.size(F.filter(s["base"], lambda x: x["kind"] == k)).cast("long")
    return find_secrets(docs.select("doc_id", "text")).select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(_joined(s["base"]).cast("binary"), 256).alias("base_sha256"),
        _joined(s["every"]).alias("spans"),
        s["layers"].alias("layers"),
        s["truncated"].alias("truncated"),
    )


def redact(text: str | None, spans: list[tuple[int, int]], mark: str = "[secret]") -> str | None:
    """The text with the union of the spans replaced."""
    out, last = [], 0
    for a, b in sorted(spans):
        if a >= last:
            out += [text[last:a], mark]
        last = max(last, b)
    return text if not out else "".join([*out, text[last:]])


def _redact_texts(texts: pd.Series) -> pd.Series:
    return pd.Series([redact(t, [s[1:3] for s in scan(t)[1]]) for t in texts], dtype=object)


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with all spans of secrets replaced; all columns stay."""
    return docs.withColumn(text_col, F.pandas_udf(_redact_texts, "string")(F.col(text_col)))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_report(read_table(spark, sf_dir, "documents"))


QUERIES = {"op2_secrets": op2_secrets}
ORACLES: dict[str, str] = {}
