"""Secret scan with a recursive decoding worklist.

Every text is scanned as it is; these spans are the base. Then layers go through a worklist: URL escapes, Unicode
escapes, base64 and compressed data are unwrapped in a layer, each kind on its own, and what comes out is a new layer
with, for each of its characters, the span of the text it came from. New layers are scanned and unwrapped again until
none is new. A layer that was met before with the same content at the same place is not entered again, so
content that unwraps to itself ends. A layer is the line around what was unwrapped: no pattern runs over a line
break, and neighbours count (a decoded `=` between a plain name and a plain value makes an assignment).

A match in a layer counts if it holds an unwrapped character, and is reported as the span of the text that it came
from: exact for URL and Unicode escapes, to the base64 characters that share its bits, the whole run for compressed
data. Compressed data is read in windows of bounded size that end at line breaks; a line longer than
`LONGEST_LINE` in there is cut, with `OVERLAP` characters in both parts.

Defined cases: null and empty texts have no spans; rows that repeat or have a null id are scanned alike; what cannot be
decoded stays as it is; of damaged compressed data the part before the damage counts. Extra columns are kept; new ones
get underscores behind names that are taken. Offsets count code points.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import io
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablewright.llm.base import free_name, query, quoted, table

# What counts as a secret, and the least length of the match (of its second group for assignments).
PATTERNS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile("[0-9a-f]+"), 0, 16),
}
# The same matches, looked for where there can be one only.
LONG_HEX = re.compile("(?<![0-9a-f])[0-9a-f]{16,}")
NAMES = re.compile("password|passwd|secret|token|api_?key", re.I | re.A)

ESCAPED = re.compile("(?:%[0-9A-Fa-f]{2})+")
ESCAPED_RUN = re.compile("[A-Za-z0-9._~/%-]+")
UNICODE = re.compile(
    r"(?P<pair>\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2})|(?P<bytes>(?:\\x[0-9A-Fa-f]{2})+)|\\u(?P<four>[0-9A-Fa-f]{4})"
    r"|\\U(?P<eight>[0-9A-Fa-f]{8})|\\u\{(?P<braced>[0-9A-Fa-f]{1,6})\}|&#(?P<number>[0-9]{1,7});|&#[xX](?P<hex>[0-9A-Fa-f]{1,6});"
)
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:(?:[A-Za-z0-9+/]{60,76}\r?\n)+[A-Za-z0-9+/]{1,76}|[A-Za-z0-9+/_-]{16,})={0,2}")
NOT_BASE64 = re.compile("[^A-Za-z0-9+/]+")
PRINTABLE = re.compile(rb"(?:[\x20-\x7E\t\r\n]|[\xC2-\xDF][\x80-\xBF]|[\xE0-\xEF][\x80-\xBF]{2}|[\xF0-\xF4][\x80-\xBF]{3}){12,}")
MAGIC = {b"\x1f\x8b\x08": "gzip", b"BZh": "bzip2", b"\xfd7zXZ\x00": "xz", b"\x28\xb5\x2f\xfd": "zstd"}
READ_BYTES = 1 << 20
WINDOW = 4 << 20
LONGEST_LINE, OVERLAP = 32 << 20, 1 << 16

SPANS = "array<struct<kind string, start int, end int, path string>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("path", pa.string())]))


@dataclass
class Layer:
    """Text, and for each character the span it came from and whether it was unwrapped; without `start` it is the text itself."""

    text: str
    path: tuple[str, ...] = ()
    start: np.ndarray | None = None
    end: np.ndarray | None = None
    fresh: np.ndarray | None = None

    def part(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.start is None:
            return np.arange(a, b), np.arange(a + 1, b + 1), np.zeros(b - a, bool)
        return self.start[a:b], self.end[a:b], self.fresh[a:b]


@dataclass
class Unwrapped:
    """What stands in place of [start, end) of a layer, with the layer's span of each new character; or compressed data."""

    start: int
    end: int
    text: str = ""
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None
    data: bytes = b""


def matches(text: str) -> Iterator[tuple[str, int, int]]:
    for kind, (pattern, group, least) in PATTERNS.items():
        if kind == "hex":
            yield from ((kind, *m.span()) for m in LONG_HEX.finditer(text))
        elif kind == "access" and "AKIA" in text or kind == "assign" and NAMES.search(text):
            yield from ((kind, *m.span()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least)


def packed(data: bytes) -> str | None:
    """How data is compressed, by its first bytes."""
    for head, name in MAGIC.items():
        if data.startswith(head):
            return name
    return "zlib" if len(data) > 6 and data[0] == 0x78 and data[1] in (0x01, 0x5E, 0x9C, 0xDA) else None


def unpacked(data: bytes, how: str) -> Iterator[bytes]:
    """Pieces of bounded size; ends at the first damage."""
    if how in ("gzip", "zlib"):
        reader = zlib.decompressobj(47)
        while data and not reader.eof:
            yield reader.decompress(data, READ_BYTES)
            data = reader.unconsumed_tail
        return
    source = io.BytesIO(data)
    reader = {"bzip2": bz2.BZ2File, "xz": lzma.LZMAFile, "zstd": lambda x: zstandard.ZstdDecompressor().stream_reader(x)}[how](source)
    while piece := reader.read(READ_BYTES):
        yield piece


def windows(data: bytes, how: str) -> Iterator[str]:
    """Decompressed text in windows that end at line breaks."""
    decoder, held = codecs.getincrementaldecoder("utf-8")("surrogateescape"), ""
    pieces = unpacked(data, how)
    while True:
        try:
            piece = next(pieces, None)
        except (OSError, EOFError, ValueError, zlib.error, lzma.LZMAError, zstandard.ZstdError):
            piece = None
        if piece is None:
            break
        held += decoder.decode(piece)
        if len(held) >= WINDOW:
            cut = held.rfind("\n") + 1
            if cut:
                yield held[:cut]
                held = held[cut:]
            elif len(held) >= LONGEST_LINE:
                yield held
                held = held[-OVERLAP:]
    if held:
        yield held


def decoded(raw: bytes, begin: int, width: int) -> Unwrapped:
    """Bytes that were written with `width` characters each, from place `begin` on; bytes that are no text stand for themselves."""
    text = raw.decode("utf-8", "surrogateescape")
    sizes = np.array([len(c.encode("utf-8", "surrogateescape")) for c in text], np.int64) if len(text) < len(raw) else np.ones(len(text), np.int64)
    ends = begin + np.cumsum(sizes) * width
    return Unwrapped(begin, begin + len(raw) * width, text, ends - sizes * width, ends)


def from_url(text: str) -> Iterator[Unwrapped]:
    if "%" not in text:
        return
    for m in ESCAPED_RUN.finditer(text):
        if not text.startswith(("%1F%8B", "%1f%8b", "%28", "%FD", "%fd", "BZh", "x%"), m.start()) or "%" not in m.group():
            continue
        data = unquote_to_bytes(m.group())
        if packed(data):
            yield Unwrapped(*m.span(), data=data)
    for m in ESCAPED.finditer(text):
        yield decoded(unquote_to_bytes(m.group()), m.start(), 3)


def from_unicode(text: str) -> Iterator[Unwrapped]:
    if "\\" not in text and "&#" not in text:
        return
    for m in UNICODE.finditer(text):
        kind, a, b = m.lastgroup, *m.span()
        if kind == "bytes":
            data = bytes.fromhex(m.group().replace("\\x", ""))
            if packed(data):
                yield Unwrapped(a, b, data=data)
            yield decoded(data, a, 4)
            continue
        if kind == "pair":
            code = 0x10000 + ((int(m.group()[2:6], 16) & 0x3FF) << 10) + (int(m.group()[8:12], 16) & 0x3FF)
        else:
            code = int(m.group(kind), 10 if kind == "number" else 16)
        if code <= 0x10FFFF:
            yield Unwrapped(a, b, chr(code), np.array([a]), np.array([b]))


def from_base64(text: str) -> Iterator[Unwrapped]:
    for m in BASE64.finditer(text):
        run = m.group()
        signs = run.rstrip("=").replace("-", "+").replace("_", "/")
        places = None
        if "\n" in signs:
            places = np.flatnonzero(np.array([c not in "\r\n" for c in signs]))
            signs = NOT_BASE64.sub("", signs)
        best = None
        for shift in range(4):
            some = signs[shift:]
            some = some[: len(some) - (len(some) % 4 == 1)]
            data = base64.b64decode(some + "=" * (-len(some) % 4))
            if shift == 0 and packed(data):
                yield Unwrapped(*m.span(), data=data)
                best = None
                break
            for found in PRINTABLE.finditer(data):
                if best is None or len(found.group()) > len(best[1]):
                    best = (shift, found.group(), found.start())
            if shift == 0 and best and len(best[1]) == len(data):
                break  # all of it is text
        if best is None:
            continue
        shift, raw, first = best
        try:
            content = raw.decode()
        except UnicodeDecodeError:  # looks like text, but is none (a surrogate, an overlong form)
            continue
        sizes = np.array([len(c.encode()) for c in content], np.int64)
        stop = first + np.cumsum(sizes)
        low, high = 8 * (stop - sizes) // 6 + shift, (8 * stop - 1) // 6 + shift
        if places is not None:
            low, high = places[low], places[high]
        low, high = low + m.start(), high + 1 + m.start()
        yield Unwrapped(int(low[0]), int(high[-1]), content, low, high)


DECODERS = {"url": from_url, "unicode": from_unicode, "base64": from_base64}


def by_line(text: str, found: list[Unwrapped]) -> Iterator[tuple[int, int, list[Unwrapped]]]:
    """Lines around what was unwrapped, each with all that lies in it."""
    held, low, high = [], 0, -1
    for x in found:
        if held and x.start >= high:
            yield low, high, held
            held = []
        if not held:
            low = text.rfind("\n", 0, x.start) + 1
        held.append(x)
        high = text.find("\n", x.end)
        high = len(text) if high < 0 else high
    if held:
        yield low, high, held


def inside(layer: Layer) -> Iterator[Layer]:
    """Layers that one more unwrapping of any kind gives."""
    for name, decoder in DECODERS.items():
        found = list(decoder(layer.text))
        for x in (x for x in found if x.data):
            how = packed(x.data)
            starts, ends, _ = layer.part(x.start, x.end)
            for text in windows(x.data, how):
                yield Layer(text, (*layer.path, name, how), np.full(len(text), starts[0]), np.full(len(text), ends[-1]), np.ones(len(text), bool))
        for low, high, held in by_line(layer.text, [x for x in found if not x.data]):
            texts, maps, at = [], [], low
            for x in held:
                texts += [layer.text[at : x.start], x.text]
                maps.append(layer.part(at, x.start))
                starts, ends, _ = layer.part(x.start, x.end)
                maps.append((starts[x.starts - x.start], ends[x.ends - 1 - x.start], np.ones(len(x.text), bool)))
                at = x.end
            texts.append(layer.text[at:high])
            maps.append(layer.part(at, high))
            yield Layer("".join(texts), (*layer.path, name), *(np.concatenate(x) for x in zip(*maps)))


def scan(text: str | None) -> list[tuple[str, int, int, str]]:
    """kind, start, end, path of all spans, by start, kind and end; the path of base spans is empty."""
    if not text:
        return []
    found = {x: "" for x in matches(text)}
    work, seen = deque([Layer(text)]), set()
    while work:
        for layer in inside(work.popleft()):
            if not layer.text:
                continue
            name = (int(layer.start[0]), int(layer.end[-1]), hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest())
            if name in seen:
                continue
            seen.add(name)
            work.append(layer)
            for kind, a, b in matches(layer.text):
                if layer.fresh[a:b].any():
                    found.setdefault((kind, int(layer.start[a]), int(layer.end[b - 1])), ">".join(layer.path))
    order = {kind: k for k, kind in enumerate(PATTERNS)}
    return sorted(((*x, path) for x, path in found.items()), key=lambda x: (x[1], order[x[0]], x[2]))


def text_of(raw: bytes | None) -> str | None:
    return None if raw is None else raw.decode("utf-8", "replace")


def spans_column(text: Column) -> Column:
    """All spans of a text, base spans with an empty path."""

    @F.arrow_udf(SPANS)
    def scanned(texts: pa.Array) -> pa.Array:
        rows = ([dict(zip(("kind", "start", "end", "path"), x)) for x in scan(text_of(t.as_py()))] for t in texts.cast(pa.binary()))
        return pa.array(rows, SPAN_TYPE)

    return scanned(text)


def masked_column(text: Column, spans: Column) -> Column:
    """The text with each union of overlapping spans replaced by the kinds in it, in brackets."""

    @F.arrow_udf("string")
    def masked(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for raw, spans in zip(texts.cast(pa.binary()), found):
            whole, parts, at = text_of(raw.as_py()), [], 0
            held = sorted((x["start"], x["end"], x["kind"]) for x in spans.as_py() or [])
            while held and whole is not None:
                start, end, kind = held.pop(0)
                kinds = [kind]
                while held and held[0][0] < end:
                    _, stop, kind = held.pop(0)
                    end, kinds = max(end, stop), kinds + [kind] * (kind not in kinds)
                parts += [whole[at:start], f"[{'+'.join(kinds)}]"]
                at = end
            out.append(None if whole is None else "".join(parts) + whole[at:])
        return pa.array(out, pa.string())

    return masked(text, spans)


def find_secrets(df: DataFrame, text_col: str = "text") -> DataFrame:
    """`df` with secrets, an array of (kind, start, end, path)."""
    return df.withColumn(free_name("secrets", df.columns), spans_column(quoted(text_col)))


def mask_secrets(df: DataFrame, text_col: str = "text") -> DataFrame:
    """`df` with the text masked wherever a secret was found, base or unwrapped, and secrets beside it."""
    name = free_name("secrets", df.columns)
    return find_secrets(df, text_col).withColumn(text_col, masked_column(quoted(text_col), F.col(name)))


@query("op11_secret_scan")
def op11_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = find_secrets(table(spark, folder, "documents").select("doc_id", "text"))
    written = "concat_ws(',', transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)))"
    base = "filter(secrets, s -> s.path = '')"
    count = "cast(size(filter(secrets, s -> s.path = '' AND s.kind = '{0}')) AS bigint) AS n_{0}"
    return found.selectExpr(
        "doc_id", *(count.format(kind) for kind in PATTERNS), f"sha2({written.format(base)}, 256) AS base_sha256",
        f"{written.format('secrets')} AS spans",
    )
