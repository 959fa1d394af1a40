"""Secret scans: credentials in plain sight, and those behind nested encodings, with their places in the original text."""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from wardflow.llm.common import bounded_batches, byte_values, pick

# The kinds of findings in the order of results, their patterns and shortest lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST = 8

URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+")
ONE_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#([0-9]+);|&#[xX]([0-9A-Fa-f]+);")
#: The shortest secret takes more than 16 letters of base64.
BASE64 = re.compile(r"[A-Za-z0-9+/]{16,}(?:\r?\n[A-Za-z0-9+/]{4,})*|[A-Za-z0-9_-]{16,}")
#: A compressed layer is unwrapped up to this size; a larger one is counted in ``n_oversized``.
LAYER_BYTES = 64 << 20

# What has to be in a text, lower-cased for words, before its patterns are worth a search.
WORDS = (b"passw", b"secret", b"token", b"api")
HINTS = [re.compile(p) for p in (rb"[0-9a-f]{32}", rb"%[0-9A-Fa-f]{2}", rb"\\[uUx]|&#", rb"[A-Za-z0-9+/_-]{16}")]

FOUND = "array<struct<kind:string,start:long,end:long,depth:int,path:string,match:string>>"


class Layer(NamedTuple):
    """A decoded text or byte string; element i comes from the original's code points ``starts[i]`` to ``ends[i]``."""

    content: str | bytes
    starts: np.ndarray
    ends: np.ndarray
    path: tuple[str, ...]


def matches(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the leftmost matches that are long enough, kind by kind."""
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= ASSIGN_LEAST:
            yield "assign", m.start(), m.end()
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):
        for m in pattern.finditer(text):
            yield kind, m.start(), m.end()


def _utf8_places(data: bytes) -> np.ndarray:
    """The first byte of every code point."""
    return np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)


def _percent(run: str) -> tuple[str, np.ndarray]:
    data = bytes.fromhex(run.replace("%", ""))
    try:
        return data.decode(), 3 * np.append(_utf8_places(data), len(data))
    except UnicodeDecodeError:
        return data.decode("latin-1"), 3 * np.arange(len(data) + 1)


def _escapes(run: str) -> tuple[str, np.ndarray]:
    points, places = [], []
    for m in ONE_ESCAPE.finditer(run):
        digits = next(g for g in m.groups() if g)
        point = int(digits, 10 if m.group(5) else 16)
        if points and 0xD800 <= points[-1] < 0xDC00 <= point < 0xE000:
            points[-1] = 0x10000 + ((points[-1] - 0xD800) << 10) + point - 0xDC00
            continue
        points.append(point)
        places.append(m.start())
    return "".join(chr(p) if p < 0xD800 or 0xE000 <= p < 0x110000 else "\ufffd" for p in points), np.array([*places, len(run)])


def _substituted(layer: Layer, pattern: re.Pattern, decode, name: str) -> Layer | None:
    """The whole text with every run of the pattern decoded in its place; None if there is none."""
    text, parts, starts, ends, at = layer.content, [], [], [], 0
    for m in pattern.finditer(text):
        plain, bounds = decode(m.group())
        parts += [text[at : m.start()], plain]
        starts += [layer.starts[at : m.start()], layer.starts[m.start() + bounds[:-1]]]
        ends += [layer.ends[at : m.start()], layer.ends[m.start() + bounds[1:] - 1]]
        at = m.end()
    if not parts:
        return None
    return Layer("".join([*parts, text[at:]]), np.concatenate([*starts, layer.starts[at:]]), np.concatenate([*ends, layer.ends[at:]]), (*layer.path, name))


def _from_base64(layer: Layer) -> Iterator[Layer]:
    """A layer of bytes for every run of base64 letters, wrapped lines as one run and by themselves."""
    for m in BASE64.finditer(layer.content):
        runs = [(m.start(), m.end())]
        if "\n" in m.group():
            runs += [(m.start() + x.start(), m.start() + x.end()) for x in re.finditer(r"[^\r\n]{16,}", m.group())]
        for a, b in runs:
            letters = np.array([i for i in range(a, b) if layer.content[i] not in "\r\n"]) if b - a != len(layer.content[a:b].replace("\n", "")) else np.arange(a, b)
            letters = letters[: len(letters) - (len(letters) % 4 == 1)]
            code = layer.content[a:b].replace("\r", "").replace("\n", "")[: len(letters)].replace("-", "+").replace("_", "/")
            try:
                data = base64.b64decode(code + "=" * (-len(code) % 4), validate=True)
            except binascii.Error:
                continue
            octet = np.arange(len(data))
            first, last = letters[8 * octet // 6], letters[(8 * octet + 7) // 6]
            yield Layer(data, layer.starts[first], layer.ends[last], (*layer.path, "base64"))


def _inflated(data: bytes) -> tuple[str, bytes | None] | None:
    """The name of the compression and what was compressed (None beyond the largest layer); None if it is no such stream."""
    try:
        if data[:2] == b"\x1f\x8b" or data[:1] == b"\x78" and len(data) > 6 and (data[0] * 256 + data[1]) % 31 == 0:
            machine, name = zlib.decompressobj(47), "gzip" if data[0] == 0x1F else "zlib"
        elif data[:3] == b"BZh":
            machine, name = bz2.BZ2Decompressor(), "bzip2"
        elif data[:6] == b"\xfd7zXZ\x00":
            machine, name = lzma.LZMADecompressor(memlimit=LAYER_BYTES), "xz"
        elif data[:4] == b"\x28\xb5\x2f\xfd":
            with zstandard.ZstdDecompressor(max_window_size=LAYER_BYTES).stream_reader(data) as reader:
                out = reader.read(LAYER_BYTES + 1)
            return "zstd", out if len(out) <= LAYER_BYTES else None
        else:
            return None
        out = machine.decompress(data, LAYER_BYTES + 1)
        return name, out if len(out) <= LAYER_BYTES else None
    except (zlib.error, OSError, ValueError, EOFError, lzma.LZMAError, zstandard.ZstdError):
        return None


def _as_text(layer: Layer) -> Layer | None:
    """A byte string that is readable UTF-8, or UTF-16 of mostly Latin letters, as text."""
    data = layer.content
    if len(data) >= 4 and len(data) % 2 == 0 and data[1::2].count(0) * 4 > len(data):
        places, coding = np.arange(0, len(data), 2), "utf-16-le"
    else:
        places, coding = _utf8_places(data), "utf-8"
    try:
        text = data.decode(coding)
    except UnicodeDecodeError:
        return None
    if len(text) != len(places) or re.search(r"[\x00-\x08\x0e-\x1f\x7f]", text):
        return None
    return Layer(text, layer.starts[places], layer.ends[np.append(places[1:], len(data)) - 1], layer.path)


def _unwrapped(layer: Layer) -> tuple[list[Layer], int]:
    """The layers right below one, and how many were too large to unwrap."""
    if isinstance(layer.content, bytes):
        opened = _inflated(layer.content)
        if opened is None:
            text = _as_text(layer) if layer.content else None
            return ([text] if text else []), 0
        name, data = opened
        if data is None:
            return [], 1
        # A compressed byte has no single origin: all come from the whole stream.
        span = np.broadcast_to(layer.starts.min(), len(data)), np.broadcast_to(layer.ends.max(), len(data))
        return [Layer(data, *span, (*layer.path, name))], 0
    below = [_substituted(layer, URL, _percent, "url"), _substituted(layer, ESCAPE, _escapes, "unicode")]
    return [x for x in below if x is not None] + list(_from_base64(layer)), 0


def scan(text: bytes) -> tuple[list[tuple], int]:
    """All findings of a text, (kind, start, end, depth, path, match), and the number of layers too large to unwrap.

    A worklist starts with the text itself. Every layer is searched, its
    findings are mapped to the original's code points, and the layers below
    it are added, until nothing new appears. A layer with the content and
    the place of one that was done already is not done again, which ends
    streams that unpack to themselves.
    """
    lowered = text.lower()
    if not (b"AKIA" in text or any(w in lowered for w in WORDS) or any(h.search(text) for h in HINTS)):
        return [], 0
    plain = text.decode("utf-8", "replace")
    found: dict[tuple, tuple] = {(k, a, b): (0, "", plain[a:b]) for k, a, b in matches(plain)}
    if not any(h.search(text) for h in HINTS[1:]):
        work = []
    else:
        work = [Layer(plain, np.arange(len(plain)), np.arange(1, len(plain) + 1), ())]
    seen, oversized = set(), 0
    while work:
        layer = work.pop()
        if not len(layer.content):
            continue
        raw = layer.content if isinstance(layer.content, bytes) else layer.content.encode("utf-8", "surrogatepass")
        key = (isinstance(layer.content, bytes), int(layer.starts[0]), int(layer.ends[-1]), hashlib.sha256(raw).digest())
        if key in seen:
            continue
        seen.add(key)
        if isinstance(layer.content, str) and layer.path:
            for kind, a, b in matches(layer.content):
                place = (kind, int(layer.starts[a]), int(layer.ends[b - 1]))
                found.setdefault(place, (len(layer.path), ">".join(layer.path), layer.content[a:b]))
        below, large = _unwrapped(layer)
        work += below
        oversized += large
    rows = [(*place, *rest) for place, rest in found.items()]
    return sorted(rows, key=lambda r: (r[1], KINDS.index(r[0]), r[2])), oversized


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("kind", "start", "end", "depth", "path", "match")
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("depth", pa.int32()), ("path", pa.string()), ("match", pa.string())]))
    for batch in batches:
        results = [scan(t) for t in byte_values(batch.column("text"))]
        found = pa.array([[dict(zip(names, row)) for row in rows] for rows, _ in results], kinds)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), found, pa.array([n for _, n in results], pa.int64())], ["doc_id", "found", "n_oversized"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``found`` and ``n_oversized`` for every document.

    ``found`` lists (kind, start, end, depth, path, match) by start, then
    kind, then end; ``start`` and ``end`` are code points of the original
    text, ``path`` the encodings that were unwrapped (``url>base64>gzip``),
    ``depth`` their number. Findings of depth 0 are those of the text itself;
    deeper ones are added where their place differs from all shallower ones.
    A finding inside a compressed stream has the place of the stream.

    * null and empty texts have no findings; rows with null or repeated ids stay rows of their own.
    * layers are unwrapped whole; only a compressed layer of over 64 MB is not, and is counted in ``n_oversized``.
    * an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    base = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return base.mapInArrow(_scan, f"doc_id long, found {FOUND}, n_oversized long")


def spans_text(found: Column) -> Column:
    """``kind:start:end`` of a list of findings, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_digests(found: DataFrame) -> DataFrame:
    """One row per document: counts and digest of its plain findings, and the places of all."""
    base = F.filter("found", lambda x: x["depth"] == 0)
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("found")).alias("spans"), "n_oversized",
    )
