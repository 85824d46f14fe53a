"""Secret scans of whole texts, through nested encodings.

The text itself is the first layer of a worklist. From each layer further ones are made: the layer with its %XX escapes
decoded, the layer with its Unicode escapes and character references decoded, and for each run of base64 letters what it
decodes to, from each of the four alignments, unpacked where compressed data begins. Every new layer is scanned again, until
none is left; a layer with a content seen before at the very same place of the text is not taken up again, and compressed
data that unpacks to what was unpacked before on the way is left alone, so cycles end; equal contents at other places are
told there too. Each character of a layer carries the span of the text that it came from, so what is found is told in code
points of the text, end exclusive.

Layers are made one after the other, depth first, so that one chain of them is held at a time. Unpacked data of any size is
read as a stream, in windows of `WINDOW` bytes that overlap by `OVERLAP`; so are long decoded runs. Nothing is left unopened;
an encoded run inside such data that is longer than the overlap and crosses a window's end is read as its two parts.

Defined results: null counts as the empty text, which has no spans. Of one kind, matches in one layer are leftmost and do
not overlap; a match that is too short is dropped after it has consumed its characters. A decoded match that has the very
span of one in the text itself is told once, as the latter. Repeated rows give repeated results; further columns are
ignored, whatever their names. Damaged compressed data counts as far as it can be read.
"""

from __future__ import annotations

import base64
import bz2
import gzip
import io
import lzma
import re
import zlib
from collections.abc import Callable, Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, textscan

# The kinds in the order in which spans of one start are told, and their patterns and least lengths.
KINDS = ["assign", "access", "hex"]
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX, LEAST_BASE64 = 6, 20, 24, 16
#: Bytes of decoded data that are scanned at once, and by how many two windows overlap.
WINDOW, OVERLAP = 4 << 20, 1 << 20

_ESCAPED_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPED = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|((?:\\u[0-9A-Fa-f]{4})+)|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
_HEX, _BASE64 = 1, 2


def _flags() -> np.ndarray:
    out = np.zeros(129, np.uint8)
    out[[ord(c) for c in "0123456789abcdef"]] |= _HEX
    out[[c for c in range(128) if chr(c).isalnum() or chr(c) in "+/-_"]] |= _BASE64
    return out


_FLAGS = _flags()


def _runs(text: str, bit: int, least: int, flagged: list[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
    """Maximal runs of flagged characters, of at least so many."""
    found = []
    for at, flags in flagged:
        starts, ends = textscan.runs((flags & bit) > 0, np.empty(0, np.int64))
        keep = ends - starts >= least
        found += zip((starts[keep] + at).tolist(), (ends[keep] + at).tolist(), strict=True)
    return found


def _flagged(text: str) -> list[tuple[int, np.ndarray]]:
    out, at = [], 0
    for part in textscan.split_long(text):
        out.append((at, _FLAGS[np.minimum(textscan.codepoints(part), 128)]))
        at += len(part)
    return out


def base_matches(text: str, flagged: list[tuple[int, np.ndarray]]) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of each match in one layer, in order."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(a, 2, b) for a, b in _runs(text, _HEX, LEAST_HEX, flagged)]
    return sorted(found)


class Layer:
    """A text with the span of the first text that each of its characters came from; None: it is the first."""

    def __init__(self, text: str, starts: np.ndarray | None, ends: np.ndarray | None, via: str):
        self.text, self.starts, self.ends, self.via = text, starts, ends, via

    def origin(self, start: int, end: int) -> tuple[int, int]:
        if self.starts is None:
            return start, end
        return int(self.starts[start:end].min()), int(self.ends[start:end].max())

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        if self.starts is None:
            at = np.arange(len(self.text), dtype=np.int64)
            return at, at + 1
        return self.starts, self.ends

    def spans_at(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans from the characters at `first` to those at `last`, as starts and ends."""
        return (first, last + 1) if self.starts is None else (self.starts[first], self.ends[last])

    def name(self) -> bytes:
        """A digest of the content and of the place of each character in the first text."""
        out = sha256(self.text.encode("utf-8", "surrogatepass"))
        if self.starts is not None and len(self.text):
            one = self.starts[0] == self.starts[-1] and self.ends[0] == self.ends[-1]  # spans ascend
            for x in (self.starts, self.ends):
                out.update(b"|" + np.ascontiguousarray(x[:1] if one else x).tobytes())
        return out.digest()

    def replaced(self, changes: list[tuple[int, int, list[tuple[str, int, int]]]], via: str) -> Layer:
        """A layer in which each (start, end) has become characters, each with its own span."""
        starts, ends = self.arrays()
        text, first, last, at = [], [], [], 0
        for start, end, made in changes:
            text.append(self.text[at:start])
            first.append(starts[at:start])
            last.append(ends[at:start])
            text += [c for c, _, _ in made]
            first.append(np.array([starts[a] for _, a, _ in made], np.int64))
            last.append(np.array([ends[b - 1] for _, _, b in made], np.int64))
            at = end
        text.append(self.text[at:])
        first.append(starts[at:])
        last.append(ends[at:])
        return Layer("".join(text), np.concatenate(first), np.concatenate(last), f"{self.via}>{via}".lstrip(">"))


def _characters(data: bytes) -> list[tuple[str, int, int]]:
    """Characters of bytes in UTF-8 with their byte spans; a byte that belongs to none becomes U+FFFD."""
    out, at = [], 0
    while at < len(data):
        size = 1 if data[at] < 0x80 else 2 if data[at] >> 5 == 6 else 3 if data[at] >> 4 == 14 else 4 if data[at] >> 3 == 30 else 1
        try:
            out.append((data[at : at + size].decode("utf-8"), at, at + size))
        except UnicodeDecodeError:
            size = 1
            out.append(("\ufffd", at, at + 1))
        at += size
    return out


def _from_url(layer: Layer) -> Layer | None:
    if "%" not in layer.text:
        return None
    changes = []
    for m in _ESCAPED_URL.finditer(layer.text):
        at = m.start()
        data = bytes.fromhex(m.group().replace("%", ""))
        changes.append((at, m.end(), [(c, at + 3 * a, at + 3 * b) for c, a, b in _characters(data)]))
    return layer.replaced(changes, "url") if changes else None


def _from_escapes(layer: Layer) -> Layer | None:
    if "\\" not in layer.text and "&#" not in layer.text:
        return None
    changes = []
    for m in _ESCAPED.finditer(layer.text):
        at, end = m.span()
        if m[3]:
            units = [int(m[3][i + 2 : i + 6], 16) for i in range(0, len(m[3]), 6)]
            made, i = [], 0
            while i < len(units):
                if 0xD800 <= units[i] < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1] < 0xE000:
                    made.append((chr(0x10000 + ((units[i] - 0xD800) << 10) + units[i + 1] - 0xDC00), at + 6 * i, at + 6 * i + 12))
                    i += 2
                else:
                    made.append(("\ufffd" if 0xD800 <= units[i] < 0xE000 else chr(units[i]), at + 6 * i, at + 6 * i + 6))
                    i += 1
        else:
            code = int(m[6]) if m[6] else int(m[1] or m[2] or m[4] or m[5], 16)
            made = [(chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd", at, end)]
        changes.append((at, end, made))
    return layer.replaced(changes, "unicode") if changes else None


def _kind(data: bytes) -> str | None:
    """The format of compressed data that begins like this."""
    if data[:2] == b"\x1f\x8b":
        return "gzip"
    if len(data) > 2 and data[0] & 15 == 8 and data[0] >> 4 <= 7 and (data[0] << 8 | data[1]) % 31 == 0:
        return "zlib"
    return "bzip2" if data[:3] == b"BZh" else "xz" if data[:6] == b"\xfd7zXZ\x00" else "zstd" if data[:4] == b"\x28\xb5\x2f\xfd" else None


class _Pipe(io.RawIOBase):
    """A stream over chunks of bytes."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.rest = chunks, memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.rest:
            chunk = next(self.chunks, None)
            if chunk is None:
                return 0
            self.rest = memoryview(chunk)
        n = min(len(buffer), len(self.rest))
        buffer[:n] = self.rest[:n]
        self.rest = self.rest[n:]
        return n


class _Zlib(io.RawIOBase):
    """Zlib streams that follow each other."""

    def __init__(self, source: io.BufferedReader):
        self.source, self.machine = source, zlib.decompressobj()

    def read1(self, size: int) -> bytes:
        while True:
            if self.machine.eof:
                rest = self.machine.unused_data or self.source.read(1 << 16)
                if _kind(rest) != "zlib":
                    return b""
                self.machine = zlib.decompressobj()
            else:
                rest = self.machine.unconsumed_tail or self.source.read(1 << 16)
            out = self.machine.decompress(rest, size)
            if out or not rest:
                return out


_DAMAGED = (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError)


def unpacked(chunks: Iterator[bytes], kind: str) -> Iterator[bytes]:
    """What all members of compressed data hold, in pieces, up to the first damage."""
    source = io.BufferedReader(_Pipe(chunks))
    try:
        if kind == "zstd":
            reader = zstandard.ZstdDecompressor().stream_reader(source, read_across_frames=True)
            read = reader.read
        else:
            read = {"gzip": lambda f: gzip.GzipFile(fileobj=f), "zlib": _Zlib, "bzip2": bz2.BZ2File, "xz": lzma.LZMAFile}[kind](source).read1
        while part := read(1 << 16):
            yield part
    except _DAMAGED:
        return


def _windows(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The data in windows that overlap."""
    kept, size = [], 0
    for chunk in chunks:
        kept.append(chunk)
        size += len(chunk)
        if size >= WINDOW + OVERLAP:
            whole = b"".join(kept)
            for at in range(0, len(whole) - WINDOW - OVERLAP + 1, WINDOW):
                yield whole[at : at + WINDOW + OVERLAP]
            whole = whole[(len(whole) - OVERLAP) // WINDOW * WINDOW :]
            kept, size = [whole], len(whole)
    if size:
        yield b"".join(kept)


def _contents(make: Callable[[], Iterator[bytes]], kinds: str) -> Iterator[tuple[bytes, str]]:
    """Windows of what compressed data holds, unpacked again and again, and the formats on the way; nothing if it is not compressed.

    `make` gives the data anew each time. Data that was met before on the way is a cycle, and ends there.
    """
    met: set[bytes] = set()
    kind, found = _kind(_head(make())), False
    while kind is not None:
        name = _digest(make())
        if name in met:
            return
        met.add(name)
        inner = _unpacking(make, kind)
        head = _head(inner())
        if not head:  # it only looked compressed
            break
        make, kinds, kind, found = inner, f"{kinds}>{kind}", _kind(head), True
    if found:
        yield from ((window, kinds) for window in _windows(make()))


def _unpacking(make: Callable[[], Iterator[bytes]], kind: str) -> Callable[[], Iterator[bytes]]:
    return lambda: unpacked(make(), kind)


def _head(chunks: Iterator[bytes]) -> bytes:
    out = b""
    for chunk in chunks:
        out += chunk
        if len(out) >= 8:
            break
    return out


def _digest(chunks: Iterator[bytes]) -> bytes:
    out = sha256()
    for chunk in chunks:
        out.update(chunk)
    return out.digest()


#: What bytes must hold for a match or for a further layer.
_COULD = re.compile(rb"(?i:password|passwd|secret|token|api_?key)|AKIA|[A-Za-z0-9+/_-]{16}|%[0-9A-Fa-f]{2}|\\[uUx]|&#")
#: Base64 of the first bytes of compressed data; a run is opened at each, and after each separator.
_PACKED = re.compile(r"H4sI|Qlpo|/Td6WFo|KLUv/|eA[E-H]|eF[4-7]|eJ[w-z]|eN[o-r]")
_SEPARATOR = re.compile(r"[/_-]")
_LONE = re.compile("[\udc80-\udcff]")
_STANDARD = str.maketrans("-_", "+/")


def _texts(data: bytes) -> Iterator[tuple[str, np.ndarray | None]]:
    """Texts that bytes may be, with the size of each character: in UTF-8, where bytes that belong to none become U+FFFD, and in UTF-16 (None) if every other byte is zero."""
    if _COULD.search(data):
        text = data.decode("utf-8", "surrogateescape")
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        lone = (cp >= 0xDC80) & (cp <= 0xDCFF)
        yield _LONE.sub("\ufffd", text), np.where(lone, 1, 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000))
    for at, code in ((1, "utf-16-le"), (0, "utf-16-be")):
        if len(data) >= 8 and data[at::2].count(0) * 10 >= len(data) * 4:
            yield data[: len(data) // 2 * 2].decode(code, "replace"), None


def _decoded(letters: str) -> bytes:
    """Base64 letters to bytes; a single letter over is dropped."""
    letters = letters[: len(letters) - (len(letters) % 4 == 1)]
    return base64.b64decode(letters + "=" * (-len(letters) % 4))


def _opened(layer: Layer, spans: list[tuple[int, int]]) -> Iterator[Layer]:
    """What one run of base64 letters (or the lines of one) decodes to, from each of four alignments, and unpacked from each place where compressed data may begin."""
    raw = "".join(layer.text[a:b] for a, b in spans)
    body = raw.translate(_STANDARD)
    via = f"{layer.via}>base64".lstrip(">")
    begins = np.array([a for a, _ in spans])
    before = np.cumsum([0, *(b - a for a, b in spans)])[:-1]

    def place(letter: np.ndarray) -> np.ndarray:
        """Where in the layer letters of the run stand."""
        line = np.searchsorted(before, letter, side="right") - 1
        return begins[line] + letter - before[line]

    def of_text(first: int, last: int) -> tuple[int, int]:
        a, b = (int(x) for x in place(np.array([first, last])))
        return layer.origin(a, b + 1)

    step, overlap = WINDOW // 3 * 4, OVERLAP // 3 * 4
    for k in range(4):
        for at in range(k, max(k + 1, len(body) - overlap), step):
            some = body[at : at + step + overlap]
            for text, width in _texts(_decoded(some)):
                if width is None:
                    a, b = of_text(at, at + len(some) - 1)
                    yield Layer(text, *(np.broadcast_to(np.int64(x), len(text)) for x in (a, b)), via)
                else:
                    stop = np.cumsum(width)
                    first, last = place(at + (stop - width) * 4 // 3), place(np.minimum(at + (stop * 4 + 2) // 3, len(body)) - 1)
                    yield Layer(text, *layer.spans_at(first, last), via)
    heads = sorted({0} | {m.start() for m in _PACKED.finditer(body)} | {m.end() for m in _SEPARATOR.finditer(raw)})
    for head in heads:
        if _kind(_decoded(body[head : head + 12])) is None:
            continue

        def make(head: int = head) -> Iterator[bytes]:
            return (_decoded(body[i : i + (1 << 18)]) for i in range(head, len(body), 1 << 18))

        whole = None
        for data, kinds in _contents(make, via):
            whole = whole or of_text(head, len(body) - 1)
            for text, _ in _texts(data):
                yield Layer(text, *(np.broadcast_to(np.int64(x), len(text)) for x in whole), kinds)


#: The next line of a mail body.
_LINE = re.compile(r"\r?\n([A-Za-z0-9+/_-]+)")


def _from_base64(layer: Layer, flagged: list[tuple[int, np.ndarray]]) -> Iterator[Layer]:
    """From each run alone, and from runs that are lines of one length and then one that is not longer."""
    upto = 0
    for run in _runs(layer.text, _BASE64, LEAST_BASE64, flagged):
        yield from _opened(layer, [run])
        if run[0] < upto:
            continue
        lines, full = [run], run[1] - run[0]
        while lines[-1][1] - lines[-1][0] == full and (m := _LINE.match(layer.text, lines[-1][1])) and m.end() - m.start(1) <= full:
            lines.append(m.span(1))
        if len(lines) > 1:
            upto = lines[-1][1]
            yield from _opened(layer, lines)


def _children(layer: Layer, flagged: list[tuple[int, np.ndarray]]) -> Iterator[Layer]:
    made = (make(layer) for make in (_from_url, _from_escapes))
    return chain((x for x in made if x is not None), _from_base64(layer, flagged))


def scan(text: str | None) -> list[tuple[str, int, int, str]]:
    """All spans as (kind, start, end, via), by start, kind and end; via is empty for matches in the text itself."""
    if not text:
        return []
    spans: dict[tuple[int, int, int], str] = {}
    seen: set[bytes] = set()
    work: list[Iterator[Layer]] = [iter([Layer(text, None, None, "")])]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        name = layer.name()
        if name in seen:
            continue
        seen.add(name)
        flagged = _flagged(layer.text)
        for start, kind, end in base_matches(layer.text, flagged):
            a, b = layer.origin(start, end)
            spans.setdefault((a, kind, b), layer.via)
        work.append(_children(layer, flagged))
    return [(KINDS[kind], a, b, via) for (a, kind, b), via in sorted(spans.items())]


def redact(text: str, spans: list[tuple[str, int, int, str]], mark: str = "[REDACTED]") -> str:
    """The text with a mark in place of each stretch that spans cover."""
    out, at = [], 0
    for _, start, end, _ in spans:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


SPANS = "array<struct<kind:string,start:long,end:long,via:string>>"
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("via", pa.string())]))


def scan_documents(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans) for every row."""
    shared.small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b, "via": v} for k, a, b, v in scan(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _ARROW_SPANS)], ["key", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, spans {SPANS}").withColumnRenamed("key", key)


def redact_documents(spark: SparkSession, docs: DataFrame, text: str = "text", length: str | None = "n_chars", mark: str = "[REDACTED]") -> DataFrame:
    """The same rows and columns with every secret in `text` replaced by the mark; null stays null. The length column, if there is one, follows changed texts."""
    shared.small_batches(spark)
    at, n = docs.columns.index(text), docs.columns.index(length) if length in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [t and redact(t, scan(t), mark) for t in old]
            columns = list(batch.columns)
            columns[at] = pa.array(new, pa.string())
            if n is not None:
                lengths = [x if a == b else len(b) for x, a, b in zip(columns[n].to_pylist(), old, new, strict=True)]
                columns[n] = pa.array(lengths, batch.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def told(spans):
    """Spans as text: kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
