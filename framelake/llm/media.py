"""Media columns from ISO base media files: boxes are walked and sample tables decoded, payloads never are.

Defined results: bytes that aren't such a file, are cut off, have no track or tables that contradict each other, that
nest deeper than DEPTH, or that are fragmented (their samples aren't in these tables) give null features and an error
string; null bytes give null; a track without an stss box has keyframes only: each sample is one, but samples that all
have one size, as those of raw audio, are given by stretches. Repeated rows get equal results, an empty table an empty
one. A table's counts are held against its box before anything is built of them, and nothing is built for each of
samples of one size, so a file costs no more memory than a few times its own size. Texts too long for a file of 32-bit
offsets, of 4 GiB, are an error; a row of Spark's can't hold them.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import bounded_batches, strings, trimmed, whole

#: Fixed values of the file format: boxes that hold boxes, and those of fragmented files.
CONTAINERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf"))
FRAGMENTS = frozenset((b"moof", b"mvex"))
DEPTH = 16
#: Bytes of a stored sample, samples of a chunk and samples between keyframes, as container() writes them.
SAMPLE, CHUNK, KEY_EVERY, RATE = 64, 16, 16, 8000


def boxes(data: memoryview) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, start, end) of each box's content, nested boxes after the one that holds them."""
    open_: list[tuple[tuple[bytes, ...], int, int]] = [((), 0, len(data))]
    while open_:
        path, at, end = open_.pop()
        if at + 8 > end:
            if at < end and not path:
                raise ValueError(f"bytes at {at} are no box")
            continue
        size, kind, head = *struct.unpack_from(">I4s", data, at), 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"box {kind!r} at {at} leaves its parent")
        open_.append((path, at + size, end))
        yield (*path, kind), at + head, at + size
        if kind in CONTAINERS:
            if len(path) >= DEPTH:
                raise ValueError("boxes nest too deeply")
            open_.append(((*path, kind), at + head, at + size))


def _table(data: memoryview, at: int, end: int, kind: str, columns: int = 1) -> np.ndarray:
    """The entries of a full box with a count: version and flags, count, rows."""
    n = struct.unpack_from(">I", data, at + 4)[0]
    width = np.dtype(kind).itemsize * columns
    if at + 8 + n * width > end:
        raise ValueError("table leaves its box")
    return np.frombuffer(data, kind, n * columns, at + 8).astype("int64").reshape(n, columns)


def _sizes(data: memoryview, at: int, end: int) -> tuple[int, int, np.ndarray | None]:
    """The size that all samples have (0: none), how many there are, and otherwise each one's."""
    same, n = struct.unpack_from(">II", data, at + 4)
    if not same:
        if at + 12 + 4 * n > end:
            raise ValueError("table leaves its box")
        return 0, n, np.frombuffer(data, ">u4", n, at + 12)
    if n * same > len(data):
        raise ValueError("samples lie beyond the file")
    return same, n, None


def _place(t: dict, length: int) -> None:
    """Adds the chunks' ends in samples and bytes; checks what is there. Nothing is built for each sample of one size."""
    n, chunks, runs = t["n"], t["chunks"], t["runs"]
    first = np.append(runs[:, 0] - 1, len(chunks))
    if len(runs) and (first[0] != 0 or (np.diff(first) < 0).any() or (runs[:, 1] < 1).any()):
        raise ValueError("chunk runs are out of order")
    per = np.minimum(np.repeat(runs[:, 1], np.diff(first)), n) if len(runs) else np.zeros(0, "int64")
    t["ends"] = np.minimum(np.cumsum(per), n)
    if n and (not len(t["ends"]) or t["ends"][-1] < n):
        raise ValueError("chunks hold fewer samples than there are sizes")
    t["upto"] = None if t["sizes"] is None else np.concatenate((np.zeros(1, "int64"), np.cumsum(t["sizes"], dtype="int64")))
    starts = np.concatenate((np.zeros(1, "int64"), t["ends"][:-1]))[: len(t["ends"])]
    t["starts"], used = starts, t["ends"] > starts
    t["spans"] = np.stack((chunks[: len(used)][used], (_bytes_before(t, t["ends"]) - _bytes_before(t, starts))[used]), axis=1) if n else np.zeros((0, 2), "int64")
    if n and (t["spans"][:, 0].min() < 0 or t["spans"].sum(axis=1).max() > length):
        raise ValueError("samples lie beyond the file")
    if t["keys"] is not None and len(t["keys"]) and (t["keys"].min() < 0 or t["keys"].max() >= n):
        raise ValueError("a keyframe is none of the samples")
    if t["times"] is not None and (n_times := int(t["times"][:, 0].sum())) != n:
        raise ValueError(f"{n_times} sample times for {n} samples")


def _bytes_before(t: dict, samples: np.ndarray) -> np.ndarray:
    return samples * t["size"] if t["upto"] is None else t["upto"][samples]


def ranges(t: dict, samples: np.ndarray) -> np.ndarray:
    """(offset, bytes) of a track's samples."""
    chunk = np.searchsorted(t["ends"], samples, "right")
    before = _bytes_before(t, samples)
    return np.stack((t["chunks"][chunk] + before - _bytes_before(t, t["starts"][chunk]), _bytes_before(t, samples + 1) - before), axis=1)


def joined(spans: np.ndarray) -> np.ndarray:
    """(offset, bytes) with those in one that follow each other."""
    first = np.flatnonzero(np.concatenate(([True], spans[1:, 0] != spans[:-1].sum(axis=1)))) if len(spans) else np.zeros(0, "int64")
    return np.stack((spans[first, 0], np.add.reduceat(spans[:, 1], first)), axis=1) if len(first) else spans


def keyframes(t: dict) -> np.ndarray:
    """(offset, bytes) of the keyframes; where all samples are and have one size, of each stretch of them."""
    if t["keys"] is not None:
        return ranges(t, t["keys"])
    return joined(t["spans"]) if t["upto"] is None else ranges(t, np.arange(t["n"]))


def tracks(data: bytes) -> list[dict]:
    """codec, timescale, duration, samples and their chunks, and keyframes (from 0; None: all samples) of each track."""
    view, out = memoryview(data), []
    for path, at, end in boxes(view):
        kind = path[-1]
        if kind in FRAGMENTS:
            raise ValueError("fragmented file")
        if kind == b"trak":
            out.append({"codec": None, "timescale": 0, "duration": 0, "size": 0, "n": 0, "sizes": np.zeros(0, "int64"), "keys": None, "times": None, "chunks": np.zeros(0, "int64"), "runs": np.zeros((0, 3), "int64")})
        elif not out or b"trak" not in path:
            continue
        t = out[-1]
        if kind == b"mdhd":
            t["timescale"], t["duration"] = struct.unpack_from(">IQ", view, at + 20) if view[at] == 1 else struct.unpack_from(">II", view, at + 12)
        elif kind == b"stsd" and end - at >= 16:
            t["codec"] = bytes(view[at + 12 : at + 16]).decode("latin-1")
        elif kind == b"stsz":
            t["size"], t["n"], t["sizes"] = _sizes(view, at, end)
        elif kind == b"stsc":
            t["runs"] = _table(view, at, end, ">u4", 3)
        elif kind in (b"stco", b"co64"):
            t["chunks"] = _table(view, at, end, ">u4" if kind == b"stco" else ">u8")[:, 0]
        elif kind == b"stss":
            t["keys"] = _table(view, at, end, ">u4")[:, 0] - 1
        elif kind == b"stts":
            t["times"] = _table(view, at, end, ">u4", 2)
    for t in out:
        _place(t, len(data))
    return out


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def container(payload: bytes) -> bytes:
    """A one-track file with payload, a positive multiple of SAMPLE bytes, as samples of 8-bit values."""
    n = len(payload) // SAMPLE
    if len(payload) > 0xF0000000:
        raise ValueError("a payload of 4 GiB needs 64-bit offsets")
    chunks, rest = divmod(n, CHUNK)
    runs = [(1, CHUNK, 1)] * bool(chunks) + [(chunks + 1, rest, 1)] * bool(rest)
    full = lambda kind, *parts: _box(kind, b"\0\0\0\0", *parts)
    entry = _box(b"raw ", b"\0" * 6, struct.pack(">H", 1), b"\0" * 8, struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    total = chunks + bool(rest)

    def moov(start: int) -> bytes:
        offsets = (np.arange(total, dtype=">u4") * (SAMPLE * CHUNK) + start).astype(">u4").tobytes()
        keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4").tobytes()
        stbl = _box(b"stbl", full(b"stsd", struct.pack(">I", 1), entry), full(b"stts", struct.pack(">III", 1, n, SAMPLE)), full(b"stsz", struct.pack(">II", SAMPLE, n)), full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)), full(b"stco", struct.pack(">I", total), offsets), full(b"stss", struct.pack(">I", len(keys) // 4), keys))
        mdhd = full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n * SAMPLE, 0x55C4, 0))
        dinf = _box(b"dinf", full(b"dref", struct.pack(">I", 1), _box(b"url ", b"\0\0\0\1")))
        minf = _box(b"minf", full(b"smhd", b"\0" * 4), dinf, stbl)
        unity = struct.pack(">9I", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
        mvhd = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, n * SAMPLE, 1 << 16, 1 << 8), b"\0" * 10, unity, b"\0" * 24, struct.pack(">I", 2))
        tkhd = _box(b"tkhd", b"\0\0\0\7", struct.pack(">IIIII", 0, 0, 1, 0, n * SAMPLE), b"\0" * 12, struct.pack(">HH", 1 << 8, 0), unity, b"\0" * 8)
        return _box(b"moov", mvhd, _box(b"trak", tkhd, _box(b"mdia", mdhd, full(b"hdlr", b"\0" * 4, b"soun", b"\0" * 13), minf)))

    head = _box(b"ftyp", b"isom", struct.pack(">I", 0), b"isom")
    start = len(head) + len(moov(0)) + 8
    return head + moov(start) + _box(b"mdat", payload)


_TRACK = "codec string, timescale long, duration long, n_samples long, sample_bytes long, keyframes array<struct<offset:long,bytes:long>>"
#: The first track's columns, those of all tracks, and what is wrong with the file.
FEATURES = f"{_TRACK}, tracks array<struct<{_TRACK.replace(' ', ':').replace(',:', ',')}>>, error string"
_KEYS = pa.list_(pa.struct([("offset", pa.int64()), ("bytes", pa.int64())]))
_FIELDS = [("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()), ("sample_bytes", pa.int64()), ("keyframes", _KEYS)]
_SCHEMA = pa.schema([*_FIELDS, ("tracks", pa.list_(pa.struct(_FIELDS))), ("error", pa.string())])


def features(data: bytes | None) -> tuple[list[dict] | None, str | None]:
    """All tracks' features, or what is wrong with the file."""
    if data is None:
        return None, None
    try:
        found = [{k: t[k] for k in ("codec", "timescale", "duration", "n")} | {"bytes": int(t["spans"][:, 1].sum()), "keyframes": keyframes(t)} for t in tracks(data)]
    except (ValueError, IndexError, OverflowError, struct.error) as e:
        return None, str(e)
    return (found, None) if found else (None, "no track")


def _columns(files: list[tuple[list[dict] | None, str | None]]) -> list[pa.Array]:
    """The columns of _SCHEMA; keyframes are never Python objects."""
    flat = [t for found, _ in files for t in found or ()]
    spans = np.concatenate([t["keyframes"] for t in flat] or [np.zeros((0, 2), "int64")])
    each = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(t["keyframes"]) for t in flat)]), pa.int32()), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(spans[:, i])) for i in (0, 1)], ["offset", "bytes"]))
    plain = [pa.array([t[k] for t in flat], f[1]) for k, f in zip(("codec", "timescale", "duration", "n", "bytes"), _FIELDS)]
    all_tracks = pa.StructArray.from_arrays([*plain, each], fields=[pa.field(*f) for f in _FIELDS])
    edges = np.cumsum([0, *(len(found or ()) for found, _ in files)]).tolist()
    whole_files = pa.ListArray.from_arrays(pa.array([None if found is None else a for (found, _), a in zip(files, edges)] + edges[-1:], pa.int32()), all_tracks)
    first = all_tracks.take(pa.array([None if found is None else a for (found, _), a in zip(files, edges)], pa.int64()))
    return [*first.flatten(), whole_files, pa.array([e for _, e in files], pa.string())]


def media_columns(files: DataFrame, content: str = "content") -> DataFrame:
    """files with the features of the file in the column content instead of it.

    The other columns stay; one whose name is a feature's gets the prefix file_.
    """
    keep = [c for c in files.columns if c != content]
    rows = files.select(F.struct(*[files[f"`{c}`"].alias(f"file_{c}" if c in _SCHEMA.names else c) for c in keep]).alias("row"), files[f"`{content}`"].alias("content"))

    @trimmed
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                yield pa.RecordBatch.from_arrays([part.column("row"), *_columns([features(x) for x in strings(part.column("content"), 1)])], ["row", *_SCHEMA.names])

    bounded_batches(files)
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(walk, f"row {kind}, {FEATURES}").select("row.*", *_SCHEMA.names)


STORED = "doc_id {}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def stored_texts(docs: DataFrame) -> DataFrame:
    """Each whole text stored as such a file, and what is read back from it.

    Null texts are empty; the payload is padded with zero bytes to a positive multiple of SAMPLE.
    """

    bounded_batches(docs)

    @trimmed
    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for text in strings(batch.column("text"), 64):
                data = text.encode()
                media = container(data.ljust(max(1, -(-len(data) // SAMPLE)) * SAMPLE, b"\0"))
                t = tracks(media)[0]
                back = b"".join(media[a : a + b] for a, b in joined(t["spans"]).tolist())
                keys = keyframes(t)
                feature = f"{t['codec']}|{t['duration']}/{t['timescale']}|samples={t['n']}|keys={len(keys)}|first={keys[0, 0]}+{keys[0, 1]}|last={keys[-1, 0]}+{keys[-1, 1]}"
                for col, v in zip(cols, (len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-SAMPLE:]), len(media), hashlib.sha256(media).hexdigest(), feature)):
                    col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    rows = docs.select("doc_id", whole().alias("text"))
    return rows.mapInArrow(store, STORED.format(rows.schema["doc_id"].dataType.simpleString()))


def files_of(texts: DataFrame) -> DataFrame:
    """(doc_id, content): the files themselves, for a media table."""

    @F.arrow_udf("binary")
    def make(column: pa.Array) -> pa.Array:
        data = (s.encode() for s in strings(column))
        return pa.array([container(x.ljust(max(1, -(-len(x) // SAMPLE)) * SAMPLE, b"\0")) for x in data], pa.binary())

    return texts.select("doc_id", make(whole()).alias("content"))
