"""Lossless rewrites of containers that are a binary column: index first, padding dropped, colours tagged if asked for.

Each file is rewritten by itself, so the work spreads over the files and nothing shuffles.  The media bytes stay as
they are; only the index before them is built anew, with chunk offsets moved by as much as the media moves.

Nothing is guessed: a file whose moov has a malformed box anywhere is declined, and the offsets of a new index are read
again and compared with the source's before it is handed on.

Defined results: a file that cannot be rewritten has null content and the reason in `error`; a null content too.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelframe.sources.containers import CONTAINERS, MAX_DEPTH, MAX_TOP_LEVEL, Malformed, Rows, headers, inner_start, runs, runs_below

#: What tags BT.709 in limited range, the bytes of a visual sample entry before its boxes, layout passes.
REC709 = b"nclx" + struct.pack(">HHHB", 1, 1, 1, 0)
VISUAL_ENTRY, MAX_PASSES = 86, 6
#: Boxes that hold places in the file besides chunk offsets; what they point to would move away.
POINTERS = ("saio", "iloc")
KNOWN, DROPPED = ("ftyp", "moov", "mdat", "free", "skip", "wide"), ("free", "skip", "wide")
REWRITTEN = "file_id string, content binary, offsets_moved long, passes int, error string"


class Declined(ValueError):
    """Why a file is not rewritten."""


def boxed(kind: bytes, body: bytes) -> bytes:
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def tagged(stsd: bytes) -> bytes:
    """A video's stsd payload with BT.709 as the colours of its first entry."""
    if len(stsd) < 16:
        return stsd
    count, size = struct.unpack_from(">II", stsd, 4)
    end = min(8 + size, len(stsd))
    if count < 1 or size < VISUAL_ENTRY:
        return stsd
    inner = headers(stsd, 8 + VISUAL_ENTRY, end)
    first, last = next(((at, at + n) for kind, at, n, head, _ in inner if kind == "colr" and head == 8), (end, end))
    tag = boxed(b"colr", REC709)
    return stsd[:8] + struct.pack(">I", size + len(tag) - (last - first)) + stsd[12:first] + tag + stsd[last:]


def offsets(payload: bytes, wide: bool) -> tuple[int, ...]:
    """A chunk-offset table; one that is shorter than it says is an error."""
    n, width = struct.unpack_from(">I", payload, 4)[0] if len(payload) >= 8 else 0, 8 if wide else 4
    if len(payload) < 8 or len(payload) - 8 < n * width:
        raise Declined("a chunk offset table is cut short")
    return struct.unpack_from(f">{n}{'Q' if wide else 'I'}", payload, 8)


def _index(data: bytes, start: int, end: int, shift: int, media: tuple[int, int], retag: bool, moved: list[int], depth: int = 0, above: str = "moov") -> bytes:
    """The boxes from start to end with offsets shifted; moved gets the number of offsets of each table.

    Every byte lies in a well-formed box, but for up to seven behind the last one, which stay as they are.
    """
    if depth > MAX_DEPTH:
        raise Declined("boxes are nested too deeply")
    parts, at = [], start
    for kind, first, size, head, _, n in runs(data, start, end, strict=True):
        at = first + n * size
        if n > 1 and not _changed(kind, above):
            parts.append(data[first:at])
            continue
        for place in range(first, at, size):
            parts.append(_moved(data, kind, place, size, head, shift, media, retag, moved, depth, above))
    parts.append(data[at:end])
    return b"".join(parts)


def _changed(kind: str, above: str) -> bool:
    """Whether a box of a type, in one of type `above`, is other than a leaf that stays as it is."""
    return kind in (*POINTERS, "stco", "co64", "stsd", "meta") or kind in CONTAINERS or above == "ilst"


def _moved(data: bytes, kind: str, first: int, size: int, head: int, shift: int, media: tuple[int, int], retag: bool, moved: list[int], depth: int, above: str) -> bytes:
    """One box with the offsets in it shifted."""
    body, name = data[first + head : first + size], data[first + 4 : first + 8]
    if kind in POINTERS:
        raise Declined(f"a {kind} box holds offsets that are not moved")
    if kind in ("stco", "co64"):
        table = offsets(body, kind == "co64")
        _within(table, *media, "a chunk offset")
        moved.append(len(table))
        placed = [x + shift for x in table]
        wide = max(placed, default=0) >= 1 << 32
        body = body[:8] + struct.pack(f">{len(placed)}{'Q' if wide else 'I'}", *placed)
        name = b"co64" if wide else b"stco"
    elif kind == "stsd" and retag:
        body = tagged(body)
    elif kind == "meta" and above != "ilst":
        skip = inner_start(body, 0, len(body))
        body = body[:skip] + _index(body, skip, len(body), shift, media, False, moved, depth + 1, kind)
    elif kind != "stsd" and (kind in CONTAINERS or above == "ilst"):
        # Colours are tagged where the handler says video.
        video = retag and (kind != "trak" or b"vide" == _handler(body))
        body = _index(body, 0, len(body), shift, media, video, moved, depth + 1, kind)
    return boxed(name, body)


def _within(table: tuple[int, ...], first: int, end: int, what: str) -> None:
    if table and not first <= min(table) <= max(table) < end:
        raise Declined(f"{what} lies outside the media")


def offset_tables(moov: bytes) -> list[tuple[int, ...]]:
    """The chunk-offset tables of a moov box, in order; Declined if any box in it is malformed."""
    box = next(headers(moov, 0, len(moov), 1, strict=True))
    try:
        found = [r for r in runs_below(moov, box, strict=box[0] == "moov") if r[5] in ("stco", "co64")]
    except Malformed as why:
        raise Declined(str(why)) from why
    places = [(at + head, at + size, kind == "co64") for *_, kind, first, size, head, _, _, n in found for at in range(first, first + n * size, size)]
    return [offsets(moov[first:end], wide) for first, end, wide in places]


def _handler(trak: bytes) -> bytes:
    for kind, first, size, head, _ in headers(trak, 0, len(trak)):
        if kind == "mdia":
            for inner, at, n, skip, _ in headers(trak, first + head, first + size):
                if inner == "hdlr" and n - skip >= 12:
                    return trak[at + skip + 8 : at + skip + 12]
    return b""


def laid_out(top: list[tuple], read: Callable[[int, int], bytes], retag: bool = False) -> tuple[bytes, tuple[int, int], int, int]:
    """(the bytes before the media, the range of the media, number of chunk offsets, layout passes); Declined says why not.

    top: the headers of the file; read(start, size) is asked for ftyp and moov only.
    """
    kinds = [h[0] for h in top]
    unknown = [k for k in dict.fromkeys(kinds) if k not in KNOWN]
    moovs = [read(s, n) for k, s, n, _, _ in top if k == "moov"]
    if "moof" in kinds or any(r[0] == "mvex" for m in moovs for one in headers(m, 0, len(m), 1) for r in runs(m, one[3], len(m))):
        raise Declined("the file is fragmented, which needs a real remuxer")
    if unknown:
        raise Declined(f"unexpected top-level box(es): {', '.join(unknown)}")
    for kind in ("mdat", "moov", "ftyp"):
        if kinds.count(kind) != 1:
            raise Declined(f"{kinds.count(kind)} {kind} boxes, where one is needed")
    at = {k: (s, n, head) for k, s, n, head, _ in top}
    (f0, fn, _), (_, size, mhead), (d0, dn, dhead) = at["ftyp"], at["moov"], at["mdat"]
    brand, moov = read(f0, fn), moovs[0]
    for turn in range(1, MAX_PASSES + 1):
        moved: list[int] = []
        try:
            index = boxed(b"moov", _index(moov, mhead, len(moov), len(brand) + size - d0, (d0 + dhead, d0 + dn), retag, moved))
        except Malformed as why:
            raise Declined(str(why)) from why
        if len(index) == size:
            _verify(moov, index, len(brand) + size - d0, (len(brand) + size + dhead, len(brand) + size + dn))
            return brand + index, (d0, dn), sum(moved), turn
        size = len(index)
    raise Declined("the layout does not settle")


def _verify(before: bytes, after: bytes, shift: int, media: tuple[int, int]) -> None:
    """Reads the new index again: each offset has moved as the media has, and lies in it."""
    old, new = offset_tables(before), offset_tables(after)
    if [tuple(x + shift for x in table) for table in old] != new:
        raise Declined("a rewritten chunk offset does not follow the media")
    for table in new:
        _within(table, *media, "a rewritten chunk offset")


def rewritten(data: bytes, retag: bool = False) -> tuple[bytes, int, int]:
    """(content, number of chunk offsets, layout passes) of one file; Declined says why not."""
    front, (start, size), moved, turns = laid_out(list(headers(data, 0, len(data), MAX_TOP_LEVEL)), lambda s, n: data[s : s + n], retag)
    return front + data[start : start + size], moved, turns


def rewrite(files: DataFrame, retag: bool = False, key: str = "file_id", content: str = "content") -> DataFrame:
    """files rewritten, as REWRITTEN: one row a file."""

    def one(name: str, data: bytes | None) -> tuple:
        try:
            if data is None:
                raise Declined("no content")
            return name, *rewritten(data, retag), None
        except Declined as why:
            return name, None, None, None, str(why)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(REWRITTEN)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row = one(name, content.as_py())
                yield from out.add([row], len(row[1] or b""))
        yield from out.rest()

    return files.select(F.col(key).cast("string"), content).mapInArrow(run, REWRITTEN)
