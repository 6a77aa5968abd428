"""Payloads of single boxes to structs, as column expressions; a payload that is too short gives null fields."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelframe.functions.binary import unsigned
from reelframe.functions.formats import avc_level, hevc_level
from reelframe.operators.lookup import PRIMARIES, js_round, label

#: Names by number, and the kinds of handlers.
TRANSFERS = {
    1: "BT.709", 2: "unspecified", 4: "Gamma 2.2", 5: "Gamma 2.8", 6: "BT.601", 7: "SMPTE 240M", 8: "Linear", 11: "IEC 61966-2-4", 12: "BT.1361", 13: "sRGB", 14: "BT.2020 10-bit", 15: "BT.2020 12-bit", 16: "PQ (HDR10)", 17: "SMPTE 428", 18: "HLG",
}
MATRICES = {0: "Identity", 1: "BT.709", 2: "unspecified", 4: "FCC", 5: "BT.470BG", 6: "BT.601", 7: "SMPTE 240M", 9: "BT.2020 non-constant", 10: "BT.2020 constant"}
HDR_TRANSFERS = (16, 18)
CHROMA = {0: "monochrome", 1: "4:2:0", 2: "4:2:2", 3: "4:4:4"}
AVC_PROFILES = {66: "Baseline", 77: "Main", 88: "Extended", 100: "High", 110: "High 10", 122: "High 4:2:2", 244: "High 4:4:4 Predictive"}
AVC_EXTENDED, AVC_PLAIN = (100, 110, 122, 144, 244), (66, 77, 88)
HEVC_PROFILES = {1: "Main", 2: "Main 10", 3: "Main Still Picture", 4: "Format Range Extensions", 5: "High Throughput", 9: "Screen Content Coding"}
AAC_TYPES = {1: "AAC Main", 2: "AAC-LC", 3: "AAC-SSR", 4: "AAC-LTP", 5: "HE-AAC (SBR)", 23: "AAC-LD", 29: "HE-AACv2 (SBR+PS)", 39: "AAC-ELD"}
AAC_RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)
AAC_CHANNELS = (0, 1, 2, 3, 4, 5, 6, 8)
HANDLERS = {"vide": "video", "soun": "audio", "sbtl": "subtitle", "text": "subtitle", "subt": "subtitle"}
#: Bytes before the boxes within a sample entry, and what the two QuickTime versions add.
VISUAL_HEAD, AUDIO_HEAD, QT_EXTRA = 86, 36, {1: 16, 2: 36}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def named(value: Column, names: dict, miss: Column | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    found = F.try_element_at(table, value.cast("int") if isinstance(next(iter(names)), int) else value)
    return found if miss is None else F.coalesce(found, miss)


def signed(data: Column, offset: Column | int, width: int) -> Column:
    """The two's-complement integer of `width` bytes, under 8, at a byte offset."""
    return let(unsigned(data, offset, width), lambda v: F.when(v >= 1 << (8 * width - 1), v - (1 << (8 * width))).otherwise(v))


def signed64(data: Column, offset: Column | int) -> Column:
    high, at = signed(data, offset, 4), offset
    return high * (1 << 32) + unsigned(data, at + 4, 4)


def rest(data: Column, offset: Column | int) -> Column:
    at = offset if isinstance(offset, Column) else F.lit(offset)
    return F.substring(data, (at + 1).cast("int"), F.octet_length(data))


def fourcc(data: Column, offset: Column | int) -> Column:
    """Four characters; bytes that are not printable as \\xNN."""
    start = offset if isinstance(offset, Column) else F.lit(offset)

    def shown(k: Column) -> Column:
        return let(unsigned(data, start + k, 1), lambda b: F.when((b >= 0x20) & (b <= 0x7E), F.chr(b)).otherwise(F.concat(F.lit("\\x"), F.lower(F.lpad(F.hex(b), 2, "0")))))

    return F.when(F.octet_length(data) >= start + 4, F.array_join(F.transform(F.array(*[F.lit(k) for k in range(4)]), shown), ""))


def brand(data: Column) -> Column:
    """struct(major, minor, compatible) of ftyp; null under 8 bytes."""
    n = F.floor((F.octet_length(data) - 8) / 4)
    more = F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda k: fourcc(data, 8 + 4 * k))).otherwise(F.array().cast("array<string>"))
    return F.when(F.octet_length(data) >= 8, F.struct(fourcc(data, 0).alias("major"), unsigned(data, 4, 4).alias("minor"), more.alias("compatible")))


def clock(data: Column) -> Column:
    """struct(timescale, duration, seconds, language) of mvhd or mdhd (language means something in mdhd alone)."""
    wide = unsigned(data, 0, 1) == 1
    scale = F.when(wide, unsigned(data, 20, 4)).otherwise(unsigned(data, 12, 4))
    ticks = F.when(wide, unsigned(data, 24, 8)).otherwise(unsigned(data, 16, 4))
    code = F.when(wide, unsigned(data, 32, 2)).otherwise(unsigned(data, 20, 2))
    letters = [F.shiftright(code, k).bitwiseAND(31) for k in (10, 5, 0)]
    spelled = F.concat(*[F.chr(c + 0x60) for c in letters])
    seconds = F.when(scale > 0, ticks.cast("double") / scale).otherwise(F.lit(0.0))
    language = F.when((letters[0] == 0) | (letters[1] == 0) | (letters[2] == 0), "und").otherwise(spelled)
    return F.struct(scale.alias("timescale"), ticks.alias("duration"), seconds.alias("seconds"), language.alias("language"))


def track_header(data: Column) -> Column:
    """struct(track_id, width, height, rotation) of tkhd; rotation as players turn the picture, 0 to 359."""
    wide = unsigned(data, 0, 1) == 1
    base = F.when(wide, 12).otherwise(0)
    a, b, c, d = (signed(data, base + at, 4) for at in (40, 44, 52, 56))
    turned = F.pmod(-js_round(F.degrees(F.atan2(b.cast("double"), a.cast("double")))), F.lit(360)).cast("int")
    track_id = F.when(wide, unsigned(data, 20, 4)).otherwise(unsigned(data, 12, 4))
    still = (a == 0) & (b == 0) & (c == 0) & (d == 0)
    return F.struct(track_id.alias("track_id"), (signed(data, base + 76, 4) / 65536).alias("width"), (signed(data, base + 80, 4) / 65536).alias("height"), F.when(still, 0).otherwise(turned).alias("rotation"))


def edit_list(data: Column) -> Column:
    """struct(entries, non_trivial, first_time, empty_edit, rate_change) of elst; all false for no entries."""
    wide, n = unsigned(data, 0, 1) == 1, unsigned(data, 4, 4)
    stride = F.when(wide, 20).otherwise(12)
    there = F.least(n, F.floor((F.octet_length(data) - 8) / stride))

    def entry(k: Column) -> Column:
        at = 8 + k * stride
        return F.struct(F.when(wide, signed64(data, at + 8)).otherwise(signed(data, at + 4, 4)).alias("time"), signed(data, at + stride - 4, 2).alias("rate"))

    empty = F.array().cast("array<struct<time:bigint,rate:bigint>>")
    rows = F.when(there > 0, F.transform(F.sequence(F.lit(0).cast("long"), there - 1), entry)).otherwise(empty)

    def said(r: Column) -> Column:
        blank, speed = F.exists(r, lambda x: x["time"] == -1), F.exists(r, lambda x: x["rate"] != 1)
        return F.struct(n.alias("entries"), ((n > 1) | blank | speed).alias("non_trivial"), F.try_element_at(r, F.lit(1))["time"].alias("first_time"), blank.alias("empty_edit"), speed.alias("rate_change"))

    return F.when(data.isNotNull(), let(rows, said))


def handler(data: Column) -> Column:
    """The handler of hdlr as text; 'none' under 12 bytes."""
    return F.when(F.octet_length(data) >= 12, F.decode(F.substring(data, 9, 4), "ISO-8859-1")).otherwise("none")


def is_video(hdlr: Column) -> Column:
    """Whether a payload of hdlr is that of a picture track; false where there is none."""
    return F.coalesce(handler(hdlr) == "vide", F.lit(False))


def is_audio(hdlr: Column) -> Column:
    return F.coalesce(handler(hdlr) == "soun", F.lit(False))


def is_aac(hdlr: Column, stsd: Column) -> Column:
    """Whether a sound track's first sample entry is mp4a."""
    return is_audio(hdlr) & F.coalesce((F.octet_length(stsd) >= 16) & (fourcc(stsd, 12) == "mp4a"), F.lit(False))


def kind(name: Column) -> Column:
    return named(name, HANDLERS, F.lit("other"))


def color(data: Column) -> Column:
    """struct(present, type, primaries, transfer, matrix, full_range, three labels, hdr, unspecified, rec709) of colr."""
    there = F.coalesce(F.octet_length(data) >= 4, F.lit(False))
    form = F.when(there, fourcc(data, 0))
    enums = there & F.coalesce(form.isin("nclx", "nclc") & (F.octet_length(data) >= 10), F.lit(False))
    values = [F.when(enums, unsigned(data, at, 2)) for at in (4, 6, 8)]
    names = [F.when(there & ~enums, F.concat(form, F.lit(" profile"))).otherwise(label(v, table)) for v, table in zip(values, (PRIMARIES, TRANSFERS, MATRICES), strict=True)]
    full = F.when(enums & (form == "nclx") & (F.octet_length(data) >= 11), unsigned(data, 10, 1) >= 0x80)
    vague = ~there | (enums & ((values[0] == 2) | (values[1] == 2) | (values[2] == 2)))
    return F.struct(
        there.alias("present"), form.alias("type"), *[v.alias(n) for v, n in zip(values, ("primaries", "transfer", "matrix"), strict=True)], full.alias("full_range"),
        *[x.alias(f"{n}_label") for x, n in zip(names, ("primaries", "transfer", "matrix"), strict=True)], F.coalesce(values[1].isin(*HDR_TRANSFERS), F.lit(False)).alias("hdr"),
        F.coalesce(vague, F.lit(False)).alias("unspecified"), F.coalesce((values[0] == 1) & (values[1] == 1) & (values[2] == 1), F.lit(False)).alias("rec709"),
    )


def avc_config(data: Column) -> Column:
    """struct(profile, level, chroma, bit_depth) of avcC; the last two lie behind both arrays of parameter sets."""
    profile = unsigned(data, 1, 1)

    def past(at: Column, count: Column) -> Column:
        steps = F.when(count > 0, F.sequence(F.lit(1).cast("long"), count)).otherwise(F.array().cast("array<bigint>"))
        return F.aggregate(steps, at.cast("long"), lambda p, _: p + 2 + unsigned(data, p, 2))

    after_sps = past(F.lit(6), unsigned(data, 5, 1).bitwiseAND(31))
    end = let(after_sps, lambda at: past(at + 1, unsigned(data, at, 1)))

    def said(at: Column) -> Column:
        held = profile.isin(*AVC_EXTENDED) & (F.octet_length(data) - at >= 4)
        chroma = F.when(held, named(unsigned(data, at, 1).bitwiseAND(3), CHROMA)).when(profile.isin(*AVC_PLAIN), "4:2:0")
        depth = F.when(held, unsigned(data, at + 1, 1).bitwiseAND(7) + 8).when(profile.isin(*AVC_PLAIN), 8)
        name = named(profile, AVC_PROFILES, F.concat(F.lit("profile "), profile.cast("string")))
        return F.struct(name.alias("profile"), avc_level(unsigned(data, 3, 1)).alias("level"), chroma.alias("chroma"), depth.cast("int").alias("bit_depth"))

    return F.when(F.octet_length(data) >= 4, let(end, said))


def hevc_config(data: Column) -> Column:
    """struct(profile, level, chroma, bit_depth) of hvcC."""
    first, whole = unsigned(data, 1, 1), F.octet_length(data) >= 19
    number = first.bitwiseAND(31)
    name = F.concat(named(number, HEVC_PROFILES, F.concat(F.lit("profile "), number.cast("string"))), F.when(first.bitwiseAND(32) != 0, " (High tier)").otherwise(" (Main tier)"))
    chroma, depth = F.when(whole, named(unsigned(data, 16, 1).bitwiseAND(3), CHROMA)), F.when(whole, unsigned(data, 17, 1).bitwiseAND(7) + 8)
    return F.when(F.octet_length(data) >= 13, F.struct(name.alias("profile"), hevc_level(unsigned(data, 12, 1)).alias("level"), chroma.alias("chroma"), depth.cast("int").alias("bit_depth")))


def _behind_length(data: Column, at: Column) -> Column:
    """The offset behind a length of up to four bytes with seven bits each."""
    more = [unsigned(data, at + k, 1) >= 0x80 for k in range(3)]
    return at + F.when(~more[0], 1).when(~more[1], 2).when(~more[2], 3).otherwise(4)


def audio_config(data: Column) -> Column:
    """struct(bitrate, profile, rate, channels) of esds; what is missing or malformed is null."""

    def optional(at: Column, flags: Column) -> Column:
        at = at + F.when(flags.bitwiseAND(0x80) != 0, 2).otherwise(0)
        at = let(at, lambda p: p + F.when(flags.bitwiseAND(0x40) != 0, 1 + unsigned(data, p, 1)).otherwise(0))
        return at + F.when(flags.bitwiseAND(0x20) != 0, 2).otherwise(0)

    decoder = let(_behind_length(data, F.lit(5).cast("long")), lambda p: optional(p + 3, unsigned(data, p + 2, 1)))
    body = let(decoder, lambda p: F.when((unsigned(data, 4, 1) == 3) & (unsigned(data, p, 1) == 4), _behind_length(data, p + 1)))

    def said(p: Column) -> Column:
        rate = unsigned(data, p + 9, 4)
        bits_at = let(p + 13, lambda q: F.when(unsigned(data, q, 1) == 5, _behind_length(data, q + 1)))

        def bits(q: Column) -> Column:
            length = F.aggregate(F.sequence(p + 14, q - 1), F.lit(0).cast("long"), lambda n, at: n * 128 + unsigned(data, at, 1).bitwiseAND(0x7F))
            word = F.when(length >= 2, unsigned(data, q, 2))
            short = F.shiftright(word, 11)
            escaped = short == 31
            kind_ = F.when(escaped, 32 + F.shiftright(word, 5).bitwiseAND(63)).otherwise(short)
            index = F.when(escaped, F.shiftright(word, 1)).otherwise(F.shiftright(word, 7)).bitwiseAND(15)
            speakers = F.when(escaped, word * 0).otherwise(F.shiftright(word, 3).bitwiseAND(15))  # an escaped type leaves no room for channels
            return F.struct(
                F.when(rate > 0, rate).alias("bitrate"), named(kind_, AAC_TYPES, F.concat(F.lit("object type "), kind_.cast("string"))).alias("profile"),
                named(index, dict(enumerate(AAC_RATES))).cast("long").alias("rate"), named(speakers, dict(enumerate(AAC_CHANNELS))).cast("long").alias("channels"),
            )

        return let(bits_at, bits)

    return let(body, said)


def declared_bitrate(data: Column) -> Column:
    """The average bitrate of btrt, null for zero."""
    rate = unsigned(data, 8, 4)
    return F.when(rate > 0, rate)


def inner_boxes(data: Column, start: Column, end: Column) -> Column:
    """An array of struct(type, body) of the boxes from start to end, up to the first malformed size."""

    def on(places: Column, _: Column) -> Column:
        def step(at: Column) -> Column:
            size = unsigned(data, at, 4)
            return F.when((at + 8 <= end) & (size >= 8) & (at + size <= end), F.array(at + size)).otherwise(F.array().cast("array<bigint>"))

        return F.concat(places, let(F.element_at(places, -1), step))

    room = F.floor((end - start) / 8).cast("long")
    tries = F.when(room > 0, F.sequence(F.lit(1).cast("long"), room)).otherwise(F.array().cast("array<bigint>"))
    places = F.aggregate(tries, F.array(start.cast("long")), on)

    def cut(p: Column) -> Column:
        return F.transform(F.slice(p, 1, F.size(p) - 1), lambda at: F.struct(fourcc(data, at + 4).alias("type"), F.substring(data, (at + 9).cast("int"), (unsigned(data, at, 4) - 8).cast("int")).alias("body")))

    return let(places, cut)


def sample_entry(data: Column, kind_: Column) -> Column:
    """struct(format, entries, width, height, channels, rate, boxes) of the first sample entry of stsd."""
    n, size = unsigned(data, 4, 4), unsigned(data, 8, 4)
    held = (n > 0) & (F.octet_length(data) >= 16)
    end = F.least(8 + F.greatest(size, F.lit(16)), F.octet_length(data).cast("long"))
    extra = F.coalesce(named(unsigned(data, 24, 2), QT_EXTRA), F.lit(0))
    first = F.when(kind_ == "video", F.lit(8 + VISUAL_HEAD)).when(kind_ == "audio", 8 + AUDIO_HEAD + extra).otherwise(end)
    video, audio = held & (kind_ == "video"), held & (kind_ == "audio")
    return F.struct(
        F.when(held, fourcc(data, 12)).otherwise("none").alias("format"), F.coalesce(n, F.lit(0)).alias("entries"),
        F.when(video, unsigned(data, 40, 2)).alias("width"), F.when(video, unsigned(data, 42, 2)).alias("height"),
        F.when(audio, unsigned(data, 32, 2)).alias("channels"), F.when(audio, unsigned(data, 40, 2)).alias("rate"), F.when(held, inner_boxes(data, first, end)).alias("boxes"),
    )


def body_of(boxes: Column, name: str) -> Column:
    """The body of the last of the inner boxes with a name."""
    return F.try_element_at(F.filter(boxes, lambda b: b["type"] == name), F.lit(-1))["body"]
