"""Operator 9: media columns, Ogg container. Writes and reads binary Ogg columns with DataFrame in, DataFrame out.

Reading verifies every page's checksum, reassembles packets from the lacing values, separates the logical streams by serial
number and derives timestamps from granule positions. A text becomes one physical stream with two logical streams whose pages
alternate: 8-bit unsigned mono samples (packets of up to 4080 samples, granule = samples so far), and an index of one packet
per block of samples (its sample count and root-mean-square level, granule = blocks so far).

Defined results: a null text is an empty text (192 spaces of payload); equal texts give equal bytes (serial numbers come
from the payload); media that is null, broken or cut short is not an error: read_media gives its status and keeps what
could be read of complete packets on verified pages; repeated rows and ties are independent rows; further columns pass
unchanged, but an output replaces an old column of its name.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenforge.llm.shared import cleared

#: Fixed values of the Ogg format (RFC 3533) and of this codec mapping.
CAPTURE, CONTINUED, BEGIN, END, NO_GRANULE = b"OggS", 1, 2, 4, 0xFFFFFFFFFFFFFFFF
SAMPLE_RATE, PAD_UNIT, BLOCK = 8000, 192, 4080
SAMPLES_MAGIC, INDEX_MAGIC = b"PCM8\x00\x01", b"IDX8\x00\x01"

_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_crc(page: bytes) -> int:
    """Ogg's CRC-32 (polynomial 0x04C11DB7, not reflected, zero start): zlib's on bit-reversed bytes, reversed back."""
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, sequence: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBQIIIB", CAPTURE, 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing
    crc = page_crc(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def _lacing(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes([size % 255])


def paged(packets: list[tuple[bytes, int]], serial: int) -> list[bytes]:
    """Pages of one logical stream from (packet, granule after it); the first packet has a page of its own."""
    pages, lacing, body, granule, continued, sequence = [], bytearray(), bytearray(), NO_GRANULE, 0, 0

    def flush(last: bool, open_packet: bool) -> None:
        nonlocal lacing, body, granule, continued, sequence
        flags = continued * CONTINUED | (not pages) * BEGIN | last * END
        pages.append(_page(flags, granule, serial, sequence, bytes(lacing), bytes(body)))
        lacing, body, granule, continued, sequence = bytearray(), bytearray(), NO_GRANULE, int(open_packet), sequence + 1

    for k, (packet, after) in enumerate(packets):
        values, at = _lacing(len(packet)), 0
        while at < len(values):
            take = values[at : at + 255 - len(lacing)]
            start = at * 255
            lacing += take
            body += packet[start : start + sum(take)]
            at += len(take)
            if at == len(values):
                granule = after
            if len(lacing) == 255 and (at < len(values) or k + 1 < len(packets)):
                flush(False, at < len(values))
        if k == 0 and lacing and len(packets) > 1:
            flush(False, False)
    flush(True, False)
    return pages


def write_media(payload: bytes) -> bytes:
    """The payload as an Ogg file of two alternating logical streams."""
    seed = zlib.crc32(payload)
    samples = [(SAMPLES_MAGIC + struct.pack("<IQ", SAMPLE_RATE, len(payload)), 0)]
    index = [(INDEX_MAGIC + struct.pack("<I", BLOCK), 0)]
    for at in range(0, len(payload), BLOCK):
        block = payload[at : at + BLOCK]
        samples.append((block, at + len(block)))
        level = np.frombuffer(block, np.uint8).astype(np.float64) - 128.0
        index.append((struct.pack("<If", len(block), float(np.sqrt(np.mean(level * level)))), len(index)))
    streams = [paged(samples, seed), paged(index, seed ^ 0x5A5A5A5A)]
    out = [streams[0][0], streams[1][0]]  # all first pages come first
    rest = [streams[0][1:], streams[1][1:]]
    for k in range(max(map(len, rest))):
        out += [s[k] for s in rest if k < len(s)]
    return b"".join(out)


def read_pages(media: bytes):
    """(flags, granule, serial, sequence, lacing, body, checksum holds) of each page; a damaged start is searched for the next page."""
    at = media.find(CAPTURE)
    while 0 <= at and at + 27 <= len(media):
        _, version, flags, granule, serial, sequence, crc, n = struct.unpack_from("<4sBBQIIIB", media, at)
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        whole = len(lacing) == n and end <= len(media)
        right = whole and version == 0 and page_crc(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) == crc
        if right:
            yield flags, granule, serial, sequence, lacing, media[at + 27 + n : end], True
            at = media.find(CAPTURE, end)
        else:
            yield flags, granule, serial, sequence, lacing, b"", False
            at = media.find(CAPTURE, at + 4)


def read_streams(media: bytes) -> tuple[dict[int, list[tuple[bytes, int]]], str]:
    """Packets (bytes, granule) of each logical stream by serial number, and 'ok' or what is wrong."""
    streams: dict[int, list[tuple[bytes, int]]] = {}
    open_packet: dict[int, bytearray | None] = {}
    expected: dict[int, int] = {}
    ended: set[int] = set()
    problem = "ok"
    for flags, granule, serial, sequence, lacing, body, right in read_pages(media):
        if not right:
            problem = "bad page"
            continue
        packets = streams.setdefault(serial, [])
        lost = sequence != expected.get(serial, 0)
        expected[serial] = sequence + 1
        if lost:
            problem = "missing page"
        part = open_packet.get(serial)
        if not flags & CONTINUED:
            part = bytearray()
        elif lost:
            part = None  # its beginning is on the lost page
        at, done = 0, []
        for value in lacing:
            if part is not None:
                part += body[at : at + value]
            at += value
            if value < 255:
                if part is not None:
                    done.append(bytes(part))
                part = bytearray()
        open_packet[serial] = part
        packets += [(x, NO_GRANULE) for x in done[:-1]] + [(x, granule) for x in done[-1:]]  # the granule is that of the page's last packet
        if flags & END:
            ended.add(serial)
    if problem == "ok" and (not streams or set(streams) - ended):
        problem = "no end page" if streams else "no page"
    return streams, problem


def read_media(media: bytes | None) -> dict:
    """status, payload, sample rate, seconds by the last granule, streams and index levels."""
    streams, status = read_streams(media or b"")
    out = {"status": status, "payload": b"", "rate": 0, "seconds": 0.0, "streams": len(streams), "levels": [], "granules": []}
    for packets in streams.values():
        head = packets[0][0] if packets else b""
        if head.startswith(SAMPLES_MAGIC) and len(head) == len(SAMPLES_MAGIC) + 12:
            out["rate"], length = struct.unpack_from("<IQ", head, len(SAMPLES_MAGIC))
            out["payload"] = b"".join(x for x, _ in packets[1:])
            out["granules"] = [g for _, g in packets[1:] if g != NO_GRANULE]
            if len(out["payload"]) != length and status == "ok":
                out["status"] = "short stream"
        elif head.startswith(INDEX_MAGIC):
            out["levels"] = [struct.unpack("<If", x)[1] for x, _ in packets[1:] if len(x) == 8]
    if out["granules"] and out["rate"]:
        out["seconds"] = out["granules"][-1] / out["rate"]
    return out


def features(media: dict) -> str:
    """Features of the samples read back, as JSON with sorted keys."""
    x = np.frombuffer(media["payload"], np.uint8).astype(np.int16) - 128
    found = {"status": media["status"], "streams": media["streams"], "rate": media["rate"], "seconds": round(media["seconds"], 6), "samples": len(x), "blocks": len(media["levels"])}
    if len(x):
        y = x.astype(np.float64)
        found |= {"mean": round(float(y.mean()), 4), "rms": round(float(np.sqrt((y * y).mean())), 4), "peak": int(np.abs(x).max()), "crossings": int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0))), "loudest_block": int(np.argmax(media["levels"])) if media["levels"] else -1}
    return json.dumps(found, sort_keys=True)


def payload_of(text: str | None) -> bytes:
    """UTF-8 of the text, filled with spaces to a positive multiple of PAD_UNIT."""
    raw = (text or "").encode()
    return raw + b" " * (max(PAD_UNIT, -(-len(raw) // PAD_UNIT) * PAD_UNIT) - len(raw))


def encode(df: DataFrame, text_col: str = "text", out_col: str = "media") -> DataFrame:
    """df with a binary column of Ogg files made from text_col."""
    df = cleared(df, [out_col], [text_col])
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.BinaryType(), False)])

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                media = [write_media(payload_of(t)) for t in part.column(part.schema.get_field_index(text_col)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(media, pa.binary())], names=[*part.schema.names, out_col])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, media_col: str = "media") -> DataFrame:
    """df without media_col, with media_status, payload, sample_rate, seconds and feature read from it."""
    new = [T.StructField("media_status", T.StringType()), T.StructField("payload", T.BinaryType()), T.StructField("sample_rate", T.LongType()), T.StructField("seconds", T.DoubleType()), T.StructField("feature", T.StringType())]
    df = cleared(df, [f.name for f in new], [media_col])
    schema = T.StructType([f for f in df.schema.fields if f.name != media_col] + new)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                read = [read_media(m) for m in part.column(part.schema.get_field_index(media_col)).to_pylist()]
                rest = [c for c, n in zip(part.columns, part.schema.names, strict=True) if n != media_col]
                yield pa.RecordBatch.from_arrays([*rest, pa.array([x["status"] for x in read], pa.string()), pa.array([x["payload"] for x in read], pa.binary()), pa.array([x["rate"] for x in read], pa.int64()), pa.array([x["seconds"] for x in read], pa.float64()), pa.array([features(x) for x in read], pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def digests(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row of df: sizes and digests of the payload as it is read back from the stored bytes, and its features."""
    fields = [("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *[T.StructField(n, t) for n, t in fields]])
    arrow = {"long": pa.int64(), "bigint": pa.int64(), "string": pa.string()}

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1):
                raw = text.as_py() or ""
                media = write_media(payload_of(raw))
                read = read_media(media)
                got = read["payload"]
                rows.append((len(raw.encode()), len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(read)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, arrow[t.simpleString()]) for c, (_, t) in zip(columns, fields, strict=True)]], names=schema.names)

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
