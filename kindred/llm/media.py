"""Media columns as MPEG transport streams.

Writing cuts a payload into access units. Each becomes a packetised elementary packet with a presentation timestamp,
dealt over 188-byte transport packets with continuity counters. The program tables, and a packet marked as a
random-access point, come first and again before every `GROUP` units. Reading finds the program tables, checks their
checksums and the continuity counters, reassembles the packets, and gives the payload back with the timestamps and the
random-access points. Both stay in the task that holds the row; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import bounded_batches, crc32, read_table

#: Fixed values of the format (ISO/IEC 13818-1).
SYNC, PACKET, PAT_PID, STUFFING, PRIVATE_STREAM, PRIVATE_DATA, CRC_POLYNOMIAL = 0x47, 188, 0, 0xFF, 0xBD, 0x06, 0x04C11DB7
#: This writer's choices: pids, bytes and 90 kHz ticks of an access unit, and units between random-access points.
PMT_PID, ES_PID, UNIT, TICKS, GROUP = 0x100, 0x101, 2880, 3600, 8
#: A payload is padded with spaces to a positive multiple of this.
PAD = 192


def crc_mpeg(data: bytes) -> int:
    """CRC-32 of the format's tables: not reflected, all ones at first, not inverted."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ CRC_POLYNOMIAL if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def section(table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | len(body) + 9, number, 0xC1, 0, 0)
    return head + body + struct.pack(">I", crc_mpeg(head + body))


def psi_packet(pid: int, data: bytes) -> bytes:
    """A whole packet, continuity counter 0, that holds a short section."""
    return (struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10) + b"\0" + data).ljust(PACKET, bytes([STUFFING]))


PAT = psi_packet(PAT_PID, section(0x00, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID)))
PMT = psi_packet(PMT_PID, section(0x02, 1, struct.pack(">HHBHH", 0xE000 | ES_PID, 0xF000, PRIVATE_DATA, 0xE000 | ES_PID, 0xF000)))


def stamp(ticks: int) -> bytes:
    """A 33-bit timestamp with its marker bits, in five bytes."""
    return struct.pack(">BHH", 0x21 | ticks >> 29 & 0x0E, ticks >> 14 & 0xFFFE | 1, ticks << 1 & 0xFFFE | 1)


def counted(packet: bytes, counter: int) -> bytes:
    return packet[:3] + bytes([packet[3] | counter & 15]) + packet[4:]


def write_stream(payload: bytes) -> bytes:
    out, counter = [], 0
    for n, at in enumerate(range(0, len(payload), UNIT)):
        entry, unit, ticks = n % GROUP == 0, payload[at : at + UNIT], n * TICKS % (1 << 33)
        if entry:
            out += [counted(PAT, n // GROUP), counted(PMT, n // GROUP)]
        pes = struct.pack(">IHBBB", 0x100 | PRIVATE_STREAM, len(unit) + 8, 0x84, 0x80, 5) + stamp(ticks) + unit
        # a random-access point carries the clock reference: flags, 33-bit base, 6 reserved bits, 9-bit extension
        field_ = bytes([0x50]) + struct.pack(">IH", ticks >> 1, (ticks & 1) << 15 | 0x7E00) if entry else b""
        place, first = 0, True
        while place < len(pes):
            room = 184 - (len(field_) + 1 if field_ else 0)
            part = pes[place : place + room]
            head = struct.pack(">BH", SYNC, (0x4000 if first else 0) | ES_PID)
            if short := room - len(part):
                own = field_ or (b"\0" if short > 1 else b"")
                stuffed = own.ljust(183 - len(part), bytes([STUFFING]))
                out.append(head + bytes([0x30 | counter, len(stuffed)]) + stuffed + part)
            elif field_:
                out.append(head + bytes([0x30 | counter, len(field_)]) + field_ + part)
            else:
                out.append(head + bytes([0x10 | counter]) + part)
            counter, place, first, field_ = (counter + 1) & 15, place + len(part), False, b""
    return b"".join(out)


@dataclass
class Stream:
    """What a transport stream holds: of each unit its timestamp, and the numbers of the random-access units."""

    payload: bytes = b""
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    packets: int = 0
    stamps: list[int] = field(default_factory=list)
    entries: list[int] = field(default_factory=list)
    discontinuities: int = 0
    damaged: int = 0


def table_of(packet: bytes, at: int) -> bytes | None:
    """The section in a packet with a pointer field at `at`, or None where its checksum fails."""
    at += 1 + packet[at]
    end = at + 3 + (struct.unpack_from(">H", packet, at + 1)[0] & 0x0FFF)
    return packet[at:end] if end <= len(packet) and crc_mpeg(packet[at:end]) == 0 else None


def read_stream(data: bytes) -> Stream:
    """Parse a transport stream. Packets without the sync byte, tables with a wrong checksum and units whose length is
    not the one they state count as damaged; repeated or missing counters as discontinuities."""
    out, counters, buffers, units, tables = Stream(), {}, {}, [], {}

    def finish(pid: int) -> None:
        parts = buffers.pop(pid, None)
        if parts is None:
            return
        pes = b"".join(parts[1])
        if len(pes) < 9 or pes[:3] != b"\0\0\1" or struct.unpack_from(">H", pes, 4)[0] != len(pes) - 6:
            out.damaged += 1
            return
        if pes[7] & 0x80:
            a, b, c = struct.unpack_from(">BHH", pes, 9)
            out.stamps.append((a & 0x0E) << 29 | (b & 0xFFFE) << 14 | c >> 1)
        if parts[0]:
            out.entries.append(len(units))
        units.append(pes[9 + pes[8] :])

    for at in range(0, len(data), PACKET):
        packet = data[at : at + PACKET]
        out.packets += 1
        if len(packet) < PACKET or packet[0] != SYNC:
            out.damaged += 1
            continue
        pid, control, begins = (packet[1] & 0x1F) << 8 | packet[2], packet[3], packet[1] & 0x40
        start, entry = 4, False
        if control & 0x20:
            entry = packet[4] > 0 and bool(packet[5] & 0x40)
            start = 5 + packet[4]
        if not control & 0x10:
            continue
        if (before := counters.get(pid)) is not None and control & 15 != before + 1 & 15:
            out.discontinuities += 1
        counters[pid] = control & 15
        if pid == PAT_PID or pid in tables:
            own = packet[start:]
            if own not in (seen := tables.setdefault(pid, {})):
                seen[own] = table_of(own, 0)
                if (found := seen[own]) is None:
                    out.damaged += 1
                elif pid == PAT_PID:
                    for number, to in struct.iter_unpack(">HH", found[8:-4]):
                        out.programs[number] = to & 0x1FFF
                        tables.setdefault(to & 0x1FFF, {})
                else:
                    place = 12 + (struct.unpack_from(">H", found, 10)[0] & 0x0FFF)
                    while place < len(found) - 4:
                        kind, to, more = struct.unpack_from(">BHH", found, place)
                        out.streams[to & 0x1FFF] = kind
                        place += 5 + (more & 0x0FFF)
        elif pid in out.streams:
            if begins:
                finish(pid)
                buffers[pid] = (entry, [])
            if pid in buffers:
                buffers[pid][1].append(packet[start:])
    for pid in list(buffers):
        finish(pid)
    out.payload = b"".join(units)
    return out


def padded(text: str) -> tuple[int, bytes]:
    """Bytes of the text, and the text padded with spaces to a positive multiple of `PAD`."""
    data = text.encode("utf-8", "replace")
    return len(data), data.ljust(max(PAD, -(-len(data) // PAD) * PAD), b" ")


def with_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, n_bytes, media`: the padded text of each row as a transport stream. A null text counts as empty."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [padded(t or "") for t in batch.column(1).to_pylist()]
            media = [write_stream(p) for _, p in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_columns(media: DataFrame) -> DataFrame:
    """Columns read from `doc_id, n_bytes, media`: the payload, timestamps and random-access units of each stream, its
    programs (number to pid) and streams (pid to kind), and its packets, discontinuities and damaged parts. A null
    stream counts as empty and has no units. Repeated rows stay repeated."""
    bounded_batches(media.sparkSession)
    kinds = {
        "doc_id": pa.int64(), "n_bytes": pa.int64(), "payload": pa.binary(), "media_bytes": pa.int64(), "media_sha256": pa.string(),
        "stamps": pa.list_(pa.int64()), "entries": pa.list_(pa.int64()), "programs": pa.map_(pa.int32(), pa.int32()), "streams": pa.map_(pa.int32(), pa.int32()),
        "packets": pa.int64(), "discontinuities": pa.int64(), "damaged": pa.int64(),
    }
    schema = "doc_id long, n_bytes long, payload binary, media_bytes long, media_sha256 string, stamps array<long>, entries array<long>, programs map<int,int>, streams map<int,int>, packets long, discontinuities long, damaged long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in (m or b"" for m in batch.column(2).to_pylist()):
                s = read_stream(data)
                rows.append((s.payload, len(data), hashlib.sha256(data).hexdigest(), s.stamps, s.entries, list(s.programs.items()), list(s.streams.items()), s.packets, s.discontinuities, s.damaged))
            columns = list(zip(*rows, strict=True)) or [()] * 10
            read = [pa.array(list(c), kinds[k]) for c, k in zip(columns, list(kinds)[2:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *read], names=list(kinds))

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media_columns(with_media(read_table(spark, sf_dir, "documents")))
    feature = F.format_string(
        "packets=%d;units=%d;entries=%d;first=%d;last=%d;discontinuities=%d;damaged=%d;programs=%s;streams=%s",
        "packets", F.size("stamps"), F.size("entries"), F.try_element_at("stamps", F.lit(1)), F.try_element_at("stamps", F.lit(-1)), "discontinuities", "damaged",
        F.to_json("programs"), F.to_json("streams"),
    )
    tail = F.substring("payload", -16, 16)
    return found.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"), "media_bytes", "media_sha256", feature.alias("feature"),
    )
