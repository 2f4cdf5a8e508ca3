"""Binary flow files: a Python data source that reads them, one partition per file, and a writer.

A file is a header of 40 bytes, blocks of records, and appendix blocks with the file's ident and totals. Blocks may be packed with LZ4,
bzip2, zstd or LZO. A record is a header of 12 bytes and extensions, each with its number and length; unknown ones are skipped.

    spark.dataSource.register(FlowFileSource)
    spark.read.format("flowfile").load("/data/flows")
"""

from __future__ import annotations

import bz2
import struct
from collections.abc import Iterable, Iterator
from decimal import Decimal
from io import BytesIO
from itertools import islice
from pathlib import Path
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from freshet.schema import SCHEMA

# File format.
MAGIC, LAYOUT = 0xA50C, 2
NONE, LZO, BZ2, LZ4, ZSTD = range(5)


class _Layout:
    """A compiled layout that can be sent to workers."""

    def __init__(self, text: str) -> None:
        self.text, self.size = text, struct.calcsize(text)

    def pack(self, *values) -> bytes:
        return struct.pack(self.text, *values)

    def unpack(self, b: bytes) -> tuple:
        return struct.unpack(self.text, b)

    def unpack_from(self, b: bytes, at: int = 0) -> tuple:
        return struct.unpack_from(self.text, b, at)


FILE_HEADER, BLOCK_HEADER, RECORD_HEADER, ELEMENT_HEADER = _Layout("<HHIqBBHIqII"), _Layout("<IIHH"), _Layout("<HHHBBHBB"), _Layout("<HH")
RECORD_BLOCK, FLOW_RECORD, IDENT_RECORD, STAT_RECORD = 3, 11, 0x8001, 0x8002
BLOCK_UNCOMPRESSED = 1
# Extension number, layout, columns. Two Q in a row named once are an IPv6 address (upper, lower half); x columns are read over.
EXTENSIONS = {
    1: ("<QQQQQHHBBBB", "first_ms last_ms received_ms in_packets in_bytes src_port dst_port proto tcp_flags fwd_status src_tos"), 2: ("<II", "src4 dst4"), 3: ("<QQQQ", "src6+ dst6+"),
    4: ("<IIBBBBBB", "input_if output_if src_mask dst_mask dir dst_tos biflow_dir end_reason"), 5: ("<QQQ", "cnt_flows out_packets out_bytes"), 6: ("<II", "src_vlan dst_vlan"), 7: ("<II", "src_as dst_as"), 8: ("<I", "bgp_next4"), 9: ("<QQ", "bgp_next6+"),
    10: ("<I", "next4"), 11: ("<QQ", "next6+"), 12: ("<I", "router4"), 13: ("<QQ", "router6+"), 14: ("<10I", "mpls*"), 15: ("<QQQQ", "in_src_mac out_dst_mac in_dst_mac out_src_mac"), 16: ("<II", "next_as prev_as"), 17: ("<QQQ", "client_us server_us app_us"),
    18: ("<QH", "selector_id sampler_sysid"), 19: ("<QIHB", "nsel_event_ms conn_id fw_xevent fw_event"), 20: ("<II", "x_src4 x_dst4"), 21: ("<QQQQ", "x_src6+ x_dst6+"), 22: ("<HH", "x_src_port x_dst_port"), 23: ("<3I3I", "ingress_acl* egress_acl*"), 24: ("<66s", "username$"),
    25: ("<QIB", "nat_event_ms nat_pool nat_event"), 26: ("<HHHH", "pb_start pb_end pb_step pb_size"), 27: ("", "nbar_id"), 28: ("", "label$"), 29: ("", "in_payload"), 30: ("", "out_payload"), 31: ("<III", "tun_src4 tun_dst4 tun_proto"), 32: ("<QQQQI", "tun_src6+ tun_dst6+ tun_proto"),
    33: ("<QI", "obs_point_id obs_domain_id"), 34: ("<HH", "frame_size link_type"), 35: ("", "inmon_frame"), 36: ("<II", "egress_vrf ingress_vrf"), 37: ("<BBBBIIII", "pf_action pf_reason pf_dir pf_rewritten pf_rule pf_subrule pf_uid pf_pid pf_ifname$"),
    38: ("<HHHHIIQHB", "vlan_id customer_vlan post_vlan post_customer_vlan l2_ingress l2_egress vxlan ether_type ip_version"), 39: ("<Q", "flow_id"), 40: ("<HH", "in_service_id out_service_id"), 41: ("", "nat_string$"), 42: ("<BBB", "frag_flags min_ttl max_ttl"),
}


class Corrupt(ValueError):
    """A file or block that doesn't hold what its header says."""


def _lz4(data: bytes, size: int) -> bytes:
    """LZ4 block format."""
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        token = data[i]
        i += 1
        run = token >> 4
        if run == 15:
            while True:
                run += data[i]
                i += 1
                if data[i - 1] != 255:
                    break
        out += data[i : i + run]
        i += run
        if i >= n:
            break
        back = data[i] | data[i + 1] << 8
        i += 2
        length = (token & 15) + 4
        if token & 15 == 15:
            while True:
                length += data[i]
                i += 1
                if data[i - 1] != 255:
                    break
        if not 0 < back <= len(out) or len(out) + length > size:
            raise Corrupt("bad LZ4 block")
        _copy(out, back, length)
    return bytes(out)


def _copy(out: bytearray, back: int, length: int) -> None:
    at = len(out) - back
    while length:
        piece = out[at : at + min(length, back)]
        out += piece
        length -= len(piece)
        at += len(piece)


def _lzo(data: bytes, size: int) -> bytes:
    """LZO1X stream, after its public description: literal runs, and matches in four length and distance classes."""
    out, i = bytearray(), 0

    def extended(base: int) -> int:
        nonlocal i
        n = base
        while data[i] == 0:
            n += 255
            i += 1
        n += data[i]
        i += 1
        return n

    def literals(n: int) -> None:
        nonlocal i
        out.extend(data[i : i + n])
        i += n

    state = 0  # literals copied by the last instruction: 0, 1..3, or 4 for a long run
    if data[0] > 17:
        n = data[0] - 17
        i = 1
        literals(n)
        state = n if n < 4 else 4
    while True:
        if i >= len(data) or len(out) > size:
            raise Corrupt("bad LZO block")
        t = data[i]
        i += 1
        if t < 16 and state == 0:
            n = t + 3 if t else extended(15) + 3
            literals(n)
            state = 4
            continue
        if t < 16:
            h = data[i]
            i += 1
            length, back = (2, (h << 2) + (t >> 2) + 1) if state < 4 else (3, (h << 2) + (t >> 2) + 2049)
            tail = t & 3
        elif t >= 64:
            h = data[i]
            i += 1
            back, tail = (h << 3) + (t >> 2 & 7) + 1, t & 3
            length = (t >> 5) + 1
        else:
            mask = 31 if t >= 32 else 7
            length = (t & mask) + 2 if t & mask else extended(mask) + 2
            lo = data[i] | data[i + 1] << 8
            i += 2
            tail = lo & 3
            if t >= 32:
                back = (lo >> 2) + 1
            else:
                back = 16384 + ((t & 8) << 11) + (lo >> 2)
                if back == 16384:
                    return bytes(out)
        if back > len(out):
            raise Corrupt("bad LZO block")
        _copy(out, back, length)
        literals(tail)
        state = tail


def _unpack(data: bytes, how: int, size: int) -> bytes:
    if how == NONE:
        return data
    if how == BZ2:
        return bz2.decompress(data)
    if how == ZSTD:
        import zstandard

        return zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
    return (_lz4 if how == LZ4 else _lzo)(data, size)


def decode_record(b: bytes, at: int, size: int) -> dict:
    """One flow record: its columns by name."""
    _, _, n, engine_type, engine_id, exporter, flags, version = RECORD_HEADER.unpack_from(b, at)
    r = {"engine_type": engine_type, "engine_id": engine_id, "exporter_id": exporter, "flags": flags, "nf_version": version}
    i, end = at + RECORD_HEADER.size, at + size
    for _ in range(n):
        kind, length = ELEMENT_HEADER.unpack_from(b, i)
        if length < 4 or i + length > end:
            raise Corrupt("bad extension")
        body = b[i + 4 : i + length]
        i += length
        if kind not in EXTENSIONS:
            continue
        layout, names = EXTENSIONS[kind]
        values = list(struct.unpack_from(layout, body)) if layout else []
        for name in names.split():
            plain = name.rstrip("+*$")
            if name[-1] == "+":
                r[plain] = values.pop(0).to_bytes(8, "big") + values.pop(0).to_bytes(8, "big")
            elif name[-1] == "*":
                k = 10 if plain == "mpls" else 3
                r[plain], values = values[:k], values[k:]
            elif name[-1] == "$":
                raw = values.pop(0) if values else body[struct.calcsize(layout) if layout else 0 :]
                r[plain] = raw.split(b"\0")[0].decode("utf-8", "replace")
            elif values:
                r[plain] = values.pop(0)
            else:
                r[plain] = body
    return r


def read_file(path: str) -> Iterator[dict]:
    """Records of a file, in order; corrupt blocks are skipped."""
    with open(path, "rb") as f:
        yield from read_records(f, path)


def read_records(f: BinaryIO, path: str) -> Iterator[dict]:
    head = f.read(FILE_HEADER.size)
    if len(head) < FILE_HEADER.size:
        raise Corrupt(f"{path}: short header")
    magic, version, _, _, packing, encryption, n_appendix, _, at_appendix, block_size, n_blocks = FILE_HEADER.unpack(head)
    if magic != MAGIC or version != LAYOUT:
        raise Corrupt(f"{path}: not a flow file of layout {LAYOUT}")
    if encryption:
        raise Corrupt(f"{path}: encrypted")
    ident = None
    if n_appendix and at_appendix:
        f.seek(at_appendix)
        ident = _ident(f, n_appendix, packing, block_size)
        f.seek(FILE_HEADER.size)
    for _ in range(n_blocks):
        try:
            block = _block(f, packing, block_size)
        except Corrupt:
            continue
        if block is None:
            return
        kind, body = block
        if kind != RECORD_BLOCK:
            continue
        i = 0
        try:
            while i + 4 <= len(body):
                t, size = ELEMENT_HEADER.unpack_from(body, i)
                if size < 4 or i + size > len(body):
                    raise Corrupt("bad record size")
                if t == FLOW_RECORD:
                    yield decode_record(body, i, size) | {"ident": ident}
                i += size
        except (Corrupt, struct.error):
            continue


def _block(f, packing: int, block_size: int) -> tuple[int, bytes] | None:
    h = f.read(BLOCK_HEADER.size)
    if len(h) < BLOCK_HEADER.size:
        return None
    _, size, kind, flags = BLOCK_HEADER.unpack(h)
    body = f.read(size)
    if len(body) < size:
        return None
    if flags & BLOCK_UNCOMPRESSED:
        return kind, body
    try:
        return kind, _unpack(body, packing, max(block_size, 1 << 22) * 4)
    except Exception as e:  # whatever a decompressor makes of broken input
        raise Corrupt(str(e)) from e


def _ident(f, blocks: int, packing: int, block_size: int) -> str | None:
    for _ in range(blocks):
        block = _block(f, packing, block_size)
        if block is None:
            return None
        body, i = block[1], 0
        while i + 4 <= len(body):
            t, size = ELEMENT_HEADER.unpack_from(body, i)
            if size < 4:
                return None
            if t == IDENT_RECORD:
                return body[i + 4 : i + size].split(b"\0")[0].decode("utf-8", "replace") or None
            i += size
    return None


def encode_record(r: dict) -> bytes:
    """Extensions of which any column is set; the other columns of the same extension are 0."""
    out, n = b"", 0
    for kind, (layout, names) in EXTENSIONS.items():
        cols = names.split()
        plain = [c.rstrip("+*$") for c in cols]
        if all(r.get(c) is None for c in plain) or (kind == 31 and r.get("tun_src4") is None) or (kind == 32 and r.get("tun_src6") is None):
            continue
        values, tail = [], b""
        for c, p in zip(cols, plain):
            v = r.get(p)
            if c[-1] == "+":
                v = v or bytes(16)
                values += [int.from_bytes(v[:8], "big"), int.from_bytes(v[8:], "big")]
            elif c[-1] == "*":
                k = 10 if p == "mpls" else 3
                values += (list(v or []) + [0] * k)[:k]
            elif c[-1] == "$":
                if layout.endswith("s"):
                    values.append((v or "").encode())
                else:
                    tail = (v or "").encode() + b"\0"
            elif layout:
                values.append(int(v or 0))
            else:
                tail = bytes(v)
        body = (struct.pack(layout, *values) if layout else b"") + tail
        out += ELEMENT_HEADER.pack(kind, 4 + len(body)) + body
        n += 1
    head = RECORD_HEADER.pack(FLOW_RECORD, RECORD_HEADER.size + len(out), n, *(int(r.get(c) or 0) for c in ("engine_type", "engine_id", "exporter_id", "flags", "nf_version")))
    return head + out


def write_records(f: BinaryIO, records: Iterable[dict], ident: str = "", packing: int = NONE, per_block: int = 1000) -> int:
    """A flow file, block by block as records come; packing is NONE, BZ2 or ZSTD. Gives the number of records."""
    def packed(b: bytes) -> bytes:
        if packing == BZ2:
            return bz2.compress(b)
        if packing == ZSTD:
            import zstandard

            return zstandard.ZstdCompressor().compress(b)
        if packing != NONE:
            raise ValueError("files are written plain, or packed with bzip2 or zstd")
        return b

    begin, blocks, n = f.tell(), 0, 0
    f.write(bytes(FILE_HEADER.size))
    records = iter(records)
    while part := list(islice(records, per_block)):
        body = packed(b"".join(encode_record(r) for r in part))
        f.write(BLOCK_HEADER.pack(len(part), len(body), RECORD_BLOCK, 0) + body)
        blocks, n = blocks + 1, n + len(part)
    name = ident.encode() + b"\0"
    appendix = ELEMENT_HEADER.pack(IDENT_RECORD, 4 + len(name)) + name
    at = f.tell() - begin
    f.write(BLOCK_HEADER.pack(1, len(appendix), RECORD_BLOCK, BLOCK_UNCOMPRESSED) + appendix)
    f.seek(begin)
    f.write(FILE_HEADER.pack(MAGIC, LAYOUT, 0, 0, packing, 0, 1, 0, at, 1 << 21, blocks))
    f.seek(0, 2)
    return n


def write_file(path: str, records: Iterable[dict], ident: str = "", packing: int = NONE, per_block: int = 1000) -> int:
    with open(path, "wb") as f:
        return write_records(f, records, ident, packing, per_block)


def to_files(flows: DataFrame, packing: int = ZSTD, per_file: int = 50_000) -> DataFrame:
    """Flows as the contents of flow files (ident, n, content), up to `per_file` records of one ident each: for sinks that take bytes, and for
    stores that only Spark can reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[dict]] = {}

        def packed(ready: list) -> pa.RecordBatch:
            out = []
            for ident, rows in ready:
                f = BytesIO()
                write_records(f, rows, ident, packing)
                out.append((ident, len(rows), f.getvalue()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.int64(), pa.binary()))], names=["ident", "n", "content"])

        for b in batches:
            for r in b.to_pylist():
                rows = held.setdefault(r.get("ident") or "", [])
                rows.append(r)
                if len(rows) == per_file:
                    yield packed([(r.get("ident") or "", held.pop(r.get("ident") or ""))])
        if held:
            for x in held.items():
                yield packed([x])

    return flows.select(*[c for c in SCHEMA.names if c in flows.columns]).mapInArrow(run, "ident string, n long, content binary")


def from_files(contents: DataFrame) -> DataFrame:
    """Records of flow files given as bytes (column `content`); what is no flow file gives nothing, corrupt blocks are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(SCHEMA)
        for b in batches:
            for content in b.column(0).to_pylist():
                try:
                    records = enumerate(read_records(BytesIO(content or b""), "content"), 1)
                    while part := [r | {"rec_no": i} for i, r in islice(records, 5000)]:
                        yield _batch(part, schema)
                except Corrupt:
                    continue

    return contents.select("content").mapInArrow(run, SCHEMA)


def load(spark, path: str) -> DataFrame:
    """Flow files below `path` in any store that Spark reads, a file to a task; the format `flowfile` reads block by block, but needs a folder
    that is mounted on every worker."""
    return from_files(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class FlowFileReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options.get("path")
        if not self.root:
            raise ValueError("load() needs a path")

    def partitions(self) -> list[InputPartition]:
        root = Path(self.root)
        files = [root] if root.is_file() else sorted(p for p in root.rglob("*") if p.is_file() and not p.name.startswith((".", "_")))
        return [_File(str(p)) for p in files]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(SCHEMA)
        rows: list[dict] = []
        number = 0
        for r in read_file(partition.path):
            number += 1
            rows.append(r | {"rec_no": number})
            if len(rows) == 5000:
                yield _batch(rows, schema)
                rows = []
        if rows:
            yield _batch(rows, schema)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    cols = []
    for f in schema:
        v = [r.get(f.name) for r in rows]
        if pa.types.is_decimal(f.type):
            v = [None if x is None else Decimal(x) for x in v]
        cols.append(pa.array(v, type=f.type))
    return pa.RecordBatch.from_arrays(cols, schema=schema)


class FlowFileSource(DataSource):
    """Format `flowfile`: a file, or a folder with all files below it. rec_no counts the records of a file."""

    @classmethod
    def name(cls) -> str:
        return "flowfile"

    def schema(self):
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FlowFileReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FlowFileWriter(self.options, schema)


class FlowFileWriter(DataSourceWriter):
    """One file per task, written under a hidden name and renamed when the job commits, to a folder that is mounted on every worker. Options:
    path, ident, packing (none, bz2, zstd)."""

    def __init__(self, options: dict, schema) -> None:
        self.root, self.ident = options["path"], options.get("ident", "")
        self.packing = {"none": NONE, "bz2": BZ2, "zstd": ZSTD}[options.get("packing", "zstd")]
        self.names = schema.names
        Path(self.root).mkdir(parents=True, exist_ok=True)

    def write(self, iterator) -> WriterCommitMessage:
        import uuid

        name = f".part-{uuid.uuid4().hex}"
        # a task's rows make one file, written block by block
        n = write_file(str(Path(self.root) / name), (dict(zip(self.names, r)) for r in iterator), self.ident, self.packing)
        if not n:
            (Path(self.root) / name).unlink()
        return _Written(name if n else None)

    def commit(self, messages) -> None:
        for m in messages:
            if m is not None and m.name:
                (Path(self.root) / m.name).rename(Path(self.root) / m.name[1:])

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and m.name:
                (Path(self.root) / m.name).unlink(missing_ok=True)


class _Written(WriterCommitMessage):
    def __init__(self, name: str | None) -> None:
        self.name = name


def verify(path: str) -> dict:
    """Blocks and records of a file, and how many blocks are corrupt."""
    good = bad = records = 0
    with open(path, "rb") as f:
        h = FILE_HEADER.unpack(f.read(FILE_HEADER.size))
        if h[0] != MAGIC:
            raise Corrupt(f"{path}: not a flow file")
        for _ in range(h[10]):
            try:
                b = _block(f, h[4], h[9])
                if b is None:
                    bad += 1
                    break
                good += 1
            except Corrupt:
                bad += 1
    records = sum(1 for _ in read_file(path))
    return {"blocks": good, "corrupt_blocks": bad, "records": records}


def repack(path: str, to: str, packing: int, ident: str | None = None) -> None:
    """Writes a file anew with another packing or ident."""
    rows = list(read_file(path))
    write_file(to, rows, ident if ident is not None else next((r["ident"] for r in rows if r.get("ident")), ""), packing)
