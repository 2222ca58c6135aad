"""WARC archives: a writer and a splittable reader.

The writer gives each page a record in a gzip member of its own: a ``response`` with the page as body, or a ``revisit``
without it where a page with an equal body and a smaller id is the response. Which page is which follows from a table of
digests (grouped with map-side combination, so that a payload that a third of the pages share costs no more than others),
joined back by page id and digest; each page's body moves once, dealt by its id.

The reader deals byte ranges of the archives to tasks. A task looks for gzip magic in its range, tries each candidate by
decoding the member's head as a WARC record header, and owns the records whose member starts inside its range, reading on
beyond the range's end where the last one does. Magic that occurs inside compressed data fails the trial and is passed over.
An archive may hold another one as a payload, whose members are valid too. So tasks first list the chains of members that
follow each other in their range and where these lead; a narrow job for each archive follows them from its first byte and so finds the one
place in each range where its own records begin; then tasks read from there.

Archives of other writers are read as well: records of all types, header names in any case, folded header lines, and records without
payload digest, whose digest is computed. ``page_id`` and ``refers_to`` are those of this writer and null elsewhere. An archive that is cut
off, or that holds anything but records, is an error.

Defined cases: a null html is an empty payload; of rows that tie for the smallest id of a payload all are responses; a null
page id takes part as the largest id and is written without one; names of further columns do not matter; an empty table gives no
files and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.llm.common import checkpointed, fresh_path
from retort.llm.shared_files import new_file, opened

MAGIC = b"\x1f\x8b\x08"
#: An archive is closed at the first record end after so many bytes.
FILE_BYTES = 256 << 20
#: Byte range of a reading task.
SPLIT_BYTES = 8 << 20
_READ = 1 << 20
_LEAST_LEVEL = 1
_RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, record_id string, content_type string, payload binary"


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _page_urn(page_id: int) -> str:
    return f"<urn:page:{page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes | None, refers_to: int | None, bare: str, length: int) -> bytes:
    """One WARC record; without ``payload`` a revisit of the page ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if page_id is not None:
        lines.append(f"WARC-Page-ID: {_page_urn(page_id)}")
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{bare}")
    if payload is None:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {_page_urn(refers_to)}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def header_fields(head: bytes) -> dict[str, str]:
    """Header lines after the first, by names in lower case; a line that begins with white space goes on with the one before it."""
    fields, name = {}, None
    for line in head.decode("utf-8", errors="replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            fields[name] = f"{fields[name]} {line.strip()}".strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()
    return fields


def parsed(data: bytes) -> dict:
    """A whole record as a row: page, type, length and digest of the full payload, the page it refers to, and the payload if it is there.

    The payload of a response or request is the body of its HTTP message, that of any other record its block; a revisit has none, but the length and digest
    that its header gives.
    """
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = header_fields(head)
    size = int(fields.get("content-length", 0))
    block = rest[:size]
    if len(block) != size:
        raise ValueError("a record is cut off")
    kind, content = fields.get("warc-type", ""), fields.get("content-type", "")
    http, payload = {}, block
    if content.lower().startswith("application/http"):
        top, _, payload = block.partition(b"\r\n\r\n")
        http = header_fields(top)
    bare = fields.get("warc-payload-digest", "")
    bare = bare[5:] if bare[:5].lower() == "sha1:" else bare
    length = len(payload)
    if kind == "revisit":
        length, payload = int(http["content-length"]) if http.get("content-length", "").isdigit() else None, None
    elif not bare:
        bare = digest(payload)
    if "warc-page-id" in fields and payload is not None and (str(length) != http.get("content-length") or digest(payload) != bare):
        raise ValueError("a payload does not match its digest")
    number = lambda name: int(fields[name][len("<urn:page:") : -1]) if fields.get(name, "").startswith("<urn:page:") else None
    return {
        "page_id": number("warc-page-id"), "url": fields.get("warc-target-uri"), "record_type": kind, "payload_bytes": length, "payload_digest": bare or None,
        "refers_to": number("warc-refers-to"), "record_id": fields.get("warc-record-id"), "content_type": content or None, "payload": payload,
    }


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, html`` with ``refers_to``: the page that a revisit refers to, else null. Payloads under ``least_bytes`` are never revisits."""
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    bodies = rows.select("page_id", F.unhex(F.sha1("html")).alias("sha"), F.octet_length("html").alias("bytes"))
    firsts = bodies.filter(F.col("bytes") >= least_bytes).groupBy("sha", "bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1 and first is not null")
    firsts = checkpointed(firsts)  # both sides of the join are plain tables, so that a payload of very many pages is split
    revisits = bodies.join(firsts, ["sha", "bytes"]).filter(F.coalesce(F.col("page_id") != F.col("first"), F.lit(True)))
    known = revisits.select(F.col("page_id").alias("of"), "sha", F.col("first").alias("refers_to")).distinct()
    wide = rows.withColumn("sha", F.unhex(F.sha1("html")))
    return wide.join(known, wide.page_id.eqNullSafe(F.col("of")) & (wide.sha == known.sha), "left").select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "refers_to", wide.sha.alias("sha"), F.octet_length("html").alias("bytes"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write a record for each row of ``pages`` to archives in ``folder``; the files: ``path, bytes, records``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, out, size, n = None, None, 0, 0
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for row in zip(*columns, strict=True):
                page_id, url, html, refers_to, sha, length = (x.as_py() for x in row)
                if out is None:
                    uri = new_file(folder, ".warc.gz")
                    system, path = opened(uri)
                    out, size, n = system.open_output_stream(path, compression=None), 0, 0
                packer = zlib.compressobj(_LEAST_LEVEL, zlib.DEFLATED, 31)
                payload = None if refers_to is not None else (html or "").encode()
                member = packer.compress(record(page_id, url, payload, refers_to, base64.b32encode(sha).decode(), length)) + packer.flush()
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= FILE_BYTES:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pylist([{"path": uri, "bytes": size, "records": n}])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": uri, "bytes": size, "records": n}])

    return checkpointed(plan_records(pages, least_bytes).mapInArrow(write, "path string, bytes long, records long"))


class _Window:
    """Bytes of a file from a place on, read as they are needed."""

    def __init__(self, file, start: int, size: int):
        self.file, self.start, self.size, self.held = file, start, size, b""

    def bytes(self, at: int, n: int) -> memoryview:
        """Up to ``n`` bytes at ``at``, fewer only at the end of the file."""
        n = min(n, self.size - at)
        if at + n > self.start + len(self.held) or at < self.start:
            self.held, self.start = self.file.read_at(min(max(n, _READ), self.size - at), at), at
        return memoryview(self.held)[at - self.start : at - self.start + n]


def _member(window: _Window, at: int, whole: bool = True) -> tuple[bytes, int] | None:
    """The content of the gzip member at ``at`` and where it ends; None if no WARC record is there. Without ``whole`` the content is left out.

    A record that the end of the file cuts off is an error.
    """
    inflate, parts, place, head = zlib.decompressobj(31), [], at, b""
    try:
        while not inflate.eof:
            if place >= window.size:
                if len(head) == 5:
                    raise ValueError(f"a record that begins at byte {at} is cut off")
                return None
            raw = window.bytes(place, 64 << 10)
            part = inflate.decompress(raw)
            place += len(raw) - len(inflate.unused_data)
            if len(head) < 5:
                head = (head + part)[:5]
                if not b"WARC/".startswith(head):
                    return None
            if whole:
                parts.append(part)
    except zlib.error:
        return None
    return (b"".join(parts), place) if len(head) == 5 else None


def _candidates(window: _Window, start: int, end: int) -> Iterator[int]:
    """Places of gzip magic that start in a range."""
    at = start
    while at < end:
        ahead = bytes(window.bytes(at, min(_READ, end - at + len(MAGIC) - 1)))
        found = ahead.find(MAGIC)
        while found >= 0 and at + found < end:
            yield at + found
            found = ahead.find(MAGIC, found + 1)
        at += max(1, len(ahead) - len(MAGIC) + 1)


def chains_of_range(uri: str, start: int, end: int) -> list[dict]:
    """Chains of records that follow each other in a range: ``starts``, and ``leads``, the place after the last of them; null where no record is there though
    the range goes on."""
    system, path = opened(uri)
    chains, chain_of = [], {}
    with system.open_input_file(path) as f:
        scan, window = _Window(f, start, f.size()), _Window(f, start, f.size())
        for first in [0] if start == 0 else _candidates(scan, start, end):
            at, starts, leads = first, [], None
            while at not in chain_of:
                try:
                    member = _member(window, at, whole=False)
                except ValueError:  # cut off, or inside a payload; whether it counts is known later
                    member = None
                if member is None:
                    break
                starts.append(at)
                at = member[1]
                if at >= end:
                    leads = at
                    break
            if at in chain_of:
                leads = chains[chain_of[at]]["leads"]
            if starts:
                chain_of |= dict.fromkeys(starts, len(chains))
                chains.append({"starts": starts, "leads": leads})
    return chains


def _entries(rows: pa.Table) -> pa.Table:
    """Where the records of an archive begin in each of its ranges, by following the chains from its first byte."""
    ranges: dict[int, dict] = {}
    leads: dict[int, int | None] = {}
    for r in rows.to_pylist():
        ranges[r["start"]] = r
        for c in r["chains"]:
            leads |= dict.fromkeys(c["starts"], c["leads"])
    at, out, size = 0, [], max(r["bytes"] for r in ranges.values())
    for start in sorted(ranges):
        r = ranges[start]
        if at < r["end"] and at < size:
            out.append({"path": r["path"], "start": start, "end": r["end"], "entry": at})
            if leads.get(at) is None:
                raise ValueError(f"{r['path']}: what follows byte {at} is cut off or holds something that is no record")
            at = leads[at]
    return pa.Table.from_pylist(out, pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("entry", pa.int64())]))


def records_of_range(uri: str, start: int, end: int, entry: int | None = None) -> Iterator[dict]:
    """The records whose gzip member starts in the byte range of an archive, from ``entry`` on, or from the first candidate that is one."""
    system, path = opened(uri)
    with system.open_input_file(path) as f:
        window, at = _Window(f, start, f.size()), entry
        if entry is None:
            scan = _Window(f, start, f.size())
            at = next((c for c in _candidates(scan, start, end) if _member(window, c, whole=False)), end)
        while at < min(end, window.size):
            member = _member(window, at)
            if member is None:
                raise ValueError(f"{uri}: no record at byte {at}")
            yield parsed(member[0])
            at = member[1]


_CHAINS = "path string, bytes long, start long, end long, chains array<struct<starts:array<bigint>,leads:bigint>>"


def _with_chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("starts", pa.list_(pa.int64())), ("leads", pa.int64())]))
    for batch in batches:
        for row in batch.to_pylist():
            chains = chains_of_range(row["path"], row["start"], row["end"])
            yield pa.RecordBatch.from_arrays([*(pa.array([row[c]]) for c in ("path", "bytes", "start", "end")), pa.array([chains], kind)], ["path", "bytes", "start", "end", "chains"])


def read_archives(files: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """Every record of the archives ``path, bytes``, by byte ranges: ``page_id, url, record_type, payload_bytes, payload_digest, refers_to, record_id, content_type, payload``."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)).cast("long"), F.lit(split_bytes).cast("long")))
    ranges = files.filter("bytes > 0").withColumn("start", starts).select("path", "bytes", "start", F.least(F.col("start") + split_bytes, "bytes").alias("end"))
    partitions = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("content_type", pa.string()), ("payload", pa.binary())])
    dealt = ranges.repartition(partitions, "path", "start")
    alone = dealt.filter(F.col("bytes") <= split_bytes).select("path", "start", "end", F.lit(0).cast("long").alias("entry"))
    chained = dealt.filter(F.col("bytes") > split_bytes).mapInArrow(_with_chains, _CHAINS)
    entered = alone.unionByName(chained.groupBy("path").applyInArrow(_entries, "path string, start long, end long, entry long"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held, size = [], 0
                for found in records_of_range(row["path"], row["start"], row["end"], row["entry"]):
                    if not payloads:
                        found["payload"] = None
                    held.append(found)
                    size += 500 + len(found["payload"] or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return entered.repartition(partitions, "path", "start").mapInArrow(read, _RECORDS)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the pages to archives in the shared folder and read the records back, without the payloads."""
    return read_archives(write_archives(pages, fresh_path(pages.sparkSession, "warc"), least_bytes), payloads=False)
