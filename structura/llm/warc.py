"""WARC archives: a writer with revisit records, and a salvage reader (operator 9).

Every record is a gzip member of its own.  The reader checks each member
(CRC, length), each record (version line, headers, content length, block
and payload digest) and, when a check fails, searches for the next valid
member or version line; the bytes skipped are returned as quarantined
gaps beside the records.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, batches, ship_package, small_enough

#: Payloads shorter than this never become revisits.
REVISIT_BYTES = 100

VERSION, MEMBER = b"WARC/1.", b"\x1f\x8b\x08"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:page:"
#: A gzip member of no bytes: what the text sink writes after every record.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000030300000000000000" + "0000")
_STEP = 1 << 16
#: The longest header block of a record, and the most bytes that one member may inflate to.
HEADER_BYTES, MEMBER_BYTES = 1 << 16, 1 << 30


def record(page_id: int | None, url: str | None, payload: bytes, length: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record.  A revisit keeps the HTTP header, which has the length of the payload, and leaves the payload out."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    if not revisit:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>",
            "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}",
             f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "replace") + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """``data`` as one gzip member."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@dataclass(frozen=True)
class Record:
    start: int
    end: int
    headers: dict[str, str]
    payload: bytes
    payload_bytes: int


@dataclass(frozen=True)
class Gap:
    start: int
    end: int
    reason: str


class _Marks:
    """The next place of a mark in ``data``; a place found is kept until the search has passed it, so all searches together read the data once per mark."""

    def __init__(self, data: bytes) -> None:
        self.data, self.found = data, {}

    def __call__(self, mark: bytes, start: int) -> int:
        at = self.found.get(mark, -1)
        if at < start:
            at = self.data.find(mark, start)
            self.found[mark] = at = len(self.data) if at < 0 else at
        return at


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """All valid records of an archive in order, and the gaps between them.

    Gzip members and plain records may follow each other.  Of a member that
    holds damage, or doesn't inflate to its end, the valid records before,
    between and (as far as it inflates) after the damage are returned (with
    the member's offsets), and the damage is a gap.  In a member that fails
    its own check only records with a digest that holds count as valid, and
    only if the damage is found: in another record, or in the check itself.
    Else it may be in any header, which nothing checks, and all is a gap.
    """
    marks = _Marks(data)
    at, bad, reason = 0, None, ""
    while at < len(data):
        try:
            found, end, broken = _at(data, at, marks)
        except ValueError as e:
            if bad is None:
                bad, reason = at, str(e)
            at = min(marks(MEMBER, at + 1), marks(VERSION, at + 1))
            continue
        if bad is not None:
            yield Gap(bad, at, reason)
            bad = None
        yield from found
        if broken:
            bad, reason = at, broken
            # another member may begin before the place where this one broke off; plain text up to there is this member's
            at = min(marks(MEMBER, at + 1), marks(VERSION, end))
        else:
            at = end
    if bad is not None:
        yield Gap(bad, len(data), reason)


def _at(data: bytes, at: int, marks: _Marks) -> tuple[list[Record | Gap], int, str]:
    """Records and gaps of the record or member at ``at``, its end, and why the member broke off, if it did."""
    if data.startswith(VERSION, at):
        r = _record(data, at, marks)
        return [r], r.end, ""
    if not data.startswith(MEMBER, at):
        raise ValueError("no record begins here")
    plain, end, broken, found = _inflate(data, at)
    if not plain and not broken:
        return [], end, ""
    out: list[Record | Gap] = []
    for x in salvage_plain(plain, checked=bool(broken)):
        found |= isinstance(x, Gap)
        if isinstance(x, Record):
            out.append(Record(at, end, x.headers, x.payload, x.payload_bytes))
        elif not broken:
            out.append(Gap(at, end, f"in the member: {x.reason}"))
    if not any(isinstance(x, Record) for x in out) or broken and not found:
        raise ValueError(broken or (out[0].reason if out else "empty member"))
    return out, end, broken


def salvage_plain(data: bytes, checked: bool = False) -> Iterator[Record | Gap]:
    """As :func:`salvage`, without members; ``checked``: only records with a digest."""
    marks = _Marks(data)
    at, bad, reason = 0, None, ""
    while at < len(data):
        try:
            r = _record(data, at, marks)
            if checked and not (r.headers.get("warc-block-digest") or r.headers.get("warc-payload-digest")):
                raise ValueError("no digest in a damaged member")
        except ValueError as e:
            if bad is None:
                bad, reason = at, str(e)
            at = marks(VERSION, at + 1)
            continue
        if bad is not None:
            yield Gap(bad, at, reason)
            bad = None
        yield r
        at = r.end
    if bad is not None:
        yield Gap(bad, len(data), reason)


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str, bool]:
    """What the member at ``at`` inflates to, its end, and why it broke off, if it did: then all that came before the damage.

    Last: whether the damage is known to be in the member's own check.
    """
    z, out, view, size = zlib.decompressobj(31), [], memoryview(data), 0
    pos, step = at, _STEP
    while not z.eof:
        if pos >= len(data):
            return b"".join(out), len(data), "member is cut off", False
        before = z.copy()
        try:
            out.append(z.decompress(view[pos:pos + step]))
        except zlib.error as e:
            if step > 1:
                z, step = before, 256 if step > 256 else 1  # go up to the damage in smaller steps
                continue
            plain = b"".join(out)
            differ = int.from_bytes(data[pos - 3:pos + 1], "little") ^ zlib.crc32(plain)  # the sum's last byte is at ``pos``
            one_byte = sum((differ >> 8 * k) & 255 > 0 for k in range(4)) == 1
            return plain, pos, f"member: {e}", "length check" in str(e) or "data check" in str(e) and one_byte
        pos = min(pos + step, len(data))
        size += len(out[-1])
        if size > MEMBER_BYTES:
            return b"".join(out), pos, f"member inflates to more than {MEMBER_BYTES} bytes", False
    return b"".join(out), pos - len(z.unused_data), "", False


def _record(data: bytes, at: int, marks: _Marks) -> Record:
    if not re.compile(rb"WARC/1\.\d\r\n").match(data, at):
        raise ValueError("no version line")
    stop = marks(b"\r\n\r\n", at)
    if stop == len(data):
        raise ValueError("headers are cut off")
    if stop - at > HEADER_BYTES:
        raise ValueError("no end of the headers")
    headers: dict[str, str] = {}
    for line in data[at:stop].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[A-Za-z0-9-]+", name):
            raise ValueError("a line that is no header")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-record-id", "warc-type", "warc-date"):
        if not headers.get(name):
            raise ValueError(f"no {name}")
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        raise ValueError("no content length")
    start = stop + 4
    end = start + int(size)
    if data[end:end + 4] != b"\r\n\r\n":
        raise ValueError("the record doesn't end where its length says")
    block = data[start:end]
    _digest_holds(headers.get("warc-block-digest"), block, "block")
    payload, length = block, len(block)
    if headers.get("content-type", "").startswith("application/http"):
        top = block.find(b"\r\n\r\n")
        if top < 0:
            raise ValueError("no end of the HTTP header")
        payload = block[top + 4:]
        said = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)\s*(?:\r\n|$)", block[:top])
        length = int(said[1]) if said else len(payload)
    if headers.get("warc-type") != "revisit":
        _digest_holds(headers.get("warc-payload-digest"), payload, "payload")
        length = len(payload)
    return Record(at, end + 4, headers, payload, length)


def _digest_holds(said: str | None, data: bytes, what: str) -> None:
    kind, colon, value = (said or "").partition(":")
    if colon and kind.lower() in ("sha256", "sha1", "md5") and hashlib.new(kind.lower(), data).hexdigest() != value.lower():
        raise ValueError(f"wrong {what} digest")


def _id(value: str | None) -> int | None:
    m = re.fullmatch(rf"<{_ID}(-?\d+)>", value or "")
    return int(m[1]) if m else None


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """One record per row of ``pages``, in archives under ``path`` (one for each task).

    Of rows with equal payloads of at least ``REVISIT_BYTES`` bytes the one
    with the smallest id is a response and the others revisit it; of rows
    that share id and payload one is.  A null html is an empty payload.
    Rows without an id revisit like others but are never referred to; where
    no row of a group has an id, all are responses.  An empty table gives
    archives without records.  Roles are found from digests alone; pages
    meet them by broadcast if the list of revisits is small, else by
    shuffle on (id, digest).
    """
    spark = pages.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "warc-roles")
    html = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    every = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("payload"))
    every = every.withColumn("digest", F.sha2("payload", 256))
    sized = every.filter(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest", "page_id").agg(F.count("*").alias("copies"))
    sized = scratch.save(sized, "digests")
    firsts = sized.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.sum("copies").alias("n")).filter("n > 1 and first_id is not null")
    roles = scratch.save(sized.join(firsts.select("digest", "first_id"), "digest").filter("not page_id <=> first_id or copies > 1")
                         .select("digest", F.col("page_id").alias("id"), "first_id"), "roles")
    n = roles.count()
    rows = every.join(small_enough(roles, n, 96), (every["digest"] == roles["digest"]) & every["page_id"].eqNullSafe(roles["id"]), "left").select(
        "page_id", "url", "payload", every["digest"], "first_id")
    own = F.col("first_id").isNotNull() & F.col("page_id").eqNullSafe(F.col("first_id"))
    if roles.filter("id <=> first_id").limit(1).count():  # ids repeated with the same payload: one response each
        turn = F.row_number().over(W.partitionBy("page_id", "digest").orderBy(F.lit(1)))
        first = rows.filter(own).withColumn("turn", turn)
        rows = rows.filter(~own).withColumn("turn", F.lit(2)).unionByName(first)
    else:
        rows = rows.withColumn("turn", F.lit(2))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            made = []
            for page_id, url, payload, digest, first_id, turn in zip(*(c.to_pylist() for c in part.columns), strict=True):
                revisit = first_id is not None and turn > 1
                made.append(member(record(page_id, url, payload, len(payload), digest, first_id, revisit)))
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["member"])

    members = rows.select("page_id", "url", "payload", "digest", "first_id", "turn").mapInArrow(run, "member binary")
    # the text sink writes bytes as they are, and after each the separator: a gzip member of no bytes
    (members.select(F.col("member").cast("string").alias("value")).write
     .option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path))


_READ = pa.schema([("archive", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("gap", pa.string()), ("page_id", pa.int64()),
                   ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
                   ("refers_to", pa.int64()), ("payload", pa.binary())])
_READ_SQL = ("archive string, start long, end long, gap string, page_id long, url string, payload_bytes long, "
             "payload_digest string, record_type string, refers_to long, payload binary")


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all archives under ``path``: a gap's row has its reason in ``gap`` and no record columns.

    One archive is read by one task (at most 2 GB, the limit of a binary
    value; the writer's are far smaller).  Records of damaged archives are
    returned as far as they are valid, each once.
    """
    ship_package(spark)

    def rows(archive: str, data: bytes) -> Iterator[tuple]:
        for x in salvage(data):
            if isinstance(x, Gap):
                yield (archive, x.start, x.end, x.reason, *[None] * 7)
                continue
            kind, _, digest = x.headers.get("warc-payload-digest", "").partition(":")
            kept = x.payload if x.headers.get("warc-type") != "revisit" else None
            yield (archive, x.start, x.end, None, _id(x.headers.get("warc-record-id")), x.headers.get("warc-target-uri"), x.payload_bytes,
                   digest if kind.lower() == "sha256" else None, x.headers.get("warc-type"), _id(x.headers.get("warc-refers-to")),
                   kept if payloads else None)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for archive, data in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                yield from batches(_READ, rows(archive, data.as_py()), 256 if payloads else 4096)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, _READ_SQL)


def read_back(pages: DataFrame, path: str, id_col: str = "page_id") -> DataFrame:
    """The records of the archives that ``pages`` were written to, one per page: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Gaps are written to a log table beside (``archive, start, end, gap``).
    Where there is one, or records and pages differ in number, ValueError
    names the log: no page is lost in silence.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc-read")
    rows = scratch.save(read_archives(spark, path, payloads=False).drop("payload", "url"), "rows")
    gaps, n = rows.agg(F.count("gap"), F.count(F.when(F.col("gap").isNull(), 1))).first()
    if gaps or n != pages.count():
        scratch.save(rows.filter("gap is not null").select("archive", "start", "end", "gap"), "gaps")
        raise ValueError(f"{n} records read back, {gaps} gaps: see {scratch.root}/gaps")
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` and read the archives back, see :func:`read_back`."""
    path = f"{Scratch(pages.sparkSession, 'warc').root}/archives"
    write_archives(pages, path)
    return read_back(pages, path)
