"""Legacy ARC archives to WARC, written, read back, and revisits resolved.

An ARC file starts with a ``filedesc://`` record whose second line names the version; version 1 records
have five header fields, version 2 ten, and both end with the length of what follows.  Fields are read
from the right, so that blanks in old URLs do no harm, and the body is taken by its declared length.
A WARC record gets an identifier that follows from its content, the timestamp in ISO form, a type
that follows from scheme and content type, and digests of block and payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.functions.session import shared_dir, staged

FIELDS = {1: ["url", "ip", "date", "type", "length"],
          2: ["url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length"]}
VERSION = "WARC/1.1"
END = "\r\n\r\n"
FILE_BYTES = 32 << 20      # wanted size of an archive file; a reader takes one whole
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")      # the URL name space of RFC 4122


class BadArchive(ValueError):
    """Header line or length that does not fit its version."""


def field(value) -> str:
    """A header field of an ARC record: blanks, line breaks and % become %XX; empty ones '-'."""
    return re.sub(r"[\s%]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), str(value)) if value not in (None, "") else "-"


def write_arc(records: list[dict], version: int = 1, name: str = "pages.arc") -> bytes:
    """An uncompressed ARC file."""
    note = f"{version} 0 tripleloom\n{' '.join(FIELDS[version])}\n".encode()
    first = {"url": f"filedesc://{name}", "ip": "0.0.0.0", "type": "text/plain", "body": note, **({"status": 200} if version == 2 else {})}
    out = bytearray()
    for r in [first, *records]:
        body = r["body"]
        values = {"date": "19700101000000", "offset": len(out), "filename": name, **r, "length": len(body)}
        out += " ".join(field(values.get(f)) for f in FIELDS[version]).encode() + b"\n" + body + b"\n"
    return bytes(out)


def read_arc(content: bytes) -> Iterator[dict]:
    """The records of an ARC file, its own description first; ``version`` as that states."""
    at, version = 0, None
    while True:
        while content[at:at + 1] == b"\n":
            at += 1
        if at >= len(content):
            return
        stop = content.find(b"\n", at)
        if stop < 0:
            raise BadArchive(f"no header line at {at}")
        line = content[at:stop].decode("utf-8", "replace").rstrip("\r")
        if version is None:
            if not line.startswith("filedesc://"):
                raise BadArchive("no file description")
            version = int(content[stop + 1:stop + 2] or b"0")
            if version not in FIELDS:
                raise BadArchive(f"unknown version {version}")
        names = FIELDS[version]
        values = line.rsplit(" ", len(names) - 1)
        if len(values) != len(names) or not values[-1].isdigit():
            raise BadArchive(f"bad header {line!r}")
        record = dict(zip(names, values)) | {"length": int(values[-1]), "version": version, "at": at}
        body = content[stop + 1:stop + 1 + record["length"]]
        if len(body) != record["length"]:
            raise BadArchive(f"{record['length']} bytes declared at {at}, {len(body)} there")
        yield record | {"body": body}
        at = stop + 1 + record["length"]


def digest(content: bytes) -> str:
    return base64.b32encode(hashlib.sha1(content).digest()).decode()


def stamp(date: str) -> str:
    """YYYYMMDDhhmmss, cut short or not, to ISO; the epoch when it is none."""
    if not re.fullmatch(r"\d{4,14}", date):
        return "1970-01-01T00:00:00Z"
    full = date.ljust(14, "0") if len(date) >= 8 else (date + "00000101000000"[len(date):])
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def http_header(body: bytes) -> int:
    """Bytes of the HTTP header that ``body`` starts with, with the empty line after it; 0 without one."""
    return body.find(b"\r\n\r\n") + 4 if body.startswith(b"HTTP/") and b"\r\n\r\n" in body else 0


def record_id(url: str, date: str, body_digest: str, extra: dict | None) -> str:
    """Identifier that follows from what a record holds, so that whoever converts it again gives it the same one."""
    return f"<urn:uuid:{uuid.uuid5(NAMES, ' '.join([url, date, body_digest, *(f'{k}={v}' for k, v in (extra or {}).items())]))}>"


def to_warc(record: dict, extra: dict | None = None, revisit_of: str | None = None) -> bytes:
    """The WARC record equivalent to an ARC record, without the two line ends that follow it.

    Types: ``warcinfo`` for the file description, ``resource`` for a name look-up (text/dns), ``response``
    for every other record, and ``revisit``, whose block is the HTTP header alone, when ``revisit_of``
    names another record.  The payload is the part after the HTTP header when the body starts with
    one, else the body."""
    body = record["body"]
    head = http_header(body)
    payload = body[head:]
    kind = ("warcinfo" if record["url"].startswith("filedesc://") else "resource" if record["type"] == "text/dns"
            else "revisit" if revisit_of is not None else "response")
    block = body[:head] if kind == "revisit" else body
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(record['url'], record['date'], digest(body), extra)}", f"WARC-Date: {stamp(record['date'])}"]
    if kind == "warcinfo":
        lines.append(f"WARC-Filename: {record['url'].removeprefix('filedesc://')}")
    elif record["url"] != "-":
        lines.append(f"WARC-Target-URI: {record['url']}")
    if kind != "warcinfo" and record["ip"] not in ("-", "0.0.0.0"):
        lines.append(f"WARC-IP-Address: {record['ip']}")
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {revisit_of}", f"X-Payload-Length: {len(payload)}"]
    lines += [f"{k}: {v}" for k, v in (extra or {}).items()]
    media = "application/warc-fields" if kind == "warcinfo" else "application/http; msgtype=response" if head else record["type"]
    lines += [f"Content-Type: {media}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def read_warc(content: bytes) -> Iterator[dict]:
    """Header fields (lower case) and ``block`` of each record of an uncompressed WARC file."""
    at = 0
    while True:
        while content[at:at + 2] == b"\r\n":
            at += 2
        if at >= len(content):
            return
        stop = content.find(b"\r\n\r\n", at)
        lines = content[at:stop].decode("utf-8").split("\r\n") if stop >= 0 else [""]
        if not lines[0].startswith("WARC/"):
            raise BadArchive(f"no WARC record at {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(head["content-length"])
        block = content[stop + 4:stop + 4 + length]
        if len(block) != length:
            raise BadArchive(f"{length} bytes declared at {at}, {len(block)} there")
        yield head | {"block": block}
        at = stop + 4 + length


def base32_sha1(content: Column) -> Column:
    """Bare upper-case base32 SHA-1 without Python: five hex digits are four letters."""
    bits, letters = F.sha1(content), "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    whole = [F.conv(F.substring(bits, 1 + 10 * i, 10), 16, 10).cast("long") for i in range(4)]
    out = [F.substring(F.lit(letters), F.pmod(F.shiftright(v, 5 * (7 - k)), F.lit(32)).cast("int") + 1, F.lit(1)) for v in whole for k in range(8)]
    return F.concat(*out)


def convert(pages: DataFrame, path: str, version: int = 1, least: int = 0) -> None:
    """Write ``pages`` (page_id, url, html) as ARC records and those, converted, as WARC files in ``path``.

    Payloads of at least ``least`` bytes that are equal are stored once, in the record with the largest
    page_id (of rows that repeat that id, and of null ids when all are null, all are stored); the others
    become revisits of it and refer to it by its identifier.  Every file begins with a ``warcinfo`` record.  Files hold so many records that an average one stays under FILE_BYTES and
    none can pass 1 GiB unless one record does.  Every record is an HTTP response with the html as its
    payload, also html that itself looks like a response.  Null html is an empty payload, a null url
    is '-'.  Spark's text writer lays down the records, so that a task which is run again leaves no
    double records.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html"), F.lit("")).alias("html"), F.sha1(body).alias("digest"), F.octet_length(body).alias("size"))
    facts = staged(rows.select("page_id", "url", "digest", "size"))
    mean, most = facts.agg(F.avg("size"), F.max("size")).first()
    each = int(max(2, min(FILE_BYTES // ((mean or 0) + 1024), (1 << 30) // ((most or 0) + 1024))))
    keeper = F.max(F.struct("page_id", "url")).alias("keeper")
    copies = (facts.where(F.col("size") >= least).groupBy("digest", "size").agg(keeper, F.count(F.lit(1)).alias("n"))
              .where("n > 1").select("digest", "size", F.col("keeper.page_id").alias("keeper"), F.col("keeper.url").alias("keeper_url")))
    known = rows.join(copies, ["digest", "size"], "left").select("page_id", "url", "html", "keeper", "keeper_url")

    def to_records(batches):
        n, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            lines = []
            ids = batch["page_id"].astype("Int64")
            arc = write_arc([{"url": u, "type": "text/html", "ip": "0.0.0.0", "body": HTTP + h.encode("utf-8")} for u, h in zip(batch["url"], batch["html"])], version)
            about, *records = read_arc(arc)
            for record, page, keeper, url in zip(records, ids, batch["keeper"].astype("Int64"), batch["keeper_url"]):
                if n % each == 0:                            # the writer begins a new file here
                    lines.append(to_warc({**about, "body": info(about["version"])}, {"X-Part": f"{task}-{n // each}"}).decode("utf-8"))
                    n += 1
                other = pd.notna(keeper) and (pd.isna(page) or page != keeper)
                kept = record_id(field(url), record["date"], digest(record["body"]), page_header(keeper)) if other else None
                lines.append(to_warc(record, page_header(page), kept).decode("utf-8"))
                n += 1
            yield pd.DataFrame({"value": pd.Series(lines, dtype=object)})

    known.mapInPandas(to_records, "value string").write.option("lineSep", END).option("maxRecordsPerFile", each).option("compression", "gzip").text(path)


def page_header(page) -> dict:
    return {"X-Page-Id": "null" if pd.isna(page) else int(page)}


def info(version: int) -> bytes:
    return f"software: tripleloom\r\nformat: WARC File Format 1.1\r\nconverted-from: ARC version {version}\r\n".encode()


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, refers string"


def records_of(spark, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, record_id, refers) of every record in the archives but ``warcinfo``."""
    def records(batches):
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for r in read_warc(gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content):
                    if r["warc-type"] == "warcinfo":
                        continue
                    page = r["x-page-id"]
                    revisit = r["warc-type"] == "revisit"
                    payload = r["block"][http_header(r["block"]):] if r["content-type"].startswith("application/http") else r["block"]
                    stated, own = r["warc-payload-digest"].removeprefix("sha1:"), digest(payload)
                    if not revisit and own != stated:
                        raise BadArchive(f"page {page}: digest does not fit")
                    rows.append((None if page == "null" else int(page), int(r["x-payload-length"]) if revisit else len(payload), stated,
                                 r["warc-type"], r["warc-record-id"], r["warc-refers-to"] if revisit else None))
                yield pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "record_id", "refers"]).astype(
                    {"page_id": "Int64", "payload_bytes": "Int64"})
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInPandas(records, RECORD)


def read_back(spark, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record in the archives.

    A revisit's reference is resolved by the identifier it names, among the records of all archives; null if it is not there."""
    found = staged(records_of(spark, path))
    named = found.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers")).agg(F.max("page_id").alias("refers_to"))
    revisits = found.where("record_type = 'revisit'").join(named, "refers", "left")
    out = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    return (found.where("record_type <> 'revisit'").select(*out, F.lit(None).cast("long").alias("refers_to"))
            .unionByName(revisits.select(*out, "refers_to")))


def query(pages: DataFrame) -> DataFrame:
    """Every page as it comes back from the archives it was written to."""
    path = shared_dir(pages.sparkSession)
    convert(pages, path)
    return read_back(pages.sparkSession, path)



ORACLE = """
SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes,
       b32 AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM (
  SELECT page_id, html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper,
         list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + CAST(('0x' || substr(sha1(coalesce(html, '')), 1 + 10 * CAST(i // 8 AS INTEGER), 10))::BIGINT // CAST(pow(2, 5 * (7 - i % 8)) AS BIGINT) % 32 AS INTEGER), 1)),
           'string_agg', '') AS b32
  FROM pages)
"""
