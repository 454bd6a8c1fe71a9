"""A content-addressed WARC archive: payload bytes once, exact record headers apart, records rebuilt by joins.

An archive is a folder with two tables. `payloads` has each distinct payload once, under its SHA-256;
`heads` has a row for each record with the exact bytes before the payload and the payload's SHA-256.
Of the records of one payload one is a response, the others are revisits that refer to it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import cut, open_folder, shared_dir

#: Fixed values of the formats.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"

#: Pages have no time of their own: the date of all records, unless the caller has a better one.
DATE = "1970-01-01T00:00:00Z"

#: What `parsed` gives for each record.
FIELDS = "record_id string, page_id long, url string, record_type string, refers_to string, payload_bytes long, payload_digest string"


@dataclass(frozen=True)
class Archive:
    """Where an archive's tables are."""

    spark: SparkSession
    folder: str

    @property
    def payloads(self) -> DataFrame:
        return self.spark.read.schema("digest binary, payload binary").parquet(f"{self.folder}/payloads")

    @property
    def heads(self) -> DataFrame:
        return self.spark.read.schema("record_type string, digest binary, head binary").parquet(f"{self.folder}/heads")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"


def base32_of_hex(digits: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits (160 bits need no padding): four letters for each five digits."""
    alphabet = F.lit(BASE32)

    def letters(k: int) -> list[Column]:
        bits = F.conv(F.substring(digits, 5 * k + 1, 5), 16, 10).cast("int")
        return [alphabet.substr(F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]

    return F.concat(*[x for k in range(8) for x in letters(k)])


def _page_rows(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))


def _line(name: str, *value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), *[v if isinstance(v, Column) else F.lit(v) for v in value], F.lit("\r\n"))


def _record_id(page_id: Column, row: Column) -> Column:
    """<urn:page:ID:ROW>; the row keeps records of one page_id, or of none, apart."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), row.cast("string"), F.lit(">"))


def _heads(listed: DataFrame, least: int, date: str) -> DataFrame:
    """(record_type, digest, head) of each row of listed (row, page_id, url, digest, sha1, size)."""
    owner = listed.groupBy("digest").agg(F.max(F.struct("page_id", "row")).alias("owner"), F.count("*").alias("records"))
    shared = owner.where("records > 1").select("digest", "owner")  # most payloads have one record, and need no join
    of = listed.join(shared, "digest", "left").withColumn("revisit", (F.col("owner.row") != F.col("row")) & (F.col("size") >= least))
    revisit = F.coalesce("revisit", F.lit(False))
    # A header line ends at CR LF: control characters and blanks of an address are percent-encoded.
    url = F.col("url")
    for code in (*range(33), 127):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    digest = F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha1")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), _line("Content-Type", "text/html; charset=utf-8"), _line("Content-Length", F.col("size").cast("string")), F.lit("\r\n"))
    length = F.octet_length("http") + F.when(revisit, F.lit(0)).otherwise(F.col("size"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("row"))),
        F.coalesce(_line("WARC-Target-URI", url), F.lit("")),
        _line("WARC-Date", date),
        _line("WARC-Payload-Digest", digest),
        F.when(revisit, F.concat(_line("WARC-Refers-To", _record_id(F.col("owner.page_id"), F.col("owner.row"))), _line("WARC-Profile", REVISIT_PROFILE))).otherwise(F.lit("")),
        _line("Content-Type", "application/http; msgtype=response"),
        _line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
        F.col("http"),
    )
    return of.withColumn("http", http).select(F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"), "digest", head.cast("binary").alias("head"))


def write_archive(pages: DataFrame, folder: str, least: int = 0, date: str = DATE) -> Archive:
    """Write a record for every row of pages (page_id, url, html; more columns are ignored) under folder.

    The payload is html in UTF-8, nothing for null. Of the records with one payload of `least` bytes or
    more, that of the largest page_id is the response (nulls are the smallest; of rows with one page_id
    any one), the others are revisits of it; records of shorter payloads are all responses. A null url
    has no address line. An empty table makes an archive without records.

    Payloads are told apart by SHA-256. That equal digests stand for equal payloads is checked by their
    lengths and another hash; rows with one payload are brought together before they are shuffled.
    """
    rows = _page_rows(pages).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    size, other = F.octet_length("payload").cast("long"), F.xxhash64("payload")
    # The row number is written, so it is the same for all that read it.
    listed = cut(rows.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", "digest", F.sha1("payload").alias("sha1"), size.alias("size")))
    once = rows.select("digest", "payload", size.alias("size"), other.alias("other")).groupBy("digest").agg(F.any_value("payload").alias("payload"), *[f(c).alias(f"{c}{k}") for c in ("size", "other") for k, f in enumerate((F.min, F.max))])
    same = (F.col("size0") == F.col("size1")) & (F.col("other0") == F.col("other1"))
    checked = F.when(same, F.col("payload")).otherwise(F.raise_error(F.lit("two payloads have one SHA-256")).cast("binary"))
    once.select("digest", checked.alias("payload")).write.option("compression", "zstd").parquet(f"{folder}/payloads")
    _heads(listed, least, date).write.option("compression", "zstd").parquet(f"{folder}/heads")
    return Archive(pages.sparkSession, folder)


def records(archive: Archive) -> DataFrame:
    """(record binary) of every record, byte for byte: a response's head is joined to its payload, a revisit has none of its own."""
    heads = archive.heads
    full = heads.where("record_type = 'response'").join(archive.payloads, "digest")
    whole = full.select(F.concat("head", "payload", F.lit(END)).alias("record"))
    return whole.unionByName(heads.where("record_type = 'revisit'").select(F.concat("head", F.lit(END)).alias("record")))


def originals(archive: Archive) -> DataFrame:
    """(head, payload) of every record, revisits with the payload that they stand for."""
    return archive.heads.join(archive.payloads, "digest").select("head", "payload")


def parse_record(record: bytes) -> dict:
    """Header fields (lower-case names), the payload (of a response, checked against its digest) and its length."""
    head, split, block = record.partition(END)
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1" or not split:
        raise ValueError("not a WARC/1.1 record")
    fields = {n.lower(): v.strip() for n, _, v in (line.partition(":") for line in lines)}
    length = int(fields["content-length"])
    if block[length:] != END:
        raise ValueError("a record doesn't end where its Content-Length says")
    payload = block[:length].partition(END)[2]
    if fields["warc-type"] == "response" and fields["warc-payload-digest"] != f"sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}":
        raise ValueError("a payload doesn't match its digest")
    return fields | {"payload": payload}


def _page_of(record_id: str) -> int | None:
    page = record_id.removeprefix("<urn:page:").partition(":")[0]
    return int(page) if page else None


def _row(record: bytes) -> tuple:
    f = parse_record(record)
    own = f["warc-type"] == "response"
    digest = f["warc-payload-digest"].removeprefix("sha1:")
    return f["warc-record-id"], _page_of(f["warc-record-id"]), f.get("warc-target-uri"), f["warc-type"], f.get("warc-refers-to"), len(f["payload"]) if own else None, digest


def _batches(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "long": pa.int64()}
    names, types = zip(*(c.split() for c in FIELDS.split(", ")), strict=True)
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*part, strict=True), types, strict=True)], list(names))
            part = []
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*part, strict=True), types, strict=True)], list(names))


def parsed(found: DataFrame) -> DataFrame:
    """FIELDS of each record of found (record binary); a revisit's payload_bytes are null. A damaged record is an error."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(_row(r.as_buffer().to_pybytes()) for b in batches for r in b.column(0))

    return found.select("record").mapInArrow(parse, FIELDS)


def resolved(rows: DataFrame) -> DataFrame:
    """rows as parsed() gives them, with the payload_bytes of revisits from the records that they refer to; one that refers to nothing is an error."""
    rows = cut(rows)
    own = rows.where("record_type = 'response'")
    # Only responses that something refers to are met; many revisits of one are rows of one key, which an adaptive join splits.
    known = own.select(F.col("record_id").alias("refers_to"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"))
    others = rows.where("record_type = 'revisit'").join(known, "refers_to", "left")
    right = F.col("_digest") == F.col("payload_digest")
    size = F.when(right, F.col("_bytes")).otherwise(F.raise_error(F.concat(F.lit("no record for "), F.coalesce("refers_to", F.lit("null")))).cast("long"))
    return own.unionByName(others.withColumn("payload_bytes", size).select(*rows.columns))


def write_files(archive: Archive, folder: str) -> DataFrame:
    """(path, n_records) of the .warc.gz files with all records, each record a gzip member of its own; a file is under its name only when whole."""
    fs, base = open_folder(folder)
    fs.create_dir(base)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_folder(folder)
        name, n = uuid.uuid4().hex, 0
        with fs.open_output_stream(f"{base}/.{name}", compression=None) as out:
            for b in batches:
                for r in b.column(0):
                    out.write(gzip.compress(r.as_buffer().to_pybytes(), mtime=0))
                    n += 1
        fs.move(f"{base}/.{name}", f"{base}/{name}.warc.gz")
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}.warc.gz"]), pa.array([n], pa.int64())], ["path", "n_records"])

    return cut(records(archive).mapInArrow(write, "path string, n_records long"))


def read_files(files: DataFrame) -> DataFrame:
    """(record binary) of every record of .warc.gz files (path), one member after the other."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, name = open_folder(path)
                with fs.open_input_stream(name, compression="gzip") as source:
                    yield from _cut_records(source)

    return files.select("path").repartition(max(1, files.count())).mapInArrow(read, "record binary")


def _cut_records(source, at_once: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    rest, out, size = b"", [], 0
    while True:
        more = source.read(at_once)
        rest += more
        at = 0
        while (end := rest.find(END, at)) >= 0:
            length = next(int(x[15:]) for x in rest[at:end].decode().lower().split("\r\n") if x.startswith("content-length:"))
            stop = end + len(END) + length + len(END)
            if stop > len(rest):
                break
            out.append(rest[at:stop])
            size += stop - at
            at = stop
        rest = rest[at:]
        if out and (size > at_once or not more):
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
            out, size = [], 0
        if not more:
            if rest:
                raise ValueError("a file ends within a record")
            return


def digests(rows: DataFrame) -> DataFrame:
    """The columns of the query from resolved() rows."""
    page = F.regexp_extract("refers_to", "^<urn:page:(-?[0-9]*):", 1)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", F.when(page != "", page.cast("long")).alias("refers_to"))


def oracle_sql() -> str:
    bits = "CAST('0x' || substr(h, 5 * k + 1, 5) AS INT)"
    letters = " || ".join(f"substr('{BASE32}', 1 + (({bits} >> {s}) & 31), 1)" for s in (15, 10, 5, 0))
    return f"""
WITH p AS (
  SELECT page_id, sha1(coalesce(html, '')) AS h, sha256(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS owner FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate([{letters} FOR k IN range(8)], 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM r"""
