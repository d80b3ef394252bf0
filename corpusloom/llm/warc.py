"""WARC records over a content-addressed store.

`archive` writes two tables: `payloads` holds every distinct payload once under its SHA-256, and `records` holds the exact
header block of each record with the digest of its payload. `restore` joins them again, recomputes the digest of
every payload that it reads, and gives back each record byte for byte. Equal payloads are one before they are
shuffled, so a payload that a third of all pages have moves once per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._columns import named
from ._store import Scratch

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of_hex(digest: Column, size: int = 40) -> Column:
    """Upper-case base32, unpadded, of a hexadecimal digest whose size is a multiple of 5 digits."""
    out = []
    for k in range(0, size, 5):
        part = F.conv(F.substring(digest, k + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(_BASE32), F.shiftright(part, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _urn(page_id: Column) -> Column:
    """Ids are percent-encoded, so that no id ends a header or is taken for another; a null one is a bare percent sign."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(page_id.cast("string")), F.lit("%")), F.lit(">"))


def archive(pages: DataFrame, scratch: Scratch, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z") -> tuple[DataFrame, DataFrame]:
    """The tables (records, payloads) of pages. Of pages with equal payloads the one with the largest page_id is the response and
    the others revisit it. A null html is an empty payload; a null page_id is smaller than any other; rows that share the
    largest page_id and the payload are all responses. Line ends in a url are written as %0D and %0A."""
    rows = pages.select(named(page_id).alias("page_id"), named(url).cast("string").alias("url"), F.coalesce(named(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    again = F.xxhash64("payload")
    payloads = rows.groupBy("digest").agg(F.first("payload").alias("payload"), F.max("page_id").alias("owner"), (F.min(again) == F.max(again)).alias("one"))
    payloads = scratch.save(payloads.withColumn("payload", F.when(F.col("one"), F.col("payload")).otherwise(F.raise_error(F.lit("two payloads have the same digest")).cast("binary"))).drop("one"), "payloads")
    about = payloads.select("digest", "owner", base32_of_hex(F.sha1("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("n_bytes"))
    met = rows.select("page_id", "url", "digest").join(about, "digest")
    response = F.col("page_id").eqNullSafe(F.col("owner"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"), _field("Content-Length", F.col("n_bytes").cast("string")), F.lit("\r\n"))
    target = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _field("WARC-Type", F.when(response, "response").otherwise("revisit")),
        _field("WARC-Record-ID", _urn(F.col("page_id"))),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", target),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(response, F.lit("")).otherwise(F.concat(_field("WARC-Refers-To", _urn(F.col("owner"))), _field("WARC-Profile", F.lit(_PROFILE)))),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", (F.octet_length(F.col("http")) + F.when(response, F.col("n_bytes")).otherwise(0)).cast("string")),
        F.lit("\r\n"), F.col("http"),
    )
    records = met.withColumn("http", http).select("page_id", "digest", header.cast("binary").alias("header"))
    return scratch.save(records, "records"), payloads


def restore(records: DataFrame, payloads: DataFrame) -> DataFrame:
    """page_id, header, payload (the full one) and record (the exact bytes: a revisit has no payload in its block)."""
    own = F.col("payload")
    checked = F.when(F.sha2(own, 256) == F.col("digest"), own).otherwise(F.raise_error(F.lit("a stored payload does not match its digest")).cast("binary"))
    met = records.join(payloads.select("digest", "payload"), "digest").select("page_id", "header", checked.alias("payload"))
    block = F.when(header_field("WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return met.withColumn("record", F.concat(F.col("header"), block, F.lit(b"\r\n\r\n")))


def header_field(name: str, header: str = "header") -> Column:
    """A field of the header block; null where it is absent."""
    found = F.regexp_extract(F.decode(F.col(header), "UTF-8"), rf"(?s)^WARC/1\.1\r\n(?:[^\r\n]*\r\n)*?{name}: ([^\r\n]*)\r\n", 1)
    return F.nullif(found, F.lit(""))


def page_number(urn: Column, kind: str) -> Column:
    return F.url_decode(F.nullif(F.regexp_extract(urn, "^<urn:page:(.*)>$", 1), F.lit("%"))).cast(kind)


def read_back(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Archive pages, restore every record and describe it from its own bytes."""
    scratch = Scratch(pages.sparkSession, "warc")
    kind = pages.select(named(page_id)).schema[0].dataType.simpleString()
    found = restore(*archive(pages, scratch, page_id, url, html))
    payload = F.col("payload")
    return found.select(
        page_number(header_field("WARC-Record-ID"), kind).alias(page_id),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.when(F.concat(F.lit("sha1:"), base32_of_hex(F.sha1(payload))) == header_field("WARC-Payload-Digest"), F.substring(header_field("WARC-Payload-Digest"), 6, 32)).alias("payload_digest"),
        header_field("WARC-Type").alias("record_type"),
        page_number(header_field("WARC-Refers-To"), kind).alias("refers_to"),
        F.octet_length("record").cast("long").alias("record_bytes"),
    )
