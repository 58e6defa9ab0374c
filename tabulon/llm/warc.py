"""WARC archives: written by Spark's text writer, read back as records, and
assembled into one nested row per capture.

*Writing.*  Every record is one string that ends before its closing blank lines;
the text writer's line separator is these blank lines, so a part file is a valid
(gzip) archive on any file system that Spark writes.  A page gives a request, a
response or revisit, and a metadata record; request and metadata name the
response as concurrent.

*Reading.*  The text reader cuts a part at blank lines in a stream.  Putting the
separator back between consecutive rows of a file gives its bytes again, from
which records are taken by their Content-Length, so payloads may hold any bytes,
blank lines and record headers included.  One record is held at a time.  Gzip
parts are not split, so their rows come in order.

*Assembly.*  Requests and metadata find their capture through concurrent-to
identifiers, named on either side, directly or by way of other such records:
identifiers are joined until nothing new is attached (one round unless records
are chained).  Payloads take no part in these joins.

Defined results: a null payload is empty; a null key leaves out the ``page-id``
field and comes back null; a null or empty URL leaves out the target, line ends
in a URL are percent-encoded.  Of equal payloads of at least ``least`` bytes those
with the smallest key are responses (null keys come last, and are all responses
when no key is known), all others revisit them.  Rows equal in key, URL and
payload are the same record written again and give a row each; their requests
and metadata, equal too, come once.  Records without a capture (a request that
names none) are in ``loose_records``.  An empty table gives an empty archive and
no captures; other columns of the pages are not read.  A truncated record or a
part that is not gzip raises ``ValueError``.
"""

from __future__ import annotations

import hashlib
from typing import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.common import settled, small_batches, written

#: Fixed values of the format.
END, VERSION = "\r\n\r\n", "WARC/1.1"
PRIMARY, SIDES = ("response", "revisit", "resource"), ("request", "metadata")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(kind: Column, *parts: Column) -> Column:
    """An identifier that depends on the parts alone (null and empty differ)."""
    seen = F.md5(F.concat_ws("\u0001", kind, *[F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(seen, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(kind, record_id: Column, date: str, uri: Column, content_type: str, block: Column, extra: dict[str, Column]) -> Column:
    """A record without its closing blank lines; null fields are left out."""
    fields = {"WARC-Type": F.lit(kind) if isinstance(kind, str) else kind, "WARC-Record-ID": record_id, "WARC-Date": F.lit(date),
              "WARC-Target-URI": uri, **extra, "Content-Type": F.lit(content_type),
              "Content-Length": F.octet_length(block).cast("string")}
    lines = [F.concat(F.lit(f"{k}: "), v) for k, v in fields.items()]
    return F.concat(F.concat_ws("\r\n", F.lit(VERSION), *lines), F.lit(END), block)


def page_records(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 100,
                 date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One ``value`` per record of every page: request, response or revisit, metadata."""
    body = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit("").cast("binary"))
    uri = F.replace(F.replace(F.col(f"`{url}`").cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    p = pages.select(F.col(f"`{key}`").alias("key"), F.when(uri != "", uri).alias("uri"), body.alias("body"))
    p = p.withColumn("digest", F.sha2("body", 256)).withColumn("id", _record_id(F.lit("response"), F.col("key"), F.col("uri"), F.col("digest")))
    known = p.where(F.octet_length("body") >= least).groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(F.isnull("key").alias("none"), "key", "uri", "id")).alias("first"))
    first = written(known.where("n > 1").select("digest", F.col("first.key").alias("first_key"), F.col("first.id").alias("first_id")), "warc-first")
    p = p.join(first, "digest", "left")
    again = F.col("first_id").isNotNull() & ~F.col("key").eqNullSafe(F.col("first_key"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length("body").cast("string"), F.lit(END))
    kind = F.when(again, "revisit").otherwise("response")
    block = F.when(again, head).otherwise(F.concat(head, F.col("body").cast("string")))
    digest = F.concat(F.lit("sha256:"), F.col("digest"))
    own, names = F.col("id"), [F.col("key"), F.col("uri"), F.col("digest")]
    host = F.regexp_extract(F.coalesce("uri", F.lit("")), "://([^/?#]*)", 1)
    path = F.regexp_extract(F.coalesce("uri", F.lit("")), "://[^/?#]*([^#]*)", 1)
    target = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    records = F.array(
        _record("request", _record_id(F.lit("request"), *names), date, F.col("uri"), "application/http;msgtype=request",
                F.concat(F.lit("GET "), target, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END)), {"WARC-Concurrent-To": own}),
        _record(kind, own, date, F.col("uri"), "application/http;msgtype=response", block,
                {"WARC-Payload-Digest": digest, "WARC-Refers-To": F.when(again, F.col("first_id")),
                 "WARC-Profile": F.when(again, F.lit(PROFILE))}),
        _record("metadata", _record_id(F.lit("metadata"), *names), date, F.col("uri"), "application/warc-fields",
                F.coalesce(F.concat(F.lit("page-id: "), F.col("key").cast("string"), F.lit("\r\n")), F.lit("")), {"WARC-Concurrent-To": own}))
    return p.select(F.explode(records).alias("value"))


def write_warc(records: DataFrame, path: str) -> None:
    """Records (``value``, without closing blank lines) as gzip archives, one per task."""
    records.select("value").write.option("lineSep", END).option("compression", "gzip").text(path)


class RecordStream:
    """Takes records from the bytes of one archive as they arrive."""

    def __init__(self, name: str):
        self.name, self.held, self.need, self.fields = name, bytearray(), None, None
        if not name.endswith(".gz"):
            raise ValueError(f"{name}: only gzip archives are read, as others may be split between tasks")

    def feed(self, more: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
        """Headers and block of every record that is complete now."""
        self.held += more
        while True:
            if self.need is None:
                while self.held[:2] == b"\r\n":                         # blank lines between records
                    del self.held[:2]
                end = self.held.find(b"\r\n\r\n")
                if end < 0:
                    return
                first, *lines = self.held[:end].decode("utf-8", "replace").split("\r\n")
                if not first.startswith("WARC/"):
                    raise ValueError(f"{self.name}: no record begins with {first[:40]!r}")
                self.fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)]
                size = [v for k, v in self.fields if k.lower() == "content-length"]
                if len(size) != 1 or not size[0].isdigit():
                    raise ValueError(f"{self.name}: a record without one Content-Length")
                del self.held[:end + 4]
                self.need = int(size[0])
            if len(self.held) < self.need + 4:
                return
            block = bytes(self.held[:self.need])
            if self.held[self.need:self.need + 4] != b"\r\n\r\n":
                raise ValueError(f"{self.name}: a record is longer than its Content-Length")
            del self.held[:self.need + 4]
            self.need = None
            yield self.fields, block

    def close(self) -> None:
        if self.need is not None or self.held.strip(b"\r\n"):
            raise ValueError(f"{self.name}: the last record is cut off")


RECORD = ("record_id string, type string, date string, target_uri string, content_type string, concurrent_to array<string>, "
          "refers_to string, fields array<struct<name: string, value: string>>, stated_digest string, "
          "payload_bytes long, payload_digest string, payload binary")


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of gzip archives.  The payload is what follows the HTTP head of
    a response, else the whole block; its size and SHA-256 are always of the
    whole.  Without ``payloads`` those of responses are left out of the rows."""
    import pyarrow as pa

    small_batches(spark)
    raw = spark.read.option("lineSep", END).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))
    pair = pa.struct([("name", pa.string()), ("value", pa.string())])
    kinds = [("record_id", pa.string()), ("type", pa.string()), ("date", pa.string()), ("target_uri", pa.string()), ("content_type", pa.string()),
             ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("fields", pa.list_(pair)), ("stated_digest", pa.string()),
             ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]

    def row(fields, block):
        by = {}
        for k, v in fields:
            by.setdefault(k.lower(), []).append(v)
        one = lambda k: by.get(k, [None])[0]
        kind = one("warc-type")
        if (one("content-type") or "").replace(" ", "").lower().startswith("application/http;msgtype=response"):
            block = block.partition(b"\r\n\r\n")[2]
        shown = block if payloads or kind not in PRIMARY else None
        return (one("warc-record-id"), kind, one("warc-date"), one("warc-target-uri"), one("content-type"), by.get("warc-concurrent-to", []),
                one("warc-refers-to"), [{"name": k, "value": v} for k, v in fields], one("warc-payload-digest"), len(block), hashlib.sha256(block).hexdigest(), shown)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        stream = None
        for b in batches:
            rows = []
            for file, piece in zip(b.column(0).to_pylist(), b.column(1)):
                if stream is None or stream.name != file:
                    if stream:
                        stream.close()
                    stream = RecordStream(file)
                rows += [row(*r) for r in stream.feed(piece.as_py() + b"\r\n\r\n")]
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds)], names=[k for k, _ in kinds])
        if stream:
            stream.close()

    return raw.mapInArrow(run, RECORD)


def attachments(records: DataFrame) -> DataFrame:
    """(side, capture): the captures that each request or metadata record
    belongs to, through concurrent-to identifiers."""
    ids = written(records.select("record_id", "type", "concurrent_to"), "warc-ids")
    first, other = ids.where(F.col("type").isin(*PRIMARY)), ids.where(F.col("type").isin(*SIDES))
    captures, sides = first.select(F.col("record_id").alias("to")).distinct(), other.select(F.col("record_id").alias("side")).distinct()
    named = other.select(F.col("record_id").alias("side"), F.explode("concurrent_to").alias("to"))
    back = first.select(F.explode("concurrent_to").alias("side"), F.col("record_id").alias("capture"))
    found = written(named.join(captures, "to", "left_semi").select("side", F.col("to").alias("capture"))
                    .unionByName(back.join(sides, "side", "left_semi")).distinct(), "warc-attached")
    step = named.join(captures, "to", "left_anti")
    step = written(step.unionByName(step.select(F.col("to").alias("side"), F.col("side").alias("to"))).distinct(), "warc-chained")
    while not step.isEmpty():
        loose = step.join(found.select("side").distinct(), "side", "left_anti")
        more = settled(loose.join(found.withColumnRenamed("side", "to"), "to").join(sides, "side", "left_semi").select("side", "capture").distinct())
        if more.isEmpty():
            break
        found = settled(found.unionByName(more))
    return found


def captures(records: DataFrame) -> DataFrame:
    """One row per response, revisit or resource record: its columns, and
    ``requests`` and ``metadata``, the records concurrent to it by identifier."""
    found = attachments(records)
    side = F.struct("record_id", "date", "content_type", "payload").alias("side_record")
    sides = records.where(F.col("type").isin(*SIDES)).select(F.col("record_id").alias("side"), F.col("type").alias("kind"), side)
    by = found.join(sides, "side").dropDuplicates(["capture", "side"]).groupBy("capture").agg(
        *[F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col("side_record")))).alias(name)
          for k, name in (("request", "requests"), ("metadata", "metadata"))])
    out = records.where(F.col("type").isin(*PRIMARY)).join(by, F.col("record_id") == F.col("capture"), "left").drop("capture")
    return out.withColumns({c: F.coalesce(c, F.array()) for c in ("requests", "metadata")})


def loose_records(records: DataFrame) -> DataFrame:
    """Requests and metadata that belong to no capture."""
    return records.where(F.col("type").isin(*SIDES)).join(attachments(records).select(F.col("side").alias("record_id")), "record_id", "left_anti")


def resolved(found: DataFrame, columns: list[str]) -> DataFrame:
    """Captures with ``original_<column>`` of the response that a revisit refers
    to (a response refers to itself; null where the archive does not hold it)."""
    found = written(found, "warc-captures")
    own = found.where("type <> 'revisit'").select("*", *[F.col(c).alias(f"original_{c}") for c in columns])
    held = found.where("type = 'response'").select(F.col("record_id").alias("_id"), *[F.col(c).alias(f"original_{c}") for c in columns])
    held = written(held.dropDuplicates(["_id"]), "warc-responses")
    again = found.where("type = 'revisit'").join(held, F.col("refers_to") == F.col("_id"), "left").drop("_id")
    return own.unionByName(again)


def pages_from_warc(records: DataFrame, key: str = "page_id") -> DataFrame:
    """``key``, payload_bytes, payload_digest, record_type and refers_to of every
    capture of archives that ``page_records`` wrote."""
    records = written(records.drop("fields", "stated_digest", "target_uri"), "warc-records")      # parsed once
    fields = F.col("metadata")[0]["payload"].cast("string")
    number = F.regexp_extract(F.coalesce(fields, F.lit("")), r"(?m)^page-id: (-?\d+)\r?$", 1)
    found = captures(records).select("record_id", "type", "refers_to", "payload_bytes", "payload_digest",
                                     F.when(number != "", number).cast("long").alias("key"))
    out = resolved(found, ["key", "payload_bytes", "payload_digest"])
    return out.select(F.col("key").alias(key), F.col("original_payload_bytes").alias("payload_bytes"),
                      F.col("original_payload_digest").alias("payload_digest"), F.col("type").alias("record_type"),
                      F.when(F.col("type") == "revisit", F.col("original_key")).alias("refers_to"))
