"""WARC archives: writing with revisit records for repeated payloads, and reading back.

Headers are shuffled by payload digest to find each payload's original. Records are then written by Spark's text writer,
whose rows are whole records, into gzipped archives of about ARCHIVE_BYTES before compression. Reading takes whole
archives, cuts them by Content-Length, and joins revisits to the responses they refer to.
"""

import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epsgroup.ship import ship
from epsgroup.workspace import Workspace

ARCHIVE_BYTES = 32 << 20
SMALLEST = 100  # payloads below so many bytes are never replaced by a revisit
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format
END = b"\r\n\r\n"


def _one_line(text):
    return F.regexp_replace(text, r"[\r\n]", " ")


def _name(identifier):
    return F.concat(F.lit("<urn:page:"), F.coalesce(_one_line(identifier.cast("string")), F.lit("")), F.lit(">"))


def write(pages: DataFrame, id_col: str, url_col: str, html_col: str, path: str, ws: Workspace, date: str) -> None:
    """Write one record per row to archives under `path`.

    Of the rows with equal payloads of at least SMALLEST bytes, those with the smallest id become responses and the others
    revisits of it. A null payload is empty, a row with a null id revisits those
    with ids (if there are none, all are responses), a null address is left out. Other columns are ignored; an empty table gives no records.
    Records are dealt to archives by digest and id, so archives are of about ARCHIVE_BYTES but for a larger single record, or
    rows that are equal in both, which share one.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "bytes": F.octet_length("payload").cast("long")})
    heads = ws.save(rows.select("id", "digest", "bytes"), "heads")
    same = heads.where(F.col("bytes") >= SMALLEST).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    firsts = ws.save(same.where("n > 1 AND first IS NOT NULL").drop("n"), "firsts")
    later = heads.join(firsts, "digest").where(~F.col("id").eqNullSafe(F.col("first")))
    named = F.concat_ws(":", F.isnull("id"), F.col("id").cast("string")).alias("named")  # never null, so that both sides are dealt alike
    later = ws.save(later.select(F.col("digest").alias("of"), named.alias("later"), "first").distinct(), "later")
    total = heads.agg(F.sum("bytes")).first()[0] or 0
    archives = max(1, -(-total // ARCHIVE_BYTES))
    # Both sides are dealt to the archives by the keys of the join, which then needs no other exchange, however it is done.
    dealt = rows.withColumn("named", named).repartition(archives, "digest", "named")
    known = (F.col("digest") == F.col("of")) & (F.col("named") == F.col("later"))
    dealt = dealt.join(later.repartition(archives, "of", "later"), known, "left")
    revisit = F.col("of").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit("\r\n\r\n")
    )
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), _name(F.col("id")),
        F.lit(f"\r\nWARC-Date: {date}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), _one_line(F.col("url"))), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _name(F.col("first")))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), block, F.lit("\r\n\r\n"),
        http, F.when(revisit, "").otherwise(F.col("payload")), F.lit("\r\n"),
    )
    dealt.select(record.alias("value")).write.option("lineSep", "\r\n").text(path, compression="gzip")


def records(archive: bytes):
    """(fields, block) of each record of an archive."""
    at = 0
    while at < len(archive):
        end = archive.index(END, at)
        lines = archive[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        start, size = end + len(END), int(fields["Content-Length"])
        yield fields, archive[start : start + size]
        at = start + size + len(END)


def _identifier(name):
    return name.removeprefix("<urn:page:").removesuffix(">") if name else None


def _parse(batches, with_payload):
    for batch in batches:
        for archive in batch.column(0):
            rows = []
            for fields, block in records(gzip.decompress(archive.as_buffer())):
                payload = block[block.index(END) + len(END) :]
                kind, said = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
                if kind == "response" and hashlib.sha256(payload).hexdigest() != said:
                    raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not have its digest")
                name, refers_to = _identifier(fields["WARC-Record-ID"]), _identifier(fields.get("WARC-Refers-To"))
                text = payload.decode() if with_payload and kind == "response" else None
                rows.append((name, fields.get("WARC-Target-URI"), kind, refers_to, said, len(payload), text))
            names = ["id", "url", "record_type", "refers_to", "payload_digest", "bytes", "payload"]
            kinds = [pa.string()] * 5 + [pa.int64(), pa.string()]
            arrays = [pa.array(c, k) for c, k in zip([*zip(*rows, strict=True)] or [()] * 7, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names)


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """(id, url, record_type, refers_to, payload_digest, bytes, payload) of every record; revisits have no payload here."""
    ship(spark)
    schema = "id string, url string, record_type string, refers_to string, payload_digest string, bytes long, payload string"
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(lambda batches: _parse(batches, with_payload), schema)


def resolve(found: DataFrame) -> DataFrame:
    """Records with the bytes and payload of revisits taken from the responses they refer to.

    Responses that share an id (repeated input rows) count once, by payload digest.
    """
    to = found.where("record_type = 'response'").dropDuplicates(["id", "payload_digest"])
    to = to.select(F.col("id").alias("to"), F.col("payload_digest").alias("to_digest"), F.col("bytes").alias("to_bytes"),
                   F.col("payload").alias("to_payload"))
    known = (F.col("refers_to") == F.col("to")) & (F.col("payload_digest") == F.col("to_digest"))
    revisits = found.where("record_type = 'revisit'").join(to, known, "left")
    revisits = revisits.withColumns({"bytes": F.col("to_bytes"), "payload": F.col("to_payload")})
    return found.where("record_type = 'response'").unionByName(revisits.select(*found.columns))


def round_trip(pages: DataFrame, id_col: str, url_col: str, html_col: str, ws: Workspace, date="1970-01-01T00:00:00Z"):
    """Write the pages, read the archives back: (id_col, payload_bytes, payload_digest, record_type, refers_to)."""
    archives = f"{ws.path}/archives"
    write(pages, id_col, url_col, html_col, archives, ws, date)
    found = ws.save(read(pages.sparkSession, archives, with_payload=False), "found")
    kind = pages.schema[id_col].dataType
    return resolve(found).select(
        F.nullif("id", F.lit("")).cast(kind).alias(id_col), F.col("bytes").alias("payload_bytes"), "payload_digest",
        "record_type", F.col("refers_to").cast(kind).alias("refers_to"),
    )
