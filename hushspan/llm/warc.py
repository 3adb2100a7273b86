"""Web archives: WARC records of pages, cut into segments where they are long, and their reassembly.

A response holds its page as an HTTP message in chunked transfer framing.  A record whose block is
longer than a segment goes on in continuation records, which name the origin record and their number;
the last one states the length of the whole.  Equal payloads are archived once, and later pages
revisit that record.  Reading finds the records of every archive file, brings only the segments of
cut records together, and takes the framing off again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushspan.llm.common import settled, shared_folder, text_batches

#: Bytes of a record's block beyond which it goes on in a continuation record.
SEGMENT = 32 << 10
#: Bytes after which an archive file ends; with one more segment that bounds every file.
ARCHIVE = 8 << 20
#: Bytes of a chunk of the transfer framing.
CHUNK = 4 << 10
#: Payloads of fewer bytes are archived each time.
LEAST = 100
#: A key that more than one row in HOT has is looked up by broadcast; there are fewer than HOT of them.
HOT = 1_000

EPOCH = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_END = b"\r\n\r\n"

RECORD = ("record_id string, warc_type string, target_uri string, refers_to string, payload_digest string, "
          "complete boolean, payload binary")
_PIECE = "origin string, number int, total long, block binary"


def chunked(payload: bytes, chunk: int = CHUNK) -> bytes:
    """The payload in chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), chunk):
        part = payload[at:at + chunk]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if the framing is broken or ends early.

    Extensions after a size and trailers after the last chunk are passed over.
    """
    parts, at = [], 0
    while True:
        line_end = body.find(b"\r\n", at)
        try:
            size = int(body[at:line_end].split(b";")[0].strip(), 16) if line_end >= 0 else -1
        except ValueError:
            return None
        at = line_end + 2
        if size < 0 or at + size > len(body):
            return None
        if size == 0:
            return b"".join(parts) if body.find(b"\r\n", at) >= 0 else None
        if body[at + size:at + size + 2] != b"\r\n":
            return None
        parts.append(body[at:at + size])
        at += size + 2


def message_payload(block: bytes) -> bytes | None:
    """The payload of an HTTP message, its transfer framing taken off; None if it is broken."""
    head, blank, body = block.partition(_END)
    if not blank:
        return None
    framing = [line.split(b":", 1)[1] for line in head.split(b"\r\n")[1:]
               if line.split(b":", 1)[0].strip().lower() == b"transfer-encoding" and b":" in line]
    return unchunked(body) if any(b"chunked" in f.lower() for f in framing) else body


def record(fields: list[tuple[str, str | int]], block: bytes) -> bytes:
    """One record; line ends in field values are percent-encoded."""
    lines = ["WARC/1.1"] + [f"{n}: {str(v).replace(chr(13), '%0D').replace(chr(10), '%0A')}" for n, v in fields]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + _END + block + _END


def record_id(page: Column | str, digest: Column | str) -> Column:
    """An id that reruns repeat; equal pages with equal payloads share it.  A null page id reads as empty."""
    page = F.col(page) if isinstance(page, str) else page
    quoted = F.replace(F.url_encode(F.coalesce(page.cast("string"), F.lit(""))), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit("<urn:page:"), quoted, F.lit(":"), digest, F.lit(">"))


def page_of(record: Column | str) -> Column:
    """The page id, as text, that a record id names; null for ids of another form."""
    column = F.col(record) if isinstance(record, str) else record
    quoted = F.regexp_extract(column, "^<urn:page:([^:]*):[0-9a-f]{64}>$", 1)
    return F.url_decode(F.when(quoted != "", quoted))


def page_records(name: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None,
                 segment: int) -> Iterator[bytes]:
    """The records of one page: a revisit, a response, or a response and its continuations."""
    fields = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", name), ("WARC-Date", EPOCH),
              ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if uri is not None:
        fields.append(("WARC-Target-URI", uri))
    if refers_to:
        yield record([*fields, ("WARC-Refers-To", refers_to), ("WARC-Profile", PROFILE)], _HEAD)
        return
    block = _HEAD + chunked(payload)
    if len(block) <= segment:
        yield record(fields, block)
        return
    yield record([*fields, ("WARC-Segment-Number", 1)], block[:segment])
    for number, at in enumerate(range(segment, len(block), segment), 2):
        part = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{number}>"), ("WARC-Date", EPOCH),
                ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", number)]
        if at + segment >= len(block):
            part.append(("WARC-Segment-Total-Length", len(block)))
        yield record(part, block[at:at + segment])


def _packed(segment: int, archive: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                for made in page_records(*row, segment):
                    held.append(made)
                    size += len(made)
                    if size >= archive:
                        yield _archive(held)
                        held, size = [], 0
        if held:
            yield _archive(held)
    return run


def _archive(records: list[bytes]) -> pa.RecordBatch:
    """One archive; its last line end is the one that the writer of text files adds."""
    return pa.RecordBatch.from_arrays([pa.array([b"".join(records)[:-1]], pa.binary())], ["value"])


def _looked_up(rows: DataFrame, side: DataFrame, key: str, total: int) -> DataFrame:
    """`rows` with the columns of `side` (one row for each `key`, `n` rows of `rows` that have it) or nulls.

    Keys of more than one row in HOT, fewer than HOT in number, are broadcast, so that no hot key
    meets in one task.  Their rows, and those without a key, are spread by the other columns where
    the rest is joined by shuffle.
    """
    values = [c for c in side.columns if c not in (key, "n")]
    hot = side.where(F.col("n") * HOT > total).drop("n").withColumnsRenamed({v: f"__hot_{v}" for v in values})
    rest = side.where(F.col("n") * HOT <= total).drop("n").withColumnRenamed(key, "__key")
    first = rows.join(F.broadcast(hot.withColumn("__is_hot", F.lit(True))), key, "left")
    spread = F.concat(F.lit("-"), F.xxhash64(*rows.columns).cast("string"))
    keyed = first.withColumn("__key", F.when(F.col("__is_hot").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(spread))
    return keyed.join(rest, "__key", "left").select(
        *rows.columns, *[F.coalesce(f"__hot_{v}", v).alias(v) for v in values])


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
                   segment: int = SEGMENT, archive: int = ARCHIVE) -> None:
    """Write a WARC record for every row of `pages` to archive files below `folder`.

    The payload is the html in UTF-8; null is archived as empty.  Of the rows with equal payloads of
    LEAST bytes or more the one with the smallest page id is the response and later ones revisit it;
    rows that repeat that id are responses too.  A null id comes after all others, and is a response
    if its payload has no other.  A null url leaves the target out.  Other columns are not read.
    A file holds `archive` bytes and at most one segment more, whatever the pages' sizes.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("page"), F.col(url).cast("string").alias("uri"),
                        payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    long = rows.where(F.octet_length("payload") >= LEAST)
    firsts = (long.groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n"))
              .where(F.col("n") > 1))
    # From files the planner knows the size of this table, and shuffles the pages only if it must.
    firsts.write.parquet(f"{folder}/firsts")
    firsts = pages.sparkSession.read.parquet(f"{folder}/firsts")
    typed = _looked_up(rows, firsts, "digest", max(1, pages.count()))
    again = F.col("first").isNotNull() & (F.col("page").isNull() | (F.col("page") > F.col("first")))
    given = typed.select(record_id("page", "digest").alias("name"), "uri", "payload", "digest",
                         F.when(again, record_id("first", "digest")).alias("refers_to"))
    packed = text_batches(given).mapInArrow(_packed(segment, archive), "value binary")
    (packed.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1)
     .option("compression", "none").text(f"{folder}/archives"))


def records_of(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of every whole record of an archive."""
    at = 0
    while (head_end := archive.find(_END, at)) >= 0:
        lines = archive[at:head_end].decode("utf-8", "replace").split("\r\n")
        fields = {n.strip().lower(): v.strip() for n, _, v in (line.partition(":") for line in lines[1:])}
        length = fields.get("content-length", "")
        if not lines[0].startswith("WARC/") or not length.isdigit():
            raise ValueError(f"no WARC record at byte {at}")
        start = head_end + len(_END)
        if start + int(length) > len(archive):
            raise ValueError(f"the record at byte {at} ends early")
        yield fields, archive[start:start + int(length)]
        at = start + int(length) + len(_END)


_ROW = pa.schema([("record_id", pa.string()), ("warc_type", pa.string()), ("target_uri", pa.string()),
                  ("refers_to", pa.string()), ("payload_digest", pa.string()), ("complete", pa.bool_()),
                  ("payload", pa.binary())])
_CUT = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])


def _described(fields: dict[str, str], payload: bytes | None) -> dict:
    digest = fields.get("warc-payload-digest", "")
    whole = payload is not None or fields.get("warc-type") == "revisit"
    return {"record_id": fields.get("warc-record-id"), "warc_type": fields.get("warc-type"),
            "target_uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"),
            "payload_digest": digest.rpartition(":")[2] or None, "complete": whole, "payload": payload}


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records with their payload; of cut ones the description and, in the other columns, the segment."""
    for batch in batches:
        for content in batch.column(0):
            found = []
            for fields, block in records_of(content.as_py()):
                row, cut = {}, fields.get("warc-segment-number")
                if fields.get("warc-type") != "continuation":
                    row = _described(fields, message_payload(block) if fields.get("warc-type") == "response" and not cut else None)
                if cut:
                    total = fields.get("warc-segment-total-length")
                    row |= {"origin": fields.get("warc-segment-origin-id") or fields.get("warc-record-id"),
                            "number": int(cut), "total": int(total) if total else None, "block": block}
                found.append(row)
            yield pa.RecordBatch.from_pylist(found, pa.schema([*_ROW, *_CUT]))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order become a block again, if none is missing and the length is the stated one."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}
            parts = row.pop("parts")
            block = b"".join(p["block"] for p in parts)
            whole = [p["number"] for p in parts] == list(range(1, len(parts) + 1)) and row.pop("total") == len(block)
            payload = message_payload(block) if whole else None
            row = {n: row.get(n) for n in _ROW.names} | {"complete": payload is not None, "payload": payload}
            yield pa.RecordBatch.from_pylist([row], _ROW)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The records below `folder`, as RECORD says, each whole again.

    `complete` is false, and the payload null, where segments are missing, the length is not the
    stated one or the framing is broken.  Revisits have no payload of their own, nor have records
    other than responses.  A task holds the archives of one partition of the read
    (spark.sql.files.maxPartitionBytes) and only segments of cut records are shuffled.
    Records that repeat an id, as of repeated rows, come back as often as they were written.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    found = files.mapInArrow(_read, f"{RECORD}, {_PIECE}")
    names = [f.split()[0] for f in RECORD.split(", ")]
    whole = found.where("number IS NULL").select(*names)
    # Repeated records have equal segments; one of each goes on, and how many there were.
    parts = (found.where("number IS NOT NULL").groupBy("origin", "number")
             .agg(F.max("total").alias("total"), F.first("block").alias("block"), F.count("*").alias("n"),
                  *[F.max(n).alias(n) for n in names if n not in ("complete", "payload")]))
    cut = parts.groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts"), F.max("total").alias("total"),
        F.max(F.when(F.col("number") == 1, F.col("n"))).alias("n"),
        *[F.max(n).alias(n) for n in names if n not in ("complete", "payload")])
    given = cut.withColumn("copy", F.explode(F.sequence(F.lit(1), F.coalesce("n", F.lit(1)))))
    fields = [n for n in names if n not in ("complete", "payload")]
    return whole.union(given.select(*fields, "total", "parts").mapInArrow(_joined, RECORD))


def archived_pages(spark: SparkSession, folder: str, id_type: str = "long") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page of the archives.

    The digest and size of a response are those of the payload as read; those of a revisit are the
    ones of the record it refers to, null if there is none.  An incomplete record has nulls.
    """
    read = read_archives(spark, folder).where("warc_type IN ('response', 'revisit')")
    slim = settled(read.select("record_id", "warc_type", "refers_to", F.octet_length("payload").cast("long").alias("size"),
                               F.when(F.col("payload").isNotNull(), F.sha2("payload", 256)).alias("digest")))
    again = slim.where("warc_type = 'revisit'").select("record_id", "refers_to")
    asked = again.groupBy("refers_to").agg(F.count("*").alias("n"))
    held = (slim.where("warc_type = 'response'").select(F.col("record_id").alias("refers_to"), "size", "digest")
            .dropDuplicates(["refers_to"]).join(asked, "refers_to"))
    revisits = _looked_up(again, held, "refers_to", max(1, again.count()))
    every = slim.where("warc_type = 'response'").select("record_id", "warc_type", "size", "digest", F.lit(None).cast("string").alias("refers_to"))
    every = every.union(revisits.select("record_id", F.lit("revisit"), "size", "digest", "refers_to"))
    return every.select(
        page_of("record_id").cast(id_type).alias("page_id"), F.col("size").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"), F.col("warc_type").alias("record_type"),
        page_of("refers_to").cast(id_type).alias("refers_to"))


def query(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """The pages written as archives into the shared folder and read back."""
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder)
    return archived_pages(spark, f"{folder}/archives", dict(pages.dtypes)["page_id"])


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, min(page_id) AS first FROM p WHERE strlen(h) >= 100 GROUP BY h),
t AS (SELECT p.*, g.first, g.first IS NOT NULL AND (p.page_id IS NULL OR p.page_id > g.first) AS again
      FROM p LEFT JOIN g ON p.h = g.h)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first END AS refers_to
FROM t
"""
