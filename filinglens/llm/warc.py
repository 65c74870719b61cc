"""A deterministic sharded WARC writer, and its reader."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import buckets_for, materialise, ranked

MIN_DEDUP_BYTES = 100
#: Repeated digests (under 100 bytes each) that are broadcast at most.
BROADCAST_ROWS = 50_000
ROLL_BYTES = 16 << 20
#: Raw payload bytes that one writing task takes, so the layout follows the data and not the cluster; more, once there would be more
#: than MAX_SPANS of them (a task streams its records, so its memory doesn't follow). The cuts are at most MAX_SPANS numbers.
SPAN_BYTES = 32 << 20
MAX_SPANS = 100_000
#: Fixed value: archives of the same rows are the same bytes, so the date is a parameter and never the clock.
DATE = "1970-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def decide(pages: DataFrame, min_bytes: int = MIN_DEDUP_BYTES, salts: int = 16) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, record_type, refers_to) for every page.

    Equal payloads of at least ``min_bytes``: the smallest page_id is the response. Digests are counted with map-side
    aggregation. Only repeated ones are joined back: broadcast while they are at most BROADCAST_ROWS rows (counted), else each
    with ``salts`` copies, so that a payload which holds a third of all rows is spread.
    """
    p = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    p = p.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn(
        "payload_digest", F.sha2(F.col("html").cast("binary"), 256)
    )
    again = (
        p.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("payload_digest", "first_id")
    )
    again = materialise(again)
    if again.count() <= BROADCAST_ROWS:
        p = p.join(F.broadcast(again), "payload_digest", "left")
    else:
        again = again.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")
        p = p.withColumn("salt", salt).join(again, ["payload_digest", "salt"], "left")
    other = (F.col("first_id") < F.col("page_id")) | (F.col("first_id").isNotNull() & F.col("page_id").isNull())
    other = F.coalesce(other, F.lit(False))
    return p.select(
        "page_id", "url", "html", "payload_bytes", "payload_digest",
        F.when(other, "revisit").otherwise("response").alias("record_type"),
        F.when(other, F.col("first_id")).alias("refers_to"),
    )


def record_id(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}|{url or ""}')}>"


def clean_uri(url: str | None) -> str:
    """Header values are one line; an unknown address is about:blank."""
    return re.sub(r"[\x00-\x20\x7f]+", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) if url else "about:blank"


def record_bytes(row, date: str) -> bytes:
    """One record; headers are made anew from the row, in a fixed order."""
    payload = row.html.encode("utf-8", "surrogatepass") if row.record_type == "response" else b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + payload
    page = None if pd.isna(row.page_id) else int(row.page_id)
    head = [
        ("WARC-Type", row.record_type), ("WARC-Record-ID", record_id(page, row.url)), ("WARC-Date", date),
        ("WARC-Target-URI", clean_uri(row.url)), ("WARC-Payload-Digest", f"sha256:{row.payload_digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("X-Page-Id", "" if page is None else str(page)), ("X-Page-Url", json.dumps(row.url)),
        ("X-Payload-Length", str(int(row.payload_bytes))),
    ]
    if row.record_type == "revisit":
        head += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("X-Refers-To-Page-Id", str(int(row.refers_to))),
        ]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def write_archives(
    decided: DataFrame, out: str, sizes: DataFrame | None = None, roll_bytes: int = ROLL_BYTES, level: int = 5, date: str = DATE,
) -> DataFrame:
    """Write the records below ``out`` (a URI of any store that pyarrow opens) and return the manifest.
    ``sizes`` (page_id, payload_bytes) may give the same rows more cheaply, to cut the spans from.

    Records are range-sorted by page_id: spans of about ``SPAN_BYTES`` of payload are cut where the running sum of the bytes,
    in order of page_id, passes a multiple of that (exact, so the same rows give the same spans), and each span is one task, sorted, whose files roll once their
    compressed size reaches ``roll_bytes``. Every record is its own gzip member without a time stamp. A task writes
    ``.tmp-<uuid>`` names and renames each file when it is whole, so a lost executor leaves no half file under a final
    name and its retry writes the same bytes again. The manifest is written last; readers take only what it lists.
    """
    spark = decided.sparkSession
    sizes = sizes if sizes is not None else decided.select("page_id", "payload_bytes")
    total = sizes.agg(F.sum("payload_bytes").alias("b")).first().b or 0
    span_bytes = max(SPAN_BYTES, -(-total // MAX_SPANS))
    cuts = _cuts(sizes, span_bytes) if total > span_bytes else []
    span = _span(F.col("page_id"), cuts)

    def write(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(out)
        rows: list[dict] = []
        span_no, part, buf, sha, n, first, last = None, 0, io.BytesIO(), hashlib.sha256(), 0, None, None

        def close() -> None:
            nonlocal part, buf, sha, n
            if n:
                name = f"part-{span_no:06d}-{part:05d}.warc.gz"
                temp = f"{base}/.tmp-{uuid.uuid4().hex}"
                with store.open_output_stream(temp) as f:
                    f.write(buf.getvalue())
                store.move(temp, f"{base}/{name}")
                rows.append({"file": name, "records": n, "bytes": buf.tell(), "sha256": sha.hexdigest(), "first_page": first, "last_page": last})
                part, buf, sha, n = part + 1, io.BytesIO(), hashlib.sha256(), 0

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if row.span != span_no:
                    close()
                    span_no, part = int(row.span), 0
                member = gzip.compress(record_bytes(row, date), level, mtime=0)
                buf.write(member)
                sha.update(member)
                page = None if pd.isna(row.page_id) else int(row.page_id)
                first, last, n = (page if n == 0 else first), page, n + 1
                if buf.tell() >= roll_bytes:
                    close()
        close()
        yield pd.DataFrame(rows, columns=["file", "records", "bytes", "sha256", "first_page", "last_page"]).astype(
            {"first_page": "Int64", "last_page": "Int64"}
        )

    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(out)
    store.create_dir(base, recursive=True)
    ordered = (
        decided.withColumn("span", span.cast("int"))
        .repartitionById(len(cuts) + 1, F.col("span"))
        .sortWithinPartitions("span", F.col("page_id").asc_nulls_first(), "url", "payload_digest")
    )
    manifest = ordered.mapInPandas(write, "file string, records long, bytes long, sha256 string, first_page long, last_page long")
    manifest.write.mode("overwrite").json(f"{out}/manifest")
    return spark.read.schema(manifest.schema).json(f"{out}/manifest")


def _cuts(sizes: DataFrame, span_bytes: int) -> list[int]:
    """The page_ids at which spans after the first begin, in order. Null page_ids are in the first."""
    pages = sizes.where("page_id IS NOT NULL").groupBy("page_id").agg(F.sum("payload_bytes").alias("bytes"))
    pages = materialise(pages)
    ends = pages.agg(F.min("page_id").alias("low"), F.max("page_id").alias("high")).first()
    if ends.low is None:
        return []
    spread = (F.col("page_id").cast("double") - float(ends.low)) / (float(ends.high) - float(ends.low) + 1.0)
    order = ranked(pages, [], spread, [F.col("page_id")], "at", size=F.col("bytes"), running="before", buckets=buckets_for(pages))
    starts = order.groupBy(F.floor(F.col("before") / span_bytes).alias("span")).agg(F.min("page_id").alias("start"))
    return sorted(r.start for r in starts.where("span > 0").collect())


def _span(page: Column, cuts: list[int], step: int = 256) -> Column:
    """How many cuts are not over a page_id, by a look at every ``step``-th cut and at those between two of them."""
    if not cuts:
        return F.lit(0)
    below = lambda values: F.size(F.filter(values, lambda c: c <= page))
    coarse = below(F.lit(cuts[::step]))
    fine = F.when(coarse > 0, (coarse - 1) * step + below(F.slice(F.lit(cuts), (coarse - 1) * step + 1, step))).otherwise(0)
    return F.coalesce(F.when(page.isNotNull(), fine), F.lit(0))


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of each record of a whole archive."""
    raw = gzip.GzipFile(fileobj=io.BytesIO(data)).read()  # gzip.decompress copies the rest for every member
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode().split("\r\n")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        start, size = end + 4, int(head["Content-Length"])
        block = raw[start : start + size]
        if hashlib.sha256(block).hexdigest() != head["WARC-Block-Digest"].removeprefix("sha256:"):
            raise ValueError(f"block digest differs in {head['WARC-Record-ID']}")
        yield head, block.split(b"\r\n\r\n", 1)[1]
        at = start + size + 4


def read_archives(spark: SparkSession, out: str, payloads: bool = True) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, record_type, refers_to) from the files the manifest lists.

    A file is at most the roll size plus one record, so it is read whole by one task. A payload's length and digest are
    computed from the bytes read; a revisit has none and states those of its full payload. Files that the
    manifest doesn't list with this very digest are left out. ``payloads=False`` leaves html null.
    """

    def parse(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["file"], pdf["content"], strict=True):
                sha, rows, held = hashlib.sha256(content).hexdigest(), [], 0
                for head, payload in parse_records(content):
                    own = head["WARC-Type"] == "response"
                    rows.append((
                        int(head["X-Page-Id"]) if head["X-Page-Id"] else None, json.loads(head["X-Page-Url"]),
                        payload.decode("utf-8", "surrogatepass") if own and payloads else None,
                        len(payload) if own else int(head["X-Payload-Length"]),
                        hashlib.sha256(payload).hexdigest() if own else head["WARC-Payload-Digest"].removeprefix("sha256:"),
                        head["WARC-Type"], None if own else int(head["X-Refers-To-Page-Id"]), file, sha,
                    ))
                    held += len(payload) + 500
                    if held > 8 << 20:
                        yield frame(rows)
                        rows, held = [], 0
                yield frame(rows)

    def frame(rows: list) -> pd.DataFrame:
        names = ["page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "sha256"]
        f = pd.DataFrame(rows, columns=names, dtype=object)
        return f.astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})

    listed = spark.read.schema("file string, sha256 string").json(f"{out}/manifest")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(out)
    records = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInPandas(
        parse,
        "page_id long, url string, html string, payload_bytes long, payload_digest string, record_type string, "
        "refers_to long, file string, sha256 string",
    )
    return records.join(listed, ["file", "sha256"], "left_semi").drop("file", "sha256")


def archive(pages: DataFrame, out: str, min_bytes: int = MIN_DEDUP_BYTES, **how) -> DataFrame:
    """Write ``pages`` (page_id, url, html; other columns are not archived) as WARC below ``out``; returns the manifest.

    Defined cases: null html is an empty payload; a null url is written as about:blank and read back as null; a null page_id
    sorts first; repeated rows give repeated records, all of the smallest page_id being responses; empty
    input writes a manifest without files.
    """
    sizes = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("payload_bytes")
    )
    return write_archives(decide(pages, min_bytes), out, sizes, **how)
