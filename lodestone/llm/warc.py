"""WARC records in ZIP archives: written by tasks, found through the archives' directories and indexes, read by ranges.

An archive holds stored members: ``archive/data.warc.gz``, a gzip member for each record, so any record can be read
alone; ``indexes/index.cdxj``, a line for each record with its offset and length; ``datapackage.json``.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
from collections.abc import Iterator
from contextlib import ExitStack

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import cut, uri_filesystem
from lodestone.llm.zipfiles import STORED, ZipWriter, members

DATA, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit that names the response with the equal payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"),
        ("WARC-Date", DATE),
        *([] if url is None else [("WARC-Target-URI", "".join(c if c > " " else "%20" for c in url))]),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        *([] if refers_to is None else [("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>"), ("WARC-Profile", PROFILE), ("X-Refers-To-Page", str(refers_to))]),
        *([] if page_id is None else [("X-Page-Id", str(page_id))]),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and the bytes behind them, of one record; names in lower case."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    names = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in http.decode("latin-1").split("\r\n")[1:])}
    return fields, names, payload


def with_originals(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html and refers_to: the page whose record holds the payload, null where that is the page itself.

    Of pages with equal payloads of ``least_bytes`` or more, the one with the largest page_id holds it; one without page_id does not, if another has one. The table of
    shared digests has no texts and is written first, so the join can split a payload that a third of all pages have.
    """
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumn("sha", F.sha1("html"))
    shared = pages.where(F.octet_length("html") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n"))
    shared = cut(shared.where("n > 1").select(F.col("sha").alias("shared_sha"), "original"), "warc-shared")
    joined = pages.join(shared, F.col("sha") == F.col("shared_sha"), "left")
    return joined.select("page_id", "url", "html", F.when(~F.col("original").eqNullSafe(F.col("page_id")), F.col("original")).alias("refers_to"))


def write_archives(pages: DataFrame, out: str, archive_bytes: int = 1 << 30) -> DataFrame:
    """Write rows (page_id, url, html, refers_to) to archives below ``out`` and return the manifest: archive, length, records.

    A task rolls over to a new archive after ``archive_bytes``. Only archives in the manifest count: what a task that ran
    twice has left is never read.
    """

    def write(batches):
        fs, root = uri_filesystem(out)
        fs.create_dir(root, recursive=True)
        made, zipped, index = [], None, []

        def close():
            zipped.finish()
            zipped.start(INDEX)
            zipped.write("".join(sorted(index)).encode())
            zipped.finish()
            zipped.start(PACKAGE)
            zipped.write(json.dumps({"profile": "data-package", "resources": [{"path": DATA}, {"path": INDEX}]}).encode())
            zipped.finish()
            zipped.close()
            stream.close()
            made.append((name, zipped.at, len(index)))

        for batch in batches:
            for page_id, url, html, original in zip(batch["page_id"], batch["url"], batch["html"], batch["refers_to"], strict=True):
                if zipped is None:
                    name, index = f"{uuid.uuid4().hex}.wacz", []
                    stream = fs.open_output_stream(f"{root}/{name}")
                    zipped = ZipWriter(stream, zip64=True)
                    zipped.start(DATA)
                blob = gzip.compress(record(page_id, url, html.encode(), original), 6, mtime=0)
                at = zipped.write(blob)
                index.append(f"{url or '-'} {DATE[:4]}0101000000 {json.dumps({'offset': str(at), 'length': str(len(blob)), 'filename': 'data.warc.gz'})}\n".replace("\n", "") + "\n")
                if zipped.at >= archive_bytes:
                    close()
                    zipped = None
        if zipped is not None:
            close()
        yield pd.DataFrame(made, columns=["archive", "length", "records"]).astype({"archive": object, "length": "int64", "records": "int64"})

    ids = pages.select(F.col("page_id").cast("string"), "url", "html", F.col("refers_to").cast("string"))  # as strings: pandas has no long with nulls
    ids.mapInPandas(write, "archive string, length long, records long").write.parquet(f"{out}/manifest")
    return pages.sparkSession.read.parquet(f"{out}/manifest")


def index_of(manifest: DataFrame, root: str) -> DataFrame:
    """archive, offset, length of each record, from the archives' directories and indexes alone."""

    def locate(batches):
        fs, base = uri_filesystem(root)
        for batch in batches:
            for name in batch["archive"]:
                with fs.open_input_file(f"{base}/{name}") as f:
                    found = {n: (method, at, size) for n, method, at, size in members(f, f.size())}
                    if any(found[n][0] != STORED for n in (DATA, INDEX)):
                        raise ValueError(f"{name}: a member is not stored, so it cannot be read by ranges")
                    _, data, _ = found[DATA]
                    _, at, size = found[INDEX]
                    f.seek(at)
                    spots = [json.loads(line[line.index(b"{") :]) for line in f.read(size).splitlines()]
                yield pd.DataFrame({"archive": name, "offset": [data + int(s["offset"]) for s in spots], "length": [int(s["length"]) for s in spots]})

    return manifest.select("archive").mapInPandas(locate, "archive string, offset long, length long")


def read_records(index: DataFrame, root: str, keep_payload: bool = True, together: int = 1 << 20, task_bytes: int = 64 << 20) -> DataFrame:
    """The records at the index' places, each task with its own stretches of places, near ones read in one range of up to ``together`` bytes.

    The number of tasks follows from the records' lengths, ``task_bytes`` each, as the index itself is small whatever they hold.
    """
    sc = index.sparkSession.sparkContext
    tasks = max(sc.defaultParallelism, -(-(index.agg(F.sum("length")).collect()[0][0] or 0) // task_bytes))  # one row
    spread = index.withColumn("stretch", F.floor(F.col("offset") / (1 << 20))).repartition(tasks, "archive", "stretch").sortWithinPartitions("archive", "offset")

    def read(batches):
        fs, base = uri_filesystem(root)
        with ExitStack() as opened:
            yield from read_all(batches, fs, base, opened)

    def read_all(batches, fs, base, opened):
        name, f = None, None
        for batch in batches:
            out = []
            for archive, lo, blob in _ranges(batch, together):
                if archive != name:
                    opened.close()
                    name, f = archive, opened.enter_context(fs.open_input_file(f"{base}/{archive}"))
                f.seek(lo)
                held = f.read(blob[-1][1] - lo)
                for begin, end in blob:
                    fields, http, payload = parsed(gzip.decompress(held[begin - lo : end - lo]))
                    said = fields["warc-payload-digest"].removeprefix("sha1:")
                    revisit = fields["warc-type"] == "revisit"
                    if not revisit and digest(payload) != said:
                        raise ValueError(f"{archive}, at {begin}: the payload's digest is not the one stated")
                    page, original = fields.get("x-page-id"), fields.get("x-refers-to-page")
                    out.append((None if page is None else int(page), fields.get("warc-target-uri"), int(http["content-length"]), said, fields["warc-type"], int(original) if original else None, payload if keep_payload and not revisit else None))
            page, url, n, said, kind, original, payload = zip(*out, strict=True) if out else ((),) * 7
            yield pd.DataFrame({"page_id": pd.array(page, dtype="Int64"), "url": url, "payload_bytes": n, "payload_digest": said, "record_type": kind, "refers_to": pd.array(original, dtype="Int64"), "payload": payload})

    return spread.select("archive", "offset", "length").mapInPandas(read, RECORD)


def _ranges(batch: pd.DataFrame, together: int) -> Iterator[tuple[str, int, list[tuple[int, int]]]]:
    held: tuple[str, int, list] | None = None
    for archive, offset, length in zip(batch["archive"], batch["offset"].tolist(), batch["length"].tolist(), strict=True):
        if held and held[0] == archive and offset == held[2][-1][1] and offset + length - held[1] <= together:
            held[2].append((offset, offset + length))
        else:
            if held:
                yield held
            held = (archive, offset, [(offset, offset + length)])
    if held:
        yield held


def round_trip(pages: DataFrame, out: str, least_bytes: int = 0, keep_payload: bool = False) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html; others ignored) and read all archives back.

    A null html is an empty payload; a null url gives a record without a target. Rows that repeat a page_id each get a
    record; those whose payload is held by their own page_id are responses. A null page_id holds a payload only if no other page has it.
    Payloads of any length are one record each. An empty table gives no archive and no rows.
    """
    manifest = write_archives(with_originals(pages, least_bytes), out)
    return read_records(cut(index_of(manifest, out), "warc-index"), out, keep_payload)
