"""WARC archives with one Zstandard frame per record and their dictionary in a leading skippable frame.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary; each record then is a frame of
its own, so a reader can decode any record alone. Writing and reading happen in tasks; the archives lie in the shared
folder, and a manifest names those of the attempts that succeeded.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
ARCHIVE_BYTES, DICTIONARY_BYTES, MOST_TASKS = 16 << 20, 32 << 10, 20_000
NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
DATE = "2024-01-01T00:00:00Z"
RECORD = "archive string, offset long, record_id string, record_type string, target_uri string, refers_to string, payload binary, payload_bytes long, payload_digest string, problem string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def train_dictionary(pages: DataFrame, payload: str, key: str, samples: int = 300, each: int = 4096) -> bytes:
    """A dictionary from the first bytes of at most so many payloads, those with the smallest hash of key; b'' if there are too few."""
    ids = pages.select(key).orderBy(F.xxhash64(key), key).limit(samples).distinct()  # keys alone are sorted and sent
    few = pages.join(F.broadcast(ids), key, "left_semi").select(F.substring(F.col(payload), 1, each)).limit(samples).collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [bytes(r[0]) for r in few if r[0]]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def mark_duplicates(pages: DataFrame, payload: str, key: str, min_bytes: int = 0) -> DataFrame:
    """Append lm_keep: for rows whose payload an equal one with a larger key stands for, that key; else null.

    Payloads are equal if SHA-256 and length are; SHA-1 alone could be made to clash. Sums of equal payloads are made before the shuffle, and the join back
    is one that Spark splits where one payload has many rows.
    """
    keyed = pages.withColumns({"lm_sha": F.sha2(payload, 256), "lm_size": F.octet_length(payload)})
    same = keyed.where(F.col("lm_size") >= min_bytes).groupBy("lm_sha", "lm_size").agg(F.max(key).alias("lm_last"), F.count("*").alias("lm_n")).where("lm_n > 1").drop("lm_n")
    joined = keyed.join(same, ["lm_sha", "lm_size"], "left")
    return joined.withColumn("lm_keep", F.when(~F.col(key).eqNullSafe(F.col("lm_last")), F.col("lm_last"))).drop("lm_sha", "lm_size", "lm_last")


def record(page_id: int | None, url: str | None, payload: bytes, keep: int | None) -> bytes:
    """A response with its payload, or a revisit with the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if keep is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if keep is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if keep is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{keep}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, folder: str, dictionary: bytes) -> DataFrame:
    """Write (page_id, url, payload, lm_keep) as archives in folder and return the manifest: archive, records, bytes.

    A null url has no header, a null page_id an empty one. Archives get names of their own, so what a lost attempt left
    is never read. The manifest is stored before this returns.
    """

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        pack = zstandard.ZstdCompressor(level=6, dict_data=known, write_checksum=True, write_content_size=True)
        done, out, name, n, size = [], None, "", 0, 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((f"{folder}/{name}", n, size))
                out = None

        for batch in batches:
            for page_id, url, payload, keep in zip(*(batch.column(k) for k in ("page_id", "url", "payload", "lm_keep")), strict=True):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.zst", 0, 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    if dictionary:
                        size += out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
                frame = pack.compress(record(page_id.as_py(), url.as_py(), payload.as_py(), keep.as_py()))
                size += out.write(frame)
                n += 1
                if size >= ARCHIVE_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["archive", "records", "bytes"])

    made = pages.select("page_id", "url", "payload", F.col("lm_keep").cast("long").alias("lm_keep")).mapInArrow(archives, "archive string, records long, bytes long")
    made.write.mode("overwrite").parquet(f"{folder}/manifest")
    return pages.sparkSession.read.parquet(f"{folder}/manifest")


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that starts at this offset ends, from its own headers."""
    magic, size = struct.unpack_from("<II", data, at)
    if magic & 0xFFFFFFF0 == SKIPPABLE & 0xFFFFFFF0:
        return at + 8 + size
    if magic != FRAME:
        raise ValueError(f"no frame at {at}")
    flags = data[at + 4]
    single, checksum = flags >> 5 & 1, flags >> 2 & 1
    at += 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    last = 0
    while not last:
        block = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = block & 1, block >> 1 & 3, block >> 3
        at += 3 + (1 if kind == 1 else size)
    return at + 4 * checksum


def frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each record's frame; the dictionary comes from the first skippable frame, if there is one."""
    view, at, unpack = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        end = frame_end(view, at)
        if end > len(view):
            raise ValueError(f"the frame at {at} is cut off")
        if struct.unpack_from("<I", view, at)[0] & 0xFFFFFFF0 == SKIPPABLE & 0xFFFFFFF0:
            if at == 0 and struct.unpack_from("<I", view)[0] == SKIPPABLE:
                held = bytes(view[8:end])
                if held[:4] == struct.pack("<I", FRAME):  # a dictionary may be a compressed frame itself
                    held = unpack.decompress(held)
                unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
        else:
            yield at, unpack.decompress(view[at:end])
        at = end


def bare(uri: str | None) -> str | None:
    return uri.removeprefix("<").removesuffix(">") if uri else None


def headers_of(lines: list[str]) -> dict[str, str]:
    """Header values by lower-case name; a line that begins with white space goes on with the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            out[name] = f"{out[name]} {line.strip()}".strip()
        else:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def differs(digest: str, data: bytes) -> bool:
    """Whether a labelled SHA-1 (base32 or hex) isn't that of the data; other algorithms aren't judged."""
    kind, _, value = digest.partition(":")
    return kind.lower() == "sha1" and value.lower() not in (base32_sha1(data).lower(), hashlib.sha1(data).hexdigest())


def parse(content: bytes) -> tuple:
    """record_id to problem of RECORD. A record that breaks a rule keeps what could be read and names the problem.

    The payload of HTTP records is what stands behind the HTTP head, that of all others the whole block. Digests are
    optional; payload_digest is the base32 SHA-1 of the payload, and of a revisit what its header says.
    """
    head, gap, rest = content.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    headers = headers_of(lines)
    record_id, kind, digest = bare(headers.get("warc-record-id")), headers.get("warc-type"), headers.get("warc-payload-digest", "")
    base, said = (record_id, kind, headers.get("warc-target-uri"), bare(headers.get("warc-refers-to"))), digest.partition(":")[2] or None
    bad = lambda why: (*base, None, None, said, why)
    if not gap or not re.fullmatch(r"WARC/\d+\.\d+", version):
        return bad("no WARC head")
    if missing := [k for k in NEEDED if k.lower() not in headers]:
        return bad(f"without {', '.join(missing)}")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        return bad("length differs from Content-Length")
    block = rest[:-4]
    if differs(headers.get("warc-block-digest", ""), block):
        return bad("block digest differs")
    http = headers.get("content-type", "").partition(";")[0].strip().lower() == "application/http"
    top, _, payload = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
    size = re.search(rb"(?mi)^Content-Length:[ \t]*(\d+)[ \t]*\r?$", top)
    if kind == "revisit":
        return (*base, None, int(size[1]) if size else None, said, None)
    if size and int(size[1]) != len(payload):
        return bad("payload differs from its HTTP length")
    if differs(digest, payload):
        return bad("payload digest differs")
    return (*base, payload, len(payload), base32_sha1(payload), None)


def read(archives: DataFrame) -> DataFrame:
    """The records (RECORD) of the archives named in column archive, whole files one after another in each task.

    An empty archive has no records; a record with a bad head, length or digest comes with its problem instead of a
    payload, and the rest of its archive is read; bytes that aren't a frame end an archive with one such row.
    """
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string())
    names = [x.split()[0] for x in RECORD.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("archive").to_pylist():
                fs, inner = pa.fs.FileSystem.from_uri(path)
                with fs.open_input_stream(inner, compression=None) as f:
                    data = f.read()
                rows, held = [], 0
                try:
                    for at, content in frames(data):
                        rows.append((path, at, *parse(content)))
                        held += len(content)
                        if held > ARCHIVE_BYTES // 4:
                            yield batch_of(rows)
                            rows, held = [], 0
                except (ValueError, IndexError, struct.error, zstandard.ZstdError) as e:
                    rows.append((path, None, *[None] * 7, f"broken archive: {e}"))
                yield batch_of(rows)

    names_only = archives.select("archive")
    tasks = min(MOST_TASKS, max(1, names_only.count()))  # a number of its own: names are small, so Spark would merge their partitions
    return names_only.repartition(tasks, "archive").mapInArrow(records, RECORD)


def round_trip(spark: SparkSession, pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Archive pages (page_id, url, html) in folder and return what reading the archives gives, with RECORD's columns.

    A null html is an empty payload. Of equal payloads of min_bytes or more the row with the largest page_id is the
    response and the others revisit it; repeated rows of that page_id are responses alike, and rows whose page_ids are
    all null are responses.
    """
    held = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    manifest = write(mark_duplicates(held, "payload", "page_id", min_bytes), folder, train_dictionary(held, "payload", "page_id"))
    return read(manifest)
