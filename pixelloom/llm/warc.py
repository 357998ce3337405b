"""A deterministic sharded WARC writer, and a reader.

Records are dealt to shards by ranges of their id. A histogram of bytes over CELLS equal id ranges is refined where a
range holds more than a shard (each such range is cut into FINER, again and again), and merged into shards of about
`shard_bytes`, or of a MOST_SHARDS'th of the whole; so the bounds depend on the rows alone, not on how they lie in files, and
ids that are far apart or dense do no harm. An id with more than a shard (null, too) is dealt to several by a hash of payload
and url. A task sorts its shards by id and writes each record as a gzip member of its own; a file rolls when its compressed
size reaches `roll_bytes`. Headers, record ids and digests are made anew from the payload.

Commit: a file is written under a temporary name of its task attempt and renamed when it is whole, so a repeated task puts
an equal file in its place. When a shard is done, its own manifest follows in the same way; the last is the manifest of the
whole, which names the shards with their numbers of files and records. What an abandoned attempt left is then removed.

Of records with equal payloads of at least `least_bytes` bytes, the one with the smallest id is a response and the
others are revisits of it; smaller payloads are all responses. The digest is the bare base32 SHA-1 of the full payload.

Defined results: null html is an empty payload; null ids sort first and count as the smallest; null urls become
`urn:none:`, control characters and spaces of urls are percent-encoded; repeated ids keep a record each (rows of
equal id, url and payload are alike: all responses or all revisits); no rows give no files and no records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

CELLS, FINER, MOST_SHARDS = 4096, 64, 8192
SHARD_BYTES, ROLL_BYTES, LEAST_BYTES = 8 << 20, 1 << 20, 0
LEVEL = 3
#: Payloads that occur several times (60 bytes each) up to which their table is broadcast; beyond, it is joined by shuffles.
BROADCAST_ROWS = 200_000
DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
MANIFEST = "file string, shard long, part long, records long, bytes long, sha256 string"


def qualified(spark: SparkSession, folder: str) -> str:
    """The URI that Spark understands by a folder's name."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def filesystem(uri: str):
    """The file system of a URI and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def manifest_of(shard: int) -> str:
    return f"{shard:06d}/manifest.json"


def put(folder: str, name: str, data: bytes, attempt: str) -> None:
    """data under a temporary name in the same folder, then under its own."""
    store, path = filesystem(folder)
    inner, _, last = name.rpartition("/")
    store.create_dir(f"{path}/{inner}" if inner else path, recursive=True)
    temporary = "/".join(filter(None, (path, inner, f".{last}.{attempt}")))
    with store.open_output_stream(temporary) as f:
        f.write(data)
    store.move(temporary, f"{path}/{name}")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page}/{payload_digest}')}>"


def clean_url(url: str | None) -> str:
    if not isinstance(url, str) or not url:
        return "urn:none:"
    return "".join(f"%{b:02X}" if b <= 0x20 or b == 0x7F else chr(b) for b in url.encode("utf-8", "surrogatepass")) if any(c <= " " or c == "\x7f" for c in url) else url


def record(page: int | None, url: str | None, payload: bytes, refers: int | None, revisit: bool) -> bytes:
    """A whole record; a revisit carries the HTTP head only, its payload's size and digest are in the WARC headers."""
    own = digest(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page, own)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean_url(url)}", f"WARC-Payload-Digest: sha1:{own}", f"WARC-Block-Digest: sha1:{digest(block)}",
        f"X-Page-Id: {'' if page is None else page}", f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: {record_id(refers, own)}", f"X-Refers-To-Page: {'' if refers is None else refers}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member with a fixed head, so that equal records give equal bytes."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def marked(pages: DataFrame, page: str, url: str, html: str, least_bytes: int) -> DataFrame:
    """The rows as _page, _url, _html, _revisit, _refers, found by the payload's SHA-1 and size."""
    own = pages.select(F.col(page).cast("long").alias("_page"), F.col(url).cast("string").alias("_url"), F.coalesce(html, F.lit("")).alias("_html"))
    own = own.withColumn("_sha", F.unhex(F.sha1(F.col("_html").cast("binary"))))
    # Payloads that occur once need no mark; the others' first pages are few rows of 30 bytes, found with partial sums.
    groups = own.where(F.octet_length("_html") >= least_bytes).groupBy("_sha").agg(F.count("*").alias("_many"), F.min(F.struct(F.col("_page"), F.xxhash64("_url"))).alias("_first"))
    several = groups.where("_many > 1").select(F.col("_sha").alias("_gsha"), F.col("_first._page").alias("_refers"), F.col("_first.col2").alias("_fh"))
    several = shared.cut(several)
    if several.count() <= BROADCAST_ROWS:
        several = F.broadcast(several)
    out = own.join(several, (F.col("_sha") == F.col("_gsha")) & (F.octet_length("_html") >= least_bytes), "left")
    first = F.col("_page").eqNullSafe(F.col("_refers")) & F.xxhash64("_url").eqNullSafe(F.col("_fh"))
    return out.select("_page", "_url", "_html", (F.col("_gsha").isNotNull() & ~first).alias("_revisit"), "_refers")


def bounds_of(sizes: DataFrame, shard_bytes: int) -> tuple[np.ndarray, dict[int | None, int], int]:
    """The lowest id of each shard but the first; ids that need several shards, with how many; and the bytes of a shard.

    sizes(_page, _size) is scanned once for each refinement; ranges and their bytes come to the driver, at most
    CELLS + FINER * MOST_SHARDS each time.
    """
    low, high, total = sizes.agg(F.min("_page"), F.max("_page"), F.sum("_size")).first()
    target = max(shard_bytes, -(-(total or 0) // MOST_SHARDS))
    hot: dict[int | None, int] = {}
    nulls = sizes.where(F.col("_page").isNull()).agg(F.sum("_size")).first()[0] or 0
    if nulls > target:
        hot[None] = -(-nulls // target)
    if low is None:
        return np.zeros(0, np.int64), hot, target
    spark, cells = sizes.sparkSession, {}
    todo, parts = [(low, high + 1)], CELLS
    while todo:
        cut = [(a, b, max(1, -(-(b - a) // parts))) for a, b in todo]  # first id, the id after the last, ids of a cell
        if len(cut) == 1:
            a, b, w = cut[0]
            inside = sizes.where(F.col("_page").between(a, b - 1)).select("*", F.lit(0).alias("_k"), F.lit(a).cast("long").alias("_a"), F.lit(w).cast("long").alias("_w"))
        else:
            ranges = spark.createDataFrame([(k, a, b - 1, w) for k, (a, b, w) in enumerate(cut)], "_k int, _a long, _b long, _w long")
            firsts = np.array([a for a, _, _ in cut], np.int64)

            @F.pandas_udf("int")
            def range_of(pages: pd.Series) -> pd.Series:
                return pd.Series(np.searchsorted(firsts, pages.to_numpy(np.int64), "right") - 1)

            inside = sizes.where(F.col("_page") >= int(firsts[0])).withColumn("_k", range_of("_page"))
            inside = inside.join(F.broadcast(ranges), "_k").where(F.col("_page") <= F.col("_b"))
        found = inside.groupBy("_k", F.expr("(_page - _a) div _w").alias("_c")).agg(F.sum("_size").alias("_n")).collect()
        todo, parts = [], FINER
        for r in found:
            a, b, w = cut[r["_k"]]
            first = a + r["_c"] * w
            if r["_n"] <= target:
                cells[first] = r["_n"]
            elif w == 1:
                cells[first], hot[first] = r["_n"], -(-r["_n"] // target)
            else:
                todo.append((first, min(b, first + w)))
        todo.sort()
    starts, held = [], 0
    for first, n in sorted(cells.items()):
        if held and held + n > target:
            starts.append(first)
            held = 0
        held += n
    return np.array(starts, np.int64), hot, target


def write(pages: DataFrame, folder: str, page: str = "page_id", url: str = "url", html: str = "html", shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """The table written as WARC files into folder (a URI that all share); returns the list of files."""
    spark = pages.sparkSession
    folder = qualified(spark, folder)
    store, path = filesystem(folder)
    store.create_dir(path, recursive=True)
    sizes = shared.written(pages.select(F.col(page).cast("long").alias("_page"), (F.octet_length(F.coalesce(html, F.lit(""))) + 600).cast("long").alias("_size")), "sizes")
    starts, hot, _ = bounds_of(sizes, shard_bytes)
    # Shards in the order of ids: nulls first, and a hot id has as many numbers as it needs.
    ids = sorted(i for i in hot if i is not None)
    many_nulls = hot.get(None, 0)
    extra = np.cumsum([0, *(hot[i] - 1 for i in ids)])
    parts = np.array([hot[i] for i in ids], np.int64)
    count = many_nulls + len(starts) + 1 + int(extra[-1])
    ids = np.array(ids, np.int64)

    @F.pandas_udf("long")
    def shard_of(pages: pd.Series, none: pd.Series, hashes: pd.Series) -> pd.Series:
        p, h = pages.to_numpy(np.int64), (hashes.to_numpy(np.int64).view(np.uint64) >> np.uint64(32)).astype(np.int64)
        before = np.searchsorted(ids, p, "left")
        out = many_nulls + np.searchsorted(starts, p, "right") + extra[before]
        if len(ids):
            at = np.minimum(before, len(ids) - 1)
            out += np.where(ids[at] == p, h * parts[at] >> 32, 0)
        return pd.Series(np.where(none.to_numpy(bool), h * many_nulls >> 32, out))

    own = shard_of(F.coalesce("_page", F.lit(0)), F.col("_page").isNull(), F.col("_o"))
    rows = marked(pages, page, url, html, least_bytes).withColumn("_o", F.xxhash64("_html", "_url")).withColumn("_shard", own)
    dealt = rows.repartition(count, "_shard").sortWithinPartitions("_shard", F.col("_page").asc_nulls_first(), F.shiftrightunsigned("_o", 32), "_revisit", "_o", F.xxhash64("_url"), F.sha1("_html"))
    # Ids as texts: pandas makes floating-point numbers of integers that have nulls among them.
    dealt = dealt.select(F.col("_page").cast("string"), "_url", "_html", "_revisit", F.col("_refers").cast("string"), "_shard")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        attempt = str(TaskContext.get().taskAttemptId())
        shard, members, size, files = None, [], 0, []

        def close() -> None:
            data = b"".join(members)
            name = f"{shard:06d}/pages-{shard:06d}-{len(files):05d}.warc.gz"
            put(folder, name, data, attempt)
            files.append({"file": name, "shard": shard, "part": len(files), "records": len(members), "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()})
            members.clear()

        def finish() -> pd.DataFrame:
            close()
            put(folder, manifest_of(shard), json.dumps(files, indent=1).encode(), attempt)
            return pd.DataFrame(files)

        for pdf in batches:
            for p, u, h, r, ref, s in zip(*(pdf[c] for c in ("_page", "_url", "_html", "_revisit", "_refers", "_shard")), strict=True):
                if members and s != shard:
                    yield finish()
                    files, size = [], 0
                elif members and size >= roll_bytes:
                    close()
                    size = 0
                shard = int(s)
                members.append(member(record(None if p is None else int(p), u, h.encode("utf-8", "surrogatepass"), None if ref is None else int(ref), bool(r))))
                size += len(members[-1])
        if members:
            yield finish()

    files = shared.written(dealt.mapInPandas(run, MANIFEST), "files")
    done = files.groupBy("shard").agg(F.count("*").alias("files"), F.sum("records").alias("records")).orderBy("shard").collect()  # a row for each shard
    put(folder, "manifest.json", json.dumps([r.asDict() for r in done], indent=1).encode(), "driver")
    swept(spark, folder, [r["shard"] for r in done])
    return files


def swept(spark: SparkSession, folder: str, shards: list[int]) -> None:
    """Removes temporary files of attempts that never ended, shard by shard; a file of the manifests is never one of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, path = filesystem(folder)
        for pdf in batches:
            gone = [x.path for n in pdf["shard"] for x in store.get_file_info(fs.FileSelector(f"{path}/{n:06d}")) if x.base_name.startswith(".") and not x.base_name.endswith(".crc")]
            for name in gone:
                store.delete_file(name)
            yield pd.DataFrame({"n": [len(gone)]})

    if shards:
        tasks = min(len(shards), 4 * spark.sparkContext.defaultParallelism)
        spark.createDataFrame([(n,) for n in shards], "shard long").repartition(tasks).mapInPandas(run, "n long").agg(F.sum("n")).collect()


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, member by member."""
    at = 0
    while at < len(data):
        z = zlib.decompressobj(31)
        raw = z.decompress(data[at:] if at else data)
        at = len(data) - len(z.unused_data)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        yield headers, rest[: int(headers["Content-Length"])]


def listed(store, path: str, shard: int) -> list[dict]:
    with store.open_input_stream(f"{path}/{manifest_of(shard)}") as f:
        return json.loads(f.read())


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the files in the shards' manifests; whatever else is in the folder doesn't count.

    The driver reads the manifest of the whole, one entry for each shard; tasks read those of the shards and the files.
    """
    folder = qualified(spark, folder)
    store, path = filesystem(folder)
    with store.open_input_stream(f"{path}/manifest.json") as f:
        shards = [x["shard"] for x in json.loads(f.read())]
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, sound boolean"
    if not shards:
        return spark.createDataFrame([], schema)
    files = spark.createDataFrame([(n,) for n in shards], "shard long").repartition(len(shards))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = filesystem(folder)
        number = lambda x: int(x) if x else None
        for pdf in batches:
            for name in (x["file"] for n in pdf["shard"] for x in listed(store, path, n)):
                with store.open_input_stream(f"{path}/{name}", compression=None) as f:
                    data = f.read()
                out = []
                for h, block in records(data):
                    response = h["WARC-Type"] == "response"
                    said = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    payload = block.partition(b"\r\n\r\n")[2]
                    sound = h["WARC-Block-Digest"] == f"sha1:{digest(block)}" and (not response or digest(payload) == said)
                    size = len(payload) if response else int(h["X-Payload-Length"])
                    out.append((number(h["X-Page-Id"]), h["WARC-Target-URI"], size, digest(payload) if response else said, h["WARC-Type"], number(h.get("X-Refers-To-Page", "")), sound))
                page, url, size, said, kind, refers, sound = zip(*out, strict=True)
                yield pd.DataFrame({"page_id": pd.array(page, "Int64"), "url": url, "payload_bytes": size, "payload_digest": said, "record_type": kind, "refers_to": pd.array(refers, "Int64"), "sound": sound})

    return files.mapInPandas(run, schema)


def op2(spark, sf_dir: str) -> DataFrame:
    folder = shared.folder(spark, "warc")
    write(shared.table(spark, sf_dir, "pages"), folder)
    back = read(spark, folder)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 in SQL: the 40 hex digits as 160 bits, five at a time.
ORACLE2 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(instr('0123456789abcdef', hex[i]) - 1), 4, '0')), '') AS b FROM p),
d AS (
  SELECT page_id, n, array_to_string(list_transform(range(0, 32),
    lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[list_sum(list_transform(range(1, 6), lambda k: CASE WHEN b[i * 5 + k] = '1' THEN 1 << (5 - k) ELSE 0 END))::INT + 1]), '') AS dig
  FROM bits
),
f AS (SELECT dig, min(page_id) AS first FROM d GROUP BY dig)
SELECT page_id, n::BIGINT AS payload_bytes, dig AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d JOIN f USING (dig)
"""
