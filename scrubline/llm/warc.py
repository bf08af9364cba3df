"""WARC archives of pages, and their capture index merged from sorted runs.

Every page becomes a record: a response with its payload, or a revisit that
names the response with the same payload. Each record is a gzip member of its own,
so it can be fetched by its place in the archive alone. Spark's text writer writes
the members, so archives reach any store and a lost task is written anew. Archives
are cut by bytes, and read one member at a time.

Reading gives runs of captures, each sorted by URL key, time and page. The runs are
dealt into ranges of that order of a bounded number of captures; a range gets slices
of the runs, which arrive in order and are merged by a loser tree without sorting.

Results for unusual rows: a null payload is empty; a null or odd URL has itself,
or nothing, as key; a null ``page_id`` is written as an empty id, is never
preferred as response and refers to none; ids may be texts, which have the first
second as time and are ordered as texts; repeated rows each get a record. A record
beyond 15 MB goes on in further members behind its first; an archive holds such a
record whole. Extra columns are ignored. An empty table gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import ascii_lower, in_groups, keyed, salted_join
from scrubline.staging import stage

BREAK = "\r\n"
RECORD_BREAK = "\r\n\r\n"
EPOCH = "2024-01-01 00:00:00"
MEMBER = 15 << 20  # bytes of a gzip member before packing: below 16 MB the last byte of a member is zero
CHUNK = 1 << 16
GZIP = 31  # zlib's window bits for the gzip format


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of 160 bits given as 40 hexadecimal digits."""
    groups = [F.lpad(F.conv(F.substring(hex_digest, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: Column) -> Column:
    """Host labels from the last to the first, then the rest: ``com,example)/path?query``; lower case."""
    low = ascii_lower(F.coalesce(url, F.lit("")))
    rest = F.regexp_extract(low, "^[^:/?#]*://(.*)$", 1)
    host = F.regexp_replace(F.regexp_extract(rest, "^([^/?#]*)", 1), "^www[0-9]*\\.", "")
    path = F.regexp_extract(rest, "^[^/?#]*([^#]*)", 1)
    return F.when(rest == "", low).otherwise(F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), path))


def captures(pages: DataFrame, payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, bytes, digest, refers_to``: what each page's record is to hold.

    Of pages with equal payloads of at least ``least_bytes`` bytes the one with
    the largest id is the response; ``refers_to`` names it in the others.
    """
    body = F.coalesce(F.col(f"row.`{payload}`"), F.lit(""))
    rows = keyed(pages, pages[payload]).select(
        F.col("row.page_id").alias("page_id"), F.col("row.url").alias("url"), body.alias("payload"),
        F.octet_length(body).cast("long").alias("bytes"), F.sha1(body).alias("sha1"),
    )
    same = rows.where(F.col("bytes") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("head"), F.count("*").alias("copies"))
    heads = same.where(F.col("copies") > 1).select("sha1", "head")
    small = rows.select("page_id", "sha1")
    led = salted_join(small, heads, ["sha1"], ["page_id"]).where(F.coalesce(F.col("page_id") != F.col("head"), F.col("head").isNotNull()))
    led = led.select(F.col("page_id").alias("led_id"), F.col("sha1").alias("led_sha1"), "head").distinct()
    out = rows.join(led, F.col("page_id").eqNullSafe(F.col("led_id")) & (F.col("sha1") == F.col("led_sha1")), "left")
    return out.select("page_id", "url", "payload", "bytes", base32(F.col("sha1")).alias("digest"), F.col("head").alias("refers_to"))


def record_text(c: DataFrame) -> Column:
    """A record with its closing line breaks."""
    revisit = F.col("refers_to").isNotNull()
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit(BREAK))
    name = lambda page: F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))
    when = F.date_format(F.timestamp_add("SECOND", F.pmod(F.coalesce(F.col("page_id").try_cast("long"), F.lit(0)), F.lit(1 << 30)).cast("int"), F.lit(EPOCH).cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    target = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]+", " ")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(RECORD_BREAK))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    return F.concat(
        line("WARC/1.1"), line("WARC-Type: ", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID: ", name(F.col("page_id"))), line("WARC-Date: ", when), line("WARC-Target-URI: ", target),
        line("WARC-Payload-Digest: sha1:", F.col("digest")),
        F.when(revisit, F.concat(line("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), line("WARC-Refers-To: ", name(F.col("refers_to"))))).otherwise(""),
        line("Content-Type: application/http;msgtype=response"),
        line("Content-Length: ", F.octet_length(block).cast("string")), F.lit(BREAK), block, F.lit(RECORD_BREAK),
    )


def packed(record: bytes) -> list[bytes]:
    """The gzip members of a record, one for every 15 MB."""
    out = []
    for at in range(0, len(record), MEMBER):
        pack = zlib.compressobj(6, zlib.DEFLATED, GZIP)
        out.append(pack.compress(record[at : at + MEMBER]) + pack.flush())
    return out


def write(pages: DataFrame, path: str, payload: str = "html", least_bytes: int = 0, most_bytes: int = 64 << 20) -> None:
    """Write archives; one is closed with the record that brings it to ``most_bytes`` bytes of members.

    The text writer ends each value with a separator. A member ends with the top
    byte of its unpacked size, which is zero, so that byte serves as separator.
    """

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, archive, filled = TaskContext.get().partitionId(), 0, 0
        for batch in in_groups(batches):
            names, values = [], []
            for record in batch.column(0):
                parts = packed(record.as_buffer().to_pybytes())
                names += [f"t{task:06}-{archive:06}"] * len(parts)
                values += [x[:-1] for x in parts]
                filled += sum(map(len, parts))
                if filled >= most_bytes:
                    archive, filled = archive + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.binary())], ["archive", "value"])

    records = captures(pages, payload, least_bytes).transform(lambda c: c.select(record_text(c).alias("record")))
    out = records.mapInArrow(members, "archive string, value binary").select("archive", F.col("value").cast("string").alias("value"))
    out.write.partitionBy("archive").option("lineSep", "\0").option("compression", "none").text(path)


def unpacked(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and text of each gzip member, one at a time."""
    view, at = memoryview(content), 0
    while at < len(view):
        unpack, parts, end = zlib.decompressobj(GZIP), [], at
        while not unpack.eof:
            if end >= len(view):
                raise ValueError(f"the member at {at} does not end")
            parts.append(unpack.decompress(view[end : end + CHUNK]))
            end = min(end + CHUNK, len(view))
        end -= len(unpack.unused_data)
        yield at, end - at, b"".join(parts)
        at = end


def parse(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset and length in the archive, named fields and block of each record."""
    members = unpacked(content)
    for at, size, text in members:
        head = text.find(b"\r\n\r\n")
        lines = text[: max(head, 0)].decode("utf-8").split(BREAK)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        start = head + 4
        stop = start + int(fields["content-length"])
        parts, have = [text], len(text)
        while have < stop + 4:
            try:
                _, more, text = next(members)
            except StopIteration:
                raise ValueError(f"the record at {at} does not end") from None
            parts.append(text)
            size, have = size + more, have + len(text)
        text = parts[0] if len(parts) == 1 else b"".join(parts)
        if text[stop:] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} does not end at {stop}")
        yield at, size, fields, text[start:stop]


ENTRY = "page_id string, url string, captured string, digest string, bytes long, record_type string, refers_to string, archive string, offset long, length long"


def entries(spark, path: str) -> DataFrame:
    """One row per record, read back from the archives; a response's digest and size come from its payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                archive, content = batch.column("path")[at].as_py(), batch.column("content")[at].as_py()
                rows = []
                for offset, length, f, block in parse(content):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest, size = f["warc-payload-digest"].removeprefix("sha1:"), int(http.rsplit(b": ", 1)[1])
                    if f["warc-type"] == "response":
                        size, true = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if digest != true:
                            raise ValueError(f"{archive} at {offset}: payload does not match its digest")
                    page = lambda k: f.get(k, "").removeprefix("<urn:x-page:").removesuffix(">") or None  # noqa: B023, E731
                    rows.append((page("warc-record-id"), f["warc-target-uri"], f["warc-date"], digest, size, f["warc-type"], page("warc-refers-to"), archive, offset, length))
                cols = list(zip(*rows)) or [[]] * 10
                kinds = [pa.int64() if k in (4, 8, 9) else pa.string() for k in range(10)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [x.split()[0] for x in ENTRY.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, ENTRY)


def loser_tree(runs: list[list], key) -> Iterator:
    """Merge sorted runs: each inner node keeps the loser of its match, the winner moves up."""
    n = len(runs)
    places = [0] * n
    # a run that has ended loses to all others
    head = [(False, key(r[0])) if r else (True,) for r in runs]
    beats = lambda x, y: (head[x], x) < (head[y], y)
    losers = [-1] * n
    for run in range(n):  # each run climbs until it must wait for its opponent
        winner, node = run, (run + n) // 2
        while node:
            if losers[node] < 0:
                losers[node], winner = winner, -1
                break
            if beats(losers[node], winner):
                losers[node], winner = winner, losers[node]
            node //= 2
        if winner >= 0:
            losers[0] = winner
    while n and not head[losers[0]][0]:
        winner = losers[0]
        yield runs[winner][places[winner]]
        places[winner] += 1
        at = places[winner]
        head[winner] = (False, key(runs[winner][at])) if at < len(runs[winner]) else (True,)
        node = (winner + n) // 2
        while node:
            if beats(losers[node], winner):
                losers[node], winner = winner, losers[node]
            node //= 2
        losers[0] = winner


def in_order(keys: list) -> list[range]:
    """The places of a list cut into runs: one ends where the next key is smaller."""
    cuts = [0, *(i for i in range(1, len(keys)) if keys[i] < keys[i - 1]), len(keys)]
    return [range(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


def history(spark, path: str, range_rows: int = 200_000) -> DataFrame:
    """All captures of the archives in one order: URL key, time, page.

    A partition of the result is one range of that order, of about ``range_rows`` captures
    at any size of the archives, and is merged in memory. ``archive, offset, length`` say
    where the record's bytes lie.
    """
    order = ["url_key", "captured", "page", "page_id"]
    keys = entries(spark, path).withColumn("url_key", url_key(F.col("url"))).withColumn("page", F.col("page_id").try_cast("long"))
    runs = stage(keys.sortWithinPartitions(*order), "runs")  # a run per task that has read archives
    dealt = runs.repartitionByRange(max(runs.count() // range_rows + 1, 2), *order)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        text = lambda c: [v or "" for v in table.column(c).to_pylist()]
        # no page comes first, as in the order of the ranges
        page = [(0, 0) if v is None else (1, v) for v in table.column("page").to_pylist()]
        key = list(zip(text("url_key"), text("captured"), page, text("page_id")))
        # a fetched slice of a run is in order, so runs show by their descents
        merged = pa.array(list(loser_tree(in_order(key), key.__getitem__)), pa.int64())
        yield from table.take(merged).combine_chunks().to_batches(max_chunksize=10_000)

    return dealt.mapInArrow(merge, dealt.schema)
