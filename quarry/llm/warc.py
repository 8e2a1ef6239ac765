"""WARC archives: writing pages as records, and reading them back by verified boundaries.

Writing uses Spark's own text writer, so archives go to any store and commit
like any table. Reading splits archives at the record magic, in parallel and
at any file size; every piece is only a candidate record, as payloads may
contain the magic too. Tasks emit each candidate's offset and its successor's
(offset + header + Content-Length + 4); per archive, pointer jumping from the
file's start marks the reachable candidates, and only those are records.
Pieces inside a record are put together again: their values come from a second
read, which finds them by their digests, so it doesn't matter how a read is
split, and only the pieces that are wanted leave their tasks.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import cut, few, release, removed, shared_dir, small_batches

MAGIC = "WARC/1.1\r\n"
#: Records of one archive file, which bounds what a boundary chain's task holds.
RECORDS = 200_000
#: Groups of equal payloads that may be sent to all executors.
BROADCAST_GROUPS = 200_000
#: Pieces with one value that meet one copy of it; more frequent values get more copies.
SHARE = 1000
#: Archives that a second read names one by one; of more it reads all.
FILES = 1000
#: Payloads of at least so many bytes become revisits when repeated.
REVISIT_BYTES = 0
_DATE = "2024-01-01T00:00:00Z"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hex40: Column) -> Column:
    """Upper-case base32 of 20 bytes given as 40 hexadecimal digits."""
    groups = [F.conv(F.substring(hex40, 1 + 10 * g, 10), 16, 10).cast("bigint") for g in range(4)]
    letters = F.split(F.lit(_ALPHABET), "")
    return F.concat(*[F.element_at(letters, (F.shiftright(n, 35 - 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int")) for n in groups for k in range(8)])


def write_archives(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES, broadcast_groups: int = BROADCAST_GROUPS) -> None:
    """One record per row of ``pages`` (page_id, url, html) under ``path``.

    Of rows with equal payloads of at least ``revisit_bytes`` bytes those with
    the smallest page_id are responses, the others revisits of it. A null html
    is an empty payload; a null page_id is larger than any other; rows that
    repeat the smallest page_id are all responses.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("about:blank")), "[\\x00-\\x20]+", "%20").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html"))
    groups = cut(rows.where(F.col("bytes") >= revisit_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("sha1", "first"), "payloads")
    groups = F.broadcast(groups) if few(groups, broadcast_groups) else groups
    rows = rows.join(groups, "sha1", "left")
    again = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("html")))
    head = F.concat(
        F.lit(MAGIC + "WARC-Type: "),
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"\r\nWARC-Date: {_DATE}\r\nWARC-Record-ID: "),
        name(F.col("page_id")),
        F.lit("\r\nWARC-Target-URI: "),
        F.col("url"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha1:"),
        base32(F.col("sha1")),
        F.when(again, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("first")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"),
    )
    # The writer's line end completes the blank line after each record.
    rows.select(F.concat(head, block, F.lit("\r\n")).alias("value")).write.option("lineSep", "\r\n").option("maxRecordsPerFile", RECORDS).text(path)


def _field(head: Column, name: str) -> Column:
    """A header field's value, or null."""
    return F.nullif(F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*$", 1), F.lit(""))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between magics: archive, block and number in reading order within one read, text.

    Blocks and numbers hang on how a read is split, so they never link two reads.
    """
    return spark.read.option("lineSep", MAGIC).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("number"), "value")


def _parsed(value: Column) -> dict[str, Column]:
    """Fields of a candidate record that begins right after a magic."""
    head = F.substring_index(value, "\r\n\r\n", 1)
    size = F.octet_length(head) + 4
    length = _field(head, "Content-Length").try_cast("bigint")
    block = F.substr(value.cast("binary"), size + 1, F.coalesce(length, F.lit(0)).cast("int")).cast("string")
    http = F.octet_length(F.substring_index(block, "\r\n\r\n", 1)) + 4
    payload = F.substr(block.cast("binary"), http + 1, F.lit(2147483647))
    return {
        "head_bytes": size.cast("bigint"),
        "content_bytes": length,
        "kind": _field(head, "WARC-Type"),
        "id": _field(head, "WARC-Record-ID"),
        "refers": _field(head, "WARC-Refers-To"),
        "told_digest": F.regexp_replace(_field(head, "WARC-Payload-Digest"), "^sha1:", ""),
        "payload_bytes": F.octet_length(payload).cast("bigint"),
        "payload_sha1": F.sha1(payload),
    }


def reachable(offset: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """Which candidates the chain from offset 0 reaches; offsets rise, a successor of -1 is none.

    Pointer jumping: after k rounds every pointer spans 2^k records, and all
    records up to that distance from the start are marked.
    """
    n = len(offset)
    at = np.searchsorted(offset, successor)
    pointer = np.where((successor > offset) & (at < n) & (offset[np.minimum(at, n - 1)] == successor), at, n)
    pointer = np.append(pointer, n)
    mark = np.zeros(n + 1, dtype=bool)
    mark[0] = n > 0 and offset[0] == 0
    while True:
        new = mark.copy()
        new[pointer[mark]] = True
        new[n] = False
        if (new == mark).all() and (pointer == pointer[pointer]).all():
            return mark[:n]
        mark, pointer = new, pointer[pointer]


def _chain(group: pa.Table) -> pa.Table:
    """Pieces of one archive with where they begin, the record they belong to, and the number of its pieces."""
    group = group.sort_by([("block", "ascending"), ("number", "ascending")])
    length = group.column("length").to_numpy()
    begin = np.cumsum(length + len(MAGIC)) - length - len(MAGIC)
    head = group.column("head_bytes").to_numpy()
    content = group.column("content_bytes").fill_null(-1).to_numpy()
    # The first piece precedes the first magic; it is empty if the file begins with one.
    offset = begin[1:] - len(MAGIC)
    successor = np.where(content[1:] >= 0, begin[1:] + head[1:] + content[1:] + 4, -1)
    mark = np.concatenate(([False], reachable(offset, successor)))
    record = np.cumsum(mark) - 1
    firsts, ends = begin[mark], np.concatenate(([0], successor))[mark]
    # Pieces behind a record's end belong to no record.
    some = np.flatnonzero(record >= 0)
    some = some[begin[some] < ends[record[some]]]
    count = np.bincount(record[some], minlength=max(len(firsts), 1))
    columns = {"file": group.column("file"), "block": group.column("block"), "number": group.column("number"), "begin": pa.array(begin, pa.int64())}
    own = pa.table({**columns}).take(pa.array(some, pa.int64()))
    return own.append_column("record", pa.array(firsts[record[some]], pa.int64())).append_column("pieces", pa.array(count[record[some]], pa.int64()))


def _digest(value: Column) -> Column:
    return F.unhex(F.sha1(value.cast("binary")))


def _together(spark: SparkSession, path: str, parts: DataFrame, counts: DataFrame) -> DataFrame:
    """value: texts of the records of ``parts`` (file, record, begin, digest), their pieces joined by magics.

    ``counts`` has every digest of ``parts`` and the copies of its value. A value is read once per digest. One that very many records share gets a
    copy for every ``SHARE`` of them, and its pieces are dealt to the copies.
    """
    files = [r[0] for r in parts.select("file").distinct().limit(FILES + 1).collect()]
    again = _pieces(spark, path)
    again = (again.where(F.col("file").isin(files)) if len(files) <= FILES else again).select(_digest(F.col("value")).alias("digest"), "value")
    if few(counts, BROADCAST_GROUPS):
        values = again.join(F.broadcast(counts), "digest").groupBy("digest", "shares").agg(F.first("value").alias("value"))
    else:
        values = again.groupBy("digest").agg(F.first("value").alias("value")).join(counts, "digest")
    copies = values.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    # At most one digest in SHARE parts is frequent.
    hot = counts.where("shares > 1")
    dealt = parts.join(F.broadcast(hot) if few(hot, BROADCAST_GROUPS) else hot, "digest", "left")
    dealt = dealt.withColumn("share", F.coalesce(F.pmod(F.xxhash64("file", "record", "begin"), F.col("shares")), F.lit(0)).cast("int"))
    joined = dealt.join(copies, ["digest", "share"]).groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("begin", "value"))).alias("p"))
    return joined.select(F.array_join(F.transform("p", lambda x: x["value"]), MAGIC).alias("value"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path``: kind, id, refers, told_digest, payload_bytes, payload_sha1.

    Text before the first record, cut-off records and candidates that the
    chain from the file's start doesn't reach are no records. The result is a
    table of the shared folder; nothing else of the reading stays there.
    """
    small_batches(spark)
    key = ["file", "block", "number"]
    value = F.col("value")
    found = _pieces(spark, path).select(*key, F.octet_length("value").cast("bigint").alias("length"), _digest(value).alias("digest"), *[c.alias(k) for k, c in _parsed(value).items()])
    found = cut(found, "candidates")
    chain = cut(found.select(*key, "length", "head_bytes", "content_bytes").groupBy("file").applyInArrow(_chain, "file string, block bigint, number bigint, begin bigint, record bigint, pieces bigint"), "chain")
    fields = ["kind", "id", "refers", "told_digest", "payload_bytes", "payload_sha1"]
    records = found.join(chain.where("pieces = 1").select(*key), key, "left_semi").select(*fields)
    several = chain.where("pieces > 1").drop("pieces")
    if few(several, 0):
        out = cut(records, "records")
    else:
        # Archives with records whose payload holds the magic are read again.
        several = F.broadcast(several) if few(several, BROADCAST_GROUPS) else several
        parts = cut(found.select(*key, "digest").join(several, key).select("file", "record", "begin", "digest"), "parts")
        counts = cut(parts.groupBy("digest").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("shares")), "digests")
        values = _together(spark, path, parts, counts)
        out = cut(records.unionByName(values.select(*[c.alias(k) for k, c in _parsed(value).items()]).select(*fields)), "records")
        release(parts, counts)
    release(found, chain)
    return out


def page_records(pages: DataFrame) -> DataFrame:
    """Pages written to archives in the shared folder and read back, one row per page.

    payload_bytes and payload_digest are those of the full payload, which a
    revisit has in the response it refers to. A payload that differs from the
    digest told of it ends the read with an error.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/quarry/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    records = read_archives(spark, path)
    removed(spark, path)
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]*)>$", 1).try_cast("bigint")
    response = F.col("kind") == "response"
    digest = base32(F.col("payload_sha1"))
    wrong = F.raise_error(F.concat(F.lit("a payload differs from its digest: "), "id")).cast("string")
    own = records.where(response).select(page(F.col("id")).alias("page_id"), "id", "payload_bytes", F.when(F.col("told_digest") == digest, digest).otherwise(wrong).alias("payload_digest"))
    revisits = records.where(~response).select(page(F.col("id")).alias("page_id"), "refers", "told_digest")
    # A page may come with several payloads, so a revisit's digest belongs to what it names.
    named = revisits.select(F.col("refers").alias("id"), F.col("told_digest").alias("payload_digest")).distinct()
    meant = own.join(F.broadcast(named) if few(named, BROADCAST_GROUPS) else named, ["id", "payload_digest"], "left_semi").groupBy("id", "payload_digest").agg(F.first("payload_bytes").alias("payload_bytes"))
    meant = meant.select(F.col("id").alias("refers"), F.col("payload_digest").alias("told_digest"), "payload_bytes")
    lost = F.raise_error(F.concat(F.lit("a revisit has no response with its payload: "), "refers")).cast("string")
    again = revisits.join(F.broadcast(meant) if few(meant, BROADCAST_GROUPS) else meant, ["refers", "told_digest"], "left")
    again = again.select("page_id", "payload_bytes", F.when(F.col("payload_bytes").isNotNull(), F.col("told_digest")).otherwise(lost).alias("payload_digest"), F.lit("revisit").alias("record_type"), page(F.col("refers")).alias("refers_to"))
    return own.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("bigint").alias("refers_to")).unionByName(again)
