"""Content-addressed WARC archive.

An archive is a folder with two Parquet tables in the shared folder of the cluster:

* ``payloads(digest, n_records, payload)``: the bytes of each distinct payload, once, under their SHA-256. Writing checks
  that equal digests come with equal length and equal independent hashes; reading recomputes the digest of what is stored
  and fails on a difference.
* ``records(page_id, digest, salt, header, http_header)``: the exact header bytes of each record, in the order of no key.

A record is rebuilt by a join on the digest: header, HTTP header, payload, CRLF CRLF. A digest of more than ``HOT_RECORDS``
records has a salt for every so many of them: its payload is repeated for each salt, and its records are dealt over the salts.
A URL with line ends, which no header line can hold, has spaces for them there and its exact bytes in ``X-Target-URI-Hex``.

Of records with equal payloads of at least ``least_bytes`` bytes the one with the largest page_id is ``response``, the others
are ``revisit`` and refer to it; smaller ones are all ``response``. Rows that share both that payload and that page_id are all
responses. A null page_id is never the largest unless all are null, and then all are responses. A null html is an empty payload, a null url is written as an empty target. An empty
table makes an archive without records. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm._common import materialize, table, workspace

LEAST_BYTES = 1000
#: Records of one payload are dealt over a key for every so many of them.
HOT_RECORDS = 1000
#: So many digests at most are broadcast, those with the most records.
HOT_DIGESTS = 200_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page: Column, url: Column) -> Column:
    """A stable urn:uuid from the page's id and address."""
    h = F.md5(F.concat_ws("\x00", F.coalesce(page.cast("string"), F.lit("")), F.coalesce(url, F.lit(""))))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _lines(*fields: tuple[str, Column]) -> Column:
    out = [F.lit("WARC/1.1\r\n")]
    for name, value in fields:
        line = F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
        out.append(F.when(value.isNotNull(), line).otherwise(F.lit("")))
    return F.concat(*out, F.lit("\r\n"))


def _salts(n_records: Column) -> Column:
    return F.ceil(n_records / HOT_RECORDS).cast("int")


def write_archive(pages: DataFrame, root: str, least_bytes: int = LEAST_BYTES) -> str:
    """Archive ``pages(page_id, url, html)`` below ``root``."""
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("exact"),
        F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), "[\\r\\n]", " ").alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.unhex(F.sha2("payload", 256)))

    # Partial aggregation leaves one row per digest and task, so that a payload with many copies crosses the network once
    # for each task at most.
    stored = rows.groupBy("digest").agg(
        F.first("payload").alias("payload"),
        F.count(F.lit(1)).alias("n_records"),
        F.min(F.struct(F.octet_length("payload").alias("n"), F.xxhash64("payload").alias("h"))).alias("low"),
        F.max(F.struct(F.octet_length("payload").alias("n"), F.xxhash64("payload").alias("h"))).alias("high"),
    )
    verified = F.when(F.col("low") == F.col("high"), F.col("payload")).otherwise(
        F.raise_error(F.lit("two payloads have one SHA-256")).cast("binary")
    )
    stored.select("digest", "n_records", verified.alias("payload")).write.option("parquet.block.size", 32 << 20).option("compression", "zstd").parquet(f"{root}/payloads")

    hex_url = F.when(F.col("exact") != F.col("url"), F.hex(F.col("exact").cast("binary"))).alias("hex_url")
    narrow = rows.select("page_id", "url", hex_url, "digest", F.octet_length("payload").cast("bigint").alias("n"), F.sha1("payload").alias("sha1"))
    # Digests of several records, with the record that stays a response. Those of more than total / HOT_DIGESTS records, of which
    # there are HOT_DIGESTS at most, are broadcast; the others' records meet in a shuffle.
    shared = materialize(
        narrow.groupBy("digest").agg(F.count(F.lit(1)).alias("n_records"), F.max(F.struct("page_id", "url")).alias("target")).where("n_records > 1").withColumnRenamed("digest", "d"), "warc-shared"
    )
    limit = max(HOT_RECORDS, -(-(shared.agg(F.sum("n_records")).first()[0] or 0) // HOT_DIGESTS))
    met = narrow.join(F.broadcast(shared.where(F.col("n_records") > limit)), F.col("digest") == F.col("d"), "left")
    columns = [*narrow.columns, "n_records", "target"]
    rest = met.where(F.col("d").isNull()).select(*narrow.columns).join(shared.where(F.col("n_records") <= limit), F.col("digest") == F.col("d"), "left").select(*columns)
    joined = met.where(F.col("d").isNotNull()).select(*columns).unionAll(rest)
    revisit = (F.col("n") >= least_bytes) & F.col("target.page_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("target.page_id"))
    revisit = F.coalesce(revisit, F.lit(False))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n")
    )
    block = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("n"))
    header = _lines(
        ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        ("WARC-Record-ID", _record_id(F.col("page_id"), F.col("url"))),
        ("WARC-Date", F.lit(DATE)),
        ("WARC-Target-URI", F.col("url")),
        ("X-Target-URI-Hex", F.col("hex_url")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        ("WARC-Refers-To", F.when(revisit, _record_id(F.col("target.page_id"), F.col("target.url")))),
        ("WARC-Refers-To-Target-URI", F.when(revisit, F.col("target.url"))),
        ("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        ("X-Page-ID", F.col("page_id").cast("string")),
        ("X-Refers-To-Page-ID", F.when(revisit, F.col("target.page_id").cast("string"))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", block.cast("string")),
    )
    joined.select(
        "page_id",
        "digest",
        F.pmod(F.xxhash64("page_id", "url"), _salts(F.coalesce("n_records", F.lit(1)))).cast("int").alias("salt"),
        header.cast("binary").alias("header"),
        http.cast("binary").alias("http_header"),
    ).write.option("compression", "zstd").parquet(f"{root}/records")
    return root


def payloads(spark: SparkSession, root: str) -> DataFrame:
    """(digest, n_records, payload, payload_bytes, payload_digest): each stored payload, checked against its name."""
    stored = spark.read.schema("digest binary, n_records bigint, payload binary").parquet(f"{root}/payloads")
    sound = F.unhex(F.sha2("payload", 256)) == F.col("digest")
    size = F.when(sound, F.octet_length("payload")).otherwise(F.raise_error(F.lit("a stored payload does not match its digest")).cast("int"))
    return stored.select("digest", "n_records", "payload", size.cast("bigint").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))


def records(spark: SparkSession, root: str) -> DataFrame:
    """(page_id, digest, salt, header, http_header)"""
    return spark.read.schema("page_id bigint, digest binary, salt int, header binary, http_header binary").parquet(f"{root}/records")


def field(header: Column, name: str) -> Column:
    """A header field's value; null where the field is absent."""
    return F.nullif(F.regexp_extract(header, f"\\r\\n{name}: ([^\\r]*)\\r\\n", 1), F.lit(""))


def read_archive(spark: SparkSession, root: str) -> DataFrame:
    """Every record, rebuilt by a join: page_id, url, record_type, refers_to, payload_bytes, payload_digest, header,
    http_header, payload. Columns that are not asked for are not read or moved: without ``payload`` the join is narrow."""
    held = payloads(spark, root)
    held = held.withColumn("salt", F.explode(F.sequence(F.lit(0), _salts(F.col("n_records")) - 1)))
    text = F.col("header").cast("string")
    return (
        records(spark, root)
        .join(held, ["digest", "salt"])
        .select(
            field(text, "X-Page-ID").cast("bigint").alias("page_id"),
            F.coalesce(F.unhex(field(text, "X-Target-URI-Hex")).cast("string"), field(text, "WARC-Target-URI"), F.lit("")).alias("url"),
            field(text, "WARC-Type").alias("record_type"),
            field(text, "X-Refers-To-Page-ID").cast("bigint").alias("refers_to"),
            "payload_bytes",
            "payload_digest",
            F.substring_index(field(text, "WARC-Payload-Digest"), ":", -1).alias("header_digest"),
            "header",
            "http_header",
            "payload",
        )
    )


def warc_bytes(archive: DataFrame) -> DataFrame:
    """(page_id, record): the exact bytes of each WARC record of ``read_archive``."""
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return archive.select("page_id", F.concat("header", "http_header", body, F.lit(b"\r\n\r\n")).alias("record"))


def op1_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = write_archive(table(spark, sf_dir, "pages"), workspace(spark, "op1-warc"))
    back = read_archive(spark, root)
    digest = F.when(F.col("header_digest") == F.col("payload_digest"), F.col("payload_digest")).otherwise(
        F.raise_error(F.lit("a record's header names another payload"))
    )
    return back.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


ORACLE = {
    "op1_warc_archive": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM g
"""
}
