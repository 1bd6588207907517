"""Content-addressed WARC archive: each payload once, record headers apart, records put back by joins.

An archive is a folder with two tables:

* ``payloads`` (digest, records, size, payload): one row for each distinct payload, addressed by
  SHA-256, with the number of records that name it;
* ``records`` (page_id, record_type, refers_to, header, digest): for each page its exact WARC
  record header, the blank line that ends it included, and the address of its payload.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes, the one with the largest page_id is
the response; the others are revisits that name it. Smaller payloads always make responses. Every
page is written, repeated rows too: rows that repeat the winning page are responses like it. Null
payloads are empty ones; a null page_id or url is written without its header line, and if all
copies of a payload have null ids they are all responses.

An address is verified before it is trusted: the writer holds size and a second digest of all
payloads with one address against each other, and the reader recomputes size and SHA-256 of what
it finds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.llm.common import join_hot, written

MIN_REVISIT = 1000
EPOCH = "1970-01-01T00:00:00Z"   # pages carry no time of capture
END = "\r\n\r\n"                 # after the payload of a record


def _uri(page_id: Column) -> Column:
    """A record id that follows from the page id, so that a second run writes the same bytes."""
    h = F.sha2(F.concat(F.lit("page:"), page_id.cast("string")), 256)
    dashed = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    return F.when(page_id.isNotNull(), F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">")))


def _header(r: dict[str, Column]) -> Column:
    revisit = r["record_type"] == "revisit"
    line = lambda name, value: F.concat(F.lit(name + ": "), value.cast("string"), F.lit("\r\n"))
    lines = [
        F.lit("WARC/1.1\r\n"), line("WARC-Type", r["record_type"]), line("WARC-Record-ID", _uri(r["page_id"])),
        line("WARC-Target-URI", F.regexp_replace(r["url"], r"[\r\n]", "")), line("WARC-Date", F.lit(EPOCH)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), r["sha1"])),
        F.when(revisit, line("WARC-Refers-To", _uri(r["refers_to"]))),
        F.when(revisit, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(r["size"])),
    ]
    return F.concat(F.concat_ws("", *lines), F.lit("\r\n")).cast("binary")


def write_archive(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                  min_revisit: int = MIN_REVISIT) -> None:
    """Write the archive of ``df`` to the folder ``path``. Raises if two payloads share an address."""
    spark = df.sparkSession
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    rows = df.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"))
    sized = rows.select("*", F.octet_length("payload").cast("long").alias("size"), F.sha2("payload", 256).alias("digest"))
    brief = sized.select("page_id", "url", "size", "digest", F.sha1("payload").alias("sha1"))
    marked = sized.select("digest", "page_id", "size", F.xxhash64("payload").alias("x"))
    groups = written(marked.groupBy("digest").agg(
        F.max("page_id").alias("winner"), F.count("*").alias("rows"), F.max("size").alias("s"),
        F.min("size").alias("least"), F.min("x").alias("x0"), F.max("x").alias("x1")), "warc-groups")
    # an address stands for one payload: of one size, and of one digest of another family
    if not groups.filter((F.col("s") != F.col("least")) | (F.col("x0") != F.col("x1"))).isEmpty():
        raise ValueError("two payloads with one address")
    winners, total = groups.select("digest", "winner", "rows", "s"), groups.agg(F.sum("rows")).first()[0] or 0
    joined = join_hot(brief, winners, "digest", total, "rows")
    again = (F.col("s") >= min_revisit) & F.col("winner").isNotNull() & ~F.col("winner").eqNullSafe(F.col("page_id"))
    typed = joined.select("page_id", "url", "size", "digest", "sha1",
                          F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
                          F.when(again, F.col("winner")).alias("refers_to"))
    header = _header({c: F.col(c) for c in typed.columns})
    typed.select("page_id", "record_type", "refers_to", header.alias("header"), "digest").write.parquet(f"{path}/records")

    # one copy of each payload: copies are dropped before the shuffle, and again after it
    sized.groupBy("digest").agg(F.count("*").alias("records"), F.first("size").alias("size"),
                                F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record_type, refers_to, header, digest, payload) of every record of an archive; the
    payload is the full one, of a revisit too."""
    records = spark.read.parquet(f"{path}/records")
    payloads = spark.read.parquet(f"{path}/payloads")
    total = payloads.agg(F.sum("records")).first()[0] or 0
    # the join by address; an address that many records name is dealt over several tasks
    return join_hot(records, payloads, "digest", total, "records")


def record_bytes(record_type: Column, header: Column, payload: Column) -> Column:
    """The bytes of the record as it stands in a WARC file: a revisit has no block."""
    block = F.when(record_type == "revisit", F.lit(b"")).otherwise(payload)
    return F.concat(header, block, F.lit(END.encode()))


def verified(records: DataFrame) -> DataFrame:
    """``records`` as read, after each payload is held against its address: fails on the first that
    is missing or differs."""
    good = (F.sha2("payload", 256) == F.col("digest")) & (F.octet_length("payload") == F.col("size"))
    return records.withColumn("payload", F.when(F.coalesce(good, F.lit(False)), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("payload differs from its address "), F.col("digest"))).cast("binary")))


def _head(record: Column) -> Column:
    """The header in the bytes of a record: up to the first blank line; urls have no line ends to make one."""
    return F.substring_index(record.cast("string"), END, 1)


def parsed(record: Column) -> dict[str, Column]:
    """What the header in the bytes of a record says; null where no line says it."""
    head = _head(record)
    field = lambda name: F.nullif(F.regexp_extract(head, rf"(?:^|\r\n){name}: ([^\r\n]*)", 1), F.lit(""))
    return {"version": F.substring_index(head, "\r\n", 1), "record_type": field("WARC-Type"), "record_uri": field("WARC-Record-ID"),
            "refers_to_uri": field("WARC-Refers-To"), "digest": field("WARC-Payload-Digest"), "length": field("Content-Length")}


def rebuilt(records: DataFrame) -> DataFrame:
    """:func:`verified` records with the bytes of each (``record``), whose header is held against the
    side columns and the payload: version, type, ids, digest, lengths. Fails on the first that differs."""
    whole = verified(records).withColumn("record", record_bytes(F.col("record_type"), F.col("header"), F.col("payload")))
    block = F.when(F.col("record_type") == "revisit", F.lit(0)).otherwise(F.octet_length("payload"))
    told = parsed(F.col("record"))
    good = ((told["version"] == "WARC/1.1") & told["record_type"].eqNullSafe(F.col("record_type"))
            & told["record_uri"].eqNullSafe(_uri(F.col("page_id"))) & told["refers_to_uri"].eqNullSafe(_uri(F.col("refers_to")))
            & told["digest"].eqNullSafe(F.concat(F.lit("sha1:"), F.sha1("payload"))) & told["length"].eqNullSafe(block.cast("string"))
            & (F.octet_length("record") == F.octet_length(_head(F.col("record"))) + block + 2 * len(END)))
    return whole.withColumn("record", F.when(F.coalesce(good, F.lit(False)), F.col("record")).otherwise(
        F.raise_error(F.lit("a record's header differs from its page or payload")).cast("binary")))
