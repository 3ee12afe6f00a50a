"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

The bytes ``WARC/1.0`` may also stand inside a payload, so finding them proves nothing.  Tasks
scan pieces of the archives and emit, for everything that looks like a record, where the
next record would start.  Only what a chain from the start of the file reaches is a record.
A task follows the chains inside its piece, so pointer jumping doubles its stride over
pieces and takes the logarithm of their number in rounds.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import bound_batches, load, materialize, named, shared_dir

MAGIC = b"WARC/1.0\r\n"
END = "\r\n\r\n"
#: Bytes of an archive, of a piece that is scanned at once, and of what is searched first for a header's end.
ARCHIVE_BYTES, PIECE_BYTES, HEADER_BYTES = 32 << 20, 4 << 20, 64 << 10
#: Copies of each digest's row, so that a digest that many pages share is spread out.
SALTS = 16
#: Fixed value: the base32 alphabet.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(hexadecimal: Column) -> Column:
    """Base32 of a SHA-1 given in hexadecimal: five hexadecimal digits make four characters."""
    alphabet = F.lit(BASE32)
    out = []
    for i in range(8):
        v = F.conv(F.substring(hexadecimal, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substring(alphabet, F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def with_revisits(pages: DataFrame, min_bytes: int = 0, key: str = "page_id", html: str = "html") -> DataFrame:
    """``pages`` with payload (null is empty) in the place of ``html``, payload_bytes, payload_digest, record_type and refers_to.

    Of equal payloads of at least ``min_bytes`` that of the largest key is the response, also if
    rows repeat that key or if all keys are null; the others revisit it.  Columns of ``pages`` named like a
    result give way to it.
    """
    rest = named(pages, html, "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", used=(key,))
    d = pages.select(F.struct(*rest).alias("_row"), F.col(key).cast("long").alias("_key"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("payload"))
    d = d.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "_sha": F.sha1("payload")})
    first = d.filter(F.col("payload_bytes") >= min_bytes).groupBy("_sha").agg(F.max("_key").alias("_first"), F.count("*").alias("_n"))
    # Payloads that stand alone need no partner.  The rest is written, so that its true size decides whether
    # the pages are joined where they are or, salted against a digest that many share, by shuffle.
    first = materialize(first.filter("_n > 1").drop("_n")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    d = d.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int"), F.lit(0))).join(first, ["_sha", "_salt"], "left")
    revisit = (F.col("payload_bytes") >= min_bytes) & ~F.col("_key").eqNullSafe(F.col("_first")) & F.col("_first").isNotNull()
    return d.select("_row.*", "payload", "payload_bytes", base32_sha1(F.col("_sha")).alias("payload_digest"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_first")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Writes one WARC record per row; revisits have no block, but the length and digest of the payload they stand for.

    An archive holds ARCHIVE_BYTES at most, or one record that is longer.
    """
    d = with_revisits(pages.select(key, url, html), min_bytes, key, html)
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    response = F.col("record_type") == "response"
    block = F.when(response, F.col("payload")).otherwise("")
    record = F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", urn(F.col(key))),
        line("WARC-Target-URI", F.regexp_replace(F.col(url).cast("string"), r"[\x00-\x20\x7F]", "%20")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        line("WARC-Refers-To", urn(F.col("refers_to"))),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )

    def deal(batches):
        """Numbers files: a task begins another one before it would exceed its bytes."""
        used = number = 0
        for batch in batches:
            numbers = []
            for size in pc.binary_length(batch.column("value").cast(pa.binary())).to_pylist():
                if used and used + size + len(END) > ARCHIVE_BYTES:
                    used, number = 0, number + 1
                used += size + len(END)
                numbers.append(number)
            yield pa.RecordBatch.from_arrays([batch.column("value"), pa.array(numbers, pa.int32())], ["value", "file"])

    bound_batches(pages.sparkSession)
    dealt = d.select(record.alias("value")).mapInArrow(deal, "value string, file int")
    dealt.write.option("lineSep", END).partitionBy("file").text(path)


_FIELD = re.compile(rb"([A-Za-z-]+): ?(.*?)\r\n")


def _candidates(frames):
    """Everything in an archive that looks like a record, with its successor and where its chain leaves the piece.

    A header may be of any length; what stands before one blank line is read once, for all that may start
    there.  A block that ends as a record must, before another or the end of the file, is hashed on the way.
    """
    for f in frames:
        out = []
        for path, content in zip(f["path"], f["content"], strict=True):
            data, found, end, lines = bytes(content), {}, -1, {}
            for m in re.finditer(re.escape(MAGIC), data):
                at = m.start()
                if end < m.end() - 2:
                    end = data.find(b"\r\n\r\n", m.end() - 2, m.end() + HEADER_BYTES)
                    if end < 0:
                        end = data.find(b"\r\n\r\n", m.end() - 2)
                    if end < 0:
                        break  # nor has any later header an end
                    lines = {x[1].lower(): (x.start(), x[2]) for x in _FIELD.finditer(data, m.end(), end + 2)}
                fields = {k: v for k, (start, v) in lines.items() if start >= m.end()}
                size = fields.get(b"content-length", b"")
                if not size.isdigit() or len(size) > 15:
                    continue
                body, after = end + 4, end + 4 + int(size) + 4
                ends_well = data[after - 4 : after] == b"\r\n\r\n" and (after == len(data) or data.startswith(MAGIC, after))
                own = base64.b32encode(hashlib.sha1(memoryview(data)[body : after - 4]).digest()).decode() if ends_well else None
                get = lambda name, fields=fields: fields.get(name, b"").decode("utf-8", "replace")
                found[at] = [path, at // PIECE_BYTES, at, after, None, body, int(size), own, *map(get, (b"warc-type", b"warc-record-id", b"warc-target-uri", b"warc-payload-digest", b"warc-payload-length", b"warc-refers-to"))]
            for at in sorted(found, reverse=True):
                after = found[at][3]
                inside = after in found and after // PIECE_BYTES == at // PIECE_BYTES
                found[at][4] = found[after][4] if inside else after
            out += found.values()
        yield pd.DataFrame(out, columns=_COLUMNS)


_SCHEMA = "path string, piece bigint, pos bigint, next bigint, leaves bigint, body bigint, size bigint, own string, kind string, id string, uri string, digest string, stated string, refers string"
_COLUMNS = [c.split()[0] for c in _SCHEMA.split(", ")]


def _chain(frames):
    """Of rows in order of piece and position, those that the chain from the piece's entry reaches."""
    here = want = None
    for f in frames:
        keep = []
        for i, (path, piece, pos, after, entry) in enumerate(zip(f["path"], f["piece"], f["pos"], f["next"], f["entry"], strict=True)):
            if (path, piece) != here:
                here, want = (path, piece), entry
            if pos == want:
                keep.append(i)
                want = after
        yield f.iloc[keep].drop(columns="entry")


def verified_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path``: those on the chain from a file's start.

    A chain that does not end with its file would lose the records behind it, so it is an error.
    """
    bound_batches(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    found = materialize(files.select("path", "content").mapInPandas(_candidates, _SCHEMA))
    hop = found.select("path", F.col("pos").alias("at"), F.col("leaves").alias("to"))
    reached = found.filter("pos = 0").select("path", F.col("pos").alias("at"))
    while True:
        # One row per record on either side: shuffled at every size, never sent whole to the executors.
        further = reached.join(hop.hint("merge"), ["path", "at"]).select("path", F.col("to").alias("at"))
        entries = found.select("path", F.col("pos").alias("at"))
        reached = materialize(reached.union(further.join(entries.hint("merge"), ["path", "at"], "left_semi")).distinct())
        second = hop.select("path", F.col("at").alias("to"), F.col("to").alias("then"))
        hop = materialize(hop.join(second.hint("merge"), ["path", "to"]).select("path", "at", F.col("then").alias("to")))
        if hop.isEmpty():
            break
    ends = found.select("path", F.col("pos").alias("at"), "leaves").join(reached.hint("merge"), ["path", "at"]).groupBy("path").agg(F.max("leaves").alias("end"))
    broken = files.select("path", "length").filter("length > 0").join(ends, "path", "left").filter(~F.col("end").eqNullSafe(F.col("length"))).select("path", "end").first()
    if broken is not None:
        raise ValueError(f"the records of {broken['path']} end at byte {broken['end'] or 0}, not with the file")
    entry = found.select("path", "piece", F.col("pos").alias("at")).join(reached.hint("merge"), ["path", "at"], "left_semi").groupBy("path", "piece").agg(F.min("at").alias("entry"))
    rows = found.join(entry.hint("merge"), ["path", "piece"]).repartition("path", "piece").sortWithinPartitions("path", "piece", "pos")
    return rows.select(*_COLUMNS, "entry").mapInPandas(_chain, _SCHEMA)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest, intact) of every verified record.

    Length and digest of a response are taken from its block, those of a revisit from its header, its
    payload is null; ``intact`` says whether a response's block matches its header.  Without
    ``payloads`` that column is left out and no block leaves the task that hashed it.
    """
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    d = verified_records(spark, path)
    response, stated = F.col("kind") == "response", F.regexp_replace("digest", "^sha1:", "")
    columns = [
        number(F.col("id")).alias("page_id"),
        F.when(F.col("uri") != "", F.col("uri")).alias("url"),
        F.col("kind").alias("record_type"),
        number(F.col("refers")).alias("refers_to"),
        F.when(response, F.col("size")).otherwise(F.col("stated").try_cast("long")).alias("payload_bytes"),
        F.when(response, F.col("own")).otherwise(stated).alias("payload_digest"),
        F.when(response, F.coalesce(F.col("own") == stated, F.lit(False))).alias("intact"),
    ]
    if not payloads:
        return d.select(*columns)
    records = d.groupBy("path").agg(F.collect_list(F.struct(*_COLUMNS[5:])).alias("records"))  # of one archive's size at most
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    each = files.join(records, "path").select("content", F.explode("records").alias("r"))
    block = F.when(F.col("r.kind") == "response", F.expr("substring(content, cast(r.body + 1 as int), cast(r.size as int))"))
    return each.select("r.*", block.alias("payload")).select(*columns, "payload")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages into archives in the shared folder and reads them back."""
    path = shared_dir(spark)
    write_archives(load(spark, sf_dir, "pages"), path)
    return read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


_B32 = "substr('{a}', CAST(('0x' || substr(h, {i}, 5)) AS INTEGER) // {d} % 32 + 1, 1)"
OP9_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages
), f AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, {' || '.join(_B32.format(a=BASE32, i=5 * i + 1, d=d) for i in range(8) for d in (32768, 1024, 32, 1))} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to,
       CASE WHEN page_id = first THEN true END AS intact
FROM f
"""
