"""Derivatives of WARC responses: metadata and plain-text conversion records that refer to them.

A record is a row: warc_type, record_id, refers_to, target_uri, date, content_type, block,
content_length, block_digest, payload_digest. All of it is built-in functions; only
write_records() and read_records(), which frame bytes, run Python inside the tasks.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from html.entities import html5
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE32, BASE32HEX = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdefghijklmnopqrstuv"

#: The named characters of HTML, without the semicolon behind the name.
ENTITIES = {k[:-1]: v for k, v in sorted(html5.items()) if k.endswith(";")}
#: A reference is looked for in so many characters behind its &.
WINDOW = max(map(len, ENTITIES)) + 1
#: Fixed patterns, read alike by Java and RE2: what holds no text, then tags that end a line, then all tags.
NO_TEXT = "(?is)<(?:" + "|".join([r"!--.*?(?:-->|\z)", *(rf"{t}\b[^>]*>.*?(?:</{t}\s*>|\z)" for t in ("script", "style", "noscript", "template", "title"))]) + ")"
LINE_TAG = r"(?i)</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|tr|ul)\b[^>]*>"
ANY_TAG = r"(?i)<[a-z/!?][^>]*>"
TITLE, LANG, CHARSET = r"(?is)<title\b[^>]*>(.*?)</title", r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([a-z-]+)", r"(?i)<meta\b[^>]*\bcharset\s*=\s*[\"']?([a-z0-9_-]+)"
OUTLINK = r"(?i)<a\b[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"
SPACE = r"[ \t\r\f]{2,}|[\t\r\f]"


def sha1_base32(data: Column) -> Column:
    """sha1: and the 32 digits of base 32 in which WARC writes digests; 5 hex digits make 4 of them."""
    digits = [F.lpad(F.lower(F.conv(F.substring(F.sha1(data), i, 5), 16, 32)), 4, "0") for i in range(1, 41, 5)]
    return F.concat(F.lit("sha1:"), F.translate(F.concat(*digits), BASE32HEX, BASE32))


def record_id(*parts: Column) -> Column:
    """A URN that depends on the parts alone, so a retried task writes the same record."""
    h = F.md5(F.concat_ws("|", *parts))
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, *c) for c in cut)), F.lit(">"))


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def unescaped(text: Column) -> Column:
    """Named characters of ENTITIES, &#233; and &#xe9; resolved in one sweep; others stay as they are."""
    # a map of maps by first letter, since a map is searched from its start
    letters = (f"{_sql(k)}, map({', '.join(f'{_sql(n)}, {_sql(ENTITIES[n])}' for n in names)})" for k, names in groupby(ENTITIES, key=lambda n: n[0]))
    named = F.expr(f"map({', '.join(letters)})")

    def one(part: Column) -> Column:
        end = F.locate(";", F.substring(part, 1, WINDOW))
        name, rest = F.substring(part, F.lit(1), end - 1), F.substring(part, end + 1, F.length(part))
        hexed, plain = F.regexp_extract(name, r"^#[xX]([0-9a-fA-F]{1,6})$", 1), F.regexp_extract(name, r"^#([0-9]{1,7})$", 1)
        code = F.when(hexed != "", F.conv(hexed, 16, 10)).when(plain != "", plain).cast("long")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        number = F.when(name.startswith("#") & valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        return F.coalesce(F.concat(F.coalesce(F.try_element_at(F.try_element_at(named, F.substring(name, 1, 1)), name), number), rest), F.concat(F.lit("&"), part))

    parts = F.split(text, "&", -1)
    swept = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, 1 << 30), one), ""))
    return F.when(text.contains("&"), swept).otherwise(text)


def plain_text(html: Column) -> Column:
    """The visible text: one line per block element, blanks collapsed, empty lines gone."""
    html = F.regexp_replace(html, NO_TEXT, " ")
    html = F.regexp_replace(F.replace(html, F.lit("\n"), F.lit(" ")), LINE_TAG, "\n")
    text = F.regexp_replace(unescaped(F.regexp_replace(html, ANY_TAG, "")), SPACE, " ")
    return F.btrim(F.regexp_replace(text, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def responses_from_pages(pages: DataFrame, date: str) -> DataFrame:
    """Response records of raw pages: an HTTP head and the page as payload. A null url or html counts as empty."""
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    length = F.octet_length(html).cast("string")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length, F.lit("\r\n\r\n"))
    rows = pages.select("page_id", url.alias("target_uri"), F.lit(date).alias("date"), head.alias("http_head"), html.alias("payload"))
    return rows.select(
        "page_id",
        F.lit("response").alias("warc_type"),
        record_id(F.lit("response"), F.col("page_id").cast("string"), F.col("target_uri")).alias("record_id"),
        "target_uri",
        "date",
        "http_head",
        "payload",
        sha1_base32(F.concat("http_head", "payload")).alias("block_digest"),
        sha1_base32(F.col("payload")).alias("payload_digest"),
    )


def _field(name: str) -> Column:
    """A field of the map _h, whatever the case of its name."""
    return F.get(F.filter(F.map_entries("_h"), lambda e: F.lower(e.key) == name.lower()), F.lit(0)).value


def responses_from_records(records: DataFrame) -> DataFrame:
    """Response records of read_records(): the block parted into HTTP head and payload, digests taken from the headers or made.

    A payload is text in Latin-1 if the head says so, else in UTF-8 with what isn't valid
    replaced; a block without a blank line is all head. page_id is null. Records of other types are left out; other columns
    are kept out. Names of fields are matched in any case.
    """
    rows = records.withColumns({"_h": F.coalesce("headers", F.create_map().cast("map<string,string>")), "_b": F.coalesce("block", F.lit(b""))})
    rows = rows.filter(F.lower(_field("WARC-Type")) == "response").select("_h", "_b", F.decode("_b", "ISO-8859-1").alias("_s"))
    end = F.locate("\r\n\r\n", F.col("_s"))
    rows = rows.withColumn("_at", F.when(end > 0, end + 3).otherwise(F.length("_s")))
    rows = rows.withColumns({"_head": F.substring(F.col("_s"), F.lit(1), F.col("_at")), "_payload": F.substring(F.col("_b"), F.col("_at") + 1, F.length("_b"))})
    latin = F.col("_head").rlike(r"(?i)\ncontent-type:[^\r\n]*charset\s*=\s*\"?(?:iso-8859-1|latin-?1|windows-1252)")
    text = F.when(latin, F.decode("_payload", "ISO-8859-1")).otherwise(F.make_valid_utf8(F.col("_payload").cast("string")))
    header = _field
    return rows.select(
        F.lit(None).cast("long").alias("page_id"),
        F.lit("response").alias("warc_type"),
        header("WARC-Record-ID").alias("record_id"),
        F.coalesce(header("WARC-Target-URI"), F.lit("")).alias("target_uri"),
        header("WARC-Date").alias("date"),
        F.col("_head").alias("http_head"),
        text.alias("payload"),
        F.coalesce(header("WARC-Block-Digest"), sha1_base32(F.col("_b"))).alias("block_digest"),
        F.coalesce(header("WARC-Payload-Digest"), sha1_base32(F.col("_payload"))).alias("payload_digest"),
    )


def derivatives(responses: DataFrame) -> DataFrame:
    """Two rows per response: its metadata record and its conversion to plain text.

    Both refer to the response by its id and keep its HTTP head and digests; the metadata
    block (application/warc-fields) gives title, language, charset, the lines of the HTTP head, the
    outlinks in order and the id of the conversion. Nothing is shuffled. Repeated responses give repeated
    records; a null or empty payload gives an empty conversion; texts of any length are converted
    whole; other columns are kept out; an empty table gives an empty one.
    """
    responses = responses.withColumns({"payload": F.coalesce("payload", F.lit("")), "http_head": F.coalesce("http_head", F.lit(""))})
    payload = F.col("payload")
    first = lambda pattern: F.trim(F.regexp_replace(F.regexp_extract(payload, pattern, 1), r"\s+", " "))
    links = F.array_join(F.transform(F.regexp_extract_all(payload, F.lit(OUTLINK), 1), lambda u: F.concat(F.lit("outlink: "), u, F.lit("\r\n"))), "")
    lines = F.filter(F.split("http_head", "\r?\n", -1), lambda x: x != "")
    head = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("source-header: "), x, F.lit("\r\n"))), "")
    converted = record_id(F.lit("conversion"), F.col("record_id"))
    fields = F.concat(
        F.lit("title: "), unescaped(first(TITLE)), F.lit("\r\nlanguage: "), first(LANG), F.lit("\r\ncharset: "), first(CHARSET),
        F.lit("\r\nconversion: "), converted, F.lit("\r\n"), head, links,
    )
    made = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), record_id(F.lit("metadata"), F.col("record_id")).alias("record_id"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), converted.alias("record_id"), F.lit("text/plain; charset=utf-8").alias("content_type"), plain_text(payload).alias("block")),
    )
    source = ["page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", F.col("http_head").alias("source_http_head"),
              F.col("payload_digest").alias("source_payload_digest"), F.col("block_digest").alias("source_block_digest")]
    rows = responses.select(*source, F.explode(made).alias("_made")).select("*", "_made.*").drop("_made")
    return rows.withColumns({"content_length": F.octet_length("block").cast("long"), "block_digest": sha1_base32(F.col("block"))})


HEADERS = [
    ("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "date"), ("WARC-Target-URI", "target_uri"),
    ("WARC-Refers-To", "refers_to"), ("WARC-Block-Digest", "block_digest"), ("X-Source-Payload-Digest", "source_payload_digest"),
    ("X-Source-Block-Digest", "source_block_digest"), ("X-Source-HTTP-Head", "source_http_head"), ("Content-Type", "content_type"), ("Content-Length", "content_length"),
]


def serialized(records: DataFrame) -> DataFrame:
    """record_id and the record's bytes as a WARC file holds them, headers first.

    A header is one line: in the source's HTTP head, line ends are written as \\r and \\n and a backslash twice.
    """
    def line(value: Column) -> Column:
        for char, written in (("\\", "\\\\"), ("\r", "\\r"), ("\n", "\\n")):
            value = F.replace(value, F.lit(char), F.lit(written))
        return value

    lines = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{h}: "), line(F.col(c).cast("string")), F.lit("\r\n"))).otherwise("") for h, c in HEADERS]
    return records.select("record_id", F.encode(F.concat(F.lit("WARC/1.1\r\n"), *lines, F.lit("\r\n"), F.col("block"), F.lit("\r\n\r\n")), "UTF-8").alias("record"))


_FIELD = re.compile(r"(?m)^([\w-]+):[ \t]*([^\r\n]*)")
_CHUNK = 1 << 20


def inflated(data: bytes) -> Iterator[bytes]:
    """The content of a file in chunks, plain or of all members of a gzip file; what is broken off or no gzip ends it."""
    if not data.startswith(b"\x1f\x8b"):
        yield from (data[at : at + _CHUNK] for at in range(0, len(data), _CHUNK))
        return
    at, part = 0, zlib.decompressobj(31)
    while at < len(data):
        try:
            out = part.decompress(data[at : at + _CHUNK], _CHUNK)
            at += _CHUNK
            while out or part.unconsumed_tail:
                yield out
                out = part.decompress(part.unconsumed_tail, _CHUNK) if part.unconsumed_tail else b""
        except zlib.error:
            return
        if part.eof:
            at = min(at, len(data)) - len(part.unused_data)
            part = zlib.decompressobj(31)


def split_records(chunks: Iterable[bytes]) -> Iterator[dict[str, object]]:
    """The records of a WARC file that comes in chunks: headers, block, and whether the block is whole and its digest right.

    Only one record is held at a time. Names of fields count in any case. Where Content-Length is
    missing or no number the block ends at the next record and is not intact, as one that is broken off is not.
    """
    source, held = iter(chunks), bytearray()

    def more() -> bool:
        chunk = next(source, None)
        held.extend(chunk or b"")
        return chunk is not None

    def find(what: bytes, at: int) -> int:
        while (found := held.find(what, at)) < 0:
            at = max(at, len(held) - len(what) + 1)
            if not more():
                return -1
        return found

    while (start := find(b"WARC/", 0)) >= 0 and (end := find(b"\r\n\r\n", start)) >= 0:
        headers = dict(_FIELD.findall(held[start:end].decode("utf-8", "replace")))
        fields = {k.lower(): v for k, v in headers.items()}
        length = fields.get("content-length", "").strip()
        sure = length.isascii() and length.isdigit()
        if sure:
            last = end + 4 + int(length)
            while len(held) < last and more():
                pass
            sure = len(held) >= last
        else:
            following = find(b"\r\n\r\nWARC/", end + 4)
            last = len(held) if following < 0 else following
        block = bytes(held[end + 4 : last])
        del held[:last]
        digest = "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
        yield {"headers": headers, "block": block, "intact": sure and fields.get("warc-block-digest", digest) == digest}


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """headers, block, intact of every record of WARC files, plain or gzip, a file to a task; it is inflated in chunks and parted as it comes."""
    kind = pa.schema([("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary()), ("intact", pa.bool_())])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                rows, size = [], 0
                for r in split_records(inflated(data.as_py())):
                    rows.append(r | {"headers": list(r["headers"].items())})
                    size += len(r["block"])
                    if len(rows) >= 1000 or size > 1 << 24:
                        yield pa.RecordBatch.from_pylist(rows, schema=kind)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=kind)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(parts, "headers map<string,string>, block binary, intact boolean")


def write_records(records: DataFrame, path: str, compression: str = "none", mode: str = "errorifexists") -> None:
    """WARC files under path, one per partition, plain or gzip. path must be reachable from every executor."""
    whole = F.decode("record", "UTF-8")
    framed = serialized(records).select(F.left(whole, F.length(whole) - 4).alias("value"))  # the separator ends the records
    framed.write.mode(mode).option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def oracle_sql(date: str) -> str:
    """DuckDB SQL for derivatives(responses_from_pages(pages, date))."""

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def base32(data: str) -> str:
        parts = " || ".join(f"lower(to_base(('0x' || substr(sha1({data}), {i}, 5))::BIGINT, 32, 4))" for i in range(1, 41, 5))
        return f"'sha1:' || translate({parts}, '{BASE32HEX}', '{BASE32}')"

    def urn(text: str) -> str:
        h = f"md5({text})"
        return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"

    names = ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in ENTITIES.items())

    def replaced(text: str) -> str:
        name, rest = f"substr(p, 1, strpos(substr(p, 1, {WINDOW}), ';') - 1)", "substr(p, strpos(p, ';') + 1)"
        code = (
            f"CASE WHEN regexp_matches({name}, '^#[xX][0-9a-fA-F]{{1,6}}$') THEN ('0x' || substr({name}, 3))::BIGINT "
            f"WHEN regexp_matches({name}, '^#[0-9]{{1,7}}$') THEN substr({name}, 2)::BIGINT END"
        )
        valid = f"(({code}) BETWEEN 1 AND 55295 OR ({code}) BETWEEN 57344 AND 1114111)"
        found = f"coalesce(names[{name}], CASE WHEN {valid} THEN chr(CAST({code} AS INTEGER)) END)"
        swept = f"CASE WHEN strpos(substr(p, 1, {WINDOW}), ';') > 1 AND {found} IS NOT NULL THEN {found} || {rest} ELSE '&' || p END"
        return f"(string_split({text}, '&')[1] || array_to_string(list_transform(string_split({text}, '&')[2:], lambda p: {swept}), ''))"

    text = f"regexp_replace(payload, {quoted(NO_TEXT)}, ' ', 'g')"
    text = f"regexp_replace(replace({text}, chr(10), ' '), {quoted(LINE_TAG)}, chr(10), 'g')"
    text = f"regexp_replace({replaced(f"regexp_replace({text}, {quoted(ANY_TAG)}, '', 'g')")}, {quoted(SPACE)}, ' ', 'g')"
    text = rf"trim(regexp_replace({text}, ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10))"
    first = lambda p: rf"trim(regexp_replace(regexp_extract(payload, {quoted(p)}, 1), '\s+', ' ', 'g'))"
    end = "chr(13) || chr(10)"
    return f"""
WITH r AS (SELECT page_id, coalesce(url, '') AS target_uri, '{date}' AS date, coalesce(html, '') AS payload, MAP {{{names}}} AS names FROM pages),
s AS (SELECT *, 'HTTP/1.1 200 OK' || {end} || 'Content-Type: text/html; charset=utf-8' || {end} || 'Content-Length: ' || strlen(payload) || {end} || {end} AS source_http_head,
  {urn("'response|' || page_id || '|' || target_uri")} AS refers_to FROM r),
t AS (SELECT *, {base32('payload')} AS source_payload_digest, {base32('source_http_head || payload')} AS source_block_digest,
  {urn("'metadata|' || refers_to")} AS m, {urn("'conversion|' || refers_to")} AS c FROM s),
u AS (SELECT page_id, refers_to, target_uri, date, source_http_head, source_payload_digest, source_block_digest, 'metadata' AS warc_type, m AS record_id,
  'application/warc-fields' AS content_type, 'title: ' || {replaced(first(TITLE))} || {end} || 'language: ' || {first(LANG)} || {end} || 'charset: ' || {first(CHARSET)} || {end}
  || 'conversion: ' || c || {end}
  || array_to_string(list_transform(list_filter(string_split(source_http_head, {end}), lambda x: x <> ''), lambda x: 'source-header: ' || x || {end}), '') || array_to_string(list_transform(regexp_extract_all(payload, {quoted(OUTLINK)}, 1), lambda x: 'outlink: ' || x || {end}), '') AS block FROM t
UNION ALL SELECT page_id, refers_to, target_uri, date, source_http_head, source_payload_digest, source_block_digest, 'conversion', c, 'text/plain; charset=utf-8', {text} FROM t)
SELECT *, CAST(strlen(block) AS BIGINT) AS content_length, {base32('block')} AS block_digest FROM u"""
