"""WARC derivatives: web responses to linked metadata and plain-text conversion records.

`responses` makes response records of pages (url, html), `read_responses` reads them from WARC files with the headers
of their source; `derive` gives, for every response, a metadata record (title, language, lengths, digests, the
source's headers) and a conversion record (plain text), both with WARC-Refers-To and WARC-Concurrent-To identifiers,
the source's target address and date, and digests of what they hold; `write` writes them as WARC 1.1 files, `read`
reads such files. Record ids are name-based, from kind, page id, address and payload digest: the same input gives the
same ids, on any executor and after any retry.

The text of a page: comments, scripts and styles go, block elements end a line, all other tags go, entities (those of
HTML 5 by name, and numbers) are decoded, white space is one space, empty lines go.

Cases: a null or empty page is a response with an empty payload and has an empty conversion; a null address is
written empty, line ends in an address are written %0D and %0A; rows equal in page id, address and payload are one
capture and have one id (`number` tells them apart where they are to be records of their own); a null page id is an
id of its own; an empty table gives none; other columns are left out; a very long page costs its length.
"""

from __future__ import annotations

import gzip
import hashlib
import html.entities as entities
import itertools
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonearm.llm.common import Tables, small_batches, table

DATE = "2024-01-01T00:00:00Z"
HTML = "text/html; charset=utf-8"
#: Elements that end a line.
BLOCKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"
HIDDEN = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
TITLE, LANG = r"(?is)<title[^>]*>([^<]*)</title", r"(?i)<html[^>]*\blang=[\"']?([A-Za-z-]+)"
ENTITY = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
#: Entities by name, from Python's own table.
NAMED = {name[:-1]: text for name, text in sorted(entities.html5.items()) if name.endswith(";")}
HEADERS = "array<string>"

_hidden, _title, _lang, _entity, _tag = re.compile(HIDDEN), re.compile(TITLE), re.compile(LANG), re.compile(ENTITY), re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)?[^>]*>")
_block = re.compile(f"(?:{BLOCKS})", re.IGNORECASE)


def char_of(number: int) -> str:
    """The character of a numeric entity: numbers of C1 controls stand for their Windows-1252 characters, as browsers read them."""
    if 0x80 <= number <= 0x9F:
        return bytes([number]).decode("cp1252", "replace")
    return chr(number) if 0 < number < 0xD800 or 0xDFFF < number < 0x110000 else "�"


def decoded(text: str) -> str:
    if "&" not in text:
        return text

    def one(m: re.Match) -> str:
        name = m[1]
        if name[0] != "#":
            return NAMED.get(name, m[0])
        return char_of(int(name[2:], 16) if name[1] in "xX" else int(name[1:]))

    return _entity.sub(one, text)


def plain_text(html: str) -> str:
    text = _hidden.sub(" ", html).replace("\n", " ").replace("\r", " ")
    text = decoded(_tag.sub(lambda m: "\n" if m[1] and _block.fullmatch(m[1]) else "", text))
    return "\n".join(line for line in (" ".join(line.split()) for line in text.split("\n")) if line)


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def urn(h: str) -> str:
    """A name-based identifier from a digest."""
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-a{h[17:20]}-{h[20:32]}>"


def responses(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", date: str = DATE, number: str | None = None) -> DataFrame:
    """Response records: page_id, record_id, target_uri, date, content_type, headers, payload, payload_digest."""
    uri = F.replace(F.replace(F.coalesce(F.col(url), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    own = F.concat(F.col(id).cast("string"), F.lit("/"), F.col(number).cast("string")) if number else F.col(id).cast("string")
    out = pages.select(F.col(id).alias("page_id"), F.coalesce(own, F.lit("")).alias("own"), uri.alias("target_uri"), F.coalesce(F.col(html), F.lit("")).alias("payload"))
    out = out.select("*", F.concat(F.lit("sha256:"), F.sha2("payload", 256)).alias("payload_digest"))
    h = F.sha2(F.concat_ws("\n", F.lit("response"), "own", "target_uri", "payload_digest"), 256)
    part = lambda a, n: F.substring("h", a, n)
    record_id = F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))
    out = out.select("*", h.alias("h"))
    return out.select("page_id", record_id.alias("record_id"), "target_uri", F.lit(date).alias("date"), F.lit(HTML).alias("content_type"), F.expr(f"cast(array() as {HEADERS})").alias("headers"), "payload", "payload_digest")


def derive(found: DataFrame) -> DataFrame:
    """For every response a metadata and a conversion record; one row each, made in one pass without a shuffle.

    The name of a derived record is made of its kind, the response's id and its own digest.
    """
    small_batches(found.sparkSession)
    names = ("page_id", "record_id", "target_uri", "date", "content_type", "headers", "payload", "payload_digest")
    text = ("warc_type", "record_id", "refers_to", "concurrent_to", "target_uri", "date", "content_type", "source_content_type", "source_digest")
    out = ("page_id", *text, "content_length", "block_digest", "block")
    schema = T.StructType([T.StructField("page_id", found.schema["page_id"].dataType), *[T.StructField(n, T.StringType()) for n in text], T.StructField("content_length", T.LongType()), T.StructField("block_digest", T.StringType()), T.StructField("block", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for page, record, uri, date, kind, headers, payload, digest in zip(*[batch.column(n).to_pylist() for n in names], strict=True):
                plain = plain_text(payload)
                title, lang = _title.search(payload), _lang.search(payload)
                whole = plain.encode()
                fields = [f"title: {' '.join(decoded(title[1]).split()) if title else ''}", f"language: {lang[1].lower() if lang else ''}", f"source-content-type: {kind}", f"source-length: {len(payload.encode())}"]
                fields += [f"source-payload-digest: {digest}", f"text-length: {len(whole)}", f"text-digest: sha256:{sha(whole)}", *[f"source-header: {x}" for x in headers], ""]
                notes = "\r\n".join(fields).encode()
                made = [(t, urn(sha(f"{t}\n{record}\nsha256:{sha(block)}")), mime, block) for t, mime, block in (("metadata", "application/warc-fields", notes), ("conversion", "text/plain; charset=utf-8", whole))]
                for (t, own, mime, block), other in zip(made, made[::-1], strict=True):
                    rows.append((page, t, own, record, other[1], uri, date, mime, kind, digest, len(block), f"sha256:{sha(block)}", block.decode()))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(out)
            types = [batch.schema.field("page_id").type, *[pa.string()] * len(text), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(out))

    return found.select(*names).mapInArrow(run, schema)


def records(derived: DataFrame) -> DataFrame:
    """(page_id, record): each record as WARC 1.1 text, with the two line ends that close it."""
    header = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), "warc_type"), F.concat(F.lit("WARC-Record-ID: "), "record_id"), F.concat(F.lit("WARC-Refers-To: "), "refers_to"),
        F.concat(F.lit("WARC-Concurrent-To: "), "concurrent_to"), F.concat(F.lit("WARC-Target-URI: "), "target_uri"), F.concat(F.lit("WARC-Date: "), "date"),
        F.concat(F.lit("WARC-Block-Digest: "), "block_digest"), F.concat(F.lit("Content-Type: "), "content_type"), F.concat(F.lit("Content-Length: "), F.col("content_length").cast("string")), F.lit(""), F.lit(""),
    )
    return derived.select("page_id", F.concat(header, "block", F.lit("\r\n\r\n")).alias("record"))


def members(derived: DataFrame) -> DataFrame:
    """(page_id, member): each record as a gzip member of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [gzip.compress(x.encode(), mtime=0) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["page_id", "member"])

    rows = records(derived)
    return rows.mapInArrow(run, T.StructType([rows.schema["page_id"], T.StructField("member", T.BinaryType())]))


def write(derived: DataFrame, path: str, compress: bool = False) -> None:
    """WARC files, one for each task; compressed, every record is a gzip member, with an empty member after it, the sink's separator."""
    if compress:
        raw = members(derived).select(F.col("member").cast("string"))  # bytes as they are
        raw.write.mode("overwrite").option("encoding", "ISO-8859-1").option("lineSep", gzip.compress(b"", mtime=0).decode("latin-1")).text(path)
    else:
        records(derived).select(F.substring("record", F.lit(1), F.length("record") - 2)).write.mode("overwrite").option("lineSep", "\r\n").text(path)


#: What may begin a record, after the two line ends that close the one before.
BEGINS = "WARC/"
_size = re.compile(rb"(?im)^content-length:[ \t]*([0-9]+)[ \t]*\r?$")


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, row, piece): the stretches between what may be the beginnings of records, as bytes, in the order of the file."""
    rows = spark.read.option("lineSep", "\r\n\r\n" + BEGINS).text(path)
    meta, raw = F.col("_metadata"), F.col("value").cast("binary")  # bytes: patterns would replace what is not UTF-8
    piece = F.when(F.startswith("value", F.lit(BEGINS)), F.substring(raw, F.lit(len(BEGINS) + 1), F.length(raw))).otherwise(raw)
    return rows.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("row"), piece.alias("piece"))


def short_by(piece: bytes) -> int | None:
    """Bytes that a record lacks of the length its header says, below 0 where it has more; nothing where there is no such header."""
    head, gap, block = piece.partition(b"\r\n\r\n")
    found = _size.search(head)
    return int(found[1]) - len(block) if gap and found else None


def joined(stretches: Iterator[bytes]) -> Iterator[bytes]:
    """Records of one file from its pieces: a piece that is too short takes up those after it if they end where its length says; else it was cut short."""
    glue = b"\r\n\r\n" + BEGINS.encode()
    ahead: deque[bytes] = deque()
    while True:
        first = ahead.popleft() if ahead else next(stretches, None)
        if first is None:
            return
        lacks, used = short_by(first), 0
        while lacks is not None and lacks > 0:
            if used == len(ahead):
                following = next(stretches, None)
                if following is None:
                    break
                ahead.append(following)
            lacks -= len(glue) + len(ahead[used])
            used += 1
        # The last record of a file has its line ends still.
        fits = lacks is not None and (lacks == 0 or (lacks < 0 and used and not (ahead[used - 1][lacks:]).strip(b"\r\n")))
        if used and fits:
            yield glue.join([first, *(ahead.popleft() for _ in range(used))])
        else:
            yield first


def whole_records(found: DataFrame) -> DataFrame:
    """(piece): pieces of files in which some are too short, joined where one payload was cut; a file is walked through by one task, a record at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((f, x) for batch in batches for f, x in zip(batch.column("file").to_pylist(), (v.as_py() for v in batch.column("piece")), strict=True))
        for _, of_file in itertools.groupby(rows, key=lambda r: r[0]):
            for record in joined(x for _, x in of_file):
                yield pa.RecordBatch.from_arrays([pa.array([record], pa.binary())], names=["piece"])

    return found.repartition("file").sortWithinPartitions("file", "start", "row").select("file", "piece").mapInArrow(run, "piece binary")


def read(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """The records of WARC files of any version, compressed or not (gzip files end in .gz): version, fields (map of lower-case names), block (bytes), whole.

    A record is as long as its Content-Length says. Files are streamed as stretches between what looks like the
    beginning of a record; a first pass looks for files in which a stretch is too short (a payload that holds such a
    line, or a record that was cut off), and these alone are put in order and joined. `whole` is false where a block is
    not as long as its header says. `version` keeps the records of one version ("1.0").
    """
    small_batches(spark)
    every = pieces(spark, path)
    text = F.col("piece").cast("string")
    head = F.substring_index(text, "\r\n\r\n", 1)
    size = F.regexp_extract(head, r"(?im)^content-length:[ \t]*([0-9]+)[ \t]*\r?$", 1).try_cast("long")
    rest = F.length("piece") - F.octet_length(head) - 4
    tables = Tables(spark, "warc")
    broken = tables.write(every.filter(F.contains(text, F.lit("\r\n\r\n")) & (rest < size)).select("file").distinct(), "broken")
    rows = every.select("piece") if broken.isEmpty() else every.join(broken, "file", "left_anti").select("piece").unionByName(whole_records(every.join(broken, "file", "left_semi")))
    lines = F.split(head, "\r\n")
    pairs = F.transform(F.slice(lines, F.lit(2), F.size(lines)), lambda x: F.struct(F.lower(F.substring_index(x, ":", 1)).alias("name"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("value")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["name"]))  # a field that comes twice counts as it came first
    fields = F.map_from_arrays(names, F.transform(names, lambda n: F.filter(pairs, lambda p: p["name"] == n)[0]["value"]))
    raw = F.substring(F.col("piece"), F.octet_length(head) + 5, F.length("piece"))
    cut = F.when(size.isNotNull() & (F.length(raw) >= size), F.substring(raw, F.lit(1), size.cast("int"))).otherwise(raw)
    out = rows.filter(F.contains(text, F.lit("\r\n\r\n"))).select(F.get(lines, F.lit(0)).alias("version"), fields.alias("fields"), cut.alias("block"), size.alias("size"))
    out = out.filter(F.col("version") == version) if version else out
    return out.select("version", "fields", "block", F.coalesce(F.length("block") == F.col("size"), F.lit(False)).alias("whole"))


def read_responses(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """The response records of WARC files as `responses` gives them: identifiers and date of the source, its HTTP headers, its payload and its payload digest.

    page_id is the record's identifier. The digest is the one that the source has, whatever its algorithm; where it has
    none, the SHA-256 of the payload's bytes. Payloads in Latin-1 or Windows-1252, by their Content-Type, are decoded as
    such, all others as UTF-8 with replacement characters for what is not. Records that are cut short are left out.
    """
    found = read(spark, path, version).filter("whole and fields['warc-type'] = 'response'").select("fields", "block")
    head = F.substring_index(F.col("block").cast("string"), "\r\n\r\n", 1)
    found = found.select("fields", F.split(F.make_valid_utf8(head), "\r\n").alias("head"), F.substring(F.col("block"), F.octet_length(head) + 5, F.length("block")).alias("bytes"))
    headers = F.slice("head", F.lit(2), F.greatest(F.size("head") - 1, F.lit(0)))  # the first line is the status
    kind = F.regexp_extract(F.array_join("head", "\n"), r"(?im)^content-type:[ \t]*([^\n]*?)[ \t]*$", 1)
    latin = F.lower(kind).rlike(r"charset=\"?(iso-8859-1|latin-?1|windows-1252|cp1252)\"?")
    payload = F.when(latin, F.translate(F.decode("bytes", "ISO-8859-1"), "".join(map(chr, range(0x80, 0xA0))), "".join(map(char_of, range(0x80, 0xA0))))).otherwise(F.make_valid_utf8(F.col("bytes").cast("string")))
    digest = F.coalesce(F.nullif(F.col("fields")["warc-payload-digest"], F.lit("")), F.concat(F.lit("sha256:"), F.sha2("bytes", 256)))
    field = lambda n: F.coalesce(F.col("fields")[n], F.lit(""))
    return found.select(field("warc-record-id").alias("page_id"), field("warc-record-id").alias("record_id"), field("warc-target-uri").alias("target_uri"), field("warc-date").alias("date"), kind.alias("content_type"), headers.alias("headers"), payload.alias("payload"), digest.alias("payload_digest"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of all pages."""
    return derive(responses(table(spark, sf_dir, "pages")))


def _sql() -> str:
    """The same records in DuckDB's SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    swap = lambda c, pattern, to: f"regexp_replace({c}, {q(pattern)}, {to}, 'g')"
    space = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    c1 = "[" + ", ".join(q(char_of(i)) for i in range(0x80, 0xA0)) + "]"
    by_number = lambda n: f"CASE WHEN {n} BETWEEN 128 AND 159 THEN {c1}[{n} - 127] WHEN {n} = 0 OR {n} BETWEEN 55296 AND 57343 OR {n} > 1114111 THEN chr(65533) ELSE chr({n}::INTEGER) END"
    named = "MAP {" + ", ".join(f"{q(n)}: {q(t)}" for n, t in NAMED.items()) + "}"

    def entity(c: str) -> str:
        name = f"regexp_extract('&' || x, {q('^' + ENTITY)}, 1)"
        one = f"CASE WHEN {name} = '' THEN '&' || x WHEN {name}[1:2] IN ('#x', '#X') THEN ({by_number(f'''('0x' || {name}[3:])::BIGINT''')}) || x[len({name}) + 2:] WHEN {name}[1] = '#' THEN ({by_number(f'{name}[2:]::BIGINT')}) || x[len({name}) + 2:] ELSE coalesce(m[{name}] || x[len({name}) + 2:], '&' || x) END"
        return f"CASE WHEN contains({c}, '&') THEN string_split({c}, '&')[1] || array_to_string(list_transform(string_split({c}, '&')[2:], lambda x: {one}), '') ELSE {c} END"

    text = swap(swap(swap("payload", HIDDEN, "' '"), r"[\n\r]", "' '"), rf"(?i)</?(?:{BLOCKS})(?:[^a-z0-9>][^>]*)?>", "chr(10)")
    text = swap(text, r"<[^>]*>", "''")
    lines = f"array_to_string(list_filter(list_transform(string_split(entities, chr(10)), lambda x: trim({swap('x', space + '+', chr(39) + ' ' + chr(39))})), lambda x: x <> ''), chr(10))"
    urn_of = lambda h: f"'<urn:uuid:' || {h}[1:8] || '-' || {h}[9:12] || '-5' || {h}[14:16] || '-a' || {h}[18:20] || '-' || {h}[21:32] || '>'"
    own = lambda kind, block: urn_of(f"sha256('{kind}' || chr(10) || refers_to || chr(10) || 'sha256:' || sha256({block}))")
    crlf = "chr(13) || chr(10)"
    fields = f" || {crlf} || ".join(["'title: ' || title", "'language: ' || lang", f"'source-content-type: {HTML}'", "'source-length: ' || strlen(payload)", "'source-payload-digest: ' || payload_digest", "'text-length: ' || strlen(text)", "'text-digest: sha256:' || sha256(text)", "''"])
    return f"""
WITH named AS MATERIALIZED (SELECT {named} AS m),
a AS (SELECT page_id, replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') AS target_uri, coalesce(html, '') AS payload, 'sha256:' || sha256(coalesce(html, '')) AS payload_digest FROM pages),
b AS (SELECT *, {urn_of("sha256('response' || chr(10) || coalesce(page_id::VARCHAR, '') || chr(10) || target_uri || chr(10) || payload_digest)")} AS refers_to, {text} AS stripped, regexp_extract(payload, {q(TITLE)}, 1) AS raw_title, lower(regexp_extract(payload, {q(LANG)}, 1)) AS lang FROM a),
c AS (SELECT *, {entity('stripped')} AS entities, trim({swap('(' + entity('raw_title') + ')', space + '+', chr(39) + ' ' + chr(39))}) AS title FROM b, named),
d AS (SELECT *, {lines} AS text FROM c),
e AS (SELECT *, {fields} AS fields FROM d),
f AS (SELECT *, {own('metadata', 'fields')} AS metadata_id, {own('conversion', 'text')} AS conversion_id FROM e),
g AS (SELECT *, 'metadata' AS warc_type, metadata_id AS record_id, conversion_id AS concurrent_to, 'application/warc-fields' AS content_type, fields AS block FROM f
UNION ALL SELECT *, 'conversion', conversion_id, metadata_id, 'text/plain; charset=utf-8', text FROM f)
SELECT page_id, warc_type, record_id, refers_to, concurrent_to, target_uri, '{DATE}' AS date, content_type, '{HTML}' AS source_content_type,
payload_digest AS source_digest, strlen(block)::BIGINT AS content_length, 'sha256:' || sha256(block) AS block_digest, block FROM g"""


ORACLE_SQL = _sql()
