"""WARC derivatives: response records to linked metadata and conversion records.

For every response a metadata record (JSON: the source record's headers, the
HTTP headers, title and links of the page) and a conversion record (the page
as plain text) are made. Both refer to the response by its record id and carry
its target, date and digests. DataFrame functions only; records are written and
read as text files, one gzip stream per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CAPTURED = "1970-01-01T00:00:00Z"  # date of records whose source has none
HTTP_STATUS = "HTTP/1.1 200 OK"

# Fixed patterns of the plain-text conversion, applied in order (pattern, replacement).
TEXT_RULES = (
    (r"(?is)<script\b[^>]*>.*?(?:</script\s*>|\z)", " "),
    (r"(?is)<style\b[^>]*>.*?(?:</style\s*>|\z)", " "),
    (r"(?s)<!--.*?(?:-->|\z)", " "),
    (r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>", "\n"),
    (r"</?[a-zA-Z!][^>]*>", ""),
)
# Fixed named character references that are resolved (HTML's); others stay as they are.
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "),
              ("&copy;", "©"), ("&middot;", "·"), ("&reg;", "®"), ("&trade;", "™"), ("&deg;", "°"), ("&sect;", "§"), ("&euro;", "€"),
              ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"),
              ("&laquo;", "«"), ("&raquo;", "»"), ("&bull;", "•"), ("&times;", "×"), ("&szlig;", "ß"), ("&ccedil;", "ç"), ("&ntilde;", "ñ"),
              ("&agrave;", "à"), ("&aacute;", "á"), ("&acirc;", "â"), ("&auml;", "ä"), ("&egrave;", "è"), ("&eacute;", "é"), ("&ecirc;", "ê"),
              ("&euml;", "ë"), ("&iacute;", "í"), ("&icirc;", "î"), ("&iuml;", "ï"), ("&oacute;", "ó"), ("&ocirc;", "ô"), ("&ouml;", "ö"),
              ("&uacute;", "ú"), ("&ugrave;", "ù"), ("&ucirc;", "û"), ("&uuml;", "ü"), ("&Auml;", "Ä"), ("&Ouml;", "Ö"), ("&Uuml;", "Ü"),
              ("&Eacute;", "É"), ("&amp;", "&"))
REFERENCE = "&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|" + "|".join(name[1:-1] for name, _ in REFERENCES) + ");"
SPACE_RULES = ((r"[ \t\x0B\f\r]+", " "), (r" ?\n[ \n]*", "\n"), (r"^[ \n]+|[ \n]+$", ""))
TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
# The value of href as it is written: in double or single quotes, or bare.
LINK = r"""(?i)<a(?:\s[^>]*?)?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
QUOTES = "^[\"']|[\"']$"


def record_id(*parts: Column) -> Column:
    """<urn:uuid:...> fixed by the parts."""
    h = F.md5(F.concat_ws("\n", *parts).cast("binary"))
    cut = [F.substring(h, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def _character(code: Column) -> Column:
    """The character of a reference (#233, #xE9 or eacute); U+FFFD for a number that no character has."""
    number = F.when(F.lower(F.substring(code, 2, 1)) == "x", F.conv(F.substring(code, 3, 8), 16, 10)).otherwise(F.substring(code, 2, 8)).cast("long")
    good = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    numeric = F.decode(F.unhex(F.lpad(F.hex(F.when(good, number).otherwise(0xFFFD)), 8, "0")), "UTF-32")
    named = F.create_map(*[F.lit(x) for name, char in REFERENCES for x in (name[1:-1], char)])
    return F.when(F.startswith(code, F.lit("#")), numeric).otherwise(F.element_at(named, code))


def references(text: Column) -> Column:
    """Numeric references and the named ones of REFERENCES resolved in one pass. ``text`` should be a plain column, as it is read thrice."""
    parts = F.split(text, REFERENCE, -1)
    chars = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1)), _character)
    whole = F.array_join(F.zip_with(parts, chars, lambda p, c: F.concat(p, F.coalesce(c, F.lit("")))), "")
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


def _replaced(text: Column, rules) -> Column:
    for pattern, to in rules:
        text = F.regexp_replace(text, pattern, to)
    return text


def plain_text(pages: DataFrame, html: str, out: str) -> DataFrame:
    """Adds the text of a page: scripts, styles, comments and tags go, block elements break lines, references are resolved, blank lines go."""
    return pages.withColumn(out, _replaced(F.col(html), TEXT_RULES)).withColumn(out, references(F.col(out))).withColumn(
        out, _replaced(F.col(out), SPACE_RULES))


def responses(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> response records; a null url or html counts as empty."""
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    head = F.concat(F.lit(f"{HTTP_STATUS}\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        record_id(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), url, html).alias("record_id"),
        url.alias("target_uri"), F.lit(CAPTURED).alias("date"), head.alias("http_header"), html.alias("payload"))


def derivatives(source: DataFrame) -> DataFrame:
    """Response records -> two derived records each.

    Columns: page_id, warc_type ('metadata' or 'conversion'), record_id,
    refers_to, target_uri, date, content_type, content_length (bytes),
    block_digest, source_payload_digest, source_header, block. Empty payloads
    give an empty conversion and a metadata record without title and links.
    Repeated responses give repeated records; other columns are not read.
    """
    s = source.select("page_id", "record_id", "target_uri", "date", "http_header", "payload")
    s = plain_text(s, "payload", "plain").withColumn("title", F.regexp_extract("payload", TITLE, 1)).withColumn("payload_digest", digest(F.col("payload")))
    s = s.withColumn("links", F.regexp_extract_all("payload", F.lit(LINK), F.lit(1)))
    title = F.regexp_replace(references(F.col("title")), r"[ \t\x0B\f\r\n]+", " ")
    size = (F.octet_length("http_header") + F.octet_length("payload")).cast("string")
    envelope = F.to_json(F.struct(
        F.struct(F.lit("response").alias("WARC-Type"), F.col("record_id").alias("WARC-Record-ID"), F.col("target_uri").alias("WARC-Target-URI"),
                 F.col("date").alias("WARC-Date"), size.alias("Content-Length"), F.col("payload_digest").alias("WARC-Payload-Digest")).alias("source"),
        F.col("http_header").alias("http"), title.alias("title"), F.transform("links", lambda x: references(F.regexp_replace(x, QUOTES, ""))).alias("links")))
    both = F.explode(F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/json").alias("content_type"), envelope.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain").alias("content_type"), F.col("plain").alias("block"))))
    rows = s.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", "http_header", "payload_digest", both.alias("r"))
    return rows.select(
        "page_id", "r.warc_type", record_id(F.col("r.warc_type"), F.col("refers_to")).alias("record_id"), "refers_to", "target_uri", "date", "r.content_type",
        F.octet_length("r.block").cast("long").alias("content_length"), digest(F.col("r.block")).alias("block_digest"),
        F.col("payload_digest").alias("source_payload_digest"), F.col("http_header").alias("source_header"), "r.block")


def warc_text(records: DataFrame) -> DataFrame:
    """Derived records -> (value): whole WARC records but for the version line and the closing blank lines."""
    line = lambda name, col: F.concat(F.lit(f"{name}: "), col, F.lit("\r\n"))
    return records.select(F.concat(
        line("WARC-Type", F.col("warc_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Refers-To", F.col("refers_to")),
        line("WARC-Target-URI", F.col("target_uri")), line("WARC-Date", F.col("date")), line("WARC-Block-Digest", F.col("block_digest")),
        line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length").cast("string")), F.lit("\r\n"), F.col("block")).alias("value"))


VERSION = "WARC/1.1\r\n"


def write_warc(records: DataFrame, path: str) -> None:
    """One .gz file of WARC records per partition."""
    (warc_text(records).select(F.concat(F.lit(VERSION), "value", F.lit("\r\n")).alias("value"))
     .write.option("lineSep", "\r\n").option("compression", "gzip").text(path))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records (headers map, block) of files of ``write_warc``.

    Records end where a blank line is followed by the next version line. A block
    that holds this very sequence is cut there; its Content-Length shows it, and
    reading raises.
    """
    raw = spark.read.option("lineSep", "\r\n\r\n" + VERSION).text(path)
    body = F.regexp_replace(F.regexp_replace("value", r"\A" + VERSION, ""), r"\r\n\r\n\z", "")
    rows = raw.select(body.alias("v")).where("v <> ''").select(F.split("v", "\r\n\r\n", 2).alias("p"))
    pairs = F.transform(F.split(F.col("p")[0], "\r\n"), lambda x: F.struct(F.substring_index(x, ": ", 1).alias("key"), F.regexp_replace(x, r"\A[^:]*: ", "").alias("value")))
    out = rows.select(F.map_from_entries(pairs).alias("headers"), F.col("p")[1].alias("block"))
    whole = F.octet_length("block") == F.col("headers")["Content-Length"].cast("int")
    return out.select("headers", F.when(whole, F.col("block")).otherwise(F.raise_error(F.lit("a record's Content-Length does not match its block"))).alias("block"))


def oracle() -> str:
    """DuckDB SQL for the derivatives of the pages table."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    u = lambda h: f"('<urn:uuid:' || substr({h},1,8) || '-' || substr({h},9,4) || '-' || substr({h},13,4) || '-' || substr({h},17,4) || '-' || substr({h},21,12) || '>')"
    nl = "chr(13) || chr(10)"

    names = "MAP {" + ", ".join(f"{q(name[1:-1])}: {q(char)}" for name, char in REFERENCES) + "}"
    code = "CASE WHEN lower(c[2]) = 'x' THEN CAST('0x' || substr(c, 3) AS BIGINT) ELSE CAST(substr(c, 2) AS BIGINT) END"
    number = f"chr(CAST(CASE WHEN {code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111 THEN {code} ELSE 65533 END AS INTEGER))"
    chars = f"list_transform(regexp_extract_all(y, {q(REFERENCE)}, 1), lambda c: CASE WHEN c[1] = '#' THEN {number} ELSE map_extract({names}, c)[1] END)"
    pieces = f"regexp_split_to_array(y, {q(REFERENCE.replace('(', '(?:'))})"

    def refs(x: str) -> str:
        return f"list_transform([{x}], lambda y: list_aggregate(list_transform(list_zip({pieces}, {chars}), lambda z: z[1] || coalesce(z[2], '')), 'string_agg', ''))[1]"
    text = "payload"
    for pattern, to in TEXT_RULES:
        text = f"regexp_replace({text}, {q(pattern)}, {'chr(10)' if to == chr(10) else q(to)}, 'g')"
    text = refs(text)
    for pattern, to in SPACE_RULES:
        text = f"regexp_replace({text}, {q(pattern)}, {'chr(10)' if to == chr(10) else q(to)}, 'g')"
    title = "regexp_replace(" + refs(f"regexp_extract(payload, {q(TITLE)}, 1)") + f", {q(r'[ \t\x0B\f\r\n]+')}, ' ', 'g')"
    return f"""WITH r AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload,
  md5('response' || chr(10) || coalesce(CAST(page_id AS VARCHAR), '') || chr(10) || coalesce(url, '') || chr(10) || coalesce(html, '')) AS h FROM pages),
s AS (SELECT page_id, target_uri, payload, {u('h')} AS refers_to, 'sha256:' || sha256(payload) AS payload_digest,
  '{HTTP_STATUS}' || {nl} || 'Content-Type: text/html; charset=utf-8' || {nl} || 'Content-Length: ' || strlen(payload) || {nl} || {nl} AS http_header FROM r),
b AS (SELECT *, 'metadata' AS warc_type, 'application/json' AS content_type, CAST(json_object('source',
    json_object('WARC-Type', 'response', 'WARC-Record-ID', refers_to, 'WARC-Target-URI', target_uri, 'WARC-Date', '{CAPTURED}', 'Content-Length', CAST(strlen(http_header) + strlen(payload) AS VARCHAR), 'WARC-Payload-Digest', payload_digest),
    'http', http_header, 'title', {title}, 'links', list_transform(regexp_extract_all(payload, {q(LINK)}, 1), lambda x: {refs(f"regexp_replace(x, {q(QUOTES)}, '', 'g')")})) AS VARCHAR) AS block FROM s
  UNION ALL SELECT *, 'conversion', 'text/plain', {text} FROM s)
SELECT page_id, warc_type, {u("md5(warc_type || chr(10) || refers_to)")} AS record_id, refers_to, target_uri, '{CAPTURED}' AS date, content_type,
  CAST(strlen(block) AS BIGINT) AS content_length, 'sha256:' || sha256(block) AS block_digest, payload_digest AS source_payload_digest, http_header AS source_header, block FROM b"""
