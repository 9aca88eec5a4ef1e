"""Readers for message exports, chats, pages, lexicons and plain files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import textfn as tx
from threadloom.functions.ordered import running_sums
from threadloom.operators.patterns import numbered_lines

# Members of a JSON export that may hold the message list.
LIST_MEMBERS = ["messages", "sms", "mms", "data", "conversations", "items"]

SMS_SCHEMA = (
    "_address string, _contact_name string, _date string, _type string, _body string, _text string"
)


# --- files -----------------------------------------------------------------------------------


def read_json_messages(spark: SparkSession, path: str, schema=None, lines: bool = False) -> DataFrame:
    """Message rows of JSON exports: a top-level array, or an object with a list member.

    ``sms`` and ``mms`` lists are concatenated; an object without a list member is one row.
    ``lines`` reads one JSON value per line, which Spark can split inside a file.
    """
    reader = spark.read.option("multiLine", not lines)
    raw = (reader.schema(schema) if schema is not None else reader).json(path)
    members = [
        c for c in LIST_MEMBERS
        if c in raw.columns and dict(raw.dtypes)[c].startswith("array<struct")
    ]
    if not members:
        return raw
    chosen = [m for m in ("sms", "mms") if m in members] if members[0] in ("sms", "mms") else members[:1]
    out = None
    for m in chosen:
        part = raw.select(F.inline(m))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_delimited(spark: SparkSession, path: str, sep: str = ",", schema=None) -> DataFrame:
    reader = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def read_table_file(spark: SparkSession, path: str, fmt: str, **options) -> DataFrame:
    """Tabular JSON, CSV, TSV or Parquet."""
    if fmt in ("csv", "tsv"):
        return read_delimited(spark, path, "\t" if fmt == "tsv" else ",", options.get("schema"))
    return spark.read.options(**options).format(fmt).load(path)


def read_sms_xml(spark: SparkSession, path: str) -> DataFrame:
    """Android backups: one row per ``<sms>`` and ``<mms>`` element with text.

    The schema is explicit, since inference would turn phone numbers into integers. Type 2 is a
    sent message.
    """
    parts = [
        spark.read.format("xml").option("rowTag", tag).schema(SMS_SCHEMA).load(path).withColumn("kind", F.lit(tag))
        for tag in ("sms", "mms")
    ]
    raw = parts[0].unionByName(parts[1])
    body = F.coalesce(F.nullif("_body", F.lit("")), "_text")
    named = F.when(F.col("_contact_name").isin("(Unknown)", "null", ""), None).otherwise(F.col("_contact_name"))
    other = F.coalesce(named, "_address", F.lit("Unknown"))
    sent = F.col("_type") == "2"
    return raw.where(F.trim(body) != "").select(
        F.timestamp_millis(F.col("_date").cast("long")).alias("ts"),
        F.when(sent, "Me").otherwise(other).alias("sender"),
        F.when(sent, other).otherwise("Me").alias("recipient"),
        body.alias("text"),
        F.when(sent, "sent").otherwise("received").alias("type"),
        "kind",
        F.col("_address").alias("address"),
    )


def read_whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Plain text: one message per non-blank line."""
    return spark.read.text(path).select(F.trim("value").alias("text")).where("text <> ''")


def scan_files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """Path, name, size and modification time of files; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "modificationTime")


def hash_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """SHA-256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("hash"))


def read_assistant_export(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """Turns of chat-assistant exports: a list of conversations or ``{conversations: [...]}``."""
    raw = spark.read.option("multiLine", not lines).schema(schema).json(path)
    conv = raw.select(F.inline("conversations")) if "conversations" in raw.columns else raw
    turns = conv.select("conversation_id", F.posexplode("messages").alias("turn", "m"))
    return turns.select(
        F.sha2(F.concat_ws("|", "conversation_id", "turn", "m.role", "m.content"), 256).alias("message_hash"),
        "conversation_id",
        F.lit("chatgpt").alias("platform"),
        "turn",
        F.col("m.role").alias("turn_type"),
        F.col("m.content").alias("content"),
    )


def read_lexicon(spark: SparkSession, path: str, sep: str | None = None, language: str | None = None, categories: dict[str, str] | None = None) -> DataFrame:
    """Lexicon rows (term, category, language, severity) from TSV, CSV or plain term lists.

    The delimiter is sniffed from the first line; terms are lower-cased, categories mapped, the
    severity defaults to 5.
    """
    first = spark.read.text(path).first()
    head = first[0] if first else ""
    if sep is None:
        sep = next((s for s in ("\t", ",", ";") if s in head), None)
    if sep is None:
        raw = spark.read.text(path).select(F.col("value").alias("term"))
    else:
        raw = spark.read.option("header", True).option("sep", sep).csv(path)
    raw = raw.withColumnsRenamed({c: c.strip().lower() for c in raw.columns})
    col = lambda *names: F.coalesce(*[F.col(n) for n in names if n in raw.columns], F.lit(None).cast("string"))
    category = col("category", "type")
    if categories:
        mapped = F.create_map(*[F.lit(x) for kv in categories.items() for x in kv])
        category = F.coalesce(F.try_element_at(mapped, F.upper(category)), category)
    out = raw.select(
        F.lower(F.trim(col("term", "lemma", "word"))).alias("term"),
        category.alias("category"),
        F.coalesce(col("language", "lang"), F.lit("en")).alias("language"),
        F.coalesce(col("severity").try_cast("int"), F.lit(5)).alias("severity"),
    ).where("term is not null and term <> ''")
    return out.where(F.col("language") == language) if language else out


# --- formats ---------------------------------------------------------------------------------


def detect_format(name: Column, head: Column) -> Column:
    """Format by extension, else by the first characters of the content."""
    extension = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    by_name = (
        F.when(extension.isin("html", "htm"), "html").when(extension == "xml", "xml").when(extension == "csv", "csv")
        .when(extension == "tsv", "tsv").when(extension == "json", "json").when(extension.isin("txt", "md", "log"), "text")
        .when(extension == "pdf", "pdf")
    )
    start = F.lower(F.ltrim(F.substring(head, 1, 4096)))
    by_content = (
        F.when(F.startswith(start, F.lit("<!doctype html")) | F.startswith(start, F.lit("<html")), "html")
        .when(F.startswith(start, F.lit("<?xml")) | F.contains(start, F.lit("<sms ")), "xml")
        .when(F.startswith(start, F.lit("%pdf")), "pdf")
        .when(start.rlike(r"^[\[{]"), "json")
        .otherwise("text")
    )
    return F.coalesce(by_name, by_content)


def detect_platform(head: Column) -> Column:
    """Source platform by marks in the first part of the content."""
    start = F.lower(F.substring(head, 1, 8192))
    has = lambda s: F.contains(start, F.lit(s))
    return (
        F.when(has("<smses") | has("<sms "), "sms")
        .when(has("_3-95") | has("messenger"), "facebook")
        .when(has("imessage"), "imessage")
        .when(has("from:") & has("subject:"), "email")
        .when(has('"role"') & has('"content"'), "chatgpt")
        .otherwise("unknown")
    )


# --- text columns ----------------------------------------------------------------------------


def _element(block: Column, *marks: str) -> Column:
    """Stripped text of the first element carrying one of the attribute marks."""
    found = [
        F.nullif(tx.unescape_html(tx.strip_tags(F.regexp_extract(block, rf"<[a-z]+[^>]*{m}[^>]*>([\s\S]*?)</", 1))), F.lit(""))
        for m in marks
    ]
    return F.coalesce(*found)


def parse_chat_html(docs: DataFrame, id_col: str = "doc_id", html_col: str = "html") -> DataFrame:
    """Messages of a chat page: sender, text, time, thread, kind and reactions.

    The page is cut in front of each message block; blocks without text are dropped.
    """
    blocks = F.filter(
        F.split(F.col(html_col), r'(?=<div class="pam _3-95)|(?=<div [^>]*data-testid="message")', -1),
        lambda b: F.contains(b, F.lit('class="pam _3-95')) | F.contains(b, F.lit('data-testid="message"')),
    )
    rows = docs.select(id_col, F.posexplode(blocks).alias("position", "b"))
    b = F.col("b")
    has = lambda s: F.contains(b, F.lit(s))
    kind = (
        F.when(has('data-testid="photo"') | has("photo.jpg"), "photo")
        .when(has('data-testid="video"') | has("video.mp4"), "video")
        .when(has('data-testid="audio"') | has("audio.mp3"), "audio")
        .otherwise("text")
    )
    when = tx.parse_timestamp(_element(b, 'data-testid="messenger_timestamp"', 'class="_3-94 _2lem"'))
    return rows.select(
        id_col,
        "position",
        F.coalesce(_element(b, 'data-testid="messenger_username"', 'class="[^"]*actor', 'class="_3-96 _2pio _2lek _2lel"'), F.lit("Unknown")).alias("sender"),
        _element(b, 'data-testid="messenger_message_text"', 'class="_3-96 _2let"', 'class="[^"]*msg').alias("text"),
        when["ts"].alias("ts"),
        when["precision"].alias("timestamp_precision"),
        F.nullif(F.regexp_extract(b, r'data-thread-id="([^"]*)"', 1), F.lit("")).alias("thread_id"),
        kind.alias("message_type"),
        F.size(F.regexp_extract_all(b, F.lit('data-testid="reaction"'), F.lit(0))).alias("n_reactions"),
    ).where("text is not null")


def parse_html_messages(docs: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Texts of message-like divs; pages without any fall back to p/div/span blocks of more than ten characters."""
    html = F.col(html_col)
    strip = lambda parts: F.transform(parts, tx.strip_tags)
    divs = F.filter(
        strip(F.regexp_extract_all(html, F.lit(r'(?i)<div[^>]*class="[^"]*(?:message|msg|chat)[^"]*"[^>]*>([\s\S]*?)</div>'), F.lit(1))),
        lambda x: x != "",
    )
    blocks = F.filter(
        strip(F.regexp_extract_all(html, F.lit(r"(?i)<(?:p|div|span)[^>]*>([\s\S]*?)</(?:p|div|span)>"), F.lit(1))),
        lambda x: F.length(x) > 10,
    )
    from threadloom.functions.spans import let

    found = let(divs, lambda d: F.when(F.size(d) > 0, d).otherwise(blocks))
    return docs.select(id_col, F.posexplode(found).alias("position", "body"))


def _group_lines(lines: DataFrame, id_col: str, header: Column, joiner: str) -> DataFrame:
    """Attach continuation lines to the header line above them (lines before any header are dropped)."""
    flagged = lines.withColumn("__h", header.cast("int"))
    numbered = running_sums(flagged, [id_col], ["line_no"], F.floor(F.col("line_no") / 10_000), {"message_no": F.col("__h")})
    body = F.when(F.col("__h") == 1, F.col("body")).otherwise(F.trim("line"))
    kept = numbered.where((F.col("message_no") > 0) & ((F.col("__h") == 1) | (F.trim("line") != "")))
    pieces = F.array_sort(F.collect_list(F.struct("line_no", body.alias("t"))))
    head = lambda c: F.max(F.when(F.col("__h") == 1, F.col(c))).alias(c)
    return kept.groupBy(id_col, "message_no").agg(
        head("sender"), head("ts_text"), F.array_join(F.transform(pieces, lambda x: x["t"]), joiner).alias("text")
    )


def parse_transcript(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``Sender [time]: text`` or ``time - Sender: text``; other lines continue the message with a blank."""
    one = r"^(.+?)\s*\[(.+?)\]:\s*(.+)$"
    two = r"^(.+?)\s*-\s*(.+?):\s*(.+)$"
    lines = numbered_lines(docs, id_col, text_col)
    line = F.col("line")
    first, second = line.rlike(one), line.rlike(two)
    pick = lambda a, b: F.when(first, F.regexp_extract(line, one, a)).when(second, F.regexp_extract(line, two, b))
    lines = lines.withColumns(
        {"sender": F.trim(pick(1, 2)), "ts_text": F.trim(pick(2, 1)), "body": F.trim(pick(3, 3))}
    )
    out = _group_lines(lines, id_col, first | second, " ")
    when = tx.parse_timestamp(F.col("ts_text"))
    return out.withColumns(
        {"ts": when["ts"], "timestamp_precision": when["precision"], "is_from_me": F.lower("sender") == "me"}
    ).drop("ts_text")


def parse_log(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``[yyyy-MM-dd HH:mm:ss] Sender: text`` with continuation lines kept as lines."""
    shape = r"^\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\]\s*([^:]+):\s*(.*)$"
    lines = numbered_lines(docs, id_col, text_col)
    line = F.col("line")
    lines = lines.withColumns(
        {"sender": F.trim(F.regexp_extract(line, shape, 2)), "ts_text": F.regexp_extract(line, shape, 1), "body": F.regexp_extract(line, shape, 3)}
    )
    out = _group_lines(lines, id_col, line.rlike(shape), "\n")
    return out.withColumn("ts", F.try_to_timestamp("ts_text", F.lit("yyyy-MM-dd HH:mm:ss"))).drop("ts_text")


def parse_plain(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One message per non-blank line of a text."""
    lines = numbered_lines(docs, id_col, text_col)
    return lines.where(F.trim("line") != "").select(id_col, "line_no", F.trim("line").alias("body"))


def html_tables(docs: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, table_no, row_no, col_no, is_header, value) of every table cell."""
    cell = r"(?i)<(t[dh])[^>]*>([\s\S]*?)</t[dh]>"
    tables = docs.select(id_col, F.posexplode(F.regexp_extract_all(html_col, F.lit(r"(?i)<table[^>]*>([\s\S]*?)</table>"), F.lit(1))).alias("table_no", "t"))
    rows = tables.select(id_col, "table_no", F.posexplode(F.regexp_extract_all("t", F.lit(r"(?i)<tr[^>]*>([\s\S]*?)</tr>"), F.lit(1))).alias("row_no", "r"))
    cells = F.arrays_zip(
        F.regexp_extract_all("r", F.lit(cell), F.lit(1)).alias("tag"), F.regexp_extract_all("r", F.lit(cell), F.lit(2)).alias("value")
    )
    return rows.select(id_col, "table_no", "row_no", F.posexplode(cells).alias("col_no", "c")).select(
        id_col, "table_no", "row_no", "col_no", (F.lower("c.tag") == "th").alias("is_header"), tx.strip_tags(F.col("c.value")).alias("value")
    )


def html_extract(docs: DataFrame, tag: str, op: str = "text", attribute: str | None = None, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Text, inner HTML or one attribute of every element of a tag."""
    if op == "attr":
        found = F.regexp_extract_all(html_col, F.lit(rf'(?i)<{tag}\b[^>]*\b{attribute}="([^"]*)"'), F.lit(1))
    else:
        inner = F.regexp_extract_all(html_col, F.lit(rf"(?i)<{tag}(?:\s[^>]*)?>([\s\S]*?)</{tag}>"), F.lit(1))
        found = F.transform(inner, tx.strip_tags) if op == "text" else inner
    return docs.select(id_col, F.posexplode(found).alias("position", "value"))


def parse_xml(docs: DataFrame, schema: str, xml_col: str = "xml") -> DataFrame:
    return docs.withColumn("parsed", F.from_xml(F.col(xml_col), schema))


# --- registry --------------------------------------------------------------------------------

_READERS: dict[str, Callable[..., DataFrame]] = {
    "sms": read_sms_xml,
    "json": read_json_messages,
    "csv": read_delimited,
    "text": read_lines,
    "chatgpt": read_assistant_export,
}


def register_reader(platform: str, reader: Callable[..., DataFrame]) -> None:
    _READERS[platform] = reader


def reader_for(platform: str) -> Callable[..., DataFrame]:
    return _READERS[platform]


def platforms() -> list[str]:
    return sorted(_READERS)
