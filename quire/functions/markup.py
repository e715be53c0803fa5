"""Column expressions over markdown and HTML strings, file names and model responses."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import SPACE, SPACE_BUT_NEWLINE, newlines, normalize, strip

TABLE_OPEN, TABLE_CLOSE = r"(?i)<\s*table\b", r"(?i)</\s*table\s*>"
ESCAPED_OPEN, ESCAPED_CLOSE = r"(?i)&lt;\s*table\b", r"(?i)&lt;\s*/\s*table\s*&gt;"
TABLE_TAGS = ("table", "thead", "tbody", "tr", "th", "td")
#: What a model writes about a page image instead of its text.
NOTE_HINTS = (
    "image contains", "image shows", "placeholder", "actual image", "replace it with", "cannot be represented in markdown",
    "cannot be rendered in markdown", "text content has been fully extracted", "for illustrative purposes", "actual image url",
    "base64", "visual styling element", "fictional", "this transcription is", "no additional text or structured data",
)
ALIGNMENTS = {"none": "---", "left": ":---", "right": "---:", "center": ":---:"}


def _count(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def unescape_basic(text: Column) -> Column:
    """The five basic entities as characters, each ampersand last."""
    for name, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(ch))
    return text


def escape(text: Column) -> Column:
    """& < > " ' as entities, the ampersand first."""
    for ch, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(ch), F.lit(name))
    return text


def escape_with_breaks(text: Column) -> Column:
    return F.replace(escape(text), F.lit("\n"), F.lit("<br />\n"))


def opens_table(text: Column) -> Column:
    return text.rlike(TABLE_OPEN) | text.rlike(ESCAPED_OPEN)


def closes_table(text: Column) -> Column:
    return text.rlike(TABLE_CLOSE) | text.rlike(ESCAPED_CLOSE)


def has_table(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return low.contains("<table") | low.contains("&lt;table")


def has_open_table(text: Column) -> Column:
    """More tables begin than end, entities read as characters."""
    t = unescape_basic(F.coalesce(text, F.lit("")))
    return _count(t, TABLE_OPEN) > _count(t, TABLE_CLOSE)


def heading(line: Column) -> Column:
    """struct<level, text> of a markdown heading line, else null."""
    pattern = f"^[{SPACE}]{{0,3}}(#{{1,6}})[{SPACE}]+(.+?)[{SPACE}]*$"
    text = strip(F.regexp_extract(line, pattern, 2))
    return F.when(line.rlike(pattern) & (text != ""), F.struct(F.char_length(F.regexp_extract(line, pattern, 1)).alias("level"), text.alias("text")))


def is_note(line: Column) -> Column:
    """A remark of the model about the image rather than text of the page."""
    t = strip(F.regexp_replace(strip(line), r"^\*+|\*+$", ""))
    low = F.lower(t)
    hinted = low.contains("image")
    for h in NOTE_HINTS:
        hinted = hinted | low.contains(h)
    return t.rlike(r"(?i)^\*?\s*this transcription\s+is\b") | (t.rlike(r"(?i)^\*?\s*note\s*:\s*") & hinted)


def without_tags(line: Column) -> Column:
    """A line without tags and comments, br as a newline; a line with a table tag stays."""
    low = F.lower(line)
    hinted = F.lit(False)
    for tag in TABLE_TAGS:
        hinted = hinted | low.contains(f"<{tag}") | low.contains(f"</{tag}")
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(line, r"(?i)<\s*br\s*/?\s*>", "\n"), "<!--.*?-->", ""), "</?[a-zA-Z][^>]*>", "")
    return F.when(hinted | ~line.contains("<") | ~line.contains(">"), line).otherwise(bare)


def is_broken_tag(line: Column) -> Column:
    """Begins a tag that isn't a table's and doesn't end."""
    t = strip(line)
    name = F.lower(F.regexp_extract(t, r"^</?\s*([a-zA-Z][a-zA-Z0-9:-]*)\b", 1))
    return t.startswith("<") & ~t.contains(">") & (name != "") & ~name.isin(*TABLE_TAGS)


def is_rule(line: Column) -> Column:
    """A markdown horizontal rule."""
    return strip(line).rlike(r"^(?:-{3,}|\*{3,}|_{3,})$")


def is_tail_candidate(line: Column) -> Column:
    t = strip(line)
    return (t != "") & (F.char_length(t) <= 48)


def compact_blank_lines(text: Column) -> Column:
    """Lines without blanks at their ends, one empty line for several, none at the ends."""
    t = F.regexp_replace(text, f"(?dm)[{SPACE_BUT_NEWLINE}]+$", "")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def lone_table_tags(text: Column) -> Column:
    """Is every line of a paragraph a single table tag?"""
    own = F.filter(F.transform(F.split(unescape_basic(unescape_basic(text)), "\n"), strip), lambda x: x != "")
    tag = r"(?i)^</?\s*(?:table|thead|tbody|tr|th|td)\b[^>]*>$"
    return opens_table(text) & (F.size(own) > 0) & F.forall(own, lambda x: x.rlike(tag))


# Pipe tables


def pipe_cells(line: Column) -> Column:
    """The cells of a pipe row, null if the line has no bar. A backslash before a bar keeps it in its cell."""
    t = strip(line)
    parts = F.split(t, r"(?<!\\)\|")
    parts = F.when(t.startswith("|"), F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.size(parts) - 1))).otherwise(parts)
    ends = t.rlike(r"(?<!\\)\|$") & (F.size(parts) > 0)
    parts = F.when(ends, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    cells = F.transform(parts, lambda c: F.replace(strip(c), F.lit("\\|"), F.lit("|")))
    return F.when(t.contains("|") & (F.size(cells) > 0), cells)


def alignments(line: Column) -> Column:
    """The alignments of a separator row, else null."""
    cells = F.transform(pipe_cells(line), lambda c: F.replace(c, F.lit(" "), F.lit("")))
    kind = lambda c: F.when(c.startswith(":") & c.endswith(":"), "center").when(c.startswith(":"), "left").when(c.endswith(":"), "right").otherwise("none")
    return F.when(F.forall(cells, lambda c: c.rlike("^:?-{3,}:?$")), F.transform(cells, kind))


def escape_cell(text: Column) -> Column:
    """A cell's text for a pipe table: br for newlines, a backslash before a bar that has none (or an even number)."""
    return F.regexp_replace(F.replace(newlines(text), F.lit("\n"), F.lit("<br>")), r"(?<!\\)((?:\\\\)*)\|", r"$1\\|")


def pipe_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, escape_cell), " | "), F.lit(" |"))


def separator(align: Column) -> Column:
    out = None
    for name, mark in ALIGNMENTS.items():
        out = F.when(align == name, mark) if out is None else out.when(align == name, mark)
    return out.otherwise(ALIGNMENTS["none"])


def pipe_table(header: Column, align: Column, rows: Column) -> Column:
    """A table's lines. Rows and alignments have as many cells as the header, else it is an error."""
    fits = (F.size(align) == F.size(header)) & F.forall(rows, lambda r: F.size(r) == F.size(header))
    made = F.array_join(F.concat(F.array(pipe_row(header), pipe_row(F.transform(align, separator))), F.transform(rows, pipe_row)), "\n")
    return F.when(fits, made).otherwise(F.raise_error("the rows of a table have as many cells as its header"))


def table_html(grid: Column) -> Column:
    """A grid as HTML: the first row is the head, shorter rows are filled up."""
    width = F.array_max(F.transform(grid, F.size))
    filled = F.transform(grid, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    tags = lambda r, tag: F.array_join(F.transform(r, lambda c: F.concat(F.lit(f"<{tag}>"), escape_with_breaks(c), F.lit(f"</{tag}>"))), "\n")
    body = F.transform(F.slice(filled, F.lit(2), F.greatest(F.lit(0), F.size(filled) - 1)), lambda r: F.concat(F.lit("<tr>\n"), tags(r, "td"), F.lit("\n</tr>\n")))
    head = F.concat(F.lit('<table data-kind="table">\n<thead>\n<tr>\n'), tags(filled[0], "th"), F.lit("\n</tr>\n</thead>\n<tbody>\n"))
    return F.when((F.size(grid) > 0) & (width > 0), F.concat(head, F.array_join(body, ""), F.lit("</tbody></table>"))).otherwise('<pre data-kind="table"></pre>')


def block_html(kind: Column, level: Column, text: Column, table: Column) -> Column:
    """One block as HTML; table: the HTML of a table block's grid, null without one."""
    t = escape_with_breaks(text)
    n = F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(level, F.lit(1)))).cast("string")
    return (
        F.when(kind == "heading", F.concat(F.lit("<h"), n, F.lit(">"), t, F.lit("</h"), n, F.lit(">")))
        .when((kind == "table") & table.isNotNull(), table)
        .when(kind == "table", F.concat(F.lit('<pre data-kind="table">'), t, F.lit("</pre>")))
        .when(kind == "figure", F.concat(F.lit("<figure><figcaption>"), t, F.lit("</figcaption></figure>")))
        .otherwise(F.concat(F.lit("<p>"), t, F.lit("</p>")))
    )


def document_html(fragment: Column, title: Column) -> Column:
    """A whole HTML document around a fragment."""
    head = ["<!doctype html>", '<html lang="en">', "  <head>", '    <meta charset="utf-8" />', '    <meta name="viewport" content="width=device-width, initial-scale=1" />']
    return F.concat(F.lit("\n".join(head) + "\n    <title>"), escape(title), F.lit("</title>\n  </head>\n  <body>\n"), fragment, F.lit("\n  </body>\n</html>"))


# Model responses and base64


def without_data_url(value: Column) -> Column:
    """Without the `data:...,` in front."""
    return F.regexp_replace(strip(value), "(?is)^data:[^,]*,", "")


def strict_base64(value: Column) -> Column:
    """Base64 without white space; an error if it is empty or can't be decoded."""
    t = F.regexp_replace(without_data_url(value), f"[{SPACE}]+", "")
    good = (t != "") & F.try_to_binary(t, F.lit("base64")).isNotNull()
    return F.when(good, t).otherwise(F.raise_error("not base64"))


def tolerant_base64(value: Column) -> Column:
    """The bytes of base64, empty ones if it can't be decoded."""
    t = F.regexp_replace(without_data_url(F.coalesce(value, F.lit(""))), f"[{SPACE}]+", "")
    return F.coalesce(F.try_to_binary(t, F.lit("base64")), F.lit(b""))


def response_text(body: Column) -> Column:
    """The text of a chat completion: the first choice's content, a string or a list of parts with text; an error without one."""
    content = F.get_json_object(body, "$.choices[0].message.content")
    parts = F.from_json(content, "array<struct<text:string>>", {"mode": "PERMISSIVE"})
    joined = F.array_join(F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t.isNotNull()), "")
    text = F.when(content.rlike(r"^\s*\[\s*\{"), joined).otherwise(content)
    return F.when(text.isNotNull() & (text != ""), newlines(text)).otherwise(F.raise_error("a response without text"))


# File names


def safe_stem(name: Column) -> Column:
    """An upload's name without folder, quotes, line breaks and its last suffix; `download` if nothing is left."""
    base = F.regexp_replace(F.substring_index(F.replace(F.coalesce(name, F.lit("")), F.lit("\\"), F.lit("/")), "/", -1), '[\r\n"]', "")
    stem = strip(F.when(base.rlike(r"^.+\.[^.]*$") & ~base.rlike(r"^\.+[^.]*$"), F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base))
    return F.when(stem == "", "download").otherwise(stem)


def ascii_stem(name: Column) -> Column:
    """safe_stem with an underscore for each run of other characters than letters, digits, dot, underscore and hyphen."""
    stem = F.regexp_replace(F.regexp_replace(safe_stem(name), "[^A-Za-z0-9._-]+", "_"), "^[._-]+|[._-]+$", "")
    return F.when(stem == "", "download").otherwise(stem)


def download_name(name: Column, suffix: str) -> Column:
    return F.concat(safe_stem(name), F.lit(f".{suffix}"))


def disposition(name: Column, suffix: str) -> Column:
    """A Content-Disposition header; names beyond ASCII come in both forms."""
    full, plain = download_name(name, suffix), F.concat(ascii_stem(name), F.lit(f".{suffix}"))
    coded = F.replace(F.url_encode(full), F.lit("+"), F.lit("%20"))
    simple = full.rlike(r"^[\x00-\x7f]*$")
    return F.when(simple, F.concat(F.lit('attachment; filename="'), full, F.lit('"'))).otherwise(
        F.concat(F.lit('attachment; filename="'), plain, F.lit("\"; filename*=UTF-8''"), coded)
    )


def upload_reason(name: Column, content: Column, most_bytes: int, busy: Column) -> Column:
    """Why an upload isn't taken: 409 busy, 400 empty or not a PDF, 413 too large; null if it is."""
    head = F.regexp_replace(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), r"^[\t\n\x0b\x0c\r ]+", "")
    return (
        F.when(busy, 409)
        .when(content.isNull() | (F.octet_length(content) == 0), 400)
        .when(F.octet_length(content) > most_bytes, 413)
        .when(~head.startswith("%PDF"), 400)
    )


def replace_terms(text: Column, terms: Iterable[tuple[str, str]]) -> Column:
    """Fixed replacements, in order."""
    for wrong, right in terms:
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return text


def normalized_lines(text: Column) -> Column:
    """Normalised, stripped, non-empty lines of a text split at newlines."""
    return F.filter(F.transform(F.split(newlines(text), "\n"), lambda x: strip(normalize(x))), lambda x: x != "")


def _last_part(name: Column) -> Column:
    """A path's last part, without line breaks."""
    return F.substring_index(F.regexp_replace(F.regexp_replace(name, r"[\r\n]", ""), "/+$", ""), "/", -1)


def disposition_name(header: Column) -> Column:
    """The file name of a Content-Disposition header, the coded form first; null without one."""
    coded = F.regexp_extract(header, r"(?i)filename\*\s*=\s*UTF-8''([^;\s]+)", 1)
    plain = F.regexp_extract(header, r'(?i)filename\s*=\s*"([^"]*)"', 1)
    return F.when(coded != "", _last_part(F.try_url_decode(F.replace(coded, F.lit("+"), F.lit("%2B"))))).when(plain != "", _last_part(plain))


def saved_name(name: Column, fallback: str, suffix: str | None = None) -> Column:
    """A name to save a file by: the last part, or fallback without one, with the suffix if one is asked for."""
    own = _last_part(strip(F.coalesce(name, F.lit(""))))
    own = F.when(own == "", _last_part(F.lit(fallback))).otherwise(own)
    if not suffix or not suffix.strip().lstrip("."):
        return own
    end = "." + suffix.strip().lstrip(".").lower()
    stem = F.when(own.rlike(r"^.+\.[^.]+$"), F.regexp_replace(own, r"\.[^.]+$", "")).otherwise(own)
    return F.when(F.lower(own).endswith(end), own).otherwise(F.concat(stem, F.lit(end)))


def numbered_names(rows: DataFrame, folder: str = "folder", name: str = "name", into: str = "unique_name", order: Sequence[str] = ()) -> DataFrame:
    """rows with names that differ within their folder: the second of a name is `stem (1).suffix`, and so on.

    The first is the least by the columns `order`, by default all: a run that is repeated numbers them as before, and rows that tie are equal.
    """
    place = F.row_number().over(Window.partitionBy(folder, name).orderBy(*(order or rows.columns))) - 1
    stem, end = F.regexp_replace(name, r"(?<=.)\.[^.]+$", ""), F.regexp_extract(name, r"(?<=.)(\.[^.]+)$", 1)
    number = F.concat(stem, F.lit(" ("), F.col("_place").cast("string"), F.lit(")"), end)
    return rows.withColumn("_place", place).withColumn(into, F.when(F.col("_place") == 0, F.col(name)).otherwise(number)).drop("_place")
