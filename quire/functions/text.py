"""Column expressions over page text: normalisation, character classes, quality, page numbers, decisions.

All of them stay in the JVM. `None` in gives null out unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the text rules know it, and the character classes of the tokenizer.
_WIDE_SPACE = r"\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE = r"\t\n\x0b\x0c\r\x1c-\x1f " + _WIDE_SPACE
SPACE_BUT_NEWLINE = r"\t\x0b\x0c\r\x1c-\x1f " + _WIDE_SPACE
HIRAGANA, KATAKANA, KANJI = r"\x{3040}-\x{309f}", r"\x{30a0}-\x{30ff}\x{ff66}-\x{ff9d}", r"\x{4e00}-\x{9fff}"
DIGIT, LATIN = "0-9", "a-zA-Z"
JAPANESE = HIRAGANA + KATAKANA + KANJI
CLASSES = {"hiragana": HIRAGANA, "katakana": KATAKANA, "kanji": KANJI, "digit": DIGIT, "latin": LATIN}
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
REPLACEMENT = "\ufffd"
WIDE_DIGITS, NARROW_DIGITS = "０１２３４５６７８９", "0123456789"
DASHES = "-‐‑‒–—―－−"
#: str.splitlines() breaks at these; split("\n") doesn't.
LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def newlines(text: Column) -> Column:
    """CR LF and CR as LF."""
    return F.regexp_replace(text, r"\r\n?", "\n")


def normalize(text: Column) -> Column:
    """LF newlines, plain blanks for no-break and ideographic ones, no control characters, no blanks at line ends."""
    t = F.translate(newlines(text), "\u00a0\u3000", "  ")
    return F.regexp_replace(F.regexp_replace(t, CONTROL, ""), f"(?dm)[{SPACE_BUT_NEWLINE}]+$", "")


def compact(text: Column) -> Column:
    """Normalised text without any white space."""
    return F.regexp_replace(normalize(text), f"[{SPACE}]+", "")


def char_class(ch: Column) -> Column:
    """The class of a single character: hiragana, katakana, kanji, digit, latin, or symbol for anything else."""
    out = None
    for name, members in CLASSES.items():
        test = ch.rlike(f"^[{members}]$")
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("symbol")


def tokens(text: Column) -> Column:
    """Maximal runs of one character class; white space separates and is dropped."""
    runs = "|".join(f"[{m}]+" for m in CLASSES.values())
    others = "".join(CLASSES.values()) + SPACE
    return F.regexp_extract_all(text, F.lit(f"({runs}|[^{others}]+)"), F.lit(1))


def longest_run(text: Column) -> Column:
    """The length of the longest run of one character; 0 for the empty text."""
    runs = F.regexp_extract_all(text, F.lit(r"(?s)((.)\2+)"), F.lit(1))  # most characters stand alone: only longer runs become strings
    return F.coalesce(F.array_max(F.transform(runs, F.char_length)), F.least(F.lit(1), F.char_length(text)), F.lit(0))


def quality(text: Column) -> Column:
    """struct of counts, ratios and a score in [0, 1]: how much a text reads like text.

    Blanks and tabs are dropped before symbols and runs are counted; newlines count as symbols.
    """
    t = normalize(F.coalesce(text, F.lit("")))
    n = F.char_length(t)
    visible = F.char_length(F.regexp_replace(t, f"[{SPACE}]", ""))
    packed = F.regexp_replace(t, r"[ \t]+", "")
    symbols = F.char_length(F.regexp_replace(packed, "[" + "".join(CLASSES.values()) + "]", ""))
    size = F.greatest(F.lit(1), F.char_length(packed)).cast("double")
    whole = F.greatest(F.lit(1), n).cast("double")
    bad = (n - F.char_length(F.replace(t, F.lit(REPLACEMENT), F.lit("")))) / whole
    symbol, run = symbols / size, longest_run(packed) / size
    zero = F.lit(0.0)
    score = (
        F.least(F.lit(1.0), visible / 80.0)
        * F.greatest(zero, 1.0 - bad * 8.0)
        * F.greatest(zero, 1.0 - symbol * 2.0)
        * F.greatest(zero, 1.0 - F.greatest(zero, run - 0.1) * 3.0)
    )
    return F.struct(
        n.cast("bigint").alias("char_count"),
        visible.cast("bigint").alias("visible_char_count"),
        (visible / whole).alias("visible_ratio"),
        bad.alias("replacement_char_ratio"),
        symbol.alias("symbol_ratio"),
        run.alias("longest_repeat_ratio"),
        F.greatest(zero, F.least(F.lit(1.0), score)).alias("score"),
    )


def page_kind(has_text: Column, image_ratio: Column, likelihood: Column) -> Column:
    """image, table, mixed, text or empty, by the first rule that holds."""
    return (
        F.when(image_ratio >= 0.60, "image")
        .when(likelihood >= 0.65, "table")
        .when(has_text & (image_ratio > 0.10), "mixed")
        .when(has_text, "text")
        .when(image_ratio > 0.10, "image")
        .otherwise("empty")
    )


def lines(text: Column) -> Column:
    """The lines that str.splitlines() gives, without the empty one behind a last break."""
    parts = F.split(text, LINE_BREAK)
    return F.when(F.char_length(text) == 0, F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def filled_lines(text: Column) -> Column:
    """Stripped lines that aren't empty."""
    return F.filter(F.transform(lines(text), strip), lambda x: x != "")


def repeat_coverage(text: Column) -> Column:
    """The share of non-blank lines whose value comes at least twice."""
    # sorted, equal lines are neighbours: the second of a run adds two, every further one one; lines are made once, as the argument of one fold:
    # where lambdas were nested here, Spark left the Python functions of the plan around it unplanned
    begin = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("same"), F.lit(0).alias("n"))

    def step(s: Column, line: Column) -> Column:
        run = F.when(s["last"].eqNullSafe(line), s["run"] + 1).otherwise(1)
        return F.struct(line.alias("last"), run.alias("run"), (s["same"] + F.when(run == 1, 0).when(run == 2, 2).otherwise(1)).alias("same"), (s["n"] + 1).alias("n"))

    return F.aggregate(F.sort_array(filled_lines(text)), begin, step, lambda s: F.when(s["n"] == 0, 0.0).otherwise(s["same"] / s["n"].cast("double")))


def token_overlap(left: Column, right: Column) -> Column:
    """Distinct tokens that both have over those of the right."""
    a, b = F.array_distinct(tokens(normalize(left))), F.array_distinct(tokens(normalize(right)))
    return F.when(F.size(b) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(b).cast("double"))


def common_prefix(left: Column, right: Column) -> Column:
    """The number of characters that both begin with."""
    n = F.least(F.char_length(left), F.char_length(right))
    differ = F.array_position(F.zip_with(F.split(F.substring(left, F.lit(1), n), ""), F.split(F.substring(right, F.lit(1), n), ""), lambda x, y: x != y), True)
    return F.when(n == 0, 0).when(differ == 0, n).otherwise(differ - 1).cast("int")


def ascii_digits(text: Column) -> Column:
    """Full-width digits as ASCII ones."""
    return F.translate(text, WIDE_DIGITS, NARROW_DIGITS)


def ascii_int(text: Column) -> Column:
    """The number that a text of digits is, else null."""
    t = strip(ascii_digits(text))
    return F.when(t.rlike("^[0-9]+$"), t.try_cast("bigint"))


def is_page_number(text: Column, page_number: Column) -> Column:
    """Is a text just this page's number, with dashes or not?"""
    d = f"[{DASHES}]?"
    s = f"[{SPACE}]*"
    found = F.regexp_extract(strip(normalize(text)), f"^{s}{d}{s}([0-9{WIDE_DIGITS}]{{1,3}}){s}{d}{s}$", 1)
    return F.coalesce(ascii_int(found) == page_number, F.lit(False))


def without_page_number(text: Column, page_number: Column) -> Column:
    """Normalised text without this page's number in front of it; `01 | title` keeps it."""
    t = strip(normalize(text))
    pattern = f"(?s)^[{SPACE}]*([0-9{WIDE_DIGITS}]{{1,3}})[{SPACE}]+(.+)$"
    number, rest = ascii_int(F.regexp_extract(t, pattern, 1)), F.regexp_replace(F.regexp_extract(t, pattern, 2), f"^[{SPACE}]+", "")
    drop = (number == page_number) & ~rest.rlike("^[|｜]")
    return F.when(F.coalesce(drop, F.lit(False)), rest).otherwise(t)


def promoted_heading(text: Column, page_number: Column, overview: str = "事業概要", business: str = "事業") -> Column:
    """struct<heading, tail> of a text that is a section heading with a bar, else null.

    `NN | title`, or the overview word, a bar and a title; a note mark, or a long or punctuated rest behind a
    title that ends in the business word, is the tail.
    """
    t = without_page_number(text, page_number)
    w = f"[^{SPACE}]"
    section = f"(?s)^[{SPACE}]*([0-9{WIDE_DIGITS}]{{2}})[{SPACE}]*[|｜][{SPACE}]*({w}(?:.*{w})?)[{SPACE}]*$"
    over = f"(?s)^[{SPACE}]*{overview}[{SPACE}]*[|｜][{SPACE}]*({w}(?:.*{w})?)[{SPACE}]*$"
    title = strip(F.regexp_extract(t, over, 1))
    note = f"[{SPACE}]+(?=\\*[0-9{WIDE_DIGITS}]+|注[0-9{WIDE_DIGITS}]+)"
    head, tail = f"(?s)^(.*?)({note})(.+)$", f"(?s)^(.{{1,80}}?{business})[{SPACE}]+(.+)$"
    noted = title.rlike(f"(?s){note}")
    long_tail = strip(F.regexp_extract(title, tail, 2))
    split = (long_tail != "") & (long_tail.rlike("[。、]") | (F.char_length(long_tail) >= 24))
    own = F.when(noted, strip(F.regexp_extract(title, head, 1))).when(split, strip(F.regexp_extract(title, tail, 1))).otherwise(title)
    rest = F.when(noted, strip(F.regexp_extract(title, head, 3))).when(split, long_tail)
    rest = F.when(rest != "", rest)
    pair = lambda a, b: F.struct(a.alias("heading"), b.alias("tail"))
    none = F.lit(None).cast("string")
    barred = F.concat(F.regexp_extract(t, section, 1), F.lit(" | "), strip(F.regexp_extract(t, section, 2)))
    return F.when(t.rlike(section), pair(barred, none)).when(
        t.rlike(over) & (own != "") & ~((F.char_length(own) > 80) & rest.isNull()), pair(F.concat(F.lit(f"{overview}｜"), own), rest)
    )


def is_short_fragment(line: Column) -> Column:
    """At most 20 visible characters with a letter, and neither a bullet, a footnote, a number of 3 digits nor a piece of a br tag."""
    t = strip(normalize(line))
    low, c = F.lower(t), compact(t)
    return F.coalesce(
        (c != "")
        & (F.char_length(c) <= 20)
        & ~low.contains("br />")
        & ~low.contains("br/>")
        & ~low.endswith("<br")
        & ~t.rlike("^[*・\\-•※]")
        & ~t.rlike(f"[0-9{WIDE_DIGITS}]{{3,}}")
        & c.rlike(r"\p{L}|[" + JAPANESE + "]"),
        F.lit(False),
    )


def has_letter(text: Column) -> Column:
    return text.rlike(r"\p{L}|[" + JAPANESE + "]")


def has_japanese(text: Column) -> Column:
    return text.rlike("[" + JAPANESE + "]")


def is_contents_line(text: Column) -> Column:
    """One line with at least two `(n)` items and a leader of four dots."""
    t = strip(normalize(text))
    items = F.size(F.regexp_extract_all(t, F.lit(CONTENTS_ITEM), F.lit(0)))
    return ~t.rlike(r"[\n\r]") & (items >= 2) & t.rlike(r"(?:…|\.|．){4,}")


CONTENTS_ITEM = f"[（(][{SPACE}]*[0-9{WIDE_DIGITS}]+[{SPACE}]*[)）]"


def split_contents_line(text: Column) -> Column:
    """A contents line with a newline before each of its items; other texts as they are."""
    parted = strip(F.regexp_replace(strip(normalize(text)), CONTENTS_ITEM, "\n$0"))
    return F.when(is_contents_line(text) & parted.contains("\n"), parted).otherwise(text)


def close_japanese(text: Column) -> Column:
    """Without white space between Japanese characters, in texts of over 6 visible characters."""
    j = f"[{JAPANESE}]"
    return F.when(F.char_length(compact(text)) <= 6, text).otherwise(F.regexp_replace(text, f"(?<={j})[{SPACE}]+(?={j})", ""))


def is_data_line(line: Column, marks: str = "△▲") -> Column:
    """Does a line look like a table's row: a grouped number, a percent sign, a mark and a digit, or four numbers?"""
    return (
        line.rlike(r"[0-9]{1,3}(?:,[0-9]{3})+")
        | line.contains("%")
        | line.rlike(f"[{marks}][{SPACE}]*[0-9]")
        | (F.size(F.regexp_extract_all(line, F.lit("[0-9]+"), F.lit(0))) >= 4)
    )


def is_address(text: Column) -> Column:
    """Does a text look like a url or an e-mail address?"""
    t = F.lower(strip(text))
    return t.rlike(r"(?:https?://|hxxps?://|www\.)") | t.rlike(r"[^\s@]+@[^\s@]+\.[^\s@]+") | t.contains("://") | t.rlike(r"(?s)^[^@]*@.*\.")


def change_budget(length: Column, ratio: float) -> Column:
    """How many characters of a text of that length may change."""
    return F.when(length <= 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(length * ratio))).cast("bigint")


def clamp_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """A box in shares of the page, clamped to [0, 1]; a page without extent is an error."""
    good = (width > 0) & (height > 0)
    one = lambda v, d, n: F.when(good, F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / d))).otherwise(F.raise_error("a page's width and height are positive").cast("double")).alias(n)
    return F.struct(one(x0, width, "x0"), one(y0, height, "y0"), one(x1, width, "x1"), one(y1, height, "y1"))


def box_area(box: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, box["x1"] - box["x0"]) * F.greatest(zero, box["y1"] - box["y0"])


def box_contains(box: Column, x: Column, y: Column) -> Column:
    """Edges belong to a box."""
    return (x >= box["x0"]) & (x <= box["x1"]) & (y >= box["y0"]) & (y <= box["y1"])


def precedes(a: Column, b: Column) -> Column:
    """Is box a read before box b: above it in the same column, or left of it in the same band?"""
    least = F.lit(1e-6)

    def overlap(lo: str, hi: str) -> Column:
        both = F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
        return both / F.least(F.greatest(least, a[hi] - a[lo]), F.greatest(least, b[hi] - b[lo]))

    return ((overlap("x0", "x1") >= 0.15) & (a["y1"] <= b["y0"] + 0.005)) | ((overlap("y0", "y1") >= 0.15) & (a["x1"] <= b["x0"] + 0.005))


def heading_level(size: Column, page_size: Column) -> Column:
    """1 to 4 by how much larger a region's median font is than the page's; 1 where that is unknown."""
    ratio = size / F.greatest(F.lit(1e-6), page_size)
    return F.when(~(page_size > 0) | page_size.isNull() | size.isNull(), 1).when(ratio >= 1.60, 1).when(ratio >= 1.35, 2).when(ratio >= 1.20, 3).otherwise(4)


def safe_cell_change(before: Column, after: Column) -> Column:
    """A changed cell has no line break, and no bar that it hadn't."""
    return ~after.rlike(r"[\n\r]") & (~after.contains("|") | before.contains("|"))
