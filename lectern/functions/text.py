"""Cleaning functions over text columns; all are built-in expressions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

APOSTROPHES = "\u02bc\u2018\u2019"
DOUBLE_QUOTES = "\u201c\u201d\u201e\u201f\u00ab\u00bb"
FORMAT_CHARS = "[\ufeff\u2060-\u2069\u202a-\u202e\u200b-\u200f\u00ad]"
_FIVE, _THREE = "\u0001", "\u0002"

ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"


def _sub(text: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(text, pattern, to)


def straight_quotes(text: Column) -> Column:
    """Typographic apostrophes and double quotes as their ASCII forms."""
    return F.translate(text, APOSTROPHES + DOUBLE_QUOTES, "'" * len(APOSTROPHES) + '"' * len(DOUBLE_QUOTES))


def line_ends(text: Column) -> Column:
    """CRLF and CR as LF, without blanks before a line's end."""
    return _sub(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "[ \\t]+\\n", "\n")


def clamp_breaks(text: Column) -> Column:
    """Runs of five newlines or more become five, of three or four three; shorter ones stay."""
    marked = _sub(_sub(text, "\\n{5,}", _FIVE), "\\n{3,4}", _THREE)
    return F.replace(F.replace(marked, F.lit(_FIVE), F.lit("\n" * 5)), F.lit(_THREE), F.lit("\n" * 3))


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return _sub(text, "^\\s+|\\s+$", "")


def extracted(text: Column) -> Column:
    """Text of the extraction stage: separators, invisible characters, quotes, ellipses, breaks and blanks."""
    text = F.replace(F.replace(F.replace(text, F.lit("\u2028"), F.lit("\n")), F.lit("\u2029"), F.lit("\n\n")), F.lit("\u202f"), F.lit(" "))
    text = straight_quotes(_sub(text, FORMAT_CHARS, ""))
    text = clamp_breaks(line_ends(F.replace(text, F.lit("…"), F.lit("..."))))
    return strip(_sub(_sub(text, "[ \\t]{2,}", " "), "\\.(?:\\s*\\.){2,}", "..."))


def clean_file_text(text: Column) -> Column:
    """A clean chapter's text as it is read: apostrophes, line ends, blanks, one newline at the end."""
    text = F.translate(text, APOSTROPHES, "'" * len(APOSTROPHES))
    return F.concat(strip(_sub(line_ends(text), "[ \\t]{2,}", " ")), F.lit("\n"))


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def filled(lines: Column) -> Column:
    return F.filter(F.transform(lines, strip), lambda x: x != "")


def keeps_lines(lines: Column, full: Column | None = None) -> Column:
    """Whether a block's lines stay apart: one begins with a dash or bullet, or three or more are short on average."""
    if full is None:
        return let(filled(lines), lambda x: keeps_lines(lines, x))
    total = F.aggregate(full, F.lit(0), lambda n, x: n + F.length(x))
    listed = F.exists(lines, lambda x: F.regexp_like(x, F.lit("^\\s*[—–•*-]")))
    return (F.size(lines) > 1) & (listed | ((F.size(full) >= 3) & (total < F.size(full) * 60)))


def cleaned(text: Column, unwrap: bool = True) -> Column:
    """Text of the cleaning stage, whose paragraphs' lines are joined unless they are lists or verse."""
    text = clamp_breaks(line_ends(straight_quotes(text)))
    text = _sub(text, '(^|[\\s“("])\\[([A-Za-z])\\](?=[a-z])', "$1$2")
    text = _sub(text, "-\\n(?=\\w)", "-")
    if unwrap:
        wide = lambda b: F.when(F.length(b) >= 5, F.lit("\n" * 5)).when(F.length(b) >= 3, F.lit("\n" * 3)).otherwise(F.lit("\n\n"))

        def joined(lines: Column, full: Column) -> Column:
            return strip(_sub(F.when(keeps_lines(lines, full), F.array_join(full, "\n")).otherwise(F.array_join(full, " ")), "[ \\t]{2,}", " "))

        def block(x: Column) -> Column:
            # most blocks are one line, which needs no list
            one = strip(_sub(x, "[ \\t]{2,}", " "))
            return F.when(~F.contains(x, F.lit("\n")), one).otherwise(let(F.split(x, "\n", -1), lambda lines: let(filled(lines), lambda full: joined(lines, full))))

        def paragraphs(t: Column) -> Column:
            widths = F.concat(F.transform(F.regexp_extract_all(t, F.lit("\\n{2,}"), 0), wide), F.array(F.lit("")))
            return F.array_join(F.zip_with(F.transform(F.split(t, "\\n{2,}", -1), block), widths, lambda b, w: F.concat(b, w)), "")

        text = let(text, paragraphs)
    else:
        text = _sub(text, "[ \\t]{2,}", " ")
    return strip(clamp_breaks(_sub(text, "\\.[ \\t]*\\.[ \\t]*\\.", "...")))


def first_match(text: Column, patterns: list[str]) -> Column:
    """The first pattern in list order that is found in the text, or null."""
    return F.coalesce(*(F.when(F.regexp_like(text, F.lit(p)), F.lit(p)) for p in patterns))


def cut_section(text: Column, patterns: list[str]) -> tuple[Column, Column]:
    """The text up to the first pattern in list order, without white space at its end, and that pattern (or "")."""
    text_out, reason = text, F.lit("")
    for p in reversed(patterns):
        found = F.regexp_like(text, F.lit(p))
        head = F.element_at(F.split(text, p, 2), 1)
        text_out = F.when(found, _sub(head, "\\s+$", "")).otherwise(text_out)
        reason = F.when(found, F.lit(p)).otherwise(reason)
    return text_out, reason


def remove_all(text: Column, patterns: list[str]) -> tuple[Column, list[Column]]:
    """The text without what the patterns find, one after the other, and how often each was found."""
    counts = []
    for p in patterns:
        counts.append(F.regexp_count(text, F.lit(p)))
        text = _sub(text, p, "")
    return text, counts


def slug(text: Column, fallback: str = "chapter", most: int = 60) -> Column:
    """Lower-case ASCII words joined by hyphens; Latin-1 accents are dropped, other letters go."""
    ascii_ = _sub(F.translate(text, ACCENTED, PLAIN), "[^\\x00-\\x7f]", "")
    short = F.substring(_sub(_sub(F.lower(ascii_), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)
    return F.when(short == "", F.lit(fallback)).otherwise(short)


def href_base(href: Column) -> Column:
    """A link without its fragment, percent-decoded (a plus stays a plus)."""
    return F.try_url_decode(F.replace(F.substring_index(href, "#", 1), F.lit("+"), F.lit("%2B")))


def href_fragment(href: Column) -> Column:
    return F.when(F.contains(href, F.lit("#")), F.try_url_decode(F.replace(F.regexp_extract(href, "#(.*)$", 1), F.lit("+"), F.lit("%2B")))).otherwise("")


def series_key(href: Column) -> Column:
    """(prefix, ext) of a file that is one of a split series, or null."""
    pattern = "^(.+?)(?:_split_|-split-)[0-9]+([.][^./]+)$"
    return F.when(F.regexp_like(href, F.lit(pattern)), F.struct(F.regexp_extract(href, pattern, 1).alias("prefix"), F.regexp_extract(href, pattern, 2).alias("ext")))


NUMERIC_HEADING = "(?i)^[\\W_]*(?:\\d+|[ivxlcdm]+)[\\W_]*$"


def is_title_heading(text: Column) -> Column:
    """Whether a heading names something, rather than being a number."""
    one = strip(_sub(F.coalesce(text, F.lit("")), "\\s+", " "))
    return (one != "") & ~F.regexp_like(one, F.lit(NUMERIC_HEADING))


def title_of_text(text: Column, max_words: int = 10, max_chars: int = 80) -> Column:
    """A title from the first line that isn't a number, cut to `max_words`; "" if there is none."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda x: strip(_sub(x, "\\s+", " "))), is_title_heading)

    def titled(line: Column) -> Column:
        words = F.split(line, " ", -1)
        cut = (F.length(line) > max_chars) | (F.size(words) > max_words)
        short = F.when(cut, F.array_join(F.slice(words, 1, max_words), " ")).otherwise(line)
        short = strip(_sub(_sub(short, "^[ \"'`\\[\\](){}<>-]+|[ \"'`\\[\\](){}<>-]+$", ""), "[,:;.!?]+$", ""))
        return F.when(cut & is_title_heading(short) & ~F.endswith(short, F.lit("...")), F.concat(short, F.lit("..."))).otherwise(short)

    return F.coalesce(F.try_element_at(F.filter(F.transform(lines, titled), is_title_heading), F.lit(1)), F.lit(""))


def title_case_word(word: Column) -> Column:
    """Each part between hyphens and apostrophes with a capital and small letters."""
    parts = F.regexp_extract_all(word, F.lit("[-'’]|[^-'’]+"), 0)
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1_000_000)))), "")


def file_title(name: Column) -> Column:
    """A title from a file's name: no folder, suffix or leading number, blanks for _ and -."""
    stem = _sub(F.substring_index(name, "/", -1), "(?<=.)[.][^.]*$", "")
    bare = strip(F.translate(_sub(stem, "^[0-9]+[ _-]+", ""), "_-", "  "))
    return F.when(bare == "", stem).otherwise(bare)


def sort_title(title: Column, fallback: Column) -> Column:
    """The title as a library sorts it: lower case, without a leading article; the id if there is none."""
    bare = _sub(F.lower(strip(F.coalesce(title, F.lit("")))), "^(?:the|an|a) ", "")
    return F.when(bare == "", F.lower(fallback)).otherwise(bare)


def tag_value(text: Column) -> Column:
    """A metadata value with the signs of the marker format escaped."""
    for sign in ("\\", "\n", "=", ";", "#"):
        text = F.replace(text, F.lit(sign), F.lit("\\" + sign))
    return text
