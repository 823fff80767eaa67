"""Text functions as Column expressions.

Classes are spelled out instead of ``\\w``, ``\\s`` and ``\\d``, whose meaning differs between engines:
letters, numbers and underscore for words, Unicode white space, decimal digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

W, S, D = r"\p{L}\p{N}_", r" \t\n\x0B\f\r\x1c-\x1f\x85\p{Z}", r"\p{Nd}"

# The characters of S one by one.
SPACES = "".join(map(chr, (0x20, *range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

# The words that retrieval ignores.
STOPWORDS = (
    "a an and are as at be by did do does for from had has have how in is it its of on or that the their there this to was were "
    "what when where which who whom why will with"
).split()

# The patterns of headings, titles, notes and numbers.
PAGE_NUMBER = rf"(?i)^(?:page[{S}]*)?{D}+(?:[{S}]*(?:of|/)[{S}]*{D}+)?$"
HEADING = rf"^{D}+\.[{S}]+[^{S}]"
OCR_HEADING = rf"^{D}+\.[{S}]+[^{S}].{{0,80}}$"
TABLE_TITLE = rf"(?i)^Table[{S}]+{D}+(?![{W}])"
TABLE_NOTE = rf"(?i)^(?:Notes?|Footnotes?|Source)[{S}]*:"
YEAR = rf"^(?:19|20){D}{{2}}$"
NUMBER = rf"^[-+(]?[$€£]?[{S}]*[{D}.,]+[{S}]*%?\)?$"
DOLLAR_AS_S = rf"(?<![{W}$])S(?={D}{{1,3}}(?:,{D}{{3}})+(?:\.{D}+)?(?![{W}])|{D}+(?:\.{D}+)?(?:[MKB]|bn|m|k)(?![{W}]))"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    """Runs of Unicode white space as one space, ends stripped."""
    return strip(F.regexp_replace(c, rf"[{S}]+", " "))


def tokenize(c: Column) -> Column:
    """Lower-cased words without stop words (H1)."""
    words = F.regexp_extract_all(F.lower(c), F.lit(rf"[{W}]+"), F.lit(0))
    return F.filter(words, lambda x: ~x.isin(*STOPWORDS))


def approximate_tokens(c: Column) -> Column:
    """ceil(1.3 * pieces) + 2, a piece being a word or a single other visible character (H2)."""
    pieces = F.size(F.regexp_extract_all(c, F.lit(rf"[{W}]+|[^{W}{S}]"), F.lit(0)))
    return (F.ceil(F.lit(1.3) * pieces) + 2).cast("int")


def furniture_key(c: Column) -> Column:
    """Lower case, digit runs as #, white space collapsed (H4)."""
    return collapse(F.regexp_replace(F.lower(c), rf"{D}+", "#"))


def is_page_number(c: Column) -> Column:
    return strip(c).rlike(PAGE_NUMBER)


def is_heading(c: Column) -> Column:
    """One line that starts with a number and a dot (H6)."""
    t = strip(c)
    return ~t.contains("\n") & t.rlike(HEADING)


def is_numeric(c: Column) -> Column:
    return c.rlike(NUMBER) & c.rlike(D)


def clean_cell(c: Column) -> Column:
    return collapse(F.coalesce(c, F.lit("")))


def fix_currency(c: Column) -> Column:
    """The letter S right before an amount as a dollar sign."""
    return F.regexp_replace(c, DOLLAR_AS_S, r"\$")


def normalize_quote(c: Column) -> Column:
    """White space collapsed, curly quotes straight, outer quotes and an ellipsis at the end gone."""
    t = F.translate(collapse(c), "“”‘’", "\"\"''")
    t = F.regexp_replace(t, r"^[\"']+|[\"']+$", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\.\.\.\z", ""), r"…\z", "")
    return strip(t)


def contains_words(text: Column, quote: Column) -> Column:
    """The quote occurs in the text and is not cut out of a longer word or number."""
    literal = F.concat(F.lit("\\Q"), F.replace(quote, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.rlike(text, F.concat(F.lit(rf"(?<![{W}])"), literal, F.lit(rf"(?![{W}])")))


def cells(line: Column) -> Column:
    """The parts between | that are not blank."""
    return F.filter(F.transform(F.split(line, r"\|"), strip), lambda x: x != "")


def is_relevant(text: Column, groups: Column) -> Column:
    """Some group of phrases occurs completely."""
    return F.exists(groups, lambda g: F.forall(g, lambda p: F.contains(text, p)))


def detect_header(rows: Column, external: Column) -> Column:
    """struct(names, consumed) (H10): external names if all are filled, consuming no row; else the first
    of at least two rows if all its cells are filled and none is a number other than a year."""
    first = F.transform(F.get(rows, F.lit(0)), clean_cell)
    names = F.transform(external, clean_cell)
    outside = external.isNotNull() & (F.size(external) > 0) & F.forall(names, lambda x: x != "")
    inside = (F.size(rows) >= 2) & F.forall(first, lambda x: (x != "") & (~is_numeric(x) | x.rlike(YEAR)))
    return F.struct(F.when(outside, names).when(inside, first).alias("names"), F.when(~F.coalesce(outside, F.lit(False)) & inside, 1).otherwise(0).alias("consumed"))


def render_row(row: Column, names: Column) -> Column:
    """``Name: value | Name: value`` without blank cells; values alone where there is no name."""

    def cell(c: Column, i: Column) -> Column:
        value, name = clean_cell(c), F.coalesce(F.get(names, i), F.lit(""))
        return F.when(value == "", "").when(name == "", value).otherwise(F.concat(name, F.lit(": "), value))

    return F.array_join(F.filter(F.transform(row, cell), lambda x: x != ""), " | ")


def truncate(c: Column, most: int = 4000) -> Column:
    """At most so many characters, and a mark where some were cut."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("\n...[Content Truncated]"))).otherwise(c)


def review_reason(warning: Column, known: dict[str, str]) -> Column:
    """The plain reason of a warning: its key is the text before ':' and ' (', keys that begin with
    table_ share one reason, unknown ones are given as they are (H33)."""
    key = F.substring_index(F.substring_index(warning, ":", 1), " (", 1)
    key = F.when(key.startswith("table_"), "table").otherwise(key)
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), warning)


def short_id(c: Column) -> Column:
    """An id without what stands before its first colon."""
    return F.regexp_replace(c, "^[^:]*:", "")


def processing_message(status: Column, document_type: Column, ocr_pages: Column, reasons: Column) -> Column:
    """A sentence on how a file was processed (H34); reasons: "page n: why" in order, of which three are
    told (F8). Unknown statuses are given as they are."""
    n = ocr_pages.cast("string")
    # The sentences.
    ready = F.when(document_type == "scanned", F.concat(F.lit("Ready. Scanned document: read "), n, F.lit(" page(s) with OCR.")))
    ready = ready.when(document_type == "mixed", F.concat(F.lit("Ready. Mixed document: OCR used on "), n, F.lit(" page(s) with scanned content."))).otherwise("Ready.")
    told = F.array_join(F.slice(reasons, 1, 3), "; ")
    review = F.concat(F.lit("Not searchable: "), F.when(F.coalesce(told, F.lit("")) == "", "some pages could not be read").otherwise(told), F.lit("."))
    return F.when(status == "CHUNKED", ready).when(status == "NEEDS_REVIEW", review).when(status == "FAILED", "Processing failed; the file is not searchable.").otherwise(status)


def sse_event(kind: Column, data: Column) -> Column:
    """One server-sent event."""
    return F.concat(F.lit("event: "), kind, F.lit("\ndata: "), data, F.lit("\n\n"))
