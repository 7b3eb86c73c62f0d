"""Lines of documents and stateless predicates on them, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import patterns as P

#: predicate -> (pattern that must match, pattern that mustn't)
PREDICATES: dict[str, tuple[str, str | None]] = {
    "l01_blank": (P.BLANK, None),
    "l02_atx_heading": (P.ATX, None),
    "l05_bullet": (P.BULLET, P.BREAK),
    "l06_decimal_ordered": (P.DECIMAL, None),
    "l08_example_marker": (P.java(P.EXAMPLE), None),
    "l10_empty_item": (rf"^{P.WS}*([-*+]|([0-9]+|#)[.)]|\(([0-9]+|#)\)){P.WS}*$", None),
    "l12_fence_prefix": (P.FENCE, None),
    "l13_fence_opener": (P.FENCE_OPEN, None),
    "l15_front_matter_delimiter": (P.FRONT_END, None),
    "l19_continuation": (P.CONTINUATION, None),
    "l21_table_line": (P.TABLE_ROW, None),
    "l21_grid_border": (P.GRID_BORDER, None),
    "l21_spaced_dashes": (P.DASHES_SPACED, None),
    "l21_full_dashes": (P.DASHES_FULL, None),
    "l22_pipe_delimiter": (rf"^[-|: \t]*(-[-|: \t]*\||\|[-|: \t]*-)[-|: \t]*$", None),
    "l23_headerless_header": (r"\|", rf"^{P.WS}*(\||>|#|[-*+] |`{{3,}}|~{{3,}})"),
    "l24_quote_line": (P.QUOTE, None),
    "l24_quote_opener": ("^ {0,3}>", None),
    "l25_setext_underline": (P.SETEXT, None),
    "l26_setext_text": ("[^ \t]", rf"^( {{4}}|{P.WS}*(>|\||#+( |$)|[-*+]( |$)|([0-9]+|#)[.)]( |$)|`{{3,}}|~{{3,}}))"),
    "l27_definition": (P.DEFINITION, None),
    "l28_title_line": (P.TITLE_LINE, None),
    "l29_thematic_break": (P.BREAK, None),
    "l31_initial_marker": (P.INITIAL, None),
    "l33_would_start_block": (rf"^{P.WS}*([-*+]( |$)|([0-9]+|#)[.)]( |$)|>|\||`{{3,}}|~{{3,}}|#{{1,6}}( |$)|<[!?/A-Za-z])", None),
}


def lines(docs: DataFrame, offsets: bool = False) -> DataFrame:
    """(doc_id, line_no, text[, start]): split on line feeds alone, carriage returns stripped; start in bytes needs one window by document."""
    body = F.regexp_replace("text", r"\n\z", "")
    parts = F.when(F.col("text") != "", F.split(body, "\n", -1))
    out = docs.select("doc_id", F.posexplode(parts).alias("i", "raw"))
    text = F.regexp_replace("raw", "\r+$", "").alias("text")
    no = (F.col("i") + 1).cast("int").alias("line_no")
    if not offsets:
        return out.select("doc_id", no, text)
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length("raw") + 1).over(w), F.lit(0)).cast("bigint").alias("start")
    return out.select("doc_id", no, text, start)


def matches(name: str, text: str = "text") -> Column:
    must, mustnt = PREDICATES[name]
    hit = F.col(text).rlike(must)
    return hit & ~F.col(text).rlike(mustnt) if mustnt else hit


def features(rows: DataFrame) -> DataFrame:
    """All predicates of every line in one projection."""
    return rows.select("*", *(matches(n).alias(n) for n in PREDICATES), fancy().alias("l09_fancy_marker"), doubtful().alias("l32_marker_doubt"), indent().alias("l03_indent"), roman().alias("l07_roman"), html_kind().alias("l17_html_kind"), html_closes().alias("l18_html_closes"))


def indent(text: str = "text") -> Column:
    """Display column of the first sign that isn't blank, tab stop 4."""
    lead = F.regexp_extract(text, "^([ \t]*)", 1)
    signs = F.filter(F.split(lead, ""), lambda c: c != "")
    return F.aggregate(signs, F.lit(0), lambda n, c: F.when(c == "\t", n + 4 - n % 4).otherwise(n + 1)).cast("int")


#: Kind of marker -> what it looks like, without what follows.
MARKERS = {"bullet": "[-*+]", "decimal": r"(?:\((?:[0-9]+|#)\)|(?:[0-9]+|#)[.)])", "example": r"(?:\(@[\w-]*\)|@[\w-]*[.)])", "fancy": r"(?:\([A-Za-z]+\)|[A-Za-z]+[.)])"}


def marker(text: str = "text") -> Column:
    """The marker that a line begins with, or null: a bullet, a number, an example's label, a letter or a numeral."""
    out = None
    for kind, p in MARKERS.items():
        m = F.regexp_extract(text, f"(?U)^[ \t]*({p})", 1)
        hit = m != ""
        if kind == "fancy":
            hit = hit & ((F.length(F.regexp_replace(m, "[().]", "")) == 1) | (F.coalesce(roman(text), F.lit(0)) > 0))
        out = F.when(hit, m) if out is None else out.when(hit, m)
    return out


def separator(text: str = "text") -> Column:
    """Columns of blanks between a line's marker and what follows, tab stop 4; 99 at the end of the line, null without any."""
    mark = marker(text)
    rest = F.expr(f"substring({text}, length(regexp_extract({text}, '^([ \t]*)', 1)) + 1)")
    blanks = F.regexp_extract(F.substring(rest, F.length(mark) + 1, F.length(rest)), "^([ \t]*)", 1)
    signs = F.filter(F.split(blanks, ""), lambda c: c != "")
    begin = indent(text) + F.length(mark)
    width = F.aggregate(signs, begin, lambda n, c: F.when(c == "\t", n + 4 - n % 4).otherwise(n + 1)) - begin
    return F.when(F.length(mark) + F.length(blanks) == F.length(rest), F.lit(99)).when(width > 0, width).cast("int")


def fancy(text: str = "text") -> Column:
    """Whether a line has a fancy marker: an example's, a letter or a numeral; a capital before a period that may be an initial needs two columns, and `p. 9` is a page."""
    mark, value = marker(text), F.coalesce(roman(text), F.lit(0))
    word = F.regexp_replace(mark, "[().]", "")
    need = F.when(mark.rlike(r"^[A-Z]+\.$") & ((F.length(word) == 1) | value.isin(1, 5, 10, 50, 100, 500, 1000)), 2).otherwise(1)
    kind = mark.rlike(r"^\(?(@|[A-Za-z])")
    return F.coalesce(kind & (separator(text) >= need) & ~F.col(text).rlike(r"^[ \t]*p\. [0-9]"), F.lit(False))


def doubtful(text: str = "text") -> Column:
    """Whether a marker may be none: an initial, a labelled example, a word that is a numeral beyond 30."""
    mark = marker(text)
    label = mark.rlike(r"^\(?@[^.)]")
    word = mark.rlike(r"^[a-z]{2,}[.)]$") & (roman(text) > 30)
    return F.coalesce(F.col(text).rlike(P.INITIAL), F.lit(False)) | (fancy(text) & F.coalesce(label | word, F.lit(False)))


def content_column(text: str = "text") -> Column:
    """Column where a listed item's content begins; a marker at the end of the line has one blank after it."""
    listed = F.col(text).rlike(P.BULLET) | F.col(text).rlike(P.DECIMAL) | fancy(text)
    sep = separator(text)
    return F.when(listed & sep.isNotNull(), indent(text) + F.length(marker(text)) + F.when(sep == 99, F.greatest(F.lit(1), _trailing(text))).otherwise(sep)).cast("int")


def _trailing(text: str) -> Column:
    """Columns of the blanks after a marker that ends its line."""
    begin = indent(text) + F.length(marker(text))
    signs = F.filter(F.split(F.regexp_extract(text, "([ \t]*)$", 1), ""), lambda c: c != "")
    return F.aggregate(signs, begin, lambda n, c: F.when(c == "\t", n + 4 - n % 4).otherwise(n + 1)) - begin


def roman(text: str = "text") -> Column:
    """Value of a loosely written roman numeral before a period or bracket, else null."""
    word = F.upper(F.regexp_extract(text, r"^[ \t]*\(?([MDCLXVI]+|[mdclxvi]+)[.)]", 1))
    each = lambda p: F.regexp_count(word, F.lit(p))
    value = 1000 * each("M") + 500 * each("D") + 100 * each("C") + 50 * each("L") + 10 * each("X") + 5 * each("V") + each("I")
    value = value - 200 * each("C[MD]") - 20 * each("X[CL]") - 2 * each("I[XV]")
    return F.when((word != "") & word.rlike(f"^{P.ROMAN_BODY}$"), value).cast("int")


def style(text: str = "text") -> Column:
    """Style of a list item's line: bullet, or kind, case and delimiter."""
    mark = marker(text)
    shape = F.when(mark.startswith("("), "()").otherwise(F.substring(mark, -1, 1))
    case = F.when(mark.rlike("[A-Z]"), "-upper").otherwise("-lower")
    kind = F.when(F.col(text).rlike(P.DECIMAL), "decimal").when(F.col(text).rlike(P.java(P.EXAMPLE)), "example").when(fancy(text), F.concat(F.when(roman(text) > 0, "roman").otherwise("alpha"), case))
    return F.when(matches("l05_bullet", text), "bullet").when(kind.isNotNull(), F.concat(kind, shape))


def line_class(text: str = "text", paragraph_open: bool = False) -> Column:
    """Class of a line; in an open paragraph an empty item and a fancy marker are text."""
    c = F.col(text)
    out = F.when(c.rlike(P.BLANK), "BLANK").when(c.rlike(P.FRONT_END), "FMATTER").when(c.rlike(P.FENCE_OPEN), "FENCE").when(c.rlike(P.ATX), "HEADING")
    if paragraph_open:
        out = out.when(matches("l10_empty_item", text), "TEXT")
    out = out.when(matches("l05_bullet", text), "BULLET").when(c.rlike(P.DECIMAL), "ORDERED")
    return (out if paragraph_open else out.when(fancy(text), "ORDERED")).otherwise("TEXT")


def html_kind(text: str = "text") -> Column:
    out = None
    for kind, p in P.HTML_KINDS.items():
        out = F.when(F.col(text).rlike(p), kind) if out is None else out.when(F.col(text).rlike(p), kind)
    return out


def html_closes(text: str = "text") -> Column:
    """Whether the line that opens a raw HTML block also ends it."""
    rest = F.regexp_replace(F.col(text), "^ *<", "")
    out = None
    for kind, p in P.HTML_ENDS.items():
        hit = (html_kind(text) == kind) & rest.rlike(p)
        out = hit if out is None else out | hit
    return F.coalesce(out, F.lit(False))


def hard_breaks(rows: DataFrame) -> DataFrame:
    """Lines that end in two or more spaces, with text on them and on the next line."""
    nxt = F.lead("text").over(Window.partitionBy("doc_id").orderBy("line_no"))
    return rows.withColumn("nxt", nxt).where(F.col("text").rlike("[^ \t] {2,}$") & F.col("nxt").rlike("[^ \t]")).drop("nxt")


def refusals(docs: DataFrame, longest_line: int = 8191, most_lines: int = 200_000) -> DataFrame:
    """(doc_id, reason) of documents that conformance mode refuses; the rest of the run goes on."""
    longest = F.array_max(F.transform(F.split("text", "\n", -1), lambda x: F.octet_length(x)))
    many = F.length(F.regexp_replace("text", "[^\n]", ""))
    reason = F.when(F.col("text").contains("\0"), "nul").when(longest > longest_line, "long-line").when(many > most_lines, "too-many-lines")
    return docs.select("doc_id", reason.alias("reason")).where("reason IS NOT NULL")
