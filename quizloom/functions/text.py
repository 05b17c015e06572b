"""Functions of texts and titles as column expressions. Java patterns: (?U) for letters beyond ASCII, (?iu) for their case."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the language rule: letters and words of Tajik, letters of Belarusian.
TAJIK_LETTERS = "ҷҳқғӯӣҶҲҚҒӮӢ"
TAJIK_WORDS = ("тоҷик", "тоҷикистон", "ҷумҳур", "забони", "тоҷикӣ", "давлат", "конститутсия")
BELARUSIAN_LETTERS = "ўЎ"
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹"

#: Fixed patterns of titles.
ROMAN = r"(?i)^[IVXLCDM]+$"
REAL_HEADING = r"(?iu)^(?:(?:раздел|глава|часть|статья|параграф)\s|конституция|преамбула|[ivxlcdm]+\.)"
ARTICLE_HEADING = r"(?iu)^(?:(?:статья|article|раздел|section|глава|chapter|часть|part|параграф|paragraph)\s*\d|[ivxlcdm]+\.)"
NUMBERED = r"^(?:\d+[.)]\s|\d+\.\d+[.)]\s|[а-яА-Я]\.\s)"
SUB_ITEM = r"^(?:\d+|[а-яА-Я])\)\s"
LETTER_ITEM = r"^[а-яА-Я]\)\s"
MAIN_ITEM = r"^(?:\d+|[а-яА-Я])\.\s"


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def blank_to_null(text: Column) -> Column:
    return F.when(strip(text) != "", text)


def strip_emphasis(text: Column) -> Column:
    """Without one pair of emphasis marks around the whole, and then without one around its beginning."""
    whole = r"^(\*\*\*|___|\*\*|__|\*|_)(.+)\1$"
    s = strip(text)
    s = F.when(s.rlike(whole), strip(F.regexp_extract(s, whole, 2))).otherwise(s)
    head = r"^(\*{1,3}|_{1,3})(.+?)\1(.*)$"
    return F.when(s.rlike(head), strip(F.concat_ws(" ", strip(F.regexp_extract(s, head, 2)), strip(F.regexp_extract(s, head, 3))))).otherwise(s)


def footnotes(text: Column) -> Column:
    """Runs of superscript digits as a note: ` (см.сноску 12)`."""
    return F.translate(F.regexp_replace(text, f"([{SUPERSCRIPTS}]+)", " (см.сноску $1)"), SUPERSCRIPTS, "0123456789")


def is_roman(text: Column) -> Column:
    return strip(text).rlike(ROMAN)


def is_real_heading(title: Column) -> Column:
    return strip(title).rlike(REAL_HEADING)


def is_article_heading(title: Column) -> Column:
    return strip(title).rlike(ARTICLE_HEADING)


def is_numbered(title: Column) -> Column:
    return strip(title).rlike(NUMBERED)


def is_sub_item(title: Column) -> Column:
    return strip(title).rlike(SUB_ITEM)


def is_main_item(title: Column) -> Column:
    return strip(title).rlike(MAIN_ITEM)


def is_paragraph(title: Column, content: Column, has_children: Column) -> Column:
    """Whether a node is a paragraph rather than a heading; the first rule that holds decides."""
    t = strip(F.coalesce(title, F.lit("")))
    return (
        F.when(has_children, False).when(t == "", True).when(t.rlike(REAL_HEADING), False).when(F.length(t) > 150, True)
        .when(t.rlike("[,;]$"), True).when(t.rlike(r"(?U)^\p{Ll}"), True).otherwise(False)
    )


def language(text: Column, otherwise: Column | None = None) -> Column:
    """The rule branch: Tajik by letters or words, Belarusian by letters, else what another detector says, else Russian."""
    tajik = text.rlike(f"[{TAJIK_LETTERS}]") | text.rlike("(?iu)" + "|".join(TAJIK_WORDS))
    other = F.lit("ru") if otherwise is None else F.coalesce(F.when(otherwise == "fa", "tg").when(otherwise.isin("ru", "be", "tg"), otherwise), F.lit("ru"))
    return F.when(tajik, "tg").when(text.rlike(f"[{BELARUSIAN_LETTERS}]"), "be").otherwise(other)


def clean(text: Column, patterns: list[str]) -> Column:
    """Without what the patterns match, one after the other; then blank lines at most one at a time, ends stripped."""
    for pattern in patterns:
        text = F.regexp_replace(text, pattern, "")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def salvage_json(raw: Column) -> Column:
    """The object within a model's answer: without fences, from the first to the last brace, without commas before an end."""
    body = F.regexp_extract(F.regexp_replace(raw, r"```(?:json)?", ""), r"(?s)\{.*\}", 0)
    return F.regexp_replace(body, r",\s*([}\]])", "$1")


def escape_braces(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))


def object_id(value: Column) -> Column:
    """An id that may be wrapped as {"$oid": ...}."""
    return F.coalesce(F.get_json_object(value, "$['$oid']"), value)


def day(stamp: Column) -> Column:
    return F.substring(stamp.cast("string"), 1, 10)


#: What a literal of Python is made of: strings in either quotes, words and numbers, brackets and separators, white space.
PYTHON_TOKEN = r"""'(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*"|[-+]?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?|[A-Za-z]+|[\[\]{}(),:]|\s+"""


def python_string(token: Column) -> Column:
    """A string's token in JSON: its own quotes bare, double quotes escaped, \\xNN as \\u00NN."""
    inner = F.substr(token, F.lit(2), F.length(token) - 2)
    parts = F.regexp_extract_all(inner, F.lit(r"(\\x[0-9A-Fa-f]{2}|\\.|[^\\])"), 1)
    mended = F.transform(parts, lambda c: F.when(c == "\\'", "'").when(c == '"', '\\"').when(c == "\t", "\\t").when(F.length(c) == 4, F.concat(F.lit("\\u00"), F.right(c, F.lit(2)))).otherwise(c))
    return F.concat(F.lit('"'), F.array_join(mended, ""), F.lit('"'))


def bound(value: Column, made: Callable[[Column], Column]) -> Column:
    """What is made of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), made)[0]


def literal_python(text: Column) -> Column:
    """JSON of a literal written in Python: quotes of either kind with all that may stand within, True, False and None, tuples, commas
    before an end. JSON stays as it is. NULL if it is neither."""
    words = {"True": "true", "False": "false", "None": "null", "(": "[", ")": "]", ",": "\x01"}

    def told(t: Column) -> Column:
        plain = F.coalesce(*[F.when(t == a, b) for a, b in words.items()], t)
        return F.when(F.left(t, F.lit(1)).isin("'", '"'), python_string(t)).when(t.rlike(r"^\s"), "").otherwise(plain)

    def made(text: Column) -> Column:
        joined = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"({PYTHON_TOKEN})"), 1), told), "")
        json = F.translate(F.regexp_replace(joined, "\x01([\\]}])", "$1"), "\x01", ",")
        rest = F.regexp_replace(text, PYTHON_TOKEN, "")
        return F.when(F.try_parse_json(text).isNotNull(), text).when(rest == "", bound(json, lambda j: F.when(F.try_parse_json(j).isNotNull(), j)))

    return bound(text, made)
