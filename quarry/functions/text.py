"""Text functions on columns: shortening, names, identifiers, citations, numbers in prose."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarry.functions.scalar import SPACE, strip


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def capped(text: Column, n: int, marker: str = "\n...[truncated]") -> Column:
    """The text, or its first n characters and a marker where it is longer."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit(marker))).otherwise(text)


@F.pandas_udf(StringType())
def ascii_fold(texts: pd.Series) -> pd.Series:
    """Compatibility decomposition without what is then not ASCII."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode(), na_action="ignore")


def author_string(names: Column) -> Column:
    """The first author's last word, "et al." if there are more; NULL without one."""
    first = words(F.coalesce(F.get(names, F.lit(0)), F.lit("")))
    last = F.coalesce(F.try_element_at(first, F.lit(-1)), F.lit("NULL"))
    return F.when(F.coalesce(F.size(names), F.lit(0)) <= 0, "NULL").when(F.size(names) == 1, last).otherwise(F.concat(last, F.lit(" et al.")))


def reference_string(key: Column, authors: Column, year: Column, citations: Column) -> Column:
    parts = [key.cast("string"), author_string(authors), year.cast("string")]
    return F.concat(F.lit("["), F.concat_ws(" | ", *parts), F.lit(" | Citations: "), citations.cast("string"), F.lit("]"))


def plain_dashes(text: Column) -> Column:
    """En and em dashes, with the space around them, as hyphens."""
    return F.regexp_replace(text, r"(?U)\s*[–—]\s*", "-")


def safe_name(text: Column) -> Column:
    """Everything but letters and numbers as underscores."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", "_")


def file_name(key: Column) -> Column:
    return F.concat(F.replace(key, F.lit("/"), F.lit("__")), F.lit(".json"))


def url_key_untracked(url: Column, prefix: str = "utm_") -> Column:
    """Host and path without scheme, fragment, closing slash and the query's tracking parameters."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    place = F.concat(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", ""))
    parameters = F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&")
    kept = F.filter(parameters, lambda p: p.rlike("=.") & ~F.startswith(F.lower(p), F.lit(prefix)))
    return F.concat(place, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


# What identifies a paper in a URL, and how it is written.
URL_LABELS = (
    (r"arxiv\.org/(?:abs|pdf|html|e-print)/([0-9]{4}\.[0-9]{4,5})", "arXiv:"),
    (r"aclanthology\.org/([0-9A-Za-z.\-]+?)(?:\.pdf|/|$)", "ACL Anthology "),
    (r"doi\.org/(10\.[^\s/]+/[^\s?#]+)", "doi:"),
    (r"(?:www\.)?ncbi\.nlm\.nih\.gov/pmc/articles/(PMC[0-9]+)", "PMC "),
)
PAPER_PAGE = r"semanticscholar\.org/(?:paper|reader)/(?:[^/]+/)?([0-9a-f]{40})"
PAPER_FILE = r"pdfs\.semanticscholar\.org/([0-9a-f]{4})/([0-9a-f]{36})"
PREPRINT = r"arxiv\.org/(?:abs|pdf|html)/([0-9]{4}\.[0-9]{4,5})"


def url_label(url: Column) -> Column:
    """The first recognised identifier of a URL, else an empty text."""
    out = F.lit("")
    for pattern, name in reversed(URL_LABELS):
        found = F.regexp_extract(url, pattern, 1)
        out = F.when(found != "", F.concat(F.lit(name), found)).otherwise(out)
    return out


def paper_ids(url: Column) -> Column:
    """A struct (arxiv, paper) of the identifiers in a URL; the paper's only where there is no preprint's."""
    arxiv = F.nullif(F.regexp_extract(url, PREPRINT, 1), F.lit(""))
    page = F.nullif(F.regexp_extract(url, PAPER_PAGE, 1), F.lit(""))
    file = F.nullif(F.concat(F.regexp_extract(url, PAPER_FILE, 1), F.regexp_extract(url, PAPER_FILE, 2)), F.lit(""))
    return F.struct(arxiv.alias("arxiv"), F.when(arxiv.isNull(), F.coalesce(page, file)).alias("paper"))


# Lists of page numbers behind the words "Web Page(s)", with ranges.
_NUMBER = r"\d+(?:\s*[-–—]\s*\d+)?"
PAGE_LIST = rf"(?i)Web Pages?\s+({_NUMBER}(?:(?:\s*(?:,|and|&|or))+\s*{_NUMBER})*)"
#: Pages between the ends of a range beyond which it is prose, and only its ends count.
WIDEST_RANGE = 20


def page_numbers(text: Column) -> Column:
    """The pages that a text refers back to, ranges expanded, in ascending order."""

    def expanded(piece: Column) -> Column:
        ends = F.transform(F.regexp_extract_all(piece, F.lit(r"(\d+)"), 1), lambda n: n.cast("int"))
        low, high = F.get(ends, F.lit(0)), F.get(ends, F.lit(1))
        wide = F.when((high > low) & (high - low <= WIDEST_RANGE), F.sequence(low, F.greatest(low, F.coalesce(high, low)))).otherwise(ends)
        return F.when(high.isNull(), ends).otherwise(wide)

    lists = F.regexp_extract_all(text, F.lit(PAGE_LIST), 1)
    pieces = F.flatten(F.transform(lists, lambda one: F.regexp_extract_all(one, F.lit(f"({_NUMBER})"), 1)))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(pieces, expanded))))


def first_json(text: Column) -> Column:
    """The text of the first JSON object, in a fence or from the first to the last brace; null if there is none."""
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    return F.coalesce(fenced, F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")))


def first_array(text: Column) -> Column:
    """The text from the first to the last square bracket; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\[.*\])", 1), F.lit(""))


def score_in_text(text: Column, default: int = 5) -> Column:
    """The first whole number from 1 to 10 in a text."""
    found = F.regexp_extract(text, r"\b([1-9]|10)\b", 1)
    return F.coalesce(F.nullif(found, F.lit("")).cast("int"), F.lit(default))


def clamp(x: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def numbered(items: Column) -> Column:
    """An array as lines 1. and so on."""
    return F.array_join(F.transform(items, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n")


def rendered_shots(shots: Column, question: str, fields: tuple[str, ...]) -> Column:
    """Worked examples as a prompt shows them: the seed question, then a JSON object of the fields that hold text, a line each."""
    def block(s: Column) -> Column:
        quoted = {f: F.to_json(F.array(s[f])) for f in fields}
        lines = [F.when(F.coalesce(s[f], F.lit("")) != "", F.concat(F.lit(f'"{f}": '), F.substr(quoted[f], F.lit(2), F.length(quoted[f]) - 2))) for f in fields]
        held = F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), ",\n")
        body = F.when(held == "", "{}").otherwise(F.concat(F.lit("{\n"), held, F.lit("\n}")))
        return F.concat(F.lit("Seed Question: "), strip(F.coalesce(s[question], F.lit(""))), F.lit("\n"), body)

    return F.array_join(F.transform(shots, block), "\n\n")


def filled(template: Column, sentinel: str, value: Column) -> Column:
    """The template with every sentinel replaced; one without it stays as it is."""
    return F.replace(template, F.lit(sentinel), value)


def listed(items: Column) -> Column:
    """An array as a phrase: commas, and before the last "and"."""
    n = F.size(items)
    head = F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n <= 1, F.array_join(items, "")).otherwise(F.concat(head, F.lit(" and "), F.element_at(items, -1)))


def elapsed(seconds: Column) -> Column:
    """Under a minute as x.xs, else minutes and seconds, with hours if any."""
    s = F.rint(seconds).cast("bigint")
    h, m = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60)
    long = F.format_string("%dm %ds", m, F.pmod(s, F.lit(60)))
    return F.when(s < 60, F.format_string("%.1fs", seconds)).otherwise(F.when(h > 0, F.concat(F.format_string("%dh ", h), long)).otherwise(long))


def date_range(year_filter: Column, max_date: Column) -> Column:
    """A year filter a-b, its ends compared as texts, cut at a latest date: start:end."""
    latest = F.substring_index(max_date, "-", 1)
    start, end = F.substring_index(year_filter, "-", 1), F.regexp_extract(year_filter, r"^[^-]*-(.*)$", 1)
    start = F.when(start == "", "").otherwise(F.least(start, latest))
    end = F.when((end != "") & (end < latest), end).otherwise(max_date)
    return F.when(F.coalesce(year_filter, F.lit("")) == "", F.concat(F.lit(":"), max_date)).otherwise(F.concat_ws(":", start, end))


#: Fixed value: model names that one provider serves; all others go to the other.
_OPENAI = r"(?i)^(gpt|o[1-9](-|$)|chatgpt|davinci|babbage)"


def provider(model: Column, override: Column | None = None) -> Column:
    by_name = F.when(F.coalesce(model, F.lit("")).rlike(_OPENAI), "openai").otherwise("anthropic")
    return by_name if override is None else F.when(override.isNotNull() & (override != "auto"), override).otherwise(by_name)


#: What a fetched page says that was not reached, looked for in its first characters.
_NOT_FETCHED = (
    r"(?i)captcha|complete the check|security check required|just a moment|checking your browser|cloudflare|"
    r"verify you are human|access denied|403 forbidden|not authorized|permission denied|could not be accessed|"
    r"not directly accessible|unable to (?:access|retrieve)|requires user interaction|failed to (?:fetch|load)|"
    r"error (?:fetching|loading)|no HTML elements|content is empty|no (?:useful|relevant) information"
)
FETCH_WINDOW, LEAST_EVIDENCE = 400, 200


def fetch_failed(evidence: Column) -> Column:
    return (F.length(evidence) < LEAST_EVIDENCE) | F.left(evidence, F.lit(FETCH_WINDOW)).rlike(_NOT_FETCHED)


def unusable_title(title: Column) -> Column:
    return F.trim(title).rlike(r"(?i)^https?://|^microsoft word\b|^[\w.\-]+\.pdf$|^untitled")
