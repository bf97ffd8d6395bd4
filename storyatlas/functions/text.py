"""Text rules, all as JVM expressions.

Python's notion of white space and word characters is spelled out as Unicode
classes, as Java's short classes are of ASCII only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"
#: What is neither a letter, a number, an underscore nor white space.
NOT_WORD = r"(?U)[^\p{L}\p{N}_\s]"
SALUTATION = r"dear\s+diary"
# fixed values: names in capitals that a heading keeps
ACRONYMS = [
    "MTA", "NYC", "NY", "NJ", "NYPD", "FDNY", "EMS", "LIRR", "JFK", "LGA", "NYU", "CUNY", "PATH", "MoMA", "SoHo",
    "NoHo", "NoMad", "DUMBO", "FiDi", "TriBeCa",
]
DASHES = r"(?U)^[\s—–\-]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` has it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip_chars(c: Column | str, chars: str) -> Column:
    """Drop any of ``chars`` from both ends."""
    return F.btrim(_col(c), F.lit(chars))


def collapse(c: Column | str) -> Column:
    """Runs of white space as one blank, ends trimmed."""
    return F.trim(F.regexp_replace(_col(c), SPACE, " "))


def name_key(c: Column | str) -> Column:
    """Match key: lower case, punctuation as blanks, collapsed."""
    return collapse(F.regexp_replace(F.lower(_col(c)), NOT_WORD, " "))


def empty_to_null(c: Column | str) -> Column:
    return F.nullif(_col(c), F.lit(""))


def first_item(items: Column | str) -> Column:
    """First element, NULL for NULL or empty arrays."""
    return F.try_element_at(_col(items), F.lit(1))


def join_items(items: Column | str) -> Column:
    """Elements joined by "; ", NULL if there are none."""
    return F.when(F.size(_col(items)) > 0, F.array_join(_col(items), "; "))


def content_id(*parts: Column | str) -> Column:
    """Stable id of an entry's content: NULL and empty parts are alike."""
    joined = F.concat_ws("\u001f", *[F.coalesce(_col(p), F.lit("")) for p in parts])
    return F.concat(F.lit("e"), F.substring(F.sha1(joined.cast("binary")), 1, 16))


def guid(uri: Column | str, url: Column | str) -> Column:
    """What follows the last slash of ``uri``, else ``url`` with runs of other characters as hyphens."""
    slug = strip_chars(F.regexp_replace(F.coalesce(_col(url), F.lit("")), "[^A-Za-z0-9]+", "-"), "-")
    last = F.element_at(F.split(_col(uri), "/"), -1)
    return F.when(F.coalesce(last, F.lit("")) != "", last).otherwise(slug)


def year_of(date: Column | str) -> Column:
    """Leading four digits as a year, else NULL."""
    head = F.substring(_col(date), 1, 4)
    return F.when(head.rlike("^[0-9]{4}$"), head.cast("int"))


def byline(c: Column | str) -> Column:
    """A byline without its leading "By "; NULL if nothing is left."""
    return empty_to_null(F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), "^By ", "")))


def strip_dashes(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), DASHES, "")


def is_all_caps(c: Column | str) -> Column:
    """At least one letter, and every letter is upper case."""
    return _col(c).rlike(r"\p{L}") & ~_col(c).rlike(r"[\p{L}&&[^\p{Lu}]]")


def title_case(c: Column | str) -> Column:
    """Upper case after every character without case, lower case else; ``initcap`` looks at blanks only."""
    runs = F.split(_col(c), r"(?<=[^\p{Lu}\p{Ll}\p{Lt}])(?=[\p{Lu}\p{Ll}\p{Lt}])")
    return F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")


def smart_case(c: Column | str) -> Column:
    """Title case for shouted names, others as they are."""
    return F.when(is_all_caps(c), title_case(_col(c))).otherwise(_col(c))


def display_title(c: Column | str) -> Column:
    """A heading for display: words begin with a capital, but those that begin with a digit; acronyms, also before 's, in capitals."""
    raised = lambda w: F.concat(F.regexp_extract(w, r"^([^a-z]*)", 1), F.upper(F.regexp_extract(w, r"^[^a-z]*([a-z])", 1)), F.regexp_replace(w, r"^[^a-z]*[a-z]", ""))
    word = lambda w: F.when(w.rlike(r"^\d") | ~w.rlike("[a-z]"), w).otherwise(raised(w))
    out = F.array_join(F.transform(F.split(F.lower(_col(c)), r"(?<=\s)(?=\S)|(?<=\S)(?=\s)"), word), "")
    for name in ACRONYMS:
        out = F.regexp_replace(out, rf"(?<![A-Za-z])(?i:{name})(?![A-Za-z])", name)
    return out


def salutation_body(c: Column | str) -> Column:
    """A body that opens with the salutation exactly once."""
    rest = F.regexp_replace(_col(c), r"(?iU)^\s*" + SALUTATION + r"\s*[:,]?\s*", "")
    return F.concat(F.lit("Dear Diary:\n\n"), F.regexp_replace(rest, r"(?U)^\s+", ""))


def entry_text(title: Column | str, body: Column | str) -> Column:
    """Body under an optional title head."""
    head = F.when(F.coalesce(_col(title), F.lit("")) != "", F.concat(F.lit("Title: "), _col(title), F.lit("\n\n"))).otherwise("")
    return F.concat(head, F.coalesce(_col(body), F.lit("")))


def json_object(content: Column | str, reasoning: Column | str) -> Column:
    """From the first brace to the last, in ``content`` or else in ``reasoning``."""
    cut = lambda c: empty_to_null(F.regexp_extract(F.coalesce(_col(c), F.lit("")), r"(?s)\{.*\}", 0))
    return F.coalesce(cut(content), cut(reasoning))


def keyword_values(keywords: Column | str, name: str) -> Column:
    """Values of the keywords with this name, joined."""
    own = F.filter(_col(keywords), lambda k: k["name"] == name)
    return F.coalesce(F.array_join(F.transform(own, lambda k: F.coalesce(k["value"], F.lit(""))), "; "), F.lit(""))


def image_year(url: Column | str) -> Column:
    """Year in an image path, 0 without."""
    return F.coalesce(F.nullif(F.regexp_extract(F.coalesce(_col(url), F.lit("")), r"/images/(\d{4})/", 1), F.lit("")).cast("int"), F.lit(0))
