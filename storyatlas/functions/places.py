"""The language of location queries: cleaning, classification, canonical streets.

Every rule is a column expression over built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, collapse, empty_to_null, name_key, strip_chars

# ---- fixed values: patterns and word lists ----------------------------------
WORD_ORDINALS = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth"]
_ORDINALS = "First|Second|Third|Fourth|Fifth|Sixth|Seventh|Eighth|Ninth|Tenth|Eleventh|Twelfth"
_DIRECTION = r"(?:East|West|North|South|E|W|N|S)"
STATION = r"(?i)\b(?:[A-Z]\s+train|subway|train|path|ferry)?\s*(?:station|stop|terminal)\b"
STATION_QUALIFIER = r"(?i)\b(?:BMT|IND|IRT|PATH|Metro[- ]North|West Side|East Side|No\.?\s*\d+|[A-Z]\s+train|of the .*?subway)\b"
BUS_TAIL = r"(?i)\b(?:crosstown\s+)?bus\b.*$"
CROSSING = r"(?i)^(?:the\s+)?(?:corner of\s+|intersection of\s+)?(.+?)\s+(?:and|&|at)\s+(.+)$"
BETWEEN = r"(?i)^(.+?)\s+between\s+(.+?)\s+and\s+(.+)$"
OFF_NEAR = r"(?i)^(.+?)\s+(?:off|near)\s+(.+)$"
HOUSE_NUMBER = r"^\s*\d+[A-Za-z]?\s+\S"
BARE_STREET = (
    rf"(?i)^(?:the\s+)?{_DIRECTION}?\s*(?:\d{{1,3}}(?:st|nd|rd|th)?|{_ORDINALS}|[A-Z][a-z]+)"
    r"\s+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Broadway|Parkway|Pkwy|Drive|Dr|Lane)\.?$"
)
SIDE_STREET = (
    rf"(?i)^(?:the\s+)?(?:{_DIRECTION}\.?\s+)?(?:\d{{1,3}}(?:st|nd|rd|th|d)?|{_ORDINALS}|[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)?)"
    r"\s+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Broadway|Parkway|Pkwy|Drive|Dr|Lane|Ln|Place|Pl|Terrace|Ter|Court|Ct"
    r"|Square|Plaza|Circle|Highway|Hwy|Slip|Walk|Row|Way)(?:\s+(?:North|South|East|West))?\.?$"
)
BARE_ORDINAL = rf"(?i)^(?:the\s+)?(?:{_DIRECTION}\.?\s+)?\d{{1,3}}(?:st|nd|rd|th|d)?$"
AVENUE_LETTER = r"(?i)^Avenue\s+[A-D]$"
PLURAL = r"(?i)^(.*?)\s+(Streets|Sts|Avenues|Aves|Roads|Boulevards|Blvds|Places|Drives|Lanes)\.?$"
SINGULAR = {"streets": "Street", "sts": "St", "avenues": "Avenue", "aves": "Ave", "roads": "Road", "boulevards": "Boulevard", "blvds": "Blvd", "places": "Place", "drives": "Drive", "lanes": "Lane"}
BARE_NAMES = ["broadway", "amsterdam", "columbus", "lexington", "madison", "park", "lenox", "riverside", "york", "west end", "east end", "central park west", "franklin", "vesey", "bowery", "canal", "avenue of the americas"]
AVENUES = ["lexington", "park", "madison", "amsterdam", "columbus", "york", "west end", "east end", "lenox", "convent", "mcdonald", "flatbush", "nostrand"]
DRIVES = ["riverside"]
GEO_ORDINAL = rf"(?i)^(?:({_DIRECTION})\.?\s+)?(\d{{1,3}})(?:st|nd|rd|th|d)?$"
NUMBERED_STREET = rf"(?i)^(?:the\s+)?(?:{_DIRECTION}\.?\s+)?(?:\d{{1,3}}(?:st|nd|rd|th|d)?|{_ORDINALS})\s+(?:Street|St|Avenue|Ave)\.?$"
PINNED_STREETS = [
    "park", "park avenue", "park avenue south", "lexington", "lexington avenue", "madison", "madison avenue",
    "amsterdam", "amsterdam avenue", "columbus", "columbus avenue", "west end", "west end avenue", "york", "york avenue",
    "lenox", "lenox avenue", "riverside", "riverside drive", "central park west", "convent", "convent avenue",
    "st nicholas avenue", "saint nicholas avenue", "fort washington avenue", "avenue of the americas",
]
TAIL = r"(?i)\b(?:at|on|in)\s+(.+)$"
GEOCODABLE = r"(?i)(?:street|avenue|broadway|\bst\b|\bave\b|plaza|square|\band\b|\d)"
GENERIC_TOKENS = [
    "the", "a", "an", "of", "and", "at", "in", "on", "off", "near", "new", "york", "ny", "nyc", "usa", "us",
    "manhattan", "brooklyn", "queens", "bronx", "staten", "island",
    "street", "st", "avenue", "ave", "road", "rd", "boulevard", "blvd", "place", "pl", "drive", "dr", "lane", "ln", "parkway", "pkwy",
    "court", "ct", "terrace", "ter", "square", "plaza", "circle",
    "restaurant", "restaurants", "cafe", "diner", "bar", "grill", "deli", "tavern", "lounge", "club", "pub", "bakery", "shop", "store",
    "market", "park", "building", "hotel", "theater", "theatre", "house", "company", "co",
]
BOROUGHS = {"the bronx": "Bronx", "bronx": "Bronx", "kings": "Brooklyn", "brooklyn": "Brooklyn", "manhattan": "Manhattan", "queens": "Queens", "staten island": "Staten Island"}
#: Boroughs in the order in which a crossing is looked for.
BOROUGH_ORDER = ["Manhattan", "Brooklyn", "Queens", "Bronx", "Staten Island"]
#: Points that every variant of a name is pinned to, and names that stand for another.
PINNED_POINTS = {
    "port authority": (40.75717952921247, -73.9911739036894),
    "port authority terminal": (40.75717952921247, -73.9911739036894),
    "port authority bus terminal": (40.75717952921247, -73.9911739036894),
    "42nd street port authority terminal": (40.75717952921247, -73.9911739036894),
    "la guardia": (40.77571, -73.87336),
    "la guardia airport": (40.77571, -73.87336),
    "laguardia": (40.77571, -73.87336),
    "carnegie deli": (40.7507122990915, -73.99370858820676),
    "studio 54": (40.76439744535597, -73.9836979460188),
}
ALIASES = {
    "pennsylvania station": "Penn Station",
    "new york penn station": "Penn Station",
    "kennedy international airport": "Kennedy Airport",
    "jfk": "Kennedy Airport",
    "jfk airport": "Kennedy Airport",
}
# -----------------------------------------------------------------------------


def _lookup(key: Column, table: dict[str, str]) -> Column:
    """The table's value for ``key``, NULL without."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), key)


def _group(c: Column, pattern: str, n: int) -> Column:
    return F.regexp_extract(c, pattern, n)


def pick_query(locations: Column | str) -> Column:
    """The first location if it is not blank."""
    return empty_to_null(collapse_ends(F.try_element_at(_col(locations), F.lit(1))))


def collapse_ends(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_query(raw: Column | str) -> Column:
    """Without bus routes, and without what follows a comma unless cross streets do."""
    q = strip_chars(F.regexp_replace(collapse_ends(_col(raw)), BUS_TAIL, ""), " ,")
    cut = q.contains(",") & ~q.rlike(r"(?i)\bbetween\b")
    return F.when(cut, collapse_ends(F.split_part(q, F.lit(","), F.lit(1)))).otherwise(q)


def looks_like_street(side: Column) -> Column:
    s = strip_chars(side, " .,")
    key = name_key(s)
    return s.rlike(SIDE_STREET) | s.rlike(BARE_ORDINAL) | s.rlike(AVENUE_LETTER) | key.isin(BARE_NAMES) | key.isin(WORD_ORDINALS)


def _plural(side: Column) -> tuple[Column, Column]:
    """The name under a shared plural suffix and the suffix in the singular (NULL without)."""
    s = collapse_ends(side)
    return _group(s, PLURAL, 1), F.when(s.rlike(PLURAL), _lookup(F.lower(_group(s, PLURAL, 2)), SINGULAR))


def is_crossing(one: Column, other: Column) -> Column:
    """Both sides read as streets, alone or under a shared plural suffix."""
    name, suffix = _plural(other)
    shared = looks_like_street(F.concat_ws(" ", one, suffix)) & looks_like_street(F.concat_ws(" ", name, suffix))
    return (looks_like_street(one) & looks_like_street(other)) | (suffix.isNotNull() & shared)


def classify(q: Column | str) -> Column:
    """station, relational, intersection, bare_street or place: the first whose rule holds."""
    q = _col(q)
    crossing = q.rlike(CROSSING) & ~q.rlike(HOUSE_NUMBER) & is_crossing(_group(q, CROSSING, 1), _group(q, CROSSING, 2))
    return (
        F.when(q.isNull(), None)
        .when(q.rlike(STATION), "station")
        .when(q.rlike(BETWEEN) | q.rlike(OFF_NEAR), "relational")
        .when(crossing, "intersection")
        .when(q.rlike(BARE_STREET), "bare_street")
        .otherwise("place")
    )


def street_pair(q: Column | str) -> Column:
    """struct(one, other): the two streets of a crossing or a relation, NULL without."""
    q = _col(q)
    tidy = lambda c: strip_chars(F.regexp_replace(c, r"(?U)\s+", " "), " .,")
    pick = F.lit(None)
    for pattern in (CROSSING, OFF_NEAR, BETWEEN):
        pick = F.when(q.rlike(pattern), F.struct(tidy(_group(q, pattern, 1)).alias("one"), tidy(_group(q, pattern, 2)).alias("other"))).otherwise(pick)
    return pick


def apply_suffix(name: Column, suffix: Column) -> Column:
    """A shared suffix on one side: 31st, Road -> 31 Road."""
    name = strip_chars(name, " .,")
    direction = F.when(_group(name, GEO_ORDINAL, 1) != "", F.concat(_group(name, GEO_ORDINAL, 1), F.lit(" "))).otherwise("")
    return F.when(name.rlike(GEO_ORDINAL), F.concat(direction, _group(name, GEO_ORDINAL, 2), F.lit(" "), suffix)).otherwise(F.concat(name, F.lit(" "), suffix))


def canonical_street(side: Column | str) -> Column:
    """The full name of a street: 77th -> 77 Street, Third -> Third Avenue."""
    s = F.regexp_replace(strip_chars(side, " .,"), r"(?i)^the\s+", "")
    key = name_key(s)
    direction = F.when(_group(s, GEO_ORDINAL, 1) != "", F.concat(_group(s, GEO_ORDINAL, 1), F.lit(" "))).otherwise("")
    return (
        F.when(key.isin(WORD_ORDINALS), F.concat(s, F.lit(" Avenue")))
        .when(s.rlike(GEO_ORDINAL), F.concat(direction, _group(s, GEO_ORDINAL, 2), F.lit(" Street")))
        .when(key.isin(AVENUES), F.concat(s, F.lit(" Avenue")))
        .when(key.isin(DRIVES), F.concat(s, F.lit(" Drive")))
        .when(key.startswith("avenue of the americas"), F.lit("Avenue of the Americas"))
        .otherwise(s)
    )


def crossing_streets(q: Column | str) -> Column:
    """struct(one, other) in canonical form, NULL without two streets."""
    pair = street_pair(q)
    one, other = pair["one"], pair["other"]
    name, suffix = _plural(other)
    shared = F.struct(apply_suffix(one, suffix).alias("one"), apply_suffix(name, suffix).alias("other"))
    plain = F.struct(canonical_street(one).alias("one"), canonical_street(other).alias("other"))
    return F.when(pair.isNull(), None).when(suffix.isNotNull(), shared).otherwise(plain)


def strip_station(q: Column | str) -> Column:
    """A station's name as a plain place; the query itself if nothing is left."""
    return F.coalesce(empty_to_null(strip_chars(F.regexp_replace(_col(q), STATION, ""), " -,")), _col(q))


def station_core(q: Column | str) -> Column:
    """A station's name without lines and divisions."""
    core = collapse(F.regexp_replace(strip_station(q), STATION_QUALIFIER, ""))
    return F.coalesce(empty_to_null(strip_chars(core, " -,.")), _col(q))


def location_tail(q: Column | str) -> Column:
    """What follows the first at, on or in, if it can be geocoded."""
    tail = strip_chars(_group(_col(q), TAIL, 1), " .,")
    return F.when(_col(q).rlike(TAIL) & tail.rlike(GEOCODABLE), tail)


def is_pinned_street(q: Column | str) -> Column:
    """Numbered and famous streets that are looked for in one borough only."""
    return _col(q).rlike(NUMBERED_STREET) | name_key(q).isin(PINNED_STREETS)


def ordinal(n: Column | str) -> Column:
    n = _col(n)
    tens, unit = n % 100, n % 10
    end = F.when((tens >= 10) & (tens <= 20), "th").when(unit == 1, "st").when(unit == 2, "nd").when(unit == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def digit_ordinals(q: Column | str) -> Column:
    """Ordinals in digits: Sixth -> 6th, 43d -> 43rd."""
    out = _col(q)
    for n, word in enumerate(WORD_ORDINALS, 1):
        out = F.regexp_replace(out, rf"(?i)\b{word}\b", f"{n}")
    tail = r"(?:st|nd|rd|th|d)?\b"
    out = F.regexp_replace(out, rf"(?i)\b0{{1,2}}(?=\d{{1,2}}{tail})", "")
    for digits, end in ((r"\d?1\d|\d{0,2}[04-9]", "th"), (r"(?:\d?[02-9])?1", "st"), (r"(?:\d?[02-9])?2", "nd"), (r"(?:\d?[02-9])?3", "rd")):
        out = F.regexp_replace(out, rf"(?i)\b({digits}){tail}", f"$1{end}")
    return out


def is_override(q: Column | str) -> Column:
    """Whether a fixed point, an alias or a pin decides this query."""
    return name_key(q).isin([*PINNED_POINTS, *ALIASES]) | is_pinned_street(q)


def distinct_tokens(c: Column | str) -> Column:
    """Words that identify a place."""
    words = F.filter(F.split(name_key(c), " "), lambda w: F.length(w) > 1)
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, GENERIC_TOKENS)))


def label_covers(query: Column | str, label: Column | str) -> Column:
    """Whether at least half of the query's identifying words are in the label."""
    words = distinct_tokens(query)
    hit = F.size(F.array_intersect(words, F.split(name_key(label), " ")))
    return F.when(F.coalesce(_col(label), F.lit("")) == "", False).when(F.size(words) == 0, True).otherwise(hit * 2 >= F.size(words))


def canonical_borough(c: Column | str) -> Column:
    return _lookup(F.lower(collapse_ends(_col(c))), BOROUGHS)


def first_borough(neighborhoods: Column | str, of: dict[str, str]) -> Column:
    """The borough of the first neighborhood that ``of`` (name in lower case -> borough) knows."""
    known = F.filter(F.transform(_col(neighborhoods), lambda n: _lookup(F.lower(F.coalesce(n, F.lit(""))), of)), lambda b: b.isNotNull())
    return F.try_element_at(known, F.lit(1)) if of else F.lit(None).cast("string")


def borough_phrase(c: Column | str) -> Column:
    """A borough as it reads after "in"."""
    return F.when(_col(c) == "Bronx", "the Bronx").otherwise(_col(c))
