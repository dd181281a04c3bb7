"""Titles, names and query strings."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold_map() -> tuple[str, str]:
    """Accented Latin letters and their base letters, from their canonical decompositions."""
    pairs = [(chr(p), unicodedata.normalize("NFD", chr(p))[0]) for p in range(0xC0, 0x250)]
    pairs = [(c, base) for c, base in pairs if c != base and base.isascii()]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _fold_map()
#: Named entities that stand for a character in titles; all others become a space.
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#039;": "'", "&apos;": "'", "&nbsp;": " ", "&eacute;": "é", "&egrave;": "è", "&uuml;": "ü", "&ouml;": "ö", "&auml;": "ä", "&ntilde;": "ñ", "&ccedil;": "ç"}
#: Letters without a canonical decomposition, and how they are written in ASCII.
SPELLED = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "ħ": "h", "ı": "i", "ŧ": "t"}
#: The number of a character reference, decimal or hexadecimal, after "&#".
REFERENCE = r"^(x[0-9a-f]{1,6}|[0-9]{1,7});"


def fold_accents(text: Column) -> Column:
    return F.translate(text, FOLD_FROM, FOLD_TO)


def decode_references(text: Column) -> Column:
    """``&#233;`` and ``&#xe9;`` in a lower-case text as characters; what is no valid reference stays as it is."""

    def one(part: Column) -> Column:
        number = F.regexp_extract(part, REFERENCE, 1)
        code = F.when(F.startswith(number, F.lit("x")), F.conv(F.substring(number, 2, 6), 16, 10)).otherwise(number).try_cast("int")
        known = (number != "") & ((code.between(1, 0xD7FF)) | code.between(0xE000, 0x10FFFF))
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(known, code).otherwise(32)), 8, "0")), "UTF-32")
        return F.when(known, F.concat(char, F.substring(part, F.char_length(number) + 2, F.char_length(part)))).otherwise(F.concat(F.lit("&#"), part))

    parts = F.split(text, "&#")
    joined = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), one), ""))
    return F.when(F.contains(text, F.lit("&#")), joined).otherwise(text)


def normalize_title(title: Column) -> Column:
    """Lower-case, entities and references decoded, accents folded, letters like ß spelled out, everything but a-z, 0-9 and
    spaces deleted, spaces collapsed."""
    out = F.lower(title)
    for entity, char in ENTITIES.items():
        if entity != "&amp;":
            out = F.replace(out, F.lit(entity), F.lit(char))
    out = decode_references(F.replace(out, F.lit("&amp;"), F.lit("&")))
    out = F.lower(F.regexp_replace(out, r"&[a-z0-9#]+;", " "))
    for letter, plain in SPELLED.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    out = F.regexp_replace(fold_accents(out), r"[^a-z0-9 ]", "")
    return F.trim(F.regexp_replace(out, " +", " "))


def fuzzy_ratio(a: Column, b: Column) -> Column:
    """0 to 100: share of the longer string that needs no edit; 0 if either is empty, 100 if equal."""
    longest = F.greatest(F.length(a), F.length(b))
    ratio = F.round((1 - F.levenshtein(a, b) / longest) * 100).cast("int")
    return F.when(a == b, 100).when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(ratio)


def confidence(ratio: Column) -> Column:
    return F.round(ratio / 100.0, 2)


def normalize_author(full_name: Column) -> Column:
    out = F.regexp_replace(fold_accents(F.lower(full_name)), r"[^a-z\s]", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def full_name(given: Column, family: Column) -> Column:
    return F.trim(F.concat_ws(" ", given, family))


def parse_author(name: Column) -> Column:
    """struct<family,given> of "Family, Given"; else the last word is the family name."""
    clean = F.trim(name)
    comma = F.split(clean, ",", 2)
    parts = F.split(clean, r"\s+")
    given = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), " ")
    by_comma = F.struct(F.trim(comma[0]).alias("family"), F.nullif(F.trim(F.get(comma, F.lit(1))), F.lit("")).alias("given"))
    by_space = F.struct(F.element_at(parts, -1).alias("family"), F.nullif(given, F.lit("")).alias("given"))
    return F.when(F.instr(clean, ",") > 0, by_comma).otherwise(by_space)


def lucene_escape(term: Column) -> Column:
    return F.regexp_replace(term, r'([+\-&|!(){}\[\]^"~*?:/\\])', r"\\$1")


def boolean_to_symbols(term: Column) -> Column:
    """AND, OR, NOT to +, |, - and white space collapsed."""
    out = F.regexp_replace(term, r"(?i)\bAND\b", "+")
    out = F.regexp_replace(out, r"(?i)\bOR\b", "|")
    out = F.regexp_replace(out, r"(?i)\bNOT\s+", "-")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def ellipsis(text: Column, length: int = 48) -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("…"))).otherwise(text)


def raw_url_encode(text: Column) -> Column:
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def cache_key(term: Column, year_from: Column, year_to: Column, language: Column, max_results: Column, offset: Column, aliases: Column) -> Column:
    """SHA-256 of the query's parts; the order of source names does not matter."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.sha2(F.concat_ws("|", term, blank(year_from), blank(year_to), blank(language), blank(max_results), blank(offset), F.array_join(F.sort_array(aliases), ",")), 256)


def cluster_name(seed: Column) -> Column:
    """A repeatable identifier of a cluster."""
    return F.substring(F.sha2(seed.cast("string"), 256), 1, 10)


def year_of(text: Column) -> Column:
    """The first four digits in a row, as a year."""
    return F.nullif(F.regexp_extract(text, r"(\d{4})", 1), F.lit("")).cast("int")


def atom_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")
