"""Text, identifier and URL rules as column expressions; no Python runs on the rows but for ``sequence_ratio``."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Suffixes of company names that carry no identity (fixed values).
LEGAL_SUFFIXES = ("LTD", "LIMITED", "PVT", "PRIVATE", "PUBLIC", "INC", "INCORPORATED", "CORP", "CORPORATION", "CO", "COMPANY", "PLC")
#: Abbreviations in names and what they stand for (fixed values).
ABBREVIATIONS = {"COM": "COMMERCIAL", "VE": "VEHICLE", "CTR": "CONTROL", "SYS": "SYSTEM", "IND": "INDIA", "LTD": "LIMITED", "PVT": "PRIVATE", "PUB": "PUBLIC", "CORP": "CORPORATION", "CO": "COMPANY"}
#: Phrases that follow an issuer in a notice, and the verbs that tell one (fixed values).
NOTICE_VERBS = r"(?:has|have|had)\s+(?:informed|submitted|announced|intimated|disclosed|provided|uploaded|filed)\b"
BOUNDARY = rf"(?i)\s+{NOTICE_VERBS}|\s+(?:regarding|about|on|for)\s+(?:the|its|their)\b|\s*\|\s*SUBJECT\s*:"
#: Words too common to identify a company (fixed values).
STOP_WORDS = ("THE", "AND", "OF", "FOR", "IN", "ON", "AT", "LIMITED", "LTD", "PRIVATE", "PVT", "PUBLIC", "PUB", "COMPANY", "CO", "CORPORATION", "CORP", "INDIA", "INDIAN", "INC", "PLC")


def normalized_name(name: Column) -> Column:
    """Upper case, without an ex-date tail, every other character a space, spaces collapsed."""
    bare = F.regexp_replace(name, r"(?i)\s*-\s*ex-?\s*date\s*:.*$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(bare), "[^A-Z0-9]", " "), " +", " "))


def normalized_symbol(symbol: Column) -> Column:
    return F.regexp_replace(F.upper(symbol), "[^A-Z0-9]", "")


def evidence_name(name: Column) -> Column:
    return normalized_name(F.replace(name, F.lit("&"), F.lit(" AND ")))


def without_legal_suffix(name: Column) -> Column:
    """A normalized name without its trailing legal words."""
    return F.trim(F.regexp_replace(name, rf"(?:\s+(?:{'|'.join(LEGAL_SUFFIXES)}))+$", ""))


def cleaned(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, "\u0000", " "), r"\s+", " "))


def scrip_code(title: Column) -> Column:
    """The number of five to eight digits in parentheses, null without one."""
    return F.nullif(F.regexp_extract(title, r"\(([0-9]{5,8})\)", 1), F.lit(""))


def title_symbol(title: Column) -> Column:
    """The symbol before `` : `` at the start of a title."""
    return F.nullif(F.regexp_extract(title, r"^\s*([A-Z0-9&-]{1,20})\s*:", 1), F.lit(""))


def title_company(title: Column) -> Column:
    """The company before a scrip code or before "has informed", else the title."""
    coded = F.nullif(F.trim(F.regexp_extract(title, r"^(.*?)\s*\([0-9]{5,8}\)", 1)), F.lit(""))
    informed = F.nullif(F.trim(F.regexp_extract(title, r"(?i)^(?:[A-Z0-9&-]{1,20}\s*:\s*)?(.*?)\s+has informed", 1)), F.lit(""))
    return F.coalesce(coded, informed, title)


def tokens(name: Column) -> Column:
    """Meaningful tokens of a normalized name: three letters or more, no stop word, in order, once each."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_distinct(F.filter(F.split(name, " "), lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t)))


def expanded(name: Column) -> Column:
    """A normalized name with its abbreviations written out."""
    table = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    return F.array_join(F.transform(F.split(name, " "), lambda t: F.coalesce(F.try_element_at(table, t), t)), " ")


def distinctive_tokens(name: Column) -> Column:
    """Sorted tokens of three letters or more of an expanded name without the generic ones."""
    return F.array_sort(tokens(expanded(name)))


def acronym(name: Column) -> Column:
    """First letters of the meaningful tokens."""
    return F.array_join(F.transform(tokens(name), lambda t: F.substring(t, 1, 1)), "")


def name_variants(name: Column) -> Column:
    """A normalized name, without its legal suffix, and with the other spelling of LIMITED or CORPORATION."""
    other = F.when(F.endswith(name, F.lit(" LIMITED")), F.regexp_replace(name, " LIMITED$", " LTD")).when(F.endswith(name, F.lit(" CORPORATION")), F.regexp_replace(name, " CORPORATION$", " CORP"))
    return F.array_distinct(F.filter(F.array(name, without_legal_suffix(name), other), lambda v: v.isNotNull() & (v != "")))


def issuer(title: Column) -> tuple[Column, Column, Column]:
    """Issuer, method and confidence: what stands before a boundary phrase or a bar, else before a notice verb; two words at least."""
    line = F.trim(F.element_at(F.split(F.trim(title), "\n"), 1))
    bound = F.when(F.rlike(line, F.lit(BOUNDARY)), F.element_at(F.split(line, BOUNDARY), 1)).when(F.contains(line, F.lit("|")), F.element_at(F.split(line, r"\|"), 1))
    bare = lambda c: F.regexp_replace(c, r"^[ \-:|,]+|[ \-:|,]+$", "")
    words = lambda c: F.size(F.split(evidence_name(c), " "))
    prefix, verb = bare(bound), bare(F.nullif(F.regexp_extract(line, rf"(?i)^(.{{2,120}}?)\s+{NOTICE_VERBS}", 1), F.lit("")))
    first, second = F.coalesce(words(prefix) >= 2, F.lit(False)), F.coalesce(words(verb) >= 2, F.lit(False))
    return F.when(first, prefix).when(second, verb), F.when(first, "TITLE_PREFIX").when(second, "NOTICE_VERB").otherwise("NONE"), F.when(first, F.lit(0.85)).when(second, F.lit(0.9)).otherwise(F.lit(0.0))


def name_v11(name: Column) -> Column:
    """The mapping script's variant: lower case, and only an ex-date of two dashes or slashes is cut off."""
    bare = F.regexp_replace(F.trim(name), r"(?i)\s*-\s*Ex-Date\s*:\s*\d{1,2}[-/]\w+[-/]\d{2,4}\s*$", "")
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(bare, "[^a-zA-Z0-9 ]", " "), r"\s+", " ")))


def isin_shape(text: Column, strict: bool = True) -> Column:
    return F.rlike(text, F.lit("^INE[A-Z0-9]{9}$" if strict else "^IN[A-Z0-9]{10}$"))


def isin_valid(text: Column) -> Column:
    """Shape and check digit: letters count as 10 to 35, then the Luhn sum from the right ends in 0."""
    digits = F.array_join(F.transform(F.split(text, ""), lambda c: F.when(F.rlike(c, F.lit("[A-Z]")), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")
    each = F.transform(F.reverse(F.split(digits, "")), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    doubled = F.transform(each, lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    total = F.aggregate(doubled, F.lit(0), lambda a, x: a + x)
    return F.rlike(text, F.lit("^[A-Z]{2}[A-Z0-9]{9}[0-9]$")) & (total % 10 == 0)


def safe_double(text: Column) -> Column:
    """A number with optional thousands commas; null for a dash, blank or anything else."""
    return F.regexp_replace(F.trim(text), ",", "").try_cast("double")


def safe_long(text: Column) -> Column:
    return safe_double(text).try_cast("long")


def parsed_date(text: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "dd-MMM-yyyy", "dd/MM/yyyy")) -> Column:
    """The first format that fits; null for a dash, blank or none."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in formats]).cast("date")


def url_class(url: Column) -> Column:
    """PDF, XML, HTML, OTHER or NONE by the suffix of a URL's path."""
    path = F.lower(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-zA-Z]+://[^/]*", ""))
    return F.when(url.isNull() | (F.trim(url) == ""), "NONE").when(F.endswith(path, F.lit(".pdf")), "PDF").when(F.endswith(path, F.lit(".xml")), "XML").when(F.endswith(path, F.lit(".html")) | F.endswith(path, F.lit(".htm")), "HTML").otherwise("OTHER")


def safe_file_name(text: Column) -> Column:
    return F.substring(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_"), 1, 120)


def identity_key(isin: Column, exchange: Column, symbol: Column, name: Column) -> Column:
    """ISIN, else exchange and symbol, else exchange and name."""
    filled = lambda c: c.isNotNull() & (c != "")
    return F.when(filled(isin), isin).when(filled(symbol), F.concat_ws(":", exchange, symbol)).otherwise(F.concat_ws(":", exchange, name))


def json_fields(text: Column) -> Column:
    """The fields of a JSON object as raw values by name; nothing, no object or no JSON has no fields."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))


def json_merged(old: Column, new: Column) -> Column:
    """Two JSON objects as fields: those of the later one win whole, nulls and nested values stay as they are."""
    later = json_fields(new)
    return F.map_concat(F.map_filter(json_fields(old), lambda k, v: ~F.map_contains_key(later, k)), later)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 M / T of the recursive longest matching blocks; no built-in function has these semantics. Null for a null."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")
