"""Text keys and normalisers. Every function takes and returns a Column; no UDF."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accent_table() -> tuple[str, str]:
    """Letters of the Latin blocks whose decomposition is one base letter plus marks."""
    source, target = [], []
    for code in range(0xC0, 0x250):
        letter = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c))
        if base != letter and len(base) == 1:
            source.append(letter)
            target.append(base)
    return "".join(source), "".join(target)


ACCENTS, PLAIN = _accent_table()

# Turkish letters and their ASCII forms.
TURKISH = "ÇĞİÖŞÜçğıöşü"
TURKISH_ASCII = "CGIOSUcgiosu"

# Folded first word of a track name -> canonical city.
DOMESTIC_CITIES = {
    "ISTANBUL": "İstanbul",
    "IZMIR": "İzmir",
    "ANKARA": "Ankara",
    "ADANA": "Adana",
    "ANTALYA": "Antalya",
    "BURSA": "Bursa",
    "DIYARBAKIR": "Diyarbakır",
    "ELAZIG": "Elazığ",
    "KOCAELI": "Kocaeli",
    "SANLIURFA": "Şanlıurfa",
}
# Folded prefix of a course name -> city.
TRACK_ALIASES = {
    "VELIEFENDI": "İstanbul",
    "SIRINYER": "İzmir",
    "YESILOBA": "Adana",
    "OSMANGAZI": "Bursa",
    "KARTEPE": "Kocaeli",
    "75. YIL": "Ankara",
}
MANDATORY_CITIES = ["ISTANBUL", "IZMIR"]
UNKNOWN_TRACK = "Bilinmiyor"

# Breeding and handicap codes appended to names in result lists.
NAME_SUFFIXES = "DB|SK|KG|SKG|SG|KGR|SGKR|ÖG|AP|K|G|E|A|D"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def squeeze(value: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(value), r"\s+", " "))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]


def repair_mojibake(value: Column | str) -> Column:
    """Undo UTF-8 bytes read as Latin-1; the text is kept where that is not what happened."""

    def repaired(v: Column) -> Column:
        decoded = F.decode(F.encode(v, "ISO-8859-1"), "UTF-8")
        suspect = v.rlike("[ÃÄÅ]") & ~v.rlike(r"[^\u0000-\u00FF]")
        return F.when(suspect & ~decoded.contains("\ufffd"), decoded).otherwise(v)

    return bind(_col(value), repaired)


def strip_accents(value: Column | str) -> Column:
    return F.regexp_replace(F.translate(_col(value), ACCENTS, PLAIN), r"\p{M}", "")


def fold(value: Column | str) -> Column:
    """Comparison key: mojibake repaired, accents dropped, upper case, trimmed."""
    return F.trim(F.upper(strip_accents(repair_mojibake(F.coalesce(_col(value), F.lit(""))))))


def clean_track(value: Column | str) -> Column:
    """Drop what stands in parentheses at the end, then resolve course aliases."""
    text = squeeze(F.coalesce(_col(value), F.lit(UNKNOWN_TRACK)))
    text = F.trim(F.regexp_replace(text, r"(?:\s*\([^)]*\))+\s*$", ""))

    def resolved(pair: Column) -> Column:
        name = F.when(pair["text"] == "", F.lit(UNKNOWN_TRACK)).otherwise(pair["text"])
        for alias, city in reversed(TRACK_ALIASES.items()):
            name = F.when(pair["key"].startswith(alias), F.lit(city)).otherwise(name)
        return name

    with_key = bind(text, lambda t: F.struct(t.alias("text"), fold(t).alias("key")))
    return bind(with_key, resolved)


def track_key(value: Column | str) -> Column:
    return fold(clean_track(value))


def first_word(value: Column) -> Column:
    return F.element_at(F.split(value, r"\s+"), 1)


def is_domestic_track(value: Column | str) -> Column:
    return first_word(track_key(value)).isin(list(DOMESTIC_CITIES))


def track_policy(value: Column | str) -> Column:
    return bind(
        first_word(track_key(value)),
        lambda base: F.when(base.isin(MANDATORY_CITIES), "mandatory")
        .when(base.isin(list(DOMESTIC_CITIES)), "supported")
        .otherwise("unsupported"),
    )


def normalise_city(value: Column | str) -> Column:
    value = _col(value)
    table = F.create_map(*[F.lit(x) for pair in DOMESTIC_CITIES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, first_word(fold(value))), value)


def horse_name(value: Column | str) -> Column:
    """Storage form: no trailing parenthesis, single spaces, upper case, accents kept."""
    bare = F.regexp_replace(F.trim(_col(value)), r"\s*\([^)]*\)\s*$", "")
    return F.trim(F.upper(F.regexp_replace(bare, r"\s+", " ")))


def clean_name(value: Column | str) -> Column:
    """ASCII letters and spaces only, upper case."""
    ascii_text = F.translate(F.coalesce(_col(value), F.lit("")), TURKISH, TURKISH_ASCII)
    return squeeze(F.upper(F.regexp_replace(ascii_text, r"[^A-Za-z ]", "")))


def name_key(value: Column | str) -> Column:
    """Name without the appended breeding and handicap codes, folded."""
    bare = F.regexp_replace(
        F.trim(F.coalesce(_col(value), F.lit(""))), rf"(?iu)(\s+(?:{NAME_SUFFIXES})\b)+\s*$", ""
    )
    return F.trim(F.upper(strip_accents(F.trim(bare))))


def person_key(value: Column | str) -> Column:
    lowered = F.lower(F.translate(F.coalesce(_col(value), F.lit("")), TURKISH, TURKISH_ASCII))
    return F.regexp_replace(lowered, r"\s+", "")


def track_feature_key(value: Column | str) -> Column:
    lowered = F.lower(F.translate(F.coalesce(_col(value), F.lit("")), TURKISH, TURKISH_ASCII))
    return squeeze(F.regexp_replace(lowered, r"\s*\([^)]*\)", ""))


def ascii_key(value: Column | str) -> Column:
    plain = F.regexp_replace(strip_accents(F.coalesce(_col(value), F.lit(""))), r"[^\x00-\x7F]", "")
    return F.trim(F.regexp_replace(F.upper(plain), r"[^A-Z0-9]+", " "))


def surface_keyword(value: Column | str) -> Column:
    """Surface by keyword (as-of dialect); unknown text is kept, lower-cased."""
    text = F.lower(F.translate(F.coalesce(_col(value), F.lit("")), "Çİ", "çi"))
    return (
        F.when(text.rlike("kum|dirt|k:"), "k:")
        .when(text.rlike("çim|turf|ç:|c:"), "ç:")
        .when(text.rlike("sentetik|synthetic|s:|tapeta"), "s:")
        .otherwise(text)
    )


def surface_initial(value: Column | str) -> Column:
    """First letter before any colon (dataset dialect)."""
    head = F.regexp_extract(F.trim(F.coalesce(_col(value), F.lit(""))), r"^([^:]+)", 1)
    return F.concat(F.substring(head, 1, 1), F.lit(":"))


def surface_prefix(value: Column | str) -> Column:
    """Text before the colon, else the first letter (incremental dialect)."""
    text = F.trim(F.coalesce(_col(value), F.lit("")))
    return F.when(text == "", "").when(
        text.contains(":"), F.concat(F.substring_index(text, ":", 1), F.lit(":"))
    ).otherwise(F.concat(F.substring(text, 1, 1), F.lit(":")))


# Words in a part of a race class that say nothing about the class.
CLASS_NOISE = ["kg", "e.i.d", "e.d", "çim", "cim", "kum", "sentetik", "tapeta"]
# Surface code -> words that name it, the first code that fits counts.
SURFACE_WORDS = {
    "k:": ["kum", "dirt", "k:"],
    "ç:": ["çim", "cim", "turf", "ç:", "c:"],
    "s:": ["sentetik", "synthetic", "s:", "tapeta"],
}


def holds_any(value: Column, words: list[str]) -> Column:
    return reduce(or_, [value.contains(w) for w in words])


def _class_without_noise(value: Column) -> Column:
    said = F.transform(F.split(value, ","), lambda part: F.trim(part))
    return F.array_join(F.filter(said, lambda part: ~holds_any(part, CLASS_NOISE) & ~part.rlike("^[0-9]+$")), ", ")


def _surface_code(value: Column) -> Column:
    return F.coalesce(*[F.when(holds_any(value, words), code) for code, words in SURFACE_WORDS.items()], value)


_CATEGORY_RULES: dict[str, Callable[[Column], Column]] = {
    "track": lambda value: F.regexp_replace(value, r"\s*\([^)]*\)", ""),
    "race_class": _class_without_noise,
    "surface": _surface_code,
}


def normalise_category(value: Column | str, feature: str | None = None) -> Column:
    """Category text for drift comparison: lower case in Turkish letters, the feature's own rule if
    it has one, no blanks around separators. A missing value is a category."""
    given = _col(value)
    lowered = F.lower(F.translate(F.trim(given), "İIıŞÇĞÖÜ", "iiişçğöü"))
    ruled = _CATEGORY_RULES[feature](lowered) if feature in _CATEGORY_RULES else lowered
    return F.coalesce(squeeze(F.regexp_replace(ruled, r"\s*([/,.-])\s*", "$1")), F.lit("__MISSING__"))


def unescape_first_line(value: Column | str) -> Column:
    """First line of a text with the common HTML entities resolved."""
    text = _col(value)
    for entity, char in (
        ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"),
    ):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_extract(text, r"^([^\r\n]*)", 1))


# The upper half of the Turkish code page beside Latin-1; bytes it leaves undefined stand apart.
_TURKISH = {chr(b): bytes([b]).decode("cp1254", errors="ignore") for b in range(0x80, 0x100)}
_TURKISH_GAPS = "".join(latin for latin, char in _TURKISH.items() if not char)
_TURKISH_PAIRS = [(latin, char) for latin, char in _TURKISH.items() if char and char != latin]
_TURKISH_LATIN, _TURKISH_TEXT = ("".join(side) for side in zip(*_TURKISH_PAIRS, strict=True))


def is_cp1254(content: Column | str) -> Column:
    """No byte is undefined in the Turkish code page."""
    return ~F.decode(_col(content), "ISO-8859-1").rlike(f"[{_TURKISH_GAPS}]")


def encode_cp1254(value: Column | str) -> Column:
    """Bytes of a text in the Turkish code page; letters it lacks become question marks."""
    return F.encode(F.translate(_col(value), _TURKISH_TEXT, _TURKISH_LATIN), "ISO-8859-1")


def decode_as(content: Column | str, encoding: Column | str) -> Column:
    """Text of bytes known to be ``utf-8``, ``cp1254`` or ``latin-1``."""
    content, encoding = _col(content), _col(encoding)
    latin = F.decode(content, "ISO-8859-1")
    return (
        F.when(encoding == "utf-8", content.cast("string"))
        .when(encoding == "cp1254", F.translate(latin, _TURKISH_LATIN, _TURKISH_TEXT))
        .otherwise(latin)
    )


def city_from_file_name(name: Column | str) -> Column:
    """City part of names like ``2026-01-31-istanbul-report.txt``."""
    city = F.lower(F.regexp_extract(_col(name), r"\d{4}-\d{2}-\d{2}[-_]([^-_.]+)", 1))
    return normalise_city(city)


def date_from_file_name(name: Column | str) -> Column:
    return F.try_to_timestamp(
        F.regexp_extract(_col(name), r"(\d{4}-\d{2}-\d{2})", 1), F.lit("yyyy-MM-dd")
    ).cast("date")
