"""Text keys and similarities as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms in the order in which they are stripped, and words that say nothing in a name.
LEGAL_SUFFIXES = (
    "s.l.u.", "s.l.u", "s.l.", "s.l", "slu", "sl", "s.a.u.", "s.a.", "s.a", "sau", "sa", "s.c.", "sc",
    "s.coop.", "scoop", "c.b.", "cb", "sociedad limitada", "sociedad anonima",
)
NOISE_WORDS = ("the", "el", "la", "los", "las", "de", "del", "y", "e", "en", "al")
# Words of a street address that name no street.
STREET_WORDS = (
    "calle", "c", "avenida", "avda", "av", "plaza", "pza", "paseo", "po", "camino", "ctra", "carretera",
    "urbanizacion", "urb", "edificio", "edif", "local", "bajo", "piso", "puerta", "s n", "num", "numero", "n",
)
# Shapes of credentials.
SECRET_SHAPES = (
    r"\bsk-[A-Za-z0-9_-]{16,}\b",
    r"\bgsk_[A-Za-z0-9_-]{16,}\b",
    r"\bAIza[0-9A-Za-z_-]{30,}\b",
    r"(?i)\bBearer\s+[A-Za-z0-9._-]{12,}\b",
    r"(?i)\bpostgres(?:ql)?://\S+",
)
SECRET_KEYS = (
    r"(?i)(api[-_]?key|apikey|authorization|auth|token|secret|password|passwd|pwd|credential|cookie|session|bearer"
    r"|dsn|connection[-_]?string|database[-_]?url)"
)
REDACTED = "[REDACTED]"


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str]:
    """Characters up to U+1EFF whose decomposition is one character and marks, and these characters."""
    marked, plain = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        kept = [c for c in unicodedata.normalize("NFD", chr(code)) if not 0x300 <= ord(c) <= 0x36F]
        if len(kept) == 1 and kept[0] != chr(code):
            marked.append(chr(code))
            plain.append(kept[0])
    return "".join(marked), "".join(plain)


def strip_diacritics(c: Column) -> Column:
    """Latin letters without their marks; combining marks U+0300 to U+036F go. Other scripts stay."""
    return F.regexp_replace(F.translate(c, *_folding()), "[\\u0300-\\u036F]", "")


def normalize_text(c: Column) -> Column:
    """Lower case without marks; whatever is no letter or digit of ASCII becomes one space. Null is ''."""
    folded = F.lower(strip_diacritics(F.coalesce(c, F.lit(""))))
    return F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " "))


def normalize_name(c: Column) -> Column:
    """normalize_text of a name without trailing legal forms, each stripped once, in order."""
    value = F.trim(F.lower(strip_diacritics(F.coalesce(c, F.lit("")))))
    quoted = [suffix.replace(".", "\\.") for suffix in LEGAL_SUFFIXES]
    stripped = value
    for suffix in quoted:
        stripped = F.regexp_replace(stripped, f"(?s)^(.+)[ ,.\\-]{suffix}$", "$1")
    # most names end in none of them
    value = F.when(value.rlike(f"(?s).[ ,.\\-](?:{'|'.join(quoted)})$"), stripped).otherwise(value)
    return F.trim(F.regexp_replace(value, "[^a-z0-9]+", " "))


def name_tokens(c: Column) -> Column:
    """Words of a normalised name, without single characters and noise words."""
    return F.filter(F.split(c, " "), lambda w: (F.length(w) > 1) & ~w.isin(*NOISE_WORDS))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays as sets; 0 if either is empty."""
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance by the longer length; 0 if either is empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def name_similarity(a: Column, b: Column) -> Column:
    """Of two normalised names: the greater of token overlap and 0.95 of the edit similarity."""
    return F.greatest(jaccard(name_tokens(a), name_tokens(b)), 0.95 * edit_similarity(a, b))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the words of a normalised text, each padded by two spaces before and one after."""
    words = F.filter(F.split(c, " "), lambda w: w != "")

    def of(w: Column) -> Column:
        padded = F.concat(F.lit("  "), w, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words, of)))


def trigram_similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def street_key(c: Column) -> Column:
    """A normalised street without words such as street, square or floor."""
    pattern = "\\b(" + "|".join(STREET_WORDS) + ")\\b"
    return F.trim(F.regexp_replace(F.regexp_replace(normalize_text(c), pattern, " "), "\\s+", " "))


def clean_field(c: Column) -> Column:
    """Trimmed, white space collapsed, empty to null."""
    value = F.trim(F.regexp_replace(c, "\\s+", " "))
    return F.when(value != "", value)


def decimal_number(c: Column) -> Column:
    """A number that may have a decimal comma; null if it is none."""
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def redact(c: Column) -> Column:
    """Values that look like credentials are replaced."""
    for shape in SECRET_SHAPES:
        c = F.regexp_replace(c, shape, REDACTED.replace("[", "\\[").replace("]", "\\]"))
    return c


def redact_map(c: Column) -> Column:
    """redact for the values of a map; those under secret-like keys go whole."""
    return F.transform_values(c, lambda k, v: F.when(k.rlike(SECRET_KEYS), F.lit(REDACTED)).otherwise(redact(v)))


def excerpt(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)
