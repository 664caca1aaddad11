"""Caption, docket, name and id functions, all ``Column -> Column``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words dropped from captions, and replacements made before, in this order.
STOPWORDS = [
    "appellant", "appellee", "petitioner", "respondent", "defendant", "plaintiff", "appeal", "intervenor", "movant", "united", "states", "of", "america",
    "the", "et", "al", "and", "a", "an", "as", "ex", "rel", "for", "its", "etal", "department", "dept", "district", "commonwealth", "people", "state",
    "in", "re", "debtor", "business", "appellants", "enterprise", "hereafter", "hereinafter", "successor", "trustee", "trustees", "plaintiffs",
    "defendants", "partners", "partnership", "partnerships", "associates", "association", "associations", "others", "incorporated", "matter",
]
REPLACEMENTS = [
    (r"\bh/?w\b", "spouse"), (r"\bhis wife\b", "spouse"), (r"\bhusband\b", "spouse"), (r"\bwife\b", "spouse"), (r"\bcompany\b", "corp"),
    (r"\bcorporation\b", "corp"), (r"\bco\b", "corp"), (r"\binc\.?\b", "corp"), (r"\bltd\.?\b", "corp"), (r"\bllc\.?\b", "corp"), ("&", "and"),
]
#: ASCII letters and digits, and marks between words that no replacement takes.
PLAIN = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 "
MARKS = "-#,.'()"
CONNECTOR = r"\b(vs?\.?)\b"
SPLIT_CONNECTOR = r"(?i)^(.*)\s+(?:v(?:\.|s\.?)?|versus)\s+(.*)$"
DOCKET_TAG = r"\b[Nn]os?\.\s*"
DOCKET_BLOCK = r"\b[Nn]os?\.\s*[A-Za-z0-9\-_/\. ,;]+"
NAME_TITLES = ["judge", "chief", "circuit", "district", "magistrate", "senior", "acting", "visiting", "bankruptcy"]
NAME_SUFFIXES = ["jr", "sr", "ii", "iii", "iv", "v"]
ROMAN = r"(?i)^(?=[MDCLXVI])M{0,4}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"
ORDINALS = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh"]

_EMPTY = "array<string>"


def strip(c: Column) -> Column:
    """Without white space (of any script) at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Every run of white space as one space."""
    return F.regexp_replace(c, r"(?U)\s+", " ")


def normalize_caption(name: Column) -> Column:
    """Caption for fuzzy matching: connector, punctuation and stopwords go; null and blank give ''."""
    given = F.coalesce(name, F.lit(""))
    words = F.filter(F.split(F.translate(F.lower(given), MARKS, " " * len(MARKS)), " "), lambda t: ~t.isin(["", "v", "vs", *STOPWORDS]))
    same = lambda t: F.when(t.isin("company", "corporation", "co", "inc", "ltd", "llc"), "corp").when(t.isin("hw", "husband", "wife"), "spouse").otherwise(t)
    # Other characters, or a replacement that could run into the next word (translate is far quicker than a class of characters).
    unusual = (F.translate(given, PLAIN + MARKS, "") != "") | given.rlike(r"\.[A-Za-z0-9]") | F.contains(F.lower(given), F.lit("his wife"))
    return F.when(unusual, normalize_any(given)).otherwise(F.array_join(F.transform(words, same), " "))


def normalize_any(name: Column) -> Column:
    """``normalize_caption`` for any text, replacement by replacement."""
    x = F.regexp_replace(F.lower(name), "(?U)" + CONNECTOR, " ")
    for pattern, by in REPLACEMENTS:
        x = F.regexp_replace(x, "(?U)" + pattern, by)
    x = F.regexp_replace(x, r"(?U)[^\w\s]", " ")
    return F.array_join(F.filter(F.split(x, r"(?U)\s+"), lambda t: (t != "") & ~t.isin(STOPWORDS)), " ")


def split_caption(name: Column) -> Column:
    """``struct(left, right)`` around the rightmost connector, lower case; both null if there is none."""
    plain = ~name.rlike(r"[^\x21-\x7E ]|  ")
    s = F.when(plain, F.trim(name)).otherwise(collapse(strip(name)))
    sides = F.transform(F.array(s), lambda x: F.struct(*(F.trim(F.lower(F.regexp_extract(x, SPLIT_CONNECTOR, i))).alias(side) for i, side in enumerate(("left", "right"), 1))))
    none = F.lit(None).cast("string")
    return F.coalesce(F.get(F.filter(sides, lambda p: (p["left"] != "") & (p["right"] != "")), F.lit(0)), F.struct(none.alias("left"), none.alias("right")))


def docket_tokens(s: Column) -> Column:
    """Docket numbers of a docket field, upper case; null and blank give []."""
    parts = F.split(F.regexp_replace(s, "(?U)" + DOCKET_TAG, ""), r"(?U)[,;/\s]+")
    clean = F.transform(parts, lambda p: F.upper(F.regexp_replace(F.translate(p, "–—", "--"), r"[^A-Za-z0-9\-/.]+", "")))
    return F.coalesce(F.filter(clean, lambda p: p != ""), F.array().cast(_EMPTY))


def first_dockets(text: Column) -> Column:
    """Docket numbers of the first block introduced by 'No.' or 'Nos.' in a text."""
    return docket_tokens(F.regexp_extract(text, "(?U)" + DOCKET_BLOCK, 0))


def judge_needles(raw: Column) -> Column:
    """Distinct names to look for: last names and 'first last', without titles, suffixes and Roman numerals."""
    parts = F.split(F.regexp_replace(raw, r"(?iU)\band\b", ","), r"[;,\n]+")

    def names(part: Column) -> Column:
        tokens = F.filter(F.regexp_extract_all(part, F.lit("[A-Za-z]+"), F.lit(0)), lambda t: ~F.lower(t).isin(NAME_TITLES + NAME_SUFFIXES) & ~t.rlike(ROMAN))
        last = F.get(tokens, F.size(tokens) - 1)
        none = F.array().cast(_EMPTY)
        return F.when(F.size(tokens) >= 2, F.array(last, F.concat_ws(" ", F.get(tokens, F.lit(0)), last))).when(F.size(tokens) == 1, F.array(last)).otherwise(none)

    return F.coalesce(F.array_distinct(F.flatten(F.transform(parts, names))), F.array().cast(_EMPTY))


def contains_any(text: Column, needles: Column) -> Column:
    """Whether any needle occurs: one word as a whole word, several as a substring; null or blank text has none."""
    low = F.lower(text)

    def hit(n: Column) -> Column:
        m = F.lower(strip(n))
        return (m != "") & F.when(m.contains(" "), F.contains(low, m)).otherwise(F.rlike(low, F.concat(F.lit(r"(?U)\b\Q"), m, F.lit(r"\E\b"))))

    return F.coalesce(F.exists(needles, hit), F.lit(False))


def norm_id(x: Column) -> Column:
    """Id as text; '12.0' becomes '12'."""
    s = strip(x.cast("string"))
    whole = s.try_cast("double").try_cast("bigint").cast("string")
    return F.when(s.endswith(".0"), F.coalesce(whole, s)).otherwise(s)


def to_long(x: Column) -> Column:
    """Whole number, or null for anything else that cannot be read as a number."""
    return x.cast("string").try_cast("double").try_cast("bigint")


def to_time(x: Column) -> Column:
    """Date or time of a date, time or text column; null for what cannot be read as one."""
    return x.cast("string").try_cast("timestamp")


def canon(s: Column) -> Column:
    """Only the letters a-z, lower case; null gives ''."""
    return F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), "[^a-z]", "")


def infer_circuit(court: Column) -> Column:
    """Ordinal of the circuit named by an appellate court, or null."""
    s = canon(court)
    court_of_appeals = s.contains("circuit") | s.contains("ctappeals") | s.contains("courtofappeals")
    out = F.lit(None).cast("string")
    for name in reversed(ORDINALS):
        out = F.when(s.contains(name) & court_of_appeals, F.lit(name)).otherwise(out)
    return out


def norm_circuit(c: Column) -> Column:
    """'3rd' as 'ca3'; raises where there is no digit."""
    digits = F.regexp_replace(c, r"[^0-9]", "")
    return F.when(digits != "", F.concat(F.lit("ca"), digits)).otherwise(F.raise_error(F.concat(F.lit("not a numbered circuit: "), F.coalesce(c, F.lit("null")))))


def norm_string(s: Column) -> Column:
    """Trimmed, lower case, white space collapsed."""
    plain = ~s.rlike(r"[^\x21-\x7E ]|  ")  # printable ASCII with single blanks, as nearly all are
    return F.when(plain, F.lower(F.trim(s))).otherwise(collapse(F.lower(strip(s))))


def to_list(v: Column, is_array: bool = False) -> Column:
    """List from an array (as it is), a bracketed text or a comma list; null gives []."""
    none = F.array().cast(_EMPTY)
    if is_array:
        return F.coalesce(v, none)
    s = strip(v)
    bare = F.filter(F.transform(F.split(s, ","), strip), lambda t: t != "")
    inner = F.regexp_replace(s, r"^[\[(]|[\])]$", "")
    quoted = F.filter(F.transform(F.split(inner, ","), lambda t: F.regexp_replace(strip(t), r"^['\"]|['\"]$", "")), lambda t: t != "")
    return F.coalesce(F.when(s.rlike(r"^\[.*\]$|^\(.*\)$"), quoted).otherwise(bare), none)


def strip_honorifics(s: Column) -> Column:
    """Name without 'Honorable' and 'Hon.', trimmed of blanks and punctuation."""
    x = F.regexp_replace(strip(s), r"(?iU)\b(?:the\s+)?honorable\b|^hon\.?\s*", "")
    return F.btrim(collapse(x), F.lit(" ,;."))


def split_name(full: Column) -> Column:
    """``struct(first, last)`` of a name, suffixes dropped; '' where there is none."""
    tokens = F.regexp_extract_all(strip_honorifics(full), F.lit(r"[A-Za-z][A-Za-z'.\-]*"), F.lit(0))
    is_suffix = lambda t: F.lower(F.rtrim(t, F.lit("."))).isin(NAME_SUFFIXES)
    # tokens up to the last one that is no suffix
    kept = F.filter(tokens, lambda t, i: F.exists(F.slice(tokens, i + 1, F.size(tokens)), lambda u: ~is_suffix(u)))
    at = lambda i: F.regexp_replace(F.coalesce(F.get(kept, i), F.lit("")), r"\.$", "")
    return F.struct(at(F.lit(0)).alias("first"), at(F.size(kept) - 1).alias("last"))


def truncate_middle(tokens: Column, most: int) -> Column:
    """First and last ``most`` tokens of a longer list."""
    return F.when(F.size(tokens) > most, F.concat(F.slice(tokens, 1, most), F.slice(tokens, -most, most))).otherwise(tokens)
