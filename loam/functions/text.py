"""Text expressions: tokens, defanging, normal forms, spans and fingerprints. All stay in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed value: ids such as T1059 or T1059.003, inside a text.
TECHNIQUE = r"\bT\d{4}(?:\.\d{3})?\b"
#: The expansions of the ligature code points.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
#: What ends a token of the overlap measure, and the words it leaves out.
OVERLAP_TOKEN, OVERLAP_END = r"[a-z0-9][a-z0-9_\-./]+", ".,;:"
STOP_WORDS = (
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "was", "were", "are", "be", "been",
    "being", "has", "had", "have", "do", "did", "does", "this", "that", "it", "its", "as", "not", "no", "so", "if", "then", "than", "also",
    "which", "who", "when", "where", "what", "how", "more", "some", "through", "during", "after", "before", "between", "into", "over",
    "under", "about", "up", "out", "down", "off",
)


def tokens(text: Column, least: int = 3) -> Column:
    """Distinct runs of at least ``least`` ASCII letters of the lower-cased text; empty for null."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"([a-z]{{{least},}})"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two arrays of distinct values; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def overlap_tokens(text: Column, stop_words: list[str]) -> Column:
    """Distinct tokens of letters, digits and inner signs, without end signs, stop words and those of two characters."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({OVERLAP_TOKEN})"), F.lit(1))
    trimmed = F.transform(found, lambda t: F.regexp_replace(t, r"[.,;:]+$", ""))
    kept = F.filter(trimmed, lambda t: F.length(t) > 2)
    return F.array_distinct(F.array_except(kept, F.array(*map(F.lit, stop_words))) if stop_words else kept)


def support(quote: Column, known: Column, least: int = 4) -> Column:
    """Share of a quote's tokens (four letters or more) among ``known``; null below ``least`` tokens or with nothing known."""
    own = tokens(quote, 4)
    return F.when((F.size(own) >= least) & (F.size(known) > 0), F.size(F.array_intersect(own, known)) / F.size(own))


def trimmed(value: Column) -> Column:
    """Without ASCII white space at either end."""
    return F.regexp_replace(value, r"\A\s+|\s+\z", "")


def refang(value: Column) -> Column:
    """Undo the usual defanging of addresses, ends trimmed; applying it again changes nothing."""
    steps = (
        (r"(?i)\bhxx(?:t?ps)://", "https://"),
        (r"(?i)\bhxx(?:t?p)://", "http://"),
        (r"(?i)\bfxp://", "ftp://"),
        (r"[\[({]\s*\.\s*[\])}]", "."),
        (r"(?i)[\[({]\s*at\s*[\])}]", "@"),
        (r"[\[({]\s*:\s*[\])}]", ":"),
        (r"[\[({]\s*/\s*[\])}]", "/"),
        (r"\\\.", "."),
    )
    value = trimmed(value)
    for pattern, replacement in steps:
        value = F.regexp_replace(value, pattern, replacement)
    return value


def refang_lists(artifacts: Column) -> Column:
    """A map of lists with every value refanged, empty and repeated ones dropped in order, and empty lists dropped."""
    clean = F.transform_values(artifacts, lambda _, v: F.array_distinct(F.filter(F.transform(v, refang), lambda x: x != "")))
    return F.map_filter(clean, lambda _, v: F.size(v) > 0)


def expand_ligatures(text: Column) -> Column:
    for sign, letters in LIGATURES.items():
        text = F.replace(text, F.lit(sign), F.lit(letters))
    return text


def has_watermark(text: Column) -> Column:
    """Whether the last line is one run of at least 80 base64 characters."""
    return F.rlike(text, F.lit(r"\n[A-Za-z0-9+/=_-]{80,}\s*\z"))


def strip_watermark(text: Column) -> Column:
    return F.regexp_replace(text, r"\n[A-Za-z0-9+/=_-]{80,}\s*\z", "")


def tidy_space(text: Column) -> Column:
    """No blanks at line ends, at most one empty line in a row, nothing at either end."""
    text = F.regexp_replace(text, r"[ \t]+(?=\n|\z)", "")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(text, r"\A\s+", ""), r"\s+\z", "")


def one_space(text: Column) -> Column:
    """ASCII white space runs made one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))


def numbered_lines(text: Column) -> Column:
    """Every line after its number and a bar, from 1."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda line, k: F.concat((k + 1).cast("string"), F.lit("| "), line)), "\n")


def normal_command(command: Column) -> Column:
    return F.lower(refang(one_space(command)))


def cve_id(value: Column) -> Column:
    """The first CVE-like id in its written form; null without one."""
    year, number = (F.regexp_extract(value, r"(?i)\bCVE[\s\-_]*(\d{4})[\s\-_]*(\d{4,7})\b", k) for k in (1, 2))
    return F.when(year != "", F.concat(F.lit("CVE-"), year, F.lit("-"), number))


def cve_ids(value: Column) -> Column:
    """All ids written CVE-year-number, upper case, in order of first mention."""
    return F.array_distinct(F.regexp_extract_all(F.upper(F.coalesce(value, F.lit(""))), F.lit(r"(CVE-\d{4}-\d{4,7})"), F.lit(1)))


def technique_ids(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({TECHNIQUE})"), F.lit(1)))


def is_technique_id(value: Column) -> Column:
    return F.coalesce(F.rlike(value, F.lit(r"\AT\d{4}(?:\.\d{3})?\z")), F.lit(False))


def short_hash(text: Column, n: int = 20) -> Column:
    """The first characters of the sha256 of the trimmed, lower-cased text."""
    return F.substring(F.sha2(F.lower(F.trim(text)), 256), 1, n)


def fingerprint(refs: Column, platforms: Column, tactics: Column) -> Column:
    """A behaviour's fingerprint: the same for the same techniques, platforms and tactics in any order."""
    part = lambda a: F.array_join(F.array_sort(a), "|")
    return F.substring(F.sha2(F.concat_ws("::", part(refs), part(platforms), part(F.array_distinct(tactics))), 256), 1, 32)


def hash_kind(value: Column) -> Column:
    """The algorithm that a hexadecimal digest's length tells; null for other lengths."""
    n = F.length(value)
    return F.when(n == 32, "MD5").when(n == 40, "SHA-1").when(n == 64, "SHA-256").when(n == 128, "SHA-512")


#: Fixed value: signs of rule syntax.
RULE_MARKS = (":", "{", "}", "|", "=", "(", ")", "$", "\\", "==", "!=", "->")


def looks_like_rule(content: Column, marks: tuple[str, ...] = RULE_MARKS, longest: int = 120) -> Column:
    """Whether a detection rule's text is a body: several lines, a mark of rule syntax, or long."""
    trimmed = F.trim(content)
    found = F.lit(False)
    for mark in marks:
        found = found | F.contains(trimmed, F.lit(mark))
    return F.coalesce(F.contains(trimmed, F.lit("\n")) | found | (F.length(trimmed) > longest), F.lit(False))


def ellipsis(text: Column, n: int) -> Column:
    """The text, or its first n - 1 characters and an ellipsis."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def safe_name(name: Column) -> Column:
    """A file name with other characters than letters, digits, dots, bars and hyphens made underscores."""
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_")


def extension(name: Column) -> Column:
    """The lower-cased extension without its dot; empty if there is none."""
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def ipv4(value: Column) -> Column:
    """The address in a value, without port or brackets; null if an octet is over 255 or has a leading zero."""
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    found = F.regexp_extract(value, rf"\A\s*\[?({octet}(?:\.{octet}){{3}})\]?(?::\d{{1,5}})?\s*\z", 1)
    return F.when(found != "", found)


def hive(path: Column) -> Column:
    """A registry path with an abbreviated first segment written out."""
    names = {
        "HKLM": "HKEY_LOCAL_MACHINE",
        "HKCU": "HKEY_CURRENT_USER",
        "HKCR": "HKEY_CLASSES_ROOT",
        "HKU": "HKEY_USERS",
        "HKCC": "HKEY_CURRENT_CONFIG",
    }  # fixed values
    out = path
    for short, full in names.items():
        out = F.when(F.rlike(path, F.lit(rf"(?i)\A{short}(?:\\|\z)")), F.concat(F.lit(full), F.substring(path, len(short) + 1, 1 << 20))).otherwise(out)
    return out


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of two unit vectors in double precision; 0 for null, empty or unequal lengths."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    fits = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(fits, F.aggregate(products, F.lit(0.0), lambda s, v: s + v)).otherwise(F.lit(0.0))
