"""Column expressions over text. All run in the row, so none needs a shuffle."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ruleloom import constants as K


def any_of(conds: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, list(conds), F.lit(False))


def alternation(parts: Iterable[str]) -> str:
    """A pattern for any of the literals; one test per row keeps generated code small."""
    return "(?:" + "|".join("\\Q" + p + "\\E" for p in parts) + ")"


def contains_any(value: Column, parts: Iterable[str]) -> Column:
    return value.rlike(alternation(parts)) if parts else F.lit(False)


def count_present(value: Column, parts: Iterable[str]) -> Column:
    """How many of the parts occur at least once."""
    return reduce(lambda a, b: a + b, [value.contains(p).cast("int") for p in parts])


def starts_with_any(value: Column, parts: Iterable[str]) -> Column:
    return value.rlike("^" + alternation(parts)) if parts else F.lit(False)


def ends_with_any(value: Column, parts: Iterable[str]) -> Column:
    return value.rlike(alternation(parts) + r"\z") if parts else F.lit(False)


def count_literal(text: Column, needle: Column | str) -> Column:
    """Non-overlapping occurrences of a literal, by the bytes its removal saves."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    saved = F.octet_length(text) - F.octet_length(F.replace(text, needle, F.lit("")))
    return (saved / F.octet_length(needle)).cast("bigint")


def count_regex(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def ratio(num: Column, den: Column) -> Column:
    """num / den, and 0 where the denominator is 0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num / F.nullif(den, F.lit(0)))


def text_lines(text: Column) -> Column:
    """Lines without their endings; one trailing newline adds no empty line."""
    body = F.regexp_replace(text, r"\r?\n\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.split(body, r"\r?\n")
    )


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(K.TOKEN_RE), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def array_sum(values: Column, as_type: str = "double") -> Column:
    return F.aggregate(values, F.lit(0).cast(as_type), lambda acc, x: acc + x.cast(as_type))


def array_mean(values: Column) -> Column:
    return ratio(array_sum(values), F.size(values))


def array_stddev(values: Column, mean: Column) -> Column:
    """Population standard deviation."""
    squares = F.aggregate(
        values, F.lit(0.0), lambda acc, x: acc + (x.cast("double") - mean) * (x.cast("double") - mean)
    )
    return F.sqrt(ratio(squares, F.size(values)))


def count_where(values: Column, test) -> Column:
    return F.size(F.filter(values, test)).cast("bigint")


def char_counts(text: Column) -> Column:
    """array<struct<ch, n>> of distinct characters and their counts.

    Each distinct character costs one byte scan of the text, which beats exploding
    one row per character and needs no shuffle.
    """
    return F.transform(
        F.array_distinct(F.split(text, "")),
        lambda c: F.struct(c.alias("ch"), count_literal(text, c).alias("n")),
    )


def entropy_of_counts(counts: Column, total: Column) -> Column:
    return F.aggregate(
        counts,
        F.lit(0.0),
        lambda acc, x: acc - (x["n"] / total) * F.log2(x["n"] / total),
    )


def char_entropy(text: Column) -> Column:
    """Shannon entropy in bits per character; 0 for empty text."""
    return F.when(text == "", F.lit(0.0)).otherwise(
        entropy_of_counts(char_counts(text), F.char_length(text))
    )


def entropy_level(entropy: Column) -> Column:
    return (
        F.when(entropy < 4.0, "very_low")
        .when(entropy < 6.0, "normal")
        .when(entropy < 7.2, "elevated")
        .otherwise("high")
    )


# -- string classes -----------------------------------------------------------------


def is_base64_like(s: Column) -> Column:
    return (
        (F.octet_length(s) >= 16)
        & (F.octet_length(s) % 4 == 0)
        & s.rlike(r"^[A-Za-z0-9+/=]+$")
        & s.rlike("[A-Z]")
        & s.rlike("[a-z]")
        & (~s.contains("=") | s.endswith("="))
    )


def is_hex_like(s: Column) -> Column:
    return (
        (F.octet_length(s) >= 8)
        & (F.octet_length(s) % 2 == 0)
        & s.rlike(r"^(0[xX])?[0-9a-fA-F]*$")
    )


def is_url_encoded(s: Column) -> Column:
    """More than three %XX escapes; one that ends the string needs no follow-up."""
    return F.regexp_count(s, F.lit("%[0-9a-fA-F]{2}")) > 3


def is_escape_heavy(s: Column) -> Column:
    n = count_literal(s, "\\u") + count_literal(s, "\\x") + count_literal(s, "&#x")
    return (n + count_literal(s, "&#")) >= 5


def is_url(s: Column) -> Column:
    return s.rlike(r"^(?i)(https?|ftp|file|wss?)://")


def is_file_path(s: Column) -> Column:
    return (
        (s.startswith("/") & (F.octet_length(s) > 1) & ~s.startswith("//"))
        | s.rlike(r"^[A-Za-z]:[\\/]")
        | starts_with_any(s, ("./", "../", "~"))
        | contains_any(s, ("/bin/", "/etc/", "/tmp/", "/var/"))
        | contains_any(s, ("\\Windows\\", "\\System32\\", "\\AppData\\"))
    )


def is_ip_address(s: Column) -> Column:
    part = r"\+?0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    quad = s.rlike(rf"^({part}\.){{3}}{part}$")
    colons = count_literal(s, ":")
    return quad | (s.rlike("^[0-9a-fA-F:]+$") & colons.between(2, 7))


def is_email(s: Column) -> Column:
    domain = F.substring_index(s, "@", -1)
    return (
        (F.octet_length(s) >= 5)
        & (count_literal(s, "@") == 1)
        & ~s.startswith("@")
        & domain.contains(".")
        & ~domain.startswith(".")
        & ~domain.endswith(".")
    )


def is_domain(s: Column) -> Column:
    return s.rlike("^[A-Za-z0-9.-]+$") & ends_with_any(F.lower(s), K.DOMAIN_TLDS)


def has_embedded_code(s: Column) -> Column:
    return contains_any(F.lower(s), K.EMBEDDED_CODE_MARKERS)


def has_shell_command(s: Column) -> Column:
    return contains_any(F.lower(s), K.SHELL_MARKERS)


def has_sql(s: Column) -> Column:
    """At least two markers; they are only counted in strings that hold one."""
    any_marker = s.rlike("(?i)" + alternation(K.SQL_MARKERS))
    return F.when(any_marker, count_present(F.upper(s), K.SQL_MARKERS) >= 2).otherwise(F.lit(False))


def is_script_text(s: Column) -> Column:
    return contains_any(s, K.SCRIPT_MARKERS) | starts_with_any(s, K.SCRIPT_SHEBANGS)


def is_path_shaped(s: Column) -> Column:
    known = ("/bin/", "/usr/", "/etc/", "/tmp/", "/var/", "C:\\", "Program")
    return (
        s.startswith("/")
        | ((F.octet_length(s) > 3) & s.rlike(r"^(?s).:\\"))
        | ((s.contains("/") | s.contains("\\")) & ~s.contains(" ") & contains_any(s, known))
    )


def is_real_ip(s: Column) -> Column:
    """Holds a dotted quad with valid octets that is not part of a version string."""
    first = F.regexp_extract(s, K.IP_RE, 0)
    return (
        (first != "")
        & ~s.rlike(K.VERSION_IP_RE)
        & F.forall(F.split(first, r"\."), lambda o: F.coalesce(o.try_cast("int"), F.lit(999)) <= 255)
    )


def string_kind(s: Column) -> Column:
    """First match wins; symbols are looked up by the caller before this."""
    return (
        F.when(s.rlike(K.URL_RE), "url")
        .when(is_real_ip(s), "ip")
        .when(s.rlike(K.EMAIL_RE), "email")
        .when(is_path_shaped(s), "path")
        .when((F.octet_length(s) >= 16) & s.rlike(K.BASE64_RE), "base64")
        .otherwise("const")
    )


def preview(s: Column) -> Column:
    """First 40 bytes of printable text on one line, else a marker."""
    head = F.substring(s, 1, 40)
    flat = F.replace(F.replace(head, F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(""))
    return F.when(head.rlike(r"^[\x20-\x7E\n\r\t]*$"), flat).otherwise("<binary data>")


# -- names --------------------------------------------------------------------------


def normalize_symbol(s: Column) -> Column:
    """The name without prefixes; most have none, which costs no regex."""
    prefixed = s.startswith("sym.") | s.startswith("fcn.") | s.startswith("_")
    return F.when(prefixed, F.regexp_replace(s, r"^(?:sym\.imp\.)*(?:sym\.)*(?:fcn\.)*_*", "")).otherwise(s)


def normalize_import_name(s: Column) -> Column:
    """Lower case; a run of separators keeps its first one; one trailing is dropped."""
    lowered = F.regexp_replace(F.lower(s), r"^[^a-z0-9_]+", "")
    marked = F.regexp_replace(lowered, r"[./][^a-z0-9_]*", "/")
    marked = F.regexp_replace(marked, r"[^a-z0-9_/][^a-z0-9_]*", "-")
    return F.regexp_replace(marked, "[/-]$", "")


def file_extension(path: Column) -> Column:
    base = F.substring_index(path, "/", -1)
    return F.when(base.rlike(r"^.+\.[^.]*$"), F.substring_index(base, ".", -1))


def normalized_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(
        F.lit(1.0) - F.levenshtein(a, b) / F.nullif(longest, F.lit(0))
    )
