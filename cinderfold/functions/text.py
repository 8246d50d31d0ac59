"""Column functions on text. All but NFKD are built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What Python's str.strip, str.split and \\s take for white space, as Java and RE2 character classes. Fixed values.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
NOT_SPACE = "[^" + SPACE[1:]
SPACE_RE2 = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_SPACE_RE2 = "[^" + SPACE_RE2[1:]
CVE_YEAR = r"CVE-(\d{4})-\d+"


@F.arrow_udf(StringType())
def nfkd(text: pa.Array) -> pa.Array:
    """Compatibility decomposition, which Spark's catalogue lacks; a whole Arrow batch at a time."""
    import pyarrow.compute as pc

    return pc.utf8_normalize(text, form="NFKD")


def _drop(c: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(by))


def clean_ascii(c: Column) -> Column:
    """clean_text() for text that is decomposed already."""
    c = _drop(c, r"[^\n\t\x20-\x7e]")
    c = _drop(c, r"\n{3,}", "\n\n")
    c = _drop(c, r"(?m)^[ \t]+|[ \t]+$")
    return _drop(_drop(c, " {2,}", " "), r"\A[ \t\n]+|[ \t\n]+\z")


def clean_text(c: Column) -> Column:
    """Decompose, keep printable ASCII, tab and newline, at most one blank line, stripped lines, single spaces."""
    return clean_ascii(nfkd(F.coalesce(c, F.lit(""))))


def strip(c: Column) -> Column:
    return _drop(c, rf"\A{SPACE}+|{SPACE}+\z")


def normal_form(c: Column) -> Column:
    """Stripped, lower-cased, white space runs as one space: equal for texts that count as copies. Null is empty."""
    return _drop(F.lower(strip(F.coalesce(c, F.lit("")))), f"{SPACE}+", " ")


def content_hash(c: Column) -> Column:
    return F.md5(normal_form(c).cast("binary"))


def hash_bucket(digest: Column, buckets: int = 100) -> Column:
    """A 128-bit hex digest modulo `buckets`, from its two 64-bit halves."""
    half = lambda start: F.conv(F.substring(digest, start, 16), 16, 10).cast("decimal(20,0)") % buckets
    return F.pmod(half(1) * F.lit(pow(2, 64, buckets)) + half(17), F.lit(buckets)).cast("int")


def is_validation(bucket: Column, share: float = 0.05, buckets: int = 100) -> Column:
    """Below the rounded share of buckets, which is at least one."""
    return bucket < max(1, round(share * buckets))


#: Least length of the cleaned texts of a source; whether more than the second is dropped, or cut at the third. Fixed values.
LENGTHS = {"nvd": (50, None, None), "arxiv": (100, None, None), "mitre_attack": (100, None, None), "capec": (100, None, None), "cwe": (100, None, None), "owasp": (100, None, None), "ctf": (200, None, None), "exploitdb": (100, 8000, None), "ctf_repo": (200, None, 12000)}


def cve_year(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, CVE_YEAR, 1), F.lit("")).cast("int")


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def words(c: Column) -> Column:
    """Lower-cased runs of what isn't white space."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"{NOT_SPACE}+"), F.lit(0))


def alphabetic(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[A-Za-z]+"), F.lit(0)), F.lower)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once a row, however often body names it, inner functions included."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def runs(tokens: Column, k: int) -> Column:
    """All runs of k tokens, space-joined, in order; none below k tokens."""

    def of(t: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(t, i, k), " "))
        return F.when(F.size(t) >= k, every).otherwise(F.array().cast("array<string>"))

    return bind(tokens, of)


def shingles(tokens: Column, k: int = 4) -> Column:
    """The set of runs of k tokens."""
    return F.array_distinct(runs(tokens, k))


def is_empty(c: Column) -> Column:
    """Whether nothing is left of a text once it is stripped; null is empty."""
    return strip(F.coalesce(c, F.lit(""))) == ""


def within(c: Column, least: int, most: int | None = None, cut: int | None = None) -> Column:
    """The cleaned text if it has at least `least` and at most `most` characters, cut to `cut`; null if it is dropped."""
    return within_clean(clean_text(c), least, most, cut)


def within_clean(c: Column, least: int, most: int | None = None, cut: int | None = None) -> Column:
    """within() for text that is clean already."""

    def of(t: Column) -> Column:
        kept = F.length(t) >= least
        if most is not None:
            kept = kept & (F.length(t) <= most)
        return F.when(kept, t if cut is None else F.substring(t, 1, cut))

    return bind(c, of)


def est_tokens(chars: Column) -> Column:
    """Four characters a token, of a sum of characters."""
    return F.floor(chars / 4).cast("long")


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty; the last as it is."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns[:-1]], columns[-1])


def strip_prompt(output: Column, prompt: Column) -> Column:
    """Output without the prompt that it repeats at its start, stripped."""
    return strip(F.when(F.startswith(output, prompt), F.substring(output, F.length(prompt) + 1, F.length(output))).otherwise(output))


def english_or_first(descriptions: Column) -> Column:
    """value of the first English description if filled, else of the first."""
    english = F.try_element_at(F.filter(descriptions, lambda d: d["lang"] == "en"), F.lit(1))["value"]
    return F.coalesce(F.nullif(english, F.lit("")), F.try_element_at(descriptions, F.lit(1))["value"])
