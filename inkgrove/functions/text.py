"""Column expressions over text that Catalyst can compile, with the traps of Java regexes and trims taken care of."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Function words that carry no meaning in a query, Indonesian then English, in natural order.
STOPWORDS = (
    "yang dan di ke dari untuk dengan pada ini itu atau adalah juga ada tidak gak nggak bisa akan sudah udah dalam saja aja "
    "apa bagaimana gimana kenapa mengapa kapan dimana mana siapa nya lalu jadi karena kalau kalo agar supaya oleh sebagai tentang cara "
    "the a an and or of to in on for with is are was were be it this that how what why when where which who do does "
    "can i my we you about from by as at"
).split()


def _icu(cls: str, method: str, col: Column, flag: bool) -> Column:
    """A static text method of the ICU library, which Spark itself brings for its collations."""
    return F.reflect(F.lit(cls), F.lit(method), col, F.lit(flag))


def composed(col: Column) -> Column:
    """Unicode normal form C. Call it for strings beyond ASCII only, which ``beyond_ascii`` selects."""
    return _icu("com.ibm.icu.text.Normalizer", "compose", col, False)


def decomposed(col: Column) -> Column:
    """Unicode normal form D; see ``composed``."""
    return _icu("com.ibm.icu.text.Normalizer", "decompose", col, False)


def case_folded(col: Column) -> Column:
    """Full Unicode case folding; see ``composed``."""
    return _icu("com.ibm.icu.lang.UCharacter", "foldCase", col, True)


def beyond_ascii(col: Column) -> Column:
    return col.rlike(r"[^\x00-\x7F]")


def fold(col: Column) -> Column:
    """Lower case without diacritics, all in the JVM; ASCII strings, the common case, are only lowered."""
    return F.when(beyond_ascii(col), composed(F.regexp_replace(decomposed(F.lower(col)), r"\p{Mn}+", ""))).otherwise(F.lower(col))


def tokens(folded: Column) -> Column:
    """Runs of letters and digits of a folded text; null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(folded, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), F.array().cast("array<string>"))


def strip(col: Column) -> Column:
    """Without white space of any kind at both ends (``trim`` knows only the space)."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def split_lines(col: Column) -> Column:
    """Lines as an editor counts them: every Unicode line break separates, a final break opens no further line; '' has none."""
    brk = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
    return F.when(col == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(col, rf"(?:{brk})\z", ""), brk, -1))


def cut(col: Column, most: int) -> Column:
    """At most ``most`` characters, with ``...`` where something was cut."""
    return F.when(F.length(col) > most, F.concat(F.substring(col, 1, most), F.lit("..."))).otherwise(col)


def csv_values(value: str) -> list[str]:
    """Comma-separated filter values: trimmed, without leading ``#``, lower case, empty ones dropped."""
    return [v for v in (p.strip().lstrip("#").lower() for p in value.split(",")) if v]


def query_terms(col: Column) -> Column:
    """Terms of a keyword query: other characters than letters, digits, ``_`` and ``-`` separate; marks at the ends go;
    function words go unless nothing else is there. A repeated term stays repeated."""
    words = F.filter(F.transform(F.split(F.regexp_replace(col, r"[^\p{L}\p{N} _\-]", " "), " +"), lambda t: F.regexp_replace(t, r"^[-_]+|[-_]+$", "")), lambda t: t != "")
    content = F.filter(words, lambda t: ~F.lower(t).isin(STOPWORDS))
    return F.when(F.size(content) > 0, content).otherwise(words)


def occurrences(text: Column, part: str) -> Column:
    """How often ``part`` stands in ``text``, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / F.lit(len(part))).cast("bigint")
