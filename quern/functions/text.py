"""Text expressions. Lengths and offsets count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters or digits of any script.
WORD = r"[\p{L}\p{N}]+"
CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"

#: White space that trimming takes off, line ends included.
WHITE = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def collapse(text: Column) -> Column:
    """Runs of white space of any script as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_for_compare(text: Column) -> Column:
    return F.lower(collapse(text))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def estimate_tokens(text: Column) -> Column:
    """CJK characters, and words that hold none."""
    cjk = F.size(F.regexp_extract_all(text, F.lit(f"({CJK})"), F.lit(1)))
    plain = F.filter(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), lambda w: ~w.rlike(CJK))
    return (cjk + F.size(plain)).cast("long")


def count_words(text: Column) -> Column:
    """Characters from U+4E00 to U+9FFF, and white-space separated words of the rest."""
    han = F.size(F.regexp_extract_all(text, F.lit("([一-鿿])"), F.lit(1)))
    rest = F.size(F.regexp_extract_all(F.regexp_replace(text, "[一-鿿]", " "), F.lit(r"(\S+)"), F.lit(1)))
    return (han + rest).cast("long")


def uuid_shape(digest: Column) -> Column:
    """A version-5-like UUID of the first 16 bytes of a hex SHA-256."""
    variant = F.element_at(F.array(*(F.lit(c) for c in "89ab89ab89ab89ab")), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1)
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def chunk_id(version: Column, ordinal: Column) -> Column:
    return uuid_shape(F.sha2(F.concat(version.cast("string"), F.lit(":"), ordinal.cast("string")), 256))


def extension(filename: Column) -> Column:
    """Lower-cased from the last dot on; empty without one."""
    return F.when(F.instr(filename, ".") > 0, F.lower(F.concat(F.lit("."), F.substring_index(filename, ".", -1)))).otherwise(F.lit(""))


def column_number(letters: Column) -> Column:
    """A is 1, Z 26, AA 27."""
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda n, c: F.when(c == "", n).otherwise(n * 26 + F.ascii(c) - 64)).cast("int")


def column_letters(number: Column, most: int = 3) -> Column:
    """The inverse of column_number, up to `most` letters."""
    out, n = F.lit(""), number.cast("int")
    for _ in range(most):
        rest = (n - 1) % 26
        out = F.when(n > 0, F.concat(F.chr(rest + 65), out)).otherwise(out)
        n = F.when(n > 0, ((n - 1 - rest) / 26).cast("int")).otherwise(F.lit(0))
    return out


def cell_range(row_start: Column, column_start: Column, row_end: Column, column_end: Column) -> Column:
    return F.concat(column_letters(column_start), row_start.cast("string"), F.lit(":"), column_letters(column_end), row_end.cast("string"))


def snippet(text: Column, most: int = 420) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def excerpt(text: Column, most: int = 320) -> Column:
    return F.substring(collapse(text), 1, most)


def safe_filename(name: Column, ordinal: Column) -> Column:
    """The last part of a path, runs of other than word characters, dots and dashes as '_', 160 at most."""
    clean = F.substring(F.regexp_replace(F.substring_index(name, "/", -1), r"[^\w.\-]+", "_"), 1, 160)
    return F.when(clean == "", F.concat(F.lit("asset-"), ordinal.cast("string"))).otherwise(clean)


def source_label(page: Column, slide: Column, sheet: Column, cells: Column, heading: Column) -> Column:
    """The first that is there of page, slide, sheet with its range, heading; else 'document'."""
    return F.coalesce(
        F.concat(F.lit("page "), F.nullif(page, F.lit(0)).cast("string")),
        F.concat(F.lit("slide "), F.nullif(slide, F.lit(0)).cast("string")),
        F.concat(F.lit("sheet "), F.nullif(sheet, F.lit("")), F.coalesce(F.concat(F.lit(" "), cells), F.lit(""))),
        heading,
        F.lit("document"),
    )


def context_prefix(**fields: Column) -> Column:
    """'key: value' lines in the order given, without nulls."""
    return F.concat_ws("\n", *(F.concat(F.lit(f"{k}: "), v.cast("string")) for k, v in fields.items()))


def clean_markdown(text: Column) -> Column:
    """Line feeds only, at most two blank lines in a row, none at the ends."""
    return F.btrim(F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n{4,}", "\n\n\n"), F.lit(WHITE))


def term_score(text: Column, terms: Column) -> Column:
    """How many of the distinct terms the text contains."""
    return F.size(F.filter(F.array_distinct(terms), lambda t: F.contains(F.lower(text), t))).cast("long")


def citations(answer: Column) -> Column:
    """Distinct ordinals of [1], [1, 2] and their full-width forms, in order of appearance."""
    groups = F.regexp_extract_all(answer, F.lit(r"[\[【](\d+(?:\s*[,，、]\s*\d+)*)[\]】]"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, r"\s*[,，、]\s*"), lambda x: x.cast("int")))))


def highlight(text: Column, query: Column, open_: str = "<mark>", close: str = "</mark>", most: int = 8) -> Column:
    """Marks the query's distinct terms of two letters or more, the longest first."""
    terms = F.filter(F.array_distinct(words(query)), lambda t: F.length(t) > 1)
    ordered = F.transform(F.sort_array(F.transform(F.slice(terms, 1, most), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda s: s["t"])
    pattern = F.concat(F.lit("(?i)("), F.array_join(ordered, "|"), F.lit(")"))
    return F.when(F.size(terms) > 0, F.regexp_replace(text, pattern, F.lit(f"{open_}$1{close}"))).otherwise(text)
