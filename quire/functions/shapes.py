"""Text shapes: lengths, case, and the heuristics that tell headings, lists and metadata lines apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases and keywords that results depend on.
WORKS = ["also by", "also from", "by the same author", "other books by", "other works by", "works by"]
METADATA = ["base", "book design", "cover art", "copyright", "digital", "edited", "editor", "edition", "epub", "isbn", "original title", "published", "publisher", "release", "rights", "title:", "version"]
CHAPTER_STARTS = ["chapter ", "chap ", "kapitel ", "part ", "del "]
CHAPTER_WORDS = ["afterword", "appendix", "epilogue", "introduction", "preface", "prolog", "prologue"]
CREDIT_STARTS = ["adapted ", "afterword ", "edited ", "illustrated ", "introduction ", "translated ", "with "]
SCENES = ["*", "* * *", "***", "****", "*****"]


def normalized(text: Column) -> Column:
    """White space of any kind as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def all_upper(text: Column) -> Column:
    """At least one letter, and every letter is its own upper case."""
    letters = F.regexp_replace(text, r"[^\p{IsAlphabetic}]", "")
    return (letters != "") & (letters == F.upper(letters))


def short_heading(text: Column) -> Column:
    return (F.char_length(text) <= 120) & (F.size(words(text)) <= 14)


def short_list(text: Column) -> Column:
    return (F.char_length(text) <= 90) & (F.size(words(text)) <= 12)


def category(text: Column) -> Column:
    return F.size(words(text)).between(1, 4) & (F.char_length(text) <= 60) & all_upper(text)


def works_heading(text: Column) -> Column:
    return F.lower(text).rlike("|".join(WORKS))


def metadata_line(text: Column) -> Column:
    low = F.lower(text)
    keyword = low.rlike("|".join(METADATA))
    return keyword | (F.contains(text, F.lit(":")) & (F.char_length(text) <= 100)) | ((F.char_length(text) <= 40) & text.rlike(r"\p{N}") & text.rlike("[-/.:]"))


def chapterish(text: Column) -> Column:
    low = F.lower(text)
    return low.rlike(f"^(?:{'|'.join(CHAPTER_STARTS)})") | low.isin(*CHAPTER_WORDS)


def credit_label(text: Column) -> Column:
    """Of a text in lower case."""
    return (F.char_length(text) <= 80) & (text.rlike(" by|by | from ") | text.rlike(f"^(?:{'|'.join(CREDIT_STARTS)})"))


def scene_break(text: Column) -> Column:
    return text.isin(*SCENES)


def human_size(n: Column) -> Column:
    """Bytes below 1 KB as they are, else KB or MB with one decimal, ties to even."""
    one = lambda x: F.replace(F.format_number(x, 1), F.lit(","), F.lit(""))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.concat(one(n / 1024), F.lit(" KB"))).otherwise(F.concat(one(n / (1 << 20)), F.lit(" MB")))


def numbered(text: Column, prefix: str) -> Column:
    return text.rlike(rf"^{prefix}\p{{N}}")


def local_name(qname: Column) -> Column:
    return F.lower(F.substring_index(qname, ":", -1))


def classes(value: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(value, F.lit(""))), r"(?U)\s+"), lambda c: c != "")


def add_class(value: Column, name: Column) -> Column:
    have = F.filter(F.split(F.coalesce(value, F.lit("")), r"(?U)\s+"), lambda c: c != "")
    return F.array_join(F.when(F.array_contains(have, name), have).otherwise(F.concat(have, F.array(name))), " ")


def any_of(have: Column, names: list[str]) -> Column:
    return F.arrays_overlap(have, F.array(*map(F.lit, names)))


def least_of(have: Column, names: list[str]) -> Column:
    return F.array_min(F.filter(have, lambda c: c.isin(*names)))
