"""Text functions, Column to Column.  NFC needs Arrow; all else stays in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Openings of boilerplate lines, name-like capitals, punctuation.
BOILERPLATE = r"(?iumd)^\s*(?:đọc thêm|xem thêm|tags?:|từ khóa:|liên quan:|chia sẻ).*$"
TITLE_CHARS = "A-ZĐÁÀẢÃẠÂẤẦẨẪẬĂẮẰẲẴẶÉÈẺẼẸÊẾỀỂỄỆÍÌỈĨỊÓÒỎÕỌÔỐỒỔỖỘƠỚỜỞỠỢÚÙỦŨỤƯỨỪỬỮỰÝỲỶỸỴ"
SENTENCE_END = r"(?<=[.!?…])(?U:\s+)"
SPACE = r"(?U)\s+"
WORD_CHARS = r"\p{L}\p{N}_"
NUMERIC_EDGES = ".,;:%()[]{}"


def nfc(text: Column) -> Column:
    """Unicode NFC; null stays null.  ASCII texts, which it leaves alone, never reach Python."""

    @F.pandas_udf("string")
    def composed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return F.coalesce(composed(F.when(F.octet_length(text) != F.char_length(text), text)), text)


def normalized(text: Column) -> Column:
    """NFC, boilerplate lines out, white space runs to one space, trimmed; '' for null."""
    plain = F.regexp_replace(nfc(F.coalesce(text, F.lit(""))), BOILERPLATE, "")
    return F.trim(F.regexp_replace(plain, SPACE, " "))


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def stripped(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    """Split after . ! ? … before white space; no empty ones."""
    return F.filter(F.transform(F.split(stripped(F.coalesce(text, F.lit(""))), SENTENCE_END), stripped), lambda s: s != "")


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"([{WORD_CHARS}\u00C0-\u1EF9]+)"), 1)


def lower_tokens(text: Column) -> Column:
    return F.transform(word_tokens(text), F.lower)


def truncate_words(text: Column, most: int) -> Column:
    found = words(text)
    return F.when(F.size(found) <= most, stripped(F.coalesce(text, F.lit("")))).otherwise(F.array_join(F.slice(found, 1, most), " "))


def truncate_chars(text: Column, most: int = 6000) -> Column:
    """At most ``most`` code points, back to the last space, with a mark; null gives ''."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(F.length(whole) > most, F.concat(F.regexp_replace(F.substr(whole, F.lit(1), F.lit(most)), r"(?s) [^ ]*$", ""), F.lit(" […]"))).otherwise(whole)


def render_prompt(template: str, *, title: Column, category: Column, source: Column, content: Column, most: int = 6000) -> Column:
    """The template with its four fields filled in; nulls give ''.  Doubled braces become single ones."""
    filled = {"title": F.coalesce(title, F.lit("")), "category": F.coalesce(category, F.lit("")), "source": source, "content_text": truncate_chars(content, most)}
    pieces, rest = [], template
    while rest:
        at = min((i for i in (rest.find("{" + k + "}") for k in filled) if i >= 0), default=-1)
        if at < 0:
            pieces.append(F.lit(rest.format()))
            break
        name = rest[at + 1 : rest.index("}", at)]
        pieces += [F.lit(rest[:at].format()), filled[name]]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*pieces)


def collapse_punctuation(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)[\s\-–—.,;:()\[\]{}/]+", " "))


def numeric_tokens(text: Column) -> Column:
    """Runs of non-space with a digit, punctuation stripped from their ends; repeats stay."""
    found = F.regexp_extract_all(text, F.lit(r"((?U)\S*\d\S*)"), 1)
    return F.filter(F.transform(found, lambda t: F.btrim(t, F.lit(NUMERIC_EDGES))), lambda t: t != "")


def digit_groups(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\d{3,})"), 1)


def entities(text: Column) -> Column:
    """Runs of two or more title-cased words, first occurrence of each."""
    word = rf"[{TITLE_CHARS}][{WORD_CHARS}\u00C0-\u1EF9]*"
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"({word}(?:(?U:\s+){word})+)"), 1))


def source_text(title: Column, content: Column) -> Column:
    return F.concat_ws(" ", F.nullif(title, F.lit("")), F.nullif(content, F.lit("")))


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")


def to_utc(text: Column) -> Column:
    """A timestamp from ISO-8601 or RFC-822 text, UTC if it names no zone; null if it is neither."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3,9},\s*", "")
    formats = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]xx", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss[XXX]", "yyyy-MM-dd", "d MMM yyyy HH:mm:ss xx", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss")
    return F.coalesce(*(F.try_to_timestamp(bare, F.lit(f)) for f in formats))


def first_date(*candidates: Column) -> Column:
    """The first that is neither null nor empty, as a timestamp."""
    return to_utc(F.coalesce(*(F.nullif(c, F.lit("")) for c in candidates)))
