"""Text normalisation, validation and assembly as column expressions.

Only Unicode composition needs Python (an Arrow UDF, and only for texts that are not
ASCII); everything else stays in generated code.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sequences that UTF-8 text read as a Western single-byte encoding leaves behind.
MOJIBAKE = r"(?:Ã[\x80-\xBF§©®±¼½¾]|Â[\x80-\xBF]|â(?:€|™|œ|ž|€“|€”|€™)|ðŸ|ï¿½)"
MOJIBAKE_FLAG = "suspicious_mojibake"
REPLACEMENT_ERROR = "U+FFFD replacement character is not allowed"
NOT_TEXT_ERROR = "text must be a Unicode string decoded as UTF-8"
CONTROL_ERROR = "disallowed control character U+"

# Words whose presence speaks for English, and the letters that speak for Vietnamese.
ENGLISH_MARKERS = (
    "the", "of", "and", "in", "to", "for", "with", "from", "city", "state",
    "university", "software", "language", "organization", "capital", "located",
)
VIETNAMESE_LETTERS = (
    "ăâđêôơưĂÂĐÊÔƠƯáàảãạấầẩẫậắằẳẵặéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ"
    "ÁÀẢÃẠẤẦẨẪẬẮẰẲẴẶÉÈẺẼẸẾỀỂỄỆÍÌỈĨỊÓÒỎÕỌỐỒỔỖỘỚỜỞỠỢÚÙỦŨỤỨỪỬỮỰÝỲỶỸỴ"
)

_NOT_ASCII = r"[^\x00-\x7F]"


@F.pandas_udf(T.StringType())
def _compose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _compose_each(arrays: pd.Series) -> pd.Series:
    def one(xs):
        return None if xs is None else [None if x is None else unicodedata.normalize("NFC", x) for x in xs]

    return arrays.map(one)


def nfc(c: Column) -> Column:
    """Canonical composition; ASCII texts do not pass through Python."""
    return F.coalesce(_compose(F.when(c.rlike(_NOT_ASCII), c)), c)


def nfc_each(c: Column) -> Column:
    """Canonical composition of each string of an array."""
    return F.coalesce(_compose_each(F.when(F.exists(c, lambda x: x.rlike(_NOT_ASCII)), c)), c)


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """White space of any kind and number becomes one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalized(c: Column) -> Column:
    """Composed, with single blanks."""
    return squeeze(nfc(c))


def text_error(c: Column) -> Column:
    """Why a text is refused, or null: a replacement character, or the first control but tab and line ends."""
    control = F.regexp_extract(c, r"([\p{Cc}&&[^\t\n\r]])", 1)
    return F.when(c.contains("�"), REPLACEMENT_ERROR).when(
        control != "", F.concat(F.lit(CONTROL_ERROR), F.lpad(F.hex(F.ascii(control)), 4, "0"))
    )


def first_error(c: Column) -> Column:
    """The first error of an array of texts; a null entry is no text."""
    errors = F.transform(c, lambda x: F.when(x.isNull(), F.lit(NOT_TEXT_ERROR)).otherwise(text_error(x)))
    return F.get(F.filter(errors, lambda e: e.isNotNull()), F.lit(0))


def is_mojibake(c: Column) -> Column:
    return c.rlike(MOJIBAKE)


def normalized_each(c: Column) -> Column:
    """Each text normalised, empty ones and repetitions dropped, the order kept; null becomes empty."""
    texts = F.filter(F.transform(nfc_each(c), squeeze), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.array_distinct(texts), F.array().cast("array<string>"))


def estimated_tokens(c: Column) -> Column:
    """A quarter of the characters, rounded up, at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.char_length(c) / 4)).cast("bigint")


def looks_english(c: Column) -> Column:
    """Whether a text in a Vietnamese field seems English: no Vietnamese letter, four words, two markers."""
    words = F.transform(F.regexp_extract_all(c, F.lit("([A-Za-z]+)"), 1), F.lower)
    markers = F.filter(words, lambda w: w.isin(*ENGLISH_MARKERS))
    return F.coalesce(
        (c != "") & ~c.rlike(f"[{VIETNAMESE_LETTERS}]") & (F.size(words) >= 4) & (F.size(markers) >= 2), F.lit(False)
    )


def document(label: Column, description: Column, aliases: Column) -> Column:
    """``Label. Description. Aliases: a; b.``; null without a label."""
    parts = F.concat_ws(
        " ",
        F.concat(label, F.lit(".")),
        F.when(description != "", F.concat(description, F.lit("."))),
        F.when(F.size(aliases) > 0, F.concat(F.lit("Aliases: "), F.array_join(aliases, "; "), F.lit("."))),
    )
    return F.when(label != "", parts)


def index_text(document_en: Column, document_vi: Column) -> Column:
    """What is embedded of a record; null where both documents are missing."""
    en = F.when(document_en != "", F.concat(F.lit("English: "), document_en))
    vi = F.when(document_vi != "", F.concat(F.lit("Vietnamese: "), document_vi))
    return F.nullif(F.concat_ws("\n", en, vi), F.lit(""))


def instructed(text: Column, is_query: Column, instruction: str) -> Column:
    """Queries are embedded behind an instruction, documents are not."""
    return F.when(is_query, F.concat(F.lit(instruction), text)).otherwise(text)


def tunnel_url(c: Column) -> Column:
    """The first quick-tunnel address in a text, or null."""
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"(https://[a-z0-9-]+\.trycloudflare\.com\b)", 1), F.lit(""))
