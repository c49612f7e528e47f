"""Text clean-up as column expressions; every function here is row-local and runs in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.config import WATCH_URL
from lectern.functions.repeats import collapse_repeats

# The default English stop words; results depend on exactly this list.
STOP_WORDS = (
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are", "as", "at",
    "be", "because", "been", "before", "being", "below", "between", "both", "but", "by", "can", "did",
    "do", "does", "doing", "down", "during", "each", "few", "for", "from", "further", "had", "has", "have",
    "having", "he", "her", "here", "hers", "herself", "him", "himself", "his", "how", "i", "if", "in",
    "into", "is", "it", "its", "itself", "just", "me", "more", "most", "my", "myself", "no", "nor", "not",
    "now", "of", "off", "on", "once", "only", "or", "other", "our", "ours", "ourselves", "out", "over",
    "own", "s", "same", "she", "should", "so", "some", "such", "t", "than", "that", "the", "their",
    "theirs", "them", "themselves", "then", "there", "these", "they", "this", "those", "through", "to",
    "too", "under", "until", "up", "very", "was", "we", "were", "what", "when", "where", "which", "while",
    "who", "whom", "why", "will", "with", "you", "your", "yours", "yourself", "yourselves",
)

# Unicode White_Space, written out so that every regex dialect reads it the same way.
WIDE_SPACE = r"\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACE = r" \x09-\x0D" + WIDE_SPACE
# What counts as markup and as a colour code. Decimal digits are written as a Unicode class,
# as the JVM's \d knows the ASCII ones only.
MARKUP = "<[^>]+>"
COLOUR_CODE = r"c\p{Nd}+c?"


def strip_markup(text: Column) -> Column:
    return F.regexp_replace(text, MARKUP, " ")


def strip_colour_codes(text: Column) -> Column:
    """Caption colour codes such as c12c. Runs before lower-casing, so C12 keeps its letter."""
    return F.regexp_replace(text, COLOUR_CODE, "")


def plain_spaces(text: Column) -> Column:
    """Every white-space character becomes a plain space.

    The long class is only tried on characters outside printable ASCII, which are rare.
    """
    return F.regexp_replace(text, rf"[^!-~ ](?<=[{SPACE}])", " ")


def keep_letters(text: Column) -> Column:
    """Drop everything but a-z and spaces; other white space must be plain already."""
    return F.regexp_replace(text, "[^a-z ]+", "")


def squeeze_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, " {2,}", " "))


def clean_text(text: Column) -> Column:
    """Markup, colour codes, case, non-letters and white space, in this order."""
    return squeeze_spaces(keep_letters(plain_spaces(F.lower(strip_colour_codes(strip_markup(text))))))


def remove_stop_words(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    words = F.split(text, " ")
    dropped = [*stop_words, ""]
    return F.array_join(F.filter(words, lambda w: ~w.isin(dropped)), " ")


def collapse_repeated_words(text: Column) -> Column:
    """Drop a word equal to the word before it, ignoring case; words are separated by one space."""
    words = F.split(text, " ")
    before = F.concat(F.array(F.lit(None).cast("string")), words)
    kept = F.zip_with(words, before, lambda w, p: F.when(p.isNull() | (F.lower(w) != F.lower(p)), w))
    return F.array_join(kept, " ")


def normalize(
    df: DataFrame,
    stop_words: Sequence[str] | None = None,
    text_col: str = "text",
    out_col: str = "normalized_text",
    repeats: bool = True,
) -> DataFrame:
    """Add the normalised text of every segment.

    Repeated phrases go first, while the raw words and spaces are still there; ``repeats=False``
    leaves that step out and keeps the whole expression in the JVM.
    """
    text = F.col(text_col)
    text = collapse_repeats(text) if repeats else text
    cleaned = clean_text(text)
    return df.withColumn(out_col, remove_stop_words(cleaned, STOP_WORDS if stop_words is None else stop_words))


def video_url(video_id: Column) -> Column:
    return F.concat(F.lit(WATCH_URL), video_id)


def matches(text: Column, pattern: str) -> Column:
    """Case-sensitive regular-expression search."""
    return text.rlike(pattern)


def sentiment_bucket(score: Column) -> Column:
    return F.when(score > 0.1, "Positive").when(score < -0.1, "Negative").otherwise("Neutral")


def short_title(title: Column, limit: int = 80) -> Column:
    return F.when(F.length(title) > limit, F.concat(F.substring(title, 1, limit), F.lit("..."))).otherwise(title)


def topic_label(topic_id: Column, name: Column) -> Column:
    return F.concat(F.lit("Topic "), topic_id.cast("string"), F.lit(": "), name)


def tokens(text: Column, min_length: int = 2) -> Column:
    """Words of normalised text with at least ``min_length`` letters."""
    return F.filter(F.split(text, " "), lambda w: F.length(w) >= min_length)
