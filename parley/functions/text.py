"""Column expressions for message text. All JVM-side (regexp, higher-order
functions); no Python in the per-row path.

Fixed values that must equal the original tool's behaviour:
- URL token: ``http`` or ``https``, ``://``, then one or more of ``!``,
  the ASCII range ``$``..``_`` or ``a``..``z``; replaced by ``url``.
- custom emoji token: ``<:`` ... ``:`` digits ``>`` (lazy, no newline);
  replaced by the text between the first two colons; rescanned from the
  start after every replacement.
- user mention token: ``<@`` digits ``>``; unknown ids become ``Human``.
- non-ASCII runs become one space; ``\\n`` becomes one space.
- blank = only Python whitespace after the steps above.
- end-of-sequence marker: ``<|endoftext|>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
URL_RE = r"https?://[!$-_a-z]+"
URL_TOKEN = "url"
EMOJI_RE = r"(?d)<:.*?:[0-9]+>"
# one anchored replacement of the leftmost emoji token: prefix + name
EMOJI_STEP_RE = r"(?d)\A((?s:.*?))<:(?=([^:]*)).*?:[0-9]+>"
MENTION_RE = r"<@[0-9]+>"
MENTION_ID_RE = r"<@([0-9]+)>"
UNKNOWN_MEMBER = "Human"
NON_ASCII_RE = r"[^\x00-\x7F]+"
# characters Python's str.strip() removes from ASCII text
NON_BLANK_RE = r"[^\t\n\x0b\f\r\x1c-\x1f ]"
EOS = "<|endoftext|>"
# Unicode whitespace for strip() on text that may still hold non-ASCII
UNICODE_WS_CLASS = r"[\t\n\x0b\f\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# -----------------------------------------------------------------------------


def replace_urls(c: Column) -> Column:
    """Every URL -> ``url`` in one pass (the flat class needs no
    recursion, so very long URLs cannot overflow the regex stack)."""
    return F.regexp_replace(c, URL_RE, URL_TOKEN)


def replace_custom_emojis(c: Column) -> Column:
    """Leftmost-first emoji replacement with rescans, as a fold.

    Every replacement removes at least two colons, so ``colons/2`` steps
    bound the number of rescans; rows without a token skip the fold.
    """
    colons = F.length(c) - F.length(F.regexp_replace(c, ":", ""))
    steps = F.floor(colons / 2).cast("int")
    fold = F.aggregate(
        F.sequence(F.lit(1), F.greatest(steps, F.lit(1))),
        c,
        lambda acc, _: F.regexp_replace(acc, EMOJI_STEP_RE, "$1$2"),
    )
    return F.when(c.rlike(EMOJI_RE), fold).otherwise(c)


def blank_non_ascii(c: Column) -> Column:
    """Each run of non-ASCII characters -> one space."""
    return F.regexp_replace(c, NON_ASCII_RE, " ")


def newline_to_space(c: Column) -> Column:
    """``\\n`` -> space (``\\r`` is kept)."""
    return F.translate(c, "\n", " ")


def is_not_blank(c: Column) -> Column:
    """C7 predicate: keep when something other than whitespace remains."""
    return c.rlike(NON_BLANK_RE)


def strip_unicode(c: Column) -> Column:
    """Python ``str.strip()`` for text that may hold non-ASCII whitespace."""
    return F.regexp_replace(c, rf"(?U)^{UNICODE_WS_CLASS}+|{UNICODE_WS_CLASS}+$", "")


def normalise_id(c: Column) -> Column:
    """Mention ids compare as integers: ``007`` means ``7``."""
    return F.regexp_replace(c, r"^0+(?=[0-9])", "")


def rouge_tokens(c: Column) -> Column:
    """Tokens as the common ROUGE tokenizer makes them: lower-case, runs of
    ``[a-z0-9]``, no stemming."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1)


WORD_SPLIT_RE = r"[ \t\n\x0b\f\r]+"


def word_tokens(c: Column) -> Column:
    """Whitespace tokens (ASCII whitespace; no empty strings)."""
    return F.filter(F.split(c, WORD_SPLIT_RE), lambda t: t != "")
