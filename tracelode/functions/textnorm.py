"""Normal forms in which a claimed and an archived text are compared."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import ship
from .binding import let

#: Link forms, invisible characters, and marks that are folded together.
_SPACE = r"\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
LINKS = (rf"(?i)https?://[^{_SPACE}]+|[a-z0-9-]+\.t\.co/[^{_SPACE}]*|pic\.(?:twitter|x)\.com/[^{_SPACE}]*", rf"(?i)\bt\.co/[^{_SPACE}]+")
INVISIBLE = r"[\x{200B}\x{200C}\x{200D}\x{FEFF}\x{2060}\x{AD}]"
FOLDS = (
    (r"[\x{2018}\x{2019}\x{201A}\x{201B}\x{2039}\x{203A}\x{60}\x{B4}\x{2B9}\x{2BA}\x{2032}\x{2035}]", "'"),
    (r"[\x{201C}\x{201D}\x{201E}\x{201F}\x{AB}\x{BB}]", '"'),
    (r"[\x{2010}-\x{2015}\x{2212}]", "-"),
)
OTHER = r"[^\p{L}\p{N}]+"
LOOKALIKES = ("01|58", "ollsb")
PAIRS = (("rn", "m"), ("vv", "w"))


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


def nfkc(text: Column) -> Column:
    """Compatibility composition. ASCII texts are their own, so only others cross over to Python."""
    ship()
    plain = text.rlike(r"^[\x00-\x7F]*$")
    return F.coalesce(_nfkc(F.when(~plain, text)), text)


def _base(text: Column, compatibility: bool) -> Column:
    """Lower-cased, without links and invisible characters, quotes and dashes folded. Each step runs only on texts that may need it."""

    def unlinked(t: Column) -> Column:
        out = t
        for link in LINKS:
            out = F.regexp_replace(out, link, " ")
        return F.when(t.contains("://") | t.contains("t.co/") | t.contains("pic."), out).otherwise(t)

    def folded(t: Column) -> Column:
        out = F.regexp_replace(t, INVISIBLE, "")
        for pattern, mark in FOLDS:
            out = F.regexp_replace(out, pattern, mark)
        return F.when(F.length(t) == F.octet_length(t), t).otherwise(out)  # ASCII marks go with all other marks

    return let(let(F.lower(nfkc(text) if compatibility else text), unlinked), folded)


def _words(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, OTHER, " "))


def _lookalikes(text: Column) -> Column:
    """Glyphs that are misread for each other made one, before marks go: ``r-n`` is no ``m``."""
    for pair, one in PAIRS:
        text = F.replace(text, F.lit(pair), F.lit(one))
    return F.translate(text, *LOOKALIKES)


def normalize_text(text: Column, compatibility: bool = True) -> Column:
    """Letters and digits only, lower-cased, words apart by single spaces, links gone.

    ``compatibility=False`` skips NFKC, for texts known to be in that form; the whole is then a JVM expression.
    Emoji need no step of their own: none is a letter or digit.
    """
    return _words(_base(text, compatibility))


def normalize_folded(text: Column, compatibility: bool = True) -> Column:
    """The same with glyphs that are misread for each other made one."""
    return _words(_lookalikes(_base(text, compatibility)))


def normal_forms(text: Column, compatibility: bool = True) -> Column:
    """struct(plain, folded): what of a text is compared. Worth computing once for a text that is compared often."""
    return let(_base(text, compatibility), lambda t: F.struct(_words(t).alias("plain"), _words(_lookalikes(t)).alias("folded")))
