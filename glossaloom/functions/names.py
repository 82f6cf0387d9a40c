"""Name keys: the normal form under which surface forms are grouped."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossaloom.functions.text import strip, words


@F.pandas_udf(T.StringType())
def _decompose(texts: pd.Series) -> pd.Series:
    """NFKD without combining marks; Spark has no built-in for it."""

    def plain(text: str | None) -> str | None:
        if text is None:
            return None
        return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))

    return texts.map(plain)


def name_key(c: Column) -> Column:
    """Lower case, no accents, hyphens and blanks as one space, no possessive.

    Only texts outside ASCII travel through the Arrow helper; the rest pass it as nulls.
    """
    foreign = F.when(c.rlike(r"[^\x00-\x7F]"), c)
    plain = F.coalesce(_decompose(foreign), c)
    return F.regexp_replace(F.regexp_replace(strip(F.lower(plain)), r"(?U)[-\s]+", " "), r"(?U)'s\b", "")


def sorted_tokens(key: Column) -> Column:
    return F.sort_array(words(key))
