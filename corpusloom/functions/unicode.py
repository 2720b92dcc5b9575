"""Unicode normalisation, which Spark has no function for: Arrow batches, and distinct values first."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Hungarian endings that stay attached behind a hyphen, and short words that are no debris.
HYPHEN_SUFFIXES = "t et at ot öt k ek ak ok ök ben ban ről ról nak nek val vel hoz hez höz ra re ba be ból ből tól től on en ön n nál nél ig ként é ja je".split()
SHORT_WORDS = ("ad", "fa", "ma", "ok")

#: A word with one or two endings behind its last hyphen. The word is ASCII, or has a capital or a digit; in
#: lower-case ASCII words -on is an English particle and stays.
_ENDED = r"(?s)\A(?![\x00-\x7F&&[^A-Z]]*[a-z][\x00-\x7F&&[^A-Z]]*-on\z)([\x00-\x7F]+|.*[\p{Lu}\p{Nd}].*)-(?:" + "|".join(HYPHEN_SUFFIXES) + r"){1,2}\z"
#: One or two ASCII characters, a lower-case letter among them and no capital.
_DEBRIS = r"\A(?=[^A-Z]{1,2}\z)(?=[\x00-\x7F]*[a-z])[\x00-\x7F]+\z"


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def _fold(x: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", x.casefold()) if not unicodedata.combining(c))


@F.pandas_udf(T.StringType())
def fold(s: pd.Series) -> pd.Series:
    """Lower case without accents."""
    return s.map(_fold, na_action="ignore")


@F.pandas_udf(T.StringType())
def decomposed(s: pd.Series) -> pd.Series:
    """Characters as what they are made of, without their marks: ligatures and fractions give several."""
    return s.map(lambda x: x if x.isascii() else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)), na_action="ignore")


def normalise_lemma(lemma: Column) -> Column:
    """A lemma without attached endings; null where nothing worth a keyword is left."""
    # every step takes one ending at most, and there are no more of them than hyphens
    bare = F.aggregate(F.split(lemma, "-"), lemma, lambda word, _: F.regexp_replace(word, _ENDED, "$1"))
    return F.when((bare == "") | bare.rlike(_DEBRIS) & ~bare.isin(*SHORT_WORDS), None).otherwise(bare)
