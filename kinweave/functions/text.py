"""Unicode helpers that stay in the JVM where they can."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F
from pyspark.sql.types import StringType

from kinweave.runtime import ship

#: A string without any character from U+0300 on (combining marks and all later blocks) is in NFC already.
_MAY_CHANGE = r"[^\u0000-˿]"


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    import unicodedata

    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def nfc(c: Column) -> Column:
    """``c`` in Unicode form NFC; only strings that could change go through Python."""
    ship(SparkSession.active())
    return F.when(c.rlike(_MAY_CHANGE), _nfc(F.when(c.rlike(_MAY_CHANGE), c))).otherwise(c)


def words(c: Column) -> Column:
    """The longest runs of letters and digits, in NFC and lower case, in order."""
    return F.regexp_extract_all(F.lower(nfc(c)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
