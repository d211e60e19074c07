"""Projection, cleaning and type alignment of the two tables of a match."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from kinweave.functions.similarity import missing
from kinweave.spec import MatchSpec


def project(df: DataFrame, id_col: str, columns: Iterable[str]) -> DataFrame:
    """The id and the columns of a similarity map, in order, once each."""
    cols = list(dict.fromkeys([id_col, *columns]))
    lacking = [c for c in cols if c not in df.columns]
    if lacking:
        raise KeyError(f"columns not in the table: {lacking}")
    return df.select(*cols)


def to_numeric(c: Column, fill: bool = False) -> Column:
    """Digits and points of the text as a number; nothing left is null, or 0 with ``fill``; unreadable is null."""
    digits = F.coalesce(F.regexp_replace(c.cast("string"), r"[^0-9.]", ""), F.lit(""))
    if fill:
        digits = F.when(digits == "", "0").otherwise(digits)
    return digits.try_cast("double")


def fill_string(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def stop_word_list(language: str = "english", extra: Iterable[str] = ()) -> list[str]:
    return sorted({w.lower() for w in (*StopWordsRemover.loadDefaultStopWords(language), *extra)})


def remove_stop_words(c: Column, stop: list[str], lemmas: dict[str, str] | None = None) -> Column:
    """The alphabetic words that are no stop words, each once, in order, joined by blanks; null stays null."""
    tokens = F.filter(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda t: t.rlike(r"^\p{L}+$") & ~F.lower(t).isin(stop))
    if lemmas:
        table = F.create_map(*[F.lit(x) for kv in lemmas.items() for x in kv])
        tokens = F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, F.lower(t)), t))
    return F.array_join(F.array_distinct(tokens), " ")


def align_types(left: DataFrame, right: DataFrame, spec: MatchSpec) -> tuple[DataFrame, DataFrame]:
    """Equal types stay; whole and floating numbers become double; anything else that differs becomes text."""
    for a, b in spec.column_pairs:
        ta, tb = left.schema[a].dataType, right.schema[b].dataType
        if ta == tb:
            continue
        if isinstance(ta, NumericType) and isinstance(tb, NumericType):
            if {ta.typeName(), tb.typeName()} & {"double", "float"}:
                left, right = left.withColumn(a, F.col(a).cast("double")), right.withColumn(b, F.col(b).cast("double"))
            continue
        text = lambda c, t: F.when(~missing(c, t.typeName()), c.cast("string"))
        left, right = left.withColumn(a, text(F.col(a), ta)), right.withColumn(b, text(F.col(b), tb))
    return left, right


def prepare(
    left: DataFrame, right: DataFrame, spec, left_id: str, right_id: str, *, fill_numeric_na: bool = False, to_numeric_cols: Iterable[str] = (), fill_string_na: bool = False,
    capitalize: bool = False, lower_case: bool = False, stop_words: list[str] | None = None, lemmas: dict[str, str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Both tables projected to a similarity map, cleaned and type-aligned, as one lazy projection each.

    In this order: numbers, filled strings, stop words, upper case, lower case
    (which wins), aligned types.  ``stop_words`` is a list, or None for none.
    """
    spec = MatchSpec.of(spec)
    numeric = set(to_numeric_cols)

    def clean(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
        df = project(df, id_col, columns)
        out = [F.col(id_col)]
        for c in columns:
            if c == id_col:
                continue
            x, kind = F.col(c), df.schema[c].dataType
            if c in numeric:
                x, text = to_numeric(x, fill_numeric_na), False
            else:
                text = not isinstance(kind, NumericType)
                if fill_string_na:
                    x, text = fill_string(F.when(~missing(x, kind.typeName()), x)), True
                if stop_words is not None and text:
                    x = remove_stop_words(x, stop_words, lemmas)
            if text and capitalize:
                x = F.upper(x)
            if text and lower_case:
                x = F.lower(x)
            out.append(x.alias(c))
        return df.select(*out)

    return align_types(clean(left, left_id, spec.left_columns), clean(right, right_id, spec.right_columns), spec)
