"""Names of encodings: whether they exist, their normal form, and whether a declaration agrees with what was used."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from arbora.functions.text import coding


def _normal(name: str | None) -> str | None:
    try:
        return codecs.lookup((name or "").removeprefix("bom-")).name
    except LookupError:
        return None


def _normal_names(names: pd.Series) -> pd.Series:
    known = {n: _normal(n) for n in names.unique()}
    return pd.Series([known[n] for n in names], dtype=object)


def normal_name(name: Column | str) -> Column:
    """The codec's own name; null if there is none.  A batch's few encodings are looked up once each."""
    return F.pandas_udf(_normal_names, "string")(name)


def exists(name: Column) -> Column:
    return normal_name(name).isNotNull()


def same(a: Column, b: Column) -> Column:
    """Equal by codec; names without a codec are equal if their texts are."""
    return F.coalesce(normal_name(a), F.lower(a)) == F.coalesce(normal_name(b), F.lower(b))


def agrees(text: Column, used: Column) -> Column:
    """Whether a text declares no encoding or the one that was used."""
    return F.coalesce(same(coding(text), used), F.lit(True))
