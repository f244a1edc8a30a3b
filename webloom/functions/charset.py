"""Bytes to text in any charset, and host names beyond ASCII."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import urls

#: Labels that Spark decodes itself.
NATIVE = {"utf-8": "UTF-8", "utf8": "UTF-8", "us-ascii": "US-ASCII", "utf-16": "UTF-16", "utf-16le": "UTF-16LE", "utf-16be": "UTF-16BE"}
#: Labels that the web reads as another charset.
WEB = {"iso-8859-1": "cp1252", "latin1": "cp1252", "ascii": "cp1252", "us-ascii": "cp1252", "shift_jis": "cp932", "gb2312": "gbk", "ks_c_5601-1987": "cp949"}


def known(label: str) -> bool:
    try:
        codecs.lookup(WEB.get(label.strip().lower(), label.strip()))
    except LookupError:
        return False
    return True


def text_of(data: bytes, label: str | None) -> str | None:
    """Text of bytes, bad ones replaced; no label is UTF-8, an unknown one gives null."""
    name = (label or "utf-8").strip().lower()
    return bytes(data).decode(WEB.get(name, name), "replace") if known(name) else None


def decode_bytes(data: Column, label: Column | str = "utf-8") -> Column:
    """Text of BINARY, bad bytes replaced; a null label is UTF-8, an unknown one gives
    null.  Spark decodes few charsets, so labels in a column go through Python's codecs
    by Arrow batches; a constant UTF-8 stays in the JVM."""
    if isinstance(label, str):
        if not known(label):
            raise ValueError(f"unknown encoding: {label}")
        if label.lower() in ("utf-8", "utf8"):
            return F.make_valid_utf8(data.cast("string"))
        label = F.lit(label)

    @F.pandas_udf("string")
    def decode(xs: pd.Series, labels: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else text_of(x, n) for x, n in zip(xs, labels, strict=True)], dtype=object)

    return decode(data, label)


def idna_host(host: Column) -> Column:
    """A host in ASCII (punycode) form; null where there is none.  ASCII hosts stay in the
    JVM's hands when the caller filters for others first."""

    @F.pandas_udf("string")
    def encode(hosts: pd.Series) -> pd.Series:
        def one(h):
            try:
                return None if h is None else h.lower() if h.isascii() else h.encode("idna").decode().lower()
            except UnicodeError:
                return None

        return pd.Series([one(h) for h in hosts], dtype=object)

    return encode(host)


def ascii_hosts(df: DataFrame, *, url: str = "url") -> DataFrame:
    """``df`` with hosts beyond ASCII in their ASCII form; rows whose host has none are gone.
    Only rows with such hosts reach Python."""
    odd = F.coalesce(urls.host(F.col(url)).rlike(r"[^\x00-\x7F]"), F.lit(False))
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^/?#:]*)", 1)
    some = df.where(odd).withColumn("_ascii", idna_host(host)).where("_ascii is not null")
    whole = F.concat(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?)", 1), "_ascii", F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?[^/?#:]*(.*)$", 1))
    return df.where(~odd).unionByName(some.withColumn(url, whole).drop("_ascii"))
