"""Metalink documents: parsing, mirror order, further documents and link headers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webloom.functions import text, urls

KEPT = ("md5", "sha-1", "sha-256", "sha-512")
DOCUMENT = "struct<files:array<struct<name:string,urls:array<struct<url:string,location:string,preference:int>>,hashes:array<struct<algo:string,hex:string>>>>,metaurls:array<struct<url:string,mediatype:string,priority:int>>,error:string>"


def _number(value: str | None) -> int | None:
    try:
        return int(value) if value is not None else None
    except ValueError:
        return None


def parse_document(xml: str | None) -> dict:
    """Files with URLs and hashes, and metaurls.  Attribute names count without their
    prefix; preference and priority are one field; a malformed document has an error and
    nothing else."""
    import xml.etree.ElementTree as ET
    from urllib.parse import urlsplit

    empty = {"files": [], "metaurls": [], "error": None}
    try:
        if xml is None or "<!ENTITY" in xml:
            raise ET.ParseError("no document" if xml is None else "entities are not read")
        root = ET.fromstring(xml)
    except ET.ParseError as e:
        return empty | {"error": str(e)}
    local = lambda n: n.rpartition("}")[2].lower()
    usable = lambda u: bool(urlsplit(u).scheme and urlsplit(u).netloc)
    alias = {"sha256": "sha-256", "sha1": "sha-1", "sha512": "sha-512"}
    files, metaurls = [], []
    for node in root.iter():
        if local(node.tag) == "file":
            one = {"name": {local(k): v for k, v in node.attrib.items()}.get("name"), "urls": [], "hashes": []}
            for x in node.iter():
                a, said = {local(k): v for k, v in x.attrib.items()}, (x.text or "").strip()
                if local(x.tag) == "url" and usable(said):
                    one["urls"].append({"url": said, "location": a.get("location"), "preference": _number(a.get("preference", a.get("priority")))})
                elif local(x.tag) == "hash" and said:
                    algo = (a.get("type") or "").strip().lower().replace("_", "-")
                    algo = alias.get(algo, algo)
                    if algo in KEPT:
                        one["hashes"].append({"algo": algo, "hex": said.lower()})
            files.append(one)
        elif local(node.tag) == "metaurl" and usable((node.text or "").strip()):
            a = {local(k): v for k, v in node.attrib.items()}
            metaurls.append({"url": node.text.strip(), "mediatype": a.get("mediatype", a.get("type")), "priority": _number(a.get("priority", a.get("preference")))})
    return {"files": files, "metaurls": metaurls, "error": None}


def documents(df: DataFrame, *, xml: str = "xml") -> DataFrame:
    """Adds ``doc`` (files, metaurls, error).  Spark's XML functions fail or null a whole
    document on what this keeps, so it is an Arrow-batched parser."""

    @F.pandas_udf(DOCUMENT)
    def parse(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_document(x) for x in s], columns=["files", "metaurls", "error"])

    return df.withColumn("doc", parse(F.col(xml)))


def ordered_urls(found: Column, location: str | None) -> Column:
    """Mirrors: the preferred location first, then by preference from high to low, missing
    last, equals in document order."""
    keyed = F.transform(
        found,
        lambda u, i: F.struct(
            F.when(F.lower(F.coalesce(u["location"], F.lit(""))) == (location or "\0").lower(), 0).otherwise(1).alias("far"),
            (-F.coalesce(u["preference"].cast("bigint"), F.lit(-(2**31)))).alias("low"),
            i.alias("at"),
            u["url"].alias("url"),
        ),
    )
    return F.transform(F.array_sort(keyed), lambda k: k["url"])


def rank_mirrors(df: DataFrame, location: str | None = None, *, key: str = "name") -> DataFrame:
    """Adds ``rank`` to rows (key, url, location, preference, pos)."""
    near = F.when(F.lower("location") == (location or "\0").lower(), 0).otherwise(1)
    w = W.partitionBy(key).orderBy(near, F.col("preference").desc_nulls_last(), "pos")
    return df.withColumn("rank", F.row_number().over(w))


def pick_mirror(df: DataFrame, location: str | None = None, *, key: str = "name") -> DataFrame:
    """The first mirror of each file, as one aggregate with partial sums."""
    near = F.when(F.lower("location") == (location or "\0").lower(), 0).otherwise(1)
    best = F.min(F.struct(near.alias("n"), (-F.coalesce(F.col("preference").cast("bigint"), F.lit(-(2**31)))).alias("p"), "pos", "url"))
    return df.groupBy(key).agg(best.alias("b")).select(key, F.col("b.url").alias("url"))


def nth_metaurl(metaurls: Column, index: int) -> Column:
    """The ``index``-th (from 1; 0 or less is the first) further document that is a
    metalink; one without a media type counts.  Null where there are not so many."""
    fit = F.filter(metaurls, lambda m: m["mediatype"].isNull() | text.is_metalink_type(m["mediatype"]))
    return F.try_element_at(fit, F.lit(max(1, index)))


def duplicates(links: Column, base: Column) -> Column:
    """struct<urls, digests, describedby> of parsed Link headers: duplicates by pri, missing
    last, in order; the first digests that there are hold for all."""
    dup = F.filter(links, lambda x: x["rel"] == "duplicate")
    keyed = F.array_sort(F.transform(dup, lambda x, i: F.struct(F.coalesce(x["pri"].cast("bigint"), F.lit(2**31)).alias("p"), i.alias("i"), urls.join(base, x["url"]).alias("u"))))
    first = lambda a: F.try_element_at(a, F.lit(1))
    described = F.filter(links, lambda x: (x["rel"] == "describedby") & (x["media_type"].isNull() | text.is_metalink_type(x["media_type"])))
    digests = first(F.filter(F.transform(links, lambda x: x["digests"]), lambda d: F.size(d) > 0))
    return F.struct(
        F.filter(F.transform(keyed, lambda k: k["u"]), lambda u: u.isNotNull()).alias("urls"),
        F.coalesce(digests, F.array().cast("array<struct<algo:string,hex:string>>")).alias("digests"),
        urls.join(base, first(described)["url"]).alias("describedby"),
    )
