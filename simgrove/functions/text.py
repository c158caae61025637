"""Scalar functions of the curation work, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: phrases that mean the two accepted licences
CC0 = ["cc0", "cc0 1.0", "creative commons zero", "creative commons zero 1.0"]
CC_BY = ["cc by", "cc by 2.0", "cc by 2.5", "cc by 3.0", "cc by 4.0", "creative commons attribution", "creative commons attribution 4.0"]
#: fixed values: parts that mean a restricted licence, in addresses and in phrases
RESTRICTED_PATHS = ["/by-nc/", "/by-sa/", "/by-nd/", "/by-nc-sa/", "/by-nc-nd/"]
RESTRICTED_WORDS = ["cc by nc", "cc by sa", "cc by nd"]
#: fixed values: file endings that are recognised
ENDINGS = [".jpg", ".jpeg", ".png", ".webp", ".tif", ".tiff"]


def _any(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def normalize_license(value: Column) -> Column:
    """'CC0', 'CC-BY' or null; restricted variants are refused before attribution is accepted."""
    low = F.replace(F.lower(F.trim(value)), F.lit("https://"), F.lit("http://"))
    phrase = F.trim(F.regexp_replace(F.translate(low, "_-", "  "), r"\s+", " "))
    zero = low.contains("creativecommons.org/publicdomain/zero/") | phrase.isin(CC0)
    refused = _any([low.contains(x) for x in RESTRICTED_PATHS] + [phrase.contains(x) for x in RESTRICTED_WORDS])
    by = low.contains("creativecommons.org/licenses/by/") | phrase.isin(CC_BY)
    return F.when(zero, "CC0").when(refused, F.lit(None)).when(by, "CC-BY")


def filled(c: Column) -> Column:
    """The trimmed text, null if nothing is left."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def build_attribution(creator: Column, holder: Column, publisher: Column, institution: Column, key: Column, license_text: Column, identifier: Column) -> Column:
    """Credit, holder, institution, occurrence, licence and source, the distinct ones of them joined by ' | '."""
    c, h, p, i = filled(creator), filled(holder), filled(publisher), F.nullif(institution, F.lit(""))
    credit = F.coalesce(c, h, p, filled(institution), F.lit("Source provider"))
    shown_holder = F.when(h != credit, h)
    shown_institution = F.when((i != credit) & ~F.coalesce(i == shown_holder, F.lit(False)), i)
    return F.concat_ws(" | ", credit, shown_holder, shown_institution, F.concat(F.lit("GBIF occurrence "), key.cast("string")), filled(license_text), filled(identifier))


def suffix_for(content_type: Column, url: Column) -> Column:
    """File ending by content type, then by address, then '.jpg'."""
    ct = F.lower(F.coalesce(content_type, F.lit("")))
    path = F.substring_index(F.lower(url), "?", 1)
    out = F.when(ct.contains("png"), ".png").when(ct.contains("webp"), ".webp").when(ct.contains("tiff"), ".tif")
    for e in ENDINGS:
        out = out.when(path.endswith(e), e)
    return out.otherwise(".jpg")


def cache_url(key: Column, identifier: Column) -> Column:
    """Address of a cached occurrence image: the occurrence key and the md5 of the publisher's identifier."""
    return F.concat(F.lit("https://api.gbif.org/v1/image/cache/occurrence/"), key.cast("string"), F.lit("/media/"), F.md5(identifier.cast("binary")))


def format_layer_name(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("features."), F.lit("Layer ")), F.lit("_"), F.lit(" "))


def layer_file_key(c: Column) -> Column:
    return F.replace(c, F.lit("."), F.lit("_"))


def sample_label_text(index: Column, label: Column, plain: bool = False) -> Column:
    """S<index>:<label>; long labels are cut at 8 characters, structured ones with '..' after 10."""
    s = label.cast("string")
    cut = F.substring(s, 1, 8) if plain else F.when(F.length(s) > 10, F.concat(F.substring(s, 1, 8), F.lit(".."))).otherwise(s)
    name = F.concat(F.lit("S"), index.cast("string"))
    return F.when(s.isNotNull() & (s != ""), F.concat(name, F.lit(":"), cut)).otherwise(name)


def filename_build(family: Column, key: Column, sha: Column, suffix: Column) -> Column:
    return F.concat(F.concat_ws("__", family, key.cast("string"), F.substring(sha, 1, 12)), suffix)


def utc_now() -> Column:
    """The time of the query in UTC, to the second: 2024-01-31T12:00:00Z."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
