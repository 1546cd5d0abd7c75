"""Path, name, time-stamp and key builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def file_basename(col) -> Column:
    """Last '/' component, like ``os.path.basename``."""
    return F.element_at(F.split(_c(col), "/"), -1)


def strip_suffix(col, n: int = 4) -> Column:
    """Drop the last ``n`` characters unconditionally (``s[:-n]``)."""
    c = _c(col)
    return F.left(c, F.greatest(F.length(c) - F.lit(n), F.lit(0)))


def remove_all(col, token: str) -> Column:
    """Delete every occurrence of ``token`` (``str.replace(token, '')``)."""
    return F.replace(_c(col), F.lit(token), F.lit(""))


def file_extension(col) -> Column:
    """``os.path.splitext(p)[1]``: last dot of the base name, leading dots ignored."""
    return F.regexp_extract(_c(col), r"(?<=[^./])(\.[^./]*)$", 1)


def swap_extension(col, new_ext: str = ".parquet") -> Column:
    """``splitext(p)[0] + new_ext``."""
    stem = F.regexp_replace(_c(col), r"^((?:.*/)?\.*[^./][^/]*?)\.[^./]*$", "$1")
    return F.concat(stem, F.lit(new_ext))


def iso_timestamp(col) -> Column:
    """``datetime.isoformat()``: microseconds shown only when non-zero."""
    ts = _c(col)
    with_frac = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    without = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, "SSSSSS")
    return F.when(fraction == "000000", without).otherwise(with_frac)


def run_stamp(col) -> Column:
    """``strftime('%Y%m%d_%H%M%S')`` used in flush and summary file names."""
    return F.date_format(_c(col), "yyyyMMdd_HHmmss")


def point_id(document_name, chunk_index) -> Column:
    """Deterministic point id: retries of the same chunk overwrite instead of duplicating."""
    return F.sha2(F.concat_ws("\u0001", _c(document_name), _c(chunk_index).cast("string")), 256)


def request_key(*cols) -> Column:
    """Cache key of a request; sha-256 instead of a 32-bit checksum that collides."""
    return F.sha2(F.concat_ws("|", *[_c(c).cast("string") for c in cols]), 256)


def plain_path(path) -> Column:
    """One form of a path: percent escapes decoded, ``file:`` and repeated slashes of a local one removed."""
    c = F.regexp_replace(_c(path), "^file:/+", "/")
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)
