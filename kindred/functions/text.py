"""Ids from urls, status names, time paths, image sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the reply codes.
STATUS = ("REPLY_OK", "REPLY_FAILED", "REPLY_DOWNLOAD_FAIL", "REPLY_IMAGELOAD_FAIL", "REPLY_FEATEXTRACT_FAIL",
          "REPLY_EXTRACTSERVER_FAIL", "REPLY_INDEXSERVER_FAIL", "REPLY_INVALID_PID", "REPLY_REDISSERVER_FAIL")


def pid_from_url(url: Column) -> Column:
    """After the last slash, up to the first dot, then up to the first question mark; no slash: empty."""
    last = F.regexp_extract(url, r"/([^/]*)$", 1)
    return F.substring_index(F.substring_index(last, ".", 1), "?", 1)


def pid_from_url_v1(url: Column) -> Column:
    """After the last slash up to the next dot, else up to the last ampersand, else all of it;
    without a slash the url as it is."""
    last = F.regexp_extract(url, r"([^/]*)$", 1)
    return F.when(~F.contains(url, F.lit("/")), url).when(
        F.contains(last, F.lit(".")), F.substring_index(last, ".", 1)).when(
        F.contains(last, F.lit("&")), F.regexp_extract(last, r"^(.*)&", 1)).otherwise(last)


def status_name(code: Column) -> Column:
    """The name of a reply code; empty for an unknown one."""
    return F.coalesce(F.get(F.array(*map(F.lit, STATUS)), code), F.lit(""))


def time_path(ts: Column, minutes: int = 5) -> Column:
    """HH/(MM / minutes), as request folders are named."""
    return F.concat(F.lpad(F.hour(ts).cast("string"), 2, "0"), F.lit("/"),
                    F.floor(F.minute(ts) / minutes).cast("string"))


def resized(width: Column, height: Column, most: int = 120, short_side: int = 100, ratio: int = 4) -> tuple[Column, Column]:
    """(width, height) of an image whose sides are to be at most ``most``; all divisions truncate.

    Images that fit stay. Beyond ``ratio`` times longer than wide, the short side becomes
    ``short_side`` and the long one that times the whole ratio; from 100 on nothing is done.
    """
    long, short = F.greatest(width, height), F.least(width, height)
    times = F.floor(long / short)

    def side(x, is_long):
        narrow = F.when(is_long, times * short_side).otherwise(F.lit(short_side))
        fit = F.when(is_long, F.lit(most)).otherwise(F.floor(short * most / long))
        return F.when((long <= most) | (times >= 100), x).when(times > ratio, narrow).otherwise(fit).cast("bigint")

    return side(width, width >= height), side(height, width < height)
