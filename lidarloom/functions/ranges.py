"""Byte ranges: headers, deadlines and retries as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 8 s and 2 s for each MiB begun; waits before the retries.
BASE_MS, PER_MIB_MS, RETRY_MS = 8000, 2000, (500, 2000)
#: Fixed value: the largest whole number that a double tells from its neighbours.
LARGEST = (1 << 53) - 1


def usable(offset: Column, length: Column) -> Column:
    return F.coalesce((offset >= 0) & (length >= 1) & (offset == F.floor(offset)) & (length == F.floor(length)), F.lit(False))


def range_header(offset: Column, length: Column) -> Column:
    return F.concat(F.lit("bytes="), offset.cast("string"), F.lit("-"), (offset + length - 1).cast("string"))


def content_range(header: Column) -> Column:
    """Struct start, last, total (null for *); null where the header is unreadable or contradicts itself."""
    text = F.regexp_replace(header, r"^\s+|\s+$", "")
    found = lambda k: F.regexp_extract(text, r"^bytes (\d+)-(\d+)/(\d+|\*)$", k)
    part = lambda k: F.when(F.try_to_number(found(k), F.lit("9" * 18)) <= LARGEST, F.try_to_number(found(k), F.lit("9" * 18)).cast("long"))
    start, last, total = part(1), part(2), part(3)
    # A total that is no exact number contradicts itself; only the asterisk stands for an unknown one.
    ok = start.isNotNull() & (last >= start) & F.when(found(3) == "*", True).otherwise(F.coalesce(last < total, F.lit(False)))
    return F.when(ok, F.struct(start.alias("start"), last.alias("last"), total.alias("total")))


def deadline_ms(length: Column) -> Column:
    return F.lit(BASE_MS) + F.ceil(length / F.lit(1 << 20)) * PER_MIB_MS


def retry_wait_ms(attempt: Column) -> Column:
    """The wait after a failed attempt, counted from 0; null when it was the last one."""
    return F.get(F.array(*map(F.lit, RETRY_MS)), attempt.cast("int"))


def worth_retrying(code: Column, status: Column) -> Column:
    return F.coalesce(code.isin("range-timeout", "range-network") | ((code == "range-request-failed") & (status >= 500)), F.lit(False))


def attempt_error(status: Column, header: Column, offset: Column, length: Column, body: Column) -> Column:
    """The error code of one answer to a range request, null if it is the range that was asked for."""
    got = content_range(header)
    return (
        F.when(status == 200, "range-unsupported")
        .when(status >= 400, "range-request-failed")
        .when(status != 206, "range-unsupported")
        .when(header.isNull(), "content-range-unreadable")
        .when(got.isNull() | (got["start"] != offset) | (got["last"] != offset + length - 1) | (body != length), "content-range-mismatch")
    )
