"""Window, progress, backoff and worker arithmetic."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

INT_MAX, LONG_MAX = 2147483647, 9223372036854775807
# The largest pool, the assumed latency of a request, the largest exponent of a backoff, and the factors of the jitter's mixing.
POOL_MAX, LATENCY_MS, LAST_DOUBLING = 64, 50, 20
JITTER_STEP, JITTER_FACTORS = 0x9E3779B97F4A7C15, (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def unresolved_count(start: Column, end: Column, last: Column) -> Column:
    """Ids still to do, none if exhausted, saturated to 32 bits."""
    left = end - F.coalesce(last + 1, start) + 1
    return F.least(F.greatest(left, F.lit(0)), F.lit(INT_MAX)).cast("int")


def target_total(start: Column, end: Column) -> Column:
    return F.greatest(end - start + 1, F.lit(0))


def saturating_add(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.try_add(a, b), F.lit(LONG_MAX)))


def target_max(max_id: Column, frontier: Column, cold: Column, limit: Column, end: Column, ignore: Column) -> Column:
    """Last id to plan for: an explicit end, else start + limit - 1, else the upstream maximum, which clamps unless ignored."""
    start = F.coalesce(cold, saturating_add(frontier, F.lit(1)))
    wanted = F.coalesce(end, saturating_add(start, limit - 1))
    return F.when(wanted.isNull(), max_id).when(ignore, wanted).otherwise(F.least(wanted, max_id))


def target_profile(limit: Column, cold: Column, end: Column, start: Column) -> Column:
    open_ = limit.isNull() & end.isNull()
    return F.when(open_ & (start <= 1), "full_history").when(open_ & cold.isNull(), "updater").otherwise("bounded")


def percent_complete(done: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(100).cast("long")).otherwise(F.floor(F.least(done, total) * 100 / total).cast("long"))


def next_id(start: Column, cursor: Column) -> Column:
    return F.coalesce(cursor + 1, start)


def valid_segment(start: Column, end: Column, cursor: Column) -> Column:
    return (start > 0) & (end > 0) & (start <= end) & (cursor.isNull() | cursor.between(start - 1, end))


def durable_advance(next_: Column, last: Column) -> Column:
    return F.greatest(F.coalesce(last - next_ + 1, F.lit(0)), F.lit(0))


def backoff_ms(initial: int, cap: int, attempt: Column) -> Column:
    """Doubling delay without jitter: initial * 2^min(attempt - 1, 20), at most the cap."""
    doubled = F.lit(initial).cast("long") * F.pow(F.lit(2), F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(LAST_DOUBLING))).cast("long")
    return F.least(doubled, F.lit(cap).cast("long"))


def jitter(cap: int):
    """Pandas UDF (item_id, attempt) -> delay in [0, cap]: 64-bit mixing that wraps around, which ANSI arithmetic forbids."""

    @F.pandas_udf("long")
    def mixed(item_id: pd.Series, attempt: pd.Series) -> pd.Series:
        with np.errstate(over="ignore"):
            x = item_id.to_numpy(np.int64).view(np.uint64) ^ (attempt.to_numpy(np.int64).view(np.uint64) * np.uint64(JITTER_STEP))
            for factor in JITTER_FACTORS:
                x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
            x ^= x >> np.uint64(33)
        return pd.Series((x % np.uint64(cap + 1)).astype(np.int64))

    return mixed


def retry_delay_ms(initial: int, cap: int, jitter_cap: int, item_id: Column, attempt: Column) -> Column:
    """How long an item waits after its n-th attempt: the doubling delay and its jitter; nothing if both are switched off."""
    if not initial and not jitter_cap:
        return F.lit(0).cast("long")
    return backoff_ms(initial, cap, attempt) + jitter(jitter_cap)(item_id.cast("long"), attempt.cast("long"))


def ceil_div(a: Column, b: int) -> Column:
    return F.floor((a + (b - 1)) / b).cast("long")


def derive_workers(rps: Column) -> Column:
    """Requests in flight at the assumed latency, with four fifths more, each step at least one."""
    return F.greatest(ceil_div(F.greatest(ceil_div(rps * LATENCY_MS, 1000), F.lit(1)) * 9, 5), F.lit(1))


def queue_capacity(workers: Column) -> Column:
    return F.greatest(workers * 2, F.lit(1))


def pool_size(workers: Column) -> Column:
    return F.greatest(F.least(workers, F.lit(POOL_MAX)), F.lit(1))


def throttle_pause(elapsed: Column, duty: Column) -> Column:
    return F.when(duty >= 1, None).otherwise(elapsed * (1 - duty) / duty)


def check_inputs(limit: int | None = None, cold_start: int | None = None, end: int | None = None, ignore_highest: bool = False) -> None:
    """Raises ValueError unless a run's bounds make sense together."""
    for name, value in (("limit", limit), ("cold start", cold_start), ("end", end)):
        if value is not None and value <= 0:
            raise ValueError(f"{name} must be positive")
    if limit is not None and end is not None:
        raise ValueError("limit and end exclude each other")
    if end is not None and cold_start is not None and end < cold_start:
        raise ValueError("end lies before the start")
    if ignore_highest and limit is None and end is None:
        raise ValueError("ignoring the highest id needs a limit or an end")
