"""What was known of each claim on a day, from source tables whose records arrive later.

Each system of record delivers records of claims: the date it was recorded on, the date it arrived,
and columns of its own. Of each claim and source the record that was recorded last counts, among
those that had arrived by the day; one that arrives late does not replace a later one.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspan.functions.dates import DateLike, as_date
from claimspan.sources.tables import require_columns

RECORDED, ARRIVED = "recorded_on", "arrived_on"


def known_on(sources: Mapping[str, DataFrame], day: DateLike,
             key: str = "claim_num") -> DataFrame:
    """A row for each claim that any source knew of by the day: the key, and of each source its
    columns and, as ``<source>_recorded_on``, their date; null where it knew nothing yet.

    All sources share one exchange and one aggregate, which starts within tasks. Records of the
    same dates are told apart by their content, so that the result does not depend on order.
    Records without a key, or without one of the dates, are not known.
    """
    if not sources:
        raise ValueError("no sources")
    day, columns = as_date(day), {}
    for name, source in sources.items():
        require_columns(source, [key, RECORDED, ARRIVED])
        columns[name] = [c for c in source.columns if c not in (key, RECORDED, ARRIVED)]
    every = [c for own in columns.values() for c in own] + [f"{n}_{RECORDED}" for n in sources]
    twice = sorted({c for c in every if every.count(c) > 1} | ({key} & set(every)))
    if twice:
        raise ValueError(f"columns of more than one source: {', '.join(twice)}")

    def records(name: str) -> DataFrame:
        own = [F.col(f"`{c}`") for c in columns[name]]
        latest = F.struct(RECORDED, ARRIVED, F.xxhash64(F.lit(name), *own).alias("tie"))
        return sources[name].where(
            (F.col(ARRIVED) <= F.lit(day)) & F.col(RECORDED).isNotNull() & F.col(key).isNotNull()
        ).select(key, latest.alias(f"__order_{name}"), F.struct(
            F.col(RECORDED).alias(f"{name}_{RECORDED}"), *own).alias(f"__row_{name}"))

    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(records, sources))
    latest = rows.groupBy(key).agg(*(
        F.max_by(f"__row_{name}", f"__order_{name}").alias(f"__row_{name}") for name in sources))
    return latest.select(key, *(
        F.col(f"__row_{name}")[c].alias(c)
        for name in sources for c in (f"{name}_{RECORDED}", *columns[name])))
