"""Joins on keys of which one may hold most of the rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

#: A key with at least this share of all rows is hot; there are at most 1 / HOT of them.
HOT = 1 / 1000


def join_groups(rows: DataFrame, groups: DataFrame, total: int, key: str | list[str], size: str = "group_size", how: str = "inner") -> DataFrame:
    """``rows`` with their group's columns, where ``groups`` has one row a key and, in ``size``, how many rows it has.

    Hot groups, of which there are at most 1 / HOT in ``total`` rows, are broadcast, so that no task gets all rows of
    one; the rest meet by a shuffle. ``how`` is ``inner``, or ``left`` for rows without a group too. Null keys have no
    group. ``groups`` is read three times, so it should come from a table.
    """
    keys = [key] if isinstance(key, str) else key
    bound = max(2, math.ceil(total * HOT))
    hot = F.broadcast(groups.where(F.col(size) >= bound))
    cold = groups.where(F.col(size) < bound)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    if how == "inner":
        return rows.join(hot, keys).unionByName(rest.join(cold.hint("merge"), keys))
    # rows without a key would meet in one task
    keyed = F.lit(True)
    for k in keys:
        keyed = keyed & F.col(k).isNotNull()
    more = [F.lit(None).cast(f.dataType).alias(f.name) for f in groups.schema.fields if f.name not in keys]
    out = rows.join(hot, keys).unionByName(rest.where(keyed).join(cold.hint("merge"), keys, "left"))
    return out.unionByName(rest.where(~keyed).select("*", *more))
