"""Attempts that are accepted or rejected as they arrive, with a target and a cap for each class.

Arbitrary keyed state on disk holds, for each class, the codes that were accepted, in maps by bands of their bits, and
how many attempts there were. A new code is too near to an accepted one exactly if some band is equal and the
distance small, so only codes of equal bands are looked up. The state goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

from curalith.operators.hamming import spans
from curalith.storage import fresh_path

from .attempts import PROVIDER, ROCKS

SCHEMA = "class string, attempt long, code long, bad boolean"


class Acceptor(StatefulProcessor):
    """Decides a class's attempts in order: ``accepted``, ``degenerate``, ``near`` an accepted one, or ``not_tried`` once the
    target or the cap is reached. The cap is looked at when a batch of attempts begins, and a batch is no longer than what
    is missing to the target; a batch that has begun is finished."""

    def __init__(self, target: int, cap: int, batch: int, most: int, bits: int = 64):
        self.target, self.cap, self.batch, self.most = target, cap, batch, most
        self.spans = spans(bits, most + 1)  # codes at most ``most`` bits apart agree in one of these

    def init(self, handle) -> None:
        self.counts = handle.getValueState("counts", "accepted long, attempts long, left long")
        self.bands = handle.getMapState("bands", "band int, bits long", "codes array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["attempt", "code"], kind="stable")
        accepted, attempts, left = self.counts.get() if self.counts.exists() else (0, 0, 0)
        held: dict[tuple[int, int], list[int]] = {}  # what this batch of rows has looked up

        def codes(band: tuple[int, int]) -> list[int]:
            if band not in held:
                held[band] = list(self.bands.getValue(band)[0]) if self.bands.containsKey(band) else []
            return held[band]

        status, changed = [], set()
        for code, bad in zip(pdf["code"].tolist(), pdf["bad"].tolist()):
            if not left:
                left = min(self.batch, self.target - accepted) if accepted < self.target and attempts < self.cap else 0
            if not left:
                status.append("not_tried")
                continue
            attempts, left = attempts + 1, left - 1
            if bad:
                status.append("degenerate")
                continue
            u = code & (1 << 64) - 1
            bands = [(i, (u >> a) & (1 << b - a) - 1) for i, (a, b) in enumerate(self.spans)]
            if any(((x ^ code) & (1 << 64) - 1).bit_count() <= self.most for band in bands for x in codes(band)):
                status.append("near")
                continue
            status.append("accepted")
            accepted += 1
            for band in bands:
                codes(band).append(code)
                changed.add(band)
        for band in changed:
            self.bands.updateValue(band, (held[band],))
        self.counts.update((accepted, attempts, left))
        yield pd.DataFrame({"class": key[0], "attempt": pdf["attempt"].to_numpy(np.int64), "status": status})

    def close(self) -> None:
        pass


def follow(spark: SparkSession, path: str, state: str, target: int, cap: int, batch: int = 16, most: int = 4, files_per_batch: int = 1) -> DataFrame:
    """``(class, attempt, status)`` of all attempts in the tables at ``path`` (see ``SCHEMA``), by ``Acceptor``.

    Attempts of a class are taken in order within a batch of files, and files in the order in which they came. Called again with
    the same ``state`` folder after files were added, it reads only these and goes on where it stopped. Each batch commits as a table of
    its own, which a repeat overwrites. A task holds the new attempts of one class (a few numbers each), and acceptance in order
    makes a class the unit of work. A null class is a class; attempts without a code count as degenerate.
    """
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)
        bad = F.col("bad") | F.col("code").isNull()
        # a null would turn codes into floats on the way
        rows = rows.select("class", "attempt", F.coalesce("code", F.lit(0)).alias("code"), F.coalesce(bad, F.lit(False)).alias("bad"))
        found = rows.groupBy("class").transformWithStateInPandas(Acceptor(target, cap, batch, most), "class string, attempt long, status string", "Append", "None")

        def commit(part: DataFrame, number: int) -> None:
            part.write.mode("overwrite").parquet(f"{state}/decided/batch={number}")

        found.writeStream.outputMode("append").foreachBatch(commit).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    return spark.read.schema("class string, attempt long, status string, batch int").parquet(f"{state}/decided").drop("batch")


def accepted(attempts: DataFrame, target: int, cap: int, batch: int = 16, most: int = 4) -> DataFrame:
    """``follow`` over one table of attempts (see ``SCHEMA``), written to the shared folder first."""
    spark = attempts.sparkSession
    path = fresh_path(spark, "attempts")
    attempts.select("class", "attempt", "code", "bad").write.parquet(path)
    return follow(spark, path, fresh_path(spark, "acceptance"), target, cap, batch, most, 100_000)
