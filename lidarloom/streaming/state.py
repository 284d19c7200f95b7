"""Streaming forms: admission as keyed state, and hierarchy expansion into a growing registry."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.admission import LEDGER, RANGE_BYTES, SLOTS, Ledger, rows


def admission_stream(events: DataFrame, range_bytes: int = RANGE_BYTES, slots: int = SLOTS) -> DataFrame:
    """The ledger of the batch query over a stream of events; the state of a provider is its counters and open leases."""
    names = [x.split()[0] for x in LEDGER.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ledger = pickle.loads(state.get[0]) if state.exists else Ledger(range_bytes, slots)
        got = pd.concat(list(batches)).sort_values("seq")
        out = pd.DataFrame(list(rows(ledger, key[0], got)), columns=names)
        state.update((pickle.dumps(ledger),))
        yield out

    return events.groupBy("provider").applyInPandasWithState(run, LEDGER, "ledger binary", "append", "NoTimeout")


def registry_stream(pages: DataFrame, path: str, checkpoint: str):
    """Tiles of arriving pages appended to the registry at path; one file set for each batch, written again as a whole if a batch is retried."""

    def put(batch: DataFrame, number: int) -> None:
        batch.select(F.col("uri"), "key", "kind").where("uri is not null").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return pages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
