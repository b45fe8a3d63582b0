"""Document ids of a stream of records: the stream's counter is kept as state across batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

COUNTER = 1 << 20


class StreamCounter(StatefulProcessor):
    """Gives each record ts << 20 | counter; the counter goes on where the last batch ended."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("counter", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.state.get()[0] if self.state.exists() else 0
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "seq"], ignore_index=True)
        numbers = (n + 1 + pd.Series(range(len(pdf)))) % COUNTER
        n = (n + len(pdf)) % COUNTER
        yield pd.DataFrame({"stream_id": pdf["stream_id"], "seq": pdf["seq"], "document_id": pdf["ts"] * COUNTER + numbers})
        self.state.update((n,))

    def close(self) -> None:
        pass


def with_stream_ids(records: DataFrame) -> DataFrame:
    """(stream_id, seq, document_id) of records (stream_id, seq, ts).

    State is a number per stream, kept by RocksDB in the checkpoint. Order inside a batch is by
    (ts, seq). A stream's counter is sequential by its nature, so its rows of one batch (three
    numbers each) pass through one task; the source's limit of files per batch bounds them.
    """
    return records.groupBy("stream_id").transformWithStateInPandas(StreamCounter(), "stream_id bigint, seq bigint, document_id bigint", "append", "none")
