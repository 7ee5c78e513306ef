"""Restoring originals in streams of chunks, with the end of each stream held back until it cannot be a placeholder."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hushframe.operators.restore import RestoreError, Restorer, with_known

OUT = "stream_id long, field string, seq long, text string"


def restore_chunks(chunks: DataFrame, found: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """OUT: what each chunk lets out. `chunks` (stream_id, field, seq, chunk, flush) is a stream, `found` a table.

    Each (stream_id, field) is a stream of its own; chunks of one micro-batch are taken by seq. The state is the held
    text, its length bounded by the longest placeholder. If tolerant restoring fails, what was held comes exactly restored. With `idle_ms`, a stream
    that gets no chunk for so long gives out what is held; Spark then makes batches without end, so the query needs a
    processing-time trigger rather than availableNow.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, last = state.get if state.exists else ("", -1)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(*key, last, pending)], columns=["stream_id", "field", "seq", "text"])
            return
        out, rest = [], None
        for row in pd.concat(list(frames)).sort_values("seq", kind="stable").itertuples():
            if rest is None:
                known = [(k["placeholder"], k["original"]) for k in (row.known if row.known is not None else [])]
                rest = Restorer(known, list(row.kinds) if row.kinds is not None else [], in_json=row.field.endswith("arguments"))
                rest.pending = pending
            try:
                said = rest.feed(row.chunk or "", bool(row.flush))
            except RestoreError as e:
                said = e.unemitted
            out.append((*key, row.seq, said))
        if rest.pending:
            state.update((rest.pending, out[-1][2]))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["stream_id", "field", "seq", "text"])

    rows = with_known(chunks, found, "stream_id")
    return rows.groupBy("stream_id", "field").applyInPandasWithState(run, OUT, "pending string, seq long", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)
