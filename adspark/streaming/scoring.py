"""Domain status of a stream of new rows against a fixed training side.

The training layout and thresholds are built once; every micro-batch is scored by the batch
operators. No state is kept between batches, so a lost executor only repeats its batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.domain import point_limits, status_from_limits
from ..operators.neighbours import Space, lay_out


def dknn_stream(train: DataFrame, new_rows: DataFrame, space: Space, k: int, target: str, checkpoint: str) -> StreamingQuery:
    """Append (keys, id, ad_param, inside) of every arriving row to the parquet folder ``target``.

    Batches carry their number as a folder, so a repeated batch overwrites itself.
    """
    layout = lay_out(train, space)
    limits = point_limits(layout, [k])

    def score(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        status = status_from_limits(layout, limits, batch, [k])
        status.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return (
        new_rows.writeStream.foreachBatch(score)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
