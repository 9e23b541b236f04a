"""Scoring of arriving queries against a fixed index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from phytomill.operators import search


def score_stream(queries: DataFrame, index: DataFrame, out: str, checkpoint: str, k: int = 5, key: str = "vec_id", query: str = "query_id") -> StreamingQuery:
    """Answer each micro-batch of a stream of (query, embedding) with topk and append the results to Parquet.

    The index is read once a batch; results of a batch that is repeated after a failure overwrite the same folder.
    """

    def answer(batch: DataFrame, number: int) -> None:
        hits = search.results(search.topk(index, batch, k, key, query))
        hits.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
