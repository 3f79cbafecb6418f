"""Late repair of a raw table from a stream: every micro-batch is one upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from factorloom.sources.rawstore import RawStore


def upsert_stream(incoming: DataFrame, root: str, name: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start a query that upserts each batch into the table ``name`` of the store at ``root``.

    An upsert of the same rows twice changes nothing, so a batch that is run
    again after a failure does no harm.
    """
    out = incoming.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, _: RawStore(rows.sparkSession, root).upsert(name, rows) and None)
    return (out.trigger(availableNow=True) if once else out).start()
