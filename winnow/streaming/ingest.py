"""New vectors assigned to known centroids as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from winnow.operators.blocks import assigned
from winnow.operators.kmeans import Centroids


def assign_stream(vectors: DataFrame, centroids: Centroids, folder: str, checkpoint: str, kind: str = "l2") -> StreamingQuery:
    """Append (id, cluster_id, dist) of each new vector to ``folder`` until what is there has been read.

    The centroids are few and travel to the tasks.  Assignment keeps no state, so a batch that is repeated
    after a failure gives the same rows, and the file sink's log admits them once.
    """
    near = assigned(vectors, centroids.rows, centroids.ids, kind)
    return near.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
