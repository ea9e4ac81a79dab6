"""Background renewal of vectors: requests as a stream, merged by node, and all facets of a node replaced when their joint hash changes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.vectors import embed_facets, joint_hash

FACETS = "array<struct<facet:string,text:string>>"
REQUESTS = f"id string, at long, facets {FACETS}"


def _newest(key: tuple, requests: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The newest of a node's requests, if it is newer than the last one known and its facets differ from those."""
    best = None
    for chunk in requests:
        row = chunk.sort_values(["at", "hash"]).iloc[-1]
        if best is None or (row["at"], row["hash"]) > (best["at"], best["hash"]):
            best = row
    at, known = state.get if state.exists else (None, None)
    if at is not None and (best["at"], best["hash"]) <= (at, known):
        return
    state.update((int(best["at"]), best["hash"]))
    if best["hash"] != known:
        yield pd.DataFrame({"id": [key[0]], "at": [int(best["at"])], "hash": [best["hash"]], "facets": [best["facets"]]})


def due_nodes(requests: DataFrame, provider: str) -> DataFrame:
    """A stream of requests (id, at, facets) -> id, at, hash, facets of the nodes whose vectors must be made again. However many requests
    a node has in a micro-batch, it is due once; later ones with the same facets, or older ones, don't count. Requests without an id or
    a time are passed over; at equal times the greater hash counts, in whatever order they come."""
    text = F.to_json(F.struct(F.coalesce("facets", F.array().cast(FACETS)).alias("f")))
    keyed = requests.where("id is not null and at is not null").select("id", "at", joint_hash(provider, F.col("facets")).alias("hash"), text.alias("facets"))
    due = keyed.groupBy("id").applyInPandasWithState(_newest, "id string, at long, hash string, facets string", "at long, hash string", "update", GroupStateTimeout.NoTimeout)
    return due.withColumn("facets", F.from_json("facets", f"f {FACETS}")["f"])


def refresh_stream(spark: SparkSession, path: str, root: str, checkpoint: str, provider: str, embed: Callable[[DataFrame], DataFrame], once: bool = True) -> StreamingQuery:
    """Reads JSON requests below path and writes the vectors of the nodes that are due below root, a folder for each micro-batch. One
    that is run again writes its own folder again, so each request counts once. embed: (id, text) -> (id, vector)."""

    def each(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{root}/due/epoch={epoch}")  # the state is asked once
        due = spark.read.schema(rows.schema).parquet(f"{root}/due/epoch={epoch}")
        texts = due.select("id", F.explode("facets").alias("f")).select("id", "f.facet", "f.text")
        new = due.select("id", "at", "hash").join(embed_facets(texts, embed), "id", "left")  # a node without facets keeps a row without one
        new.write.mode("overwrite").parquet(f"{root}/vectors/epoch={epoch}")

    writer = due_nodes(spark.readStream.schema(REQUESTS).json(path), provider).writeStream.outputMode("update")
    writer = writer.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def facet_vectors(spark: SparkSession, root: str) -> DataFrame:
    """id, facet, hash, vector as they are now: those of each node's newest refresh."""
    rows = spark.read.schema("id string, at long, hash string, facet string, vector array<double>, epoch long").parquet(f"{root}/vectors")
    last = rows.groupBy("id").agg(F.max(F.struct("at", "hash", "epoch")).alias("last"))
    now = rows.join(last, "id").where("at = last.at and hash = last.hash and epoch = last.epoch")
    return now.where("facet is not null").select("id", "facet", "hash", "vector")
