"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at a time (one text, if it is longer).
SLICE = 1 << 20
#: Threads in which the tokenizer libraries encode a slice.
THREADS = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which every executor sees.

    Only where the setting is absent (tests, one machine) a temporary folder is
    made and recorded in the session; on a cluster the setting is required.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Lineage ends there: a lost executor costs a re-read of files that all see,
    not a recomputation. Parquet is smaller than a checkpoint of whole rows and
    is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/paperlake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(id_col: str, text_col: str) -> Column:
    """Identity of a row: equal id and text give the same key, nulls included."""
    return F.xxhash64(
        F.coalesce(F.col(id_col).cast("string"), F.lit("\x00null")), F.coalesce(F.col(text_col), F.lit(""))
    )


def text_or_empty(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def free_name(columns: Iterable[str], name: str) -> str:
    """``name``, or a longer one that none of ``columns`` has."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


#: A key is hot when it has more than this share of the rows, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.001


def join_values(rows: DataFrame, values: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``values`` (one row per ``key``; its ``c`` counts the key's rows, of ``total`` or fewer).

    A key that may hold a third of all rows isn't gathered: values of hot keys,
    1,000 at most by their definition, are broadcast; the others are joined by a shuffle.
    """
    names = [x for x in values.columns if x not in (key, "c")]
    hot = values.where(F.col("c") > F.lit(total * HOT_SHARE)).select(key, F.struct(*names).alias("__hot"))
    tagged = rows.join(F.broadcast(hot), key, "left")
    cold = tagged.where("__hot is null").drop("__hot").hint("merge").join(values.where(F.col("c") <= F.lit(total * HOT_SHARE)).drop("c"), key)
    return tagged.where("__hot is not null").select(*rows.columns, "__hot.*").unionByName(cold)


def slices(batches: Iterator[pa.RecordBatch], text: int = -1, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches cut into slices of about ``size`` bytes of the column at ``text``, so that memory doesn't grow with texts.

    Arrow's memory is handed back at the end: the next stage may reuse the worker.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.columns[text]), 0).to_numpy(zero_copy_only=False))
        at = done = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, done + size, side="right")))
            yield batch.slice(at, stop - at)
            at, done = stop, int(ends[stop - 1])
    pa.default_memory_pool().release_unused()


def library_threads() -> None:
    """Call before a tokenizer library is first used; all operators say the same, since workers are reused."""
    os.environ["TOKENIZERS_PARALLELISM"] = "true"
    os.environ["RAYON_NUM_THREADS"] = str(THREADS)
