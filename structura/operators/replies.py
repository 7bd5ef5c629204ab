"""M3 with a reply store: model replies that survive a run that ends early.

A reply costs time and money, so it is kept under the digest of its prompt.
A run asks only for prompts without a stored reply, each distinct prompt
once, in batches that are stored as they end: when a run is killed, the
batches that it has finished stay, and the next run goes on from there.  A
batch writes a folder of its own, in full or not at all, and the reader
takes one reply per digest, so a batch that runs again repeats nothing.

Prompts whose call fails are stored with their error and the number of
calls, and are asked again until ``attempts`` is reached.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.joins import join_group_facts
from ..functions.scratch import materialize
from .prompt import generate_batch

STORE_SCHEMA = "digest string, response string, error string, calls bigint"


def stored_replies(spark: SparkSession, store: str) -> DataFrame:
    """``digest, response, error, calls``: one row per digest in the store: a reply if there is one (the least, if a batch ran twice), else the latest error."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(store)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], STORE_SCHEMA)
    rows = spark.read.schema(STORE_SCHEMA).option("recursiveFileLookup", "true").parquet(store)
    return rows.groupBy("digest").agg(
        F.min("response").alias("response"),
        F.when(F.min("response").isNull(), F.max_by("error", "calls")).alias("error"), F.max("calls").alias("calls"))


def _keyed(prompts: DataFrame, id_col: str, prompt_col: str) -> DataFrame:
    text = F.coalesce(F.col(prompt_col).cast("string"), F.lit(""))
    return prompts.select(F.col(id_col).cast("string").alias("file_id"), F.sha2(text.cast("binary"), 256).alias("digest"), text.alias("prompt"))


def generate_missing(prompts: DataFrame, generator: Callable[[list[str]], list[str]], store: str, attempts: int = 3, batches: int = 8,
                     id_col: str = "file_id", prompt_col: str = "prompt") -> None:
    """Ask ``generator`` for every distinct prompt that ``store`` has no reply for, and store the replies and errors.

    ``batches``: the distinct prompts are dealt by digest into so many jobs,
    each stored when it ends.  One call of this function asks a failing
    prompt again, in a further round, until it has failed ``attempts``
    times in all.  A null prompt counts as empty.
    """
    spark = prompts.sparkSession
    asked = materialize(_keyed(prompts, id_col, prompt_col).groupBy("digest").agg(F.min("prompt").alias("prompt")), "prompts")
    for _ in range(attempts):
        known = materialize(stored_replies(spark, store), "known-replies")
        done = known.filter(F.col("response").isNotNull() | (F.col("calls") >= attempts)).select("digest")
        failed = known.filter("response is null").select("digest", F.col("calls").alias("before"))
        todo = materialize(asked.join(done, "digest", "left_anti").join(failed, "digest", "left")
                           .withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(batches))), "prompts-left")
        buckets = [r.bucket for r in todo.select("bucket").distinct().collect()]  # at most ``batches``
        if not buckets:
            return
        for b in sorted(buckets):
            own = todo.filter(F.col("bucket") == b)
            new = generate_batch(own, generator, id_col="digest").withColumnRenamed("file_id", "digest")
            calls = own.select("digest", (F.coalesce("before", F.lit(0)) + 1).alias("calls"))
            # the calls are written before anything else reads them: the join may run its inputs again
            path = f"{store}/run-{uuid.uuid4().hex}"
            first = materialize(new, "replies")
            first.join(calls, "digest").select("digest", "response", "error", F.col("calls").cast("bigint").alias("calls")).write.parquet(path)


def replies_from_store(prompts: DataFrame, store: str, id_col: str = "file_id", prompt_col: str = "prompt") -> DataFrame:
    """``file_id, response, error`` for every prompt: what the store has for it, null and null for a prompt that was never asked.

    Many prompts may be equal: a digest with more than a thousandth of all
    rows is broadcast, the others meet by shuffle.
    """
    keyed = materialize(_keyed(prompts, id_col, prompt_col).drop("prompt"), "prompt-keys")
    sizes = keyed.groupBy("digest").agg(F.count("*").alias("n"))
    facts = materialize(sizes.join(stored_replies(prompts.sparkSession, store), "digest", "left"), "prompt-replies")
    return join_group_facts(keyed, facts, ["digest"], "n").select("file_id", "response", "error")
