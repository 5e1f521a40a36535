"""Transforms of datasets that arrive file by file.

A batch of lines is parsed, what cannot be used is set aside with its reason, and the rest is asked about once: replies go to the ledger of the batch before
anything is made of them. Each batch writes one folder of the output, as a whole. A batch that is repeated after a failure finds its replies and
writes the same folder again, so nothing is lost, doubled or paid for twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairsmith.functions.text import is_blank, utrim
from pairsmith.operators import gates, records
from pairsmith.plans import transforms
from pairsmith.sources.providers import Provider
from pairsmith.sources.sinks import as_json
from pairsmith.sources.staging import written

MODES = ("sft-to-dpo", "regen-rejected", "regen-plain")
NO_OBJECT, NO_PROMPT, NO_REPLY = "no JSON object", "no prompt", "no reply"


def lines_of(spark: SparkSession, path: str, at_once: int = 100) -> DataFrame:
    """A stream of (file, line) of the text files that arrive in a folder, ``at_once`` files at a time: the bound is the back pressure."""
    stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", at_once).text(path)
    return stream.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).where(~is_blank(F.col("line")))


def usable(lines: DataFrame, mode: str, style: str = "sharegpt") -> DataFrame:
    """(line_no, file, line, problem, r): the record of each line, or what is wrong with it. A line's number is a hash of it and its file.

    Equal lines of a file have one number; they are asked about once and all go on.
    """
    schema = records.SFT_SCHEMA if mode == "sft-to-dpo" else records.DPO_SCHEMA
    parsed = lines.select("file", "line", F.xxhash64("file", "line").alias("line_no"), F.from_json(utrim(F.col("line")), f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}).alias("r"))
    whole = F.col("r").isNotNull() & F.col("r._corrupt").isNull()
    if mode == "sft-to-dpo":
        fields = parsed.select("file", "line", "line_no", "r", whole.alias("whole"), "r.*").drop("_corrupt")
        both = records.prompt_and_chosen(fields, style)
        no_prompt, no_reply = F.col("prompt").isNull(), F.col("chosen").isNull()
    else:
        both = parsed.select("file", "line", "line_no", "r", whole.alias("whole"), "r.prompt", "r.chosen")
        # With reasoning a pair may lack a chosen reply: it is passed on as it is.
        no_prompt, no_reply = is_blank(F.col("prompt")), is_blank(F.col("chosen")) if mode == "regen-plain" else F.lit(False)
    problem = F.when(~F.col("whole"), F.lit(NO_OBJECT)).when(no_prompt, F.lit(NO_PROMPT)).when(no_reply, F.lit(NO_REPLY))
    return both.select("line_no", "file", "line", problem.alias("problem"), "r")


def _made(good: DataFrame, mode: str, style: str, provider: Provider, ledger: str, text: str | None) -> dict[str, DataFrame]:
    """(line_no, record columns) by the name of the output."""
    each = good.select("line_no", "r.*").drop("_corrupt").dropDuplicates(["line_no"])
    if mode == "sft-to-dpo":
        return {"dataset": transforms.sft_to_dpo(each, style, provider, ledger=ledger, text=text)}
    if mode == "regen-plain":
        return {"dataset": transforms.regen_plain(each, provider, ledger=ledger, text=text).withColumnRenamed("job_id", "line_no")}
    plain, reasoned = transforms.regen_rejected(each, provider, ledger=ledger, text=text)
    return {"dataset": plain.withColumnRenamed("job_id", "line_no"), "dataset_reasoning": reasoned.withColumnRenamed("job_id", "line_no")}


def transform_stream(
    lines: DataFrame, mode: str, provider: Provider, output: str, checkpoint: str, style: str = "sharegpt", text: str | None = None, forever: bool = False, keep: Callable[[DataFrame], Column] | None = None
) -> StreamingQuery:
    """A started query that makes pairs of a stream of (file, line), in ``<output>/dataset``, for regeneration with reasoning in ``<output>/dataset_reasoning`` too.

    Lines that cannot be used are in ``<output>/rejects`` as (file, line, problem). A call that fails ends the query with an error when the
    others of its batch are done; started again with the same checkpoint, it asks only for what is missing. It ends when all files that are there have been
    read, unless ``forever``. ``keep`` gives a condition on (prompt, chosen, rejected) that pairs must meet.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")

    def batch(rows: DataFrame, number: int) -> None:
        told = written(usable(rows, mode, style))
        good = told.where("problem is null")
        told.where("problem is not null").select("file", "line", "problem").write.mode("overwrite").parquet(f"{output}/rejects/batch={number}")
        copies = good.select("line_no")
        for name, made in _made(good, mode, style, provider, f"{output}/replies/batch={number}", text).items():
            out = copies.join(made, "line_no").drop("line_no")
            out = out if keep is None else out.where(keep(out))
            as_json(out).write.mode("overwrite").text(f"{output}/{name}/batch={number}")

    query = lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (query if forever else query.trigger(availableNow=True)).start()


def complete_replies(rows: DataFrame) -> Column:
    """A condition for ``keep``: the chosen reply passes the gates as one that stopped by itself."""
    none = F.lit(None).cast("string")
    return gates.failure_reason(rows["chosen"], none, F.lit("stop")).isNull()
