"""A content-addressed table of a provider's answers: equal chunks are asked once, in one run or in many.

A chunk's key is the digest of its text and contexts. A run asks only for keys that no run has answered, one chunk a key, packed
in prompts of a few chunks; a prompt that fails or whose answer can't be read is asked again chunk by chunk, and a chunk that
fails alone stays unanswered, so a later run asks it anew. Answers are appended to the run's own folder when they are whole; a
run that is repeated after a failure finds what it had written and asks the rest. Two runs that ask the same key at one
time both append it, and readers take the answer of the smaller run. What is asked, and how each failure came about, is a table too.

Defined results: chunks of null text count as empty text; a chunk without facts is answered too, with none; repeated chunks
share an answer and each get its claims.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import chunk_key, clean_json, first_of, route_answers
from ..session import dropped, written
from .providers import ANSWER, answers, chunk_prompt, packed_prompts

FACTS = ANSWER.removeprefix("struct<facts:").removesuffix(">")
_ANSWERED = f"key string, facts {FACTS}, asked_as string, run string"


def _facts(answer: Column) -> Column:
    """The facts of an answer; null if it is no JSON object."""
    body = clean_json(answer)
    readable = F.coalesce(F.schema_of_variant(F.try_parse_json(body)).startswith("OBJECT"), F.lit(False))
    return F.when(readable, F.coalesce(F.from_json(body, ANSWER)["facts"], F.array().cast(FACTS)))


class AnswerCache:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, name: str) -> str | None:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return root.toString() if fs.exists(root) else None

    def read(self) -> DataFrame:
        """key, facts, asked_as, run: one row for each answered key."""
        folder = self._folder("answers")
        table = self.spark.createDataFrame([], _ANSWERED) if folder is None else self.spark.read.schema(_ANSWERED).parquet(f"{folder}/*")
        packed = table.groupBy("key").agg(F.min_by(F.struct("facts", "asked_as", "run"), F.struct("run", "asked_as")).alias("x"))
        return packed.select("key", "x.*")

    def asked(self) -> DataFrame:
        """key, document_id, chunk_id, asked_as (batch or chunk), answered, error, run: every asking of every run."""
        return self.spark.read.parquet(f"{self._folder('asked')}/*")

    def ask(self, chunks: DataFrame, provider, run: str) -> DataFrame:
        """Ask for what is unanswered of ``chunks`` (document_id, batch, rank, chunk_id, text, heading_context, table_context); the rows of :meth:`asked` that this adds."""
        keyed = chunks.withColumn("key", chunk_key(F.col("text"), F.col("heading_context"), F.col("table_context")))
        new = keyed.join(self.read().select("key"), "key", "left_anti")
        todo = written(first_of(new, [F.col("key")], [F.col("document_id"), F.col("rank"), F.col("chunk_id")]), "unanswered")
        own = todo.select("key", "document_id", "batch", "rank", "chunk_id", "text")
        packed = written(answers(packed_prompts(todo), provider).withColumn("facts", _facts(F.col("answer"))), "answers")
        claims = packed.where("facts is not null").select("document_id", "batch", F.explode("facts").alias("f")).select("document_id", "batch", F.col("f.chunk_id").alias("chunk_id"), F.col("f.evidence.quote").alias("quote"), "f")
        routed = route_answers(claims, own).groupBy("document_id", "chunk_id").agg(F.collect_list("f").alias("facts"))
        readable = own.join(packed.where("facts is not null").select("document_id", "batch"), ["document_id", "batch"])
        by_batch = readable.join(routed, ["document_id", "chunk_id"], "left").select("key", "document_id", "chunk_id", F.coalesce("facts", F.array().cast(FACTS)).alias("facts"), F.lit("batch").alias("asked_as"), F.lit(None).cast("string").alias("error"))
        lost = todo.join(packed.where("facts is null").select("document_id", "batch", F.coalesce("error", F.lit("unreadable answer")).alias("batch_error")), ["document_id", "batch"])
        alone = answers(lost.select("key", "document_id", "chunk_id", "batch_error", chunk_prompt()), provider).withColumn("facts", _facts(F.col("answer")))
        error = F.concat_ws("; ", "batch_error", F.when(F.col("facts").isNull(), F.coalesce("error", F.lit("unreadable answer"))))
        by_chunk = alone.select("key", "document_id", "chunk_id", "facts", F.lit("chunk").alias("asked_as"), error.alias("error"))
        every = written(by_batch.unionByName(by_chunk), "asked")
        every.where("facts is not null").select("key", "facts", "asked_as", F.lit(run).alias("run")).write.mode("append").parquet(f"{self.path}/answers/run={run}")
        report = every.select("key", "document_id", "chunk_id", "asked_as", F.col("facts").isNotNull().alias("answered"), "error", F.lit(run).alias("run"))
        report.write.mode("append").parquet(f"{self.path}/asked/run={run}")
        dropped(todo, packed)
        return report

    def claims(self, chunks: DataFrame) -> DataFrame:
        """The claims of answered ``chunks``, each with the chunk's columns and chunk_text."""
        keyed = chunks.withColumn("key", chunk_key(F.col("text"), F.col("heading_context"), F.col("table_context")))
        found = keyed.join(self.read().select("key", "facts"), "key").withColumnRenamed("text", "chunk_text").withColumn("f", F.explode("facts")).drop("facts")
        names = [c for c in found.columns if c not in ("f", "key")]
        return found.select(*names, *[F.col(f"f.{c}").alias(c) for c in found.schema["f"].dataType.names if c not in (*names, "evidence")], F.col("f.evidence.quote").alias("quote"))
