"""Outside helpers behind small interfaces: language models and OCR. The defaults answer nothing; replays serve tests."""

from __future__ import annotations

import json
import re
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.extract import clean_json

TYPES = ("CORROBORATES", "CONTRADICTS", "CONTEXTUAL_DIFFERENCE", "UNCERTAIN")
CLAIM = (
    "chunk_id string, subject string, predicate string, raw_value string, value_type string, unit string, currency string, time string, "
    "scope string, location string, evidence struct<quote:string>, confidence double"
)
ANSWER = f"struct<facts:array<struct<{', '.join(re.sub(r'^(\w+) ', r'\1:', x) for x in re.split(r', (?=\w+ )', CLAIM))}>>>"
ASK = 'Return {"facts": [...]} with every stated fact.\n\n'
MOST_ERROR = 200  # characters of an error that are kept
VERDICT = "struct<relationship_type:string,confidence:double,explanation:string,supporting_dimensions:array<string>>"


class LLMProvider(Protocol):
    def generate(self, prompt: str) -> str:
        """The model's answer to a prompt; raises if there is none."""


class NullProvider:
    """No model: nothing is extracted, nothing is judged."""

    def generate(self, prompt: str) -> str:
        raise RuntimeError("no provider")


class ReplayProvider:
    """Recorded answers, by a part of the prompt; the first that fits."""

    def __init__(self, answers: dict[str, str]):
        self.answers = answers

    def generate(self, prompt: str) -> str:
        for part, answer in self.answers.items():
            if part in prompt:
                return answer
        raise KeyError("nothing recorded for this prompt")


class Fallback:
    """Several providers in turn, ``attempts`` tries each."""

    def __init__(self, providers: list, attempts: int = 2):
        self.providers, self.attempts = providers, attempts

    def generate(self, prompt: str) -> str:
        last: Exception = RuntimeError("no provider")
        for p in self.providers:
            for _ in range(self.attempts):
                try:
                    return p.generate(prompt)
                except Exception as e:  # a provider's failures are of any kind
                    last = e
        raise last


def answers(prompts: DataFrame, provider, prompt: str = "prompt") -> DataFrame:
    """``prompts`` with the provider's answer, or null and the error. Equal prompts are asked once."""
    distinct = prompts.select(F.sha2(prompt, 256).alias("_key"), F.col(prompt).alias("_prompt")).dropDuplicates(["_key"])

    def ask(frames):
        for f in frames:
            out, errors = [], []
            for p in f["_prompt"]:
                try:
                    out.append(provider.generate(p))
                    errors.append(None)
                except Exception as e:  # a provider's failures are of any kind; they are told apart by type and message
                    out.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:MOST_ERROR])
            yield pd.DataFrame({"_key": f["_key"], "answer": out, "error": errors})

    asked = distinct.mapInPandas(ask, "_key string, answer string, error string")
    return prompts.withColumn("_key", F.sha2(prompt, 256)).join(asked, "_key", "left").drop("_key")


def _chunk() -> Column:
    return F.concat(
        F.lit("[chunk_id: "), F.col("chunk_id"), F.lit("]\n"), F.coalesce(F.concat(F.lit("Heading: "), "heading_context", F.lit("\n")), F.lit("")), F.coalesce(F.concat("table_context", F.lit("\n")), F.lit("")), F.coalesce("text", F.lit(""))
    )


def chunk_prompt() -> Column:
    """The prompt for a chunk alone."""
    return F.concat(F.lit(ASK), _chunk()).alias("prompt")


def packed_prompts(chunks: DataFrame) -> DataFrame:
    """document_id, batch, prompt: a prompt for the chunks of each batch (document_id, batch, rank, chunk_id, text, heading_context, table_context)."""
    batch = chunks.withColumn("_part", _chunk()).groupBy("document_id", "batch").agg(F.array_sort(F.collect_list(F.struct("rank", "_part"))).alias("_p"))
    return batch.select("document_id", "batch", F.concat(F.lit(ASK), F.array_join(F.transform("_p", lambda x: x["_part"]), "\n\n")).alias("prompt"))


def extract_claims(chunks: DataFrame, provider) -> DataFrame:
    """Claims that the provider finds in batches of chunks; nothing is kept or asked again (see sources.answer_cache)."""
    parsed = answers(packed_prompts(chunks), provider).select("document_id", "batch", F.from_json(clean_json(F.col("answer")), ANSWER).alias("a"))
    return parsed.select("document_id", "batch", F.explode("a.facts").alias("f")).select("document_id", "batch", "f.*", F.col("f.evidence.quote").alias("quote")).drop("evidence")


def judged(pairs: DataFrame, provider) -> DataFrame:
    """Pairs (sides a and b, optional a_quote and b_quote) with the judge's relationship in ``r``."""

    def quote(c: str):
        return F.coalesce(F.col(c), F.lit("No quote available")) if c in pairs.columns else F.lit("No quote available")

    def claim(x: str):
        return F.concat(F.lit(f"Claim {x.upper()}: "), F.to_json(F.struct(*[F.col(f"{x}_{c}").alias(c) for c in ("subject", "predicate", "raw_value", "time_label", "scope")])), F.lit("\nQuote: "), quote(f"{x}_quote"), F.lit("\n"))

    asked = answers(pairs.withColumn("prompt", F.concat(F.lit("Compare two claims; return relationship_type, confidence, explanation, supporting_dimensions as JSON.\n"), claim("a"), claim("b"))), provider)
    v = asked.withColumn("v", F.from_json(clean_json(F.col("answer")), VERDICT))
    kind = F.upper(F.coalesce(F.col("v.relationship_type"), F.lit("UNCERTAIN")))
    failed = F.col("answer").isNull() | F.col("v").isNull()
    r = F.struct(
        F.when(failed | ~kind.isin(*TYPES), "UNCERTAIN").otherwise(kind).alias("relationship_type"), F.when(failed, 0.5).otherwise(F.coalesce("v.confidence", F.lit(0.85))).alias("confidence"),
        F.coalesce("v.explanation", F.lit("No verdict.")).alias("explanation"), F.coalesce("v.supporting_dimensions", F.array().cast("array<string>")).alias("supporting_dimensions"), F.lit("llm_judge").alias("resolution_tier"), F.lit("{}").alias("reasoning_metadata"),
    )
    return v.withColumn("r", r).drop("v", "answer", "error", "prompt")


class OCRProvider(Protocol):
    def read(self, image: bytes) -> str:
        """The text of an image."""


def ocr(pages: DataFrame, provider: OCRProvider) -> DataFrame:
    """page_id, ocr_text of pages with a column ``image``."""

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"page_id": f["page_id"], "ocr_text": [None if x is None else provider.read(bytes(x)) for x in f["image"]]})

    return pages.select("page_id", "image").mapInPandas(run, "page_id string, ocr_text string")


def as_json(value) -> str:
    return json.dumps(value, ensure_ascii=False)
