"""Prompts, recorded or called answers, and reuse of equal prompts within a question."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The prompt's sentences.
OPENING = 'Answer the question using only the context below.\nIf the question is a yes-or-no question, answer with exactly one word: "yes" or "no".\n'
SHORT = "Otherwise, answer as briefly as possible with the exact name or phrase from the context -- not a full sentence.\n\n"
CERTIFIED = "Otherwise, return only the requested entity, attribute, locality, or option required by the verified certificate -- not a full sentence.\n\n"
HINTS = {
    "bridge_comparison": "Internally identify the intermediate entity and requested attribute for each option, compare the two attributes, then return only the winning option.\n",
    "direct_comparison": "Internally identify the requested attribute for each option, compare them, then return only the answer.\n",
    "chained_reasoning": "Internally follow the relation chain across the ordered evidence before answering.\n",
}
CONTRACT = (
    "Execute the verified reasoning certificate below exactly. Trace each final operation input through its dependency branch and use its resolved bindings.\n"
    "For a comparison phrased as 'Which/Who/A or B', return the winning option from the question, never yes/no. Respect the operator direction: younger/later means the later date; older/first/earlier means the earlier date.\n"
    "Render only the final answer in the form requested by the question. Preserve an explicitly supported nationality or demonym for a nationality question; use a country noun only when the question unambiguously requests the named country. "
    "Do not expand or convert a supported surface merely to make it more specific. For a birth/death place, return the conventional place entity: retain a region when it is part of the place name, but omit a descriptive geographic hierarchy beyond that entity.\n"
    "Verified certificate:\n"
)
RETRIES = 7


def prompt(question: Column, context: Column, route: Column | None = None, certificate: Column | None = None) -> Column:
    """The prompt's text.  ``route`` adds the hint of a chain-aware method, ``certificate`` (JSON, null: none) its contract."""
    hint, contract, style = F.lit(""), F.lit(""), F.lit(SHORT)
    if route is not None:
        for name, text in HINTS.items():
            hint = F.when(route == name, F.lit(text)).otherwise(hint)
    if certificate is not None:
        contract = F.when(certificate.isNotNull(), F.concat(F.lit(CONTRACT), certificate, F.lit("\n\n"))).otherwise(F.lit(""))
        style = F.when(certificate.isNotNull(), F.lit(CERTIFIED)).otherwise(F.lit(SHORT))
    return F.concat(F.lit(OPENING), style, hint, contract, F.lit("Context:\n"), F.coalesce(context, F.lit("")), F.lit("\n\nQuestion: "), question, F.lit("\nAnswer:"))


def first_use(rows: DataFrame, order: str = "row") -> DataFrame:
    """``generation_reused``: false for the first row of each (qid, prompt), which pays for the call."""
    w = W.partitionBy("qid", F.md5("prompt")).orderBy(order)
    return rows.withColumn("generation_reused", F.row_number().over(w) > 1)


def recorded(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers of an earlier run, ``answers (prompt_sha256, answer, prompt_tokens, output_tokens)``; a reused row costs nothing."""
    keyed = first_use(rows).withColumn("prompt_sha256", F.sha2("prompt", 256)).join(answers, "prompt_sha256", "left")
    paid = lambda c: F.when(F.col("generation_reused"), 0).otherwise(F.col(c)).alias(c)
    return keyed.select(*rows.columns, "generation_reused", "answer", paid("prompt_tokens"), paid("output_tokens"), F.when(F.col("answer").isNull(), "answer_missing").alias("error"))


def called(rows: DataFrame, backend: Callable[[str], str], wait: float = 1.0) -> DataFrame:
    """``qid, row, answer, error`` of a chat backend, one call for each distinct prompt of a question.

    A failing call is tried again, at most ``RETRIES`` times in all with doubled waits; then the row has an error.
    """
    once = first_use(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            answers, errors = [], []
            for text in b.column("prompt").to_pylist():
                answer = error = None
                for i in range(RETRIES):
                    try:
                        answer, error = backend(text), None
                        break
                    except Exception as e:  # noqa: BLE001 - every backend has its own errors
                        error = type(e).__name__
                        time.sleep(wait * 2**i if i + 1 < RETRIES else 0)
                answers.append(answer), errors.append(error)
            yield pa.RecordBatch.from_arrays([b.column("qid"), b.column("key"), pa.array(answers, pa.string()), pa.array(errors, pa.string())], names=["qid", "key", "answer", "error"])

    kind = dict(rows.dtypes)["qid"]
    paid = once.filter("not generation_reused").select("qid", F.md5("prompt").alias("key"), "prompt").mapInArrow(run, f"qid {kind}, key string, answer string, error string")
    return once.withColumn("key", F.md5("prompt")).join(paid, ["qid", "key"]).select("qid", "row", "generation_reused", "answer", "error")


def structured(rows: DataFrame, schema: str, required: list[str]) -> DataFrame:
    """``answer`` parsed as a JSON object with exactly the fields ``required``; ``structured_generation_invalid`` where it is not."""
    keys = F.array_sort(F.json_object_keys("answer"))
    fits = keys == F.array(*map(F.lit, sorted(required)))
    parsed = F.when(fits, F.from_json("answer", schema))
    return rows.withColumn("parsed", parsed).withColumn("error", F.when(parsed.isNull(), "structured_generation_invalid"))
