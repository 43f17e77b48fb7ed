"""Patient reports: page text to one report text, extraction by a plug-in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import constants as K
from ..functions.text import strip
from ..plugins import Extractor


def report_text(pages: DataFrame) -> DataFrame:
    """``document_id, text``: pages with text under a page line, in page order.

    One report is one uploaded file, so a group is the pages of one file.
    """
    block = F.concat(
        F.lit("--- Page "), F.col("page_number").cast("string"), F.lit(" ---\n"),
        strip(F.col("text")),
    )
    kept = pages.where(strip(F.col("text")) != "").withColumn("_block", block)
    parts = F.array_sort(F.collect_list(F.struct("page_number", "_block")))
    return kept.groupBy("document_id").agg(
        F.array_join(F.transform(parts, lambda p: p["_block"]), "\n\n").alias("text")
    )


def extract_vitals(
    reports: DataFrame,
    extractors: list[Extractor],
    sent: int | None = None,
    kept: int | None = None,
) -> DataFrame:
    """``document_id, raw_text, vitals, summary`` by the first extractor that works.

    An extractor turns text into JSON.  A report none can read fails the job.
    Extractors get the whole text and all of it is kept, unless ``sent`` or
    ``kept`` bounds the characters (``constants.REPORT_TEXT_SENT`` and ``_KEPT``
    suit models with a small context).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["json"] = [_first_json(extractors, t, sent) for t in batch["text"]]
            yield batch

    answered = reports.select("document_id", "text").mapInPandas(
        run, "document_id string, text string, json string"
    )
    return parse_vitals(answered, kept=kept)


def _first_json(extractors: list[Extractor], text: str, sent: int | None) -> str:
    import json

    problem: Exception | None = None
    for extractor in extractors:
        try:
            answer = extractor.extract(text[:sent]).strip()
            json.loads(answer)
            return answer
        except Exception as error:
            problem = error
    raise RuntimeError(f"no extractor could read the report: {problem}")


def parse_vitals(answered: DataFrame, json: str = "json", kept: int | None = None) -> DataFrame:
    """Read extractor output; a missing summary gets the default text."""
    text = F.col("text") if kept is None else F.left("text", F.lit(kept))
    vitals = F.from_json(json, schemas.VITALS)
    return answered.select(
        "document_id",
        text.alias("raw_text"),
        vitals.alias("vitals"),
        F.coalesce(vitals["clinical_summary"], F.lit(K.DEFAULT_REPORT_SUMMARY)).alias("summary"),
    )
