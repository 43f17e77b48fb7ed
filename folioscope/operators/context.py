"""From hits to sources, context, history and prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import strip, title_case
from .ordered import top_k


def ordered_text(order: str, text: str, separator: str) -> Column:
    """Aggregate: texts in order, joined.  For groups of a known small size."""
    pairs = F.array_sort(F.collect_list(F.struct(order, text)))
    return F.array_join(F.transform(pairs, lambda p: p[text]), separator)


def attach_chunks(hits: DataFrame, chunks: DataFrame, item_id: str = "chunk_id") -> DataFrame:
    """Join chunk columns to hits after ranking, so text never enters the ranking.

    Written hits have a size that Spark knows; if it is small, the chunk table
    is scanned without a shuffle.
    """
    return hits.join(chunks, item_id)


def format_sources(hits: DataFrame, score: str = "score") -> DataFrame:
    """Fill missing document fields and round the score to 4 digits."""
    columns = set(hits.columns)

    def col(name: str, default) -> Column:
        if name not in columns:
            return F.lit(default)
        return F.coalesce(F.col(name), F.lit(default))

    document = col("document_id", K.DEFAULT_DOCUMENT_ID)
    known = F.create_map(*[F.lit(x) for pair in K.DOCUMENT_FILES.items() for x in pair])
    file = F.coalesce(
        F.nullif(col("pdf_file", ""), F.lit("")),
        F.element_at(known, document),
        F.concat(document, F.lit(".pdf")),
    )
    name = F.coalesce(
        F.nullif(col("document_name", ""), F.lit("")),
        F.when(F.lower(document).contains("who"), F.lit(K.DEFAULT_DOCUMENT_NAME)).otherwise(
            title_case(F.regexp_replace(document, "_", " "))
        ),
    )
    kept = [c for c in ("query_id", "rank") if c in columns]
    return hits.select(
        *kept,
        col("chunk_id", "").alias("chunk_id") if "chunk_id" in columns else F.lit("").alias("chunk_id"),
        document.alias("document_id"),
        name.alias("document_name"),
        file.alias("pdf_file"),
        col("section_title", "").alias("section_title"),
        col("page_start", 0).alias("page_start"),
        col("page_end", 0).alias("page_end"),
        F.round(F.col(score), 4).alias("score"),
        col("text", "").alias("text"),
    )


SOURCE_FIELDS = [
    "rank", "chunk_id", "document_id", "document_name", "pdf_file",
    "section_title", "page_start", "page_end", "score", "text",
]


def collect_sources(sources: DataFrame, query_id: str = "query_id") -> DataFrame:
    """One row per query with its ordered sources (the k hits of the query)."""
    return sources.groupBy(query_id).agg(
        F.array_sort(F.collect_list(F.struct(*SOURCE_FIELDS))).alias("sources")
    )


def source_block(s: Column) -> Column:
    pages = F.when(
        s["page_start"] == s["page_end"],
        F.concat(F.lit("Page "), s["page_start"].cast("string")),
    ).otherwise(
        F.concat(
            F.lit("Pages "), s["page_start"].cast("string"), F.lit("-"), s["page_end"].cast("string")
        )
    )
    section = F.when(
        F.coalesce(s["section_title"], F.lit("")) != "",
        F.concat(F.lit(", Section: "), s["section_title"]),
    ).otherwise("")
    return F.concat(
        F.lit("["), s["rank"].cast("string"), F.lit("] Document: "), s["document_name"],
        section, F.lit(" | "), pages, F.lit("\n"), s["text"],
    )


def context_text(sources: Column) -> Column:
    """Context of an ordered array of sources; a placeholder when there is none."""
    joined = F.array_join(F.transform(sources, source_block), K.CONTEXT_SEPARATOR)
    return F.when(F.coalesce(F.size(sources), F.lit(0)) > 0, joined).otherwise(
        F.lit(K.EMPTY_CONTEXT)
    )


def build_context(
    queries: DataFrame, sources: DataFrame, query_id: str = "query_id"
) -> DataFrame:
    """``query_id, context, n_sources`` of every query."""
    per_query = queries.select(query_id).join(collect_sources(sources, query_id), query_id, "left")
    count = F.when(F.col("sources").isNull(), 0).otherwise(F.size("sources"))
    return per_query.select(
        query_id,
        context_text(F.col("sources")).alias("context"),
        count.cast("bigint").alias("n_sources"),
    )


def conversation_pairs(turns: DataFrame) -> DataFrame:
    """User turns paired with the assistant turn that follows, per conversation.

    ``turns`` is ``conv_id, turn, role, text``; the partner is found by turn
    number, so a very long conversation is not gathered in one place.
    """
    asked = turns.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("query")
    )
    answered = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return asked.join(answered, ["conv_id", "turn"])


def history_window(
    pairs: DataFrame, turns: int = K.HISTORY_TURNS, conv_id: str = "conv_id"
) -> DataFrame:
    """``conv_id, history, n_turns`` from the last ``turns`` question/answer pairs."""
    block = F.concat(
        F.lit("User: "), F.col("query"), F.lit("\nAssistant: "), F.col("answer")
    )
    recent = top_k(pairs, [conv_id], [F.desc("turn")], turns, "_back")
    return (
        recent.withColumn("_block", block)
        .groupBy(conv_id)
        .agg(
            ordered_text("turn", "_block", "\n\n").alias("history"),
            F.count(F.lit(1)).alias("n_turns"),
        )
    )


def enrich_query(
    queries: DataFrame,
    query: str = "query",
    category: str = "bp_category",
    comorbidities: str = "comorbidities",
    out: str = "dense_query",
) -> DataFrame:
    """Text for the dense leg: query, category and comorbidities.

    The sparse leg keeps the raw query.
    """
    kind = F.coalesce(F.col(category), F.lit(""))
    others = F.array_join(F.coalesce(F.col(comorbidities), F.array().cast("array<string>")), " ")
    full = strip(F.concat(F.col(query), F.lit(" "), kind, F.lit(" "), others))
    return queries.withColumn(
        out, F.when((kind != "") | (others != ""), full).otherwise(F.col(query))
    )


def _joined_or(items: Column, default: str) -> Column:
    text = F.array_join(F.coalesce(items, F.array().cast("array<string>")), ", ")
    return F.when(text == "", F.lit(default)).otherwise(text)


def patient_note(vitals: Column, summary: Column) -> Column:
    """Prompt part for a structured patient record; empty when there is none."""

    def number(name: str) -> Column:
        return F.coalesce(vitals[name].cast("string"), F.lit(K.UNKNOWN_READING))

    note = F.concat(
        F.lit(K.PATIENT_HEAD),
        F.lit("- Blood Pressure: "), number("systolic"), F.lit("/"), number("diastolic"),
        F.lit(" mmHg ("),
        F.coalesce(vitals["bp_category"], F.lit(K.DEFAULT_BP_CATEGORY)),
        F.lit(")\n- Comorbidities / Risk Factors: "),
        _joined_or(vitals["comorbidities"], K.NO_COMORBIDITIES),
        F.lit("\n- Current Medications: "),
        _joined_or(vitals["medications"], K.NO_MEDICATIONS),
        F.lit("\n- Report Summary: "),
        F.coalesce(summary, F.lit("")),
        F.lit("\n\n" + K.PATIENT_TAIL),
    )
    return F.when(vitals.isNull(), F.lit("")).otherwise(note)


def patient_text_note(text: Column) -> Column:
    """Prompt part for a free-text patient record."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("")).otherwise(
        F.concat(F.lit(K.PATIENT_TEXT_HEAD), text, F.lit("\n\n"))
    )


def target_note(doc_filter: Column, name: Column, organization: Column) -> Column:
    head, rest = K.TARGET_NOTE.split("{name}")
    middle, tail = rest.split("{organization}")
    note = F.concat(
        F.lit(head), F.coalesce(name, doc_filter), F.lit(middle),
        F.coalesce(organization, F.lit("")), F.lit(tail),
    )
    return F.when(F.coalesce(doc_filter, F.lit("")) == "", F.lit("")).otherwise(note)


def build_prompt(
    context: Column, query: Column, patient: Column, history: Column, target: Column
) -> Column:
    blank = F.lit("")
    past = F.when(F.coalesce(history, blank) == "", blank).otherwise(
        F.concat(history, F.lit("\n\n"))
    )
    return F.concat(
        F.lit("CONTEXT:\n"), context, F.lit("\n\n"),
        F.coalesce(patient, blank), past, F.coalesce(target, blank),
        F.lit("QUESTION: "), query, F.lit("\n\nANSWER:"),
    )
