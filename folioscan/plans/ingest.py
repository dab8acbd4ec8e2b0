"""Pages to sections, metadata, chunks, lexical index and catalog as stored tables.

Each stage is written and read back: the table is the end of its lineage, so a
lost executor repeats one stage at most and later stages read only the columns
they need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscan.functions.text import strip, text_or_empty
from folioscan.operators import catalog, chunking, lexical, structure
from folioscan.rules import INDONESIAN, RuleSet
from folioscan.settings import Bm25Settings, ChunkSettings


def stored(df: DataFrame, path: str, *partition: str) -> DataFrame:
    df.write.mode("overwrite").partitionBy(*partition).parquet(path)
    return df.sparkSession.read.parquet(path)


def run_ingest(
    pages: DataFrame,
    folder: str,
    *,
    rules: RuleSet = INDONESIAN,
    chunking_settings: ChunkSettings = ChunkSettings(),
    bm25: Bm25Settings = Bm25Settings(),
    old_catalog: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """``pages(doc_id, source_file, page, text)`` to the tables below ``folder``.

    Documents without any text go to ``rejects`` and keep their old catalog row.
    """
    sections = stored(structure.section_pages(pages, rules), f"{folder}/section_pages")
    meta = stored(
        structure.propagate_cover_metadata(structure.document_metadata(pages, rules), rules),
        f"{folder}/metadata",
    )
    raw_chunks = chunking.chunk_sections(sections, settings=chunking_settings)
    fields = meta.select("doc_id", "title", "author", "year", "program")
    chunks = stored(raw_chunks.join(fields, "doc_id", "left"), f"{folder}/chunks", "stream")
    index = lexical.build_bm25_index(
        chunks.select("chunk_id", F.col("ord"), "stream", "text"), settings=bm25
    ).persist()
    lexical.save_bm25_index(index, f"{folder}/bm25")
    index.unpersist()
    rejects = stored(
        pages.groupBy("doc_id")
        .agg(F.max(F.length(strip(text_or_empty("text")))).alias("chars"))
        .where(F.col("chars") == 0)
        .select("doc_id", F.lit("no_text").alias("reason")),
        f"{folder}/rejects",
    )
    new = catalog.build_catalog(pages, meta, sections, chunks)
    merged = new if old_catalog is None else catalog.merge_catalog(old_catalog, new, rejects)
    cat = stored(merged, f"{folder}/doc_catalog")
    display = stored(catalog.display_metadata(cat, rules), f"{folder}/display_metadata")
    return {
        "section_pages": sections, "metadata": meta, "chunks": chunks, "rejects": rejects,
        "doc_catalog": cat, "display_metadata": display,
    }


def open_index(spark: SparkSession, folder: str, stream: str | None = None) -> lexical.Bm25Index:
    return lexical.load_bm25_index(spark, f"{folder}/bm25", stream=stream)
