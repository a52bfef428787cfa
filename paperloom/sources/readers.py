"""File readers. Each one only scans; the parsing of text is in ``parsers`` and works on any text column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.schemas import AUTHORITY, LINE_DUMP, RECT_COLUMNS, SYNSET
from paperloom.sources import parsers as P


def read_line_dump(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """OCR page dumps, one JSON document per file: the line table and the page table (blank pages included)."""
    d = spark.read.schema(LINE_DUMP).option("multiLine", True).json(path).withColumn("bibkey", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.lines)?\.json$", 1))
    return P.dump_lines(d, "bibkey"), P.dump_pages(d, "bibkey")


def read_words(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Word-box TSV files: words and page sizes. Malformed rows are dropped."""
    rows = spark.read.text(path).select(F.input_file_name().alias("bibkey"), F.col("value"))
    t = P.word_rows(rows, "bibkey", "value")
    return P.words(t), P.page_sizes(t)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file: ``bibkey, path, text``."""
    d = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return d.withColumn("bibkey", F.regexp_extract("path", r"([^/]+?)\.[A-Za-z0-9]+$", 1))


def scan_folder(spark: SparkSession, path: str, metadata: DataFrame | None = None) -> DataFrame:
    """One row per file with its size; cached metadata is joined by path. File contents are not read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    return d.join(metadata, "path", "left") if metadata is not None else d


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rectangle rows from csv, tsv, json or jsonl, chosen by suffix."""
    low = path.lower()
    if low.endswith((".jsonl", ".ndjson")):
        return spark.read.json(path)
    if low.endswith(".json"):
        d = spark.read.option("multiLine", True).json(path)
        return d.select(F.explode("rows").alias("r")).select("r.*") if "rows" in d.columns else d
    return spark.read.option("header", True).option("sep", "\t" if low.endswith(".tsv") else ",").csv(path)


def rect_columns(columns: list[str]) -> dict:
    """Names of the page and rectangle columns of a row frame and whether they are corners or corner and size."""
    low = {c.lower().strip(): c for c in columns}
    page = next((low[c] for c in ("page", "page_num", "page_number", "pageno", "p") if c in low), None)
    for mode, sets in RECT_COLUMNS.items():
        for names in sets:
            if all(n in low for n in names):
                return {"page": page, "mode": mode, "rect": tuple(low[n] for n in names)}
    raise ValueError(f"no rectangle among the columns {columns}")


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """N-Triples lines to ``s, p, o, lang, literal``."""
    return P.triples(spark.read.text(path), "value")


def read_authority(spark: SparkSession, path: str) -> DataFrame:
    """Authority records in RDF/XML, one row per description."""
    return spark.read.format("xml").option("rowTag", "rdf:Description").schema(AUTHORITY).load(path)


def read_synsets(spark: SparkSession, path: str) -> DataFrame:
    """Synset XML, one row per synset."""
    return spark.read.format("xml").option("rowTag", "synset").schema(SYNSET).load(path)


def build_vocabularies(spark: SparkSession, sources: dict[str, tuple]) -> tuple[DataFrame | None, list[str]]:
    """One concept frame of every scheme whose reader finds its input; the names of the missing ones are returned."""
    out, missing = None, []
    for scheme, (reader, path) in sources.items():
        try:
            d = reader(spark, path).withColumn("scheme", F.lit(scheme))
            d.schema  # noqa: B018 - a missing path fails here
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            missing.append(scheme)
            continue
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out, missing
