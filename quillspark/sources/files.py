"""Reading files into elements, and tables of settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("txt", "md", "pdf", "doc", "docx", "ppt", "pptx", "xls", "xlsx", "png", "jpg", "jpeg")


class IngestLimitError(ValueError):
    """Too many files, or too large ones."""


def scan(spark: SparkSession, root: str, max_files: int = 10_000, max_bytes: int = 200 << 20, max_total: int = 2 << 30) -> DataFrame:
    """(path, extension, length, content) of the files under ``root`` that have a known extension; one aggregate checks the limits."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = files.withColumn("extension", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))).where(F.col("extension").isin(*EXTENSIONS))
    n, largest, total = files.agg(F.count("*"), F.max("length"), F.sum("length")).first()
    if n > max_files or (largest or 0) > max_bytes or (total or 0) > max_total:
        raise IngestLimitError(f"{n} files, the largest {largest} bytes, {total} bytes in all")
    return files.select("path", "extension", "length", "content")


def normalized_text(text: Column) -> Column:
    """Line ends and spaces normalised, no more than one empty line, nothing at either end."""
    for pattern, by in ((r"\r\n?", "\n"), (r"[ \t]+", " "), (r"\n ", "\n"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")):
        text = F.regexp_replace(text, pattern, by)
    return text


def text_elements(files: DataFrame) -> DataFrame:
    """One text element for each text or markdown file, normalised; empty files left out."""
    text = normalized_text(F.decode("content", "utf-8"))
    return files.where("extension IN ('txt', 'md')").select(F.col("path").alias("source"), F.lit(0).alias("element_index"), F.lit("text").alias("type"), text.alias("content"), F.lit(None).cast("int").alias("page")).where("content <> ''")


def path_metadata(files: DataFrame, root: str) -> DataFrame:
    """File type, first folder below the root, path parts and a school grade in the name."""
    below = F.expr(f"substring(path, instr(path, '{root}') + {len(root)})")
    parts = F.filter(F.split(below, "/"), lambda p: p != "")
    grade = F.regexp_extract(F.element_at(parts, -1), r"(?iu)(\d{1,2})\s*(?:класс|klass|class)", 1)
    return files.select("path", F.col("extension").alias("file_type"), F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).alias("subject_hint"), parts.alias("path_parts"), grade.try_cast("int").alias("grade"))


def parsed_elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements from JSON output of a parser: a list of objects, or an object with such a list."""
    kind = "array<struct<type:string,content:string,text:string,page:int,page_number:int,page_no:int,page_idx:int,page_index:int>>"
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), "value")
    lists = raw.select("source", "value", F.coalesce(F.from_json(F.get_json_object("value", "$.elements"), kind), F.from_json("value", kind)).alias("e"))
    return lists.select("source", F.posexplode("e").alias("element_index", "item")).select("source", "element_index", "item.*")


def ocr_sample(pages: int, sample: int) -> list[int]:
    """Page numbers to look at: evenly spaced, with the first and the last."""
    if pages <= sample:
        return list(range(pages))
    return sorted({round(i * (pages - 1) / (sample - 1)) for i in range(sample)}) if sample > 1 else [0]


def sampled_pages(pages: Column, sample: int) -> Column:
    """``ocr_sample`` as an expression."""
    n = F.least(pages, F.lit(sample))
    each = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.coalesce(F.bround(F.try_divide(i * (pages - 1), n - 1)), F.lit(0)).cast("int"))
    return F.when(pages > 0, F.array_sort(F.array_distinct(each))).otherwise(F.array().cast("array<int>"))


def preferred_artifacts(files: DataFrame, by: str) -> DataFrame:
    """(by, path, content): of each parser's output the first JSON file that parses, else the first other text that isn't empty."""
    text = F.decode("content", "utf-8")
    usable = files.withColumn("text", text).withColumn("order", F.when((F.col("extension") == "json") & F.try_parse_json("text").isNotNull(), 0).when(F.col("extension").isin("md", "txt") & (F.trim("text") != ""), 1))
    # only places are compared; the texts are fetched for the chosen files
    chosen = usable.where("order IS NOT NULL").groupBy(by).agg(F.min(F.struct("order", "path")).alias("first"))
    return chosen.select(by, F.col("first.path").alias("path")).join(usable.select("path", F.col("text").alias("content")), "path").select(by, "path", "content")


def evaluation_set(spark: SparkSession, path: str) -> DataFrame:
    """Items of an evaluation from JSON files with an array of objects."""
    kind = "query string, category string, expected_source string, expected_pages array<int>, expected_terms array<string>, relevant_fragment_ids array<string>, is_negative boolean"
    return spark.read.schema(kind).option("multiLine", True).json(path).withColumn("is_negative", F.coalesce("is_negative", F.lit(False)))


def subject_hints(spark: SparkSession, path: str, defaults: dict[str, list[str]]) -> DataFrame:
    """(subject, hint): the defaults, each subject replaced by its list in the file if it has one (``subject:`` and ``- hint`` lines)."""
    held, subject = dict(defaults), None
    for (line,) in spark.read.text(path).select(F.trim("value")).collect() if path else ():  # a file of settings
        if line.startswith("#") or not line:
            continue
        if line.startswith("- ") and subject:
            held[subject].append(line[2:].strip().strip("\"'"))
        elif line.endswith(":"):
            subject = line[:-1].strip()
            held[subject] = []
    return spark.createDataFrame([(s, h) for s, hints in held.items() for h in hints], "subject string, hint string")


def needs_ocr(pages: DataFrame, by: str, text: str, least: int = 80) -> DataFrame:
    """(by, pages, text_pages, chars, needs_ocr): unless half of the pages have text, and enough of it on average."""
    size = F.length(F.trim(text))
    told = pages.groupBy(by).agg(F.count("*").alias("pages"), F.count_if(size >= 20).alias("text_pages"), F.sum(size).alias("chars"))
    enough = (F.col("text_pages") >= F.greatest(F.lit(1), F.floor(F.col("pages") / 2))) & (F.col("chars") / F.col("pages") >= least)
    return told.withColumn("needs_ocr", ~enough)
