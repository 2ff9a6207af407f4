"""Sources: text and JSON lines, page files, archives of images, paged web interfaces.

Files are found and read by Spark; nothing opens a path on the driver or on one machine.
"""

from __future__ import annotations

import io
import re
import time
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scripts import TAMIL, ScriptProfile
from ..operators import corpus, metrics
from ..operators.pairs import PAIR

IMAGES = ("png", "jpg", "jpeg", "tiff", "tif", "bmp", "webp")
MAX_PAGES = 100
PAGES = "path string, page int, content binary"


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Stripped lines that are not blank."""
    return spark.read.text(path).select(T.strip(F.col("value")).alias("line")).where("line <> ''")


def json_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pairs from JSON lines; blank lines are skipped, a missing source is ``unknown``."""
    return spark.read.schema(PAIR).json(path).where("input is not null or target is not null").withColumn("source", F.coalesce("source", F.lit("unknown")))


def page_files(spark: SparkSession, path: str, suffix: str = "pdf") -> DataFrame:
    """Files below ``path`` with the suffix, but for those marked as verified; :func:`discover` has their paths in order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").option("recursiveFileLookup", "true").load(path)
    return files.where(~F.col("path").contains("(verify)")).select("path", "content")


def discover(paths: DataFrame) -> DataFrame:
    """The same choice over a table of paths."""
    return paths.where(F.lower("path").endswith(".pdf") & ~F.col("path").contains("(verify)")).orderBy("path")


def image_pages(spark: SparkSession, path: str) -> DataFrame:
    """Each image file is a document of one page."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).isin(*IMAGES)).select("path", F.lit(1).alias("page"), "content")


#: First bytes of the image formats.
SIGNATURES = (b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"II*\0", b"MM\0*", b"BM", b"RIFF")


def _place(name: str) -> tuple:
    """Numbers within a name count as numbers: image2 before image10."""
    return tuple((0, int(x)) if x.isdigit() else (1, x) for x in re.split(r"(\d+)", name) if x)


def docx_pages(files: DataFrame, most: int = MAX_PAGES) -> DataFrame:
    """Each image within a document (path, content) is a page; what is no image is skipped, a document without any or with too many fails."""

    def pages(path: str, content: bytes) -> list[dict]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = sorted((n for n in z.namelist() if n.startswith("word/media/") and n.rpartition(".")[2].lower() in IMAGES), key=_place)
            images = [data for data in map(z.read, names) if data.startswith(SIGNATURES)]
        if not images:
            raise ValueError(f"{path} holds no images")
        if len(images) > most:
            raise ValueError(f"{path} has {len(images)} pages, more than {most}")
        return [{"path": path, "page": i, "content": data} for i, data in enumerate(images, 1)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch.path, batch.content, strict=True):
                yield pd.DataFrame(pages(path, content), columns=["path", "page", "content"])

    return files.select("path", "content").mapInPandas(run, PAGES)


def pdf_pages(files: DataFrame, dpi: int = 300) -> DataFrame:
    """Pages of PDF files (path, content): the embedded image of an image-only page, else a rendering. Needs the PyMuPDF library on the workers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz

        for batch in batches:
            for path, content in zip(batch.path, batch.content, strict=True):
                with fitz.open(stream=content, filetype="pdf") as document:
                    for number, page in enumerate(document, 1):
                        images = page.get_images(full=True)
                        only_image = len(images) == 1 and not page.get_text("text").strip()
                        data = document.extract_image(images[0][0])["image"] if only_image else page.get_pixmap(dpi=dpi).tobytes("png")
                        yield pd.DataFrame([{"path": path, "page": number, "content": data}])

    return files.select("path", "content").mapInPandas(run, PAGES)


def document_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, content) of all documents below ``path``: PDF and DOCX files and images."""
    parts = [pdf_pages(page_files(spark, path)), docx_pages(page_files(spark, path, "docx")), image_pages(spark, path)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def at_most(pages: DataFrame, most: int = MAX_PAGES) -> DataFrame:
    """``pages`` as it is, or a failure for a document of more pages; the source is read once and pages are dealt by document."""
    n = F.count("*").over(Window.partitionBy("path"))
    checked = F.when(n <= most, True).otherwise(F.raise_error(F.format_string("%s has %s pages", "path", n.cast("string"))).cast("boolean"))
    return pages.withColumn("ok_", checked).where("ok_").drop("ok_")


def with_retries(call: Callable[[dict], dict], params: dict, tries: int = 3, wait: Callable[[float], None] = time.sleep) -> dict:
    """The answer of a web interface, or nothing after ``tries`` failures; waits 1, 2, 4 ... seconds between."""
    for attempt in range(tries):
        try:
            return call(params)
        except Exception:
            if attempt + 1 < tries:
                wait(2**attempt)
    return {}


def paged(call: Callable[[dict], dict], params: dict, items: str, limit: int) -> Iterator[dict]:
    """The items of a listing that goes on by continuation tokens."""
    seen, more = 0, dict(params)
    while True:
        answer = with_retries(call, more)
        for item in answer.get("query", {}).get(items, []):
            if seen == limit:
                return
            seen += 1
            yield item
        if not answer.get("continue"):
            return
        more = {**params, **answer["continue"]}


def fetched_texts(urls: DataFrame, fetch: Callable[[str], str]) -> DataFrame:
    """(url, text, error) of a table of addresses: a page that cannot be fetched is a row with its error, the others go on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url in batch.url:
                try:
                    rows.append((url, fetch(url), None))
                except Exception as e:  # one address's failure is reported in its row
                    rows.append((url, None, str(e)))
            yield pd.DataFrame(rows, columns=["url", "text", "error"])

    return urls.select("url").mapInPandas(run, "url string, text string, error string")


def page_sentences(pages: DataFrame, key: str, html: str, profile: ScriptProfile = TAMIL, most: int | None = None) -> DataFrame:
    """Valid sentences of web pages, tags stripped and character references decoded; with ``most`` the first so many."""
    plain = pages.where(F.col(html).isNotNull()).select(key, T.decode_entities(T.strip_tags(F.col(html)), closed=True).alias("text"))
    return corpus.sentences(plain, key, profile, most)


def first_that_works(*sources: Callable[[], DataFrame]) -> DataFrame:
    """The table of the first source that can be read and holds a row; the last source's failure is raised."""
    failure: Exception | None = None
    for read in sources:
        try:
            df = read()
            if not df.isEmpty():
                return df
        except Exception as e:  # the next source stands in
            failure = e
    raise ValueError("no source holds a row") from failure


def once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; it is made and written if there is none yet or it is empty."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where) or spark.read.parquet(path).isEmpty():
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def crawl_titles(members: DataFrame, roots: list[str]) -> DataFrame:
    """Titles to fetch, each once: pages of the root categories and of their subcategories, one level down.

    members: (category, title, kind), kind ``page`` or ``subcat``.
    """
    first = members.where(F.col("category").isin(*roots))
    below = first.where("kind = 'subcat'").select(F.col("title").alias("category")).distinct()
    second = members.join(below, "category", "left_semi").where("kind = 'page'")
    return first.where("kind = 'page'").select("title").unionByName(second.select("title")).distinct()


def reference_pages(spark: SparkSession, path: str) -> DataFrame:
    """(doc, text): the files page_*.txt in each folder below ``path``, stripped and joined by spaces in order of their names."""
    files = spark.read.option("wholetext", "true").option("pathGlobFilter", "page_*.txt").option("recursiveFileLookup", "true").text(path)
    named = files.select(F.input_file_name().alias("path"), T.strip(F.col("value")).alias("text"))
    parts = F.array_sort(F.collect_list(F.struct("path", "text")))
    return named.groupBy(F.element_at(F.split("path", "/"), -2).alias("doc")).agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


def stored_winner(spark: SparkSession, path: str, a: str, b: str) -> str:
    """The engine that won more pages in a stored comparison (ties to a, a missing confidence is 0); a if the report is missing or unreadable."""
    report = spark.read.schema("document string, total_pages int, pages array<struct<page:int,a:struct<confidence:double>,b:struct<confidence:double>>>")
    try:
        for whole in ("false", "true"):  # an object a line, or one array
            pages = report.option("multiLine", whole).json(path).select(F.explode("pages").alias("p"))
            if not pages.isEmpty():
                sides = pages.select(*[F.coalesce(f"p.{s}.confidence", F.lit(0.0)).alias(f"{s}_confidence") for s in "ab"])
                return {"a": a, "b": b}[metrics.best_engine(sides).first().winner]
    except AnalysisException:
        pass  # no report yet
    return a
