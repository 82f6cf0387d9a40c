"""Reading chapters: text trees, EPUB archives, HTML tables, and the transforms that make chapters of them."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossaloom.functions import text as X
from glossaloom.plans.ordered import ranked

# The default heading marker and note patterns.
CHAPTER_MARKER = r"(?i)^#\s*(chapter|ch)\.?\s*\d+"
STRIP_PATTERNS = [r"(?i)translator'?s?\s*notes?", r"(?i)editor'?s?\s*notes?", r"(?i)^\{\s*note\s*\}"]
HEADER_NUMBER = r"(?i)(?:chapter|ch)\.?\s*(\d+)"

_BREAK_BEFORE = {"p", "div", "br", "h1", "h2", "h3"}
_BREAK_AFTER = _BREAK_BEFORE - {"br"}


class _Plain(HTMLParser):
    def __init__(self, drop: frozenset[str]):
        super().__init__()
        self.out: list[str] = []
        self.drop, self.hidden = drop, 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self.drop
        if tag in _BREAK_BEFORE:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in self.drop and self.hidden:
            self.hidden -= 1
        if tag in _BREAK_AFTER:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def _plain(html: str, drop: frozenset[str] = frozenset()) -> str:
    parser = _Plain(drop)
    parser.feed(html)
    return "".join(parser.out)


def html_to_text(html: Column, drop_script: bool = False) -> Column:
    """Text of an HTML page with line breaks at block tags and entities decoded.

    Script and style contents are kept unless ``drop_script``.  Pages go to Python a hundred at a time, not in an Arrow batch of
    thousands, so a worker's memory does not grow with the table.
    """
    drop = frozenset({"script", "style"}) if drop_script else frozenset()
    convert = F.udf(lambda page: None if page is None else _plain(page, drop), T.StringType(), useArrow=False)
    return convert(html)


def read_text_tree(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """``path, name, raw`` for every .txt file (bad bytes are ignored)."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.[tT][xX][tT]").load(path)
    )
    raw = F.regexp_replace(_utf8(F.col("content")), "\r\n?", "\n")
    return files.select("path", F.substring_index("path", "/", -1).alias("name"), raw.alias("raw"))


@F.pandas_udf(T.StringType())
def _utf8(contents: pd.Series) -> pd.Series:
    return contents.map(lambda b: bytes(b).decode("utf-8", errors="ignore"))


_EPUB_ROW = T.StructType([T.StructField("path", T.StringType()), T.StructField("name", T.StringType()), T.StructField("raw", T.StringType())])


def read_epub_tree(spark: SparkSession, path: str) -> DataFrame:
    """``path, name, raw`` for every .epub file: its pages in archive order as text, one task per file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[eE][pP][uU][bB]").load(path)

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for file, content in zip(frame["path"], frame["content"]):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as book:
                    pages = [n for n in book.namelist() if n.lower().endswith((".xhtml", ".html", ".htm"))]
                    text = "\n".join(_plain(book.read(n).decode("utf-8", errors="ignore")) for n in pages)
                rows.append((file, file.rsplit("/", 1)[-1], text))
            yield pd.DataFrame(rows, columns=["path", "name", "raw"])

    return files.select("path", "content").mapInPandas(unpack, _EPUB_ROW)


# --------------------------------------------------------------------------- chapter transforms


def strip_patterns(text: Column, patterns: Sequence[str]) -> Column:
    """Delete each pattern in order."""
    for p in patterns:
        text = F.regexp_replace(text, p, "")
    return text


def split_chapters(text: Column, marker: str = CHAPTER_MARKER, multiline: bool = True) -> Column:
    """Chunks that start at a marker; text before the first marker is dropped; no marker keeps the whole text.

    ``multiline`` lets ``^`` match at every line start; without it a marker counts at the file start only.
    """
    pattern = ("(?m)" if multiline else "") + marker
    parts = F.split(text, f"(?={pattern})")
    # What precedes the first marker is a part of its own unless a marker opens the text.
    first = F.when(F.get(parts, F.lit(0)).rlike(f"\\A(?:{pattern})"), 1).otherwise(2)
    chunks = F.filter(F.transform(F.slice(parts, first, F.size(parts)), X.strip), lambda c: c != "")
    return F.when(text.rlike(pattern), chunks).otherwise(F.array(text))


def chapter_rows(files: DataFrame, marker: str = CHAPTER_MARKER, strips: Sequence[str] = (), multiline: bool = True) -> DataFrame:
    """Files ``path, raw`` to ``path, pos, chapter, title, text, paragraphs``.

    The number comes from the first 200 characters, else the chunk's place in its file.
    """
    chunks = files.select("path", F.posexplode(split_chapters(strip_patterns(F.col("raw"), strips), marker, multiline)).alias("pos", "text"))
    named = F.try_to_number(F.regexp_extract(F.substring("text", 1, 200), HEADER_NUMBER, 1), F.lit("9999999999999999999")).cast("bigint")
    lead = ("(?m)" if multiline else "") + marker
    return chunks.select(
        "path", "pos",
        F.coalesce(named, F.col("pos") + 1).alias("chapter"),
        X.strip(F.regexp_extract("text", f"\\A(?:{lead})", 0)).alias("title"),
        "text",
        X.lines(F.col("text")).alias("paragraphs"),
    )


def renumber_zero(rows: DataFrame, group: str = "novel") -> DataFrame:
    """Give chapters numbered 0 their place in the file order of their novel."""
    placed = ranked(rows, group, [F.col("path"), F.col("pos")], "_place")
    return placed.withColumn("chapter", F.when(F.col("chapter") == 0, F.col("_place")).otherwise(F.col("chapter"))).drop("_place")


def load_corpus(spark: SparkSession, path: str, novel: str, marker: str = CHAPTER_MARKER, strips: Sequence[str] = (), multiline: bool = True) -> DataFrame:
    """All chapters under ``path`` from text and EPUB files."""
    files = read_text_tree(spark, path).unionByName(read_epub_tree(spark, path))
    rows = chapter_rows(files, marker, strips, multiline).withColumn("novel", F.lit(novel))
    return renumber_zero(rows).select("novel", "chapter", "title", "text", "paragraphs", F.col("path").alias("src"))


def file_number(name: Column) -> Column:
    """First digits of a file name; null without digits."""
    digits = F.regexp_extract(name, r"(\d+)", 1)
    return F.when(digits != "", digits).cast("bigint")


def index_by_number(files: DataFrame, order: str | None = None) -> DataFrame:
    """``chapter, text`` from files ``name, raw``: the last file in name order wins a shared number.

    Of files of one name the first by the numeric column ``order`` counts; without it, the one of the greatest text.
    """
    last = F.struct("name", -F.col(order)) if order else F.struct("name", "raw")
    return (
        files.withColumn("chapter", file_number(F.col("name"))).where("chapter is not null")
        .groupBy("chapter").agg(F.max_by("raw", last).alias("text"))
    )


def validate_chapters(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(good, rejected)``: known source type, text, number >= 1, and one row per (novel, number, source)."""
    key = ["novel", "number", "source_type"]
    copies = rows.groupBy(*key).agg(F.count("*").alias("_copies"))
    checked = rows.join(copies, key).withColumn(
        "problems",
        F.array_compact(
            F.array(
                F.when(~F.coalesce(F.col("source_type").isin("mtl", "original"), F.lit(False)), "source type"),
                F.when(~F.coalesce(F.col("raw_text"), F.lit("")).rlike(r"(?U)\S"), "no text"),
                F.when(~(F.coalesce("number", F.lit(0)) >= 1), "number"),
                F.when(F.col("_copies") > 1, "duplicate"),
            )
        ),
    ).drop("_copies")
    return checked.where("size(problems) = 0").drop("problems"), checked.where("size(problems) > 0")
