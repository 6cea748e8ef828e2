"""FB2 books and web pages as zones: author, title, annotation, body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places of metadata and zones in an FB2 book, whatever its namespace prefix.
_BOOK = "/*[local-name()='FictionBook']"
_INFO = _BOOK + "/*[local-name()='description']/*[local-name()='title-info']"


def _step(*names: str) -> str:
    return "".join(f"/*[local-name()='{n}']" for n in names)


def fb2_zones(books: DataFrame, id_col: str = "doc_id", xml_col: str = "text") -> DataFrame:
    """(id, author_first, author_last, genre, author, title, annotation, body) of well-formed books; others are skipped.

    A zone is the text of its elements in document order, inline markup and text after it included. Several authors
    and genres are joined by spaces; binaries are no zone.
    """
    held = books.select(F.col(id_col), F.col(xml_col).alias("_x")).filter(F.trim("_x") != "")
    # xpath stops the whole job on malformed XML, so from_xml looks first
    seen = F.from_xml("_x", "description string, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    good = held.withColumn("_ok", seen["_corrupt"].isNull() & seen.isNotNull())

    def texts(path: str) -> Column:
        return F.when(F.col("_ok"), F.array_join(F.xpath(F.col("_x"), F.lit(f"{path}//text()")), " "))

    info = lambda *names: texts(_INFO + _step(*names))
    out = good.filter("_ok").select(
        id_col, info("author", "first-name").alias("author_first"), info("author", "last-name").alias("author_last"), info("genre").alias("genre"),
        info("author").alias("author"), info("book-title").alias("title"), info("annotation").alias("annotation"), texts(_BOOK + _step("body")).alias("body"),
    )
    return out


def page_zones(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(doc_id, title, body): the title element, and the text of the rest without scripts, styles and tags."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    title = F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)
    rest = F.regexp_replace(html, r"(?is)<(script|style|title)[^>]*>.*?</(script|style|title)>", " ")
    return pages.select(F.col(id_col).alias("doc_id"), title.alias("title"), F.regexp_replace(rest, r"<[^>]*>", " ").alias("body"))
