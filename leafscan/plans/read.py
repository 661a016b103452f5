"""Reading files: images, directories and PDF documents to lines, pages, documents and accuracies."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Dialect
from ..operators import assemble, model
from ..sources import files


class Engine:
    """A model, its charset and a dialect; every method gives a DataFrame and nothing runs before it is asked for.

    make_session is called once a Python worker; the default opens the weights by onnxruntime.
    """

    def __init__(self, spark: SparkSession, charset: str, weights: str | None = None, make_session=None, dialect: Dialect = Dialect()):
        self.spark, self.charset, self.dialect = spark, charset.strip("\r\n"), dialect
        self.make_session = make_session or (lambda: model.onnx_session(weights))

    def lines(self, pages: DataFrame) -> DataFrame:
        found = model.read_lines(pages, self.make_session, self.charset, self.dialect)
        return found.where(F.col("text").isNull() | ~model.is_blank(F.col("text"))) if self.dialect.drop_blank_lines else found

    def pages(self, pages: DataFrame) -> DataFrame:
        """(path, page_no, text, error): lines joined in order; the page's error where it couldn't be decoded."""
        return self._joined(self.lines(pages), pages)

    def _joined(self, lines: DataFrame, pages: DataFrame) -> DataFrame:
        read = lines.where("line_no is not null and text is not null").groupBy("path", "page_no").agg(assemble.joined("line_no", separator="\n").alias("text"))
        return pages.select("path", "page_no", "error").join(read, ["path", "page_no"], "left").select("path", "page_no", F.when(F.col("error").isNull(), F.coalesce("text", F.lit(""))).alias("text"), "error")

    def read_images(self, where: str) -> DataFrame:
        """(path, page_no, text, error) of a file or of a directory's images."""
        return self.pages(files.pages(files.list_images(self.spark, where, self.dialect)))

    read_image = read_images

    def read_pdfs(self, where: str) -> DataFrame:
        """(path, pages): the pages' texts of each PDF document, in order; blank lines are kept."""
        pdf = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(where)
        pages = files.pages(files.pdf_pages(pdf))
        keep = Engine(self.spark, self.charset, None, self.make_session, self.dialect)
        lines = model.read_lines(pages, keep.make_session, keep.charset, keep.dialect)
        return document_texts(keep._joined(lines, pages))

    def with_accuracy(self, where: str, truth: DataFrame) -> DataFrame:
        """read_images with truth (path, truth) and `accuracy` in percent."""
        return assemble.with_accuracy(self.read_images(where), truth, "path", self.dialect)

    def report(self, where: str) -> DataFrame:
        """(path, success, pages) with lines and boxes."""
        return assemble.report(self.lines(files.pages(files.list_images(self.spark, where, self.dialect))).where("line_no is not null"))

    def outcomes(self, where: str) -> DataFrame:
        """(file, text, error, success): a file that fails is a row."""
        return assemble.outcomes(self.read_images(where)).orderBy("file")


def document_texts(pages: DataFrame) -> DataFrame:
    """(path, pages): texts of (path, page_no, text) in the order of pages."""
    rows = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    return pages.groupBy("path").agg(F.transform(rows, lambda r: r["text"]).alias("pages"))


def write_text(pages: DataFrame, where: str) -> None:
    """A directory of text files with pages under their headers."""
    header = F.concat(F.lit("--- "), F.col("path"), F.lit(" page "), F.col("page_no").cast("string"), F.lit(" ---\n"), F.coalesce("text", F.lit("")))
    pages.orderBy("path", "page_no").select(header.alias("value")).write.text(where)


def write_json(rows: DataFrame, where: str) -> None:
    rows.write.json(where)
