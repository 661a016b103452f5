"""Files as rows: images, directories, PDF documents, charsets and labelled lines."""

import os
import shutil
import subprocess
import tempfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ContractError, Dialect
from ..operators import kernels
from . import exif, png


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))


def list_images(spark: SparkSession, where: str, dialect: Dialect = Dialect()) -> DataFrame:
    """(path, modificationTime, length, content) of a file, or of a directory's image files, not its subdirectories'."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(where)
    found = F.regexp_extract("path", r"\.([A-Za-z]+)$", 1) if dialect.extensions_exact_case else extension(F.col("path"))
    return files.where(found.isin(*dialect.extensions))


def decode_page(data: bytes):
    """The upright grey page of an encoded image: oriented, flattened on white. PNG only, unless another codec is there."""
    if data[:8] == png.SIGNATURE:
        image = png.decode(data)
    else:
        try:
            import io

            import numpy as np
            from PIL import Image
        except ImportError:
            raise ValueError("only PNG files can be decoded without an imaging library") from None
        picture = Image.open(io.BytesIO(data))
        image = np.asarray(picture.convert("RGBA" if "A" in picture.getbands() else "RGB"))
    return kernels.grey(kernels.flatten(kernels.orient(image, exif.orientation(data))))


_PAGE = T.StructType().add("width", "integer").add("height", "integer").add("grey", "binary").add("error", "string")


@F.pandas_udf(_PAGE)
def _decode(contents: pd.Series) -> pd.DataFrame:
    rows = []
    for data in contents:
        try:
            page = decode_page(data)
            rows.append((page.shape[1], page.shape[0], page.tobytes(), None))
        except Exception as e:  # a bad file is a row like any other
            rows.append((None, None, None, f"{type(e).__name__}: {e}"))
    return pd.DataFrame(rows, columns=["width", "height", "grey", "error"])


@F.pandas_udf(T.IntegerType())
def orientation(contents: pd.Series) -> pd.Series:
    return contents.map(exif.orientation).astype("int32")


def pages(files: DataFrame) -> DataFrame:
    """files (path, content) as pages (path, page_no, width, height, grey, error)."""
    keep = ["path", *(["page_no"] if "page_no" in files.columns else [])]
    failed = F.col("_failed") if "error" in files.columns else F.lit(None).cast("string")
    given = files.withColumnRenamed("error", "_failed") if "error" in files.columns else files
    out = given.select("*", _decode("content").alias("p")).select(*keep, "p.width", "p.height", "p.grey", F.coalesce(failed, "p.error").alias("error"))
    return out if "page_no" in files.columns else out.withColumn("page_no", F.lit(1))


def has_pdf_tool(tool: str = "pdftoppm") -> bool:
    return shutil.which(tool) is not None


def pdf_pages(files: DataFrame, dpi: int = 300, tool: str = "pdftoppm", timeout: float = 600) -> DataFrame:
    """(path, page_no, content, error) of PDF files (path, content): rasterised by pdftoppm on the executors, a row a page in order.

    A file that the tool rejects, that has no page, or that takes longer than timeout seconds is one row with an error. Without
    the tool the job ends with a ContractError, as no file could be read.
    """

    def row(path, number, content, error):
        return pd.DataFrame({"path": [path], "page_no": [number], "content": [content], "error": [error]})

    def run(batches):
        if not has_pdf_tool(tool):
            raise ContractError("pdftoppm isn't installed on an executor")
        for frame in batches:
            for path, content in zip(frame["path"], frame["content"]):
                with tempfile.TemporaryDirectory() as folder:
                    source = os.path.join(folder, "in.pdf")  # an absolute path is never taken for an option
                    with open(source, "wb") as f:
                        f.write(content)
                    try:
                        subprocess.run([tool, "-png", "-r", str(dpi), source, os.path.join(folder, "page")], check=True, capture_output=True, timeout=timeout)
                    except (subprocess.CalledProcessError, subprocess.TimeoutExpired) as e:
                        said = (e.stderr or b"").decode("utf-8", "replace").strip()
                        yield row(path, 1, None, f"PDF: {said or e}")
                        continue
                    names = sorted((n for n in os.listdir(folder) if n.endswith(".png")), key=page_number)
                    if not names:
                        yield row(path, 1, None, "PDF: it has no page")
                    for name in names:
                        with open(os.path.join(folder, name), "rb") as f:
                            yield row(path, page_number(name), f.read(), None)

    return files.select("path", "content").mapInPandas(run, "path string, page_no int, content binary, error string")


def page_number(name: str) -> int:
    """The number at the end of a rasterised page's name."""
    return int(name.rsplit("-", 1)[-1].split(".")[0])


def read_charset(spark: SparkSession, path: str) -> str:
    return spark.read.option("wholetext", "true").text(path).first()[0].strip("\r\n")


def labelled_lines(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of a file of name<TAB>text; lines without a tab are left out, a text may hold further tabs."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).where(F.size(parts) == 2).select(parts[0].alias("name"), parts[1].alias("text"))


def verify_artifact(path: str, sha256: str, size: int | None = None) -> str:
    """path, if the file has the digest (and size); checked once, on the driver."""
    import hashlib

    digest, n = hashlib.sha256(), 0
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
            n += len(block)
    if digest.hexdigest() != sha256 or (size is not None and n != size):
        raise ContractError(f"{path} isn't the file that was asked for")
    return path
