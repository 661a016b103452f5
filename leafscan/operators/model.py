"""The recognition model: its contract, its session and inference over lines. The session is injectable, as weights are not part of this package."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ContractError, Dialect, OutputError
from . import kernels


def static(value) -> int | None:
    """A fixed dimension as a number; None for a symbolic or unknown one."""
    return int(value) if isinstance(value, (int, np.integer)) and not isinstance(value, bool) and value > 0 else None


def onnx_session(path: str):
    """A session on one thread: tasks are what runs in parallel."""
    import onnxruntime

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    return onnxruntime.InferenceSession(path, options, providers=["CPUExecutionProvider"])


def runtime_version() -> str | None:
    try:
        import onnxruntime
    except ImportError:
        return None
    return onnxruntime.__version__


def check_contract(session, charset: str, dialect: Dialect = Dialect()) -> int | None:
    """The number of classes, where the graph fixes it; ContractError where graph, charset and dialect don't fit."""
    if not charset:
        raise ContractError("an empty charset")
    inputs, outputs = session.get_inputs(), session.get_outputs()
    if len(inputs) != 1 or len(outputs) != 1:
        raise ContractError("the model has one input and one output")
    given, made = list(inputs[0].shape or []), list(outputs[0].shape or [])
    if len(given) != 4 or len(made) != 3:
        raise ContractError(f"input of rank 4 and output of rank 3 expected, not {len(given)} and {len(made)}")
    height, classes = static(given[2]), static(made[2])
    if height is not None and height != dialect.height:
        raise ContractError(f"the model reads {height} rows, not {dialect.height}")
    if classes is not None and classes != len(charset) + 1:
        raise ContractError(f"{classes} classes don't fit {len(charset)} characters")
    return classes


def input_size(session, dialect: Dialect = Dialect()) -> tuple[int, int]:
    """Height and width of the canvas: of the graph where it fixes them, else the dialect's."""
    shape = session.get_inputs()[0].shape
    return static(shape[2]) or dialect.height, static(shape[3]) or dialect.width


def check_scores(scores, classes: int | None = None) -> np.ndarray:
    """Steps x classes of one line, sound; else OutputError."""
    scores = np.asarray(scores)
    if scores.ndim != 3 or scores.shape[0] != 1 or scores.shape[1] < 1 or (classes is not None and scores.shape[2] != classes):
        raise OutputError(f"scores of shape {scores.shape}")
    if not np.isfinite(scores).all():
        raise OutputError("scores that aren't finite")
    return scores[0]


def decode(scores: np.ndarray, charset: str) -> str:
    """Greedy text of steps x classes."""
    path = scores.argmax(axis=1)
    kept = path[(path != 0) & np.r_[True, path[1:] != path[:-1]]]
    if len(kept) and kept.max() > len(charset):
        raise OutputError("a class is beyond the charset")
    return "".join(charset[c - 1] for c in kept)


class Reader:
    """One session in a Python worker: crops to texts."""

    def __init__(self, make_session, charset: str, dialect: Dialect):
        self.session, self.charset, self.dialect = make_session(), charset, dialect
        self.classes = check_contract(self.session, charset, dialect)
        self.name = self.session.get_inputs()[0].name

    def tile(self, crop: np.ndarray) -> str:
        tensor = kernels.preprocess(crop, self.dialect)
        if tensor is None:
            return ""
        return decode(check_scores(self.session.run(None, {self.name: tensor})[0], self.classes or len(self.charset) + 1), self.charset)

    def line(self, crop: np.ndarray, tiled: bool = True) -> str:
        parts = kernels.tiles(crop, self.dialect.height, self.dialect.width) if tiled and self.dialect.tile_wide_lines else [(0, crop.shape[1])]
        return "".join(self.tile(crop[:, a:b]) for a, b in parts)


_LINE = "line_no int, x int, y int, w int, h int, tiles int, text string, error string"


def read_lines(pages: DataFrame, make_session, charset: str, dialect: Dialect = Dialect()) -> DataFrame:
    """(path, page_no, line_no, bbox, tiles, text, error): a row a line of pages (path, page_no, width, height, grey, error).

    A page without lines is read whole, as line 0 and untiled. A page that couldn't be decoded is one row with its error.
    A line's unusable scores raise, or (skip_failed_lines) become its error; a broken contract always raises. One row in,
    some tens out, and pixels stay bytes until they are in the worker.
    """

    def run(batches):
        reader = None
        for frame in batches:
            for r in frame.itertuples(index=False):
                if r.error is not None:
                    yield pd.DataFrame([(r.path, r.page_no, None, None, None, None, None, None, None, r.error)], columns=names)
                    continue
                reader = reader or Reader(make_session, charset, dialect)
                page = kernels.dark_on_light(np.frombuffer(r.grey, np.uint8).reshape(int(r.height), int(r.width)))
                found = kernels.boxes(kernels.binarise(page, dialect), dialect)
                rows = []
                for i, (x, y, w, h) in enumerate(found or [(0, 0, page.shape[1], page.shape[0])]):
                    crop, error, text = page[y : y + h, x : x + w], None, None
                    try:
                        text = reader.line(crop, tiled=bool(found))
                    except OutputError as e:
                        if not dialect.skip_failed_lines:
                            raise
                        error = f"{type(e).__name__}: {e}"
                    pieces = len(kernels.tiles(crop, dialect.height, dialect.width)) if found and dialect.tile_wide_lines else 1
                    rows.append((r.path, r.page_no, i, x, y, w, h, pieces, text, error))
                yield pd.DataFrame(rows, columns=names)

    names = ["path", "page_no", "line_no", "x", "y", "w", "h", "tiles", "text", "error"]
    lines = pages.select("path", "page_no", "width", "height", "grey", "error").mapInPandas(run, "path string, page_no int, " + _LINE)
    return lines.select("path", "page_no", "line_no", F.when(F.col("line_no").isNotNull(), F.struct("x", "y", "w", "h")).alias("bbox"), "tiles", "text", "error")


def is_blank(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " ")) == ""
