"""Dialects: the choices in which page readers differ, and the errors that they raise."""

from dataclasses import dataclass


class ContractError(ValueError):
    """The model, its charset or its input doesn't fit the engine."""


class OutputError(ValueError):
    """The model's scores are unusable: wrong shape or not finite."""


@dataclass(frozen=True)
class Dialect:
    binarise: str = "flat"  # or adaptive
    level: int = 128
    threshold: str = "mean"  # share of the mean of rows with ink, or of the max
    ratio: float = 0.05
    smooth: str = "visited"  # true_k, visited, fixed
    window: int = 3
    padding: str = "ceil"  # floor, ceil, constant
    tile_wide_lines: bool = True
    width_rounding: str = "floor"  # or round
    min_width: int = 1
    resample: str = "bilinear"
    drop_blank_lines: bool = False
    skip_failed_lines: bool = False
    accuracy_decimals: int | None = None
    accuracy_utf16: bool = False
    both_empty_is_right: bool = False
    min_line: int = 10
    max_gap: int = 10
    height: int = 160
    width: int = 1024
    extensions: tuple = ("png", "jpg", "jpeg")
    extensions_exact_case: bool = False

    def __post_init__(self):
        if not 0 < self.ratio < float("inf"):
            raise ContractError("the threshold ratio must be finite and positive")


DIALECTS = {
    "flat": Dialect(),
    "python": Dialect(binarise="adaptive", threshold="max", ratio=0.02, smooth="true_k", window=5, padding="floor", extensions=("png", "jpg", "jpeg", "bmp", "tiff")),
    "js": Dialect(tile_wide_lines=False, width_rounding="round", min_width=0, resample="lanczos3", accuracy_decimals=2, accuracy_utf16=True),
    "go": Dialect(smooth="fixed", tile_wide_lines=False, width_rounding="round", resample="bicubic", drop_blank_lines=True, skip_failed_lines=True, both_empty_is_right=True, extensions_exact_case=True),
    "rust": Dialect(padding="constant", width_rounding="round", min_width=0, resample="triangle", accuracy_decimals=2),
}
