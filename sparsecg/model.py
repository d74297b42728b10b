"""Errors, headers and options that all parts share."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum


class Code(Enum):
    INDEX_OUT_OF_BOUNDS = "index out of bounds"
    VECTOR_INCOMPATIBLE_SIZE = "vectors of incompatible size"
    VECTOR_EXPECTED_FULL = "a full vector is expected"
    VECTOR_EXPECTED_PACKED = "a packed vector is expected"
    NOT_CONVERGED = "not converged"
    NOT_CONVERGED_INDEFINITE_MATRIX = "not converged: the matrix is indefinite"
    NOT_SUPPORTED = "not supported"
    INVALID_VALUE = "invalid value"
    MTX_INVALID_COMMENT = "invalid Matrix Market comment"
    INVALID_FORMAT_SPECIFIER = "invalid format specifier"
    EOF = "unexpected end of file"
    LINE_TOO_LONG = "line too long"
    EINVAL = "invalid argument"
    ERANGE = "number out of range"


class EngineError(Exception):
    """An error with one of the codes above and, for files, a line number."""

    def __init__(self, code: Code, detail: str = "", line: int | None = None):
        self.code, self.line = code, line
        super().__init__(code.value + (f" in line {line}" if line is not None else "") + (f": {detail}" if detail else ""))


@dataclass(frozen=True)
class Header:
    """What the first lines of a Matrix Market file say."""

    object: str
    format: str
    field: str
    symmetry: str
    nrows: int
    ncols: int
    nnz: int
    comments: tuple[str, ...] = ()

    @property
    def nvalspernz(self) -> int:
        return {"pattern": 0, "complex": 2}.get(self.field, 1)


def entry_count(object: str, format: str, symmetry: str, nrows: int, ncols: int, nnz: int = 0) -> int:
    """Entries that a file of this shape stores."""
    if format == "coordinate":
        return nnz
    if object == "vector":
        return nrows
    return {"general": nrows * ncols, "symmetric": nrows * (nrows + 1) // 2, "hermitian": nrows * (nrows + 1) // 2, "skew-symmetric": nrows * (nrows - 1) // 2}[symmetry]


@dataclass
class SolveOptions:
    """Stopping rules; a tolerance of 0 is off."""

    maxits: int = 100
    residual_atol: float = 0.0
    residual_rtol: float = 1e-9
    diff_atol: float = 0.0
    diff_rtol: float = 0.0
    epsilon: float = 0.0


@dataclass
class SolveResult:
    x: object
    iterations: int
    bnrm2: float
    x0nrm2: float
    r0nrm2: float
    rnrm2: float
    dxnrm2: float = float("inf")
    history: list[tuple[int, float, float, float]] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)
    status: str = "converged"
    report: object = None
