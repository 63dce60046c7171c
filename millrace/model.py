"""Names and policies that the whole package shares."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

#: Columns that carry a record's identity and time (epoch seconds) through row functions, which do not see them.
KEY, TS = "__key", "__ts"
RESERVED = (KEY, TS)

#: What a failing row function does: fail the job; drop the row; keep it with nulls; drop the whole batch (empty), or the
#: whole logical split it belongs to.
ON_ERROR = ("fail", "drop_row", "null_row", "empty", "drop_split")


@dataclass
class Stage:
    """A named step of a pipeline: a function of its upstreams' DataFrames."""

    name: str
    kind: str
    upstreams: list[str]
    build: Any
    parallelism: int | tuple[int, int] | None = None
    options: dict = field(default_factory=dict)


def check_callable(fn: Any, what: str) -> None:
    if not callable(fn):
        raise ValueError(f"{what} needs a callable, not {type(fn).__name__}")
