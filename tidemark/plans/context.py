"""What a step has to know about its run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime


def utc_now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


@dataclass(frozen=True)
class RunContext:
    """Identity of one task execution. Run and task ids are required: the gates and
    reports that read the audit log could not find a row without them."""

    run_id: str
    task_key: str
    use_case: str
    env: str
    job_id: str = ""
    ops: str = "ops"
    tags: dict[str, str] = field(default_factory=dict)
    clock: Callable[[], datetime] = utc_now

    def __post_init__(self) -> None:
        for name in ("run_id", "task_key", "use_case", "env"):
            if not getattr(self, name):
                raise ValueError(f"a run context needs {name}")

    def ops_table(self, name: str) -> str:
        """A log of this use case.

        Plain Parquet appends to one folder must not overlap, and jobs of several use
        cases run side by side, so each use case writes a database of its own;
        ``audit.evidence`` reads them together.
        """
        return f"{self.ops}_{self.use_case}.{name}"

    def shared_table(self, name: str) -> str:
        """A control table of all use cases, written by one job."""
        return f"{self.ops}.{name}"
