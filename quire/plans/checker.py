"""A checker that runs an external program on each archive and reads its JSON report.

The program gets the archive's path and ``--json -``; a missing program, a timeout or an unreadable report
make the result unavailable, never an error of the job.
"""

from __future__ import annotations

import math
import os
import shutil
import subprocess
import tempfile

from quire.operators.findings import CheckResult, parse_report

DEFAULT_TIMEOUT = 120.0


def timeout_of(value: str | None) -> float:
    """Seconds from a setting; anything but a finite positive number gives the default."""
    try:
        seconds = float(value) if value is not None else DEFAULT_TIMEOUT
    except ValueError:
        return DEFAULT_TIMEOUT
    return seconds if math.isfinite(seconds) and seconds > 0 else DEFAULT_TIMEOUT


class ProgramChecker:
    """Callable from archive bytes to a CheckResult; picklable, so it can run in workers."""

    def __init__(self, program: str, timeout: float | str | None = None):
        self.command = ["java", "-jar", program] if program.endswith(".jar") else [program]
        self.timeout = timeout_of(None if timeout is None else str(timeout))

    def __call__(self, content: bytes) -> CheckResult:
        if not shutil.which(self.command[0]):
            return CheckResult(False, "unavailable", message=f"{self.command[0]} was not found.")
        with tempfile.TemporaryDirectory() as folder:
            path = os.path.join(folder, "book.epub")
            with open(path, "wb") as f:
                f.write(content)
            try:
                done = subprocess.run([*self.command, path, "--json", "-"], capture_output=True, timeout=self.timeout, check=False)
            except subprocess.TimeoutExpired:
                return CheckResult(False, "timeout", message=f"The checker took more than {self.timeout:g} seconds.")
        report = done.stdout if done.stdout.strip() else done.stderr
        return parse_report(report.decode("utf-8", "replace"), done.returncode)
