"""Names of the columns that operators add beside those of their input."""

from __future__ import annotations

from collections.abc import Iterable


def free_name(wanted: str, taken: Iterable[str], prefix: str) -> str:
    """``wanted``, behind as many ``prefix`` as it takes to differ (without regard to case) from all ``taken``.

    So an input column is never replaced by one of the same name that an operator adds.
    """
    lower = {t.lower() for t in taken}
    while wanted.lower() in lower:
        wanted = prefix + wanted
    return wanted
