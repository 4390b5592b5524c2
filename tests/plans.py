"""Helpers to look at physical plans."""

import io
from contextlib import redirect_stdout


def plan_of(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()
