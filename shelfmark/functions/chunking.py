"""Sentence-like segments packed into chunks under a token budget."""

from __future__ import annotations

from math import ceil

import pandas as pd
from pyspark.sql import Column, functions as F

BOUNDARY = r"(?<=\. |\n|! |\? |; |:\s|[0-9]\.\s|- |\* )"


def segments(text: Column) -> Column:
    """Text cut after sentence ends, line ends, list marks and colons."""
    return F.filter(F.split(text, BOUNDARY), lambda s: s != "")


def chunks(text: Column, budget: int = 512, overlap: int = 128) -> Column:
    """Array of chunks. A token is counted as four characters, rounded up. Segments fill a chunk up to
    the budget; a segment above the budget stands alone; preceding segments are put in front of a
    chunk as long as they fit the overlap."""

    @F.pandas_udf("array<string>")
    def pack(parts: pd.Series) -> pd.Series:
        def one(segs: list[str]) -> list[str]:
            sizes = [ceil(len(s) / 4) for s in segs]
            out, start = [], 0
            while start < len(segs):
                end, used = start, 0
                while end < len(segs) and used + sizes[end] <= budget:
                    used += sizes[end]
                    end += 1
                end = max(end, start + 1)
                lead, spent = start, 0
                while lead > 0 and spent + sizes[lead - 1] <= overlap:
                    lead -= 1
                    spent += sizes[lead]
                out.append("".join(segs[lead:end]))
                start = end
            return out

        return pd.Series([one(list(segs)) if segs is not None else None for segs in parts])

    return pack(segments(text))
