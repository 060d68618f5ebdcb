"""Removal of overlapping intervals in score order."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Kept:
    """Intervals that stay in one document: none holds another, so that in order of their starts their ends are in order too."""

    def __init__(self, share: float):
        self.share, self.starts, self.ends = share, [], []

    def add(self, start: float, end: float) -> bool:
        """Whether an interval stays: none that stayed shares `share` of the shorter of the two with it."""
        first, last = bisect_right(self.ends, start), bisect_left(self.starts, end)
        for k in range(first, last):
            s, e = self.starts[k], self.ends[k]
            if min(e, end) - max(s, start) >= self.share * min(e - s, end - start):
                return False
        at = bisect_left(self.starts, start)
        self.starts.insert(at, start)
        self.ends.insert(at, end)
        return True


def without_overlaps(parents: DataFrame, share: float = 0.5, width: int | None = None) -> DataFrame:
    """parents (query_id, id, document_id, start, end, score) without those that overlap a better one that stays.

    Of two intervals of one query and document the better has the higher score, at one score the smaller id; they overlap if what they share is
    `share` of the shorter one or more. Each document's intervals come sorted to one task, best first, which holds those that stay
    and no pairs. Intervals without length, and those with a null, overlap nothing. width, of bins in which pairs once met, says nothing now.
    """
    if share > 1:
        return parents
    columns = parents.columns
    used = [columns.index(c) for c in ("query_id", "document_id", "start", "end", "score")]

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = kept = None
        for batch in batches:
            stays = []
            for query, document, start, end, score in zip(*(batch.column(c).to_pylist() for c in used)):
                if query is None or document is None or start is None or end is None or score is None or end <= start:
                    stays.append(True)
                    continue
                if (query, document) != group:
                    group, kept = (query, document), Kept(share)
                stays.append(kept.add(start, end))
            yield batch.filter(pa.array(stays, pa.bool_()))

    dealt = parents.repartition("query_id", "document_id").sortWithinPartitions("query_id", "document_id", F.desc("score"), "id")
    return dealt.mapInArrow(passed, parents.schema)
