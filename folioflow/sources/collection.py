"""The text and image collections as stores that are opened, made where they are absent, and counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from .. import schemas
from ..operators import search
from .keyed import KeyedTable

KINDS = {"text": schemas.TEXT_INDEX, "image": schemas.IMAGE_INDEX}


class Collection(KeyedTable):
    """Points by id. Readers keep the version that they have opened while points are put in."""

    @classmethod
    def open(cls, spark: SparkSession, path: str, kind: str) -> Collection:
        """The collection at ``path``, made empty where there is none."""
        found = cls(spark, path, "point_id")
        found.create(KINDS[kind])
        return found

    def upsert(self, points: DataFrame, order: str | Column | None = None, commit: str | None = None) -> int:
        """Put points in by id; of several with one id the last by ``order`` wins, without it ids must be unique."""
        rows = points if order is None else search.upsert(None, points, "point_id", order)
        return self.put(rows, commit=commit)

    def pending(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows (chunks or regions) that have no point yet."""
        return search.pending(rows, self.read(), key)

    def update_payload(self, new: DataFrame, key: str, column: str) -> int:
        """Replace one payload column of the points that ``new`` (key, column) has a value for; vectors stay."""
        stored = self.read().join(new.filter(new[column].isNotNull()).select(key), key, "left_semi")
        return self.put(search.update_payload(stored, new, key, column))
