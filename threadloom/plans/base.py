"""Shared inputs of the core plans, and the oracle's common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import model
from ..runtime import ship, table


class Inputs:
    """The model's tables over one data folder, built lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        ship(spark)

    def t(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    @property
    def wide(self) -> DataFrame:
        return self.t("preprocessed")

    @property
    def scored(self) -> DataFrame:
        return model.scored(self.wide, self.t("annotations"), self.t("cutoffs"))

    @property
    def in_scope(self) -> DataFrame:
        return model.in_scope_messages(self.wide, self.t("annotations"))

    @property
    def messages(self) -> DataFrame:
        return model.messages(self.wide)


#: Common table expressions of the oracle: m (wide rows once), msg, scored, scope.
CTE = """
WITH m AS (SELECT DISTINCT * FROM preprocessed),
msg AS (SELECT participant, source_path, chat_index, message_index,
  CASE WHEN lower(trim(role)) IN ('user', 'human', 'you') THEN 'user' WHEN lower(trim(role)) IN ('assistant', 'ai', 'bot', 'model') THEN 'assistant'
  ELSE lower(trim(role)) END AS role, COLUMNS('score__.*') FROM m),
long AS (SELECT participant, source_path, chat_index, message_index, role, substr(col, 8) AS annotation_id, score
  FROM (UNPIVOT msg ON COLUMNS('score__.*') INTO NAME col VALUE score)),
scored AS (SELECT l.*, a.category, a.scope, a.is_harmful, c.cutoff, trunc(l.score) >= c.cutoff AS is_pos,
  coalesce(len(a.scope) = 0 OR list_contains(a.scope, l.role), false) AS in_scope
  FROM long l JOIN annotations a USING (annotation_id) JOIN cutoffs c USING (annotation_id)),
scope AS (SELECT g.participant, g.source_path, g.chat_index, g.message_index, g.role, a.annotation_id
  FROM msg g JOIN annotations a ON len(a.scope) = 0 OR list_contains(a.scope, g.role))
"""
KEY_SQL = "participant, source_path, chat_index, message_index"
CONV_SQL = "participant, source_path, chat_index"
