"""The loop of checking and repairing pages, as a fixpoint over tables.

A round checks the pages that are open, closes those without a blocking issue, and repairs in each other page the
first one (by severity, then name). Pages that are closed are neither checked nor repaired again. The loop ends when no
page is open or after `most` repairs a page; each round is one table, from which the next goes on, so lost executors
repeat a round at most and plans don't grow.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import Rounds
from .gates import severity_rank

BLOCKING = ["blocker", "error"]


@dataclass(frozen=True)
class Rule:
    """An issue that a page has where its content matches the pattern, and the repair for it, if there is one."""

    check: str
    severity: str
    pattern: str
    repair: str | None = None


def issues_of(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """slug, check, severity: all rules over one scan of the pages."""
    found = [F.when(F.col("content").rlike(r.pattern), F.struct(F.lit(r.check).alias("check"), F.lit(r.severity).alias("severity"))) for r in rules]
    return pages.select("slug", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x")).select("slug", "x.*")


def first_blocking(issues: DataFrame) -> DataFrame:
    """slug, check: what each page has to be repaired of first; pages without blocking issues have no row."""
    own = issues.where(F.col("severity").isin(BLOCKING))
    return own.groupBy("slug").agg(F.min(F.struct(severity_rank(F.col("severity")).alias("rank"), "check")).alias("x")).select("slug", "x.check")


def fix_loop(
    spark: SparkSession, pages: DataFrame, check: Callable[[DataFrame], DataFrame], repairs: Mapping[str, Callable[[Column], Column]], most: int = 3
) -> DataFrame:
    """slug, content, verdict, rounds, open_check of every page. pages (slug, content), one row a slug; check gives
    issues (slug, check, severity); repairs are by check. Verdicts: clean; blocked, where no repair is known for what
    stands open; given_up after `most` repairs. rounds counts repairs."""
    tables, closed = Rounds(spark, "fixes"), []
    now = pages.select("slug", "content")
    for k in range(most + 1):
        judged = tables.cut(now.join(first_blocking(check(now)), "slug", "left"))
        verdict = F.when(F.col("check").isNull(), "clean").when(~F.col("check").isin(list(repairs)), "blocked")
        if k == most:
            verdict = verdict.otherwise("given_up")
        judged = judged.withColumn("verdict", verdict)
        closed.append(judged.where("verdict is not null").select("slug", "content", "verdict", F.lit(k).cast("long").alias("rounds"), F.col("check").alias("open_check")))
        open_ = judged.where("verdict is null")
        if k == most or open_.isEmpty():
            break
        content = F.col("content")
        for name, repair in repairs.items():
            content = F.when(F.col("check") == name, repair(F.col("content"))).otherwise(content)
        now = open_.select("slug", content.alias("content"))
    return reduce(DataFrame.unionByName, closed)
