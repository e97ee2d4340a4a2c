"""Row selection: projects, pages, whitelists."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.functions.hours import hour_number_from
from trafficlens.schema import with_hour_number


def in_projects(traffic: DataFrame, projects=("en", "de")) -> DataFrame:
    return traffic.where(F.col("project").isin(*projects))


def of_page(traffic: DataFrame, project: str, title: str) -> DataFrame:
    return traffic.where((F.col("project") == project) & (F.col("title") == title))


def require_page(traffic: DataFrame, project: str, title: str) -> DataFrame:
    """The page's rows; an unknown page is an error. Looks for one row right away."""
    page = of_page(traffic, project, title)
    if page.isEmpty():
        raise ValueError(f"Page not found: {project} {title}")
    return page


def since(traffic: DataFrame, cut: dt.datetime) -> DataFrame:
    """Drop rows older than the cut hour."""
    return with_hour_number(traffic).where(F.col("hour_no") >= hour_number_from(cut))


def until(traffic: DataFrame, last: dt.datetime) -> DataFrame:
    """Drop rows newer than the last hour."""
    return with_hour_number(traffic).where(F.col("hour_no") <= hour_number_from(last))


def on_whitelist(traffic: DataFrame, whitelist: DataFrame, dedupe: bool = True) -> DataFrame:
    """Rows of listed pages; ``whitelist`` has the columns project and title, or title alone.

    ``dedupe=False`` is a plain inner join: a page listed twice doubles its rows. No broadcast is
    forced: Spark broadcasts a list it measures as small and sort-merges a long one. Nothing stands
    between shuffle and join on either side, so adaptive execution can split a hot page.
    """
    joined = traffic.join(whitelist, whitelist.columns, "left_semi" if dedupe else "inner")
    return joined.select(*traffic.columns)
