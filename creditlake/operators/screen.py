"""The screen: each company's best current rating beside its latest financials, under any mix of filters.

Ratings and financials are reduced to one row a company by partial aggregation (max_by over a struct of the order), which combines
before the exchange and needs no sort; a company with very many instruments costs no more than others.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from creditlake.functions.names import is_state_owned
from creditlake.functions.ratings import grade_label


def _first_by(df: DataFrame, keys: Sequence[str], *best: Column) -> DataFrame:
    """One row for each key: the one whose ``best`` values, in order, are largest; nulls are smallest."""
    row = F.struct(*(F.col(c) for c in df.columns if c not in keys))
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(*best)).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def latest_rating(ratings: DataFrame) -> DataFrame:
    """One row per company and agency: the latest date as text, then the largest id."""
    return _first_by(ratings, ["company_id", "agency"], F.col("rating_date"), F.col("id"))


def top_rating(latest: DataFrame) -> DataFrame:
    """One row per company: best grade, then latest date, then agency and largest id."""
    order = Window.partitionBy("company_id").orderBy(F.col("rating_grade").asc_nulls_last(), F.col("rating_date").desc_nulls_last(), F.col("agency"), F.col("id").desc())
    return latest.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")  # a row an agency at most, so a company has few


def latest_financials(financials: DataFrame) -> DataFrame:
    """One row per company: latest fiscal year, then the largest id."""
    return _first_by(financials, ["company_id"], F.col("fiscal_year"), F.col("id"))


@dataclass(frozen=True)
class Filters:
    """Options of the screen; the defaults filter by grade only."""

    min_grade: int = 1
    max_grade: int = 20
    agencies: Sequence[str] = ()
    outlooks: Sequence[str] = ()
    sectors: Sequence[str] = ()
    listed_only: bool = False
    unlisted_only: bool = False
    min_revenue: float | None = None
    max_revenue: float | None = None
    min_ebitda: float | None = None
    min_margin: float | None = None
    max_leverage: float | None = None
    min_debt: float | None = None
    drop_state_owned: bool = False
    name_pattern: str | None = None

    def conditions(self) -> list[Column]:
        c = [F.col("Grade").between(self.min_grade, self.max_grade)]
        for column, values in (("Agency", self.agencies), ("Outlook", self.outlooks), ("Sector", self.sectors)):
            c += [F.col(column).isin(*values)] if values else []
        if self.listed_only or self.unlisted_only:
            c.append(F.col("Listed") == int(self.listed_only))
        for column, least in (("Revenue (Cr)", self.min_revenue), ("EBITDA (Cr)", self.min_ebitda)):
            c += [F.col(column) >= least] if least is not None else []
        if self.max_revenue is not None:
            c.append(F.col("Revenue (Cr)") <= self.max_revenue)
        # zero and twenty stand for "off"
        c += [F.col("EBITDA Margin %") >= self.min_margin] if self.min_margin and self.min_margin > 0 else []
        c += [F.col("Net Debt/EBITDA") <= self.max_leverage] if self.max_leverage is not None and self.max_leverage < 20 else []
        c += [F.col("Total Debt (Cr)") >= self.min_debt] if self.min_debt and self.min_debt > 0 else []
        c += [~is_state_owned(F.col("Company Name"))] if self.drop_state_owned else []
        c += [F.col("Company Name").rlike("(?i)" + self.name_pattern)] if self.name_pattern else []
        return c


#: Report labels by source column.
RATING_LABELS = {"agency": "Agency", "rating_symbol": "Rating", "rating_grade": "Grade", "outlook": "Outlook", "sector": "Sector", "rating_date": "Rating Date", "rationale_url": "Rationale URL"}
MONEY_LABELS = {"revenue_cr": "Revenue (Cr)", "ebitda_cr": "EBITDA (Cr)", "ebitda_margin_pct": "EBITDA Margin %", "total_debt_cr": "Total Debt (Cr)", "net_debt_cr": "Net Debt (Cr)", "net_debt_ebitda": "Net Debt/EBITDA"}
COMPANY_LABELS = {"name": "Company Name", "is_listed": "Listed", "bse_code": "BSE Code", "isin": "ISIN"}
SCREEN_COLUMNS = [
    "company_id", "Company Name", "Agency", "Rating", "Grade", "Outlook", "Sector", "Listed", "Revenue (Cr)", "EBITDA (Cr)", "EBITDA Margin %",
    "Total Debt (Cr)", "Net Debt (Cr)", "Net Debt/EBITDA", "Rating Date", "Rationale URL", "BSE Code", "ISIN",
]


def chosen(ratings: DataFrame) -> DataFrame:
    return top_rating(latest_rating(ratings))


def screen(companies: DataFrame, ratings: DataFrame, financials: DataFrame, filters: Filters | None = Filters(), order: bool = True) -> DataFrame:
    """Filters apply to the chosen row, so a company whose best rating is by another agency isn't found under its second best; None: no filter at all."""
    c = companies.select(F.col("id").alias("company_id"), *(F.col(k).alias(v) for k, v in COMPANY_LABELS.items()))
    r = chosen(ratings).select("company_id", *(F.col(k).alias(v) for k, v in RATING_LABELS.items()))
    m = latest_financials(financials).select("company_id", *(F.col(k).alias(v) for k, v in MONEY_LABELS.items()))
    out = c.join(r, "company_id").join(m, "company_id", "left").select(*SCREEN_COLUMNS)
    for condition in filters.conditions() if filters else ():
        out = out.where(condition)
    return out.orderBy(F.col("Grade").asc(), F.col("Company Name").asc()) if order else out


def user_sort(df: DataFrame, column: str, ascending: bool, limit: int | None = None) -> DataFrame:
    """Sorted by one column, nulls last either way, then by name and id."""
    first = F.col(column).asc_nulls_last() if ascending else F.col(column).desc_nulls_last()
    out = df.orderBy(first, F.col("Company Name"), F.col("company_id"))
    return out if limit is None else out.limit(limit)


def listed_label(flag: Column) -> Column:
    return F.when(flag == 1, "Yes").otherwise("No")


def attach_notes(df: DataFrame, notes: DataFrame) -> DataFrame:
    """A Note column ('' without one), and '' for a missing link; known columns first, others after."""
    out = df.join(notes.select("company_id", F.col("note").alias("Note")), "company_id", "left")
    out = out.withColumns({"Note": F.coalesce("Note", F.lit("")), "Rationale URL": F.coalesce("Rationale URL", F.lit(""))})
    known = [c for c in [*SCREEN_COLUMNS, "Note"] if c in out.columns]
    return out.select(*known, *(c for c in out.columns if c not in known))


def rating_distribution(screened: DataFrame) -> DataFrame:
    """Companies per grade, with symbol and label."""
    n = screened.groupBy(F.col("Grade").alias("grade")).agg(F.count(F.lit(1)).alias("n"))
    symbol = grade_label(F.col("grade"))
    return n.select("grade", "n", symbol.alias("symbol"), F.concat(symbol, F.lit(" (G"), F.col("grade").cast("string"), F.lit(")")).alias("label"))
