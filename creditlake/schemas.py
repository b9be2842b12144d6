"""The four tables."""

COMPANIES = "id long, name string, name_normalized string, cin string, isin string, bse_code string, nse_symbol string, is_listed int"
RATINGS = (
    "id long, company_id long, agency string, rating_symbol string, rating_grade int, outlook string, instrument_type string, instrument_name string, "
    "rated_amount_cr double, rating_date string, sector string, sub_sector string, rationale_url string, source_id string"
)
MEASURES = ["revenue_cr", "ebitda_cr", "ebitda_margin_pct", "pat_cr", "total_debt_cr", "cash_cr", "net_debt_cr", "capex_cr", "interest_coverage", "net_debt_ebitda"]
FINANCIALS = "id long, company_id long, fiscal_year int, " + ", ".join(f"{m} double" for m in MEASURES) + ", data_source string, extraction_confidence double"
NOTES = "company_id long, note string"
