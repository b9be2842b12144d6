"""Symbols, words and multipliers that results depend on. All are stated as text, in natural order."""

from __future__ import annotations

# Fixed: rating symbols by grade, 1 is best; there is no CCC.
SYMBOLS = ["AAA", "AA+", "AA", "AA-", "A+", "A", "A-", "BBB+", "BBB", "BBB-", "BB+", "BB", "BB-", "B+", "B", "B-", "C+", "C", "C-", "D"]
GRADES = {s: g for g, s in enumerate(SYMBOLS, 1)}

# Fixed: agency names that may stand before a symbol, as patterns.
AGENCY_PREFIXES = [
    r"\[ICRA\]", r"ICRA\s+", r"CRISIL\s+", r"CARE\s+EDGE\s+", r"CARE\s+", r"IND\s+", r"FITCH\s+", r"INDIA\s+RATINGS\s+AND\s+RESEARCH\s+",
    r"ACUITE\s+", r"BRICKWORK\s+", r"BWR\s+", r"SMERA\s+", r"INFOMERICS\s+",
]

# Fixed: words from which the rest of a rating is an action.
ACTION_WORDS = r"ISSUER\s+NOT\s+COOPERATING|INC|REAFFIRMED|UPGRADED|DOWNGRADED|ASSIGNED|SUSPENDED|WITHDRAWN|SO|CE|PP-MLD"

# Fixed: outlook patterns, the first that occurs counts.
OUTLOOKS = [
    (r"watch\s+develop", "Watch Developing"), (r"watch\s+neg", "Watch Negative"), (r"watch\s+pos", "Watch Positive"), (r"\bwatch\b", "Watch"),
    (r"credit\s+watch", "Watch"), (r"review\s+for\s+downgrade", "Watch Negative"), (r"review\s+for\s+upgrade", "Watch Positive"),
    ("negative", "Negative"), ("positive", "Positive"), ("stable", "Stable"), ("developing", "Developing"),
]

# Fixed: grade bands (first grade, last grade) and presets of the least rating.
BANDS = [(1, 2), (3, 4), (5, 7), (8, 10), (11, 13), (14, 16), (17, 20)]
PRESETS = {
    "AAA only": (1, 1), "AA+ or better": (1, 2), "AA or better": (1, 3), "AA- or better": (1, 4), "A+ or better": (1, 5),
    "A or better": (1, 6), "A- or better": (1, 7), "BBB+ or better": (1, 8), "All": (1, 20),
}

# Fixed: sectors by group; any other sector is Corporate.
SECTOR_GROUPS = {
    "Corporate": [
        "Manufacturing", "Auto", "Healthcare", "Technology", "Textile", "Energy", "Retail", "Real Estate", "Telecom", "Chemicals",
        "Pharmaceuticals", "Consumer Durables", "Media", "Education", "Agriculture", "Food & Beverages", "Logistics", "Hotels",
        "Construction", "Cement", "Metals", "Mining", "Paper", "Printing", "Trading", "Services", "IT Services", "FMCG", "Diversified", "",
        "Realty", "Textiles & Apparels", "Auto Components", "Automobiles", "Agricultural, Commercial & Construction Vehicles",
        "Chemicals & Petrochemicals", "Fertilizers & Agrochemicals", "Industrial Products", "Industrial Manufacturing",
        "Agricultural Food & other Products", "Food Products", "Beverages", "Ferrous Metals", "Diversified Metals",
        "Metals & Minerals Trading", "Minerals & Mining", "Pharmaceuticals & Biotechnology", "Commercial Services & Supplies",
        "Other Consumer Services", "Leisure Services", "Telecom - Services", "Telecom - Equipment & Accessories", "Healthcare Services",
        "Healthcare Equipment & Supplies", "Paper, Forest & Jute Products", "IT - Services", "IT - Software", "IT - Hardware",
        "Electrical Equipment", "Cement & Cement Products", "Other Construction Materials", "Consumable Fuels", "Petroleum Products",
        "Diversified FMCG", "Household Products", "Entertainment", "Cigarettes & Tobacco Products", "Retailing", "Not Mapped",
    ],
    "Infrastructure": ["Infrastructure", "Transport Infrastructure", "Transport Services", "Other Utilities", "Public Services", "Gas", "Power", "Oil"],
    "Financial": ["Financial Sector", "Banks", "Capital Markets", "Finance", "Insurance"],
}

# Fixed: parts of names that mark a state-owned company; the name is padded with a blank on each side.
STATE_OWNED = [
    "ntpc ", "bhel ", " sail ", "ongc", "iocl", "gail ", "nalco", "nmdc", "nhpc", "npcil", "powergrid", "seci ", "irfc", "nhai ", "hudco",
    "sidbi", "nabard", "coal india", "indian oil", "bharat petroleum", "hindustan petroleum", "oil and natural gas", "gas authority",
    "steel authority of india", "national aluminium", "national mineral development", "national thermal power",
    "national highways authority", "national fertilizers", "bharat heavy electricals", "bharat electronics", "bharat dynamics",
    "hindustan aeronautics", "hindustan copper", "mazagon dock", "garden reach ship", "goa shipyard", "rites ", "ircon", "nbcc ", "moil ",
    "mtnl", "bsnl", "balmer lawrie", "mmtc", "mecon", "engineers india", "rashtriya chemicals", "state bank of india",
    "punjab national bank", "bank of baroda", "bank of india", "bank of maharashtra", "canara bank", "union bank of india",
    "central bank of india", "indian bank ", "uco bank", "life insurance corporation", "power finance corp",
    "rural electrification corp", "housing and urban development", "national bank for agriculture", "export import bank of india",
    "exim bank", "rec limited", "pfc limited", "food corporation of india", "oil india", "mrpl", "bpcl", "hpcl",
]

# Fixed: words that hint at a sector, the first in this order that occurs counts.
SECTOR_WORDS = [
    ("housing finance", "Financial Sector"), ("asset management", "Financial Sector"), ("microfinance", "Financial Sector"),
    ("stock broker", "Capital Markets"), ("securities", "Capital Markets"), ("broking", "Capital Markets"), ("financial", "Financial Sector"),
    ("finance", "Financial Sector"), ("lending", "Financial Sector"), ("nbfc", "Financial Sector"), ("mfin", "Financial Sector"),
    ("leasing", "Financial Sector"), ("wealth", "Financial Sector"), ("invest", "Financial Sector"), ("bank", "Financial Sector"),
    ("insurance", "Insurance"), ("credit", "Financial Sector"), ("infrastructure", "Infrastructure"), ("wind energy", "Power"),
    ("solar", "Power"), ("thermal power", "Power"), ("hydropower", "Power"), ("hydro power", "Power"), ("transmission", "Infrastructure"),
    ("highway", "Infrastructure"), ("airport", "Infrastructure"), ("seaport", "Infrastructure"), ("metro rail", "Infrastructure"),
    ("railway", "Infrastructure"), ("gas pipeline", "Gas"), ("city gas", "Gas"), ("natural gas", "Gas"), ("pipeline", "Infrastructure"),
    ("water treatment", "Other Utilities"), ("sewage", "Other Utilities"), ("infra", "Infrastructure"), ("power", "Power"),
    ("electric", "Power"), ("gas", "Gas"), ("port", "Infrastructure"), ("pharma", "Pharmaceuticals"), ("pharmaceutical", "Pharmaceuticals"),
    ("hospital", "Healthcare"), ("diagnostic", "Healthcare"), ("pathology", "Healthcare"), ("clinic", "Healthcare"), ("medic", "Healthcare"),
    ("health", "Healthcare"), ("ayurved", "Healthcare"), ("biotech", "Pharmaceuticals"), ("automobile", "Auto"), ("vehicle", "Auto"),
    ("tractor", "Auto"), ("two-wheel", "Auto"), ("tyres", "Auto"), ("tyre", "Auto"), ("auto component", "Auto"), ("auto", "Auto"),
    ("apparel", "Textile"), ("garment", "Textile"), ("textile", "Textile"), ("spinning", "Textile"), ("weaving", "Textile"),
    ("fabric", "Textile"), ("denim", "Textile"), ("hosiery", "Textile"), ("yarn", "Textile"), ("cotton", "Textile"), ("cement", "Cement"),
    ("aluminium", "Metals"), ("aluminum", "Metals"), ("copper", "Metals"), ("ferrous", "Metals"), ("non-ferrous", "Metals"),
    ("steel", "Metals"), ("metal", "Metals"), ("iron", "Metals"), ("zinc", "Metals"), ("minerals", "Mining"), ("mining", "Mining"),
    ("granite", "Mining"), ("coal", "Mining"), ("mine", "Mining"), ("software", "Technology"), ("it services", "IT Services"),
    ("information technology", "Technology"), ("tech", "Technology"), ("it ", "Technology"), ("telecom", "Telecom"),
    ("telecommunication", "Telecom"), ("supermarket", "Retail"), ("retail", "Retail"), ("retailing", "Retail"),
    ("real estate", "Real Estate"), ("realty", "Real Estate"), ("township", "Real Estate"), ("developer", "Real Estate"),
    ("property", "Real Estate"), ("hospitality", "Hotels"), ("hotel", "Hotels"), ("resort", "Hotels"), ("restaurant", "Hotels"),
    ("catering", "Hotels"), ("distillery", "Food & Beverages"), ("brewery", "Food & Beverages"), ("beverage", "Food & Beverages"),
    ("food", "Food & Beverages"), ("dairy", "Food & Beverages"), ("poultry", "Agriculture"), ("agro", "Agriculture"),
    ("agriculture", "Agriculture"), ("fertilizer", "Agriculture"), ("pesticide", "Agriculture"), ("seed", "Agriculture"),
    ("university", "Education"), ("education", "Education"), ("school", "Education"), ("college", "Education"), ("coaching", "Education"),
    ("institute", "Education"), ("paper", "Paper"), ("pulp", "Paper"), ("printing", "Printing"), ("petrochemical", "Chemicals"),
    ("chemical", "Chemicals"), ("media", "Media"), ("publishing", "Media"), ("warehousing", "Logistics"), ("logistics", "Logistics"),
    ("freight", "Logistics"), ("courier", "Logistics"), ("shipping", "Logistics"), ("transport", "Logistics"),
    ("construction", "Construction"), ("builder", "Construction"), ("petroleum", "Energy"), ("refinery", "Energy"), ("energy", "Energy"),
    ("oil", "Energy"), ("trading", "Trading"), ("merchant", "Trading"),
]

# Fixed: phrases in the names of rating criteria, the first in this order that occurs counts.
CRITERIA_SECTORS = [
    ("financial sector", "Financial Sector"), ("bank", "Financial Sector"), ("insurance", "Insurance"), ("capital market", "Capital Markets"),
    ("infrastructure sector", "Infrastructure"), ("real estate", "Real Estate"), ("hotel", "Hotels"), ("healthcare", "Healthcare"),
    ("pharma", "Pharmaceuticals"), ("textile", "Textile"), ("cement", "Cement"), ("manufacturing, trading and corporate", "Manufacturing"),
    ("manufacturing", "Manufacturing"),
]

# Fixed: units as multiples of a crore.
UNITS = {
    "cr": 1.0, "crs": 1.0, "crore": 1.0, "crores": 1.0, "mn": 0.1, "million": 0.1, "millions": 0.1, "lakh": 0.01, "lakhs": 0.01,
    "lacs": 0.01, "lac": 0.01, "bn": 100.0, "billion": 100.0, "billions": 100.0,
}

# Fixed: row labels of financial tables by field; a label holds a field if it contains any of its words.
TABLE_LABELS = {
    "revenue_cr": ["revenue", "net sales", "income from operations", "total revenue", "net revenue", "gross revenue", "total income", "net turnover", "turnover"],
    "ebitda_cr": ["ebitda", "operating profit", "pbdit", "ebit", "operating income", "op profit", "ebidta"],
    "pat_cr": ["pat", "profit after tax", "net profit", "profit for the year", "net income"],
    "total_debt_cr": ["total debt", "total borrowings", "debt", "total financial debt", "gross debt", "total outstanding debt"],
    "cash_cr": ["cash and equivalents", "cash & equivalents", "cash and bank", "cash & bank balances", "cash", "liquid investments"],
    "net_debt_cr": ["net debt", "net financial debt"],
    "capex_cr": ["capex", "capital expenditure", "additions to fixed assets", "purchase of fixed assets", "net capex"],
    "interest_coverage": ["interest coverage", "icr", "dscr", "interest service"],
}

# Fixed: labels of key-indicator tables in web pages, the first in this order that occurs counts; the second list is for lenders.
PAGE_LABELS = [
    ("revenue from operations", "revenue_cr"), ("operating income", "revenue_cr"), ("total income", "revenue_cr"), ("net revenue", "revenue_cr"),
    ("net sales", "revenue_cr"), ("revenue", "revenue_cr"), ("turnover", "revenue_cr"), ("reported profit after tax", "pat_cr"),
    ("profit after tax", "pat_cr"), ("net profit", "pat_cr"), ("ebitda margin", "ebitda_margin_pct"), ("opbdit/oi", "ebitda_margin_pct"),
    ("pat margins", "ebitda_margin_pct"), ("pat margin", "ebitda_margin_pct"), ("ebitda", "ebitda_cr"), ("opbdit", "ebitda_cr"),
    ("pat", "pat_cr"), ("interest coverage", "interest_coverage"), ("total debt", "total_debt_cr"), ("net debt", "net_debt_cr"),
    ("cash", "cash_cr"), ("capex", "capex_cr"),
]
LENDER_LABELS = [
    ("total assets", "total_assets_cr"), ("total income", "revenue_cr"), ("profit after tax", "pat_cr"), ("return on assets", "roa_pct"),
    ("net worth", "net_worth_cr"),
]

# Fixed: rules for rows of brief financials, in order: a label with any of the words, or with all of them where the flag is set.
BRIEF_RULES = [
    ("revenue_cr", False, ["total operating income", "net sales", "turnover", "total revenue", "revenue from operations", "total income"]),
    ("ebitda_cr", False, ["pbildt", "ebitda", "pbdit", "operating profit", "profit before interest", "ebit"]),
    ("pat_cr", False, ["profit after tax", "pat", "net profit", "profit for the year"]),
    ("interest_coverage", False, ["interest coverage", "icr", "dscr", "debt service"]),
    ("total_debt_cr", False, ["total debt", "total borrowing"]), ("net_debt_cr", False, ["net debt"]), ("cash_cr", True, ["cash", "equivalent"]),
    ("capex_cr", False, ["capex", "capital expenditure"]),
]

# Fixed: words of plain text that stand before a figure, by field, in order.
TEXT_WORDS = {
    "revenue_cr": ["Revenue", "Net Sales", "Income from Operations", "Total Revenue"], "ebitda_cr": ["EBITDA", "Operating Profit", "PBDIT"],
    "pat_cr": ["PAT", "Profit After Tax", "Net Profit"], "total_debt_cr": ["Total Debt", "Total Borrowings"],
    "cash_cr": ["Cash and Equivalents", "Cash & Equivalents"], "net_debt_cr": ["Net Debt"], "capex_cr": ["Capex", "Capital Expenditure"],
}

# Fixed: labels of text tables: percentages, ratios, amounts; each list in order.
TEXT_PERCENTAGES = [
    ("opbdit/oi", "ebitda_margin_pct"), ("ebitda/revenue", "ebitda_margin_pct"), ("ebitda margin", "ebitda_margin_pct"),
    ("operating margin", "ebitda_margin_pct"), ("pbdit/oi", "ebitda_margin_pct"), ("pat/oi", "pat_margin_pct"),
]
TEXT_RATIOS = [("total debt/opbdit", "total_ratio"), ("total debt/ebitda", "total_ratio"), ("net debt/opbdit", "net_ratio"), ("net debt/ebitda", "net_ratio")]
TEXT_AMOUNTS = [
    ("revenue_cr", ["operating income", "net sales", "revenue", "income from operations", "total income", "total revenue", "net revenue", "turnover"]),
    ("pat_cr", ["pat", "profit after tax", "net profit", "profit for the year"]),
    ("interest_coverage", ["interest coverage", "icr", "interest service coverage"]),
]

# Fixed: spellings of exchange result fields, in order.
RESULT_FIELDS = {
    "period": ["PeriodType", "periodType", "Period", "period"], "end": ["Date", "date", "PeriodEnd", "periodEnd", "ToDate"],
    "months": ["NofMonths", "noOfMonths", "Months", "months"],
    "revenue": ["SALES_AMT", "SalesAmt", "Net Sales/Income from operations", "NetSales", "Revenue", "TotalRevenue", "TotalIncome", "Income From Operations", "Gross Sales"],
    "pbt": ["PBT", "Pbt", "ProfitBeforeTax", "Profit Before Tax"], "pat": ["PAT", "Pat", "ProfitAfterTax", "NetProfit", "Net Profit", "Profit For Period"],
    "depreciation": ["Depreciation", "DepreciationAmt", "D&A"], "finance_cost": ["FinanceCost", "Interest", "FinanceCosts", "Finance Cost"],
    "operating_profit": ["PBDIT", "Pbdit", "OperatingProfit", "Operating Profit", "EBITDA", "EBIDTA"],
    "total_debt": ["TotalDebt", "TotalBorrowings", "Borrowings", "TotalOutstandingDebt", "LTBorrowings"],
    "cash": ["Cash", "CashAndBankBalance", "CashAndEquivalents", "CashBankBalance"], "capex": ["Capex", "CapitalExpenditure", "AdditionsToFA", "NetCapex"],
}
# Fixed: words that stand for no value, what ends a year of results, and where its year stands.
NO_VALUE = r"^\s*(null|NULL|N\.A\.|NA|-)?\s*$"
YEAR_END, YEAR = r"(?i)(Mar|March)\s*\d{4}", r"(\d{4})"
UNIT_FIELDS = ["Unit", "unit", "FaceValue", "ReportingUnit", "reportingUnit"]
UNIT_REVENUE_FIELDS = ["SALES_AMT", "SalesAmt", "Net Sales", "Revenue", "NetSales"]

# Fixed: spellings of listing fields, in order.
LISTING_FIELDS = {
    "company_name": ["CompanyName", "companyName", "Company", "company"],
    "raw_rating": ["Ratings", "Rating", "rating", "RatingSymbol", "ratingSymbol", "CurrentRating", "currentRating"],
    "sector": ["SectorName", "sectorName", "Sector", "sector"], "sub_sector": ["SubSectorName", "subSectorName", "SubSector", "subSector"],
    "instrument": ["Instrument1", "Instrument", "instrument", "InstrumentType", "instrumentType", "FacilityType"],
    "rating_date": ["RatingDate", "ratingDate", "Date", "date", "EffectiveDate", "effectiveDate", "ActionDate"],
    "rationale_id": ["RationaleId", "rationaleId", "RatId", "ratId", "Id", "id"], "company_key": ["CompanyId", "companyId"],
    "amount": ["RatedAmount", "ratedAmount", "Amount", "amount", "LimitSanctioned", "FacilitySize"],
}

# Fixed: line items of annual statements by field, in order.
STATEMENT_ITEMS = {
    "revenue": ("income", ["Total Revenue", "Operating Revenue", "Net Revenue"]), "ebitda": ("income", ["EBITDA", "Normalized EBITDA", "Operating Income"]),
    "ebit": ("income", ["EBIT"]), "depreciation": ("income", ["Reconciled Depreciation", "Depreciation And Amortization"]),
    "pat": ("income", ["Net Income", "Net Income Common Stockholders", "Net Income From Continuing Operation Net Minority Interest"]),
    "total_debt": ("balance", ["Total Debt", "Long Term Debt And Capital Lease Obligation", "Total Long Term Debt"]),
    "cash": ("balance", ["Cash And Cash Equivalents", "Cash Cash Equivalents And Short Term Investments", "Cash And Short Term Investments"]),
    "net_debt": ("balance", ["Net Debt"]), "capex": ("cashflow", ["Capital Expenditure", "Purchase Of PPE", "Capital Expenditures"]),
}

# Fixed: data_source and confidence that each source of financials carries; None where it is computed.
SOURCES = {"icra": ("icra_pdf", None), "crisil": ("crisil_html", 0.85), "bse": ("bse_xbrl", 0.85), "nse": ("nse_yfinance", 0.9), "care": ("care_edge_pdf", None)}

# Fixed: where each agency publishes a rationale; the parts in braces are filled in.
RATIONALE_URLS = {
    "ICRA": "https://www.icra.in/Rating/RatingDetails?CompanyId={id}&CompanyName={name}",
    "CRISIL": "https://www.crisilratings.com/mnt/winshare/Ratings/RatingList/RatingDocs/{file}",
    "CRISIL generic": "https://www.crisilratings.com/en/home/our-business/ratings/rating-rationale.html",
    "India Ratings": "https://www.indiaratings.co.in/Issuers?issuerID={id}",
    "CARE Edge": "https://www.careratings.com/upload/CompanyFiles/PR/{file}",
}

# Fixed: patterns by which sources write units, years, dates, figures and plans.
DECLARED_UNITS = [(r"in\s+lakh|rs\.?\s*lakh|\(lakh", 0.01), (r"in\s+million|rs\.?\s*million|\(mn\)", 0.1), (r"in\s+billion|rs\.?\s*billion|\(bn\)", 100.0)]
YEAR_LIKE = r"(?i)(?:FY\s*\d{2,4}|\d{4}-\d{2,4}|Mar-\d{2}|March\s*\d{4}|\d{4})"
FULL_YEAR, SHORT_YEAR = r"20(\d{2})", r"(?i)FY\s*(\d{2})(?!\d)"
PAGE_YEAR = r"(?i)\bFY\s*(\d{4})\b|\bMar[- ](\d{2,4})\b|\b(\d{4})\b"
BRIEF_YEARS = [r"(?i)march\s+\d{1,2},?\s*(\d{4})", r"(?i)\bFY\s*(20\d{2})\b", r"(?i)\bFY\s*(\d{2})\b(?!\d)"]
BRIEF_PARTIAL = "^([0-9]?[hqm]fy|9m|6m|q)"
TEXT_YEAR = r"(?i)(?:FY\s*\d{2,4}|\d{4}-\d{2,4}|Mar[-\s]\d{2,4})"
TEXT_FIGURE = r"-?[\d,]+\.?\d*%?|\([\d,]+\.?\d*\)"
TEXT_HEADING, TEXT_SECTION_ENDS = r"(?i)Key\s+financial\s+indicators", [r"^[A-Z][A-Za-z\s]+:$", r"(?i)^(Note|Rating|Instrument|Outlook)"]
CAPEX = r"(?i)capex\s+(?:of\s+)?(?:Rs\.?\s*)?(\d[\d,\.]*)\s*(crore|cr|lakh|mn|bn|million|billion)?"
CAPEX_AHEAD = r"(?i)over\s+the\s+next|planned|expected|FY2[0-9]|upcoming|envisaged|proposed"
CAPEX_SPAN, CAPEX_NEXT = r"(?i)(\d+)\s*[-–]\s*(\d+)\s*years?", r"(?i)next\s+(\d+)\s+years?"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
SUGGEST_RATING = r"(?i)['\"]?(CRISIL\s+[A-Z]{1,3}[+\-]?(?:\s*/\s*[A-Za-z]+)?)['\"]?"
SUGGEST_OUTLOOK = r"(?i)\b(Stable|Positive|Negative|Watch|Developing)\b"
SUGGEST_DATE = r"\b(\d{1,2}[\s\-/][A-Za-z]{3}[\s\-/]\d{2,4}|\d{4}[\-/]\d{2}[\-/]\d{2}|\d{1,2}/\d{1,2}/\d{2,4})\b"
SHORT_TERM_NAMES, SHORT_TERM_SYMBOLS = "commercial paper| cp|short term|short-term", "A[1-4]"
