"""The patterns, lists and limits of the analyses, as results depend on them."""

PARTY_PATTERNS = {
    "oevp": r"\bÖVP\b|Österreichische Volkspartei",
    "spoe": r"\bSPÖ\b|Sozialdemokratische Partei Österreichs",
    "fpoe": r"\bFPÖ\b|Freiheitliche Partei Österreichs",
    "gruene": r"\bGrüne\b|Die Grünen",
}
PARTY_NAMES = {"oevp": "ÖVP", "spoe": "SPÖ", "fpoe": "FPÖ", "gruene": "Grüne"}
PARTY_TERMS = ("ÖVP", "Österreichische Volkspartei", "Volkspartei")
BANK_PATTERN = r"\bOeNB\b|Österreichische Nationalbank"
PERSON_PATTERN = r"\bSebastian Kurz"
MARKET_PATTERN = r"\bBörse\b|Aktien\b|Anleihen\b|Kapitalmarkt\b|ATX\b|Rezession"
AGENCY_ORIGINS = ("", "Redaktion", "APA", "AP", "APA, dpa", "Reuters", "dpa")

TOP_TOPICS = 10
TOP_AUTHORS = 50
TOP_SENTIMENT = 5
FIRST_YEAR = 2002
PRICES_FROM = "1999-01-01"
