"""US or non-US scope of a job's location text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: US states with their codes.
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE",
    "florida": "FL", "georgia": "GA", "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY",
    "louisiana": "LA", "maine": "ME", "maryland": "MD", "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS",
    "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM",
    "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA",
    "rhode island": "RI", "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT",
    "virginia": "VA", "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY", "district of columbia": "DC",
}
#: Words that place a job outside the US.
ELSEWHERE = (
    "canada", "united kingdom", "uk", "england", "ireland", "germany", "france", "spain", "italy", "netherlands", "poland", "romania", "india",
    "china", "japan", "singapore", "australia", "mexico", "brazil", "colombia", "argentina", "israel", "sweden", "norway", "denmark", "finland",
    "switzerland", "austria", "belgium", "portugal", "czech", "hungary", "philippines", "vietnam", "indonesia", "malaysia",
)
#: Names of the country, and what stands before a state's code.
COUNTRY = r"\b(united states|u\.s\.|u\.s\.a\.|usa)\b"
NAMED = rf"\b({'|'.join(STATES)})\b"
CODED = rf"(?i)(,|/| -)\s*({'|'.join(STATES.values())})(\b|$)"
OUTSIDE = rf"\b({'|'.join(ELSEWHERE)})\b"


def market_scope(location: Column, fallback: str = "unknown") -> Column:
    """US, non-US or the fallback; signs of the US win, and an empty location says nothing."""
    value = F.trim(F.regexp_replace(F.coalesce(location, F.lit("")), r"\s+", " "))
    low = F.lower(value)
    american = low.rlike(COUNTRY) | value.rlike(r"\bUS-[A-Z]{2}\b") | low.rlike(NAMED) | value.rlike(CODED)
    return F.when(low == "", fallback).when(american, "US").when(low.rlike(OUTSIDE), "non-US").otherwise(fallback)
