"""Fixed values that results depend on."""

from __future__ import annotations

# Postal codes of states and territories, with the historical ones.
STATES = {
    "AK": "Alaska", "AL": "Alabama", "AR": "Arkansas", "AS": "American Samoa", "AZ": "Arizona",
    "CA": "California", "CO": "Colorado", "CT": "Connecticut", "DC": "District of Columbia", "DE": "Delaware",
    "FL": "Florida", "GA": "Georgia", "GU": "Guam", "HI": "Hawaii", "IA": "Iowa",
    "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "KS": "Kansas", "KY": "Kentucky",
    "LA": "Louisiana", "MA": "Massachusetts", "MD": "Maryland", "ME": "Maine", "MI": "Michigan",
    "MN": "Minnesota", "MO": "Missouri", "MP": "Northern Mariana Islands", "MS": "Mississippi", "MT": "Montana",
    "NA": "National", "NC": "North Carolina", "ND": "North Dakota", "NE": "Nebraska", "NH": "New Hampshire",
    "NJ": "New Jersey", "NM": "New Mexico", "NV": "Nevada", "NY": "New York", "OH": "Ohio",
    "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania", "PR": "Puerto Rico", "RI": "Rhode Island",
    "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah",
    "VA": "Virginia", "VI": "Virgin Islands", "VT": "Vermont", "WA": "Washington", "WI": "Wisconsin",
    "WV": "West Virginia", "WY": "Wyoming", "OL": "Orleans", "DK": "Dakota", "PI": "Philippine Islands",
}

# Kinds of bills.
BILL_TYPES = {
    "hconres": "House Concurrent Resolution",
    "hjres": "House Joint Resolution",
    "hr": "House Bill",
    "hres": "House Resolution",
    "sconres": "Senate Concurrent Resolution",
    "sjres": "Senate Joint Resolution",
    "s": "Senate Bill",
    "sres": "Senate Resolution",
}

# Headings of presiding speakers, in order of priority; House, then Senate.
HOUSE_SPEAKERS = [
    "The CLERK",
    "The Acting CLERK",
    "The ACTING CLERK",
    "The SPEAKER pro tempore",
    "The SPEAKER",
    "The Acting SPEAKER pro tempore",
    "The ACTING SPEAKER pro tempore",
    "The Acting CHAIR",
    "The ACTING CHAIR",
    "The Acting CHAIRMAN",
    "The ACTING CHAIRMAN",
    "The CHAIRMAN",
    "The CHAIRWOMAN",
]
SENATE_SPEAKERS = [
    "The PRESIDING OFFICER",
    "The PRESIDENT pro tempore",
    "The Acting PRESIDENT pro tempore",
    "The ACTING PRESIDENT pro tempore",
    "The VICE PRESIDENT",
    "The CHIEF JUSTICE",
    "Mr. Counsel",
    "Mrs. Counsel",
    "Ms. Counsel",
]
# In compat mode two of the House headings are one, so neither is ever found alone.
JOINED_HEADINGS = ("The SPEAKER", "The Acting SPEAKER pro tempore")


def generic_speakers(mode: str = "intent") -> list[str]:
    """Headings tried after a document's own speakers."""
    house = list(HOUSE_SPEAKERS)
    if mode == "compat":
        at = house.index(JOINED_HEADINGS[0])
        house[at : at + 2] = ["".join(JOINED_HEADINGS)]
    return house + SENATE_SPEAKERS


# What the annotation rules leave out.
VERB_TAGS = ["BES", "HVS", "VB", "VBD", "VBN", "VBP", "VBZ", "MD"]
ENTITY_BLACKLIST = ["Hon", "Jr", "Memory", "Speaker", "Thereupon", "Sr", "Tribute To Dr", "REP", "HON", "JR", "SR", "Madam", "Dear Madam", "Sincerely", "Speaker Pro Tempore", "Adjournment"]
ENTITY_TAILS = [" On", " Sine Die Adjournment"]
CHUNK_BLACKLIST = [" hon ", "sine die adjournment", "who", "where", "when", "what", "behalf", "somebody", "some one", "anybody", "any one"]
PRONOUN_LEMMA = "-PRON-"
DETERMINERS = ["a", "an", "the", "this", "that", "these", "those", "each", "every", "some", "any", "no", "another"]
NUMERIC_TYPES = ["ORDINAL", "CARDINAL", "PERCENT", "MONEY", "QUANTITY", "DATE", "TIME"]
MARKS = "!\"#$%&'()*+,-/:;<=>?@[\\]^_`{|}~"
LEADING_MARKS = "!\"#$%&'()*+,-/.:;<=>?@[\\]^_`{|}~ "
SHORT_WORD, FUZZY_SCORE, TOKEN_LIMIT = 4, 90, 4999
