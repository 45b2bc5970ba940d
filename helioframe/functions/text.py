"""Text and address functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Address words and what they are shortened to.
SUFFIXES = {
    "STREET": "ST", "AVENUE": "AVE", "AV": "AVE", "ROAD": "RD", "BOULEVARD": "BLVD", "DRIVE": "DR", "LANE": "LN", "COURT": "CT",
    "PLACE": "PL", "PARKWAY": "PKWY", "HIGHWAY": "HWY", "CIRCLE": "CIR", "TERRACE": "TER", "TRAIL": "TRL", "SQUARE": "SQ", "PLAZA": "PLZ",
    "EXPRESSWAY": "EXPY", "FREEWAY": "FWY", "CENTER": "CTR", "CANYON": "CYN", "MOUNT": "MT", "SAINT": "ST",
}
DIRECTIONS = {"NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W", "NORTHEAST": "NE", "NORTHWEST": "NW", "SOUTHEAST": "SE", "SOUTHWEST": "SW"}
# Words that do not tell streets apart.
GENERIC_STREET_WORDS = ["ST", "AVE", "RD", "BLVD", "DR", "LN", "CT", "PL", "PKWY", "HWY", "CIR", "TER", "TRL", "SQ", "PLZ", "EXPY", "FWY", "WAY", "N", "S", "E", "W", "NE", "NW", "SE", "SW"]
# Words that do not tell owners apart.
ENTITY_WORDS = ["LLC", "LP", "LLP", "INC", "CO", "CORP", "CORPORATION", "LTD", "THE", "OF", "A", "AN", "AND"]
# Words that do not tell property names apart.
GENERIC_NAME_WORDS = ["the", "at", "of", "on", "and", "apartments", "apartment", "apts", "apt", "homes", "residences", "luxury", "community", "phase", "i", "ii", "iii", "north", "south", "east", "west", "a", "in"]
# The kinds of obstruction that first words name.
OBSTRUCTION_WORDS = {"hvac": "hvac", "rtu": "hvac", "vent": "vent", "skylight": "skylight", "hatch": "hatch", "standpipe": "standpipe", "smoke": "smoke_vent", "obstruction": "other"}
# Mapped building classes by occupancy; other classes have none.
R2_CLASSES = ["apartments", "dormitory"]
R3_CLASSES = ["house", "detached", "semidetached_house", "terrace", "bungalow", "cabin", "farm", "static_caravan"]
COMMERCIAL_CLASSES = [
    "commercial", "retail", "industrial", "warehouse", "office", "supermarket", "hotel", "school", "university", "college", "hospital", "public",
    "civic", "government", "church", "manufacture", "kindergarten", "parking", "service", "sports_hall", "storage_tank", "transportation", "garage",
]
COMPASS = {name: 45.0 * i for i, name in enumerate(["N", "NE", "E", "SE", "S", "SW", "W", "NW"])}
# The expressions of permit descriptions.
SOLAR = r"(?i)SOLAR|PHOTOVOLTAIC|\bPV\b"
NOT_ROOF = r"(?i)CARPORT|CANOPY|GROUND[\s-]*MOUNT|PARKING\s+STRUCTURE|TRELLIS|SHADE\s+STRUCTURE|PERGOLA"
NOT_NEW = r"(?i)\bREMOVE\b|DETACH|RE-?INSTALL|REVISION TO|BATTERY ONLY|ESS ONLY|EV CHARG"
KILOWATTS = r"(?i)(\d{1,4}(?:[.,]\d+)?)\s*-?\s*(?:KW|KILO\s*WATTS?)(?:\s*-?\s*DC)?\b"
MEGAWATTS = r"(?i)(\d{1,2}(?:\.\d+)?)\s*-?\s*MW\b"
CALIFORNIA = r"(?i),\s*(CA|California)\b(\s+9\d{4})?"
SECRET = r"(?i)((?:key|token|api_key|apikey)=)[^&\s'\"]+"


def lookup(table: dict[str, str | float], key: Column) -> Column:
    """The value of a small fixed table, or null."""
    out = F
    for k, v in table.items():
        out = out.when(key == k, F.lit(v))
    return out


def replaced(table: dict[str, str], key: Column) -> Column:
    return F.coalesce(lookup(table, key), key)


def header_name(header: Column) -> Column:
    """A header trimmed, lower case, with single spaces for underscores and spaces."""
    return F.trim(F.regexp_replace(F.lower(F.trim(header)), r"[_\s]+", " "))


def street_tokens(street: Column) -> Column:
    tokens = F.regexp_extract_all(F.upper(street), F.lit("[A-Z0-9]+"), F.lit(0))
    return F.transform(tokens, lambda t: F.coalesce(lookup(DIRECTIONS, t), lookup(SUFFIXES, t), t))


def street_score(query: Column, candidate: Column) -> Column:
    """Share of query tokens in candidate; 0 unless every distinctive one is, or if there is none."""
    generic = F.array(*(F.lit(w) for w in GENERIC_STREET_WORDS))
    core = F.filter(query, lambda t: ~F.array_contains(generic, t))
    missing = F.exists(core, lambda t: ~F.array_contains(candidate, t))
    share = F.size(F.filter(query, lambda t: F.array_contains(candidate, t))) / F.size(query)
    return F.when((F.size(core) == 0) | missing, F.lit(0.0)).otherwise(share)


def parse_address(address: Column) -> Column:
    """number, street and zip of a one-line US address; null unless both number and zip are there."""
    zip_code = F.regexp_extract(F.trim(address), r"\b(\d{5})(?:-\d{4})?\s*(?:,?\s*(?:USA|US|United States))?\s*$", 1)
    head = r"^\s*(\d+[A-Za-z]?)(?:-\d+)?\s+([^,#]+)"
    number, street = F.regexp_extract(address, head, 1), F.regexp_extract(address, head, 2)
    street = F.trim(F.regexp_replace(street, r"(?i)\b(APT|UNIT|STE|SUITE|BLDG|BUILDING)\b.*$", ""))
    return F.when((zip_code != "") & (number != ""), F.struct(F.upper(number).alias("number"), street.alias("street"), zip_code.alias("zip")))


def owner_name(owner: Column) -> Column:
    """Owner names comparable: upper case, no dots or signs, no entity words."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.upper(owner), r"\.", ""), "[^A-Z0-9]+", " ")), " ")
    return F.concat_ws(" ", F.filter(words, lambda w: ~w.isin(ENTITY_WORDS)))


def same_owner(owner_a: Column, owner_b: Column, mail_a: Column, mail_b: Column) -> Column:
    equal = lambda x, y: (owner_name(x) != "") & (owner_name(x) == owner_name(y))
    return equal(F.coalesce(owner_a, F.lit("")), F.coalesce(owner_b, F.lit(""))) | equal(F.coalesce(mail_a, F.lit("")), F.coalesce(mail_b, F.lit("")))


def name_words(text: Column) -> Column:
    tokens = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(tokens, lambda t: ~t.isin(GENERIC_NAME_WORDS) & (F.length(t) > 1)))


def kw_from_text(text: Column) -> Column:
    """The largest kW figure (or 1000 x MW) between 0 and 20000, or null."""
    kw = F.transform(F.regexp_extract_all(text, F.lit(KILOWATTS), F.lit(1)), lambda v: F.regexp_replace(v, ",", ".").cast("double"))
    mw = F.transform(F.regexp_extract_all(text, F.lit(MEGAWATTS), F.lit(1)), lambda v: v.cast("double") * 1000)
    return F.array_max(F.filter(F.concat(kw, mw), lambda v: (v > 0) & (v < 20000)))


def new_roof_install(text: Column) -> Column:
    return text.rlike(SOLAR) & ~text.rlike(NOT_ROOF) & ~text.rlike(NOT_NEW)


def redact(text: Column) -> Column:
    return F.regexp_replace(text, SECRET, "$1***")


def error_slug(text: Column, most: int = 60) -> Column:
    return F.regexp_replace(F.substring(F.regexp_replace(redact(text), r"[^A-Za-z0-9_]+", "_"), 1, most), "^_+|_+$", "")


def site_of(building_id: Column) -> Column:
    return F.regexp_replace(building_id, r" #\d+$", "")


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9_]+", "_")


def xml_escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def plane_from_name(name: Column) -> Column:
    """pitch and azimuth of 'plane <x/12 or degrees> <compass or degrees>', or null."""
    shape = r"(?i)^\s*plane\s+(\S+)\s+(\S+)"
    pitch, way = F.regexp_extract(name, shape, 1), F.upper(F.regexp_extract(name, shape, 2))
    rise, run = (F.try_to_number(F.nullif(F.regexp_extract(pitch, r"^([0-9.]+)/([0-9.]+)$", k), F.lit("")), F.lit("99999.999")).cast("double") for k in (1, 2))
    plain = F.regexp_replace(pitch, "°$", "").try_cast("double")
    degrees = F.coalesce(F.degrees(F.atan(rise / run)), plain)
    azimuth = F.coalesce(lookup(COMPASS, way), F.regexp_replace(way, "°$", "").try_cast("double"))
    return F.when(pitch != "", F.struct(degrees.alias("pitch_deg"), azimuth.alias("azimuth_deg")))


def obstruction_kind(name: Column) -> Column:
    return lookup(OBSTRUCTION_WORDS, F.regexp_extract(F.lower(name), "([a-z]+)", 1))


def occupancy_from_text(text: Column) -> Column:
    """commercial, R-3 or R-2 from free text, in that order; null if none fits."""
    t = F.lower(F.trim(text))
    return (
        F.when(t.contains("commercial") | t.isin("office", "retail", "industrial", "warehouse"), "commercial")
        .when(t.isin("r-3", "r3") | t.contains("townho") | t.contains("single") | t.contains("btr") | t.contains("rental home"), "R-3")
        .when(t.contains("multi") | t.contains("apartment") | t.isin("r-2", "r2", "mf"), "R-2")
    )


def occupancy_from_class(mapped: Column) -> Column:
    """R-2, R-3 or commercial of a mapped building class; null if it tells none."""
    return F.when(mapped.isin(R2_CLASSES), "R-2").when(mapped.isin(R3_CLASSES), "R-3").when(mapped.isin(COMMERCIAL_CLASSES), "commercial")


def existing_solar_check(address: Column, year_built: Column, doubtful: Column, first_year: int = 2020) -> Column:
    """Why a Californian site may have solar already, or ''."""
    california = F.coalesce(address.rlike(CALIFORNIA), F.lit(False))
    return F.when(california & (year_built >= first_year), F.concat(F.lit("built_"), year_built.cast("string"))).when(california & year_built.isNull() & doubtful, "new_construction").otherwise("")


def imagery_age_years(imagery: Column, year: int, month: int) -> Column:
    """Years between an ISO date string (month may be 00) and a given month."""
    y, m = F.substring(imagery, 1, 4).try_cast("int"), F.greatest(F.substring(imagery, 6, 2).try_cast("int"), F.lit(1))
    return (F.lit(year * 12 + month) - (y * 12 + m)) / 12
