"""Reference values used by more than one operator."""

from __future__ import annotations

# USPS abbreviation, name and Census FIPS code of states and territories.
STATES = (
    ("AL", "Alabama", "01"), ("AK", "Alaska", "02"), ("AZ", "Arizona", "04"), ("AR", "Arkansas", "05"), ("CA", "California", "06"),
    ("CO", "Colorado", "08"), ("CT", "Connecticut", "09"), ("DE", "Delaware", "10"), ("DC", "District of Columbia", "11"),
    ("FL", "Florida", "12"), ("GA", "Georgia", "13"), ("HI", "Hawaii", "15"), ("ID", "Idaho", "16"), ("IL", "Illinois", "17"),
    ("IN", "Indiana", "18"), ("IA", "Iowa", "19"), ("KS", "Kansas", "20"), ("KY", "Kentucky", "21"), ("LA", "Louisiana", "22"),
    ("ME", "Maine", "23"), ("MD", "Maryland", "24"), ("MA", "Massachusetts", "25"), ("MI", "Michigan", "26"), ("MN", "Minnesota", "27"),
    ("MS", "Mississippi", "28"), ("MO", "Missouri", "29"), ("MT", "Montana", "30"), ("NE", "Nebraska", "31"), ("NV", "Nevada", "32"),
    ("NH", "New Hampshire", "33"), ("NJ", "New Jersey", "34"), ("NM", "New Mexico", "35"), ("NY", "New York", "36"),
    ("NC", "North Carolina", "37"), ("ND", "North Dakota", "38"), ("OH", "Ohio", "39"), ("OK", "Oklahoma", "40"), ("OR", "Oregon", "41"),
    ("PA", "Pennsylvania", "42"), ("RI", "Rhode Island", "44"), ("SC", "South Carolina", "45"), ("SD", "South Dakota", "46"),
    ("TN", "Tennessee", "47"), ("TX", "Texas", "48"), ("UT", "Utah", "49"), ("VT", "Vermont", "50"), ("VA", "Virginia", "51"),
    ("WA", "Washington", "53"), ("WV", "West Virginia", "54"), ("WI", "Wisconsin", "55"), ("WY", "Wyoming", "56"),
    ("AS", "American Samoa", "60"), ("GU", "Guam", "66"), ("MP", "Northern Mariana Islands", "69"), ("PR", "Puerto Rico", "72"),
    ("VI", "Virgin Islands", "78"),
)

# Whole-word expansions of the canonical text form ("st" has its own rule).
EXPANSIONS = {
    "st": "street", "rd": "road", "ave": "avenue", "av": "avenue", "dr": "drive", "ln": "lane", "ct": "court", "cir": "circle",
    "pl": "place", "ter": "terrace", "blvd": "boulevard", "pkwy": "parkway", "hwy": "highway", "rte": "route", "rt": "route",
    "ext": "extension", "sq": "square", "pt": "point", "mtn": "mountain", "mt": "mount", "ft": "fort", "n": "north", "s": "south",
    "e": "east", "w": "west", "ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest",
}
# After one of these "st" stays a street.
NOT_SAINT = ("n", "s", "e", "w", "ne", "nw", "se", "sw", "north", "south", "east", "west", "ext", "extension")

# Postal directions.
DIRECTIONS = {
    "N": "N", "NORTH": "N", "S": "S", "SOUTH": "S", "E": "E", "EAST": "E", "W": "W", "WEST": "W", "NE": "NE", "NORTHEAST": "NE",
    "NW": "NW", "NORTHWEST": "NW", "SE": "SE", "SOUTHEAST": "SE", "SW": "SW", "SOUTHWEST": "SW",
}

# Postal secondary unit designators.
UNITS = {
    "APARTMENT": "APT", "APT": "APT", "BASEMENT": "BSMT", "BSMT": "BSMT", "BUILDING": "BLDG", "BLDG": "BLDG", "DEPARTMENT": "DEPT",
    "DEPT": "DEPT", "FLOOR": "FL", "FL": "FL", "FRONT": "FRNT", "FRNT": "FRNT", "HANGAR": "HNGR", "HNGR": "HNGR", "KEY": "KEY",
    "LOBBY": "LBBY", "LBBY": "LBBY", "LOT": "LOT", "LOWER": "LOWR", "LOWR": "LOWR", "OFFICE": "OFC", "OFC": "OFC", "PENTHOUSE": "PH",
    "PH": "PH", "PIER": "PIER", "REAR": "REAR", "ROOM": "RM", "RM": "RM", "SIDE": "SIDE", "SLIP": "SLIP", "SPACE": "SPC", "SPC": "SPC",
    "STOP": "STOP", "SUITE": "STE", "STE": "STE", "TRAILER": "TRLR", "TRLR": "TRLR", "UNIT": "UNIT", "UPPER": "UPPR", "UPPR": "UPPR",
}

# Postal street suffixes, by full name. Spellings beyond the name, its abbreviation and the
# plurals that end in S come from the rule below or from the caller's own table.
SUFFIXES = {
    "ALLEY": "ALY", "ANNEX": "ANX", "ARCADE": "ARC", "AVENUE": "AVE", "BAYOU": "BYU", "BEACH": "BCH", "BEND": "BND", "BLUFF": "BLF",
    "BOTTOM": "BTM", "BOULEVARD": "BLVD", "BRANCH": "BR", "BRIDGE": "BRG", "BROOK": "BRK", "BYPASS": "BYP", "CAMP": "CP",
    "CANYON": "CYN", "CAPE": "CPE", "CAUSEWAY": "CSWY", "CENTER": "CTR", "CIRCLE": "CIR", "CLIFF": "CLF", "CLUB": "CLB",
    "COMMON": "CMN", "CORNER": "COR", "COURSE": "CRSE", "COURT": "CT", "COVE": "CV", "CREEK": "CRK", "CRESCENT": "CRES",
    "CREST": "CRST", "CROSSING": "XING", "CROSSROAD": "XRD", "DALE": "DL", "DAM": "DM", "DIVIDE": "DV", "DRIVE": "DR",
    "ESTATE": "EST", "EXPRESSWAY": "EXPY", "EXTENSION": "EXT", "FERRY": "FRY", "FIELD": "FLD", "FLAT": "FLT", "FORD": "FRD",
    "FOREST": "FRST", "FORGE": "FRG", "FORK": "FRK", "FORT": "FT", "FREEWAY": "FWY", "GARDEN": "GDN", "GATEWAY": "GTWY",
    "GLEN": "GLN", "GREEN": "GRN", "GROVE": "GRV", "HARBOR": "HBR", "HAVEN": "HVN", "HEIGHTS": "HTS", "HIGHWAY": "HWY",
    "HILL": "HL", "HOLLOW": "HOLW", "INLET": "INLT", "ISLAND": "IS", "ISLE": "ISLE", "JUNCTION": "JCT", "KNOLL": "KNL",
    "LAKE": "LK", "LANDING": "LNDG", "LANE": "LN", "LIGHT": "LGT", "LOCK": "LCK", "LODGE": "LDG", "LOOP": "LOOP", "MALL": "MALL",
    "MANOR": "MNR", "MEADOW": "MDW", "MEWS": "MEWS", "MILL": "ML", "MISSION": "MSN", "MOTORWAY": "MTWY", "MOUNT": "MT",
    "MOUNTAIN": "MTN", "NECK": "NCK", "ORCHARD": "ORCH", "OVAL": "OVAL", "OVERPASS": "OPAS", "PARK": "PARK", "PARKWAY": "PKWY",
    "PASS": "PASS", "PASSAGE": "PSGE", "PATH": "PATH", "PIKE": "PIKE", "PINE": "PNE", "PLACE": "PL", "PLAIN": "PLN", "PLAZA": "PLZ",
    "POINT": "PT", "PORT": "PRT", "PRAIRIE": "PR", "RAMP": "RAMP", "RANCH": "RNCH", "RAPID": "RPD", "REST": "RST", "RIDGE": "RDG",
    "RIVER": "RIV", "ROAD": "RD", "ROUTE": "RTE", "ROW": "ROW", "RUN": "RUN", "SHOAL": "SHL", "SHORE": "SHR", "SKYWAY": "SKWY",
    "SPRING": "SPG", "SPUR": "SPUR", "SQUARE": "SQ", "STATION": "STA", "STREAM": "STRM", "STREET": "ST", "SUMMIT": "SMT",
    "TERRACE": "TER", "TRACE": "TRCE", "TRACK": "TRAK", "TRAIL": "TRL", "TUNNEL": "TUNL", "TURNPIKE": "TPKE", "UNDERPASS": "UPAS",
    "UNION": "UN", "VALLEY": "VLY", "VIADUCT": "VIA", "VIEW": "VW", "VILLAGE": "VLG", "VILLE": "VL", "VISTA": "VIS", "WALK": "WALK",
    "WALL": "WALL", "WAY": "WAY", "WELL": "WL",
}


def suffix_variants(extra: dict[str, str] | None = None) -> dict[str, str]:
    """Spelling -> standard suffix: names, abbreviations, their plurals, and the caller's own spellings."""
    out: dict[str, str] = {}
    for name, short in SUFFIXES.items():
        out[name] = out[short] = short
        if not name.endswith("S") and short != name:
            out.setdefault(name + "S", short + "S")
            out.setdefault(short + "S", short + "S")
        elif not name.endswith("S"):
            out.setdefault(name + "S", short)
    return out | (extra or {})


LAYERS = ("address", "venue", "street", "neighbourhood", "locality", "localadmin", "county", "region", "country", "postalcode")
COARSE_LAYERS = ("neighbourhood", "locality", "localadmin", "county", "region", "country", "postalcode")
SOURCE_ALIASES = {"oa": "openaddresses", "osm": "openstreetmap", "wof": "whosonfirst"}
SOURCES = ("openaddresses", "openstreetmap", "whosonfirst", "gnis", "zcta", "overture", "interpolation")
#: name -> (default, least, most)
LIMITS = {"max_text": (200, 20, 1000), "max_size": (40, 1, 100), "max_circle_km": (100, 1, 1000), "max_reverse_km": (50, 0.1, 200), "max_address_km": (5, 0.1, 50)}
#: What a layer is worth before popularity is added.
LAYER_IMPORTANCE = {"region": 1.0, "county": 0.85, "locality": 0.75, "localadmin": 0.65, "postalcode": 0.6, "neighbourhood": 0.5, "venue": 0.4, "street": 0.35}
OTHER_IMPORTANCE = 0.3
