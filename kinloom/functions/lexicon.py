"""Word lists and letter tables of the normalisation rules."""

from __future__ import annotations

# Results are only right with exactly these.

LEGAL_FORMS = {
    "limited": "ltd", "ltd": "ltd", "private": "pvt", "pvt": "pvt", "pte": "pvt",
    "corporation": "corp", "corp": "corp", "incorporated": "inc", "inc": "inc",
    "company": "co", "co": "co", "cie": "co", "llc": "llc", "llp": "llp", "lp": "lp", "plc": "plc",
    "pc": "pc", "pllc": "pllc", "pa": "pa", "public": "public",
    "sarl": "sarl", "sas": "sas", "sasu": "sasu", "eurl": "eurl", "sa": "sa", "sci": "sci", "snc": "snc", "ei": "ei",
}
#: Legal forms as transliterated names show them, by skeleton.
NATIVE_LEGAL_FORMS = {"lmt": "ltd", "prvt": "pvt", "prpt": "pvt", "kmpn": "co", "krprsn": "corp", "alp": "llp"}
NAME_STOP_WORDS = ["a", "an", "and", "d", "de", "des", "du", "en", "et", "l", "la", "le", "les", "of", "the"]
HONORIFICS = ["messrs", "miss", "mr", "mrs", "ms", "shree", "shri", "smt", "sree", "sri", "the"]
ADDRESS_FORMS = {
    "street": "st", "st": "st", "str": "st", "saint": "st", "ste": "ste", "suite": "ste",
    "road": "rd", "rd": "rd", "avenue": "ave", "ave": "ave", "av": "ave", "drive": "dr", "dr": "dr",
    "lane": "ln", "ln": "ln", "court": "ct", "ct": "ct", "boulevard": "blvd", "blvd": "blvd", "bd": "blvd", "bld": "blvd",
    "highway": "hwy", "hwy": "hwy", "place": "pl", "pl": "pl", "parkway": "pkwy", "pkwy": "pkwy",
    "circle": "cir", "cir": "cir", "terrace": "ter", "ter": "ter", "square": "sq", "sq": "sq", "trail": "trl", "trl": "trl",
    "north": "n", "south": "s", "east": "e", "west": "w", "apartment": "apt", "apt": "apt",
    "building": "bldg", "bldg": "bldg", "floor": "fl", "fl": "fl", "flr": "fl",
    "first": "1st", "second": "2nd", "third": "3rd", "fourth": "4th", "fifth": "5th",
    "nagar": "nagar", "ngr": "nagar", "sector": "sec", "sec": "sec", "phase": "ph", "ph": "ph",
    "near": "nr", "nr": "nr", "opposite": "opp", "opp": "opp", "railway": "rly", "rly": "rly",
    "crossing": "crsg", "crsg": "crsg", "cross": "crs", "colony": "colony", "society": "soc", "soc": "soc",
    "rue": "rue", "r": "rue", "chemin": "ch", "ch": "ch", "impasse": "imp", "imp": "imp", "route": "rte", "rte": "rte",
    "allee": "all", "general": "gen", "gen": "gen",
}
ADDRESS_NOISE = ["a", "door", "h", "hno", "na", "nan", "no", "none", "null", "number", "pmb", "unit"]
#: Rewrites of a phonetic skeleton, in this order, then letter by letter.
SKELETON_REWRITES = [
    ("chh", "c"), ("ch", "c"), ("sh", "s"), ("ph", "f"), ("kh", "k"), ("gh", "k"), ("th", "t"), ("dh", "t"),
    ("bh", "p"), ("jh", "j"), ("ck", "k"), ("x", "ks"), ("q", "k"), ("w", "v"), ("z", "s"),
]
SKELETON_LETTERS = ("gdbcy", "ktpki")

#: First code points of nine Indic blocks of 128 that share one layout; the tables go by the place in a block.
INDIC_BLOCKS = range(0x0900, 0x0D80, 0x80)
INDIC_CONSONANTS = {
    0x15: "k", 0x16: "kh", 0x17: "g", 0x18: "gh", 0x19: "n", 0x1A: "ch", 0x1B: "chh", 0x1C: "j", 0x1D: "jh", 0x1E: "n",
    0x1F: "t", 0x20: "th", 0x21: "d", 0x22: "dh", 0x23: "n", 0x24: "t", 0x25: "th", 0x26: "d", 0x27: "dh", 0x28: "n",
    0x29: "n", 0x2A: "p", 0x2B: "ph", 0x2C: "b", 0x2D: "bh", 0x2E: "m", 0x2F: "y", 0x30: "r", 0x31: "r", 0x32: "l",
    0x33: "l", 0x34: "l", 0x35: "v", 0x36: "sh", 0x37: "sh", 0x38: "s", 0x39: "h", 0x58: "q", 0x59: "kh", 0x5A: "g",
    0x5B: "z", 0x5C: "r", 0x5D: "rh", 0x5E: "f", 0x5F: "y",
}
INDIC_VOWELS = {
    0x05: "a", 0x06: "a", 0x07: "i", 0x08: "i", 0x09: "u", 0x0A: "u", 0x0B: "ri", 0x0C: "li", 0x0D: "e", 0x0E: "e",
    0x0F: "e", 0x10: "ai", 0x11: "o", 0x12: "o", 0x13: "o", 0x14: "au", 0x60: "ri", 0x61: "li", 0x72: "", 0x73: "",
}
INDIC_VOWEL_SIGNS = {
    0x3E: "a", 0x3F: "i", 0x40: "i", 0x41: "u", 0x42: "u", 0x43: "ri", 0x44: "ri", 0x45: "e", 0x46: "e", 0x47: "e",
    0x48: "ai", 0x49: "o", 0x4A: "o", 0x4B: "o", 0x4C: "au", 0x55: "", 0x56: "i", 0x57: "", 0x62: "li", 0x63: "li",
}
INDIC_NASALS = {0x01: "n", 0x02: "n", 0x03: "h", 0x70: "n"}
INDIC_SILENT = (0x3D, 0x71)
INDIC_VIRAMA, INDIC_NUKTA, INDIC_DIGIT_ZERO = 0x4D, 0x3C, 0x66
NUKTA_READINGS = {"j": "z", "ph": "f", "k": "q", "d": "r", "dh": "rh"}
#: Whole code points: Malayalam chillu letters and the Bengali khanda ta.
FINAL_LETTERS = {0x09CE: "t", 0x0D7A: "n", 0x0D7B: "n", 0x0D7C: "r", 0x0D7D: "l", 0x0D7E: "l", 0x0D7F: "k"}
MALAYALAM_DOUBLE = ("റ്റ", "ട്ട")
COUNTRY_CUTOFFS = {"US": 0.85, "India": 0.85, "France": 0.95}
DEFAULT_CUTOFF = 0.85
