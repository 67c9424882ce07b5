"""Normalisation of names and addresses as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from kinloom.functions import lexicon as lex
from kinloom.functions.fold import fold

ID_TAG = r"\(\s*id\s*:?\s*\d+\s*\)"
TRADE_MARKER = r"\b(?:d\s*/\s*b\s*/\s*a|dba|doing business as|trading as|t\s*/\s*a|aka|a\.k\.a\.?)\b\s*:?"
URL = r"https?://|www\."
DOMAIN = r"\.(?:co\.in|com|net|org|in|co|biz|info|fr|us)\b"
MESSRS = r"^\s*m\s*/\s*s\b\.?"
DIGIT_LETTER = r"((?<=[a-z])[0135](?=[a-z])|(?<=[a-z]{3})[0135]\b)"
WEB = r"(?iU)(\.com|\.in\b|\.net|\.org|www\.|^@)"
INDIC = r"[ऀ-ൿ]"


def looked_up(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))


def mapped(token: Column, table: dict[str, str]) -> Column:
    """What the table has for a token, or the token; most are known by their hash not to be in the table, whose map is read key by key."""
    changed = {k: v for k, v in table.items() if k != v}
    return F.when(token.isin(*changed), F.try_element_at(looked_up(changed), token)).otherwise(token)


def tokens(text: Column) -> Column:
    """Runs of small letters and digits."""
    return F.filter(F.split(text, "[^a-z0-9]+"), lambda t: t != "")


def words(text: Column) -> Column:
    """Tokens of a blank-joined string; none of an empty one."""
    return F.filter(F.split(text, " "), lambda t: t != "")


def repair_capital_l(text: Column) -> Column:
    """An l between capitals is an I."""
    return F.regexp_replace(text, r"(?U)\b([A-Z]+)l([A-Z]+)\b", "$1I$2")


def after_trade_marker(text: Column) -> Column:
    last = F.element_at(F.split(text, TRADE_MARKER), -1)
    return F.when(last.rlike(r"\S"), last).otherwise(text)


def repair_digit_letters(text: Column) -> Column:
    """0, 1, 3 and 5 that stand for o, i, e and s: between letters, or after three at a word's end.  All are marked before any is changed."""
    out = F.regexp_replace(text, DIGIT_LETTER, "\u0001$1")
    for digit, letter in zip("0135", "oies"):
        out = F.replace(out, F.lit("\u0001" + digit), F.lit(letter))
    return out


def skeleton(words: Column) -> Column:
    """Consonants of each of blank-joined tokens, alike for spellings that sound alike; tokens of digits alone stay."""
    out = F.regexp_replace(words, r"(?<![^ ])([0-9]+)(?![^ ])", "\u0001$1")
    for sound, sign in lex.SKELETON_REWRITES:
        out = F.replace(out, F.lit(sound), F.lit(sign))
    out = F.regexp_replace(F.translate(out, *lex.SKELETON_LETTERS), "(?<![^ ])[aeiou]", "a")
    out = F.regexp_replace(out, "(?<=[^ ])[aeiouh]", "")
    # doubles become one, but for those in the marked tokens
    return F.replace(F.regexp_replace(out, "(\u0001[0-9]+)|([^ ])\\2+", "$1$2"), F.lit("\u0001"), F.lit(""))


def name_tokens(raw: Column) -> Column:
    """All tokens of a name, legal forms in their short forms and honorifics in front removed."""
    s = fold(repair_capital_l(raw))
    s = after_trade_marker(F.regexp_replace(s, ID_TAG, " "))
    for pattern in (URL, DOMAIN, MESSRS):
        s = F.regexp_replace(s, pattern, " ")
    s = repair_digit_letters(F.translate(F.replace(s, F.lit("&"), F.lit(" and ")), "'`.", ""))
    found = F.transform(tokens(s), lambda t: mapped(t, lex.LEGAL_FORMS))
    native = F.transform(found, lambda t: F.coalesce(F.try_element_at(looked_up(lex.NATIVE_LEGAL_FORMS), skeleton(t)), t))
    return F.when(raw.rlike(INDIC), native).otherwise(found)


def without_honorifics(found: Column) -> Column:
    """Tokens from the first that is no honorific on, or the last one."""
    return words(F.regexp_replace(F.array_join(found, " "), f"^(?:(?:{'|'.join(lex.HONORIFICS)}) )+", ""))


def core_tokens(found: Column) -> Column:
    """Tokens that are neither legal forms nor stop words; all, if none is left."""
    idle = sorted({*lex.LEGAL_FORMS.values(), *lex.NAME_STOP_WORDS})
    core = F.filter(found, lambda t: ~t.isin(idle))
    core = F.when(F.size(core) > 0, core).otherwise(found)
    cut = (F.size(core) == 1) & core[0].rlike("^.{5,}com$")
    return F.when(cut, F.transform(core, lambda t: F.regexp_replace(t, "com$", ""))).otherwise(core)


def address_tokens(folded: Column) -> Column:
    short = F.regexp_replace(folded, "(?<![a-z0-9])0+([0-9]+(?:st|nd|rd|th)?)(?![a-z0-9])", "$1")
    return F.filter(F.transform(tokens(short), lambda t: mapped(t, lex.ADDRESS_FORMS)), lambda t: ~t.isin(lex.ADDRESS_NOISE))


def address_numbers(folded: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(folded, F.lit("0*([0-9]+)"), 1))


def folded_address(raw: Column) -> Column:
    return F.replace(F.replace(fold(raw), F.lit("n/a"), F.lit(" ")), F.lit("c/o"), F.lit(" "))


def letters_only(address: Column) -> Column:
    """Address tokens that aren't all digits."""
    return F.filter(words(address), lambda t: ~t.rlike("^[0-9]+$"))


def street(address: Column) -> Column:
    """The first word of three letters or more right after a number."""
    return F.regexp_extract(F.concat(F.lit(" "), F.replace(address, F.lit(" "), F.lit("  ")), F.lit(" ")), " [0-9]+  ([a-z]{3,}) ", 1)


def normalized(records):
    """Adds nn, nc, nk, sk, an, num, native and web to records with name and address; nulls count as empty."""
    name, address = F.coalesce("name", F.lit("")), F.coalesce("address", F.lit(""))
    # one step for each level, so that none is worked out again for every use above it
    df = records.withColumns({"_t": name_tokens(name), "_f": folded_address(address), "native": name.rlike(INDIC), "web": name.rlike(WEB)})
    df = df.withColumn("_t", without_honorifics(F.col("_t")))
    df = df.withColumn("_c", core_tokens(F.col("_t")))
    return df.withColumns(
        {
            "nn": F.array_join("_t", " "), "nc": F.array_join("_c", " "), "nk": F.array_join("_c", ""),
            "sk": skeleton(F.array_join("_c", " ")),
            "an": F.array_join(address_tokens(F.col("_f")), " "), "num": F.array_join(address_numbers(F.col("_f")), " "),
        }
    ).drop("_t", "_f", "_c")
