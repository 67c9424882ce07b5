"""Folding of any script to small ASCII letters."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

from pyspark.sql import Column, functions as F

from kinloom.functions import lexicon as lex

_BEYOND_ASCII = re.compile(r"[^\x00-\x7f]")
#: Chinese and Korean letters, which have no reading; a shortcut, as the map knows none of them either.
_WITHOUT_READING = r"[\u3400-\u9fff\uac00-\ud7a3]"
_ITEM, _VALUE = "\x01", "\x02"


@cache
def _letters() -> dict[str, tuple[bool, str | None, bool]]:
    """For each Indic letter: whether an open consonant gets its vowel before it, what it reads, whether it leaves a consonant open."""
    out: dict[str, tuple[bool, str | None, bool]] = {}
    for block in lex.INDIC_BLOCKS:
        for place in range(0x80):
            own = (True, " ", False)
            if place in lex.INDIC_CONSONANTS:
                own = (True, lex.INDIC_CONSONANTS[place], True)
            elif place in lex.INDIC_VOWEL_SIGNS:
                own = (False, lex.INDIC_VOWEL_SIGNS[place], False)
            elif place == lex.INDIC_VIRAMA:
                own = (False, None, False)
            elif place in lex.INDIC_NASALS or place in lex.INDIC_VOWELS:
                own = (True, (lex.INDIC_NASALS | lex.INDIC_VOWELS)[place], False)
            elif 0 <= place - lex.INDIC_DIGIT_ZERO <= 9:
                own = (True, str(place - lex.INDIC_DIGIT_ZERO), False)
            out[chr(block + place)] = own
    return out | {chr(c): (True, reading, False) for c, reading in lex.FINAL_LETTERS.items()}


def romanize(text: str) -> str:
    """Latin reading of Indic letters; other characters stay.  An open consonant at the end of a word has no vowel."""
    letters, read, is_open = _letters(), [], False
    nukta = {chr(b + lex.INDIC_NUKTA) for b in lex.INDIC_BLOCKS}
    silent = {chr(b + p) for b in lex.INDIC_BLOCKS for p in lex.INDIC_SILENT}
    for c in text:
        if c in nukta:
            if read and read[-1] in lex.NUKTA_READINGS:
                read[-1] = lex.NUKTA_READINGS[read[-1]]
        elif c in silent or c in "‌‍":
            continue
        elif (own := letters.get(c)) is None:
            read.append(c)
            is_open = False
        else:
            closes, reading, opens = own
            if is_open and closes:
                read.append("a")
            if reading is not None:
                read.append(reading)
            is_open = opens
    return "".join(read)


def fold_text(text: str) -> str:
    """Accents come apart from their letters, and go with all else beyond ASCII."""
    if text.isascii():
        return text.lower()
    apart = unicodedata.normalize("NFKD", romanize(text.replace(*lex.MALAYALAM_DOUBLE)))
    return _BEYOND_ASCII.sub("", apart).lower()


@cache
def _plain() -> tuple[str, str, str]:
    """Latin characters that fold to one character, what they fold to, and those that fold to none."""
    one, to, none = [], [], []
    for c in map(chr, range(0x80, 0x250)):
        folded = fold_text(c)
        if len(folded) == 1:
            one.append(c), to.append(folded)
        elif not folded:
            none.append(c)
    return "".join(one), "".join(to), "".join(none)


@cache
def _readings() -> tuple[str, str, str]:
    """Characters of the first Indic block and of other scripts that read as one character, what they read, and the others as pairs for a map."""
    first, folded = lex.INDIC_BLOCKS[0], {}
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        if c not in _letters() and unicodedata.decomposition(c):
            folded[c] = fold_text(c)
    folded |= {chr(first + p): _letters()[chr(first + p)][1] or "" for p in range(0x80)}
    folded |= {mark: reading for reading, mark in _closed().items()}
    single = [c for c, reading in folded.items() if len(reading) == 1]
    pairs = _ITEM.join(c + _VALUE + reading for c, reading in folded.items() if len(reading) > 1)
    return "".join(single), "".join(folded[c] for c in single), pairs


@cache
def _closed() -> dict[str, str]:
    """Private characters for the readings of letters that leave no consonant open, also once a nukta has changed them."""
    readings = {*lex.FINAL_LETTERS.values()}
    readings |= {lex.NUKTA_READINGS[r] for r in readings if r in lex.NUKTA_READINGS}
    return {r: chr(0xE000 + i) for i, r in enumerate(sorted(readings))}


def _romanized(text: Column) -> Column:
    """``romanize`` as far as single characters: all Indic letters in the first block, changed by nuktas, inherent vowels written out."""
    letters, first = _letters(), lex.INDIC_BLOCKS[0]
    nukta, virama = chr(first + lex.INDIC_NUKTA), chr(first + lex.INDIC_VIRAMA)
    moved = {chr(b + p): chr(first + p) for b in lex.INDIC_BLOCKS[1:] for p in range(0x80)}
    moved |= {mark: "\ufffd" for mark in _closed().values()} | {chr(c): _closed()[r] for c, r in lex.FINAL_LETTERS.items()}
    silent = "".join(chr(b + p) for b in lex.INDIC_BLOCKS for p in lex.INDIC_SILENT) + "\u200c\u200d"
    kept = {c: to for c, to in moved.items() if c not in silent}
    out = F.translate(F.replace(text, *map(F.lit, lex.MALAYALAM_DOUBLE)), "".join(kept) + silent, "".join(kept.values()))
    consonants = {chr(first + p): r for p, r in lex.INDIC_CONSONANTS.items()}
    by_reading = {r: c for c, r in consonants.items()}
    for plain, changed in lex.NUKTA_READINGS.items():
        found = "".join(c for c, r in consonants.items() if r == plain)
        for before, after in ((found, by_reading[changed]), (plain, changed), (_closed().get(plain, ""), _closed().get(changed, ""))):
            if len(before) == 1 or before == found:
                out = F.regexp_replace(out, f"[{before}]({virama}*){nukta}", f"{after}$1")
    closing = "".join(chr(first + p) for p in range(0x80) if letters[chr(first + p)][0]) + "".join(_closed().values())
    out = F.replace(out, F.lit(nukta), F.lit(""))
    return F.regexp_replace(out, f"(?<=[{''.join(consonants)}])(?=[{closing}])", "a")


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def fold(text: Column) -> Column:
    """Small ASCII letters of a text: accents go, Indic scripts are romanised, what is left beyond ASCII is deleted.

    Equal to ``fold_text``, but inside the JVM; texts of Latin letters alone take a shorter way.  Null stays null.
    """
    one, to, none = _plain()
    latin = F.translate(text, one + none, to)
    single, reading, pairs = _readings()
    several = F.str_to_map(F.lit(pairs), F.lit(_ITEM), F.lit(_VALUE))
    read = F.regexp_replace(F.translate(_romanized(text), single, reading), _WITHOUT_READING, "")
    spelt = F.transform(F.split(read, ""), lambda c: F.when(c > "\x7f", F.coalesce(F.try_element_at(several, c), F.lit(""))).otherwise(c))
    return F.when(_is_ascii(text), F.lower(text)).when(_is_ascii(latin), F.lower(latin)).otherwise(F.lower(F.array_join(spelt, "")))
