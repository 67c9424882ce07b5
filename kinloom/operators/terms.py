"""Terms of records by which retrieval finds them, and the channels that use them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Follows each term of a record's text of terms; normalised texts don't hold it.
END = "\u001f"


def prefixed(prefix: str, text: Column) -> Column:
    """The words of a blank-joined string as terms with a prefix."""
    return F.regexp_replace(F.trim(text), "([^ ]+) *", f"{prefix}$1{END}")


def name_terms() -> Column:
    """Tokens and skeletons of the core name."""
    return F.concat(prefixed("n", F.col("nc")), prefixed("s", F.col("sk")))


def address_terms() -> Column:
    """Tokens of the address and pairs of neighbours."""
    text = F.trim("an")
    # the last pair takes the last word along
    pairs = F.when(text.contains(" "), F.regexp_replace(text, r"([^ ]+) +(?=([^ ]+))(?:[^ ]+\z)?", f"b$1_$2{END}")).otherwise("")
    return F.concat(prefixed("a", text), pairs)


def gram_terms(n: int = 4) -> Column:
    """Character n-grams of the compact name between its marks; a name too short for one is a term itself."""
    marked = F.concat(F.lit("^"), F.col("nk"), F.lit("$"))
    # one pass; the place of a substring would be counted from the start of the name for each gram.  The last one takes the rest along
    grams = F.regexp_replace(marked, rf"(?s)(?=(.{{{n}}})).(?:.{{{n - 1}}}\z)?", f"c$1{END}")
    return F.when(F.length(marked) < n, F.concat(F.lit("c"), marked, F.lit(END))).otherwise(grams)


def skeleton_terms() -> Column:
    return F.concat(prefixed("s", F.col("sk")), address_terms())


def web_like() -> Column:
    return F.col("web") | ((F.length("nk") >= 8) & ~F.col("nc").contains(" "))


@dataclass(frozen=True)
class Channel:
    """How records meet: the text of their terms, which pool records are searched, and lengths of candidate lists."""

    text: Callable[[], Column]
    pool: Callable[[], Column] = lambda: F.lit(True)
    k: int = 10

    def terms(self) -> Column:
        """The distinct terms of a record."""
        return F.array_distinct(F.array_remove(F.split(self.text(), END), ""))


CHANNELS = {
    "joint": Channel(lambda: F.concat(name_terms(), address_terms()), k=30),
    "addr": Channel(address_terms, k=20),
    "name": Channel(name_terms),
    "cgram": Channel(gram_terms, web_like),
    "name_noaddr": Channel(name_terms, lambda: F.col("an") == ""),
    "native": Channel(skeleton_terms, lambda: F.col("native")),
    "cgram_noaddr": Channel(gram_terms, lambda: F.col("an") == ""),
}


def record_terms(records: DataFrame, channel: Channel, *columns: str) -> DataFrame:
    """rid, country, pool (whether from the pool), ``columns``, terms: the text of a record's terms, null if it takes no part."""
    return records.select("rid", "country", (F.col("source") > 1).alias("pool"), *columns, F.when((F.col("source") == 1) | channel.pool(), channel.text()).alias("terms"))
