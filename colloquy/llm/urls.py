"""URL filters: rules for hosts and paths, then a weighted vocabulary.

A rule (verdict, host, path) fits its host and all subdomains where the url's path begins with the rule's; the
longest that fits decides. Where none fits, an Aho-Corasick automaton finds the vocabulary's terms in the url
(A-Z lowered); a hit counts if no letter a-z or digit stands on either side of it. Each distinct term adds its weight
once, and a sum of at least ``limit`` blocks: a strict term weighs as much as the limit, a soft one less.

Edge cases: a url that is null or has no ``://`` has an empty host and path and fits no rule; a null url holds no
terms and is allowed. Repeated rows are judged each. Columns besides stay; a result name that is taken gets
underscores in front.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, free_name, give_back, small_batches

#: The rules of the contract.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: The vocabulary where none is given, of content words only: names of tracking parameters or formats are no content.
#: One of these blocks.
STRICT = tuple(
    """
    porn porno pornhub xxx xvideos xnxx xhamster redtube youporn hentai milf milfs gangbang blowjob handjob deepthroat creampie
    cumshot camgirl camgirls sexcam sexcams upskirt escort escorts callgirl callgirls casino sportsbook bookmaker
    warez torrent torrents thepiratebay crackz keygen keygens serialz nulled cardable fullz carding darknet
    """.split()
)
#: Several distinct ones of these block.
SOFT = tuple(
    """
    sex sexy adult nude nudes naked erotic fetish lingerie hot singles dating hookup swingers bet bets betting gamble gambling
    poker roulette blackjack slots jackpot lottery bingo wager odds pharmacy pills viagra cialis xanax tramadol steroids
    replica crack cracked patch serial hack hacks cheat cheats mod apk payday loan loans credit forex binary cheap free win
    winner bonus prize giveaway followers proxies botnet
    """.split()
)
#: Weight at which a url is blocked; strict terms have it, soft ones weigh 1.
LIMIT = 2


def host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host_col: Column, path_col: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (host and path as one string), and its verdict; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):  # the longest is asked first, so comes last
        fits = ((host_col == h) | host_col.endswith("." + h)) & path_col.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


#: Most terms of a vocabulary, which every task holds whole.
MOST_TERMS = 1_000_000


def vocabulary(table: DataFrame) -> dict[str, int]:
    """Terms and weights of a table (term, weight). Nulls, empty terms and weights below 1 are left out, A-Z lowered; of
    repeated terms the largest weight counts. More than ``MOST_TERMS`` rows are an error."""
    rows = table.select(ascii_lower(F.col("term")).alias("term"), F.col("weight").cast("int").alias("weight")).filter("term <> '' AND weight > 0")
    got = rows.groupBy("term").agg(F.max("weight").alias("weight")).limit(MOST_TERMS + 1).collect()
    if len(got) > MOST_TERMS:
        raise ValueError(f"the vocabulary has more than {MOST_TERMS} terms")
    return {r["term"]: r["weight"] for r in got}


def automaton(terms: dict[str, int]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for term, weight in terms.items():
        out.add_word(term, (term, weight))
    if terms:
        out.make_automaton()
    return out


_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def weight(url: str | None, machine) -> int:
    """The sum of the weights of the distinct terms of a url."""
    text = (url or "").translate(_LOWER)
    found = {}
    if len(machine):
        for end, (term, w) in machine.iter(text):
            start = end + 1 - len(term)
            if (start == 0 or text[start - 1] not in _WORD) and (end + 1 == len(text) or text[end + 1] not in _WORD):
                found[term] = w
    return sum(found.values())


def judge(pages: DataFrame, url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, terms: dict[str, int] | DataFrame | None = None, limit: int = LIMIT) -> DataFrame:
    """``pages`` with host, path, rule, weight and verdict. ``terms``: weights by term, or a table (term, weight)."""
    host_, path_, rule_, weight_, verdict_ = (free_name(pages.columns, n) for n in ("host", "path", "rule", "weight", "verdict"))
    small_batches(pages.sparkSession)
    if isinstance(terms, DataFrame):
        terms = vocabulary(terms)
    if terms is None:
        terms = dict.fromkeys(SOFT, 1) | dict.fromkeys(STRICT, limit)
    schema = T.StructType([*pages.schema.fields, T.StructField(weight_, T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(terms)
        for batch in batches:
            weights = [weight(u, machine) for u in batch.column(url_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weights, pa.int32())], names=[*batch.schema.names, weight_])

    weighed = pages.mapInArrow(give_back(run), schema).withColumn(host_, host(F.col(url_col))).withColumn(path_, path(F.col(url_col)))
    rule, verdict = rule_of(F.col(host_), F.col(path_), rules)
    own = F.when(F.col(weight_) >= limit, "block").otherwise("allow")
    return weighed.select(*pages.columns, host_, path_, rule.alias(rule_), weight_, F.coalesce(verdict, own).alias(verdict_))
