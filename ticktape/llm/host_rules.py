"""Quality rules judged per document and per host.

Every document is counted and put to plain rules: the base ones (too few words, too many in repeated windows) and the operator's own
(symbols a word, repeated lines, mean word length).  Failures of any rule are added up by host; a host's failure rate is shrunk
towards the rate of all hosts by a beta prior whose strength is estimated from how much the hosts differ, so a host with few documents
cannot be condemned by two bad ones.  Hosts whose shrunk rate passes a limit are rejected, and the verdict is joined back to their
documents.  The limit follows from the prior: ``FAR_OUT`` standard deviations above the rate of all hosts, but at least
``LEAST_LIMIT`` and at most ``HOST_LIMIT``.  ``own=False`` judges by the base rules and ``HOST_LIMIT`` alone.

Every text is counted once and its counts are stored beside what the caller carries along; hosts are pre-aggregated from there, so
a host may hold any share of the documents.

Defined cases: a null text has no words and fails; a null host is a host of its own; repeated rows count each;
no rows give no rows and no hosts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ticktape.llm.tables import text_of, written

LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
HOST_LIMIT = 0.5
#: The operator's own rules: symbols and repeated lines by tenths, characters a word.
MOST_SYMBOLS, MOST_DUP_LINES, LEAST_DUP_LINES, SHORTEST, LONGEST = 1, 3, 3, 3, 12
FAR_OUT, LEAST_LIMIT = 3.0, 0.2
#: Bounds of the prior's strength, in documents.
WEAKEST, STRONGEST = 1.0, 1e6
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
NAMES = [c.split()[0] for c in COUNTS.split(", ")]
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_BLANKS = str.maketrans("", "", " \t\n\x0b\x0c\r")


def counts(text: str, window: int = WINDOW) -> tuple[int, int, int, int, int]:
    """Words, their characters, symbols, repeated lines, words inside repeated windows of one whole text."""
    return tallies(text, window)[:5]


def tallies(text: str, window: int = WINDOW) -> tuple[int, int, int, int, int, int]:
    """The ``counts``, and the lines that hold more than blanks."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes: exactly the six ASCII blanks
    lines = [x for x in text.split("\n") if x.translate(_BLANKS)]
    repeated = 0
    runs = list(zip(*(words[i:] for i in range(window))))
    if len(set(runs)) < len(runs):
        seen, reach = Counter(runs), 0
        for i, run in enumerate(runs):
            if seen[run] > 1:
                repeated += i + window - max(i, reach)
                reach = i + window
    return len(words), len(text.translate(_BLANKS)), len(_SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated, len(lines)


def counts_udf():
    @pandas_udf(f"{COUNTS}, n_lines long")
    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([tallies(t) for t in batch], columns=[*NAMES, "n_lines"], dtype="int64")

    return counted


def base_failed(found: Column) -> Column:
    return (found["n_words"] < LEAST_WORDS) | (100 * found["n_repeat_words"] > MOST_REPEATED * found["n_words"])


def own_failed(found: Column) -> Column:
    return (
        (10 * found["n_symbols"] > MOST_SYMBOLS * found["n_words"])
        | ((found["n_dup_lines"] >= LEAST_DUP_LINES) & (10 * found["n_dup_lines"] > MOST_DUP_LINES * found["n_lines"]))
        | (found["word_chars"] < SHORTEST * found["n_words"])
        | (found["word_chars"] > LONGEST * found["n_words"])
    )


def measured(docs: DataFrame, host: str = "source", text: str = "text", own: bool = True, carry: list[str] | None = None) -> DataFrame:
    """``row`` (the columns to ``carry``, all by default), ``host``, ``found`` (its counts), ``base_failed`` and ``failed`` (any rule)."""
    row = F.struct(*carry) if carry else F.struct("*")
    rows = docs.select(row.alias("row"), F.col(host).cast("string").alias("host"), counts_udf()(text_of(text)).alias("all"))
    every = F.col("all")
    base = base_failed(every)
    failed = base | own_failed(every) if own else base
    found = F.struct(*[every[n].alias(n) for n in NAMES])
    return written(rows.select("row", "host", found.alias("found"), base.alias("base_failed"), failed.alias("failed")), "measured")


def host_verdicts(rows: DataFrame, own: bool = True) -> DataFrame:
    """``host``, ``n``, ``failed``, ``rate`` (shrunk) and ``rejected`` of every host of ``measured`` rows."""
    hosts = written(rows.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("failed")), "hosts")
    n_hosts, n, failed = hosts.agg(F.count("*"), F.sum("n"), F.sum("failed")).first()
    mean = min(max((failed or 0) / max(1, n or 0), 1e-6), 1 - 1e-6)
    apart = hosts.agg(F.sum(F.col("n") * F.pow(F.col("failed") / F.col("n") - mean, 2)) / max(1, n or 0)).first()[0] or 0.0
    a, b = prior(n_hosts, n or 0, mean, apart)
    rate = (F.col("failed") + a) / (F.col("n") + a + b)
    return hosts.withColumn("rate", rate).withColumn("rejected", F.col("rate") > (host_limit(a, b) if own else HOST_LIMIT))


def host_limit(a: float, b: float) -> float:
    """The highest rate that is borne, from the prior of the hosts' rates."""
    mean = a / (a + b)
    far = mean + FAR_OUT * (mean * (1 - mean) / (a + b + 1)) ** 0.5
    return min(max(far, LEAST_LIMIT), HOST_LIMIT)


def prior(n_hosts: int, n: int, mean: float, apart: float) -> tuple[float, float]:
    """Beta prior of the hosts' rates, by moments: what hosts differ beyond chance sets its strength."""
    beyond = apart - mean * (1 - mean) * n_hosts / max(1, n)
    strength = mean * (1 - mean) / beyond - 1 if beyond > 0 else STRONGEST
    strength = min(max(strength, WEAKEST), STRONGEST)
    return mean * strength, (1 - mean) * strength


def judged(docs: DataFrame, host: str = "source", text: str = "text", own: bool = True, carry: list[str] | None = None) -> DataFrame:
    """``measured`` rows with ``kept``: not failed themselves, and not from a rejected host."""
    rows = measured(docs, host, text, own, carry)
    bad = host_verdicts(rows, own).where("rejected").select(F.col("host").alias("h"), "rejected")
    both = rows.join(bad, rows["host"].eqNullSafe(bad["h"]), "left").drop("h")
    return both.withColumn("kept", ~F.col("failed") & F.col("rejected").isNull())


def accepted(docs: DataFrame, host: str = "source", text: str = "text", own: bool = True) -> DataFrame:
    """The rows of ``docs`` that are kept."""
    return judged(docs, host, text, own).where("kept").select("row.*")
