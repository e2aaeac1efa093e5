"""Secret scans: fixed patterns, and a guess-cost estimate of values that stand where credentials do.

`scan` gives every span of a whole text, in code points, end exclusive:

* assign, access, hex: the patterns below, leftmost and non-overlapping for
  each kind; the span is the whole match, and matches below their least length
  are dropped after matching.
* guess: a value in a credential context that the patterns leave out, when the
  cheapest way to guess it costs at least 10**LEAST_GUESSES tries. The cost is
  the minimum over all segmentations of the value into known words, dates,
  repeats, keyboard walks and brute-force spans, found by dynamic programming.

Segments start and end anywhere. Only repeats and walks of over LONG characters
are tried at their full length alone, which keeps the work of a value in
proportion to its length. Words and their ranks are a short list that guessers
try first, then the words of the corpus, most common first: they are counted
over all documents, and WORDS of them at most go to every task.

Nulls and empty texts have no spans. Repeated rows each get their own result.
Only the columns named are read, so others may have any name.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keep

# Kinds in their order, patterns, and least lengths.
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST = 8
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# Where else credentials stand, and what a value there looks like.
CONTEXT = re.compile(
    r"""(?ai:(?<![a-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|secret|auth)[_-]?key|auth(?:orization)?|bearer|credentials?|client[_-]?secret))["']?[ \t]*(?:[:=]|=>|:=)[ \t]*(?:(?ai:bearer|basic)[ \t]+)?["']?([^\s"'<>,;]{6,})"""
)
CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "credential")

# Words that guessers try first, most common first.
COMMON = """password 123456 qwerty letmein admin welcome login abc123 monkey dragon master hello freedom whatever
shadow sunshine princess football baseball iloveyou trustno1 superman batman starwars secret root user test guest
default changeme example sample temp demo pass love money summer winter spring autumn monday friday january february
march april june july august september october november december name company service server database db prod dev
staging public private token key access null none true false string value your here insert""".split()
RANK = {w: math.log10(i + 2) for i, w in enumerate(COMMON)}
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("@4831!05$7", "aabeiiosst")

LEAST_GUESSES = 10.0
LONGEST_WORD, LONG, LONGEST_UNIT = 24, 32, 8
#: Words of the corpus, at most, that count as known.
WORDS = 20_000
#: Each further segment makes a guesser try more orders of segments.
SEGMENT = 0.5
DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/._](?:0?[1-9]|1[0-2])[-/._](?:19|20)\d\d|(?:19|20)\d\d", re.ASCII)
DATE_LENGTHS = (4, 8, 9, 10)

# Neighbours on a keyboard: the next key of a row, and the nearest of the next row.
NEXT = {(a, b) for row in ROWS for a, b in zip(row, row[1:])}
NEXT |= {(a, b) for up, down in zip(ROWS, ROWS[1:]) for i, b in enumerate(down) for a in up[i : i + 2]}
NEXT |= {(b, a) for a, b in NEXT}


def brute(value: str) -> list[float]:
    """log10 of the alphabet that a brute-force guesser needs for each character; letters of one case run as in words."""
    kinds = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in value]
    mixed = len(set(kinds)) > 1
    each = (1.41, 1.41, 1.0, 1.52) if mixed else (0.9, 0.9, 1.0, 1.52)
    return [each[k] for k in kinds]


def walks(a: str, b: str) -> bool | None:
    """How the next key follows: True for the next of the alphabet or digits, False for a neighbour on the keyboard, None for neither."""
    return True if ord(b) - ord(a) == 1 else False if (a, b) in NEXT else None


def segments(value: str, ranks: dict[str, float]) -> list[list[tuple[int, float]]]:
    """From each start, the end and cost of every segment that is not brute force."""
    low = "".join(c if len(c.lower()) > 1 else c.lower() for c in value)  # keeps the length
    n, plain, step = len(value), low.translate(LEET), brute(value)
    sums = [0.0]
    for x in step:
        sums.append(sums[-1] + x)

    def word(i: int, j: int) -> float:
        """log10 of the guesses for a known word as it is written; infinite for none."""
        w = low[i:j]
        cost = ranks.get(w)
        if cost is None:
            cost = ranks.get(plain[i:j])
            if cost is None:
                return math.inf
            cost += 0.3
        return cost if value[i:j] == w else cost + 0.3

    out: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i + 3, min(n, i + LONGEST_WORD) + 1):
            if (cost := word(i, j)) < math.inf:
                out[i].append((j, cost))
        if "0" <= value[i] <= "9":
            for k in DATE_LENGTHS:
                if i + k <= n and DATE.fullmatch(value, i, i + k):
                    out[i].append((i + k, math.log10(365.0 * 120) if k > 4 else math.log10(120.0)))
    for unit in range(1, min(LONGEST_UNIT, n // 2) + 1):
        same = 0  # characters from i on that equal those a unit later
        for i in range(n - unit - 1, -1, -1):
            same = same + 1 if value[i] == value[i + unit] else 0
            most = same // unit + 1
            if most > 1:
                cost = min(word(i, i + unit), sums[i + unit] - sums[i])
                many = min(most, max(2, LONG // unit))
                out[i] += [(i + unit * m, cost + math.log10(m)) for m in range(2, many + 1)]
                if most > many:
                    out[i].append((i + unit * most, cost + math.log10(most)))
    end = n - 1
    for i in range(n - 1, -1, -1):  # end: the last character of the longest walk from i
        if i + 1 < n and walks(low[i], low[i + 1]) is None:
            end = i
        way, turns = None, 0
        for j in range(i + 1, min(end, i + LONG) + 1):
            now = walks(low[j - 1], low[j])
            turns += way is not None and now != way
            way = now
            if j - i >= 2:
                out[i].append((j + 1, math.log10(47.0) + math.log10(j + 1 - i) + turns * math.log10(4.0)))
    longest = n - 1
    turn = [0] * (n + 1)  # turns of the walk from i to its end
    for i in range(n - 2, -1, -1):
        now = walks(low[i], low[i + 1])
        if now is None:
            longest, turn[i] = i, 0
            continue
        then = walks(low[i + 1], low[i + 2]) if i + 2 <= longest else None
        turn[i] = turn[i + 1] + (then is not None and then != now)
        if longest - i > LONG:
            out[i].append((longest + 1, math.log10(47.0) + math.log10(longest + 1 - i) + turn[i] * math.log10(4.0)))
    return out


def guess_cost(value: str, ranks: dict[str, float] = RANK) -> float:
    """log10 of the guesses that the cheapest segmentation of value needs."""
    n = len(value)
    step, ends = brute(value), segments(value, ranks)
    best = [0.0] + [math.inf] * n
    brute_best = [math.inf] * (n + 1)  # cheapest so far with a brute-force span that is still open
    for i in range(n):
        here = min(best[i], brute_best[i])
        for j, cost in ends[i]:
            best[j] = min(best[j], here + cost + (SEGMENT if i else 0.0))
        brute_best[i + 1] = min(best[i] + (SEGMENT if i else 0.0), brute_best[i]) + step[i]
    return min(best[n], brute_best[n])


def scan(text: str | None, ranks: dict[str, float] = RANK) -> list[tuple[str, int, int, float | None]]:
    """All spans of a text by start, then kind: (kind, start, end, log10 of guesses for guess)."""
    if not text:
        return []
    low = text.lower()
    found: list[tuple[str, int, int, float | None]] = []
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", m.start(), m.end(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), None) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end(), None) for m in HEX.finditer(text)]
    if any(w in low for w in CONTEXT_WORDS):
        starts, reach = [], [0]  # of the spans so far by start, the farthest end of each one and those before it
        for _, s, e, _ in sorted(found, key=lambda x: x[1]):
            starts.append(s)
            reach.append(max(reach[-1], e))
        for m in CONTEXT.finditer(text):
            start, end = m.span(1)
            while end > start and text[end - 1] in ".)]}:!?":
                end -= 1
            if end - start >= 6 and reach[bisect_left(starts, end)] <= start and (cost := guess_cost(text[start:end], ranks)) >= LEAST_GUESSES:
                found.append(("guess", start, end, cost))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def known_words(docs: DataFrame, text: str = "text", most: int = WORDS) -> dict[str, float]:
    """log10 of the rank of words that guessers try: the fixed list, then the corpus's most common words, `most` at most.

    Words are taken by whole classes of commonness (eighths of a power of two), so
    the driver gets the sizes of some hundred classes and the words taken, no more.
    """
    every = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w).between(3, LONGEST_WORD))
    counted = keep(docs.select(F.explode(every).alias("w")).groupBy("w").count(), "words")
    level = F.floor(F.log2("count") * 8)
    taken, least = 0, None
    for r in sorted(counted.groupBy(level.alias("level")).count().collect(), reverse=True):
        if taken + r["count"] > most:
            break
        taken, least = taken + r["count"], r["level"]
    rows = counted.where(level >= least).collect() if taken else []
    discard(counted)
    words = dict.fromkeys([*COMMON, *(r["w"] for r in sorted(rows, key=lambda r: (-r["count"], r["w"])))])
    return {w: math.log10(i + 2) for i, w in enumerate(words)}


SPANS = "array<struct<kind:string,start:long,end:long,log10_guesses:double>>"


def secrets(docs: DataFrame, text: str = "text", out: str = "secrets", ranks: dict[str, float] | None = None) -> DataFrame:
    """All columns of docs and the spans of a text column; ranks of known words are counted over docs where none are given."""
    known = docs.sparkSession.sparkContext.broadcast(known_words(docs, text) if ranks is None else ranks)

    @F.pandas_udf(SPANS)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("kind", "start", "end", "log10_guesses")
        for s in batches:
            yield s.map(lambda x: [dict(zip(names, span)) for span in scan(x, known.value)], na_action=None)

    return docs.withColumn(out, of(F.coalesce(F.col(text), F.lit(""))))


def digest(found: DataFrame, spans: str = "secrets") -> DataFrame:
    """Counts and joined spans of each document."""
    said = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(said(F.filter(spans, lambda x: x["kind"] != "guess")), 256).alias("base_sha256"),
        said(F.col(spans)).alias("spans"),
    )
