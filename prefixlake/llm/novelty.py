"""Secret scans: fixed patterns, and strings that a primed compressor cannot explain.

Three patterns find what looks like a secret by shape. Beyond them, a long token near a word
such as key, token or password, before or after it, is a candidate, and so is one near a token that
is reported, line by line through a key of many lines. Its novelty is the number of bytes that
zstandard needs for it when the surrounding code and a dictionary of identifiers are
already known: a fixed list and the ``LEARNED`` commonest words of long tokens of all documents. A word counts once per distinct token,
at least ``LEARNED_LEAST`` times, so that a copied secret teaches nothing. That is compared with what a random string of the same alphabet (digits, hex, base 32, ...) and
length costs, so that long keys of few different characters are found like short ones of many. Known names compress well,
other names and paths may not; what costs three quarters of a random string or more is reported as ``novel``. What the surroundings have in common with the
token, from ``MIN_TOKEN`` characters on, is left out of them, so a copy nearby explains nothing, and a
token that is reported once is reported wherever the text has it.

Positions are code points, ends exclusive. A null or empty text has no spans; repeated rows
are scanned one by one; no rows give no rows; texts of any length are scanned whole. Columns
other than the two named are not read.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixlake.llm.words import text_groups

KINDS = ("assign", "access", "hex", "novel")
# Fixed patterns of the base scan, applied leftmost and without overlap.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LENGTH, ACCESS_LENGTH = 8, 16

# A candidate: a token of the alphabet of keys.
MIN_TOKEN, CONTEXT = 20, 96
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_TOKEN)
SENSITIVE = re.compile(
    r"pass|secret|token|key|auth|bearer|credential|private|signature|aws|akia|login", re.ASCII | re.IGNORECASE)
LEARNED, LEARNED_LEAST = 2_000, 20
WORD = r"[A-Z]?[a-z]{3,14}|[A-Z]{4,15}"  # the words that long tokens are made of
NOVEL_SHARE = 0.75  # of the compressed bytes of a random string
# Alphabets of keys, smallest first; a token belongs to the first that has all its characters.
_DIGITS, _UPPER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()
ALPHABETS = (
    _DIGITS, _DIGITS + "abcdef", _DIGITS + "ABCDEF", _UPPER + "234567=", _DIGITS + _LOWER, _DIGITS + _UPPER,
    _DIGITS + _UPPER + _LOWER, _DIGITS + _UPPER + _LOWER + "+/_=-")
_STEP = 1.1  # lengths are compared with the next smaller power of it
IDENTIFIERS = (
    "authorization authentication bearer basic client_id client_secret access_key secret_key private_key public_key "
    "api_key apikey token refresh_token session_id cookie password passwd username user login email credential "
    "signature certificate begin end rsa ssh aws s3 bucket region account endpoint host port url http https www com "
    "org net localhost config settings environment variable export import from return function class public static "
    "void string int bool true false null none default self this new const let var if else for while try except "
    "catch raise throw print logger debug info warning error test example sample placeholder changeme your_key_here "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdef0123456789 application/json charset=utf-8"
).encode()


class NoveltyMeter:
    """Compressed bytes of a token that knows its surroundings.

    The surroundings are part of the dictionary: strings in them explain a token, while the mere
    use of the same letters does not, which would bring random lines of a key below their share.
    """

    def __init__(self, learned: tuple[str, ...] = ()):
        self.names = " ".join([*reversed(learned), ""]).encode() + IDENTIFIERS

    def cost(self, around: str, token: str) -> int:
        primed = zstandard.ZstdCompressionDict(self.names + around.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        compressor = zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False)
        return len(compressor.compress(token.encode())) - len(compressor.compress(b""))

    def is_novel(self, around: str, token: str) -> bool:
        return self.cost(around, token) >= NOVEL_SHARE * len(token) * random_cost(_alphabet(token), _rounded(len(token)))


_SETS = tuple(frozenset(letters) for letters in ALPHABETS)


def _alphabet(token: str) -> int:
    used = set(token)
    return next(k for k, letters in enumerate(_SETS) if used <= letters)


@lru_cache(maxsize=4096)
def _rounded(length: int) -> int:
    size = float(MIN_TOKEN)
    while size * _STEP <= length:
        size *= _STEP
    return int(size)


@lru_cache(maxsize=1024)
def random_cost(alphabet: int, length: int) -> float:
    """Compressed bytes per character of random strings: the least of a few that are the same in every run."""
    rng = random.Random(alphabet * 1_000_003 + length)
    meter = NoveltyMeter()
    return min(meter.cost("", "".join(rng.choices(ALPHABETS[alphabet], k=length))) for _ in range(5)) / length


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the pattern matches that are long enough."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _apart(token: str, before: str, after: str) -> str:
    """The last and first ``CONTEXT`` characters around a token, without what they have in common with it.

    The texts reach ``MIN_TOKEN`` characters further, so that a copy is seen that the context cuts.
    """
    parts = {token[k : k + MIN_TOKEN] for k in range(len(token) - MIN_TOKEN + 1)}

    def left(text: str) -> list[str]:
        own = [True] * len(text)
        for k in range(len(text) - MIN_TOKEN + 1):
            if text[k : k + MIN_TOKEN] in parts:
                own[k : k + MIN_TOKEN] = [False] * MIN_TOKEN
        return [c if o else "" for c, o in zip(text, own)]

    return "".join(left(before)[-CONTEXT:] + left(after)[:CONTEXT])


def _outside(spans: list[tuple[int, int]], known: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The spans, in order and apart, that no known span meets; both lists are walked once."""
    out, place, reach = [], 0, 0  # reach: the furthest end of the known spans that start before this one ends
    ordered = sorted((s, e) for s, _, e in known)
    for start, end in spans:
        while place < len(ordered) and ordered[place][0] < end:
            reach = max(reach, ordered[place][1])
            place += 1
        if reach <= start:
            out.append((start, end))
    return out


def novel_spans(text: str, known: list[tuple[int, int, int]], meter: NoveltyMeter) -> list[tuple[int, int, int]]:
    """Candidates outside the known spans that stand in a sensitive context and do not compress, each token once.

    The context is a sensitive word on either side, a known span that names a secret, or a reported token.
    """
    spans = _outside([m.span() for m in CANDIDATE.finditer(text)], known)
    # known spans that name a secret: ends up to here, and starts from here on, without gaps in order
    ends = sorted(e for _, kind, e in known if KINDS[kind] != "hex")
    starts = sorted(s for s, kind, _ in known if KINDS[kind] != "hex")

    def near_known(start: int, end: int) -> bool:
        before, after = bisect_right(ends, start), bisect_left(starts, end)
        return (before > 0 and start - ends[before - 1] <= CONTEXT) or (after < len(starts) and starts[after] - end <= CONTEXT)

    out: list[tuple[int, int, int]] = []
    reported: set[str] = set()  # once is enough here, see ``all_novel_spans``
    seen = [False] * len(spans)
    for first, (start, end) in enumerate(spans):
        if seen[first] or not (
                SENSITIVE.search(text, max(0, start - CONTEXT), start) or SENSITIVE.search(text, end, end + CONTEXT)
                or near_known(start, end)):
            continue
        seen[first], reached = True, [first]
        while reached:
            at = reached.pop()
            start, end = spans[at]
            token, reach = text[start:end], CONTEXT + MIN_TOKEN
            if token not in reported:
                if not meter.is_novel(_apart(token, text[max(0, start - reach) : start], text[end : end + reach]), token):
                    continue
                out.append((start, 3, end))
                reported.add(token)
            for step in (-1, 1):  # a reported token is a context for its neighbours
                k = at + step
                while 0 <= k < len(spans) and max(start - spans[k][1], spans[k][0] - end) <= CONTEXT:
                    if not seen[k]:
                        seen[k] = True
                        reached.append(k)
                    k += step
    return sorted(out)


def all_novel_spans(text: str, known: list[tuple[int, int, int]], meter: NoveltyMeter) -> list[tuple[int, int, int]]:
    """The novel spans, and outside the known spans every other place of their tokens, inside longer candidates too."""
    found = novel_spans(text, known, meter)
    if not found:
        return []
    tokens = {text[s:e] for s, _, e in found}
    lengths = sorted({len(t) for t in tokens}, reverse=True)
    whole = {(s, e) for s, _, e in found}
    bases = sorted((s, e) for s, _, e in known)
    out, base = [], 0
    for match in CANDIDATE.finditer(text):
        start, end = match.span()
        if (start, end) in whole:
            out.append((start, 3, end))
            continue
        while base < len(bases) and bases[base][1] <= start:
            base += 1
        k = start
        while k < end:
            size = next((n for n in lengths if k + n <= end and text[k : k + n] in tokens), 0)
            near = bases[base : base + 1 + end - start] if size else []
            if size and not any(s < k + size and k < e for s, e in near if s < end):
                out.append((k, 3, k + size))
            k += size or 1
    return out


def learned_words(docs: DataFrame, text_col: str = "text", most: int = LEARNED, least: int = LEARNED_LEAST) -> tuple[str, ...]:
    """The words found in the most distinct long tokens of all documents, commonest first: at most ``most``."""
    tokens = docs.select(F.explode(F.regexp_extract_all(text_col, F.lit(CANDIDATE.pattern), F.lit(0))).alias("token")).distinct()
    words = tokens.select(F.explode(F.array_distinct(F.regexp_extract_all("token", F.lit(WORD), F.lit(0)))).alias("word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("tokens")).where(F.col("tokens") >= least)
    return tuple(r["word"] for r in counted.orderBy(F.desc("tokens"), "word").limit(most).collect())


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans: one row per document; spans are structs of kind, start, end, by start, then kind as listed."""
    learned = learned_words(docs, text_col)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = NoveltyMeter(learned)
        for batch in text_groups(batches, "text"):
            rows = []
            for text in batch.column(1).to_pylist():
                found = base_spans(text or "")
                found = sorted(found + all_novel_spans(text or "", found, meter))
                rows.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(span))], ["doc_id", "spans"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(scan, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")
