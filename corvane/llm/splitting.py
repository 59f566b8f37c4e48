"""Cutting oversized items at natural boundaries.

Agglomerative: an item falls into atomic segments (sentences; clauses, words or
bare stretches only where a sentence alone is too long). Adjacent pairs wait in
a heap, the weakest boundary first, and merge while the combined size plus the
overlap fits the limit. What is left are the pieces, each
starting ``overlap`` characters before the end of the previous one.

Sizes are code points. Defined results: an item within its limit is one piece;
null or empty items give none; an overlap of the limit or more counts as one
less than the limit; a limit that is null or below one drops the item; forced cuts keep combining
marks with their letter; repeated rows give repeated rows; an empty table gives
no rows.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.sources.tables import load

#: Boundary strengths, weakest first. A place has the strength of the strongest mark that ends there.
FORCED, SPACE, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(6)
NAMES = ("forced", "space", "clause", "sentence", "line", "paragraph")
CLOSERS = "\"'”’»«)\\]}」』】）〉》"
BREAKS = (
    (PARAGRAPH, re.compile(r"\r?\n[ \t]*(?:\r?\n[ \t]*)+|\f+\s*| +")),
    (LINE, re.compile(r"\r\n|\n|\r| |\u0085")),
    (SENTENCE, re.compile(rf"(?:[.!?…؟।]+[{CLOSERS}]*\s+)|(?:[。！？]+[{CLOSERS}]*\s*)")),
    (CLAUSE, re.compile(rf"[,;:،؛]+[{CLOSERS}]*\s+|[，、；：]+[{CLOSERS}]*\s*|[.!?…,;:؟।،](?=\S)")),
    (SPACE, re.compile(r"\s+")),
)
#: fixed values: what ends a stretch without natural boundary
BOUNDARY = re.compile(r"[\s.!?…。！？।؟,;:，、；：،]+")


def _refine(text: str, lo: int, hi: int, level: int) -> list[tuple[int, int]]:
    """(end, strength of the end) of the parts of text[lo:hi] at one level; the last one's strength is left 0."""
    strength, pattern = BREAKS[level]
    ends = [(m.end(), strength) for m in pattern.finditer(text, lo, hi) if lo < m.end() < hi]
    return [*ends, (hi, -1)]


def _atoms(text: str, cap: int) -> tuple[list[tuple[int, int, int]], int]:
    """(start, end, strength of the boundary after it) of the atomic segments, and the longest stretch of them without natural boundary.

    The stretch is measured where no boundary was found in more than ``cap`` characters; shorter ones count as 0.
    """
    spans = [(0, len(text), PARAGRAPH)]
    for level in range(len(BREAKS)):
        finer = []
        for lo, hi, after in spans:
            # sentences are atoms; below them only what is too long is divided
            if level > 2 and hi - lo <= cap:
                finer.append((lo, hi, after))
                continue
            at = lo
            for end, strength in _refine(text, lo, hi, level):
                finer.append((at, end, after if strength < 0 else strength))
                at = end
        spans = finer
    out, longest = [], 0
    for lo, hi, after in spans:
        if hi - lo > cap:
            # what closes the segment (marks, quotes, white space) is no part of the stretch
            longest = max(longest, *map(len, BOUNDARY.split(text[lo:hi])))
        while hi - lo > cap:
            end = lo + cap
            while end > lo + max(1, cap // 2) and unicodedata.combining(text[end]):
                end -= 1
            out.append((lo, end, FORCED))
            lo = end
        out.append((lo, hi, after))
    return out, longest


def cut_points(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, kind of the cut before it) of the pieces; the first one's kind is ``start``."""
    return pieces_of(text, limit, overlap)[0]


def pieces_of(text: str, limit: int, overlap: int) -> tuple[list[tuple[int, int, str]], bool]:
    """The pieces as of ``cut_points``, and whether an atomic segment held a stretch longer than the limit without natural boundary."""
    if len(text) <= limit:
        return [(0, len(text), "start")] if text else [], False
    overlap = max(0, min(overlap, limit - 1))
    cap = limit - overlap
    atoms, longest = _atoms(text, cap)
    # the first piece must hold an overlap for the second one to share
    while len(atoms) > 1 and atoms[0][1] < overlap:
        atoms[:2] = [(0, atoms[1][1], atoms[1][2])]
    start = [a[0] for a in atoms]
    end = [a[1] for a in atoms]
    after = [a[2] for a in atoms]
    n = len(atoms)
    nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(after[i], end[i + 1] - start[i], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, size, a, b = heapq.heappop(heap)
        # an entry is stale if either side has grown or gone since
        if not (alive[a] and b < n and alive[b] and nxt[a] == b and end[b] - start[a] == size):
            continue
        if size > (limit if start[a] == 0 else cap):
            continue
        end[a], after[a], alive[b], nxt[a] = end[b], after[b], False, nxt[b]
        if nxt[a] < n:
            prv[nxt[a]] = a
            heapq.heappush(heap, (after[a], end[nxt[a]] - start[a], a, nxt[a]))
        if prv[a] >= 0:
            heapq.heappush(heap, (after[prv[a]], end[a] - start[prv[a]], prv[a], a))
    out, kind = [], "start"
    for i in range(n):
        if alive[i]:
            out.append((max(0, start[i] - overlap) if out else 0, end[i], kind))
            kind = NAMES[after[i]]
    return out, longest > limit


def _cut(frames: Iterator[pd.DataFrame], content: bool) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for key, text, limit, overlap in zip(f["key"], f["item"], f["limit"], f["overlap"]):
            pieces, forced = pieces_of(text, int(limit), int(overlap))
            rows.extend((key, i, a, b, kind, forced, text[a:b] if content else None) for i, (a, b, kind) in enumerate(pieces))
        yield pd.DataFrame(rows, columns=["key", "piece", "start_char", "end_char", "cut", "has_stretch", "content"])


def split_oversized(items: DataFrame, key: str, item: str, limit: str, overlap: str, only_oversized: bool = False, content: bool = True) -> DataFrame:
    """(key, piece, start_char, end_char, cut, has_stretch, content) of every piece.

    ``has_stretch``: an atomic segment of the item held a stretch longer than the limit without any natural boundary.
    Only oversized items go through Python. Without ``content`` the column is null and the pieces are given by their bounds.
    """
    rows = items.select(
        F.col(key).cast("long").alias("key"), F.col(item).alias("item"), F.col(limit).cast("long").alias("limit"),
        F.coalesce(F.col(overlap), F.lit(0)).cast("long").alias("overlap"),
    ).filter((F.col("item") != "") & (F.col("limit") >= 1))
    big = rows.filter(F.length("item") > F.col("limit")).mapInPandas(
        partial(_cut, content=content), "key bigint, piece int, start_char int, end_char int, cut string, has_stretch boolean, content string"
    )
    if only_oversized:
        return big
    small = rows.filter(F.length("item") <= F.col("limit")).select(
        "key", F.lit(0).alias("piece"), F.lit(0).alias("start_char"), F.length("item").alias("end_char"), F.lit("start").alias("cut"),
        F.lit(False).alias("has_stretch"), (F.col("item") if content else F.lit(None).cast("string")).alias("content"),
    )
    return big.unionByName(small)


def canonical(path: Column) -> Column:
    """A path without prefix, white space around it, doubled or reversed separators and relative steps."""
    t = F.regexp_replace(path, r"(?U)^\s+|\s+$", "")
    t = F.replace(F.regexp_replace(t, r"(?i)^[a-z][a-z0-9+.\-]+://", ""), F.lit("\\"), F.lit("/"))
    steps = F.filter(F.split(t, "/"), lambda x: (x != "") & (x != "."))
    up = F.aggregate(
        steps, F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
    )
    return F.concat(F.lit("/"), F.array_join(up, "/"))


def requested_items(spark, d: str) -> DataFrame:
    """(request_id, item, limit, overlap): the text of a call, or what the file it names holds, under its wing's profile."""
    calls = load(spark, d, "ingest_requests").select("request_id", "tool", "text", "path", "wing")
    texts = calls.filter(F.col("tool").isin("ingest_text", "ingest_raw")).select("request_id", "wing", F.col("text").alias("item"))
    blobs = load(spark, d, "code_index_source_blobs").select(F.col("canonical_path").alias("p"), F.col("content").alias("item"))
    files = (
        calls.filter((F.col("tool") == "ingest_file") & F.col("path").isNotNull())
        .select("request_id", "wing", canonical(F.col("path")).alias("p"))
        .join(blobs, "p").select("request_id", "wing", "item")
    )
    # the profiles are a handful of configured rows
    profiles = load(spark, d, "chunk_profiles").groupBy(F.lower(F.trim("wing")).alias("w")).agg(
        F.max(F.struct("chunk_size", "chunk_overlap")).alias("c"))
    both = texts.unionByName(files).withColumn("w", F.lower(F.regexp_replace("wing", r"(?U)^\s+|\s+$", "")))
    got = both.join(profiles, "w", "left")
    use = F.coalesce("c", profiles.filter("w = '*'").select("c").scalar())
    return got.select("request_id", "item", use["chunk_size"].alias("limit"), use["chunk_overlap"].alias("overlap"))
