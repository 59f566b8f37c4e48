"""Chunkers, stems, masks, extraction and the offline embedder: per text, in batches."""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fixed_chunks(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Windows of ``size`` characters; each ends at white space of its last fifth, if there is any."""
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size")
    out, at, n = [], 0, len(text)
    while at < n:
        end = min(n, at + size)
        if end < n:
            soft = max((i for i in range(end - 1, end - max(1, size // 5) - 1, -1) if i > at and text[i].isspace()), default=-1)
            if soft > at:
                end = soft + 1
        out.append((at, end))
        if end >= n:
            break
        at = max(end - overlap, at + 1)
    return out


def code_chunks(text: str, size: int) -> list[tuple[int, int]]:
    """Windows that end at a blank line or closing brace of their last two fifths, else at a line end."""
    out, at, n = [], 0, len(text)
    while at < n:
        end = min(n, at + size)
        if end < n:
            low = at + size * 3 // 5
            cut = max((text.rfind(m, low, end) + len(m) for m in ("\n\n", "\n}\n") if text.rfind(m, low, end) >= 0), default=0)
            cut = cut or (text.rfind("\n", at + 1, end) + 1)
            end = cut if cut > at else end
        out.append((at, end))
        at = end
    return out


def heading_paths(text: str) -> list[tuple[int, list[str]]]:
    """(offset, headings in force) from each heading of a markdown text on, code fences left out."""
    out, path, at, fence = [(0, [])], [], 0, False
    for line in text.split("\n"):
        if re.match(r"\s*(```|~~~)", line):
            fence = not fence
        m = None if fence else re.match(r"(#{1,6})\s+(.*?)\s*#*\s*$", line)
        if m:
            d = len(m.group(1))
            path = [p for p in path if p[0] < d] + [(d, m.group(2))]
            out.append((at, [p[1] for p in path]))
        at += len(line) + 1
    return out


def chunked(docs: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """(key, chunk_index, char_start, char_end, heading_path, content) of every text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, t in zip(f["key"], f["text"]):
                heads = heading_paths(t)
                for i, (a, b) in enumerate(fixed_chunks(t, size, overlap)):
                    rows.append((k, i, a, b, [h for o, h in heads if o <= a][-1], t[a:b]))
            yield pd.DataFrame(rows, columns=["key", "chunk_index", "char_start", "char_end", "heading_path", "content"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).filter(F.length("text") > 0).mapInPandas(
        run, "key bigint, chunk_index int, char_start int, char_end int, heading_path array<string>, content string")


def display_label(s: str) -> str:
    return unicodedata.normalize("NFKC", s).strip()


def mask_code(text: str) -> str:
    """The text with fenced and inline code blanked; every offset stays."""
    return re.sub(r"```.*?(?:```|\Z)|`[^`\n]+`", lambda m: re.sub(r"[^\n]", " ", m.group(0)), text, flags=re.S)


def line_diff(a: str, b: str) -> tuple[int, int]:
    """(lines added, lines removed) from a to b."""
    m = difflib.SequenceMatcher(None, a.split("\n"), b.split("\n"), autojunk=False).get_opcodes()
    changed = [x for x in m if x[0] != "equal"]
    return sum(j2 - j1 for _, _, _, j1, j2 in changed), sum(i2 - i1 for _, i1, i2, _, _ in changed)


_FNV, _PRIME, _MASK = 0xCBF29CE484222325, 0x100000001B3, (1 << 64) - 1


def mock_embedding(text: str, dims: int) -> list[float]:
    """A deterministic unit vector of a text: a hash of text and index per dimension. It means nothing."""
    h = _FNV
    for b in text.strip().encode():
        h = ((h ^ b) * _PRIME) & _MASK
    out = []
    for i in range(dims):
        g = h
        for b in i.to_bytes(8, "little"):
            g = ((g ^ b) * _PRIME) & _MASK
        out.append(g / _MASK * 2 - 1)
    v = np.array(out)
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


def _embed(frames: Iterator[pd.DataFrame], dims: int, provider) -> Iterator[pd.DataFrame]:
    for f in frames:
        got = [provider(t, dims) for t in f["text"]]
        if len(got) != len(f):
            raise ValueError("a provider must return one vector per text")
        yield pd.DataFrame({"key": f["key"], "embedding": got})


def embedded(docs: DataFrame, key: str, text: str, dims: int, provider=mock_embedding) -> DataFrame:
    """(key, embedding) by a pluggable provider ``(text, dims) -> list``."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInPandas(partial(_embed, dims=dims, provider=provider), "key bigint, embedding array<float>")


def _measure(w: str) -> int:
    """Number of vowel-consonant turns of a stem."""
    shape = "".join("v" if c in "aeiou" or c == "y" and i and w[i - 1] not in "aeiou" else "c" for i, c in enumerate(w))
    return len(re.findall("v+c", shape))


def _vowel(w: str) -> bool:
    return any(c in "aeiou" or c == "y" and i and w[i - 1] not in "aeiou" for i, c in enumerate(w))


def _short(w: str) -> bool:
    """Ends consonant, vowel, consonant other than w, x, y."""
    cons = lambda i: not (w[i] in "aeiou" or w[i] == "y" and i and w[i - 1] not in "aeiou")
    return len(w) >= 3 and cons(len(w) - 3) and not cons(len(w) - 2) and cons(len(w) - 1) and w[-1] not in "wxy"


#: fixed values: words that a stemmed index leaves out
STOPWORDS = """
a about above after again against all am an and any are as at be because been before being below between both but by can cannot could did do does
doing down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me
more most must my myself no nor not now of off on once only or other ought our ours ourselves out over own same she should so some such than that the
their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why
will with without would you your yours yourself yourselves
""".split()
#: fixed values: suffixes of the published stemmer's steps 2, 3 and 4
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent",
    "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def porter(w: str) -> str:
    """Stem of a lower-case ASCII word by the published algorithm."""
    if len(w) <= 2 or not (w.isascii() and w.isalpha()):
        return w
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((s for s in ("ed", "ing") if w.endswith(s) and _vowel(w[: -len(s)])), None)
        if cut:
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short(w):
                w += "e"
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        s = max((s for s in table if w.endswith(s)), key=len, default=None)
        if s and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + table[s]
    s = max((s for s in STEP4 if w.endswith(s)), key=len, default=None)
    if s and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w
