"""Sentence units of every document by a hidden-event language model.

Between words a boundary token may have been said without being written. The
model's n-grams are the words on the two sides of a gap, counted over
the whole corpus: what stands at the ends and starts of paragraphs and list
lines, where boundaries are certain, against what stands inside. Forward-backward over the
gaps of a paragraph gives each boundary's posterior, which decides.

Every gap between words is a gap of the model. Three kinds differ in what they show:

* Gaps with an end mark, with the quotes and brackets it closes: how far the word before the mark ends units is counted.
* Spaces between Thai letters: the share of them that ends a unit is fitted by expectation maximisation to what follows
  them, as a mixture of what starts paragraphs and what stands anywhere; the letters on both sides give the rest.
* Bare gaps. Where a paragraph has end marks or Thai spaces, a boundary at a bare gap has a prior of ``BARE``, which the
  words' evidence, at most ``MOST`` a side, can't make up for, so these gaps aren't walked. A paragraph without any mark, be it a comma or bracket, is walked gap by gap
  (between all letters in scripts without spaces), with the corpus' share of boundaries as the prior and a
  chain over the distance from the last boundary.

Structure is certain beforehand: blank lines, headings, list lines and lines of code.

Defined results: null, empty, blank or invisible texts give no units; repeated rows give repeated units;
an empty table gives no rows; extra columns are ignored; a text of any length is read whole, paragraph by paragraph.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.sources.tables import written

# fixed values: marks that may end a unit, by script; beyond ASCII those with Unicode's property Sentence_Terminal, as code points
TERMINAL = (
    "589 61D-61F 6D4 700-702 7F9 837 839 83D-83E 964-965 104A-104B 1362 1367-1368 166E 1735-1736 17D4-17D5 1803 1809 1944-1945 1AA8-1AAB "
    "1B4E-1B4F 1B5A-1B5B 1B5E-1B5F 1B7D-1B7F 1C3B-1C3C 1C7E-1C7F 2024 203C-203D 2047-2049 2CF9-2CFB 2E2E 2E3C 2E53-2E54 2E60-2E61 3002 A4FF "
    "A60E-A60F A6F3 A6F7 A876-A877 A8CE-A8CF A92F A9C8-A9C9 AA5D-AA5F AAF0-AAF1 ABEB FE12 FE15-FE16 FE52 FE56-FE57 FF01 FF0E FF1F FF61 "
    "10A56-10A57 10F55-10F59 10F86-10F89 11047-11048 110BE-110C1 11141-11143 111C5-111C6 111CD 111DE-111DF 11238-11239 1123B-1123C 112A9 "
    "113D4-113D5 1144B-1144C 115C2-115C3 115C9-115D7 11641-11642 1173C-1173E 11944 11946 11A42-11A43 11A9B-11A9C 11C41-11C42 11EF7-11EF8 "
    "11F43-11F44 16A6E-16A6F 16AF5 16B37-16B38 16B44 16D6E-16D6F 16E98 1BC9F 1DA88"
)
DOTS = ".․﹒．"  # may stand inside names and numbers
STRONG = "!?" + "".join(chr(i) for r in TERMINAL.split() for i in range(int(r.split("-")[0], 16), int(r.split("-")[-1], 16) + 1) if chr(i) not in DOTS)
ENDERS = STRONG + DOTS + "…"
ASKING = "!?‼‽⁇⁈⁉﹖﹗"
PAIRS = {"(": ")", "（": "）", "[": "]", "«": "»", "「": "」", "『": "』", "“": "”", "„": "“", "【": "】", "《": "》"}
QUOTES = set("«「『“„\"")
CLOSERS = set(PAIRS.values()) | {'"', "’", "'"}
MARKS = re.compile('["“”' + re.escape("".join(set(PAIRS) | set(PAIRS.values()))) + "]")
DIGIT = re.compile(r"\d")
INNER_CJK = re.compile(r"[、，](\w{1,2})")
AFTER = set(ENDERS) | set(PAIRS.values()) | {'"'}
ANY_RUN = re.compile(rf"[{ENDERS}]+")
END_RUN = re.compile(f"[{''.join(c for c in ENDERS if c <= chr(0xFFFF))}]+")  # several times as fast
BEYOND = re.compile(f"[{min(c for c in ENDERS if c > chr(0xFFFF))}-{max(ENDERS)}]")
LIST_LINE = re.compile(r"\s*(?:[-*+•·–—‣◦]|\(?\d{1,3}[.)]|[a-z][.)])[ \t]+\S")
WORD = re.compile(r"[^\W_]+(?:['’_.-][^\W_]+)*", re.U)
THAI_GAP = re.compile(r"(?<=[ก-ฺเ-๎])[ \t 　]+(?=[ก-ฺเ-๎])")
THAI = re.compile(r"[ก-ฺเ-๎]")
CHUNK = re.compile(r"\S+")
ANY_MARK = re.compile("[,;:、，；：،؛\"“”„‘" + re.escape("".join(set(PAIRS) | set(PAIRS.values()))) + "]|[" + "".join(c for c in ENDERS if c not in DOTS) + r"]|[.․﹒．](?!\w)")
BREAK = re.compile("\r\n|[\n\r\u0085\u2028\x0b\x0c]|\u2029")
EXOTIC = re.compile("[\r\u0085\u2028\u2029\x0b\x0c]")
COUNTS = ("start", "mid", "end", "inner", "right", "last", "any")
BARE, MOST = -12.0, 4.0  # log-odds
NEAR = (-5.0, -3.0, -1.5, 0.0)  # log-odds of a boundary so many words after another one
HIDDEN = {"Cc", "Cf", "Zs", "Zl", "Zp"}


class _Visible(dict):
    """Whether a character can be seen, worked out once for each."""

    def __missing__(self, c: str) -> bool:
        v = self[c] = "!" <= c <= "~" or not c.isspace() and unicodedata.category(c) not in HIDDEN
        return v


VISIBLE = _Visible()


def trim(text: str, a: int, b: int) -> tuple[int, int] | None:
    """Bounds of text[a:b] without invisible characters around it."""
    while a < b and not VISIBLE[text[a]]:
        a += 1
    while b > a and not VISIBLE[text[b - 1]]:
        b -= 1
    return (a, b) if a < b else None


def lines(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    if not EXOTIC.search(text):
        for line in text.split("\n"):
            out.append((at, at + len(line)))
            at += len(line) + 1
        return out
    for m in BREAK.finditer(text):
        out.append((at, m.start()))
        if m.group(0) == "\u2029":
            out.append((m.end(), m.end()))  # ends a paragraph
        at = m.end()
    out.append((at, len(text)))
    return out


def paragraphs(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of lines with something visible in them."""
    run: list[tuple[int, int]] = []
    for a, b in lines(text):
        if a < b and (VISIBLE[text[a]] or trim(text, a, b)):
            run.append((a, b))
        elif run:
            yield run
            run = []
    if run:
        yield run


class _Script(dict):
    """Script class of a character, worked out once for each."""

    def __missing__(self, c: str) -> str:
        o = ord(c)
        if 0x0E00 <= o < 0x0E80:
            v = "thai"
        elif 0x3040 <= o < 0x3100 or 0x3400 <= o < 0xA000 or 0xAC00 <= o < 0xD7B0 or 0x20000 <= o < 0x30000:
            v = "cjk"
        elif c.isdigit():
            v = "digit"
        elif c.isalpha():
            v = "upper" if c.isupper() else "lower" if c.islower() else "plain"
        else:
            v = "mark"
        self[c] = v
        return v


SCRIPT = _Script()


def right_token(text: str, at: int, end: int) -> tuple[str, str]:
    """(token, class) of what follows a place."""
    c = text[at]
    kind = SCRIPT[c]
    if kind == "cjk":
        return text[at:min(at + 2, end)], kind
    if kind == "thai":
        return text[at:min(at + 3, end)], kind
    m = WORD.match(text, at, min(end, at + 40))
    if not m:
        # an opening mark says what its first word says about case
        n = at + 1
        while n < end and not text[n].isalnum() and n < at + 4:
            n += 1
        return c, "mark" + (SCRIPT[text[n]] if n < end else "")
    w = m.group(0)[:16]
    if kind == "digit":
        return DIGIT.sub("9", w), kind
    if w.isalpha():
        return w, kind
    return w, "ident" if "_" in w or "." in w.rstrip(".") and kind == "lower" else kind


def left_token(text: str, lo: int, at: int, run: str) -> tuple[str, str]:
    """(token, class) of the word before an end mark that starts at ``at``."""
    if run[0] != "." or len(run) > 1:
        return run[0] + ("+" if len(run) > 1 else ""), "strong" if run[0] in STRONG else "dots"
    part = text[max(lo, at - 24):at]
    w = "" if not part or part[-1].isspace() else part.split()[-1].lstrip("([{«“„\"（「")
    if not w:
        return ".", "word."
    if w.isdigit():
        return DIGIT.sub("9", w) + ".", "number."
    if w.isalpha() and len(w) > 3:
        return w.lower() + ".", "word."
    if len(w) == 1 and w.isalpha():
        return (w if w.islower() or SCRIPT[w] == "plain" else "X") + ".", "letter."
    low = DIGIT.sub("9", w.lower())
    return low + ".", "short." if len(w) <= 3 and w.isalpha() else "word."


def spans(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Quotations and brackets of text[a:b] that close, outermost only."""
    stack: list[tuple[str, int]] = []
    out: list[tuple[int, int]] = []
    for m in MARKS.finditer(text, a, b):
        i, c = m.start(), m.group(0)
        if c == '"':
            if any(o == '"' for o, _ in stack):
                while stack:
                    o, s = stack.pop()
                    if o == '"':
                        out.append((s, i))
                        break
            else:
                stack.append((c, i))
        elif c == "“" and stack and stack[-1][0] == "„":
            out.append((stack.pop()[1], i))
        elif c in PAIRS:
            stack.append((c, i))
        else:
            for d in range(len(stack) - 1, -1, -1):
                if PAIRS.get(stack[d][0]) == c or c == "”" and stack[d][0] == "„":
                    out.append((stack[d][1], i))
                    del stack[d:]
                    break
    out.sort()
    outer: list[tuple[int, int]] = []
    for s, e in out:
        if not outer or s > outer[-1][1]:
            outer.append((s, e))
    return outer


class Place:
    """Where a unit may end: ``end`` of its last mark, start of what follows, and the model's evidence."""

    __slots__ = ("end", "next", "left", "right", "opened", "gap", "thai")

    def __init__(self, end, nxt, left, right, opened, gap, thai=False):
        self.end, self.next, self.left, self.right, self.opened, self.gap, self.thai = end, nxt, left, right, opened, gap, thai


def places(text: str, a: int, b: int) -> tuple[list[Place], tuple[str, str] | None]:
    """Possible boundaries inside text[a:b], and the left token of its end if that has an end mark."""
    outer = spans(text, a, b)
    starts = [s for s, _ in outer]
    out: list[Place] = []
    last = None
    done = a
    for m in (ANY_RUN if BEYOND.search(text, a, b) else END_RUN).finditer(text, a, b):
        s, e = m.span()
        if s < done:
            continue
        run = m.group(0)
        if run == "." and e < b and ("a" <= (c := text[e]) <= "z" or "0" <= c <= "9"):
            continue  # inside a name or a number
        if run != "." and run in DOTS and e < b and SCRIPT[text[e]] in ("lower", "digit"):
            continue  # the same in other widths
        opened, left = -1, None
        while True:
            k = bisect_right(starts, e - 1) - 1
            if k >= 0 and outer[k][0] < e <= outer[k][1]:
                close = outer[k][1]
                n = e
                while n < close and (text[n].isspace() or text[n] in CLOSERS or text[n] in ENDERS):
                    n += 1
                if n < close:
                    opened = -2  # inside a quotation or bracket
                    break
                opened, e = outer[k][0], close + 1
                continue
            n = e
            while n < b and (text[n] in ENDERS or text[n] in "'’" and n + 1 < b and not text[n + 1].isalnum()):
                n += 1
            if n > e:
                if text[e] in ENDERS and opened >= 0:
                    left = left_token(text, a, e, text[e:n])
                e = n
                continue
            break
        if opened == -2:
            continue
        done = e
        left = left or left_token(text, a, s, run)
        nxt = e
        while nxt < b and not VISIBLE[text[nxt]]:
            nxt += 1
        if nxt >= b:
            last = left
            continue
        gap = nxt > e
        right = right_token(text, nxt, b)
        if not gap and opened < 0 and m.group(0)[-1] in DOTS + "…":
            # inside a name or number unless a capital or a letter of a caseless script follows a word
            caseless = right[1] in ("cjk", "thai", "plain")
            before = text[s - 1] if s > a else " "
            capital = right[1] == "upper" and nxt + 1 < b and (text[nxt + 1].islower() or text[nxt + 1] in " ’'")
            marked = right[1] in ("markupper", "markcjk", "markplain", "markthai") and text[nxt] in "(（«“„\"「『¿¡"
            if not (before.isalnum() or before in ")]}»”\"" or not before.isascii()) or not (caseless or capital or marked):
                if not (m.group(0)[-1] == "…" and caseless):
                    continue
            if left[1] == "letter.":
                continue
        elif not gap and opened < 0 and m.group(0)[-1] in ASKING and right[1] in ("lower", "digit", "ident"):
            continue
        out.append(Place(e, nxt, left, right, opened, gap))
    for m in THAI_GAP.finditer(text, a, b) if THAI.search(text, a, b) else ():
        k = bisect_right(starts, m.start()) - 1
        if not (k >= 0 and outer[k][0] < m.start() < outer[k][1]):
            out.append(Place(m.start(), m.end(), last_token(text, a, m.start()), right_token(text, m.end(), b), -1, True, True))
    out.sort(key=lambda p: p.end)
    return out, last


class Gap:
    """A bare gap: where the text before it ends, where it goes on, and the tokens on both sides."""

    __slots__ = ("end", "next", "left", "right")

    def __init__(self, end, nxt, left, right):
        self.end, self.next, self.left, self.right = end, nxt, left, right


def last_token(text: str, lo: int, at: int) -> tuple[str, str]:
    """(token, class) of the word that ends at a place."""
    kind = SCRIPT[text[at - 1]]
    if kind in ("cjk", "thai"):
        return text[max(lo, at - (2 if kind == "cjk" else 3)):at], kind
    part = text[max(lo, at - 40):at].split()
    return right_token(part[-1], 0, len(part[-1])) if part else ("", "mark")


def gaps(text: str, a: int, b: int) -> list[Gap]:
    """The gaps of text[a:b]: white space, and places between letters of scripts without spaces."""
    out = []
    for m in CHUNK.finditer(text, a, b):
        s, e = m.span()
        if s > a:
            left = s
            while not VISIBLE[text[left - 1]]:
                left -= 1
            out.append(Gap(left, s, last_token(text, a, left), right_token(text, s, b)))
        if e - s > 1 and SCRIPT[text[s]] == "cjk":
            for i in range(s + 1, e):
                if SCRIPT[text[i]] == "cjk" and SCRIPT[text[i - 1]] == "cjk":
                    out.append(Gap(i, i, last_token(text, s, i), right_token(text, i, b)))
    return out


def is_heading(text: str, run: list[tuple[int, int]]) -> bool:
    """A paragraph of one line that is marked as a heading, or short and without an end mark."""
    if len(run) != 1:
        return False
    t = trim(text, *run[0])
    s = text[t[0]:t[1]]
    if re.match(r"#{1,6}\s", s):
        return True
    return len(s) <= 60 and s[-1] not in ENDERS and s[-1] not in CLOSERS and not any(SCRIPT[c] == "thai" for c in s[:3] if " " in s)


def blocks(text: str, code: bool) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whole) of what lies between certain boundaries; whole ones aren't divided further."""
    if code:
        for a, b in lines(text):
            yield a, b, True
        return
    for run in paragraphs(text):
        first = trim(text, *run[0])
        if is_heading(text, run):
            yield *run[0], True
        elif LIST_LINE.match(text[first[0]:run[0][1]]):
            # a line without a marker goes on with the item before it
            at = run[0][0]
            for (_, b), (c, d) in zip(run, run[1:]):
                if LIST_LINE.match(text[c:d]):
                    yield at, b, True
                    at = c
            yield at, run[-1][1], True
        else:
            yield run[0][0], run[-1][1], False


def letter_runs(texts: list[str]) -> dict[str, dict[str, int]]:
    """By script: how often each run of three Thai letters, or two of Chinese, Japanese or Korean, stands after another letter of its script."""
    code = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    thai = (code >= 0x0E01) & (code <= 0x0E3A) | (code >= 0x0E40) & (code <= 0x0E4E)
    cjk = (code >= 0x3040) & (code < 0x3100) | (code >= 0x3400) & (code < 0xA000) | (code >= 0xAC00) & (code < 0xD7B0)
    out = {}
    for script, own, width in (("thai", thai, 3), ("cjk", cjk, 2)):
        out[script] = {}
        n = len(code) - width
        if n < 1 or not own.any():
            continue
        at = np.flatnonzero(np.logical_and.reduce([own[i:n + i] for i in range(width + 1)])) + 1
        key = np.zeros(len(at), np.uint64)
        for i in range(width):
            key = (key << np.uint64(21)) | code[at + i]
        keys, counts = np.unique(key, return_counts=True)
        for k, c in zip(keys.tolist(), counts.tolist()):
            out[script]["".join(chr(k >> 21 * (width - 1 - i) & 0x1FFFFF) for i in range(width))] = c
    return out


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """n-gram counts of the places whose boundary is certain or impossible: (what, token, class, n)."""
    counts: Counter = Counter()
    inner: Counter = Counter()  # words inside units as they stand; read as tokens once each
    grams: dict = {"thai": Counter(), "cjk": Counter()}  # letters anywhere inside runs without spaces

    def flush():
        for script, own in grams.items():
            for w, n in own.items():
                counts["any", w, script] += n
            own.clear()
        for w, n in inner.items():
            counts["mid", *right_token(w, 0, len(w))] += n
        inner.clear()
        rows = [(w, t, c, n) for (w, t, c), n in counts.items()]
        counts.clear()
        return pd.DataFrame(rows, columns=["what", "token", "kind", "n"])

    for f in frames:
        prose = [t for t, k in zip(f["text"], f["kind"]) if k != "code"]
        for s in range(0, len(prose), 1_000):
            for script, own in letter_runs(prose[s:s + 1_000]).items():
                grams[script].update(own)
        for text, kind in zip(f["text"], f["kind"]):
            if kind == "code":
                continue
            for a, b, whole in blocks(text, False):
                t = trim(text, a, b)
                if not t:
                    continue
                a, b = t
                if whole:
                    m = LIST_LINE.match(text, a, b)
                    if not m:
                        continue
                    a = m.end() - 1
                here, last = places(text, a, b)
                if last:
                    counts["start", *right_token(text, a, b)] += 1
                    counts["end", *last] += 1
                    n = b
                    while n > a and (not VISIBLE[text[n - 1]] or text[n - 1] in AFTER):
                        n -= 1
                    if n > a:
                        counts["last", *last_token(text, a, n)] += 1
                elif not whole and SCRIPT[text[a]] == "thai" == SCRIPT[text[b - 1]]:
                    counts["start", *right_token(text, a, b)] += 1
                    counts["last", *last_token(text, a, b)] += 1
                for p in here:
                    if not p.thai:
                        counts["inner", *p.left] += 1
                    counts["right", *p.right] += 1
                words = text[a:b].split()
                # a word after an end mark or a closing mark may begin a unit; the others stand inside one
                inner.update([w[:24] for v, w in zip(words, words[1:]) if v[-1] not in AFTER])
                inner.update(INNER_CJK.findall(text, a, b))
        if len(counts) + len(inner) + sum(map(len, grams.values())) > 200_000:
            yield flush()
    yield flush()


class Model:
    """Hidden-event n-grams: log-odds of a boundary from the words on its two sides."""

    def __init__(self, rows: list[tuple[str, str, str, int]]):
        self.by: dict = {w: Counter() for w in COUNTS}
        self.of: dict = {w: Counter() for w in COUNTS}
        for what, token, kind, n in rows:
            if token:
                self.by[what][token] += n
            if kind:
                self.of[what][kind] += n
        self.total = {w: sum(c.values()) + 1.0 for w, c in self.of.items()}
        #: how often words that never stand at an edge or a place stand inside, on average; their own counts aren't kept
        self.typical = {"mid": 1.0, "any": 1.0}
        self.seen: dict = {}
        # share of all boundaries that end a paragraph, from the marks that always end a unit
        e, i = self.of["end"]["strong"], self.of["inner"]["strong"]
        self.share = min(0.95, max(0.05, (e + 1) / (e + i + 4)))
        words = sum(self.of["mid"].values()) + sum(self.of["right"].values())
        bounds = sum(self.of["start"].values()) + sum(self.of["inner"].values())
        p = min(0.3, max(0.02, (bounds + 5) / (words + bounds + 60)))
        self.bare = math.log(p / (1 - p))
        self.spaced = self._mixture("thai")

    def _mixture(self, kind: str) -> float:
        """Log-odds that a space between letters of a script without other spaces ends a unit, by expectation maximisation."""
        seen = [(n, *self._two(t, kind, "start", "any")) for t, n in self.by["right"].items() if t and SCRIPT[t[0]] == kind]
        share = 0.9
        for _ in range(30):
            share = (sum(n * share * s / (share * s + (1 - share) * m) for n, s, m in seen) + 9) / (sum(n for n, _, _ in seen) + 10)
        share = min(share, 0.9995)
        return math.log(share / (1 - share))

    def _two(self, token: str, kind: str, a: str, b: str) -> tuple[float, float]:
        """Probabilities of a token under two of the counts, backed off to the same spread over its class."""
        n = {w: self.by[w][token] for w in (a, b)}
        if not (n[b] or any(token in self.by[w] for w in ("right", "start", "last"))):
            n[b] = self.typical[b]
        return tuple((n[w] + 0.5) / (self.of[w][kind] + 0.5 * 400) for w in (a, b))

    def side(self, token: tuple[str, str], at: str) -> float:
        """Log-odds of a boundary from the word on one side of a gap; ``at``: start or last."""
        kind = token[1]
        p, q = self._two(token[0], kind, at, "any" if kind in ("cjk", "thai") else "mid")
        return max(-MOST, min(MOST, math.log(p / q)))

    def start_side(self, token: str, kind: str) -> float:
        return self.side((token, kind), "start")

    def last_side(self, token: str, kind: str) -> float:
        return self.side((token, kind), "last")

    def left(self, token: str, kind: str) -> float:
        ends, inner = self.by["end"][token], self.by["inner"][token]
        prior = {"strong": 0.97, "dots": 0.8, "number.": 0.3, "letter.": 0.03, "short.": 0.5}.get(kind, 0.93)
        weight = 2.0
        p = (min(ends / self.share, ends + inner) + weight * prior) / (ends + inner + weight)
        p = min(max(p, 0.0005), 0.995)
        return math.log(p / (1 - p))

    def right(self, token: str, kind: str) -> float:
        def logp(what: str) -> float:
            back = (self.of[what][kind] + 0.5) / (self.total[what] + 10)
            size = {"upper": 300, "lower": 300, "cjk": 500, "thai": 200, "plain": 300}.get(kind, 20)
            return math.log((self.by[what][token] + 4.0 * back / size * 10) / (self.total[what] + 40.0))

        x = max(-5.0, min(5.0, logp("start") - logp("mid")))
        seen = self.by["right"][token]
        if seen > 3:
            # as many boundaries before this word as its paragraph starts promise, of all places before it
            p = (self.by["start"][token] * (1 - self.share) / self.share + 0.2) / (seen + 0.4)
            p = min(max(p, 0.001), 0.98)
            x = 0.4 * x + math.log(p / (1 - p))
        return x

    def cached(self, of, side: str, token: tuple[str, str]) -> float:
        x = self.seen.get((side, token))
        if x is None:
            if len(self.seen) > 100_000:
                self.seen.clear()
            x = self.seen[side, token] = of(*token)
        return x

    def evidence(self, text: str, a: int, p: Place, prev: int) -> float:
        """Log-odds that a unit ends at a place; ``prev`` is where the possible unit before it ended."""
        if p.thai:
            return self.spaced + self.cached(self.start_side, "s", p.right) + self.cached(self.last_side, "e", p.left)
        x = self.cached(self.left, "l", p.left)
        if p.opened >= 0:
            x = min(x, 2.0)  # a mark inside what closes here ends less than one in the open
        x += self.cached(self.right, "r", p.right)
        if p.opened >= 0:
            before = p.opened
            while before > a and not VISIBLE[text[before - 1]]:
                before -= 1
            initial = before <= prev or before == a
            if text[p.opened] in QUOTES:
                # words after a quotation that opened the sentence say whose it is
                x += -9.0 if initial else 0.5
            elif initial:
                x += 4.0
        if p.right[1] == "lower":
            x -= 3.0
        return x


def posteriors(odds: list[float], close: list[bool]) -> list[float]:
    """Forward-backward over a chain of places; two boundaries with next to nothing between them are unlikely."""
    n = len(odds)
    if not any(close):  # nothing ties one place to the next
        return [1 / (1 + math.exp(-min(30.0, max(-30.0, x)))) for x in odds]
    emit = np.stack([np.zeros(n), np.clip(odds, -30, 30)], 1)
    pair = np.zeros((n, 2, 2))
    pair[np.asarray(close, bool), 1, 1] = -2.0
    f, g = np.zeros((n, 2)), np.zeros((n, 2))
    f[0] = emit[0]
    for i in range(1, n):
        x = f[i - 1][:, None] + pair[i]
        f[i] = emit[i] + np.logaddexp(x[0], x[1])
    for i in range(n - 2, -1, -1):
        x = pair[i + 1] + (emit[i + 1] + g[i + 1])[None, :]
        g[i] = np.logaddexp(x[:, 0], x[:, 1])
    s = f + g
    return list(1 / (1 + np.exp(np.clip(s[:, 0] - s[:, 1], -60, 60))))


def chain(odds: list[float], near: tuple[float, ...] = NEAR) -> list[float]:
    """Forward-backward over bare gaps: posterior of a boundary at each, where ``near`` weighs one so many gaps after another."""
    n, k = len(odds), len(near)
    x = np.clip(odds, -30, 30)
    pen = np.array(near)
    f, g = np.full((n + 1, k), -np.inf), np.zeros((n + 1, k))
    f[0, 0] = 0.0  # the paragraph's start is a boundary
    nxt = np.minimum(np.arange(k) + 1, k - 1)
    for i in range(n):
        f[i + 1, 0] = np.logaddexp.reduce(f[i] + x[i] + pen)
        for d in range(k):
            f[i + 1, nxt[d]] = np.logaddexp(f[i + 1, nxt[d]], f[i, d])
    for i in range(n - 1, -1, -1):
        g[i] = np.logaddexp(x[i] + pen + g[i + 1, 0], g[i + 1, nxt])
    total = np.logaddexp.reduce(f[n])
    return [float(np.exp(np.logaddexp.reduce(f[i] + x[i] + pen) + g[i + 1, 0] - total)) for i in range(n)]


def unmarked(text: str, a: int, b: int) -> bool:
    """Whether a paragraph shows no mark at all; in Thai, the spaces are the marks."""
    return not (ANY_MARK.search(text, a, b) or THAI.search(text, a, b))


def bare_units(text: str, a: int, b: int, model: Model, threshold: float) -> list[tuple[int, int]]:
    """Units of a paragraph without marks."""
    here = gaps(text, a, b)
    if not here:
        return [(a, b)]
    odds = [model.bare + model.cached(model.start_side, "s", g.right) + model.cached(model.last_side, "e", g.left) for g in here]
    out, at = [], a
    for g, y in zip(here, chain(odds)):
        if y >= threshold:
            out.append((at, g.end))
            at = g.next
    return [*out, (at, b)]


def units(text: str, code: bool, model: Model, threshold: float = 0.5) -> list[tuple[int, int]]:
    """(start, end) of every unit of a text."""
    out = []
    for a, b, whole in blocks(text, code):
        t = trim(text, a, b)
        if not t:
            continue
        if whole:
            out.append(t)
            continue
        a, b = t
        here, last = places(text, a, b)
        if not here:
            out += bare_units(text, a, b, model, threshold) if not last and unmarked(text, a, b) else [t]
            continue
        ends = [a, *(p.end for p in here)]
        odds = [model.evidence(text, a, p, ends[i]) for i, p in enumerate(here)]
        close = [p.end - ends[i] < 4 for i, p in enumerate(here)]
        said = posteriors(odds, close)
        at = a
        for p, y in zip(here, said):
            if y >= threshold:
                u = trim(text, at, p.end)
                if u:
                    out.append(u)
                at = p.end
        u = trim(text, at, b)
        if u:
            out.append(u)
    return out


def _split(frames: Iterator[pd.DataFrame], model: Model) -> Iterator[pd.DataFrame]:
    for f in frames:
        for s in range(0, len(f), 500):
            own = f.iloc[s:s + 500]
            rows = []
            for key, text, kind, rare in zip(own["key"], own["text"], own["kind"], own["rare"]):
                rare = () if rare is None else [(r["token"], [(w, r[w]) for w in COUNTS if r[w]]) for r in rare]
                for token, counts in rare:
                    for what, n in counts:
                        model.by[what][token] = n
                rows += [(key, a, b) for a, b in units(text, kind == "code", model)]
                for token, counts in rare:
                    for what, _ in counts:
                        del model.by[what][token]
            yield pd.DataFrame(rows, columns=["key", "start_char", "end_char"])


def _unnamed(frames: Iterator[pd.DataFrame], named: dict[str, set[str]]) -> Iterator[pd.DataFrame]:
    """(digest, side, token) of the tokens around each text's places that the model doesn't hold by name."""
    for f in frames:
        rows = set()
        for digest, text, kind in zip(f["digest"], f["text"], f["kind"]):
            for a, b, whole in blocks(text, kind == "code"):
                t = None if whole else trim(text, a, b)
                here, last = places(text, *t) if t else ((), None)
                bare = gaps(text, *t) if t and not here and not last and unmarked(text, *t) else ()
                sides = [x for p in here for x in (("r" if p.thai else "l", p.left[0]), ("r", p.right[0]))] + [("r", x[0]) for g in bare for x in (g.left, g.right)]
                rows |= {(digest, side, token) for side, token in sides if token not in named[side]}
        yield pd.DataFrame(list(rows), columns=["digest", "side", "token"])


def fit(df: DataFrame, text: str, kind: str, vocabulary: int = 100_000) -> tuple[Model, DataFrame | None]:
    """Counts the n-grams of all texts: (model, rare).

    The ``vocabulary`` most frequent tokens of each side are in the model by name, with
    whole counts; if there are more, ``rare`` has the counts of the others (side, token, and a column for each count).
    """
    counts = written(
        df.select(F.col(text).alias("text"), F.coalesce(F.col(kind), F.lit("")).alias("kind")).filter(F.length("text") > 0)
        .mapInPandas(_count, "what string, token string, kind string, n bigint")
        .groupBy("what", "token", "kind").agg(F.sum("n").alias("n")), "counts")
    rows = [(r.what, "", r.kind, r.n) for r in counts.groupBy("what", "kind").agg(F.sum("n").alias("n")).collect()]
    side = F.when(F.col("what").isin("end", "inner"), "l").otherwise("r").alias("side")
    tokens = counts.groupBy(side, "token").agg(*[F.coalesce(F.sum(F.when(F.col("what") == w, F.col("n"))), F.lit(0)).alias(w) for w in COUNTS])
    # words that never stand at an edge or a place are told apart by nothing but how often they stand inside: the mean does for them
    n = F.when(F.col("side") == "l", F.col("inner")).otherwise(F.col("right") + F.col("start") + F.col("last"))
    tokens = written(tokens.withColumn("n", n), "tokens")
    rest = tokens.filter("n = 0 and side = 'r'").agg(*[F.avg(F.when(F.col(w) > 0, F.col(w))).alias(w) for w in ("mid", "any")]).first()
    tokens = tokens.filter("n > 0")
    named, more = {}, False
    for s in "lr":
        top = tokens.filter(F.col("side") == s).orderBy(F.desc("n"), "token").limit(vocabulary + 1).collect()
        more |= len(top) > vocabulary
        named[s] = {r.token for r in top[:vocabulary]}
        rows += [(w, r.token, "", r[w]) for r in top[:vocabulary] for w in COUNTS if r[w]]
    model = Model(rows)
    model.typical = {w: rest[w] or 1.0 for w in ("mid", "any")}
    if not more:
        return model, None
    spark = df.sparkSession
    held = written(spark.createDataFrame([(s, w) for s in "lr" for w in named[s]], "side string, token string"), "named")
    return model, tokens.join(held, ["side", "token"], "left_anti").select("side", "token", *COUNTS)


def sentence_units(df: DataFrame, key: str, text: str, kind: str, vocabulary: int = 100_000) -> DataFrame:
    """(key, start_char, end_char) of every unit of every text; ``kind`` is ``code`` for texts read by line."""
    model, rare = fit(df, text, kind, vocabulary)
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.coalesce(F.col(kind), F.lit("")).alias("kind")).filter(F.length("text") > 0)
    if rare is None:
        rows = rows.withColumn("rare", F.lit(None).cast("string"))
    else:
        # the counts of a text's rare tokens come to it by a join; equal texts have the same ones
        named = {"l": set(model.by["inner"]), "r": set().union(*(model.by[w] for w in ("right", "start", "last")))}
        rows = rows.withColumn("digest", F.sha2("text", 256))
        found = rows.select("digest", "text", "kind").mapInPandas(partial(_unnamed, named=named), "digest string, side string, token string").distinct()
        own = found.join(rare, ["side", "token"]).groupBy("digest").agg(F.collect_list(F.struct("token", *COUNTS)).alias("rare"))
        rows = rows.join(own, "digest", "left").select("key", "text", "kind", "rare")
    return rows.mapInPandas(partial(_split, model=model), "key bigint, start_char bigint, end_char bigint")
