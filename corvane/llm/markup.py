"""Markup in texts: a recurrent block labeller and clean text.

A text is a sequence of leaf blocks. Each block gets a vector of hashed words,
hashed runs of marks and its path of open constructs; a bidirectional LSTM in numpy
reads the whole sequence and gives every block its role (heading, list, table,
code, formula, quote, paragraph, nothing) and the probability of each kind of
markup. The network names the kinds of a text; only what it names is then checked
against the exact form of that kind, which removes what merely looks like it.

The network is trained here, on a bounded sample: texts with constructs of known kind planted into them by
a grammar, look-alikes planted as examples of what isn't markup, and texts as they come, labelled by form.

Defined results: null, empty and blank texts give no rows; what stands inside
code or verbatim blocks is content; repeated rows give repeated rows of one id
once; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import partial
from html.entities import html5

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("html", "markdown", "wiki", "latex")
ROLES = ("paragraph", "heading", "list", "table", "code", "formula", "quote", "nothing")

# fixed values: the element names of HTML
ELEMENTS = (
    "a abbr address area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup "
    "data datalist dd del details dfn dialog div dl dt em embed fieldset figcaption figure font footer form frame h1 h2 h3 h4 h5 h6 head "
    "header hr html i iframe img input ins kbd label legend li link main map mark menu meta nav noscript object ol optgroup option output "
    "p param picture pre progress q s samp script section select small source span strike strong style sub summary sup svg table tbody td "
    "template textarea tfoot th thead time title tr tt u ul var video wbr"
)
_NAMES = "|".join(sorted(ELEMENTS.split(), key=len, reverse=True))
_ENTITIES = "|".join(sorted({e[:-1] for e in html5 if e.endswith(";")}, key=len, reverse=True))

TAG = re.compile(rf"</?(?:{_NAMES})(?=[\s/>])[^<>]*>|<(?:{_NAMES})\s+[a-z-]+\s*=\s*[^<>\n]*(?=\n|$)|</(?:{_NAMES})(?=\s|$)", re.I)
COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!doctype[^>]*>|<!\[CDATA\[.*?\]\]>", re.I | re.S)
REFERENCE = re.compile(rf"&(?:#\d{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|{_ENTITIES});")

FENCE = re.compile(r"^[ \t]{0,8}(?:[-*+] |\d+[.)] |> ?)*(`{3,}|~{3,})[^`\n]*$")
VERBATIM = (
    ("html", re.compile(r"<(pre|code|script|style|textarea|xmp)\b[^<>]*>(.*?)(?:</\1\s*>|\Z)", re.I | re.S)),
    ("latex", re.compile(r"\\begin\{(verbatim\*?|lstlisting|minted|Verbatim)\}(.*?)(?:\\end\{\1\}|\Z)", re.S)),
    ("wiki", re.compile(r"<(nowiki|syntaxhighlight|source)\b[^<>]*>(.*?)</\1\s*>", re.I | re.S)),
)
CODE_SPAN = re.compile(r"(?<![`\\])(`{1,2})(?!`)(?=\S)([^`\n]*[^`\s])\1(?!`)")

DISPLAY = re.compile(r"\$\$(?=[^$]*[\\^_={])[^$]+\$\$|\\\[.+?\\\]|\\\(.+?\\\)|\\begin\{((?:equation|align|gather|multline|displaymath|eqnarray|math)\*?)\}.*?(?:\\end\{\1\}|\Z)", re.S)
INLINE_MATH = re.compile(r"(?<![\\$\w])\$(?=\S)(?=[^$\n]*[\\^_={}<>+\-*/(]|[A-Za-z]\$)([^$\n]*[^\s$\\])\$(?![\w$])")
COMMAND = re.compile(
    r"\\(?:begin|end)\s*\{[A-Za-z]+\*?\}|\\[A-Za-z]{2,}\*?(?:\[[^\]\n]*\])?\{|\\(?:item|maketitle|tableofcontents|newpage|noindent|centering|ldots|LaTeX|hline)\b"
)

MD_HEADING = re.compile(r"(?m)^[ ]{0,3}#{1,6}[ \t]+\S.*$|^[ ]{0,3}(?=[^\s|>#=*+-])[^\n]+\n[ ]{0,3}=={2,}[ \t]*$")
MD_DASHED = re.compile(r"(?m)(?:\A|\n[ \t]*\n)[ ]{0,3}(?=[^\s|>#=*+:-])[^\n:]+\n[ ]{0,3}-{3,}[ \t]*$")
MD_LINK = re.compile(r"!?\[[^\[\]\n]*\]\((?:<[^<>\n]+>|[^()\s]*[./#:][^()\s]*)(?:\s+[\"'(][^)\n]*)?\)|(?m:^[ ]{0,3}\[[^\]\n]+\]:[ \t]*\S*[./]\S*)")
MD_TABLE = re.compile(r"(?m)^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$|^[ \t]*\|[ \t]*:?-{2,}:?[ \t]*\|[ \t]*$")
MD_QUOTE = re.compile(r"(?m)^[ ]{0,3}>+[ \t]?\S")
_IN = r"[^\s*_~.,;:)\]}/\\|]"
MD_STRONG = re.compile(
    rf"(?<![\w*\\])\*{{1,3}}(?={_IN})[^*\n]*(?:\n(?!\s*\n)[^*\n]*)?(?<=[^\s*(\[{{/])\*{{1,3}}(?![A-Za-z0-9*])"
    r"|(?<![\w\\])_{1,3}(?=[^\s_.,;:)])[^\n]*?(?<=[^\s_(])_{1,3}(?!\w|\.[A-Za-z])"
    r"|(?<![~\w\\])~~(?=[^\s~])[^~\n]*[^\s~]~~(?!~)"
)
WK_LINK = re.compile(r"(?<![\w\[])\[\[(?=[^\s\[\]])[^\[\]]{0,400}?\]\](?!\])|(?<=[^\x00-\x7f])\[\[(?=[^\s\[\]])[^\[\]\n]+\]\]")
WK_TEMPLATE = re.compile(r"\{\{\s*[\w#:][^{}]*(?:\{\{[^{}]*\}\}[^{}]*)*\}\}")
WK_EMPHASIS = re.compile(r"(?<![A-Za-z0-9'])'{2,5}(?=[^\s'])[^'\n]*(?:'(?!')[^'\n]*)*(?<=[^\s'])'{2,5}(?![A-Za-z0-9'])")
WK_HEADING = re.compile(r"(?m)^[ \t]*(={1,6})[ \t]*[^=\s][^\n]*?[ \t]*(?<!=)\1[ \t]*$")
WK_TABLE = re.compile(r"(?m)^[ \t:]*\{\|(?!\|)|^[ \t]*\|\}[ \t]*$")


def _blank(text: str, a: int, b: int) -> str:
    return text[:a] + re.sub(r"[^\n]", " ", text[a:b]) + text[b:]


def mask(text: str) -> tuple[str, list[tuple[int, str]], list[tuple[int, int, str]]]:
    """The text with the insides of code and formulas blanked, (position, kind) of their marks, and their spans.

    A pattern is tried only on texts that hold the characters it needs.
    """
    out = text
    marks: list[tuple[int, str]] = []
    spans: list[tuple[int, int, str]] = []
    if "```" in text or "~~~" in text:
        at, opened = 0, None
        for line in text.split("\n"):
            m = FENCE.match(line)
            end = at + len(line)
            if opened is None and m:
                opened = (m.group(1), at)
                marks.append((at, "markdown"))
                out = _blank(out, at, end)
            elif opened is not None:
                if m and m.group(1)[0] == opened[0][0] and len(m.group(1)) >= len(opened[0]) and line.strip(" >\t\r").strip(m.group(1)[0]) == "":
                    spans.append((opened[1], end, "code"))
                    opened = None
                out = _blank(out, at, end)
            at = end + 1
        if opened is not None:
            spans.append((opened[1], len(text), "code"))
    for (kind, pattern), need in zip(VERBATIM, ("<", "\\begin{", "<")):
        if need not in out:
            continue
        for m in pattern.finditer(out):
            marks.append((m.start(), kind))
            spans.append((m.start(), m.end(), "nothing" if m.group(1).lower() in ("script", "style") else "code"))
            out = _blank(out, *m.span(2))
    if "`" in out:
        for m in CODE_SPAN.finditer(out):
            marks.append((m.start(), "markdown"))
            out = _blank(out, *m.span())
    for pattern, needs in ((DISPLAY, ("$$", "\\[", "\\(", "\\begin{")), (INLINE_MATH, ("$",))):
        if any(n in out for n in needs):
            for m in pattern.finditer(out):
                marks.append((m.start(), "latex"))
                if pattern is DISPLAY:
                    spans.append((m.start(), m.end(), "formula"))
                out = _blank(out, *m.span())
    return out, marks, spans


#: by kind: exact forms, each with characters it can't do without
FORMS = {
    "latex": ((COMMAND, ("\\",)),),
    "wiki": ((WK_TEMPLATE, ("{{",)), (WK_LINK, ("[[",)), (WK_EMPHASIS, ("''",)), (WK_HEADING, ("=",)), (WK_TABLE, ("{|", "|}"))),
    "markdown": ((MD_HEADING, ("#", "==")), (MD_DASHED, ("---",)), (MD_LINK, ("](", "]:")), (MD_TABLE, ("--",)), (MD_QUOTE, (">",)), (MD_STRONG, ("*", "_", "~~"))),
}


def constructs(masked: str, kinds=KINDS) -> Iterator[tuple[int, str]]:
    """(position, kind) of every construct of a masked text, of the given kinds."""
    rest = masked
    for pattern, needs in ((COMMENT, ("<!",)), (TAG, ("<",)), (REFERENCE, ("&",))):
        if not any(n in rest for n in needs):
            continue
        if pattern is REFERENCE:
            if "html" in kinds:
                for m in pattern.finditer(rest):
                    yield m.start(), "html"
            continue
        found = [m.span() for m in pattern.finditer(rest)]
        if "html" in kinds:
            yield from ((a, "html") for a, _ in found)
        for a, b in found:
            rest = _blank(rest, a, b)
    for kind, forms in FORMS.items():
        if kind in kinds:
            for pattern, needs in forms:
                if any(n in rest for n in needs):
                    for m in pattern.finditer(rest):
                        yield m.start() + (len(m.group(0)) - len(m.group(0).lstrip("\n"))), kind


GAP = re.compile(r"\n[ \t]*\n\s*")
BLOCK_TAG = re.compile(r"(?i)(?=<(?:p|h[1-6]|li|ul|ol|table|tr|pre|div|blockquote|title|script|style)\b)")


def blocks(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Leaf blocks: parted by blank lines and block elements, headings apart, code and formulas whole."""
    cuts = {0, len(text)}
    inside = [(a, b) for a, b, _ in spans]
    cuts.update(m.end() for m in GAP.finditer(text))
    cuts.update(m.start() for m in BLOCK_TAG.finditer(text))
    cuts.update(m.start() for m in re.finditer(r"(?m)^(?:#{1,6} |={2,6}[^=\n]+=+\s*$|\\(?:sub)*section|\\paragraph|\\begin|\\item|\{\||\{\{)", text))
    cuts.update(m.end() + 1 for m in re.finditer(r"(?m)^(?:#{1,6} .*|={2,6}[^=\n]+=+[ \t]*|\|\}|\}\}|\\end\{[^}]*\})$", text) if m.end() < len(text))
    for a, b in inside:
        cuts = {c for c in cuts if not a < c < b} | {a, b}
    at = sorted(cuts)
    return [(a, b) for a, b in zip(at, at[1:]) if text[a:b].strip()]


def role(raw: str, masked: str, span: str | None) -> str:
    """Role of a block by its form, which is what the labeller learns from."""
    t = raw.strip()
    if span:
        return span
    low = t.lower()
    if re.match(r"(?s)---\n.*?\n---$", t) or re.match(r"(?is)<(?:head|!doctype|title)", low) or re.match(r"\\(?:documentclass|usepackage|begin|end|maketitle|label)\b", t) and "\n" not in t:
        return "nothing"
    if MD_HEADING.match(t) or WK_HEADING.match(t) or re.match(r"(?i)<h[1-6]\b", t) or re.match(r"\\(?:(?:sub)*section|paragraph|chapter)\*?\{", t):
        return "heading"
    if MD_TABLE.search(masked) or WK_TABLE.search(masked) or re.match(r"(?i)<t(?:able|r|d|h)\b", t) or "\\begin{tabular}" in t:
        return "table"
    if re.match(r"(?i)(?:[-*+•] |\d+[.)] |<(?:ul|ol|li)\b|\\item\b|[*#;:]+ )", t):
        return "list"
    if t.startswith(">") or re.match(r"(?i)<blockquote", t):
        return "quote"
    if not re.sub(rf"(?i)</?(?:{_NAMES})\b[^<>]*>", "", t).strip() or t.startswith("{{") and t.endswith("}}"):
        return "nothing"
    return "paragraph"


MARKED_AT, WORD_AT, PATH_AT, DIMS = 640, 1_152, 1_280, 1_408  # where hashed runs of marks end, words after a mark, other words, paths
_CLASS = np.zeros(129, np.int64)  # 0: beyond ASCII; 1 lower, 2 upper, 3 digit, 4 space, 5 line break; marks have a class each
for _c in range(128):
    _CLASS[_c] = 1 if 97 <= _c <= 122 else 2 if 65 <= _c <= 90 else 3 if 48 <= _c <= 57 else 5 if _c == 10 else 4 if _c <= 32 or _c == 127 else 6 + _c
_POWERS = np.array([pow(31, i, 1 << 32) for i in range(16)], np.uint64)


def _mix(key: np.ndarray, below: int) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(below)


def features(blocks_: list[str], paths: list[str]) -> np.ndarray:
    """A row for each block: hashed runs of marks with the shapes around them, hashed words with the mark before them, the path of open constructs."""
    n = len(blocks_)
    if not n:
        return np.zeros((0, DIMS), np.float32)
    code = np.frombuffer("\n".join(blocks_).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(b) for b in blocks_]) + 1
    sizes[-1] -= 1
    block = np.repeat(np.arange(n), sizes)
    cls = _CLASS[np.minimum(code, 128)]
    # runs of letters, digits or spaces count as one; what is left is the pattern of marks
    keep = np.r_[True, (cls[1:] != cls[:-1]) | (cls[1:] > 5)] if len(cls) else np.zeros(0, bool)
    c, own = cls[keep], block[keep]
    flat = []
    for width, lo, hi in ((3, 0, 256), (5, 256, MARKED_AT)):
        if len(c) < width:
            continue
        key = np.zeros(len(c) - width + 1, np.uint64)
        mark = np.zeros(len(key), bool)
        for i in range(width):
            part = c[i:len(c) - width + 1 + i]
            key = key * np.uint64(211) + part.astype(np.uint64)
            mark |= part > 4
        mark &= own[:len(key)] == own[width - 1:]
        flat.append(own[:len(key)][mark] * DIMS + lo + _mix(key[mark], hi - lo).astype(np.int64))
    letter = (cls == 1) | (cls == 2) | (cls == 0)
    start = np.flatnonzero(letter & ~np.r_[False, letter[:-1]])
    if len(start):
        at = np.arange(len(code))
        since = at - np.maximum.accumulate(np.where(letter & ~np.r_[False, letter[:-1]], at, 0))
        value = np.where(letter, (code | 32).astype(np.uint64) * _POWERS[np.minimum(since, 15)], np.uint64(0))
        word = np.add.reduceat(value, start)  # what follows a word up to the next one counts nothing
        before = np.where(start > 0, cls[np.maximum(start - 1, 0)], 5).astype(np.uint64)
        after = np.where(before < 6, np.uint64(0), before)
        h = _mix(word * np.uint64(257) + after, 1 << 16).astype(np.int64)
        at = np.where(after > 0, MARKED_AT + h % (WORD_AT - MARKED_AT), WORD_AT + h % (PATH_AT - WORD_AT))
        flat.append(block[start] * DIMS + at)
    v = np.bincount(np.concatenate(flat), minlength=n * DIMS).astype(np.float32).reshape(n, DIMS) if flat else np.zeros((n, DIMS), np.float32)
    for i, (raw, path) in enumerate(zip(blocks_, paths)):
        for key in ("path:" + path, "start:" + raw[:40].lstrip()[:3], "end:" + raw[-40:].rstrip()[-2:]):
            v[i, PATH_AT + zlib.crc32(key.encode("utf-8", "surrogatepass")) % (DIMS - PATH_AT)] = 1
    # a run of marks is there or not, however long the block; words count by their share
    v[:, :WORD_AT] = v[:, :WORD_AT] > 0
    words = np.log1p(v[:, WORD_AT:PATH_AT])
    v[:, WORD_AT:PATH_AT] = 2 * words / np.maximum(np.linalg.norm(words, axis=1, keepdims=True), 1)
    return v


OPENING = re.compile(r"(?i)<(/?)([a-z][a-z0-9]*)\b[^<>]*?(/?)>|\\(begin|end)\{(\w+)")


def leaves(text: str):
    """(text, masked text, marks of code and formulas, spans, blocks, path of open constructs at each block)."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    masked, marks, spans = mask(text)
    leaf = blocks(text, spans)
    paths, opened = [], []
    nested = "<" in text or "\\begin" in text
    for a, b in leaf:
        paths.append("/".join(opened[-4:]))
        for m in OPENING.finditer(text, a, b) if nested else ():
            name = (m.group(2) or m.group(5) or "").lower()
            if m.group(1) or m.group(4) == "end":
                if name in opened:
                    del opened[len(opened) - 1 - opened[::-1].index(name):]
            elif name not in ("br", "img", "hr", "meta", "link", "input", "p", "li") and not m.group(3):
                opened.append(name)
    return text, masked, marks, spans, leaf, paths


def vectors(docs: list) -> list[np.ndarray]:
    """Block vectors of each of several texts' ``leaves``."""
    v = features([d[0][a:b] for d in docs for a, b in d[4]], [p for d in docs for p in d[5]])
    return np.split(v, np.cumsum([len(d[4]) for d in docs])[:-1]) if docs else []


def by_form(doc, kinds=KINDS) -> list[set[str]]:
    """Kinds found by their exact form in each block of a text's ``leaves``."""
    _, masked, marks, _, leaf, _ = doc
    starts = [a for a, _ in leaf]
    found: list[set[str]] = [set() for _ in leaf]
    for pos, kind in [*(m for m in marks if m[1] in kinds), *constructs(masked, kinds)]:
        if leaf:
            found[max(bisect_right(starts, pos) - 1, 0)].add(kind)
    return found


def roles_by_form(doc) -> list[str]:
    text, masked, _, spans, leaf, _ = doc
    inside = {a: k for a, _, k in spans}
    return [role(text[a:b], masked[a:b], inside.get(a)) for a, b in leaf]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM over block vectors: 8 role logits and 4 markup logits per block."""

    def __init__(self, dims: int = DIMS, embed: int = 48, hidden: int = 24, seed: int = 11):
        r = np.random.default_rng(seed)
        self.dims, self.hidden = dims, hidden
        g = lambda *s: (r.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"E": g(dims, embed), "e": np.zeros(embed, np.float32), "O": g(2 * hidden + embed, 12), "o": np.zeros(12, np.float32)}
        for d in "fb":
            self.p |= {"W" + d: g(embed + hidden, 4 * hidden), "w" + d: np.zeros(4 * hidden, np.float32)}
            self.p["w" + d][hidden:2 * hidden] = 1

    def _scan(self, e: np.ndarray, on: np.ndarray, d: str, kept: dict | None = None) -> np.ndarray:
        """States of one direction; what the gradient needs goes to ``kept``."""
        h = self.hidden
        wx, wh = self.p["W" + d][:-h], self.p["W" + d][-h:]
        a = e @ wx + self.p["w" + d]
        n, t, _ = e.shape
        hs, cs = np.zeros((n, h), a.dtype), np.zeros((n, h), a.dtype)
        out = np.zeros((n, t, h), a.dtype)
        if kept is not None:
            kept.update(g=np.zeros((n, t, 3 * h), a.dtype), n=np.zeros((n, t, h), a.dtype), c=np.zeros((n, t, h), a.dtype), tc=np.zeros((n, t, h), a.dtype), h=np.zeros((n, t, h), a.dtype))
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            z = a[:, i] + hs @ wh
            g, new, m = _sigmoid(z[:, :3 * h]), np.tanh(z[:, 3 * h:]), on[:, i, None]
            c = m * (g[:, h:2 * h] * cs + g[:, :h] * new)
            tc = np.tanh(c)
            if kept is not None:
                kept["g"][:, i], kept["n"][:, i], kept["c"][:, i], kept["tc"][:, i], kept["h"][:, i] = g, new, cs, tc, hs
            hs, cs = m * g[:, 2 * h:] * tc, c
            out[:, i] = hs
        return out

    def embed(self, v: np.ndarray) -> np.ndarray:
        return np.tanh(v @ self.p["E"] + self.p["e"])

    def read(self, e: np.ndarray, on: np.ndarray, kept: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(logits, what they are read from) of embedded blocks."""
        both = [self._scan(e, on, d, None if kept is None else kept.setdefault(d, {})) for d in "fb"]
        u = np.concatenate([*both, e], 2)
        return u @ self.p["O"] + self.p["o"], u

    def forward(self, v: np.ndarray, on: np.ndarray):
        e, kept = self.embed(v), {}
        y, u = self.read(e, on, kept)
        return y, (v, e, u, kept, on)

    def _back(self, d: str, k: dict, on: np.ndarray, e: np.ndarray, dh_all: np.ndarray, de: np.ndarray, grad: dict) -> None:
        h = self.hidden
        wx, wh = self.p["W" + d][:-h], self.p["W" + d][-h:]
        n, t, _ = e.shape
        dh, dc, da = np.zeros_like(dh_all[:, 0]), np.zeros_like(dh_all[:, 0]), np.zeros((n, t, 4 * h), dh_all.dtype)
        for i in range(t - 1, -1, -1) if d == "f" else range(t):
            m, new, tc = on[:, i, None], k["n"][:, i], k["tc"][:, i]
            gi, gf, go = k["g"][:, i, :h], k["g"][:, i, h:2 * h], k["g"][:, i, 2 * h:]
            dh = (dh + dh_all[:, i]) * m
            dc = (dc + dh * go * (1 - tc * tc)) * m
            da[:, i] = np.hstack([dc * new * gi * (1 - gi), dc * k["c"][:, i] * gf * (1 - gf), dh * tc * go * (1 - go), dc * gi * (1 - new * new)])
            dh, dc = da[:, i] @ wh.T, dc * gf
        flat = da.reshape(-1, 4 * h)
        grad["W" + d] = np.vstack([e.reshape(-1, e.shape[-1]).T @ flat, k["h"].reshape(-1, h).T @ flat])
        grad["w" + d] = flat.sum(0)
        de += da @ wx.T

    def step(self, v, on, roles, kinds, rate: float, state: dict) -> float:
        y, (v, e, u, kept, _) = self.forward(v, on)
        n = max(1.0, on.sum())
        soft = np.exp(y[..., :8] - y[..., :8].max(-1, keepdims=True))
        soft /= soft.sum(-1, keepdims=True)
        prob = _sigmoid(y[..., 8:])
        loss = -(np.log(np.take_along_axis(soft, roles[..., None], -1)[..., 0] + 1e-9) * on).sum() / n
        loss -= ((kinds * np.log(prob + 1e-9) + (1 - kinds) * np.log(1 - prob + 1e-9)) * on[..., None]).sum() / n
        dy = np.concatenate([soft - np.eye(8, dtype=np.float32)[roles], prob - kinds], -1) * on[..., None] / n
        grad = {k: np.zeros_like(x) for k, x in self.p.items()}
        grad["O"] = u.reshape(-1, u.shape[-1]).T @ dy.reshape(-1, dy.shape[-1])
        grad["o"] = dy.sum((0, 1))
        du = dy @ self.p["O"].T
        h = self.hidden
        de = du[..., 2 * h:].copy()
        self._back("f", kept["f"], on, e, du[..., :h], de, grad)
        self._back("b", kept["b"], on, e, du[..., h:2 * h], de, grad)
        da = de * (1 - e * e)
        grad["E"] = v.reshape(-1, v.shape[-1]).T @ da.reshape(-1, da.shape[-1])
        grad["e"] = da.sum((0, 1))
        state["t"] = state.get("t", 0) + 1
        for k, g in grad.items():
            m1, m2 = state.setdefault(k, (np.zeros_like(g), np.zeros_like(g)))
            m1 = 0.9 * m1 + 0.1 * g
            m2 = 0.999 * m2 + 0.001 * g * g
            state[k] = m1, m2
            self.p[k] = self.p[k] - rate * (m1 / (1 - 0.9 ** state["t"])) / (np.sqrt(m2 / (1 - 0.999 ** state["t"])) + 1e-7)
        return float(loss)

    def predict(self, docs: list[np.ndarray], batch: int = 128) -> list[tuple[np.ndarray, np.ndarray]]:
        """(role of each block, probability of each kind) of each document; documents of like length run together."""
        out: list = [None] * len(docs)
        order = sorted(range(len(docs)), key=lambda i: len(docs[i]))
        embedded = np.split(self.embed(np.concatenate(docs)), np.cumsum([len(d) for d in docs])[:-1]) if docs else []
        for s in range(0, len(order), batch):
            own = order[s:s + batch]
            e, on = pad([embedded[i] for i in own], self.p["E"].shape[1])
            y, _ = self.read(e, on)
            for r, i in enumerate(own):
                n = len(docs[i])
                out[i] = y[r, :n, :8].argmax(-1), _sigmoid(y[r, :n, 8:])
        return out


def pad(docs: list[np.ndarray], dims: int) -> tuple[np.ndarray, np.ndarray]:
    t = max([1, *map(len, docs)])
    v, on = np.zeros((len(docs), t, dims), np.float32), np.zeros((len(docs), t), np.float32)
    for i, d in enumerate(docs):
        v[i, :len(d)], on[i, :len(d)] = d, 1
    return v, on


WORDS = "ledger archive node chunk index route value table review note vault harbor record result".split()


def _pick(r, *of):
    return of[r.integers(len(of))]


def construct(r, kind: str) -> str:
    """A construct of a kind, from a small grammar."""
    w = lambda: WORDS[r.integers(len(WORDS))] + _pick(r, "", "", " " + WORDS[r.integers(len(WORDS))])
    n = int(r.integers(1, 6))
    if kind == "html":
        t = _pick(r, *ELEMENTS.split())
        return _pick(
            r, f"<{t}>{w()}</{t}>", f'<{t} class="{w()}">{w()}</{t}>', f"<{t} id={n}>", f"</{t}>", f"<{t}>", f"<{t}/>", "<br>", f"{w()}<br>{w()}", f"{w()}<br/>", f"<!-- {w()} -->", f"{w()}&nbsp;{w()}",
            f"{w()} &amp; {w()}", f"&lt;{w()}&gt;", f"&#{n + 160};", f"&#x{n + 160:x};", f'<a href="https://a.example/{n}">{w()}</a>', f"<img src={w()}.png alt=", f"<div style='{w()}'\n", f"<ul>\n<li>{w()}</li>\n</ul>",
            f"<p>{w()}", f"<b>{w()}", f"{w()}</b>", f"<table><tr><td>{w()}</td></tr></table>", f"<pre>{w()}</pre>", f"{w()}&mdash;{w()}", f"<td>{w()}", f"&copy; {w()}")
    if kind == "markdown":
        return _pick(
            r, f"\n{'#' * n} {w()}\n", f"**{w()}**", f"*{w()}*", f"_{w()}_", f"__{w()}__", f"~~{w()}~~", f"[{w()}](https://a.example/{n})", f"![{w()}](img/{n}.png)", f"[{w()}](#{w()})", f"`{w()}`",
            f"\n```\n{w()}\n```\n", f"\n~~~py\n{w()}\n~~~\n", f"\n> {w()}\n", f"\n| {w()} | {w()} |\n|---|---|\n| {n} | {w()} |\n", f"\n{w()}\n=====\n", f"\n\n{w()}\n-----\n", f"\n[{n}]: https://a.example/{w()}\n", f"***{w()}***", f"[{w()}](notes/{w()}.md)")
    if kind == "wiki":
        return _pick(
            r, f"[[{w()}]]", f"[[{w()}|{w()}]]", "{{" + w() + "}}", "{{" + f"{w()}|{w()}={n}" + "}}", f"\'\'{w()}\'\'", f"\'\'\'{w()}\'\'\'", f"\n{'=' * (n % 4 + 1)} {w()} {'=' * (n % 4 + 1)}\n", "\n{| class=\"wikitable\"\n|-\n| " + w() + "\n|}\n", "\n{|\n! " + w() + "\n|}\n", f"[[File:{w()}.png|thumb]]", f"<nowiki>{w()}</nowiki>")
    return _pick(
        r, f"\\section{{{w()}}}", f"\\textbf{{{w()}}}", f"\\emph{{{w()}}}", f"\\cite{{{w()}}}", f"$x_{{{n}}}$", f"$a + b = {n}$", f"$$ \\sum_{{i={n}}} x_i $$", f"\\[ y = x^{n} \\]", f"\\( a_{n} \\)", f"\\begin{{itemize}}\n\\item {w()}\n\\end{{itemize}}",
        f"\\begin{{equation}}\ne = {n}\n\\end{{equation}}", f"\\label{{sec:{n}}}", f"\\begin{{verbatim}}\n{w()}\n\\end{{verbatim}}", f"$\\alpha$", f"\\frac{{{n}}}{{2}}", f"\\begin{{tabular}}{{ll}}", f"\\ref{{{w()}}}", f"\\item {w()}", f"\\maketitle")


def lookalike(r) -> str:
    """What merely resembles a construct."""
    w = lambda: WORDS[r.integers(len(WORDS))]
    n = int(r.integers(1, 9))
    return _pick(
        r, f"a < {n} and b > {n}", f"List<{w().title()}>", f"Vec<u8>", f"<{w()}@a.example>", f"<{n}", f"R&D", f"A & B", f"{w()} && {w()}", f"#{n}", f"# {n}" if False else f"no. #{n}", f"{n} * {n} * 2", f"2 ** {n}", f"{w()}_{w()}_{n}", f"__init__.py",
        f"snake_{w()}_case", f"arr[{n}][{n}]", f"[{n}]", f"{w()} [sic] (old)", f"${n} or ${n + 1}", f"US$ {n}.50", f"C:\\{w()}\\new", f"\\n", f"a == b", f"x = {n} = y", f"{w()} | {w()} | {n}", f"-- {w()}", f"{w()}\'s", f"it\'s \'{w()}\'", f"f({{{n}}})", f"{{{w()}}}", f"{{ {w()}: {n} }}", f"- {w()}\n- {w()}", f"{n}. {w()}", f"~{n}", f"<- {w()} ->", f"*.{w()}", f"/{w()}/*", f"->{w()}", f"%{n}", f"^{n}")


def plant(text: str, r, what: str) -> str:
    """``what`` put between two words or lines of a text; what needs a line of its own gets one."""
    at = [m.end() for m in re.finditer(r"\n" if what[:1] == "\n" else r"[ \n]", text)] or [len(text)]
    i = at[r.integers(len(at))]
    glue = "" if what[:1] == "\n" else " "
    return text[:i] + what + glue + text[i:]


def examples(texts: list[str], seed: int = 11):
    """(leaves, roles, kinds of each block) to learn from: each text as it comes, and one with constructs or look-alikes planted.

    What is planted has its kind by the grammar. A planted text is labelled where the plant lies; the rest of it has the labels it had.
    """
    r = np.random.default_rng(seed)
    for t in texts:
        doc = leaves(t)
        kinds = by_form(doc)
        yield doc, roles_by_form(doc), kinds
        if len(t) > 4_000 or any(d[2] == "code" for d in doc[3]) or set().union(*kinds, set()):
            continue
        # no construct in it: whatever is found in it below is what was planted
        t = doc[0]
        kind = _pick(r, *KINDS, "")
        for _ in range(int(r.integers(1, 4))):
            t = plant(t, r, lookalike(r))
        if not kind:
            doc = leaves(t)
            yield doc, roles_by_form(doc), [set() for _ in doc[4]]
            continue
        what = construct(r, kind)
        t = plant(t, r, "\ue000" + what + "\ue001" if what[:1] != "\n" else "\n\ue000" + what + "\ue001")
        lo = t.index("\ue000")
        hi = t.index("\ue001") - 1
        doc = leaves(t.replace("\ue000", "").replace("\ue001", ""))
        yield doc, roles_by_form(doc), [{kind} if a < hi and b > lo else set() for a, b in doc[4]]


def drills(n: int, seed: int = 11):
    """(leaves, roles, kinds of each block) of ``n`` short lines from the grammar, half with a construct and half with look-alikes."""
    r = np.random.default_rng(seed)
    for i in range(n):
        t = " ".join(WORDS[j] for j in r.integers(len(WORDS), size=int(r.integers(2, 25)))).capitalize() + _pick(r, ".", "", "!")
        kind = KINDS[i // 2 % 4] if i % 2 else ""
        for _ in range(int(r.integers(0, 3))):
            t = plant(t, r, lookalike(r))
        doc = leaves(plant(t, r, construct(r, kind)) if kind else t)
        yield doc, roles_by_form(doc), [{kind} if kind and len(doc[4]) == 1 else k for k in by_form(doc)]


def train(texts: list[str], epochs: int = 9, most_blocks: int = 64, seed: int = 11) -> Labeller:
    """A labeller fitted on texts and what is planted in them, windows of ``most_blocks`` blocks at a time."""
    model, rows = Labeller(seed=seed), []
    known = [*examples(texts, seed), *drills(2 * len(texts), seed)]
    for at in range(0, len(known), 256):  # a few at a time, and kept short, for the driver's memory
        for v, (_, roles, kinds) in zip(vectors([k[0] for k in known[at:at + 256]]), known[at:at + 256]):
            v = v.astype(np.float16)
            for s in range(0, len(v), most_blocks):
                rows.append((v[s:s + most_blocks], roles[s:s + most_blocks], kinds[s:s + most_blocks]))
    rng, state = np.random.default_rng(seed), {}
    rows.sort(key=lambda r: len(r[0]))
    for epoch in range(epochs):
        starts = list(range(0, len(rows), 32))
        rng.shuffle(starts)
        for s in starts:
            own = rows[s:s + 32]
            v, on = pad([r[0] for r in own], model.dims)
            y, k = np.zeros(on.shape, np.int64), np.zeros((*on.shape, 4), np.float32)
            for i, (_, roles, kinds) in enumerate(own):
                y[i, :len(roles)] = [ROLES.index(x) for x in roles]
                k[i, :len(kinds)] = [[x in s for x in KINDS] for s in kinds]
            model.step(v, on, y, k, 0.01 if epoch < epochs * 2 // 3 else 0.003, state)
    return model


def fit(df: DataFrame, key: str, text: str, sample_rows: int = 2_000, longest: int = 20_000) -> Labeller:
    """Trains on at most ``sample_rows`` texts of at most ``longest`` characters, chosen by hashed id."""
    rows = (
        df.filter((F.length(text) > 0) & (F.length(text) <= longest)).select(F.col(key).alias("k"), F.col(text).alias("t"))
        .orderBy(F.xxhash64("k"), "k").limit(sample_rows).collect()
    )
    return train([r.t for r in rows])


TIDY = (
    (re.compile(r"!?\[([^\[\]\n]*)\]\([^()\n]*\)"), r"\1"),
    (re.compile(r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]"), r"\1"),
    (re.compile(r"\{\{[^{}]*(?:\{\{[^{}]*\}\}[^{}]*)*\}\}"), ""),
    (re.compile(r"'{2,5}"), ""),
    (re.compile(r"(?<![\w*])\*{1,3}(?=\S)([^*\n]+?)(?<=\S)\*{1,3}(?!\w)"), r"\1"),
    (re.compile(r"(?<!\w)_{1,3}(?=[^\s_])([^\n]+?)(?<=[^\s_])_{1,3}(?!\w|\.\w)"), r"\1"),
    (re.compile(r"~~([^~\n]+)~~"), r"\1"),
    (re.compile(r"\\(?:cite|label|ref|eqref|pageref)\*?\{[^{}]*\}"), ""),
    (re.compile(r"\\(?:item)\b\s*"), "- "),
    (re.compile(r"\\footnote\{([^{}]*)\}"), r" (\1)"),
    (re.compile(r"\\[A-Za-z]{2,}\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}"), r"\1"),
    (re.compile(r"\\(?:maketitle|tableofcontents|noindent|centering|hline|newpage)\b"), ""),
)


NO_CONTENT = re.compile(
    r"(?is)\s*(?:---\n.*?\n---\s*$|<(?:script|style|head|title|!doctype|!--)|\\(?:documentclass|usepackage|maketitle|label|begin|end)\b[^\n]*$)")


def clean_block(raw: str, kind: str, found: set[str]) -> str:
    """Clean text of a block in its role; headings, lists, tables, code and formulas keep a plain mark."""
    t = raw.strip("\n")
    if kind == "nothing":
        # what can't be seen in the rendered text goes; a block with words of its own is kept, whatever the network says
        if NO_CONTENT.match(t):
            return ""
        kind = "paragraph"
    if kind == "code":
        t = re.sub(r"(?m)^\s*(?:`{3,}|~{3,})[^\n]*$\n?", "", t)
        t = re.sub(r"(?i)</?(?:pre|code)\b[^<>]*>|\\(?:begin|end)\{(?:verbatim\*?|lstlisting|minted)\}", "", t)
        t = html.unescape(t) if "html" in found else t
        return "\n".join("    " + x for x in t.strip("\n").split("\n"))
    if kind == "formula":
        return re.sub(r"^\$\$|\$\$$|^\\\[|\\\]$|^\\\(|\\\)$|\\(?:begin|end)\{[^}]*\}|\\label\{[^}]*\}", "", t.strip()).strip()
    if kind == "table":
        t = re.sub(r"(?i)</t[dh]>\s*<t[dh]\b[^<>]*>", " | ", t)
        t = re.sub(r"(?i)</tr>\s*", "\n", t)
        t = re.sub(r"(?m)^\{\|.*$|^\|\}$|^\|-.*$|^[\s|:-]*-{2,}[\s|:-]*$", "", t)
        t = re.sub(r"(?m)^[!|]\s*|\s*\|\s*$", "", t).replace("||", "|").replace("!!", "|")
    depth = 0
    if kind == "heading":
        m = re.match(r"\s*(?:(#{1,6})\s|(={2,6})|<h([1-6])|\\((?:sub)*)(?:section|paragraph|chapter))", t, re.I)
        depth = (len(m.group(1) or m.group(2) or "") or int(m.group(3) or 0) or 1 + len(m.group(4) or "") // 3) if m else 1
        t = re.sub(r"^\s*#{1,6}\s+|\s+#+\s*$|\n\s*[=-]{3,}\s*$", "", t)
        t = re.sub(r"^\s*={1,6}\s*|\s*={1,6}\s*$", "", t)
    t = re.sub(r"(?i)<li\b[^<>]*>\s*", "\n- ", t)
    t = re.sub(r"(?i)<br\s*/?>", "\n", t)
    t = TAG.sub("", COMMENT.sub("", t))
    if "html" in found:
        t = html.unescape(t)
    t = CODE_SPAN.sub(r"\2", t)
    if found & {"markdown", "wiki", "latex"}:
        for pattern, to in TIDY:
            t = pattern.sub(to, t)
    if kind == "quote":
        t = re.sub(r"(?m)^\s*>\s?", "", t)
    t = "\n".join(x.strip() if kind != "list" else x.rstrip() for x in t.split("\n") if x.strip())
    return "#" * depth + " " + " ".join(t.split()) if kind == "heading" and t else t


def _label(frames: Iterator[pd.DataFrame], model: Labeller, named: float, cleaned: bool) -> Iterator[pd.DataFrame]:
    for f in frames:
        for s in range(0, len(f), 512):
            own = f.iloc[s:s + 512]
            docs = [leaves(t) for t in own["text"]]
            rows = []
            for key, doc, (roles, probs) in zip(own["key"], docs, model.predict(vectors(docs))):
                text, leaf = doc[0], doc[4]
                if not cleaned:
                    said = [k for j, k in enumerate(KINDS) if len(probs) and probs[:, j].max() >= named]
                    if said:
                        rows.extend((key, k) for k in sorted(set().union(*by_form(doc, said))))
                    continue
                kinds = by_form(doc)
                for i, (a, b) in enumerate(leaf):
                    label = ROLES[roles[i]]
                    t = clean_block(text[a:b], label, kinds[i])
                    if t.strip():
                        rows.append((key, i, label, t))
            yield pd.DataFrame(rows, columns=["key", "block", "role", "clean"] if cleaned else ["key", "markup"])


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).filter(F.length(F.trim("text")) > 0)


def markup_kinds(df: DataFrame, key: str, text: str, model: Labeller, named: float = 0.005) -> DataFrame:
    """(key, markup) for each kind of markup a text holds: named by the network in some block with a probability of ``named``, and there by its form."""
    return _texts(df, key, text).mapInPandas(partial(_label, model=model, named=named, cleaned=False), "key bigint, markup string").distinct()


def clean_texts(df: DataFrame, key: str, text: str, model: Labeller) -> DataFrame:
    """(key, block, role, clean): the blocks of a text that have content, in order, as clean text."""
    return _texts(df, key, text).mapInPandas(
        partial(_label, model=model, named=0.0, cleaned=True), "key bigint, block int, role string, clean string")
