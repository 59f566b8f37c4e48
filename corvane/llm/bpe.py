"""Byte-level BPE of a whole corpus inside the JVM.

A text is cut into words by the tokenizer's pattern. Every word is encoded by a
fold over its bytes that applies, in rank order, the merges of a literal rank
map; the fold runs once for each of the most frequent distinct words, whose ids
then become a literal dictionary, so encoding the corpus needs no shuffle and no Python. Words
beyond the dictionary are encoded in place by the same fold: the dictionary's
size (``cache_words``) changes speed only, never a result.

A word is cut further at byte pairs that occur inside no token: no merge can
span such a place, so the pieces are independent. That keeps the fold
short in scripts without spaces.

Defined results: null and empty texts give an empty list; strings of special
tokens are ordinary text; repeated rows give repeated rows; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.sources.tables import written

BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.json"
# fixed value: the tokenizer's word pattern
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BUCKETS = 4096


def _printable() -> dict[str, int]:
    """The file format's printable stand-in of each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or (161 <= b <= 255 and b != 173)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class Ranks:
    """A tokenizer's tables: symbols of bytes, merges, and byte pairs inside tokens."""

    tokens: tuple[bytes, ...]
    rights: tuple[tuple[int, ...], ...]  # by left symbol: the right symbols it merges with
    merged: tuple[tuple[int, ...], ...]  # the symbols these merges make, whose order is the merges' rank

    @property
    def byte_ids(self) -> list[int]:
        at = {t: i for i, t in enumerate(self.tokens) if len(t) == 1}
        return [at[bytes([b])] for b in range(256)]

    def inner_pairs(self) -> list[list[int]]:
        """By first byte: the bytes that follow it inside some token."""
        seen: list[set[int]] = [set() for _ in range(256)]
        for t in self.tokens:
            for a, b in zip(t, t[1:]):
                seen[a].add(b)
        return [sorted(x) for x in seen]


@lru_cache(maxsize=4)
def read_ranks(path: str = BYTE_BPE_50K) -> Ranks:
    """Ranks of a byte-level BPE file; checks that ids rise with rank, which the fold relies on."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    vocab, special = j["model"]["vocab"], {a["content"] for a in j["added_tokens"]}
    back = _printable()
    tokens: list[bytes] = [b""] * (max(vocab.values()) + 1)
    for k, i in vocab.items():
        tokens[i] = b"" if k in special else bytes(back[c] for c in k)
    rights: list[list[int]] = [[] for _ in tokens]
    merged: list[list[int]] = [[] for _ in tokens]
    last = -1
    for m in j["model"]["merges"]:
        a, b = m.split(" ") if isinstance(m, str) else m
        made = vocab[a + b]
        if made <= last:
            raise ValueError("ids of merges don't rise with their rank")
        last = made
        rights[vocab[a]].append(vocab[b])
        merged[vocab[a]].append(made)
    return Ranks(tuple(tokens), tuple(map(tuple, rights)), tuple(map(tuple, merged)))


def literal(value, schema: str) -> Column:
    """A nested constant; folded once by the optimizer, shared by reference after that."""
    return F.from_json(F.lit(json.dumps(value, separators=(",", ":"))), schema)


def bind(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Bpe:
    """Column expressions of one tokenizer."""

    def __init__(self, ranks: Ranks):
        self.ranks = ranks
        self._rights = literal(ranks.rights, "array<array<int>>")
        self._merged = literal(ranks.merged, "array<array<int>>")
        self._bytes = literal(ranks.byte_ids, "array<int>")
        self._inner = literal(ranks.inner_pairs(), "array<array<int>>")

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + PATTERN), F.lit(0))

    def _made(self, a: Column, b: Column) -> Column:
        """Symbol made of two adjacent ones, null if they don't merge."""
        return F.get(F.get(self._merged, a), F.array_position(F.get(self._rights, a), b).cast("int") - 1)

    def fold(self, symbols: Column) -> Column:
        """Ranked merges over an array of symbols: each step merges the best pair wherever it stands."""

        def step(acc, _):
            a = acc["a"]

            def merge(made):
                best = F.array_min(made)

                def apply(m):
                    # of overlapping occurrences (x x x) the first goes now, the rest in later steps
                    def hit(i):
                        return (F.get(made, i) == m) & ~F.coalesce(F.get(made, i - 1) == m, F.lit(False))

                    at = F.sequence(F.lit(0), F.size(a) - 1)
                    kept = F.filter(at, lambda i: ~F.coalesce(hit(i - 1), F.lit(False)))
                    return F.transform(kept, lambda i: F.when(F.coalesce(hit(i), F.lit(False)), m).otherwise(F.get(a, i)))

                return F.when(best.isNull(), F.struct(a.alias("a"), F.lit(True).alias("done"))).otherwise(
                    F.struct(bind(best, apply).alias("a"), F.lit(False).alias("done"))
                )

            made = F.transform(F.sequence(F.lit(0), F.size(a) - 2), lambda i: self._made(F.get(a, i), F.get(a, i + 1)))
            return F.when(acc["done"] | (F.size(a) < 2), acc).otherwise(bind(made, merge))

        start = F.struct(symbols.alias("a"), F.lit(False).alias("done"))
        return F.when(F.size(symbols) < 2, symbols).otherwise(
            F.aggregate(F.sequence(F.lit(1), F.size(symbols) - 1), start, step, lambda acc: acc["a"])
        )

    def _pieces(self, word: Column, body) -> Column:
        """``body(hex, bytes, starts)`` of a word, starts being where independent pieces begin."""

        def of_bytes(h, b):
            cut = F.filter(
                F.sequence(F.lit(0), F.size(b) - 1),
                lambda i: (i == 0) | ~F.array_contains(F.get(self._inner, F.get(b, i - 1)), F.get(b, i)),
            )
            return bind(cut, lambda starts: body(h, b, starts))

        def of_hex(h):
            codes = F.transform(
                F.sequence(F.lit(0), (F.length(h) / 2).cast("int") - 1),
                lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int"),
            )
            return bind(codes, lambda b: of_bytes(h, b))

        return bind(F.hex(F.encode(word, "UTF-8")), of_hex)

    @staticmethod
    def _ends(starts: Column, n: Column) -> Column:
        return F.concat(F.slice(starts, 2, F.size(starts)), F.array(n))

    def piece_texts(self, word: Column) -> Column:
        """Hex of the independent pieces of a word that are longer than a byte."""
        return F.filter(
            self._pieces(word, lambda h, b, starts: F.zip_with(
                starts, self._ends(starts, F.size(b)), lambda s, e: F.substring(h, s * 2 + 1, (e - s) * 2))),
            lambda x: F.length(x) > 2,
        )

    def encode_word(self, word: Column, pieces: Column | None = None) -> Column:
        """Ids of a word, piece by piece; ``pieces`` is a literal dictionary of common pieces."""

        def ids(h, b, s, e):
            folded = bind(
                F.transform(F.sequence(s, e - 1), lambda i: F.get(self._bytes, F.get(b, i))), self.fold
            )
            found = lookup(pieces, F.substring(h, s * 2 + 1, (e - s) * 2)) if pieces is not None else None
            many = folded if found is None else F.coalesce(found, folded)
            return F.when(e - s == 1, F.array(F.get(self._bytes, F.get(b, s)))).otherwise(many)

        return F.flatten(self._pieces(word, lambda h, b, starts: F.zip_with(
            starts, self._ends(starts, F.size(b)), lambda s, e: ids(h, b, s, e))))

    def decode(self, ids: Column) -> Column:
        """Text of an id list: the tokens' bytes, joined as binary pieces, 256 at a time so that long lists aren't copied over and over."""
        pieces = literal([base64.b64encode(t).decode() for t in self.ranks.tokens], "array<binary>")
        none = F.lit(b"")
        part = lambda i: F.aggregate(F.slice(ids, i * 256 + 1, 256), none, lambda acc, x: F.concat(acc, F.get(pieces, x)))
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(ids) - 1) / 256).cast("int")), part)
        return F.decode(F.when(F.size(ids) == 0, none).otherwise(F.aggregate(parts, none, lambda acc, x: F.concat(acc, x))), "UTF-8")


def lookup(dictionary: Column, key: Column) -> Column:
    """Ids of ``key`` in a bucketed literal dictionary, null if it isn't there."""
    return F.try_element_at(F.get(dictionary, F.pmod(F.hash(key), F.lit(BUCKETS))), key)


def as_dictionary(rows: DataFrame) -> Column:
    """(key, ids) rows, bounded by the caller, as a literal of small maps by hash bucket."""
    maps: list[dict] = [{} for _ in range(BUCKETS)]
    for r in rows.select("key", "ids", F.pmod(F.hash("key"), F.lit(BUCKETS)).alias("b")).collect():
        maps[r.b][r.key] = r.ids
    return literal(maps, "array<map<string,array<int>>>")


def encode_texts(
    df: DataFrame, key: str, text: str, path: str = BYTE_BPE_50K, cache_words: int = 18_432, cache_pieces: int = 6_144
) -> DataFrame:
    """(key, ids) of every row.

    Two passes over the texts: the distinct words with the number of texts that hold them, then the
    encoding. Words of over 64 characters are not worth a place in the dictionary.
    """
    bpe = Bpe(read_ranks(path))
    counted = written(
        df.select(F.explode(F.array_distinct(bpe.words(F.col(text)))).alias("word")).groupBy("word").agg(F.count("*").alias("n")),
        "words",
    )
    common = counted.filter((F.length("word") <= 64)).orderBy(F.desc("n"), "word").limit(cache_words)
    pieces = (
        counted.select(F.explode(bpe.piece_texts(F.col("word"))).alias("key"), "n")
        .filter(F.length("key") <= 128).groupBy("key").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "key").limit(cache_pieces)
    )
    byte_list = F.transform(
        F.sequence(F.lit(0), (F.length("key") / 2).cast("int") - 1),
        lambda i: F.get(bpe._bytes, F.conv(F.substring(F.col("key"), i * 2 + 1, F.lit(2)), 16, 10).cast("int")),
    )
    piece_ids = as_dictionary(pieces.repartition(8).select("key", bind(byte_list, bpe.fold).alias("ids")))
    word_ids = as_dictionary(common.repartition(16).select(
        F.col("word").alias("key"), bpe.encode_word(F.col("word"), piece_ids).alias("ids")))
    ids = F.flatten(F.transform(
        bpe.words(F.col(text)), lambda w: F.coalesce(lookup(word_ids, w), bpe.encode_word(w, piece_ids))))
    return df.select(F.col(key).alias(key), ids.alias("ids"))
