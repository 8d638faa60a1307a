"""Encoding of a corpus with a public byte-pair tokenizer, inside the JVM.

Method: Spark's higher-order functions.  A text is cut into words by the tokenizer's
own regular expression; words that are tokens are looked up; the other distinct words
of a stretch of text are folded once each over their bytes: a word is a string with a
character for each token, at first for each byte, and every step of the fold makes one
ranked merge, lowest rank first, wherever its pair stands.  The steps are the ranks of
the tokens that lie in the word, found by a hash of its parts.  Ranks and vocabulary are
constant arrays and maps, bounded by the tokenizer's file; Catalyst folds them into
literals.  No shuffle and one scan: a text is encoded where it lies.

That is the lowest rank among the pairs at every time, leftmost first, if every token is
made by one merge, that of the two tokens left when its own bytes are merged up to its
rank; ``_merges`` tests this for the whole vocabulary.  For then no merge makes a pair of
lower rank: until the first such merge all ranks came in order, so inside the pair's bytes
the merges were those of the token alone, its two halves met and were merged before.  By
the same reason a token is never made of other halves, and a rank whose token is not
there changes nothing.

Every step searches the whole word, so words above ``WINDOW`` bytes are folded in
blocks: a window is folded, its tokens that begin in the first half are kept, the next
window begins behind them.  Tokens are the word's encoding exactly if every two
neighbours, folded on their own, come out as these two; inside a window that holds by
itself, at every seam it is tested, and a word with a seam that fails is folded whole.
"""

from __future__ import annotations

import functools
import uuid
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.llm.bpe import JAVA_PATTERN, ranks_of, read_vocabulary, vocabulary_path
from loomgraph.workspace import spread

#: Words are made distinct in stretches this long: a look-up among a stretch's distinct words is linear in their number.
STRETCH = 256
#: Longest word that is folded whole; longer ones go in windows of this many bytes, HALF apart.  No token is longer than
#: WINDOW - HALF bytes.
WINDOW, HALF = 512, 256
#: Words that are no tokens but frequent among the first SAMPLE ones of at most SHORT bytes are spelled once and put beside
#: the tokens, FREQUENT of them at most.  That saves folds; every other word is folded where it stands, so no result
#: depends on the sample.
SAMPLE, SHORT, FREQUENT = 200_000, 48, 16_384
WORD_BUCKETS, PART_BUCKETS = 1 << 16, 1 << 18
#: Parts of a word up to this many bytes are looked up; the longest ones stand for all tokens that begin with them.
PART = 5
#: Words up to this many bytes have the places of their parts in a table.
TABLED = 16

#: The character of a token: that of its byte, or BEYOND + its id.  SURROGATES are no characters.
BEYOND, SURROGATES = 256, 0xD800
#: An element of a window: offset of a token's first byte << 16 | its id.
OFFSET, ID = 16, (1 << 16) - 1


def _mixed(h: int, k: int) -> int:
    k = k * 0xCC9E2D51 & 0xFFFFFFFF
    h ^= ((k << 15 | k >> 17) & 0xFFFFFFFF) * 0x1B873593 & 0xFFFFFFFF
    return ((h << 13 | h >> 19) & 0xFFFFFFFF) * 5 + 0xE6546B64 & 0xFFFFFFFF


def _word_bucket(word: bytes, buckets: int = WORD_BUCKETS) -> int:
    """The place of Spark's ``hash`` of the string: 32-bit Murmur3 whose last bytes are taken one by one."""
    h, whole = 42, len(word) & ~3
    for i in range(0, whole, 4):
        h = _mixed(h, int.from_bytes(word[i : i + 4], "little"))
    for b in word[whole:]:
        h = _mixed(h, (b - 256 if b > 127 else b) & 0xFFFFFFFF)
    h ^= len(word)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return (h ^ h >> 16) & (buckets - 1)


class Constants:
    """One-row tables as constants of the session's expressions; they leave the session when the block ends.

    A DataFrame made inside keeps their values: Catalyst has put them into its plan.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.tag, self.names = spark, f"loomgraph_{uuid.uuid4().hex[:12]}", {}

    def __enter__(self) -> Constants:
        return self

    def __exit__(self, *_) -> None:
        for name in set(self.names.values()):
            self.spark.sql(f"DROP TEMPORARY VARIABLE IF EXISTS {name}")

    def add(self, table: pa.Table, types: dict[str, str]) -> None:
        self.spark.createDataFrame(table).createOrReplaceTempView(self.tag)
        for column, kind in types.items():
            self.names[column] = name = f"{self.tag}_{column}"
            self.spark.sql(f"DECLARE OR REPLACE VARIABLE {name} {kind}")
            self.spark.sql(f"SET VAR {name} = (SELECT {column} FROM {self.tag})")
        self.spark.catalog.dropTempView(self.tag)

    def bound(self, body: str) -> str:
        """``body`` with ``m`` as the struct of all constants."""
        return _let(f"named_struct({', '.join(f"'{c}', {v}" for c, v in self.names.items())})", "m", body)


@functools.lru_cache(2)
def _token_places(data: bytes) -> list[tuple[int, str, int]]:
    """Bucket, text and id of every token that can be a word of a text (half a character can't)."""
    return [(_word_bucket(token), token.decode(), rank) for token, rank in ranks_of(data).items() if token.decode(errors="ignore").encode() == token]


def _words(data: bytes, spelled: list[tuple[str, list[int]]]) -> pa.Table:
    """One row: the ids of every word that is a token or among ``spelled``, in maps in buckets."""
    words: list[list] = [[] for _ in range(WORD_BUCKETS)]
    for place, token, rank in _token_places(data):
        words[place].append((token, [rank]))
    for word, ids in spelled:
        words[_word_bucket(word.encode())].append((word, ids))
    return pa.table({"words": pa.array([words], pa.list_(pa.map_(pa.string(), pa.list_(pa.int32()))))})


def _halves(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """What is left of a token's bytes when all merges below its own rank are made."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        low, i = min((ranks.get(parts[i] + parts[i + 1], ranks[token]), i) for i in range(len(parts) - 1))
        if low >= ranks[token]:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


@functools.lru_cache(2)
def _merges(data: bytes) -> pa.Table:
    """One row: what a fold needs.  Texts are bytes read as Latin-1."""
    ranks = ranks_of(data)
    if max(ranks.values()) >= SURROGATES - BEYOND or sum(len(t) == 1 for t in ranks) < 256:
        raise ValueError(f"a token for every byte and ids below {SURROGATES - BEYOND} are expected")
    sign = lambda token: token.decode("latin-1") if len(token) == 1 else chr(BEYOND + ranks[token])
    count = max(ranks.values()) + 1
    pairs, ids, widths = [""] * count, [0] * (BEYOND + count), [0] * count
    found: dict[int, list[int]] = {}
    for token, rank in ranks.items():
        ids[ord(sign(token))], widths[rank] = rank, len(token)
        if len(token) > 1:
            halves = _halves(token, ranks)
            if len(halves) != 2:
                raise ValueError(f"token {rank} is made by no single merge")
            pairs[rank] = "".join(map(sign, halves))
            found.setdefault(_word_bucket(token[:PART].decode("latin-1").encode(), PART_BUCKETS), []).append(rank)
    places = [-1] * PART_BUCKETS
    for group, place in enumerate(found):
        places[place] = group
    parts = [[begin << 3 | length for length in range(2, PART + 1) for begin in range(1, n - length + 2)] for n in range(TABLED + 1)]
    row = {
        "parts": (parts, pa.list_(pa.int32())), "places": (places, pa.int32()), "groups": (list(found.values()), pa.list_(pa.int32())),
        "pairs": (pairs, pa.string()), "made": ([chr(BEYOND + i) for i in range(count)], pa.string()), "ids": (ids, pa.int32()), "widths": (widths, pa.int32()),
    }
    return pa.table({name: pa.array([value], pa.list_(kind)) for name, (value, kind) in row.items()})


WORDS_TYPE = {"words": "ARRAY<MAP<STRING, ARRAY<INT>>>"}
MERGES_TYPES = {
    # first character << 3 | length of every part of a word, by the word's length; the place in groups, or -1, by a part's hash;
    # the tokens of that hash
    "parts": "ARRAY<ARRAY<INT>>", "places": "ARRAY<INT>", "groups": "ARRAY<ARRAY<INT>>",
    # by id: the characters of the two tokens that are merged, that of the new one, its bytes; by character: the id
    "pairs": "ARRAY<STRING>", "made": "ARRAY<STRING>", "widths": "ARRAY<INT>", "ids": "ARRAY<INT>",
}


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _begin(element: str) -> str:
    return f"shiftright({element}, {OFFSET})"


def _ids(elements: str) -> str:
    return f"transform({elements}, e -> e & {ID})"


def _fold(text: str) -> str:
    """The ids of a word (a name of its bytes as Latin-1): its merges, lowest rank first, each wherever its pair stands."""
    size = f"length({text})"
    place = lambda part: f"get(m.places, hash({part}) & {PART_BUCKETS - 1})"
    few = f"transform(get(m.parts, {size}), k -> {place(f'substring({text}, shiftright(k, 3), k & 7)')})"
    parts = f"flatten(transform(sequence(2, {PART}), n -> transform(sequence(1, {size} - n + 1), i -> substring({text}, i, n))))"
    many = f"array_distinct(transform(array_distinct({parts}), p -> {place('p')}))"
    ranks = f"flatten(transform(array_remove(if({size} <= {TABLED}, {few}, {many}), -1), g -> get(m.groups, g)))"
    merged = f"aggregate(sort_array({ranks}), {text}, (s, r) -> replace(s, get(m.pairs, r), get(m.made, r)))"
    return _let(merged, "s", "transform(sequence(1, length(s)), i -> get(m.ids, ascii(substring(s, i, 1))))")


def _placed(ids: str) -> str:
    """The elements of a window's ids."""
    end = "coalesce(get(a, size(a) - 1), 0)"
    begin = f"if(size(a) = 0, 0, {_begin(end)} + get(m.widths, {end} & {ID}))"
    return f"aggregate({ids}, cast(array() as array<int>), (a, e) -> array_append(a, shiftleft({begin}, {OFFSET}) | e))"


def _blocks(text: str) -> str:
    """Ids of a long word (a name of its bytes as Latin-1), folded in windows; null if a seam fails its test."""
    n, none = f"length({text})", "cast(array() as array<int>)"
    at_end = f"(s.pos + {WINDOW} >= {n})"
    kept = f"if({at_end}, size(s.x), size(filter(s.x, e -> {_begin('e')} < {HALF})))"
    second = f"coalesce({_begin('get(s.x, 1)')}, {n} - s.pos)"
    two = _let(f"substring({text}, s.last + 1, s.pos - s.last + {second})", "u", _let(_fold("u"), "y", "size(y) = 2 and get(m.widths, y[0]) = s.pos - s.last"))
    fill = f"named_struct('pos', s.pos, 'last', s.last, 'ok', s.ok, 'out', s.out, 'x', {_let(f'substring({text}, s.pos + 1, {WINDOW})', 'u', _placed(_fold('u')))})"
    take = (
        f"named_struct('pos', if({at_end}, {n}, s.pos + {_begin(f'get(s.x, {kept})')}), 'last', s.pos + {_begin(f'get(s.x, {kept} - 1)')}, 'ok', s.ok and (s.pos = 0 or {two}),"
        f" 'out', concat(s.out, array({_ids(f'slice(s.x, 1, {kept})')})), 'x', {none})"
    )
    step = f"if(s.pos >= {n} or not s.ok, s, if(turn % 2 = 0, {fill}, {take}))"
    start = f"named_struct('pos', 0, 'last', 0, 'ok', true, 'out', cast(array() as array<array<int>>), 'x', {none})"
    return f"aggregate(sequence(2, 2 * ({n} div {HALF} + 1) + 1), {start}, (s, turn) -> {step}, s -> if(s.ok, flatten(s.out), null))"


def _spell(word: str) -> str:
    """The ids of a word that is no token."""
    whole = _fold("b")
    return _let(f"decode(encode({word}, 'UTF-8'), 'ISO-8859-1')", "b", f"if(length(b) <= {WINDOW}, {whole}, coalesce({_blocks('b')}, {whole}))")


def _token(word: str) -> str:
    return f"element_at(get(m.words, hash({word}) & {WORD_BUCKETS - 1}), {word})"


def _cut(text: str) -> str:
    return f"regexp_extract_all({text}, r\"{JAVA_PATTERN}\", 0)"


def _encode_sql(text: str) -> str:
    """Ids of a text; ``m`` is the struct of constant maps."""
    known = f"transform(ws, w -> {_token('w')})"
    rest = "array_distinct(filter(ws, (w, i) -> get(r, i) is null))"
    spelled = f"map_from_arrays(d, transform(d, w -> {_spell('w')}))"
    each = "flatten(transform(r, (x, i) -> coalesce(x, element_at(o, get(ws, i)))))"
    stretch = _let(known, "r", _let(rest, "d", _let(spelled, "o", each)))
    stretches = f"transform(sequence(0, (size(all) - 1) div {STRETCH}), i -> slice(all, cast(i * {STRETCH} + 1 as int), {STRETCH}))"
    return _let(_cut(text), "all", f"flatten(transform({stretches}, ws -> {stretch}))")


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key`` and ``ids`` (array of int) of every row, without special tokens.

    A null text has null ids, an empty text an empty array.  Strings that look like
    special tokens are ordinary text.  Every row of ``documents`` gives a row, repeated
    ones too; other columns are ignored.
    """
    data = read_vocabulary(path or vocabulary_path())
    if max(map(len, ranks_of(data))) > WINDOW - HALF:
        raise ValueError(f"tokens of at most {WINDOW - HALF} bytes are expected")
    rows = documents.select(documents[key].alias("k"), documents[text].alias("t"))
    with Constants(documents.sparkSession) as constants:
        constants.add(_merges(data), MERGES_TYPES)
        constants.add(_words(data, []), WORDS_TYPE)
        some = f"filter(array_distinct({_cut('t')}), w -> octet_length(w) <= {SHORT} and {_token('w')} is null)"
        # the limit stops the scan after its first rows; SAMPLE words of SHORT bytes at most reach the driver
        seen = Counter(r[0] for r in rows.filter("t <> ''").select(F.explode(F.expr(constants.bound(some)))).limit(SAMPLE).collect())
        top = sorted((w for w, n in seen.items() if n > 1), key=lambda w: (-seen[w], w))[:FREQUENT]
        if top:
            words = spread(documents.sparkSession.createDataFrame(pa.table({"w": top})))
            constants.add(_words(data, [(r["w"], list(r["ids"])) for r in words.select("w", F.expr(constants.bound(_spell("w"))).alias("ids")).collect()]), WORDS_TYPE)
        ids = f"if(t is null, null, if(t = '', cast(array() as array<int>), {constants.bound(_encode_sql('t'))}))"
        return spread(rows).select(F.col("k").alias(key), F.expr(ids).alias("ids"))


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """``key`` and ``text``: the tokens' binary pieces concatenated; null for null ids."""
    data = read_vocabulary(path or vocabulary_path())
    pieces = [t for t, _ in sorted(ranks_of(data).items(), key=lambda x: x[1])]
    with Constants(encoded.sparkSession) as constants:
        constants.add(pa.table({"pieces": pa.array([pieces], pa.list_(pa.binary()))}), {"pieces": "ARRAY<BINARY>"})
        joined = constants.bound(f"decode(unhex(array_join(transform(`{ids}`, i -> hex(get(m.pieces, i))), '')), 'UTF-8')")
        return encoded.select(key, F.expr(f"if(`{ids}` is null, null, {joined})").alias("text"))
