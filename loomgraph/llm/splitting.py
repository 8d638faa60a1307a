"""Splitting oversized texts at natural boundaries, with overlap, by tokens.

Method: bounded-quantifier regular expressions.  Every text is turned into a string of
marks, one letter a token, that says what ends with the token: P a paragraph, L a line,
S a sentence, C a clause, W a word, c a character, x nothing (half a character).  An
expression whose alternatives stand in order of strength, ``.{h,n}P|.{h,n}L|...``,
consumes up to n tokens a match, with any character as the last resort;
``regexp_extract_all`` gives the pieces, array functions turn their lengths into
offsets, and looking back ``overlap`` tokens from a piece's start gives the overlap.
A byte-pair word cut between two of its tokens encodes to the same tokens, so a piece
has as many tokens as marks.  A text is split where it lies: nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.llm.bpe import encoder, ranks_of, read_vocabulary, vocabulary_path
from loomgraph.workspace import spread

#: Strong boundaries count from this share of a piece's room on.
FILL = 0.5
BATCH_TOKENS = 1 << 22
#: Offsets are summed up in chunks of so many pieces and over the chunks.
CHUNK = 128


def _table(members: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(members)] = True
    return t


_KIND = np.full(256, 3, np.uint8)  # 0 white space, 1 digit, 2 letter (or a part of one), 3 other
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[48:58] = 1
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 2
_STOP, _CLOSE, _CLAUSE = _table(b".!?"), _table(b"\"')]"), _table(b",;:")


def marks_of(raw: np.ndarray, ends: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The mark of each token: ``raw`` bytes of all texts, ``ends`` the tokens' ends in it, ``last`` the places of the texts' last tokens."""
    pad = np.concatenate([np.zeros(2, np.uint8), raw, np.full(1, 32, np.uint8)])
    # bytes before (one, two, three) and after each boundary
    three, two, one, after = pad[ends - 1], pad[ends], pad[ends + 1], pad[ends + 2]
    before, behind = _KIND[one], _KIND[after]
    blank = behind == 0
    m = np.full(len(ends), ord("c"), np.uint8)
    m[(before != behind) | (before == 0)] = ord("W")
    m[_CLAUSE[one] & blank] = ord("C")
    m[(_STOP[one] | (_CLOSE[one] & _STOP[two])) & blank] = ord("S")
    cjk = np.flatnonzero((three == 0xE3) & (two == 0x80) | (three == 0xEF) & (two == 0xBC))  # full-width stops and commas
    x, y = three[cjk], one[cjk]
    m[cjk[(x == 0xE3) & (y == 0x82) | (x == 0xEF) & ((y == 0x81) | (y == 0x9F))]] = ord("S")
    m[cjk[(x == 0xE3) & (y == 0x81) | (x == 0xEF) & (y == 0x8C)]] = ord("C")
    line = np.flatnonzero((one == 10) & (after != 10))
    m[line] = ord("L")
    m[line[(two[line] == 10) | (two[line] == 13) & (three[line] == 10)]] = ord("P")
    m[((after & 0xC0) == 0x80) | (before == 3) & (after == 39)] = ord("x")  # inside a character, or before what might read as 's
    m[last] = ord("P")
    return m


def marked(documents: DataFrame, least: int, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """k, t, marks, ends (byte offset after each token) of the texts with more than ``least`` tokens."""
    data = read_vocabulary(path or vocabulary_path())

    def run(batches):
        e = encoder(data)
        width = np.zeros(1 << 16, np.int64)
        for token, rank in ranks_of(data).items():
            width[rank] = len(token)

        def emit(keys, texts, ids):
            counts = np.array([len(i) for i in ids], np.int64)
            stops = np.cumsum(counts)
            ends = np.cumsum(width[np.concatenate(ids)])
            joined = "".join(texts).encode()
            m = marks_of(np.frombuffer(joined, np.uint8), ends, stops - 1)
            offsets = np.concatenate([[0], stops]).astype(np.int32)
            began = np.concatenate([[0], ends[stops - 1]]).astype(np.int32)
            own = ends.astype(np.int32) - np.repeat(began[:-1], counts)
            binary = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(began), pa.py_buffer(joined)])
            marks = pa.StringArray.from_buffers(len(ids), pa.py_buffer(offsets), pa.py_buffer(m))
            return pa.record_batch([keys, binary, marks, pa.ListArray.from_arrays(pa.array(offsets), pa.array(own))], names=["k", "t", "marks", "ends"])

        for b in batches:
            where, texts, ids, held = [], [], [], 0
            for i, t in enumerate(b.column(1).to_pylist()):
                if t and len((x := e.encode(t))) > least:
                    where.append(i)
                    texts.append(t)
                    ids.append(np.fromiter(x, np.int32, len(x)))
                    held += len(x)
                    if held > BATCH_TOKENS:
                        yield emit(b.column(0).take(pa.array(where)), texts, ids)
                        where, texts, ids, held = [], [], [], 0
            if where:
                yield emit(b.column(0).take(pa.array(where)), texts, ids)

    rows = documents.select(documents[key].alias("k"), documents[text].alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    return spread(rows).mapInArrow(run, f"k {kind}, t binary, marks string, ends array<int>")


def _expression(first: int, further: int) -> str:
    def up_to(n: int) -> str:
        h = max(0, int(n * FILL) - 1)
        strong = [f".{{{h},{n - 1}}}{mark}" for mark in ("P", "L", "S", "C")]
        return "|".join([f".{{1,{n}}}$", *strong, f".{{0,{n - 1}}}[PLSCW]", f".{{0,{n - 1}}}[^x]", f".{{1,{n}}}"])

    return f"^(?:{up_to(first)})|(?:{up_to(further)})"


def _running_sums(lengths: Column) -> Column:
    """The sums of the first 1, 2, ... elements.  Building an array step by step copies it at each step, so that is done for short ones only."""
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0))
    grow = lambda a, n: F.concat(a, F.array(last(a) + n))
    none = F.array().cast("array<int>")
    chunked = lambda x: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(x) - 1) / CHUNK).cast("int")), lambda c: F.aggregate(F.slice(x, c * CHUNK + 1, F.lit(CHUNK)), none, grow)
    )
    before = lambda sums: F.slice(F.aggregate(sums, F.array(F.lit(0)), lambda a, x: grow(a, last(x))), F.lit(1), F.size(sums))
    joined = lambda sums: F.flatten(F.zip_with(sums, before(sums), lambda x, at: F.transform(x, lambda v: v + at)))
    sums = F.transform(F.array(lengths), chunked)  # bound once, used twice
    return F.transform(sums, joined)[0]


def _pieces(limit_id: int, most: int, overlap: int) -> Column:
    """Array of the pieces of the row's text at one limit; empty if the text is within it."""
    cut = F.transform(F.regexp_extract_all("marks", F.lit(_expression(most, most - overlap)), F.lit(0)), F.length)
    ends = _running_sums(cut)
    # each step binds what the next one uses more than once: ends -> where the last piece ended -> start -> byte offsets
    spans = F.transform(F.array(ends), lambda z: F.transform(z, lambda end, i: F.struct(i.alias("i"), end.alias("end"), F.when(i > 0, F.get(z, i - 1)).otherwise(F.lit(0)).alias("before"))))[0]

    def started(x: Column) -> Column:
        back = F.greatest(x["before"] - overlap, F.lit(0))
        start = x["before"] if not overlap else F.when(back > 0, F.least(back + F.length(F.regexp_extract(F.substring(F.col("marks"), back, F.lit(4)), "^x*", 0)), x["before"])).otherwise(back)
        return F.struct(x["i"].alias("i"), x["end"].alias("end"), x["before"].alias("before"), start.alias("start"))

    def placed(x: Column) -> Column:
        lo = F.when(x["start"] > 0, F.get("ends", x["start"] - 1)).otherwise(F.lit(0))
        return F.struct(x["i"].alias("i"), x["end"].alias("end"), x["before"].alias("before"), x["start"].alias("start"), lo.alias("lo"))

    def piece(x: Column) -> Column:
        return F.struct(
            F.lit(limit_id).alias("limit_id"), x["i"].alias("piece"), x["start"].alias("first_token"), (x["end"] - x["start"]).alias("n_tokens"), (x["before"] - x["start"]).alias("shared_tokens"),
            F.substring("t", x["lo"] + 1, F.get("ends", x["end"] - 1) - x["lo"]).cast("string").alias("text"),
        )

    whole = F.transform(F.transform(F.transform(spans, started), placed), piece)
    return F.when(F.length("marks") > most, whole)


def split(documents: DataFrame, limits: list[tuple[int, int, int]], key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """limit_id, ``key``, piece, first_token, n_tokens, shared_tokens, text of the texts above a limit.

    ``limits`` are (limit_id, max_tokens, overlap_tokens), a few.  Pieces are numbered
    from 0; each has at most ``max_tokens`` tokens and begins ``overlap_tokens`` before
    the last one's end (up to 3 tokens later where that would be inside a character).
    Without the shared tokens the pieces join to the text.  Texts within a limit,
    empty and null texts give no piece at it.  Repeated rows give repeated pieces.
    """
    for _, most, overlap in limits:
        if not 0 <= overlap < most:
            raise ValueError("an overlap is at least 0 and below the limit")
    rows = marked(documents, min(m for _, m, _ in limits), key, text, path)
    got = rows.select("k", "t", "marks", "ends", F.explode(F.array_compact(F.array(*[_pieces(*x) for x in limits]))).alias("p"))
    return got.select("k", F.explode("p").alias("p")).select(
        "p.limit_id", F.col("k").alias(key), "p.piece", "p.first_token", "p.n_tokens", "p.shared_tokens", F.col("p.text").alias(text)
    )
