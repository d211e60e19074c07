"""Encoding a corpus with a public byte-level tokenizer, and splitting what is too long."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kinweave.runtime import Shelf, rows_of, ship

DEFAULT_TOKENIZER = os.environ.get("KINWEAVE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")

#: The tokenizer's published pre-split: contractions, words, numbers, other signs (each with one space
#: before), white space.  Fixed value.
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same in the JVM's dialect: \s there is ASCII only, and possessive runs keep long texts off the stack.
_JVM_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}++| ?\p{N}++| ?[^\p{IsWhite_Space}\p{L}\p{N}]++|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"

#: Word occurrences that share one dictionary; bounds a task's memory and the size of a dictionary.
CHUNK_WORDS = 2_000_000
#: Stretches whose rows of one word may meet in one task.
STRETCHES = 100_000

_loaded: dict[str, tuple] = {}


def load(path: str) -> tuple:
    """(tiktoken encoding, bytes of each id) of a rank file, once per process."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        enc = tiktoken.Encoding(os.path.basename(path), pat_str=PRE_SPLIT, mergeable_ranks=ranks, special_tokens={})
        _loaded[path] = (enc, {i: b for b, i in ranks.items()})
    return _loaded[path]


def split_words(text: Column) -> Column:
    """The pre-split words of a text; they concatenate to the text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_JVM_SPLIT), F.lit(0))


def _chunk_schema(kind: str) -> str:
    return f"chunk long, doc binary, ends array<int>, at array<int>, held array<{kind}>"


def _chunked(doc_type: pa.DataType, value_type: pa.DataType, most: int):
    """Batches of (doc, values) to rows of one dictionary each: the distinct values, and every document's places in it.

    Documents are added to a chunk as long as it holds at most ``most`` values, wherever Arrow batches end; a longer
    document is a chunk of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, size, n = TaskContext.get().partitionId(), [], 0, 0

        def flush():
            nonlocal held, size, n
            docs = pa.concat_arrays([d for d, _ in held])
            lists = pa.concat_arrays([w for _, w in held])
            coded = lists.flatten().dictionary_encode()
            ends = np.cumsum(np.diff(lists.offsets.to_numpy()), dtype=np.int64).astype(np.int32)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("doc", doc_type)])) as w:
                w.write_batch(pa.RecordBatch.from_arrays([docs], names=["doc"]))
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            chunk = (part << 32) + n
            out = [pa.array([chunk], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), one(pa.array(ends)), one(coded.indices.cast(pa.int32())), one(coded.dictionary.cast(value_type))]
            held, size, n = [], 0, n + 1
            return pa.RecordBatch.from_arrays(out, names=["chunk", "doc", "ends", "at", "held"])

        for b in batches:
            values = b.column(1)
            values = values if isinstance(values, pa.ListArray) else values.cast(pa.list_(value_type))
            upto = values.offsets.to_numpy().astype(np.int64)
            at = 0
            while at < len(values):
                fit = int(np.searchsorted(upto, upto[at] + most - size, side="right")) - 1  # documents that still fit
                if fit <= at:
                    if held:
                        yield flush()
                        continue
                    fit = at + 1
                held.append((b.column(0).slice(at, fit - at), values.slice(at, fit - at)))
                size += int(upto[fit] - upto[at])
                at = fit
        if held:
            yield flush()

    return run


def _placed(chunks: DataFrame, value: str) -> DataFrame:
    return chunks.select("chunk", F.posexplode("held").alias("place", value))


def _join_back(chunks: DataFrame, met: DataFrame, value: str, kind: str) -> DataFrame:
    """Every chunk with the (place, value) pairs of its dictionary; no more rows are shuffled than dictionaries hold."""
    back = met.groupBy("chunk").agg(F.collect_list(F.struct("place", value)).alias("packed"))
    whole = chunks.select("chunk", "doc", "ends", "at").join(back, "chunk", "left")
    return whole.select("doc", "ends", "at", F.coalesce("packed", F.array().cast(f"array<struct<place:int,{value}:{kind}>>")).alias("packed"))


def _encode_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, _ = load(path)
        for b in batches:
            # a word is one unit of the pre-split, so it is encoded alone; strings like special tokens are ordinary text
            ids = [enc.encode_ordinary(w) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    return run


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, pa.Array]]:
    """Of every chunk: its documents, the places where each ends, and the joined values by place of every value."""
    for b in batches:
        for i in range(b.num_rows):
            docs = pa.ipc.open_stream(b.column(0)[i].as_buffer()).read_all().column(0).combine_chunks()
            docs = docs.chunk(0) if isinstance(docs, pa.ChunkedArray) else docs
            ends = np.concatenate([[0], b.column(1)[i].values.to_numpy()]).astype(np.int64)
            packed = b.column(3)[i].values  # structs (place, value)
            order = np.argsort(packed.field(0).to_numpy(), kind="stable")
            yield docs, ends, packed.field(1).take(pa.array(order)).take(b.column(2)[i].values)


def _fill_ids(doc_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, ends, per_word in _filled(batches):
            offs = per_word.offsets.to_numpy()
            ids = pa.ListArray.from_arrays(pa.array(offs[ends] - offs[0], pa.int32()), per_word.flatten())
            yield pa.RecordBatch.from_arrays([docs, ids], names=[doc_name, "ids"])

    return run


def _fill_text(doc_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, ends, pieces in _filled(batches):
            offs = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1]
            raw, at = (pieces.buffers()[2] or pa.py_buffer(b"")).to_pybytes(), offs[ends]
            texts = [raw[x:y].decode("utf-8", "replace") for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([docs, pa.array(texts, pa.string())], names=[doc_name, "text"])

    return run


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = DEFAULT_TOKENIZER, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(id, ids): the token ids of every row's text, without special tokens.

    A null and an empty text give the empty list; every row gives one row,
    repeated and null ids included; texts of any length; other columns are
    ignored; an empty table gives an empty result.

    Words are split in the JVM.  Tasks turn stretches of documents (at most
    ``chunk_words`` words, a longer document alone) into places in a stretch
    dictionary, so a word as frequent as "the" is shuffled once per stretch and
    not once per occurrence; each distinct word of the corpus is encoded once;
    the ids come back to the stretches by (stretch, place), and documents are
    filled from them in Arrow.  A word has one row a stretch at most; beyond
    STRETCHES stretches its rows are dealt over several keys.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    ship(spark)
    shelf = Shelf(spark, "encode")
    kind = docs.schema[id_col].dataType
    pairs = docs.select(F.col(id_col).alias("doc"), split_words(F.col(text_col)).alias("words"))
    chunks = shelf.put(pairs.mapInArrow(_chunked(to_arrow_type(kind), pa.string(), chunk_words), _chunk_schema("string")), "chunks")
    placed = _placed(chunks, "word")
    coded = placed.select("word").distinct().mapInArrow(_encode_words(tokenizer), "word string, ids array<int>")
    deals = rows_of(chunks) // STRETCHES + 1  # rows of a word that one key holds: at most about STRETCHES
    if deals > 1:
        placed = placed.withColumn("deal", F.pmod(F.xxhash64("chunk"), F.lit(deals)))
        coded = coded.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deals - 1).cast("long"))))
    met = placed.join(coded, ["word", "deal"] if deals > 1 else "word")
    return _join_back(chunks, met, "ids", "array<int>").mapInArrow(_fill_ids(id_col), f"`{id_col}` {kind.simpleString()}, ids array<int>")


def pieces_table(spark: SparkSession, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(id, piece): the bytes of every token id."""
    _, by_id = load(tokenizer)
    return spark.createDataFrame([(i, bytearray(b)) for i, b in sorted(by_id.items())], "id int, piece binary")


def decode_corpus(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", tokenizer: str = DEFAULT_TOKENIZER, chunk_ids: int = CHUNK_WORDS) -> DataFrame:
    """(id, text) from token ids, by a join with the id-to-piece table.

    Every row gives one row, repeated and null ids included.  Null or empty
    lists give the empty text; ids outside the vocabulary are skipped; bytes
    that are no UTF-8 become U+FFFD; an empty table gives an empty result.

    Like encoding: tasks turn stretches of at most ``chunk_ids`` token ids into
    dictionaries, each dictionary's distinct ids meet the pieces (a table as
    large as the vocabulary, broadcast), and the pieces are put in their places.
    No row is made for a single token.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = encoded.sparkSession
    ship(spark)
    shelf = Shelf(spark, "decode")
    kind = encoded.schema[id_col].dataType
    known = F.filter(F.coalesce(F.col(ids_col), F.array()).cast("array<int>"), lambda x: x.isNotNull())
    pairs = encoded.select(F.col(id_col).alias("doc"), known.alias("ids"))
    chunks = shelf.put(pairs.mapInArrow(_chunked(to_arrow_type(kind), pa.int32(), chunk_ids), _chunk_schema("int")), "chunks")
    pieces = F.broadcast(pieces_table(spark, tokenizer))
    met = _placed(chunks, "id").join(pieces, "id", "left").select("chunk", "place", F.coalesce("piece", F.lit(b"")).alias("piece"))
    return _join_back(chunks, met, "piece", "binary").mapInArrow(_fill_text(id_col), f"`{id_col}` {kind.simpleString()}, text string")


# ---------------------------------------------------------------------------------------------------------------
# Splitting oversized items at natural boundaries

_BLANK, _LINE, _SENTENCE, _SPACE, _NONE, _NEVER = 5, 4, 3, 2, 1, 0


def boundary_strengths(raw: bytes, starts: np.ndarray) -> np.ndarray:
    """Strength of a cut before each byte offset: blank line > line end > sentence end > space > none > inside a character."""
    b = np.frombuffer(raw, np.uint8)
    n = len(b)
    is_nl = (b == 10) | (b == 13) | (b == 12)
    blank = (b == 32) | (b == 9) | is_nl | (b == 11)
    stop = (b == 46) | (b == 33) | (b == 63)
    at = np.clip(starts, 0, n)
    prev = np.clip(at - 1, 0, max(n - 1, 0))
    nxt = np.clip(at, 0, max(n - 1, 0))
    # of each byte: the last byte at or before it that is no white space
    solid = np.maximum.accumulate(np.where(blank, -1, np.arange(n)))
    lines = np.concatenate([[0], np.cumsum(is_nl & ~((b == 10) & np.concatenate([[False], b[:-1] == 13])))])
    last_solid = solid[prev]
    newlines = lines[at] - lines[np.clip(last_solid + 1, 0, n)]
    after_space = blank[prev]
    ends_line = is_nl[prev]
    ends_sentence = (last_solid >= 0) & stop[np.clip(last_solid, 0, None)]
    at_space = after_space | blank[nxt]
    out = np.full(len(starts), _NONE, np.int64)
    out[at_space] = _SPACE
    out[at_space & ends_sentence] = _SENTENCE
    out[ends_line] = _LINE
    out[ends_line & (newlines >= 2)] = _BLANK
    out[(b[nxt] & 0xC0) == 0x80] = _NEVER
    return out


class RangeMax:
    """Sparse table for range maxima over codes (strength, place): the strongest cut, rightmost among equals.

    Level k holds maxima over 2^k places; a query of any length takes two
    overlapping entries.  Levels are built when first asked for.
    """

    def __init__(self, strengths: np.ndarray):
        self.levels = {0: strengths * np.int64(1 << 40) + np.arange(len(strengths), dtype=np.int64)}

    def _level(self, k: int) -> np.ndarray:
        if k not in self.levels:
            below, half = self._level(k - 1), 1 << (k - 1)
            self.levels[k] = np.maximum(below[:-half], below[half:]) if len(below) > half else below[:0]
        return self.levels[k]

    def best(self, lo: int, hi: int) -> tuple[int, int]:
        """(strength, place) of the strongest place in lo..hi, both included."""
        k = (hi - lo + 1).bit_length() - 1
        t = self._level(k)
        code = int(max(t[lo], t[hi - (1 << k) + 1]))
        return code >> 40, code & ((1 << 40) - 1)


def split_text(text: str, enc, byte_len: np.ndarray, max_tokens: int, overlap: int) -> list[tuple[str, int]]:
    """(piece, its tokens) of one text; empty if the text fits."""
    ids = enc.encode_ordinary(text)
    n = len(ids)
    if n <= max_tokens:
        return []
    raw = text.encode("utf-8", "replace")
    offs = np.concatenate([[0], np.cumsum(byte_len[np.asarray(ids, np.int64)])])
    strength = boundary_strengths(raw, offs[:-1])
    index = RangeMax(strength)
    out, start = [], 0
    least = max(overlap + 1, max_tokens // 2)
    while True:
        span = max_tokens
        while True:
            if n - start <= span:
                cut = n
            else:
                lo, hi = start + min(least, span), start + span
                s, cut = index.best(lo, hi)
                if s <= _NONE and lo > start + overlap + 8:  # nothing natural there: look nearer to the start
                    s2, cut2 = index.best(start + overlap + 8, lo)
                    if s2 > _NONE:
                        s, cut = s2, cut2
            piece = raw[offs[start] : offs[cut]].decode("utf-8", "replace")
            size = len(enc.encode_ordinary(piece))  # a cut can change how its surroundings are encoded
            if size <= max_tokens:
                break
            span = min(span, cut - start) - (size - max_tokens)
            if span <= overlap + 8:  # as many bytes as tokens are allowed always fit
                cut = int(np.searchsorted(offs, offs[start] + max_tokens, "right")) - 1
                while cut > start + 1 and cut < n and strength[cut] == _NEVER:
                    cut -= 1
                piece = raw[offs[start] : offs[cut]].decode("utf-8", "replace")
                size = len(enc.encode_ordinary(piece))
                break
        out.append((piece, size))
        if cut == n:
            return out
        back, start = start, cut - overlap
        while start > 0 and strength[start] == _NEVER:
            start -= 1
        start = max(start, back + 1)  # only where the overlap is wider than what fits


def split_oversized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 2500, overlap: int = 200, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(id, piece_no, piece, n_tokens): the pieces of every text of more than ``max_tokens`` tokens.

    Piece numbers start at 1.  A piece ends at the strongest boundary (blank
    line, line end, sentence end, space) in its second half, at the rightmost of
    equals; only where there is none there, at one nearer to its start, and only
    where there is none at all, between two characters.  Each piece repeats the
    last ``overlap`` tokens of the one before (up to three more where these
    would begin inside a character).  Null, empty and fitting texts give no row;
    repeated rows are each cut; other columns are ignored.

    A token is at least one byte, so texts of at most ``max_tokens`` bytes are
    left out by the scan itself, without loss.
    """
    if overlap + 32 >= max_tokens:
        raise ValueError("the overlap must be clearly smaller than the limit")
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, by_id = load(tokenizer)
        byte_len = np.zeros(max(by_id) + 1, np.int64)
        for i, b in by_id.items():
            byte_len[i] = len(b)
        for b in batches:
            rows, nos, pieces, sizes = [], [], [], []
            for r, text in enumerate(b.column(1).to_pylist()):
                for k, (piece, size) in enumerate(split_text(text, enc, byte_len, max_tokens, overlap), 1):
                    rows.append(r)
                    nos.append(k)
                    pieces.append(piece)
                    sizes.append(size)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(nos, pa.int32()), pa.array(pieces, pa.string()), pa.array(sizes, pa.int32())], names=[id_col, "piece_no", "piece", "n_tokens"])

    long = docs.filter(F.octet_length(F.col(text_col)) > max_tokens).select(F.col(id_col), F.col(text_col))
    return long.mapInArrow(run, f"`{id_col}` {kind.simpleString()}, piece_no int, piece string, n_tokens int")
