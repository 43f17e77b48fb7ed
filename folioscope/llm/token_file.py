"""Token files: frequency-ranked ids in a byte-aligned variable-length code.

Below ``blocks`` there is a folder for each range of document ids, in ascending
order.  Its files are sequences of blocks, each closed by a newline.  A block
holds documents that follow each other:

    magic "TOKB", then little-endian: 32-bit format version, 32-bit number of
    documents, 64-bit number of the first document in its range, 64-bit number
    of ids, 64-bit data bytes; the document ids (64-bit each) and id counts
    (64-bit each); the control bytes; the data bytes.

A control byte tells the lengths of four codes, two bits each, first code in
the lowest bits.  Codes are the ranks of token ids by frequency, with 1 to 4
bytes, lowest first.  The ranking is a table of its own beside the blocks.
"""

from __future__ import annotations

import json
import math
import os
import re
import string
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import new_run_dir, settle
from .bpe import pieces
from .worker import kept

MAGIC, VERSION = b"TOKB", 1
HEAD = "<4sIIQQQ"
BLOCK_TOKENS = 1_000_000
CACHED_WORDS = 300_000  # in each half of a worker's cache
WORDS_AT_ONCE = 500  # in a call of the library
TEXT_BYTES = 8_000_000  # of which equal pieces are looked up once

# Lengths of the four codes of every control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.int64) + 1


# -- code ---------------------------------------------------------------------


def encode_codes(codes: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of non-negative codes below 2 ** 32."""
    codes = codes.astype(np.uint32)
    lengths = 1 + (codes >= 1 << 8).astype(np.int64) + (codes >= 1 << 16) + (codes >= 1 << 24)
    padded = np.ones(-(-len(codes) // 4) * 4, np.int64)
    padded[: len(codes)] = lengths
    control = ((padded - 1).reshape(-1, 4) << np.array([0, 2, 4, 6])).sum(axis=1).astype(np.uint8)
    wide = codes.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), wide[np.arange(4) < lengths[:, None]].tobytes()


def decode_codes(control: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    """The codes again: lengths by table lookup, places by running sum."""
    lengths = LENGTHS[control].reshape(-1)[:count]
    starts = np.cumsum(lengths) - lengths
    codes = np.zeros(count, np.uint32)
    for k in range(int(lengths.max(initial=0))):
        longer = lengths > k
        codes[longer] |= data[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return codes


def pack_block(first: int, doc_ids: np.ndarray, counts: np.ndarray, codes: np.ndarray) -> bytes:
    control, data = encode_codes(codes)
    head = struct.pack(HEAD, MAGIC, VERSION, len(doc_ids), first, len(codes), len(data))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), counts.astype("<i8").tobytes(), control, data])


def unpack_blocks(content) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """First number, document ids, id counts and codes of each block of a file."""
    at = 0
    while at < len(content):
        magic, version, docs, first, tokens, size = struct.unpack_from(HEAD, content, at)
        if magic != MAGIC or version != VERSION:
            raise ValueError("no block begins here")
        at += struct.calcsize(HEAD)
        ids = np.frombuffer(content, "<i8", docs, at)
        counts = np.frombuffer(content, "<i8", docs, at + 8 * docs)
        at += 16 * docs
        control = np.frombuffer(content, np.uint8, -(-tokens // 4), at)
        at += len(control)
        data = np.frombuffer(content, np.uint8, size, at)
        at += size
        if content[at] != 10:
            raise ValueError("a block is not closed")
        at += 1
        yield first, ids, counts, decode_codes(control, data, tokens)


# -- tokens -------------------------------------------------------------------


# Kinds of bytes that decide where words are cut.  A quotation mark is the ASCII
# apostrophe, other bytes are control characters and those of other alphabets.
SPACE, LETTER, DIGIT, MARK, QUOTE, OTHER = range(6)
KINDS = np.full(256, OTHER, np.uint8)
KINDS[list(b" \t\n\r\x0b\x0c")] = SPACE
KINDS[list(string.ascii_letters.encode())] = LETTER
KINDS[list(string.digits.encode())] = DIGIT
KINDS[list(string.punctuation.encode())] = MARK
KINDS[ord("'")] = QUOTE
# Whether a piece begins between a byte of one kind and the next (6 * kind + kind).
BEGINS = np.zeros((6, 6), bool)
BEGINS[SPACE, SPACE + 1 :] = True
BEGINS[LETTER, [DIGIT, MARK, QUOTE]] = True
BEGINS[DIGIT, [LETTER, DIGIT, MARK, QUOTE]] = True
BEGINS[MARK, [LETTER, DIGIT]] = True
BEGINS[QUOTE, DIGIT] = True
BEGINS = BEGINS.reshape(-1)
# One run of letters, one digit or one run of marks.
ONE = re.compile(
    rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|\xc5[\x80-\xbf])+|[0-9]|[!-/:-@\[-`{-~]+"
).fullmatch

# The normaliser and pattern for which words may be cut and lower-cased.
NORMALIZER = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
    {"type": "Lowercase"},
]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_kinds(data: np.ndarray) -> np.ndarray:
    """The kind of every byte of UTF-8 text; both bytes of U+00C0 to U+017F are
    letters but for the two signs there and U+0130, of which lower-casing makes
    a letter and a combining dot."""
    kinds = KINDS[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC5))
    lead = lead[lead + 1 < len(data)]
    first, second = data[lead], data[lead + 1]
    no_letter = (first == 0xC3) & ((second == 0x97) | (second == 0xB7)) | (first == 0xC4) & (second == 0xB0)
    lead = lead[~no_letter]
    kinds[lead] = LETTER
    kinds[lead + 1] = LETTER
    return kinds


class WordTokens:
    """Token ids of texts, by a tokenizer that never joins words.

    Words are what stands between ASCII white space, which the tokenizer drops.
    Where its normaliser and pattern are the ones above, words are cut further,
    at places that no match of the pattern spans (beside ASCII marks and digits,
    where nothing composes), and ASCII letters are lower-cased unless something
    may compose with them: fewer pieces differ.  Texts with a string of a special
    token keep whole words; the strings hold no white space and get their ids
    inside words too, as the library does by itself.

    Equal pieces of a batch are looked up once; the new ones are encoded together
    by the library.  A piece that is one match ends with the only id that closes
    a word; the others are told apart by the places of their tokens.  Recent
    pieces are kept; a full cache becomes the old one, from which pieces that are
    needed again come back.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.recent: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        added = made.get("added_tokens") or []
        self.special = [a["content"].encode().lower() for a in added]
        steps = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        suffix = made["model"].get("end_of_word_suffix")
        self.cuts = (
            (made.get("normalizer") or {}).get("normalizers") == NORMALIZER
            and steps[0].get("pattern") == {"Regex": PATTERN}
            and (steps[0].get("behavior"), steps[0].get("invert")) == ("Removed", True)
            and [(s["type"], s.get("use_regex")) for s in steps[1:]] == [("ByteLevel", False)]
            and bool(suffix)
            and not any(a["normalized"] or ONE(a["content"].encode()) for a in added)
        )
        if self.cuts:
            vocabulary = self.tokenizer.get_vocab()
            self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
            self.closes[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def _pieces(self, texts: pa.BinaryArray) -> tuple[pa.BinaryArray, np.ndarray]:
        """The pieces of all texts, and how many there are up to the end of each."""
        bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset :][: len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        if self.cuts:
            kinds = byte_kinds(data)
            small = data.tobytes().lower()
            for name in self.special:
                at = small.find(name)
                while at >= 0:
                    text = np.searchsorted(bounds, at, "right") - 1
                    whole = kinds[bounds[text] : bounds[text + 1]]
                    whole[whole != SPACE] = OTHER
                    at = small.find(name, max(at + 1, int(bounds[text + 1])))
            loose = kinds == LETTER  # what may be lower-cased
            loose[:-1] &= kinds[1:] != OTHER
            data = np.where(loose, np.frombuffer(small, np.uint8), data)
        else:
            kinds = np.where(KINDS[data] == SPACE, np.uint8(SPACE), np.uint8(OTHER))
        solid = kinds != SPACE
        begins = np.zeros(len(data), bool)
        begins[1:] = BEGINS[6 * kinds[:-1] + kinds[1:]]
        firsts = bounds[:-1][bounds[:-1] < len(data)]
        begins[firsts] = solid[firsts]
        upto = np.searchsorted(np.flatnonzero(begins), bounds[1:])
        body = data[solid]
        offsets = np.append(np.flatnonzero(begins[solid]), len(body)).astype(np.int32)
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(body)]
        return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, buffers), upto

    def _placed(self, words: list[bytes]) -> list[bytes]:
        texts = [w.decode() for w in words]
        found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        places = np.array(found.offsets, np.int64).reshape(-1, 2)[:, 0]
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        cuts = (4 * np.searchsorted(places, starts)).tolist()
        packed = np.array(found.ids, np.int32).tobytes()
        return [packed[a:b] for a, b in zip(cuts, cuts[1:])]

    def _closed(self, words: list[bytes]) -> list[bytes]:
        text = b" ".join(words).decode()
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
        cuts = [0, *(4 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()]
        if len(cuts) != len(words) + 1:
            return self._placed(words)
        packed = ids.tobytes()
        return [packed[a:b] for a, b in zip(cuts, cuts[1:])]

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        learnt = {}
        single = [w for w in words if ONE(w)] if self.cuts else []
        rest = list(set(words).difference(single))
        for those, encode in ((single, self._closed), (rest, self._placed)):
            for at in range(0, len(those), WORDS_AT_ONCE):
                some = those[at : at + WORDS_AT_ONCE]
                learnt.update(zip(some, encode(some)))
        return learnt

    def _known(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of distinct words."""
        found = list(map(self.recent.get, words))
        missing = [w for w, ids in zip(words, found) if ids is None]
        if missing:
            again = {w: self.old[w] for w in missing if w in self.old}
            again.update(self._learn([w for w in missing if w not in again]))
            if len(self.recent) + len(again) > CACHED_WORDS:
                self.old, self.recent = self.recent, {}
            self.recent.update(again)
            found = [again[w] if ids is None else ids for w, ids in zip(words, found)]
        return found

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: none), and how many there are up to the
        end of each."""
        cut, upto = self._pieces(texts.cast(pa.binary()).fill_null(b""))
        coded = cut.dictionary_encode()
        known = self._known(coded.dictionary.to_pylist())
        made = pa.array(known, pa.binary()).take(coded.indices)
        ends = np.frombuffer(made.buffers()[1], np.int32)[made.offset :][: len(made) + 1] // 4
        return np.frombuffer(made.buffers()[2] or b"", np.int32)[ends[0] : ends[-1]], ends[upto] - ends[0]

    def packed(self, text: str | bytes) -> bytes:
        raw = text.encode() if isinstance(text, str) else text
        return self.ids(pa.array([raw], pa.binary()))[0].tobytes()


def word_tokens(path: str) -> WordTokens:
    """The tokenizer of this worker."""
    return kept(("tokenizer", path), lambda: WordTokens(path))


TOKENS = "range int, number bigint, id bigint, width int, ids binary, tokens array<int>, counts array<bigint>"


def tokenise(texts: DataFrame, tokenizer_file: str, end_id: int) -> DataFrame:
    """The ids of every row of ``id, text``, numbered in each partition, and one
    row per partition with the token counts of all its rows.

    Ids have two bytes each (``width``) if all of a batch fit, else four.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        words = word_tokens(tokenizer_file)
        totals = np.zeros(1, np.int64)
        number = 0
        for batch in pieces(batches, TEXT_BYTES):
            n = batch.num_rows
            ids, upto = words.ids(batch.column(1))
            ids = np.insert(ids, upto, end_id)
            upto = upto + np.arange(1, n + 1)
            width = 2 if ids.max(initial=0) < 1 << 16 else 4
            offsets = (np.concatenate([[0], upto]) * width).astype(np.int32)
            buffers = [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype(f"<u{width}"))]
            rows = pa.BinaryArray.from_buffers(pa.binary(), n, buffers)
            found = np.bincount(ids)
            if len(found) > len(totals):
                totals = np.concatenate([totals, np.zeros(len(found) - len(totals), np.int64)])
            totals[: len(found)] += found
            numbers = np.arange(number, number + n)
            number += n
            yield _tokens([part] * n, numbers, batch.column(0), [width] * n, rows, [None] * n, [None] * n)
        used = np.flatnonzero(totals)
        yield _tokens([part], [None], [None], [None], [None], [used], [totals[used]])

    return texts.mapInArrow(run, TOKENS)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of rows of tokens and counts, a row a token."""
    totals = np.zeros(0, np.int64)
    for batch in batches:
        tokens = batch.column(0).flatten().to_numpy()
        more = int(tokens.max(initial=-1)) + 1 - len(totals)
        totals = np.concatenate([totals, np.zeros(max(0, more), np.int64)])
        np.add.at(totals, tokens, batch.column(1).flatten().to_numpy())
    used = np.flatnonzero(totals)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(totals[used])], names=["token", "n"])


def _tokens(*columns) -> pa.RecordBatch:
    kinds = [
        pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()),
    ]
    names = ["range", "number", "id", "width", "ids", "tokens", "counts"]
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def write(
    docs: DataFrame,
    path: str,
    *,
    tokenizer_file: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Write the ids of all documents below ``path``: ``ranks`` and ``blocks``.

    Documents are in ascending order of their id.  A null text counts as empty,
    and every document ends with ``end_id``.  Rows with a null id come first,
    as id -1.  Rows that repeat an id follow each other, in order of their text.

    Documents are dealt out by ranges of their id, then encoded once; the plain
    ids are written in between, since the ranking needs all counts.  It has one
    row per token of the vocabulary, so the driver may hold it; it is made of
    per-task counts.
    """
    texts = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(-1)).alias("id"),
        F.col(text_col).cast("binary").alias("text"),
    )
    spark = docs.sparkSession
    ordered = texts.repartitionByRange("id").sortWithinPartitions("id", "text")
    plain = new_run_dir(spark, "plain_ids")
    tokenise(ordered, tokenizer_file, end_id).write.option("compression", "zstd").parquet(plain)
    stored = spark.read.parquet(plain)
    by_task = stored.where("number is null").select("tokens", "counts")
    # A vocabulary for each task is added up in steps of the root of their number.
    counted = by_task.repartition(max(1, math.isqrt(by_task.count()))).mapInArrow(_added, "token int, n bigint")
    ranked = counted.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").toArrow()
    by_rank = ranked.column("token").to_numpy()
    ranks = pa.table({"rank": np.arange(len(by_rank)), "token": by_rank})
    spark.createDataFrame(ranks).coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block():
            codes = np.concatenate([rank_of[x] for x in parts])
            counts = np.array([len(x) for x in parts], np.int64)
            packed = pack_block(first, np.array(ids, np.int64), counts, codes)
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{part:08d}"]), pa.array([packed], pa.binary())], names=["range", "value"]
            )

        part, first, size, ids, parts = -1, 0, 0, [], []
        for batch in pieces(batches):
            for now, number, doc_id, width, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and (size >= BLOCK_TOKENS or now != part or number != first + len(ids)):
                    yield block()
                    size, ids, parts = 0, [], []
                if not ids:
                    part, first = now, number
                ids.append(doc_id)
                parts.append(np.frombuffer(packed, f"<u{width}"))
                size += len(parts[-1])
        if ids:
            yield block()

    rows = stored.where("number is not null").select("range", "number", "id", "width", "ids")
    blocks = rows.mapInArrow(run, "range string, value binary")
    blocks.select("range", F.col("value").cast("string")).write.option("lineSep", "\n").partitionBy(
        "range"
    ).text(f"{path}/blocks")


def read_ranks(spark: SparkSession, path: str) -> np.ndarray:
    """Token ids by rank; one per token of the vocabulary at most."""
    rows = spark.read.parquet(f"{path}/ranks").orderBy("rank").toArrow()
    return rows.column("token").to_numpy().astype(np.int32)


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """``range, first, place, doc_id, n_tokens`` and ``ids`` (with ``digest``
    their unsigned CRC-32 instead) of every document below ``path``.

    ``first`` is the number of a block's first document in its range, and
    ``place`` the number of ids before a document in its block.
    """
    token_at = read_ranks(spark, path)
    last = ("ids_crc32", pa.int64()) if digest else ("ids", pa.list_(pa.int32()))
    names = ["file", "first", "place", "doc_id", "n_tokens", last[0]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                for first, ids, counts, codes in unpack_blocks(content.as_buffer()):
                    tokens = token_at[codes]
                    ends = np.cumsum(counts)
                    if digest:
                        raw = memoryview(tokens.astype("<u4").tobytes())
                        spans = zip((ends - counts) * 4, ends * 4)
                        made = pa.array([zlib.crc32(raw[a:b]) for a, b in spans], pa.int64())
                    else:
                        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                        made = pa.ListArray.from_arrays(offsets, pa.array(tokens))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name] * len(ids), pa.string()),
                            pa.array([first] * len(ids), pa.int64()),
                            pa.array(ends - counts),
                            pa.array(ids.astype(np.int64)),
                            pa.array(counts.astype(np.int64)),
                            made,
                        ],
                        names=names,
                    )

    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "part-*")
        .option("recursiveFileLookup", "true")
        .load(f"{path}/blocks")
    )
    kind = "ids_crc32 bigint" if digest else "ids array<int>"
    found = files.select("path", "content").mapInArrow(
        run, f"file string, first bigint, place bigint, doc_id bigint, n_tokens bigint, {kind}"
    )
    return found.withColumn("range", F.regexp_extract("file", "/range=([0-9]+)/", 1)).drop("file")


def with_starts(found: DataFrame) -> DataFrame:
    """``start``: the number of ids in all documents before.

    Blocks are added up first, then ranges; only ranges are numbered in one
    task.
    """
    blocks = found.groupBy("range", "first").agg(F.sum("n_tokens").alias("sum"))
    upto = Window.partitionBy("range").orderBy("first")
    inside = blocks.withColumn("inside", F.sum("sum").over(upto) - F.col("sum"))
    ranges = blocks.groupBy("range").agg(F.sum("sum").alias("sum"))
    order = Window.orderBy("range")
    before = ranges.select("range", (F.sum("sum").over(order) - F.col("sum")).alias("before"))
    starts = inside.join(before, "range").select("range", "first", (F.col("before") + F.col("inside")).alias("begin"))
    return found.join(starts, ["range", "first"]).withColumn("start", F.col("begin") + F.col("place")).drop("begin")


# -- the query ----------------------------------------------------------------

END_ID = 2


def op4_token_file(spark, folder):
    import public_tokenizers

    path = new_run_dir(spark, "tokens")
    write(
        spark.read.parquet(f"{folder}/documents.parquet"),
        path,
        tokenizer_file=public_tokenizers.path("word_bpe_49k.json"),
        end_id=END_ID,
    )
    found = settle(read(spark, path, digest=True), "token_documents")
    return with_starts(found).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {"op4_token_file": op4_token_file}
ORACLE: dict[str, str] = {}
