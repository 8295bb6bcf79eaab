"""Token ids in binary shards with a shared zstandard dictionary.

A store is a folder of Parquet tables:

- ``dictionary``: (hash, bytes), one zstandard dictionary, trained on the id arrays of at most ``TRAIN_ROWS``
  documents, those with the smallest hash of their id (repeated rows once, rows without an id not);
- ``shards``: (shard, first_id, last_id, dictionary_hash, doc_ids, starts, offsets, n_tokens, blob). A blob is the
  concatenation of one zstandard frame per document, of its ids as little-endian unsigned 32-bit integers;
  ``offsets`` has one more entry than documents, so a short document is read by slicing its own frame only.

Shards are in ascending order of doc_id and hold at most ``SHARD_BYTES`` of frames and ``SHARD_ROWS`` documents
(a longer document has a shard of its own). ``starts`` counts the ids of all documents before.

Tokenizing encodes each distinct word once for a batch: white space always ends a word of this tokenizer, so
texts are put together from the ids of their words; the words of a batch are encoded by the library as one
text, with a control character between them. A special token spelled out in a text is that token, as in the
library. The tokenizer's file is read for its steps, and any other tokenizer encodes whole texts.

Defined cases: null and empty texts hold the end id only; repeated rows are stored each, in the order of their
frames; a row without an id comes first; an empty table gives an empty store; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from lectern.llm.common import new_path, split_batches, stored, unused

END_ID = 1
TRAIN_ROWS = 1000
TRAIN_BYTES = 16_000
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
SHARD_BYTES = 4 << 20
SHARD_ROWS = 4096
#: Frames that one task puts in order, so that their number follows the input.
PART_BYTES = 16 << 20
MEMO = 300_000
MARK = "\x01"


#: Letters that are their own composed form, then stops and the like.
SIMPLE = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([].,;:!?#$%&*()\"+/=@^_`~\\{}[-]*)").fullmatch
#: The letters that a byte-level model has for bytes: printable ones stand for themselves, the others for those from 256 on.
PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
#: White space to str.split(), but not to the tokenizer.
SEPARATORS = re.compile("[\x1c-\x1f]")
SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: The steps of a tokenizer that cuts at white space, then into runs of letters, single digits and runs of other marks.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLITTERS = ["Split", "ByteLevel"]
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
STEPS = ({"Regex": "\\s+"}, " ", {"Regex": WORD_PATTERN}, "Removed", True, False, False, "BPE", None, None)


def words_of(text: str) -> list[str]:
    if SEPARATORS.search(text):
        return [w for w in SPACES.split(text) if w]
    return text.split()


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cuts_at_spaces(path: str) -> bool:
    """Whether a tokenizer file has the very steps that encoding word by word takes for granted."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    normalizer, splitter, model = held["normalizer"] or {}, held["pre_tokenizer"] or {}, held["model"]
    if [x.get("type") for x in normalizer.get("normalizers", [])] != NORMALIZERS or [x.get("type") for x in splitter.get("pretokenizers", [])] != SPLITTERS:
        return False
    space, (cut, letters) = normalizer["normalizers"][1], splitter["pretokenizers"]
    steps = (space["pattern"], space["content"], cut["pattern"], cut["behavior"], cut["invert"], letters["add_prefix_space"], letters["use_regex"], model["type"], model.get("dropout"), model.get("continuing_subword_prefix"))
    plain = all(not (x["lstrip"] or x["rstrip"] or x["single_word"] or SPACES.search(x["content"]) or SIMPLE(x["content"])) for x in held["added_tokens"])
    return steps == STEPS and plain and not held.get("truncation") and not held.get("padding")


class WordEncoder:
    """Texts to id bytes, word by word; whole text by whole text for a tokenizer that may join across white space.

    A word of plain letters, with stops or other marks after it or not, is the ids of its letters in lower case and
    those of the rest: the tokenizer cuts between the two. Letters need no normalizing then and go straight to the
    library's model. The ids of MEMO words, those met last, and as many met before them are kept, and of MEMO letter runs."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = cuts_at_spaces(path)
        self.model = self.tokenizer.model
        self.mark = self.ids(f" {MARK} ")
        self.bytes_of = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def learn_odd(self, words: list[str]) -> None:
        """Put the ids of any words in the memo, with one call for all but those that hold the mark."""
        plain = [w for w in words if MARK not in w]
        alone = [w for w in words if MARK in w]
        if plain:
            ids = self.ids("".join([f"{w} {MARK} " for w in plain]))
            cuts = np.flatnonzero(ids == self.mark[0]) if len(self.mark) == 1 else []
            if len(cuts) == len(plain):
                data, at = ids.tobytes(), 0
                for w, cut in zip(plain, cuts.tolist()):
                    self.memo[w] = data[at : 4 * cut]
                    at = 4 * cut + 4
            else:
                alone = words
        for w in alone:
            self.memo[w] = self.ids(w).tobytes()

    def learn(self, words: set[str]) -> None:
        memo, old, runs, tails, bytes_of, model = self.memo, self.old, self.runs, self.tails, self.bytes_of, self.model.tokenize
        if len(runs) > MEMO:
            runs.clear()
        odd = []
        for w in words:
            known = old.get(w)
            if known is None:
                if w.isascii() and w.isalpha():
                    run, tail = w.lower(), ""
                elif m := SIMPLE(w):
                    run, tail = m[1].lower(), m[2]
                else:
                    odd.append(w)
                    continue
                known = runs.get(run)
                if known is None:
                    letters = run if run.isascii() else run.encode("utf-8").decode("latin-1").translate(BYTE_LETTERS)
                    runs[run] = known = b"".join([bytes_of[t.id] for t in model(letters)])
                if tail:
                    if tail not in tails:
                        if len(tails) > MEMO // 10:
                            tails.clear()
                        tails[tail] = self.ids(tail).tobytes()
                    known += tails[tail]
            memo[w] = known
        if odd:
            self.learn_odd(odd)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_word:
            return [self.ids(t or "").tobytes() for t in texts]
        split = [words_of(t or "") for t in texts]
        out: list[bytes] = []
        at = 0
        while at < len(split):
            if len(self.memo) > MEMO:
                self.old, self.memo = self.memo, {}
            new: set[str] = set()
            to = at
            while to < len(split) and (to == at or len(new) < MEMO // 10):
                new |= set(split[to]).difference(self.memo)
                to += 1
            self.learn(new)
            known = self.memo.__getitem__
            out += [b"".join(map(known, words)) for words in split[at:to]]
            at = to
        return out


@lru_cache(maxsize=1)
def shared_encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker, which goes on to later tasks."""
    return WordEncoder(path)


def _encoded(path: str, dictionary: bytes | None):
    """Arrow batches (doc_id, text) to (doc_id, n_tokens, frame); without a dictionary frames hold raw ids."""
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(path)
        if dictionary is not None:
            shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
            compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True).compress
        for batch in split_batches(batches, "text", 8 << 20):
            ids = [x + end for x in encoder.encode(batch.column(1).to_pylist())]
            sizes = pa.array([len(x) // 4 for x in ids], pa.int64())
            frames = [x[:TRAIN_BYTES] for x in ids] if dictionary is None else [compress(x) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(frames, pa.binary())], ["doc_id", "n_tokens", "frame"])

    return run


def token_counts(docs: DataFrame, keep: list[str], text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """The columns ``keep`` and n_tokens: the ids of each text and its end id; 0 for a text without ids."""
    tokenizer = tokenizer or tokenizer_path()
    (text_c,) = unused(docs, "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer)
        for batch in split_batches(batches, text_c, 8 << 20):
            sizes = [len(x) // 4 for x in encoder.encode(batch.column(len(keep)).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([n and n + 1 for n in sizes], pa.int64())], [*keep, "n_tokens"])

    schema = StructType([*docs.select(*keep).schema.fields, StructField("n_tokens", LongType())])
    return docs.select(*keep, F.col(text_col).cast("string").alias(text_c)).mapInArrow(run, schema)


FRAMES = "doc_id long, n_tokens long, frame binary"
SHARDS = "part int, shard_in_part long, first_id long, last_id long, doc_ids array<long>, starts array<long>, offsets array<long>, n_tokens array<long>, blob binary"


def train_dictionary(docs: DataFrame, path: str) -> bytes:
    """A zstandard dictionary from the first ids of at most TRAIN_ROWS documents; empty where there is too little."""
    text_hash = unused(docs, "text_hash")[0]
    hashed = docs.withColumn(text_hash, F.xxhash64("text"))
    # Ids first, for texts are long; at most TRAIN_ROWS of them: a bounded broadcast.
    chosen = hashed.select("doc_id", text_hash).orderBy(F.xxhash64("doc_id"), "doc_id", text_hash).limit(TRAIN_ROWS).distinct()
    sample = hashed.join(F.broadcast(chosen), ["doc_id", text_hash]).dropDuplicates(["doc_id", text_hash]).select("doc_id", "text")
    samples = sorted(bytes(r["frame"]) for r in sample.mapInArrow(_encoded(path, None), FRAMES).select("frame").collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted frames to shards; starts count from the beginning of the part."""
    rows: list[tuple[int, int, bytes]] = []
    state = {"shard": 0, "start": 0}

    def out(part: int) -> pa.RecordBatch:
        n = [r[1] for r in rows]
        starts = (state["start"] + np.cumsum([0, *n])).tolist()
        offsets = np.cumsum([0, *[len(r[2]) for r in rows]]).tolist()
        one = {"part": part, "shard_in_part": state["shard"], "first_id": rows[0][0], "last_id": rows[-1][0], "doc_ids": [r[0] for r in rows], "starts": starts[:-1], "offsets": offsets, "n_tokens": n, "blob": b"".join(r[2] for r in rows)}
        state["shard"] += 1
        state["start"] = starts[-1]
        rows.clear()
        kind = pa.schema([("part", pa.int32()), ("shard_in_part", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), *[(c, pa.list_(pa.int64())) for c in ("doc_ids", "starts", "offsets", "n_tokens")], ("blob", pa.binary())])
        return pa.RecordBatch.from_pylist([one], kind)

    held, part = 0, 0
    for batch in batches:
        for part, doc, n, frame in zip(*[c.to_pylist() for c in batch.columns]):
            if rows and (held + len(frame) > SHARD_BYTES or len(rows) >= SHARD_ROWS):
                yield out(part)
                held = 0
            rows.append((doc, n, frame))
            held += len(frame)
    if rows:
        yield out(part)


def write(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode every whole text and write a store; returns its path."""
    spark = docs.sparkSession
    path, tokenizer = path or new_path(spark, "token_store"), tokenizer or tokenizer_path()
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dictionary = train_dictionary(docs, tokenizer)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, bytearray(dictionary))], "hash string, bytes binary").coalesce(1).write.parquet(f"{path}/dictionary")
    frames = stored(docs.mapInArrow(_encoded(tokenizer, dictionary), FRAMES), "token_frames")
    size = frames.agg(F.sum(F.length("frame"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    ordered = frames.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "n_tokens", "frame").select(F.spark_partition_id().alias("part"), "doc_id", "n_tokens", "frame")
    shards = stored(ordered.mapInArrow(_packed, SHARDS), "token_shards", f"{path}/parts")
    # One row per part: the ids of all parts before.
    sums = shards.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("tokens"), F.max("shard_in_part").alias("most"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("tokens_before"), F.coalesce(F.sum(F.col("most") + 1).over(before), F.lit(0)).alias("shards_before"))
    sums.withColumn("dictionary_hash", F.lit(digest)).coalesce(1).write.parquet(f"{path}/index")
    return path


def open_store(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, bytes]]:
    """(shards with their place in the whole, dictionaries by hash)."""
    parts, index = spark.read.parquet(f"{path}/parts"), spark.read.parquet(f"{path}/index")
    shards = parts.join(index, "part").withColumn("shard", F.col("shards_before") + F.col("shard_in_part"))
    return shards, {r["hash"]: bytes(r["bytes"]) for r in spark.read.parquet(f"{path}/dictionary").collect()}


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids, of all documents or of a few.

    For a few, only shards whose range holds them are read, and only their frames are decompressed."""
    shards, dictionaries = open_store(spark, path)
    if doc_ids is not None:
        # A shard that begins with rows without an id has no first one.
        reached = F.coalesce(F.col("first_id") <= max(doc_ids), F.lit(True)) & (F.col("last_id") >= min(doc_ids))
        shards = shards.filter(reached & F.arrays_overlap("doc_ids", F.array(*[F.lit(i).cast("long") for i in doc_ids])))
    wanted = None if doc_ids is None else set(doc_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools: dict[str, zstandard.ZstdDecompressor] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                before, key, docs, starts, offsets, sizes = (batch.column(j)[i].as_py() for j in range(6))
                blob = memoryview(batch.column(6)[i].as_buffer())
                if key not in tools:
                    held = dictionaries[key]
                    tools[key] = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held) if held else None)
                picked = [j for j in range(len(docs)) if wanted is None or docs[j] in wanted]
                for at in range(0, len(picked), 256):
                    some = picked[at : at + 256]
                    ids = [tools[key].decompress(blob[offsets[j] : offsets[j + 1]]) for j in some]
                    for j, x in zip(some, ids):
                        if len(x) != 4 * sizes[j]:
                            raise ValueError(f"document {docs[j]}: {len(x)} bytes, {sizes[j]} ids")
                    cols = [pa.array([docs[j] for j in some], pa.int64()), pa.array([before + starts[j] for j in some], pa.int64()), pa.array([sizes[j] for j in some], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        cols.append(pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in ids], pa.list_(pa.int64())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(cols, names)

    columns = shards.select("tokens_before", "dictionary_hash", "doc_ids", "starts", "offsets", "n_tokens", "blob")
    return columns.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
