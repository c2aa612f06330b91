"""Mixture-controlled packing of documents into fixed-length sequences.

Each source is a queue of documents in hash order. Deficit round-robin gives a source its share of
every window of ``WINDOW`` tokens: its quantum is its token count over the number of windows, and what a
window cannot give in whole tokens is carried on. Carried deficits add up to a closed form, so the window
of any token follows from its place in the queue, and windows are filled in parallel. Places in
queues and in the whole row of windows are running sums over buckets; no source meets in one task.
"""
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.lineage import new_folder
from turnwise.llm.common import running_start, whole
from turnwise.llm.mixing import key_of
from turnwise.operators.ordered import lookup

LENGTH = 2048  # tokens of a sequence
WINDOW = 32 * LENGTH  # tokens over which the sources' shares hold
END = 1  # id after every document
BATCH = 500  # documents encoded at a time

#: Characters beyond the Latin letters and signs, of which pattern libraries may know different classes.
FAR = re.compile(r"[^\t\n\r -~\u00A0-\u024F]")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it prints, else the next one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Words:
    """Token ids of texts by one byte-level tokenizer file.

    The file's vocabulary and its cutting pattern are also given to a second, much faster engine, which has the same
    ids for Latin text; texts with other characters or with a special token are encoded by the tokenizer itself.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() < 1 << 16 else "<u4")
        byte_of = {letter: byte for byte, letter in _byte_letters().items()}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token not in self.special}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        slow = [i for i, t in enumerate(texts) if FAR.search(t) or any(s in t for s in self.special)]
        found = dict(zip(slow, (e.ids for e in self.tokenizer.encode_batch([texts[i] for i in slow], add_special_tokens=False)), strict=True))
        ids = (found[i] if i in found else self.fast.encode_ordinary(t) for i, t in enumerate(texts))
        return [np.array(x, dtype=self.kind).tobytes() for x in ids]


@lru_cache(maxsize=2)
def _words(path: str) -> Words:
    return Words(path)


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(documents: DataFrame, tokenizer: str) -> DataFrame:
    """(row, doc_id, key, n, ids) of ``documents`` (doc_id, source, text), written once; ids end with END."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(tokenizer)
        end = np.array([END], dtype=words.kind).tobytes()
        for part in parts:
            for at in range(0, part.num_rows, BATCH):
                cut = part.slice(at, BATCH)
                ids = [x + end for x in words.encode(cut.column(2).to_pylist())]
                n = pa.array([len(x) // words.kind.itemsize for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([cut.column(0), cut.column(1), n, pa.array(ids, pa.binary())], ["doc_id", "key", "n", "ids"])

    made = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), key_of().alias("key"), whole().alias("text")).mapInArrow(
        batches, "doc_id bigint, key string, n bigint, ids binary")
    path = new_folder(documents.sparkSession, "ids")
    made.withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    return documents.sparkSession.read.parquet(path)


def placed(rows: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """Pieces (row, start, length, sequence_id, offset) of the rows (row, doc_id, key, n)."""
    count, tokens = rows.agg(F.count("*"), F.sum("n")).first()
    bits = max(0, (count // 2048).bit_length())
    mark = F.shiftrightunsigned(F.xxhash64("row"), 1)
    queued = rows.select("row", "key", "n").withColumn("_h", mark)
    queued = running_start(queued, ["key"], ["_h", "row"], "n", "_at", F.shiftright("_h", 63 - bits) if bits else F.lit(0),
                           F.shiftright("_h", max(0, 63 - max(0, bits - 10))) if bits > 10 else F.lit(0))
    totals = rows.groupBy("key").agg(F.sum("n").alias("_all"))
    # window w of a source begins at its token ceil(w * quantum), its quantum being its tokens * window / all tokens
    every, share = f"cast({tokens or 1} as decimal(18,0))", f"(cast(_all as decimal(18,0)) * {window})"
    starts = lambda w: F.expr(f"(cast({w} as decimal(18,0)) * {share} + {every} - 1) div {every}")
    # a window only holds tokens of the source for certain if its quantum is one or more; below, every token has a window of its own
    each = F.transform(F.sequence("_at", F.col("_at") + F.col("n") - 1), lambda t: F.call_function("div", t.cast("decimal(18,0)") * F.lit(tokens or 1).cast("decimal(18,0)"), F.expr(share)))
    windows = F.when(F.expr(f"{share} < {every}"), each).otherwise(F.sequence("_first", "_last"))
    cut = (lookup(queued, totals, ["key"], ["row"], "inner")
           .withColumn("_first", F.expr(f"(cast(_at as decimal(18,0)) * {every}) div {share}"))
           .withColumn("_last", F.expr(f"(cast(_at + n - 1 as decimal(18,0)) * {every}) div {share}"))
           .withColumn("_w", F.explode(windows))
           .withColumn("_from", starts("_w")).withColumn("_to", starts("_w + 1"))
           .withColumn("_s", F.greatest("_at", "_from"))
           .withColumn("_n", F.least(F.col("_at") + F.col("n"), F.col("_to")) - F.col("_s"))
           .withColumn("_turn", (F.col("_s") - F.col("_from")) / F.greatest(F.col("_to") - F.col("_from"), F.lit(1)))
           .select("row", "key", "_w", "_turn", "_n", (F.col("_s") - F.col("_at")).alias("_start")))
    whole_row = running_start(cut, [], ["_turn", "key", "row", "_start"], "_n", "_g", F.col("_w"), F.shiftright("_w", 10))
    one = F.lit(length).cast("bigint")
    return (whole_row.withColumn("sequence_id", F.explode(F.expr(f"sequence(_g div {length}, (_g + _n - 1) div {length})")))
            .withColumn("_b", F.greatest("_g", F.col("sequence_id") * one))
            .withColumn("_e", F.least(F.col("_g") + F.col("_n"), (F.col("sequence_id") + 1) * one))
            .select("row", (F.col("_start") + F.col("_b") - F.col("_g")).alias("start"), (F.col("_e") - F.col("_b")).alias("length"),
                    "sequence_id", (F.col("_b") - F.col("sequence_id") * one).alias("offset")))


def pack(documents: DataFrame, tokenizer: str | None = None, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """Pieces of all ``documents`` (doc_id, source, text) in sequences of ``length`` tokens, only the last of which is padded.

    Per piece: row, doc_id, key, start, length, ids (little-endian, of 2 or 4 bytes each), ids_crc32, doc_tokens, sequence_id,
    offset. A null text is empty and yields its end id; a null source is a source of its own; repeated
    rows are packed each; an empty table gives no pieces. Order depends on the stored rows alone.
    """
    rows = encoded(documents, tokenizer or tokenizer_file())
    pieces = placed(rows, length, window).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("pieces"))
    wide = _words(tokenizer or tokenizer_file()).kind.itemsize

    @F.pandas_udf("array<bigint>")
    def checks(ids: pd.Series, starts: pd.Series, lengths: pd.Series) -> pd.Series:
        def of(raw, start, count):
            values = np.frombuffer(raw, dtype=f"<u{wide}").astype("<u4")
            return [zlib.crc32(values[s:s + n].tobytes()) for s, n in zip(start, count, strict=True)]
        return pd.Series([of(*x) for x in zip(ids, starts, lengths, strict=True)])

    joined = rows.join(pieces, "row").withColumn("_crc", checks("ids", F.col("pieces.start"), F.col("pieces.length")))
    out = joined.select("row", "doc_id", "key", F.col("n").alias("doc_tokens"), "ids", F.explode(F.arrays_zip("pieces", "_crc")).alias("p"))
    return out.select("row", "doc_id", "key", F.col("p.pieces.start").alias("start"), F.col("p.pieces.length").alias("length"),
                      F.expr(f"substring(ids, cast(p.pieces.start * {wide} + 1 as int), cast(p.pieces.length * {wide} as int))").alias("ids"),
                      F.col("p._crc").alias("ids_crc32"), "doc_tokens",
                      F.col("p.pieces.sequence_id").alias("sequence_id"), F.col("p.pieces.offset").alias("offset"))
