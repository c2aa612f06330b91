"""Alignment of the tokens of two tokenizers over the same bytes.

A task takes documents in blocks of a bounded number of bytes. Token lists are flattened with their
parent indices, segmented running sums of token lengths give the byte at which each token ends, and a
hash join of both sides on (document, end) finds the bytes at which either ends or both do. Two
neighbouring ends span one link, since the tokens over that stretch overlap there and in no other one; an end of
both closes a group. Equal links are counted per document, partial counts per block are merged by
Spark, and the merged counts of a block's pairs come back to its documents.
"""
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.lineage import stored
from turnwise.llm.common import whole
from turnwise.llm.packing import FAR, _byte_letters, tokenizer_file
from turnwise.operators.ordered import lookup

CHUNK = 2 << 20  # bytes of text aligned at a time; a longer text is a chunk of its own
BLOCK = 32 << 20  # bytes of text of a block, whose pairs are counted together
WORD_MARK = "▁"  # fixed value: a space in pieces


class Tokens:
    """Both tokenizers: ids of texts, and the bytes of every id."""

    def __init__(self, first: str, second: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(first)
        self.slow.encode_special_tokens = True
        special = {t.content for t in self.slow.get_added_tokens_decoder().values()}
        byte_of = {letter: byte for byte, letter in _byte_letters().items()}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in self.slow.get_vocab(with_added_tokens=False).items() if token not in special}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=second)
        own = {i: raw for raw, i in ranks.items()}
        self.first_bytes = pa.array([own.get(i, b"") for i in range(self.slow.get_vocab_size())], pa.binary())
        self.second_bytes = pa.array([self._piece(i) for i in range(self.pieces.get_piece_size())], pa.binary())
        self.first_names, self.second_names = (pa.array([str(i) for i in range(len(x))]) for x in (self.first_bytes, self.second_bytes))
        self.kind = np.dtype("<u2" if max(len(self.first_bytes), len(self.second_bytes)) <= 1 << 16 else "<u4")

    def _piece(self, i: int) -> bytes:
        if self.pieces.is_byte(i):
            return bytes([int(self.pieces.id_to_piece(i)[3:5], 16)])
        return self.pieces.id_to_piece(i).replace(WORD_MARK, " ").encode()

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of space + text by the first tokenizer and of text by the second, which adds the space itself."""
        spaced = [" " + t for t in texts]
        far = [i for i, t in enumerate(texts) if FAR.search(t)]
        known = dict(zip(far, (e.ids for e in self.slow.encode_batch([spaced[i] for i in far], add_special_tokens=False)), strict=True))
        return [known[i] if i in known else self.fast.encode_ordinary(t) for i, t in enumerate(spaced)], self.pieces.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def _tokens(first: str, second: str) -> Tokens:
    return Tokens(first, second)


def ends(ids: pa.ListArray, lengths: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Flat ids, the list each lies in, and the place in its list's bytes at which each ends."""
    flat, parent = pc.list_flatten(ids), pc.list_parent_indices(ids)
    upto = pc.cumulative_sum(pc.take(lengths, flat))
    offsets = ids.offsets.to_numpy()
    before = np.r_[np.int64(0), upto.to_numpy()][offsets[:-1]]
    return flat, parent, pc.subtract(upto, pc.take(pa.array(before), parent))


def stretches(a: pa.ListArray, b: pa.ListArray, a_lengths: pa.Array, b_lengths: pa.Array) -> pa.Table:
    """doc, end, a, b, cut in order of (doc, end): the tokens over each stretch between two ends; ``cut`` where both end.

    a and b are places in the flattened lists. Of each list's documents both must have the same bytes.
    """
    sides = []
    for name, ids, lengths in (("a", a, a_lengths), ("b", b, b_lengths)):
        flat, parent, end = ends(ids, lengths)
        sides.append(pa.table({"doc": parent, "end": end, name: pa.array(np.arange(len(flat), dtype=np.int64))}))
    met = sides[0].join(sides[1], ["doc", "end"], join_type="full outer", use_threads=False).sort_by([("doc", "ascending"), ("end", "ascending")]).combine_chunks()
    cut = pc.and_(pc.is_valid(met["a"]), pc.is_valid(met["b"]))
    return pa.table({"doc": met["doc"], "end": met["end"], "a": pc.fill_null_backward(met["a"]), "b": pc.fill_null_backward(met["b"]), "cut": cut})


def _joined_ids(flat: pa.Array, names: pa.Array, groups: np.ndarray) -> pa.Array:
    """Decimal ids of each group, joined by commas; ``groups`` holds the places after each group's last id."""
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, groups].astype(np.int32)), pc.take(names, flat))
    return pc.binary_join(lists, ",")


def _texts_of_groups(a: pa.ListArray, b: pa.ListArray, met: pa.Table, tokens: Tokens, documents: int) -> tuple[np.ndarray, list[str]]:
    """Number of groups and the digest of their text per document."""
    last = met.filter(met["cut"])
    doc = last["doc"].to_numpy()
    left = _joined_ids(pc.list_flatten(a), tokens.first_names, last["a"].to_numpy() + 1)
    right = _joined_ids(pc.list_flatten(b), tokens.second_names, last["b"].to_numpy() + 1)
    each = pc.binary_join_element_wise(left, right, "|")
    count = np.bincount(doc, minlength=documents)
    whole_texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)].astype(np.int32)), each), ";")
    return count, [hashlib.sha256(t.as_buffer()).hexdigest() if n else "" for t, n in zip(whole_texts, count, strict=True)]


def _faithful(ids: list[list[int]], token_bytes: pa.Array, raw: list[bytes]) -> np.ndarray:
    """Whether the joined bytes of each list are the given ones."""
    lists = pa.array(ids, pa.list_(pa.int32()))
    joined = pc.binary_join(pa.ListArray.from_arrays(lists.offsets, pc.take(token_bytes, lists.values)), b"")
    return pc.equal(joined, pa.array(raw, pa.binary())).to_numpy(zero_copy_only=False)


def align(texts: list[str], tokens: Tokens) -> pa.Table:
    """n_a, n_b, n_groups, n_links, groups_sha256 and packed pairs of each text."""
    a, b = tokens.encode(texts)
    raw = [b" " + t.encode() for t in texts]
    good = _faithful(a, tokens.first_bytes, raw) & _faithful(b, tokens.second_bytes, raw)
    usable = good & np.array([len(r) > 1 for r in raw])
    a, b = (pa.array([ids if ok else [] for ids, ok in zip(side, usable, strict=True)], pa.list_(pa.int32())) for side in (a, b))
    met = stretches(a, b, *(pc.binary_length(x).cast(pa.int64()) for x in (tokens.first_bytes, tokens.second_bytes)))
    n_groups, digests = _texts_of_groups(a, b, met, tokens, len(texts))
    links = pa.table({"doc": met["doc"], "a": pc.take(a.values, met["a"]), "b": pc.take(b.values, met["b"])})
    counted = links.group_by(["doc", "a", "b"], use_threads=False).aggregate([([], "count_all")]).sort_by([("doc", "ascending"), ("a", "ascending"), ("b", "ascending")])
    doc, ca, cb, n = (counted[c].to_numpy() for c in ("doc", "a", "b", "count_all"))
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    pack = zstandard.ZstdCompressor(level=1)
    pairs = [pack.compress(ca[x:y].astype(tokens.kind).tobytes() + cb[x:y].astype(tokens.kind).tobytes() + n[x:y].astype("<u4").tobytes())
             for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
    return pa.table({
        "n_a": pc.list_value_length(a).cast(pa.int64()), "n_b": pc.list_value_length(b).cast(pa.int64()), "n_groups": pa.array(n_groups, pa.int64()),
        "n_links": pa.array(np.bincount(met["doc"].to_numpy(), minlength=len(texts)), pa.int64()), "groups_sha256": pa.array(digests, pa.string()),
        "pairs": pa.array(pairs, pa.binary())})


def _unpacked(packed: list[bytes], kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document's place, a, b and n of all packed pairs."""
    reader, width = zstandard.ZstdDecompressor(), kind.itemsize
    docs, sides = [], ([], [], [])
    for i, raw in enumerate(packed):
        data = reader.decompress(raw)
        size = len(data) // (2 * width + 4)
        docs.append(np.full(size, i, dtype=np.int64))
        for at, dtype, side in ((0, kind, sides[0]), (size * width, kind, sides[1]), (2 * size * width, np.dtype("<u4"), sides[2])):
            side.append(np.frombuffer(data, dtype=dtype, count=size, offset=at).astype(np.int64))
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    return join(docs), *(join(s) for s in sides)


def _chunks(parts: Iterator[pa.RecordBatch], chunk: int) -> Iterator[tuple[list, list[str], int]]:
    """Ids and texts of neighbouring rows of up to ``chunk`` characters together, and their characters."""
    ids, texts, size = [], [], 0
    for part in parts:
        for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
            text = text.as_py()
            if texts and size + len(text) > chunk:
                yield ids, texts, size
                ids, texts, size = [], [], 0
            ids.append(doc_id)
            texts.append(text)
            size += len(text)
    if texts:
        yield ids, texts, size


def aligned(documents: DataFrame, first: str, second: str, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """block, doc_id, the columns of ``align`` and pairs of each row of ``documents`` (doc_id, text), written once."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, number, filled = _tokens(first, second), TaskContext.get().partitionId() << 32, 0
        for ids, texts, size in _chunks(parts, chunk):
            if filled and filled + size > block:
                number, filled = number + 1, 0
            filled += size
            made = align(texts, tokens)
            made = made.add_column(0, "doc_id", pa.array(ids, pa.int64())).add_column(0, "block", pa.array([number] * len(ids), pa.int64()))
            yield from made.combine_chunks().to_batches()

    schema = ("block bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary")
    return stored(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole().alias("text")).mapInArrow(batches, schema))


def align_tokens(documents: DataFrame, first: str | None = None, second: str | None = None, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """How the tokens of two tokenizer files line up in each row of ``documents`` (doc_id, text).

    doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. A null or empty text, and one whose tokens do not give
    back its bytes, has no tokens: zeros and an empty digest. Repeated rows are documents of their own and
    count each; a row without doc_id is a document like others. Pairs whose counts tie for a token's highest
    are all best. An empty table gives no rows. Of ``documents`` only doc_id and text are read.
    """
    first, second = first or tokenizer_file(), second or tokenizer_file("piece_bpe_32k.model")
    rows = aligned(documents, first, second, chunk, block)

    def partial(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _tokens(first, second).kind
        for part in parts:
            doc, a, b, n = _unpacked(part.column(1).to_pylist(), kind)
            of = pa.table({"block": pc.take(part.column(0), pa.array(doc)), "a": a, "b": b, "n": n}).group_by(["block", "a", "b"], use_threads=False).aggregate([("n", "sum")])
            yield from of.rename_columns(["block", "a", "b", "n"]).combine_chunks().to_batches()

    pairs = rows.select("block", "pairs").mapInArrow(partial, "block bigint, a bigint, b bigint, n bigint").select(
        "block", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), "n")
    counts = stored(pairs.groupBy("a", "b").agg(F.sum("n").alias("count")))
    best = counts.groupBy("b").agg(F.max("count").alias("most"))
    marked = counts.join(best, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))
    needed = lookup(pairs.select("block", "a", "b"), marked, ["a", "b"], how="inner")

    def finished(docs: pa.Table, known: pa.Table) -> pa.Table:
        doc, a, b, n = _unpacked(docs["pairs"].to_pylist(), _tokens(first, second).kind)
        per_pair = known.select(["a", "b", "count", "best"]).group_by(["a", "b"], use_threads=False).aggregate([("count", "max"), ("best", "max")])
        held = pa.table({"doc": doc, "a": a.astype(np.int32), "b": b.astype(np.int32), "n": n}).join(per_pair, ["a", "b"], join_type="inner", use_threads=False)
        sums = pa.table({"doc": held["doc"], "best": pc.if_else(held["best_max"], held["n"], 0), "sum": pc.multiply(held["n"], held["count_max"])})
        sums = sums.group_by("doc", use_threads=False).aggregate([("best", "sum"), ("sum", "sum")])
        out = np.zeros((2, docs.num_rows), dtype=np.int64)
        out[0, sums["doc"].to_numpy()], out[1, sums["doc"].to_numpy()] = sums["best_sum"].to_numpy(), sums["sum_sum"].to_numpy()
        return docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"]).append_column("n_best", pa.array(out[0])).append_column(
            "count_sum", pa.array(out[1])).append_column("groups_sha256", docs["groups_sha256"])

    return rows.groupBy("block").cogroup(needed.groupBy("block")).applyInArrow(
        finished, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
