"""BPE encoding and decoding through a table of distinct words.

A text is split at ASCII white space, where the tokenizer's own pre-tokenizer always splits, so a
text's ids are its words' ids in a row. Three steps, one shuffle between each:

1. Documents are cut into words in blocks of about ``BLOCK_CHARS`` characters. A block keeps, per
   document, the positions of its words as numbers in the block's list of distinct words, and
   deals that list out by word hash.
2. A word meets all its copies from other blocks in one partition and is encoded there once; the
   ids go back to each block that asked. A partition holds the distinct words of its share, and
   shares grow in number with the texts' bytes.
3. A block joins its documents' positions with the ids, and for decoding the ids of its distinct words
   with their pieces: a join of packed columns with the id-to-piece table, which has the vocabulary's
   fixed size. :func:`decode` is the same join for any table of ids.

Splitting needs a tokenizer that treats words apart, and decoding one that puts pieces together with
spaces: :func:`check_tokenizer` refuses others.

Payloads are packed columns, compressed: a word costs a few bytes of shuffle. Nothing is broadcast
but the tokenizer's file. Very frequent words come once a block, so no key is hot.

Null and empty texts give no ids and an empty decoded text. Rows with the same or a null id are
kept apart. Ids, pieces and special tokens are the library's own.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritape.llm.common import pack, release, short_batches, texts_of, unpack

BLOCK_CHARS = 16_000_000
LEVEL = 9  # of compression: what is shuffled is the cost
OFTEN = 1 << 16  # words of a block that get small numbers
KNOWN_WORDS = 2_000_000  # distinct words of a share that a task remembers; past that it encodes some again
SHARE_BYTES = 64_000_000
MAX_SHARES = 10_000  # blocks times shares are rows; past that, shares grow


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _tokenizer(source: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(source)
    t.no_truncation()
    t.no_padding()
    return t


def check_tokenizer(t) -> None:
    """Raises unless words encode as they do alone and ids decode to pieces with spaces between."""
    words = ["The", "don't", "1,234", "café", "\u6f22\u5b57", "\u0130x", "(a)", "--", "\U0001f600", "x" * 300]
    alone = [t.encode(w, add_special_tokens=False).ids for w in words]
    for space in (" ", "\n", "\t \r\n", "\x0b\x0c"):
        if t.encode(space.join(words) + space, add_special_tokens=False).ids != [i for ids in alone for i in ids]:
            raise ValueError("this tokenizer does not treat words apart at white space")
    ids = [i for x in alone for i in x]
    if t.decode(ids, skip_special_tokens=False) != " ".join(t.id_to_token(i) for i in ids):
        raise ValueError("this tokenizer does not decode to pieces with spaces between")


class _Block:
    """Documents of one block: their ids, and their words as numbers in the order of first sight."""

    def __init__(self):
        self.docs, self.valid, self.places, self.counts, self.codes, self.words, self.chars = [], [], [], [], [], {}, 0

    def add(self, doc: int | None, text: str | None, place: int | None = None) -> None:
        words = text.encode("utf-8", "surrogatepass").split() if text else []
        number = self.words
        codes = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.uint32)
        self.docs.append(doc or 0)
        self.valid.append(doc is not None)
        if place is not None:
            self.places.append(place)
        self.counts.append(len(codes))
        self.codes.append(codes)
        self.chars += len(text or "")

    def rows(self, block: int, shares: int) -> Iterator[tuple[int, int, int, bytes]]:
        """(block, share, kind, payload): kind 0 is a list of words for a share, kind 1 the documents."""
        by: list[list[bytes]] = [[] for _ in range(shares)]
        for w in self.words:
            by[zlib.crc32(w) % shares].append(w)
        number, at = np.empty(len(self.words), np.uint32), 0  # words in the order of shares, and within a share as sorted
        for share, words in enumerate(by):
            if words:
                words.sort()
                number[[self.words[w] for w in words]] = np.arange(at, at + len(words), dtype=np.uint32)
                at += len(words)
                yield block, share, 0, pack(b" ".join(words), level=LEVEL)
        codes = number[np.concatenate(self.codes)] if self.codes else np.empty(0, np.uint32)
        often = np.argsort(-np.bincount(codes, minlength=at), kind="stable")[:OFTEN].astype(np.uint32)
        order = _full_order(often, at)
        place = np.empty(at, np.uint32)
        place[order] = np.arange(at, dtype=np.uint32)
        yield block, block % shares, 1, pack(np.array(self.docs, np.int64), np.array(self.valid, np.uint8), np.array(self.counts, np.uint32), place[codes], often, *([np.array(self.places, np.int64)] if self.places else []), level=LEVEL)


def _full_order(often: np.ndarray, n: int) -> np.ndarray:
    """The numbers of the most frequent words first, then all others as they come."""
    rest = np.ones(n, bool)
    rest[often] = False
    return np.concatenate((often, np.flatnonzero(rest).astype(np.uint32)))


_ROW = "block long, share int, kind int, payload binary"
_NAMES = ["block", "share", "kind", "payload"]


def _batch(rows: list) -> pa.RecordBatch:
    c = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.binary())], _NAMES)


def split_words(docs: DataFrame, shares: int, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Step 1, for (doc_id, text) rows, with a place in an order (long, not null) as a third column if wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, n, held = TaskContext.get().partitionId() << 24, 0, _Block()
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                held.add(*(x.as_py() for x in row))
                if held.chars >= block_chars:
                    yield _batch(list(held.rows(first + n, shares)))
                    n, held = n + 1, _Block()
        if held.docs:
            yield _batch(list(held.rows(first + n, shares)))
        held = None
        release()

    return docs.mapInArrow(run, _ROW)


def encode_words(rows: DataFrame, tokenizer_json: str) -> DataFrame:
    """Step 2: lists of words become lists of ids; documents pass. Each distinct word of a partition is encoded once."""
    shared = rows.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, known = _tokenizer(shared.value), {}
        for batch in batches:
            for block, share, kind, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    if len(known) > KNOWN_WORDS:
                        known.clear()
                    words = unpack(payload)[0].split(b" ")
                    fresh = [w for w in words if w not in known]
                    for i in range(0, len(fresh), 4096):
                        part = fresh[i : i + 4096]
                        for w, e in zip(part, tokenizer.encode_batch_fast([w.decode("utf-8", "surrogatepass") for w in part], add_special_tokens=False), strict=True):
                            known[w] = np.array(e.ids, dtype=np.uint32).tobytes()
                    ids = [known[w] for w in words]
                    payload = pack(np.array([len(x) // 4 for x in ids], np.uint32), np.frombuffer(b"".join(ids), np.uint32), level=LEVEL)
                yield _batch([(block, share, kind, payload)])
        del tokenizer
        known.clear()
        release()

    return rows.mapInArrow(run, _ROW)


def _join_block(table: pa.Table, pieces: pa.Array) -> pa.Table:
    """Step 3 for one block: ids and decoded text of its documents."""
    release()  # what the block before took
    found, docs = {}, None
    for share, kind, payload in zip(table["share"].to_pylist(), table["kind"].to_pylist(), table["payload"].to_pylist(), strict=True):
        if kind:
            docs = unpack(payload)
        else:
            found[share] = unpack(payload)
    doc, valid, counts, seq, often, *places = docs
    lens = np.concatenate([np.empty(0, np.uint32), *(found[x][0] for x in sorted(found))]).astype(np.int64)
    ids = np.concatenate([np.empty(0, np.uint32), *(found[x][1] for x in sorted(found))])
    if len(seq) and len(lens) <= int(seq.max()):
        raise RuntimeError(f"only {len(lens)} distinct words came back")
    order = _full_order(often, len(lens))
    starts, length = (np.cumsum(lens) - lens)[order], lens[order]  # by the numbers that the documents hold
    each = length[seq]
    ends = np.cumsum(each)
    take = np.repeat(starts[seq] - (ends - each), each) + np.arange(int(ends[-1]) if len(ends) else 0)
    values = ids[take].astype(np.int32)
    words = np.concatenate(([0], np.cumsum(counts.astype(np.int64))))
    offsets = np.concatenate(([0], ends))[words]
    found_pieces = pieces.take(pa.array(ids.astype(np.int64)))  # the id-to-piece join, of distinct words
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lens))).astype(np.int32)), found_pieces), " ").to_pylist()
    text = [joined[i] for i in order.tolist()]
    if len(length) and not length.all():  # words without ids leave no space
        shown = length[seq] > 0
        words = np.concatenate(([0], np.cumsum(shown)))[words]
        seq = seq[shown]
    seq, decoded = seq.tolist(), []
    for a, b in zip(words[:-1].tolist(), words[1:].tolist(), strict=True):
        decoded.append(" ".join([text[c] for c in seq[a:b]]))
    return pa.table(
        {
            "doc_id": pa.array(doc, pa.int64(), mask=valid == 0),
            "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32())),
            "decoded": pa.array(decoded, pa.string()),
        }
        | ({"place": pa.array(places[0], pa.int64())} if places else {})
    )


def encode_decode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_json: str | None = None, block_chars: int = BLOCK_CHARS, place_col: str | None = None, text_bytes: int | None = None) -> DataFrame:
    """doc_id, ids array<int>, decoded string of each row; with ``place_col`` (never null) also that as place long. ``text_bytes``: the texts' size, if it is known."""
    spark = df.sparkSession
    if tokenizer_json is None:
        with open(vocabulary_path(), encoding="utf-8") as f:
            tokenizer_json = f.read()
    t = _tokenizer(tokenizer_json)
    check_tokenizer(t)
    pieces = spark.sparkContext.broadcast(pa.array([t.id_to_token(i) or "" for i in range(t.get_vocab_size(with_added_tokens=True))], pa.string()))
    del t  # tens of MB, which the driver would keep
    release()
    shares = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = texts_of(df, id_col, text_col) if place_col is None else short_batches(df).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{place_col}`").cast("long").alias("place"))
    size = text_bytes if text_bytes is not None else docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shares = min(max(shares, -(-size // SHARE_BYTES)), max(shares, MAX_SHARES))
    asked = split_words(docs, shares, block_chars).repartition(shares, "share")
    return encode_words(asked, tokenizer_json).groupBy("block").applyInArrow(lambda table: _join_block(table, pieces.value), "doc_id long, ids array<int>, decoded string" + ", place long" * (place_col is not None))


def decode(df: DataFrame, key_cols: tuple[str, ...], ids_col: str = "ids", tokenizer_json: str | None = None) -> DataFrame:
    """``key_cols`` (unique together) and the decoded text of any table of id lists, by a join with the id-to-piece table.

    The table has the vocabulary's fixed size and is broadcast. Null and empty lists decode to empty text; unknown ids to nothing.
    """
    spark = df.sparkSession
    if tokenizer_json is None:
        with open(vocabulary_path(), encoding="utf-8") as f:
            tokenizer_json = f.read()
    t = _tokenizer(tokenizer_json)
    table = spark.createDataFrame([(i, t.id_to_token(i)) for i in range(t.get_vocab_size(with_added_tokens=True))], "id int, piece string")
    keys = [f"`{k}`" for k in key_cols]
    each = df.select(*keys, F.posexplode_outer(F.col(f"`{ids_col}`").cast("array<int>")).alias("__pos", "id")).join(F.broadcast(table), "id", "left")
    found = F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("__pos", "piece"))))
    return each.groupBy(*keys).agg(F.array_join(F.transform(found, lambda x: x.piece), " ").alias("decoded"))
