"""Token ids in Arrow IPC files: batches of fixed-size lists, read again without a copy at any sequence.

Documents are dealt to tasks by ranges of doc_id, so shard after shard holds the documents in ascending order. A task
encodes its documents, ends each with END and writes the ids as rows of SEQ ids (the last row filled up with 0) beside
a mask that is false where it was filled up. A task writes under a name of its own and reports the name with each
document's place, so a file left by a lost attempt is never read. Sequence k of a shard is row k % ROWS of batch k //
ROWS: a reader maps the file and gets it as a view.

encode() gives exactly what Tokenizer.encode gives: a text whose splits at single spaces provably are splits of the
tokenizer is encoded word by word through a bounded store of words, any other text (two white spaces in a row, letters beyond
U+024F, special tokens) as a whole.

Defined results: a null text is empty and has the end id only; null doc_ids sort first; repeated rows are written again,
in any order among themselves; an empty table gives no file; other columns are not read.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heatfield.llm.common import scratch, small_batches, stored

SEQ, ROWS, END, CACHED = 2048, 64, 0, 800_000
_EDGE = re.compile(r"\s\s|\s$")
#: Two white spaces in a row, or a letter beyond U+024F.
_WHOLE = r"[\t-\r\x1c-\x20\x{85}\x{a0}]{2}|[^\x{0}-\x{24f}]"


class _Pool:
    """A numpy array that grows at its end."""

    def __init__(self, dtype):
        self.held, self.n = np.zeros(1 << 16, dtype), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.held):
            self.held = np.concatenate([self.held[: self.n], np.zeros(self.n + len(values), self.held.dtype)])
        self.held[self.n : self.n + len(values)] = values
        self.n += len(values)


def _gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of `size` values from `start` on, one behind another."""
    end = np.cumsum(size)
    return values[np.arange(end[-1] if len(end) else 0) + np.repeat(start - end + size, size)]


class Encoder:
    """Encodes texts; one for each worker process. Known words have a number, and their ids are the pool from ends[number] to ends[number + 1]."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        #: Bytes of each id's token: byte-level tokens have one character a byte.
        self.length = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())], np.int64)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.pool, self.ends = _Pool(self.dtype), _Pool(np.int64)
        self.ends.add(np.zeros(1, np.int64))

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        self.ends.add(ends + self.pool.n)
        self.pool.add(ids)
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words)), strict=True))

    def _learn(self, words: list[str]) -> None:
        """Encodes words as they stand behind a space, all in one text that is divided at the words' bytes again."""
        text = " ".join(["", *words])
        plain, odd = words, []
        if _EDGE.search(text):  # a word begins or ends with a white space, or is empty
            odd = [w for w in words if not w or w[0].isspace() or w[-1].isspace()]
            plain = [w for w in words if w and not w[0].isspace() and not w[-1].isspace()]
            text = " ".join(["", *plain])
        if odd:
            ids = self._ids([f" {w}" for w in odd])
            self._add(odd, np.concatenate(ids), np.cumsum([len(x) for x in ids]))
        if plain:
            ids = self._ids([text])[0]
            sizes = list(map(len, plain if text.isascii() else [w.encode() for w in plain]))
            self._add(plain, ids, np.searchsorted(np.cumsum(self.length[ids]), np.cumsum(np.array(sizes) + 1)) + 1)

    def encode(self, texts: pa.StringArray | list[str | None]) -> list[np.ndarray]:
        """Ids of every text; nulls are empty."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if len(self.number) > CACHED:
            self.forget()
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _WHOLE)
        for token in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        wholes = iter(self._ids(texts.filter(odd).to_pylist()))
        split = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
        words, at = split.flatten(), pc.list_value_length(split).to_numpy().cumsum()
        first = np.zeros(len(words), bool)
        first[np.r_[0, at[:-1]] if len(at) else []] = True  # a text's first word has no space before it
        coded = words.filter(pa.array(~first)).dictionary_encode()
        known = coded.dictionary.to_pylist()
        number = np.fromiter(map(self.number.get, known, repeat(-1)), np.int64, len(known))
        if len(new := np.flatnonzero(number < 0)):
            self._learn(unknown := [known[i] for i in new.tolist()])
            number[new] = [self.number[w] for w in unknown]
        number = number[coded.indices.to_numpy()]
        heads = self._ids(words.filter(pa.array(first)).to_pylist())
        start, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        start[~first], size[~first] = self.ends.held[number], self.ends.held[number + 1] - self.ends.held[number]
        size[first] = [len(x) for x in heads]
        ends = np.cumsum(size)
        ids = _gather(self.pool.held, start, np.where(first, 0, size))
        cut = ends[at - 1] if len(at) else at
        rest = iter(np.split(ids, np.cumsum(np.diff(cut, prepend=0) - size[first])[:-1])) if len(at) else iter(())
        plain = iter([np.concatenate([h, r]) for h, r in zip(heads, rest, strict=True)])
        return [next(wholes) if x else next(plain) for x in odd.to_pylist()]


def _joined(batches: Iterator[pa.RecordBatch], least: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have `least` bytes: a word is looked up once in each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= least:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class _Writer:
    """Rows of SEQ ids with masks, ROWS rows to a batch."""

    def __init__(self, uri: str, dtype):
        fs, self.path = pa.fs.FileSystem.from_uri(uri)
        fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.dtype, self.held, self.n = dtype, [], 0
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), SEQ)), ("mask", pa.list_(pa.bool_(), SEQ))])
        self.file = fs.open_output_stream(self.path)
        self.ipc = pa.ipc.new_file(self.file, self.schema)

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n += len(ids)
        while self.n >= SEQ * ROWS:
            a = np.concatenate(self.held)
            self.write(a[: SEQ * ROWS])
            self.held, self.n = [a[SEQ * ROWS :]], len(a) - SEQ * ROWS

    def write(self, ids: np.ndarray) -> None:
        rows = -(-len(ids) // SEQ)
        full, mask = np.zeros(rows * SEQ, self.dtype), np.zeros(rows * SEQ, bool)
        full[: len(ids)], mask[: len(ids)] = ids, True
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(a), SEQ) for a in (full, mask)]
        self.ipc.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        if self.n:
            self.write(np.concatenate(self.held))
        self.ipc.close()
        self.file.close()


class Shard:
    """Random access to a shard's sequences; on a local path the file is mapped and the arrays are views of it."""

    def __init__(self, uri: str):
        fs, path = pa.fs.FileSystem.from_uri(uri)
        self.source = pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path)
        self.ipc = pa.ipc.open_file(self.source)

    def sequence(self, k: int) -> tuple[np.ndarray, pa.Array]:
        row = self.ipc.get_batch(k // ROWS).slice(k % ROWS, 1)
        return row.column(0).flatten().to_numpy(), row.column(1).flatten()

    def ids(self, start: int, n: int) -> np.ndarray:
        step, parts = SEQ * ROWS, []
        while n:
            a = self.ipc.get_batch(start // step).column(0).flatten().to_numpy()[start % step : start % step + n]
            parts.append(a)
            start, n = start + len(a), n - len(a)
        return np.concatenate(parts) if len(parts) != 1 else parts[0]


def write_tokens(docs: DataFrame, tokenizer: str, folder: str) -> DataFrame:
    """Writes docs(doc_id, text); returns shard, file, doc_id, place (ids of the shard before the document) and n_tokens."""
    spark = docs.sparkSession
    small_batches(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        out, at, uri = None, 0, f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.arrow"
        done = []
        for batch in _joined(batches):
            out = out or _Writer(uri, enc.dtype)
            sizes = []
            for ids in enc.encode(batch.column(1)):
                out.add(np.append(ids, enc.dtype(END)))
                sizes.append(len(ids) + 1)
            starts = np.cumsum([at, *sizes], dtype=np.int64)
            at = int(starts[-1])
            k = len(sizes)
            done.append(pa.RecordBatch.from_arrays([pa.array([shard] * k, pa.int32()), pa.array([uri] * k), batch.column(0), pa.array(starts[:-1]), pa.array(sizes, pa.int64())], ["shard", "file", "doc_id", "place", "n_tokens"]))
        if out:
            out.close()
        yield from done

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The place of a row splits a doc_id, or null, that very many rows share.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("at"))
    dealt = rows.repartitionByRange(parts, "doc_id", "at").sortWithinPartitions("doc_id", "at").drop("at")
    return stored(dealt.mapInArrow(write, "shard int, file string, doc_id long, place long, n_tokens long"), "token-index")


def read_tokens(index: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files; start counts the ids of all shards before (one row a shard)."""
    small_batches(index.sparkSession, 10_000)
    sizes = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder.cache_clear()  # the worker may have encoded before; its words are not needed any more
        name, shard = None, None
        for batch in batches:
            sums = []
            for file, place, n in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if file != name:
                    name, shard = file, Shard(file)
                sums.append(zlib.crc32(shard.ids(place, n).astype("<u4")))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(4), batch.column(3), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = index.join(F.broadcast(before), "shard").select("file", "doc_id", "place", "n_tokens", (F.col("place") + F.col("before")).alias("start"))
    return rows.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_tokens(write_tokens(docs, str(public_tokenizers.path("byte_bpe_50k.json")), scratch(spark, "tokens")))


QUERIES, ORACLES = {"op5_token_files": op5_token_files}, {}
