"""SentencePiece encoding and decoding as a relational lattice.

Texts are cut to words: between two characters that no piece holds side by side, as before most runs of spaces, before a
comma behind a letter, or beside a line feed. No path or merge crosses such a place. For the distinct words of the corpus, all
substrings up to the longest piece are exploded and joined to the piece table on the string; the edges found are grouped
by word, and a higher-order aggregate folds them: Viterbi over the scores for unigram models, and for BPE models, where
the best sum is not what the library returns, merges. A trained BPE model merges in order of score only, so one walk
over a word's edges from the best on is enough: an edge whose ends are boundaries with a single boundary between them
removes that one; the boundaries are bits of a number. Characters without a piece become their UTF-8 bytes.

Words are found in the texts by 64-bit hashes in numpy. The most frequent words, FREQUENT at most, are broadcast as
packed arrays; the other words of each part of the documents are joined to the lattice's results and meet the part's texts in a
second shuffle, so the vocabulary may have any size. All ids are decoded again and compared with the texts' bytes.
Words longer than LONG characters have more boundaries than a number has bits and are encoded by the library instead;
a shorter word that the join did not give is an error.

Defined results: a null text is empty and has no ids; a null doc_id keeps its row; rows that repeat a doc_id are encoded
each by its own text; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heatfield.llm.common import forget, prefix_hashes, row_key, small_batches, stored

FREQUENT, LONG, MARK = 1 << 20, 61, "▁"
#: Words that a task looks through at once for distinct ones; words that the grouping of edges may hold at once; words of a part; texts encoded at once.
CHUNK, HELD, PART, SOME = 1 << 19, 200_000, 3_000_000, 256
#: Partitions of the distinct words to each of the session's shuffles.
DEALT = 8
#: Characters of a piece's beginning that are looked up, and bits of the table, as a power of 2.
START, BITS = 4, 18
_MARK = MARK.encode()


class Model:
    """Pieces, scores and kind of a model file; made anew in each worker."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        self.bpe = m.trainer_spec.model_type == proto.TrainerSpec.BPE
        normal = proto.ModelProto.SentencePiece.NORMAL
        self.pieces = [(p.piece, i, float(p.score)) for i, p in enumerate(m.pieces) if p.type in (normal, proto.ModelProto.SentencePiece.USER_DEFINED)]
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.first_byte = self.library.piece_to_id("<0x00>")
        self.longest = max(len(p) for p, _, _ in self.pieces)
        #: Pairs of bytes (the first one's 256-fold and the second) that no piece holds, the second one a character's first: words are cut between them.
        self.cuts = np.ones(1 << 16, bool)
        for p, _, _ in self.pieces:
            b = np.frombuffer(p.replace(MARK, " ").encode(), np.uint8).astype(np.int64)
            self.cuts[b[:-1] * 256 + b[1:]] = False
        self.cuts.reshape(256, 256)[:, 0x80:0xC0] = False
        self.bytes = [b""] * self.library.vocab_size()
        for p, i, _ in self.pieces:
            self.bytes[i] = p.replace(MARK, " ").encode()
        for b in range(256):
            self.bytes[self.first_byte + b] = bytes([b])
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        self.begin, self.blob = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(self.bytes), np.uint8)
        one = {p.replace(MARK, " "): i for p, i, _ in self.pieces if len(p) == 1}
        #: Ids of the ASCII characters.
        self.ascii = [one.get(chr(c), self.first_byte + c) for c in range(128)]


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def lattice(words: DataFrame, path: str) -> DataFrame:
    """words with ids, for distinct words of at most LONG characters, marks written as spaces. Where words is dealt by word already, nothing below is shuffled."""
    spark, m = words.sparkSession, model(path)
    best = sorted(m.pieces, key=lambda p: (-p[2], p[1]))
    table = [(p.replace(MARK, " "), r, i, score) for r, (p, i, score) in enumerate(best)]
    table = F.broadcast(spark.createDataFrame(table, "piece string, rank long, id long, score double"))  # the model's size
    n, own = F.char_length("word"), words.columns
    starts = words.select(*own, F.explode(F.sequence(F.lit(0), n - 1)).alias("s"))
    # Where no piece begins with the next START characters there are but shorter ones: about half of all substrings.
    reach = F.when(_begins_piece(m, F.substring("word", F.col("s") + 1, F.lit(START))), m.longest).otherwise(START - 1)
    spans = starts.select(*own, "s", F.explode(F.sequence(F.col("s") + 1, F.least(n, F.col("s") + reach))).alias("e"))
    spans = spans.withColumn("piece", F.substring("word", F.col("s") + 1, F.col("e") - F.col("s")))
    if m.bpe:  # single ASCII characters need no edge, but each word needs a row
        spans = spans.filter("e > s + 1 or e = 1 or ascii(piece) > 127")
    edges = spans.join(table, "piece", "left").filter("id is not null or e = 1")
    if m.bpe:
        packed = F.when(F.col("id").isNotNull(), F.expr("shiftleft(rank, 32) + shiftleft(id, 14) + shiftleft(s, 7) + e"))
        grouped = edges.groupBy(*own).agg(F.sort_array(F.collect_list(packed)).alias("edges"))
        return grouped.withColumn("cut", F.expr(_merges())).select(*own, F.expr(_ids(m)).alias("ids"))
    edge = F.struct((F.col("s") * 128 + F.col("e")).alias("k"), "id", "score")
    grouped = edges.groupBy(*own).agg(F.collect_list(edge).alias("edges"))
    scored = grouped.select(*own, F.map_from_arrays(F.expr("transform(edges, x -> x.k)"), F.expr("transform(edges, x -> struct(x.id, x.score))")).alias("at"), n.alias("n"))
    scored = scored.withColumn("b", F.expr(_viterbi(m.longest)))
    ids = f"flatten(transform(sequence(0, size(b) - 2), i -> if(at[b[i] * 128 + b[i + 1]].id is not null, array(cast(at[b[i] * 128 + b[i + 1]].id as int)), {_bytes(m, 'substring(word, b[i] + 1, 1)')})))"
    return scored.select(*own, F.expr(ids).alias("ids"))


def _begins_piece(m: Model, c: Column) -> Column:
    """Whether a piece may begin with c: a table of bits by hash, true for all that do and few that do not."""
    hashes = np.array([_murmur(p[:START].encode()) for p in {p.replace(MARK, " ") for p, _, _ in m.pieces} if len(p) >= START], np.int64)
    bits = np.zeros(1 << BITS, np.uint8)
    bits[hashes % (1 << BITS)] = 1
    h = F.pmod(F.hash(c), F.lit(1 << BITS))
    return F.getbit(F.get(F.lit(np.packbits(bits, bitorder="little").view("<i8").tolist()), F.shiftright(h, 6)), h.bitwiseAND(63)) == 1


def _murmur(data: bytes, seed: int = 42) -> int:
    """Spark's hash() of a string: Murmur3 of 32 bits over its 4-byte words, then over each byte left."""
    low = 0xFFFFFFFF
    turn = lambda x, r: (x << r | x >> (32 - r)) & low
    whole = len(data) // 4 * 4
    for k in (*struct.unpack(f"<{whole // 4}i", data[:whole]), *struct.unpack(f"{len(data) - whole}b", data[whole:])):
        k = turn(k * 0xCC9E2D51 & low, 15) * 0x1B873593 & low
        seed = (turn(seed ^ k, 13) * 5 + 0xE6546B64) & low
    seed ^= len(data)
    seed = (seed ^ seed >> 16) * 0x85EBCA6B & low
    seed = (seed ^ seed >> 13) * 0xC2B2AE35 & low
    seed ^= seed >> 16
    return seed - (1 << 32) if seed >> 31 else seed


def _bytes(m: Model, c: str) -> str:
    return f"transform(sequence(0, octet_length({c}) - 1), j -> {m.first_byte} + cast(conv(substring(hex(encode({c}, 'UTF-8')), 2 * j + 1, 2), 16, 10) as int))"


def _inside(x: str) -> str:
    """The boundaries between the ends of an edge, as bits."""
    s, e = f"(shiftright({x}, 7) & 127)", f"({x} & 127)"
    return f"(shiftleft(1L, cast({e} as int)) - shiftleft(2L, cast({s} as int)))"


def _at_ends(x: str, cut: str) -> str:
    return f"(shiftright({cut}, cast(shiftright({x}, 7) & 127 as int)) & shiftright({cut}, cast({x} & 127 as int)) & 1L) = 1L"


def _merges() -> str:
    """Boundaries, as bits, after a walk over the edges from the best score on, at a tie from the left."""
    one = f"bit_count({_inside('x')} & t) = 1"
    return f"aggregate(edges, shiftleft(1L, char_length(word) + 1) - 1L, (t, x) -> if({one} and {_at_ends('x', 't')}, t & ~{_inside('x')}, t))"


def _ids(m: Model) -> str:
    """Ids of the pieces between boundaries, each behind its place: an edge's, or those of a single character."""
    long = "((x & 127) > (shiftright(x, 7) & 127) + 1 or octet_length(word) <> char_length(word))"
    left = f"transform(filter(edges, x -> {_at_ends('x', 'cut')} and ({_inside('x')} & cut) = 0L and {long}), x -> shiftleft(shiftright(x, 7) & 127, 32) + (shiftright(x, 14) & 262143L))"
    alone = "filter(sequence(0, char_length(word) - 1), s -> (shiftright(cut, s) & 3L) = 3L)"
    plain = f"transform({alone}, s -> shiftleft(cast(s as bigint), 32) + element_at(array({', '.join(f'{i}L' for i in m.ascii)}), ascii(substring(word, s + 1, 1)) + 1))"
    single = f"if(ascii(c) < 128, array(element_at(array({', '.join(map(str, m.ascii))}), ascii(c) + 1)), {_bytes(m, 'c')})"
    # A character of several bytes without a piece has several ids, in order.
    other = f"flatten(transform({alone}, s -> transform(transform(array(substring(word, s + 1, 1)), c -> {single})[0], (i, k) -> shiftleft(cast(s as bigint), 32) + shiftleft(cast(k as bigint), 24) + i)))"
    # Characters with a piece of their own are edges, too.
    wide = f"filter({other}, x -> not exists(edges, y -> (y & 16383L) = (shiftright(x, 32) * 128 + shiftright(x, 32) + 1)))"
    return f"transform(sort_array(concat({left}, if(octet_length(word) = char_length(word), {plain}, {wide}))), x -> cast(x & 16777215L as int))"


def _viterbi(longest: int) -> str:
    """Boundaries of the path with the greatest sum of scores; a character without a piece costs 10 more than any piece."""
    step = f"""array_max(transform(sequence(greatest(0, e - {longest}), e - 1), s -> struct(t[s].sum + coalesce(at[s * 128 + e].score, if(e = s + 1, -1e6, cast(null as double))) as sum, s as s)))"""
    path = f"aggregate(sequence(1, n), array(struct(0D as sum, -1 as s)), (t, e) -> concat(t, array({step})))"
    return f"aggregate(array({path}), array(0), (_, t) -> reverse(aggregate(sequence(1, n), array(n), (b, _) -> if(b[size(b) - 1] = 0, b, concat(b, array(t[b[size(b) - 1]].s))))))"


class Words:
    """The words of some texts, in order: bytes (each with its spaces), hash, and where each text's words begin."""

    def __init__(self, texts: list[str], m: Model):
        raw = [b" " + t.encode("utf-8", "surrogatepass").replace(_MARK, b" ") if t else b"" for t in texts]
        self.data = b"".join(raw)
        b = np.frombuffer(self.data, np.uint8)
        starts = np.zeros(len(b), bool)
        for i in range(1, len(b), 1 << 16):  # some at a time: each pair's place is a number of its own
            pairs = b[i - 1 : i - 1 + (1 << 16)].astype(np.int64)[: len(b) - i] * 256 + b[i : i + (1 << 16)]
            starts[i : i + (1 << 16)] = m.cuts[pairs]
        begin = np.cumsum([0, *map(len, raw)])
        starts[begin[:-1][np.diff(begin) > 0]] = True
        self.start = np.flatnonzero(starts)
        self.end = np.append(self.start[1:], len(b))[: len(self.start)]
        self.hash = prefix_hashes(b, self.start, self.end)
        self.first = np.searchsorted(self.start, begin)

    def at(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]]

    def some(self, at: np.ndarray) -> pa.Array:
        """The bytes of the words at these places."""
        start, size = self.start[at], self.end[at] - self.start[at]
        ends, data, parts = np.cumsum(size), np.frombuffer(self.data, np.uint8), [np.zeros(0, np.uint8)]
        for i in range(0, len(at), 1 << 14):  # some at a time: each byte's place is a number of its own
            mine = size[i : i + (1 << 14)]
            to = np.cumsum(mine)
            parts.append(data[np.repeat(start[i : i + (1 << 14)] - to + mine, mine) + np.arange(to[-1])])
        return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(np.concatenate(parts))])


def _chars(word: bytes) -> int:
    return len(word) if len(word) <= LONG else len(word.decode("utf-8", "surrogatepass"))


def _short(words: pa.Array) -> np.ndarray:
    """Which words have at most LONG characters."""
    out = pc.binary_length(words).to_numpy(zero_copy_only=False) <= LONG
    for i in np.flatnonzero(~out).tolist():
        out[i] = _chars(words[i].as_py()) <= LONG
    return out


def distinct_words(docs: DataFrame, path: str) -> DataFrame:
    """word, uses of every distinct word of at most LONG characters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, held, size = model(path), [], 0

        def distinct() -> pa.RecordBatch:
            h = np.concatenate([w.hash for w in held])
            _, first, uses = np.unique(h, return_index=True, return_counts=True)
            order = np.argsort(first)
            first, uses = first[order], uses[order]
            ends = np.cumsum([0, *(len(w.hash) for w in held)])
            cuts = np.searchsorted(first, ends)
            words = pa.concat_arrays([w.some(first[a:b] - end) for w, a, b, end in zip(held, cuts[:-1].tolist(), cuts[1:].tolist(), ends.tolist(), strict=False)])
            short = pa.array(_short(words))
            return pa.RecordBatch.from_arrays([words.filter(short).cast(pa.string()), pa.array(uses).filter(short)], ["word", "uses"])

        for batch in batches:
            held.append(Words([t for t in batch.column(0).to_pylist() if t], m))
            size += len(held[-1].hash)
            if size > CHUNK:
                yield distinct()
                held, size = [], 0
        if size:
            yield distinct()

    return docs.select("text").mapInArrow(count, "word string, uses long").groupBy("word").agg(F.sum("uses").alias("uses"))


def dictionary(docs: DataFrame, path: str) -> DataFrame:
    """word, uses, ids of every distinct word of at most LONG characters."""
    # Grouped by hash, not by sort: a partition's words are few enough to be held, also beside those of the executor's other tasks.
    parts = DEALT * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    settings = {"spark.sql.objectHashAggregate.sortBased.fallbackThreshold": str(HELD), "spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    return stored(lattice(distinct_words(docs, path), path), "dictionary", settings, compression="zstd")


class Lookup:
    """Ids by the words' hashes: an open hash table, and the ids in one array."""

    def __init__(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray):
        self.bits = max(4, int(2 * len(hashes) - 1).bit_length())
        self.ids, self.begin, self.size = ids, _begins(sizes), sizes
        self.table = np.full(1 << self.bits, -1, np.int32)
        self.hashes, left, at = hashes, np.arange(len(hashes), dtype=np.int32), self._slot(hashes)
        while len(left):
            free = self.table[at] < 0
            self.table[at[free]] = left[free]  # of several at one slot the last stays
            lost = self.table[at] != left
            left, at = left[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of the words, -1 where there is none."""
        out, at, left = np.full(len(h), -1, np.int64), self._slot(h), np.arange(len(h))
        while len(left):
            got = self.table[at]
            same = (got >= 0) & (self.hashes[got] == h[left]) if len(self.hashes) else got >= 0
            out[left[same]] = got[same]
            more = (got >= 0) & ~same
            left, at = left[more], (at[more] + 1) & ((1 << self.bits) - 1)
        return out


def frequent_words(known: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, ids and their cuts of at most FREQUENT words: all that are used more often than some number of times."""
    uses = known.groupBy(F.least("uses", F.lit(100_000)).alias("uses")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("uses")).collect()  # 100,000 rows at most
    least, total = 1 << 62, 0
    for r in uses:
        total += r.n
        if total > FREQUENT:
            break
        least = r.uses

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in _packed(batch.column(0), batch.column(1))], ["hashes", "sizes", "ids"])

    top = known.filter(F.col("uses") >= least).select("word", "ids").mapInArrow(pack, "hashes binary, sizes binary, ids binary").collect()
    h, sizes, ids = (np.frombuffer(b"".join(bytes(r[i]) for r in top), t) for i, t in enumerate((np.uint64, np.int32, np.int32)))
    return h, ids.astype(np.uint16 if ids.max(initial=0) < 1 << 16 else np.int32), sizes.astype(np.uint8)  # a word has at most LONG characters, and so bytes


def _begins(sizes: np.ndarray) -> np.ndarray:
    """Where each stretch begins."""
    ends = np.cumsum(sizes, dtype=np.int64)
    return (ends - sizes).astype(np.int32 if len(ends) == 0 or ends[-1] < 1 << 31 else np.int64)


_lookups: dict[str, Lookup] = {}


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, n_ids and whether decoding the ids gives the text again, for every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark, SOME)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = dictionary(rows, path)
    total = known.agg(F.sum("uses")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PART)
    rows = rows.select("doc_id", F.pmod(row_key(rows), F.lit(parts)).alias("part"), "text")
    shared, name = spark.sparkContext.broadcast(frequent_words(known)), uuid.uuid4().hex

    def lookup() -> Lookup:
        if name not in _lookups:
            _lookups.clear()
            _lookups[name] = Lookup(*shared.value)
        return _lookups[name]

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, have = model(path), lookup()
        for batch in (b.slice(at, SOME) for b in batches for at in range(0, b.num_rows, SOME)):  # the job's batches have many narrow rows
            w = Words(batch.column(1).to_pylist(), m)
            new = np.flatnonzero(have.find(w.hash) < 0)
            part = batch.column(0).to_numpy()[np.searchsorted(w.first, new, "right") - 1]
            order = np.lexsort((w.hash[new], part))
            new, part = new[order], part[order]
            once = np.append(True, (part[1:] != part[:-1]) | (w.hash[new][1:] != w.hash[new][:-1]))[: len(new)]
            words = w.some(new[once])
            short = _short(words)
            yield pa.RecordBatch.from_arrays([pa.array(part[once][short]), words.filter(pa.array(short)).cast(pa.string())], ["part", "word"])

    def pack_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, size, ids = _packed(batch.column(1), batch.column(2))
            part = batch.column(0).to_numpy()
            order = np.argsort(part, kind="stable")
            ids = _gather(ids, (np.cumsum(size) - size)[order], size[order])
            part, h, size = part[order], h[order], size[order]
            cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)) if len(part) else np.zeros(1, np.int64)
            at = np.append(0, np.cumsum(size))
            out = [(int(part[a]), h[a:b].tobytes(), size[a:b].tobytes(), ids[at[a] : at[b]].tobytes()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["part", "hashes", "sizes", "ids"])

    def pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([z.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column(2).to_pylist()], pa.binary())], ["doc_id", "part", "text"])

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        m, have, z = model(path), lookup(), zstandard.ZstdDecompressor()
        hashes, sizes, ids = (np.frombuffer(b"".join(right.column(c).to_pylist()), t) for c, t in (("hashes", np.uint64), ("sizes", np.int32), ("ids", np.int32)))
        h, first = np.unique(hashes, return_index=True)  # a word comes once from each task
        rare = Lookup(h, ids, sizes[first])
        rare.begin = _begins(sizes)[first]
        out = []
        full = np.cumsum([len(t) for t in left.column("text").to_pylist()]) // (1 << 20)  # a few texts at a time, or one long one
        for n in np.unique(full).tolist():
            some = left.slice(int(np.searchsorted(full, n)), int((full == n).sum()))
            texts = [z.decompress(t).decode("utf-8", "surrogatepass") for t in some.column("text").to_pylist()]
            got, ends = _encoded(m, have, rare, w := Words(texts, m))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(got))
            n_ids = np.diff(ends)
            whole = spelled(m, got) == w.data
            good = [MARK not in t and (whole or decode(m, got[a:b]) == t) for t, a, b in zip(texts, ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            out.append(pa.Table.from_arrays([some.column("doc_id"), lists, pa.array(n_ids, pa.int64()), pa.array(good, pa.bool_())], ["doc_id", "ids", "n_ids", "round_trip"]))
        return pa.concat_tables(out) if out else pa.table({"doc_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int32())), "n_ids": pa.array([], pa.int64()), "round_trip": pa.array([], pa.bool_())})

    rare = rows.select("part", "text").mapInArrow(others, "part long, word string").join(known.select("word", "ids"), "word")
    # Many narrow rows to a batch, but few bytes: the same job reads whole texts.
    batches = {"spark.sql.execution.arrow.maxRecordsPerBatch": "100000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}
    rare = stored(rare.select("part", "word", "ids").mapInArrow(pack_ids, "part long, hashes binary, sizes binary, ids binary"), "rare-words", batches, compression="zstd")
    forget(known)
    texts = rows.mapInArrow(pack_texts, "doc_id long, part long, text binary")  # what the shuffle moves
    return texts.groupBy("part").cogroup(rare.groupBy("part")).applyInArrow(assemble, "doc_id long, ids array<int>, n_ids long, round_trip boolean")


def _packed(words: pa.Array, ids: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, number of its ids, and all ids."""
    data = words.cast(pa.binary()).to_pylist()
    ends = np.cumsum([0, *map(len, data)])
    h = prefix_hashes(np.frombuffer(b"".join(data), np.uint8), ends[:-1], ends[1:])
    return h, np.asarray(pc.list_value_length(ids), np.int32), np.asarray(ids.flatten(), np.int32)


def _encoded(m: Model, have: Lookup, rare: Lookup, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """All ids of some texts, and where each text's begin."""
    begin, size = np.zeros(len(w.hash), np.int64), np.zeros(len(w.hash), np.int64)
    at, lack = have.find(w.hash), np.arange(len(w.hash))
    arrays, shift = [], 0
    for table, at in ((have, at), (rare, None)):
        at = table.find(w.hash[lack]) if at is None else at
        hit = at >= 0
        begin[lack[hit]], size[lack[hit]] = table.begin[at[hit]].astype(np.int64) + shift, table.size[at[hit]]
        lack = lack[~hit]
        arrays.append(table.ids)
        shift += len(table.ids)
    more: list[int] = []
    for i in lack.tolist():
        word = w.at(i)
        if _chars(word) <= LONG:
            raise KeyError(f"the lattice has no ids of {word!r}")
        found = _long(m, word)
        begin[i], size[i] = shift + len(more), len(found)
        more += found
    ids = _gather(_Chain([*arrays, np.array(more, np.int32)]), begin, size)
    return ids, np.append(0, np.cumsum(size))[w.first]


class _Chain:
    """Arrays one behind another, which are not copied."""

    def __init__(self, parts: list[np.ndarray]):
        self.parts, self.ends = parts, np.cumsum([len(p) for p in parts])

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(at), np.int32)
        of = np.searchsorted(self.ends, at, "right")
        for k, p in enumerate(self.parts):
            mine = of == k
            out[mine] = p[at[mine] - (self.ends[k] - len(p))]
        return out


def _gather(ids, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ids of all words in order."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return ids[np.repeat(begin - ends + size, size) + np.arange(total)] if total else np.zeros(0, np.int32)


def spelled(m: Model, ids: np.ndarray) -> bytes:
    """The bytes of pieces and bytes in order."""
    return b"".join(m.blob[np.repeat(m.begin[i] - np.cumsum(m.size[i]) + m.size[i], m.size[i]) + np.arange(m.size[i].sum())].tobytes() for i in (ids[at : at + (1 << 17)] for at in range(0, len(ids), 1 << 17)))


def _long(m: Model, word: bytes) -> list[int]:
    """A word above LONG characters by the library, whose added first mark is taken off through a line feed that no piece holds."""
    text = word.decode("utf-8", "surrogatepass")
    return m.library.encode("\n" + text)[len(m.library.encode("\n")) :]


def decode(m: Model, ids: np.ndarray) -> str:
    """The text of the ids, without the first mark."""
    return spelled(m, ids).decode("utf-8", "replace")[1:]


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), str(public_tokenizers.path("piece_bpe_32k.model")))


QUERIES, ORACLES = {"op2_sentencepiece": op2_sentencepiece}, {}
