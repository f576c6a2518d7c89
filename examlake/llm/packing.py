"""Packing by lexical retrieval.

Documents are tokenized, whole windows of long documents become sequences of
their own, and what remains of each document is packed with its lexical
neighbours. Document frequencies of terms and the mean length are counted over
all documents, and terms over a document's whole text. Documents are sorted by
min-hashes of their weightiest terms, so near ones lie together however many
there are, and runs of that order are shards: each holds a BM25 inverted index
over its documents, takes a seed document, asks the index for unused neighbours
and fills the window with them greedily, cutting the last one where the window
is full. What is left of the cut document seeds the next window. A shard's last,
unfilled window is cut into sequences whose lengths are powers of two, which
need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .tokens import WordEncoder, slices_by_bytes

WINDOW = 2048
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Weightiest terms of a document that are hashed for its place in the order, and how many of the least hashes that takes.
KEY_TERMS, KEYS = 16, 3


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


@dataclass
class Corpus:
    """What BM25 knows of all documents: their number, mean length, and by term how many hold it."""

    n: int
    mean: float
    df: np.ndarray

    def weight(self, term: np.ndarray, tf: np.ndarray, size: np.ndarray, k1: float = 1.2, b: float = 0.75) -> np.ndarray:
        df = self.df[term]
        return np.log1p((self.n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / max(1.0, self.mean)))


def counted(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The documents' distinct terms in turn, how often each is held, and where each document's begin (one more than documents)."""
    return counted_flat(np.concatenate(docs) if docs else np.zeros(0, np.int64), np.cumsum([0] + [len(d) for d in docs]))


def counted_flat(ids: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """counted() of documents in a row, given where each begins (one more than documents)."""
    n = len(begin) - 1
    small = n < 1 << 16 and (ids.itemsize <= 2 or not len(ids) or int(ids.max()) < 1 << 16)
    kind, bits = (np.uint32, 16) if small else (np.uint64, 32)  # narrow keys sort faster
    pairs, tf = np.unique((np.repeat(np.arange(n, dtype=kind), np.diff(begin)) << kind(bits)) | ids.astype(kind), return_counts=True)
    return (pairs & kind((1 << bits) - 1)).astype(np.int64), tf, np.searchsorted(pairs >> kind(bits), np.arange(n + 1))


class Bm25Index:
    """Inverted index over token-id arrays; BM25 with the usual k1 and b, a query's terms counting once each.

    held, if given, has the terms of longer texts that docs are parts of (see
    counted) and the lengths of these; corpus, if given, covers more documents.
    """

    def __init__(
        self,
        docs: list[np.ndarray],
        held: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None = None,
        corpus: Corpus | None = None,
    ) -> None:
        n = len(docs)
        term, tf, begin, sizes = held or (*counted(docs), np.fromiter(map(len, docs), np.int64, n))
        terms, code = np.unique(term, return_inverse=True)
        corpus = corpus or Corpus(n, sizes.mean() if n else 1.0, np.bincount(term))
        owner = np.repeat(np.arange(n), np.diff(begin))
        weight = corpus.weight(term, tf, sizes[owner])
        by_term = np.argsort(code, kind="stable")
        self.doc, self.weight = owner[by_term], weight[by_term]
        self.begin = np.searchsorted(code[by_term], np.arange(len(terms) + 1))
        self.query_term, self.query_begin, self.n = code, begin, n

    def scores(self, doc: int) -> np.ndarray:
        """Every document's score for the query made of all of doc's terms (0 for documents that forget() has left out)."""
        terms = self.query_term[self.query_begin[doc] : self.query_begin[doc + 1]]
        if not len(terms):
            return np.zeros(self.n)
        cuts = list(zip(self.begin[terms].tolist(), self.begin[terms + 1].tolist(), strict=True))
        return np.bincount(np.concatenate([self.doc[a:b] for a, b in cuts]), np.concatenate([self.weight[a:b] for a, b in cuts]), minlength=self.n)

    def forget(self, gone: np.ndarray) -> None:
        """Leave documents (a mask) out of the posting lists; they can still be asked for."""
        keep = ~gone[self.doc]
        self.begin = np.concatenate([[0], np.cumsum(keep)])[self.begin]
        self.doc, self.weight = self.doc[keep], self.weight[keep]


def fill_windows(docs: list[np.ndarray], window: int, held: tuple | None = None, corpus: Corpus | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, from, to) that hold each document's ids once; all but the last few are full."""
    index = Bm25Index(docs, held=held, corpus=corpus)
    sizes = [len(d) for d in docs]
    unused = np.fromiter((s > 0 for s in sizes), bool, len(docs))
    begun = np.zeros(len(docs), np.int64)
    out: list[list[tuple[int, int, int]]] = []
    seed, scan, listed = -1, 0, len(docs)
    while True:
        if seed < 0:
            while scan < len(docs) and not unused[scan]:
                scan += 1
            if scan == len(docs):
                break
            seed = scan
        pieces, room = [], window
        order: list[int] = [seed]
        at, depth = 0, 16
        next_seed = -1
        score = None
        while room:
            if at == len(order):
                free = np.flatnonzero(unused)
                if not len(free):
                    break
                if score is None:
                    if len(free) < 0.75 * listed:
                        index.forget(~unused)
                        listed = len(free)
                    score = index.scores(seed)
                s = score[free]
                few = np.argpartition(-s, depth)[:depth] if len(free) > depth else np.arange(len(free))
                order = free[few[np.lexsort((free[few], -s[few]))]].tolist()
                at, depth = 0, depth * 4
            d = order[at]
            at += 1
            start = int(begun[d])
            take = min(room, sizes[d] - start)
            pieces.append((d, start, start + take))
            room -= take
            begun[d] += take
            if begun[d] == sizes[d]:
                unused[d] = False
            else:
                next_seed = d
        out.append(pieces)
        seed = next_seed
    return out


def powers_of_two(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces of one sequence dealt to sequences whose lengths are powers of two, largest first."""
    left = sum(b - a for _, a, b in pieces)
    todo, out = list(reversed(pieces)), []
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        out.append([])
        while room:
            d, a, b = todo.pop()
            take = min(room, b - a)
            out[-1].append((d, a, a + take))
            room -= take
            if a + take < b:
                todo.append((d, a + take, b))
    return out


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, shard_docs: int = 1024, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for).

    A document's ids are its text's and end_id; a null text is empty, so each
    document has one id at least. Each id lies in exactly one piece. All
    sequences have window ids, but for the last of each shard, whose lengths are
    powers of two. Shards hold shard_docs documents at most, consecutive ones of
    an order by content; equal ones by hashed doc_id, ids and row, so that groups
    of copies of any size are cut as well. Where shards begin depends on a sample
    of the rows, so two runs can pack alike documents differently. Retrieval asks with all terms of a whole
    document and sees the whole documents of its shard. Rows that agree in all ids are interchangeable.
    Rows with one doc_id are separate documents. Only doc_id and text are read;
    an empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer_path)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            for at, n in slices_by_bytes(texts, 16_000_000):
                ids, begin = encoder.encode(texts.slice(at, n))
                ids, begin = np.insert(ids, begin[1:], end_id), begin + np.arange(n + 1)
                totals, whole, rest = np.diff(begin), [], []
                for x, y in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                    own = ids[x:y]
                    full = (y - x) // window
                    whole.append([crc(own[k * window : (k + 1) * window]) for k in range(full)])
                    rest.append((own if with_ids else own[full * window :]).tobytes())
                term, tf, cuts = counted_flat(ids, begin)
                term, tf = term.astype("<u4" if encoder.dtype.itemsize == 4 else "<u2"), tf.astype("<u4")
                parts = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(batch.schema.get_field_index("doc_id")).slice(at, n),
                        pa.array(totals, pa.int64()),
                        pa.array(whole, pa.list_(pa.int64())),
                        pa.array(rest, pa.binary()),
                        pa.array([encoder.dtype.itemsize] * n, pa.int32()),
                        pa.array([term[x:y].tobytes() for x, y in parts], pa.binary()),
                        pa.array([tf[x:y].tobytes() for x, y in parts], pa.binary()),
                    ],
                    ["doc_id", "doc_tokens", "whole", "rest", "width", "terms", "tf"],
                )

    def held_by(terms: pa.Array, tf: pa.Array, width: pa.Array, doc_tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        term = [np.frombuffer(r, "<u2" if w == 2 else "<u4") for r, w in zip(terms.to_pylist(), width.to_pylist(), strict=True)]
        none = [np.zeros(0, np.int64)]
        often = np.frombuffer(b"".join(tf.to_pylist()), "<u4").astype(np.int64)
        return np.concatenate(none + term).astype(np.int64), often, np.cumsum([0] + [len(t) for t in term]), np.array(doc_tokens.to_pylist(), np.int64)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(0, np.int64)
        for batch in batches:
            for r, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                term = np.frombuffer(r, "<u2" if w == 2 else "<u4")
                if len(term) and term[-1] >= len(df):  # terms are sorted
                    df = np.append(df, np.zeros(int(term[-1]) + 1 - len(df), np.int64))
                df[term] += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["term", "df"])

    outline = f"doc_id {kind}, doc_tokens long, whole array<long>, rest binary, width int, terms binary, tf binary"
    tokens = docs.select("doc_id", "text").mapInArrow(tokenize, outline)
    tokens = materialize(tokens.withColumn("salt", F.xxhash64("doc_id", "rest", F.monotonically_increasing_id())), "packing-tokens")
    n, ids = tokens.agg(F.count(F.lit(1)), F.coalesce(F.sum("doc_tokens"), F.lit(0))).first()
    counts = tokens.select("terms", "width").mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()  # a row for each of the vocabulary at most
    df = np.zeros(int(counts["term"].max()) + 1 if len(counts) else 1, np.int64)
    df[counts["term"].to_numpy(np.int64)] = counts["df"].to_numpy(np.int64)
    corpus = docs.sparkSession.sparkContext.broadcast(Corpus(n, ids / max(n, 1), df))
    mixed = np.random.default_rng(0).permutation(len(df))

    order_by = [f"key{k}" for k in range(KEYS)] + ["salt"]

    @F.arrow_udf("struct<" + ",".join(f"{c}:long" for c in order_by[:KEYS]) + ">")
    def keyed(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            term, tf, begin, size = held_by(*batch)
            weight = -corpus.value.weight(term, tf, np.repeat(size, np.diff(begin)))
            mix = mixed[term]
            keys = np.full((len(size), KEYS), -1, np.int64)
            for i, (x, y) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)):
                least = np.sort(mix[x:y][np.argsort(weight[x:y], kind="stable")[:KEY_TERMS]])[:KEYS]
                keys[i, : len(least)] = least
            yield pa.StructArray.from_arrays([pa.array(keys[:, k]) for k in range(KEYS)], order_by[:KEYS])

    # written, for dealing by ranges reads its input twice
    salted = materialize(tokens.select("*", keyed("terms", "tf", "width", "doc_tokens").alias("keys")).select(*tokens.columns, "keys.*"), "packing-keyed")
    discard(tokens)
    # a few shards in each partition, so that few of them are cut short by its end
    parts = max(1, min(-(-n // (4 * shard_docs)), 64 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    tokens = salted.repartitionByRange(parts, *order_by).sortWithinPartitions(*order_by).drop(*order_by)
    extra = ", ids array<long>" if with_ids else ""

    def assemble(table: pa.Table, number: int) -> tuple[pa.Table, int]:
        ids = table.column("doc_id").to_pylist()
        totals = table.column("doc_tokens").to_pylist()
        whole = table.column("whole").to_pylist()
        raw = [np.frombuffer(r, "<u2" if w == 2 else "<u4") for r, w in zip(table.column("rest").to_pylist(), table.column("width").to_pylist(), strict=True)]
        term, tf, begin, sizes = held_by(*[table.column(c) for c in ("terms", "tf", "width", "doc_tokens")])
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0, totals[i], whole[i], raw[i].tobytes()))
        rows: list[tuple] = []
        tails = []
        for i in order:
            full = len(whole[i])
            for k, c in enumerate(whole[i]):
                rows.append((ids[i], k * window, window, c, totals[i], number, 0, raw[i][k * window : (k + 1) * window] if with_ids else None))
                number += 1
            tails.append(raw[i][full * window :] if with_ids else raw[i])
        at = [np.arange(begin[i], begin[i + 1]) for i in order]
        flat = np.concatenate(at)
        for pieces in fill_windows(tails, window, (term[flat], tf[flat], np.cumsum([0] + [len(x) for x in at]), sizes[order]), corpus.value):
            size = sum(b - a for _, a, b in pieces)
            for sequence in [pieces] if size == window else powers_of_two(pieces):
                offset = 0
                for d, a, b in sequence:
                    i = order[d]
                    part = tails[d][a:b]
                    rows.append((ids[i], len(whole[i]) * window + a, b - a, crc(part), totals[i], number, offset, part if with_ids else None))
                    offset += b - a
                number += 1
        cols = list(zip(*rows, strict=True)) or [()] * 8
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        arrays = [pa.array(cols[0], table.schema.field("doc_id").type)] + [pa.array(c, pa.int64()) for c in cols[1:7]]
        if with_ids:
            names.append("ids")
            arrays.append(pa.array([x.tolist() for x in cols[7]], pa.list_(pa.int64())))
        return pa.table(arrays, names), number

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows, number = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, shard_docs - rows)
                batch = batch.slice(part.num_rows)
                waiting.append(part)
                rows += part.num_rows
                if rows == shard_docs:
                    out, number = assemble(pa.Table.from_batches(waiting), number)
                    waiting, rows = [], 0
                    yield from out.to_batches()
        if waiting:
            yield from assemble(pa.Table.from_batches(waiting), number)[0].to_batches()

    return tokens.mapInArrow(shards, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long{extra}")
