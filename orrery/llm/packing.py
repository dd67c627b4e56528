"""Mixture-controlled packing of token sequences by deficit round-robin.

Every source is a queue. In round w a queue may serve ``window`` tokens times
its share of all tokens; what it can't serve in whole quanta stays as its
deficit for later rounds. Its service up to round w is therefore the floor of
w times its rate, in quanta: a closed form, so any task can place any
document without the rounds before it. The rounds, laid end to end, are cut
into windows of exactly ``window`` tokens; a queue's count in a window is off
its target by its deficit, which is carried over windows and over partitions.

Edge cases: a null or empty text has the end token alone; a null source is a
queue of its own; rows that share an id are packed one by one; an empty table
gives an empty table; a very long document is cut over many windows. The
tokens left for the last, short window go to sequences of a power of two
each, which need no padding.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import split_words, store, text_slices, worker_state

#: Cells of the table of rounds and queues that a task has at a time.
CELLS = 1 << 20
#: Rows of offsets (about 40 bytes each) up to which they are broadcast.
MAX_BROADCAST = 100_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Words of these characters take the short way: no white space, composed already, and
#: no character whose lower case depends on its context or differs between libraries.
PLAIN = "[\x21-\x7e\u00a1-\u012f\u0131-\u024f]+"
#: The tokenizer file's own pre-token pattern (fixed value).
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Letters of plain words, and marks: neither letters, digits nor white space, so that a run of them is one pre-token.
LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha())
MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum())


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Lately(dict):
    """f(key) of keys met lately; holds up to twice ``most``: a bound on memory, not on what is computed."""

    def __init__(self, f, most: int):
        self.f, self.most, self.old = f, most, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.f(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


def rows_of(table: np.ndarray, n: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, counts): rows of a ragged table, given as its values and row lengths ``n``, one after the other."""
    first, m = (np.cumsum(n) - n)[rows], n[rows]
    ends = np.cumsum(m)
    return table[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + m, m)], m


class WordIds:
    """Ids of words, from a tokenizer that drops white space.

    No token spans ASCII white space, so a text's ids are its words' ids in
    turn. Only the distinct words of a batch are encoded: simple ones, which
    are cut into their pre-tokens all at once, by the tokenizer's model, other
    plain ones likewise but one by one, any other by the whole tokenizer.
    """

    def __init__(self, path: str, most: int = 250_000):
        import regex
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.whole, self.model = whole.encode, whole.model.tokenize
        self.kind = np.dtype("<u2" if whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.plain, self.pretokens, self.letters = re.compile(PLAIN).fullmatch, regex.compile(PRETOKEN).findall, byte_letters()
        self.words, self.parts = Lately(self.word, most // 5), Lately(self.part, most)

    def part(self, p: str) -> bytes:
        """Ids of one pre-token in lower case."""
        return np.array([t.id for t in self.model(p if p.isascii() else "".join(self.letters[b] for b in p.encode()))], self.kind).tobytes()

    def word(self, word: str) -> bytes:
        """Ids of any word."""
        if "<|" in word or not self.plain(word):
            return np.array(self.whole(word, add_special_tokens=False).ids, self.kind).tobytes()
        return b"".join(self.parts[p] for p in self.pretokens(word.lower()))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts): the ids of whole texts, each with the end token, and the number of each text's."""
        words, codes, counts = split_words(texts)
        low = pc.utf8_lower(words)
        core, tail = pc.utf8_rtrim(low, MARKS), pc.utf8_ltrim(low, LETTERS)
        # Letters, then marks: two pre-tokens at the most, as no contraction begins with a letter.
        simple = pc.and_(pc.and_(pc.match_substring_regex(words, f"^{PLAIN}$"), pc.utf8_is_alpha(core)), pc.invert(pc.match_substring(words, "<|")))
        parts = pa.concat_arrays([core.filter(simple), tail.filter(simple)]).dictionary_encode()
        rest = words.filter(pc.invert(simple)).to_pylist()
        each = [self.parts[p] if p else b"" for p in parts.dictionary.to_pylist()] + [self.words[w] for w in rest] + [b"", end_id.to_bytes(self.kind.itemsize, "little")]
        table, n = np.frombuffer(b"".join(each), self.kind), np.fromiter(map(len, each), np.int64, len(each)) // self.kind.itemsize
        simple = simple.to_numpy(zero_copy_only=False)
        rows = np.full((len(words) + 1, 2), len(each) - 2)
        rows[:-1][simple] = parts.indices.to_numpy().reshape(2, -1).T
        rows[:-1, 0][~simple] = len(parts.dictionary) + np.arange(len(rest))
        rows[-1, 0] = len(each) - 1
        table, n = rows_of(table, n, rows.ravel())
        ids, n = rows_of(table, n.reshape(-1, 2).sum(axis=1), np.insert(codes, np.cumsum(counts), len(words)))
        ends = np.cumsum(n)
        return ids, np.diff(ends[np.cumsum(counts + 1) - 1], prepend=0)


def word_ids(path: str) -> WordIds:
    kept = worker_state("packing")
    if path not in kept:
        kept[path] = WordIds(path)
    return kept[path]


def tokenize(docs: DataFrame, id_col: str, text_col: str, source_col: str, tokenizer: str, end_id: int) -> DataFrame:
    """(part, at, id, source, n, ids): a document's tokens, and how many its source has before it in the partition."""

    def run(batches):
        known, part, done = word_ids(tokenizer), TaskContext.get().partitionId(), {}
        for b in batches:
            for lo, hi in text_slices(b.column(1)):
                c = b.slice(lo, hi - lo)
                ids, n = known.encode(c.column(1), end_id)
                before = []
                for s, k in zip(c.column(2).to_pylist(), n.tolist()):
                    before.append(done.get(s, 0))
                    done[s] = before[-1] + k
                ends = np.concatenate(([0], np.cumsum(n) * known.kind.itemsize)).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(n), pa.int32()), pa.array(before, pa.int64()), c.column(0), c.column(2), pa.array(n, pa.int64()), packed], ["part", "at", "id", "source", "n", "ids"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.make_valid_utf8(F.col(text_col).cast("string")).alias("text"), F.col(source_col).cast("string").alias("source"))
    return src.mapInArrow(run, "part int, at long, id long, source string, n long, ids binary")


class Schedule:
    """Where the k-th token of a queue goes."""

    def __init__(self, totals: list[int], window: int, quantum: int):
        self.totals, self.window, self.quantum = np.array(totals, np.int64), window, quantum
        self.all = int(self.totals.sum())
        self.rounds = -(-self.all // window)
        self.rates = self.totals * (window / max(self.all, 1))
        self.whole = self.all - self.all % window

    def served(self, w: np.ndarray, q=slice(None)) -> np.ndarray:
        """Tokens that queues q have served before round w."""
        quanta = np.floor(w * self.rates[q] / self.quantum).astype(np.int64) * self.quantum
        return np.where(w >= self.rounds, self.totals[q], np.minimum(quanta, self.totals[q]))

    def rounds_of(self, q: int, quanta: np.ndarray) -> np.ndarray:
        """The rounds, each once, in which queue q serves its ``quanta`` (ascending numbers); the last round serves all that is left."""
        after = lambda w: np.floor((w + 1) * self.rates[q] / self.quantum)
        w = np.ceil((quanta + 1) * self.quantum / self.rates[q]).astype(np.int64) - 1
        # Rounding may be off by one round either way.
        w += after(w) <= quanta
        w -= after(w - 1) > quanta
        return np.unique(np.clip(w, 0, self.rounds - 1))

    def pieces(self, q: int, first: int, n: int):
        """(start in the document, position in the stream, length) arrays for n tokens from ``first`` on of queue q."""
        w = self.rounds_of(q, np.arange(first // self.quantum, -(-(first + n) // self.quantum)))
        edge = self.served(w, q)
        a, b = np.maximum(edge, first), np.minimum(self.served(w + 1, q), first + n)
        pos = np.empty(len(w), np.int64)
        step = max(1, CELLS // len(self.totals))
        for at in range(0, len(w), step):
            x = w[at : at + step, None]
            # Queues before q have had their turn in the round, q and those after it have not.
            pos[at : at + step] = self.served(x + 1, slice(q)).sum(axis=1) + self.served(x, slice(q, None)).sum(axis=1)
        return a - first, pos + a - edge, b - a

    def cut(self, start: np.ndarray, pos: np.ndarray, n: np.ndarray):
        """Cut pieces where sequences end: (start, length, sequence, offset)."""
        out = []
        last = min(self.whole, self.all)
        for s, p, m in zip(start.tolist(), pos.tolist(), n.tolist()):
            while m:
                if p < last:
                    seq, off = divmod(p, self.window)
                    room = self.window - off
                else:
                    tail, x = self.all - self.whole, p - self.whole
                    bit = (tail ^ x).bit_length() - 1
                    begin = tail >> (bit + 1) << (bit + 1)
                    seq, off = self.whole // self.window + (tail >> (bit + 1)).bit_count(), x - begin
                    room = (1 << bit) - off
                take = min(m, room)
                out.append((s, take, seq, off))
                s, p, m = s + take, p + take, m - take
        return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", window: int = 4096, quantum: int = 16, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    Each id of each document lies in exactly one piece. ``quantum`` is the
    least run of tokens that a queue serves at a time. The tokens are written
    once; only per-partition totals are shuffled.
    """
    spark = docs.sparkSession
    tokens = store(tokenize(docs, id_col, text_col, source_col, tokenizer or default_tokenizer(), end_id), "tokens")
    totals = tokens.groupBy("source", "part").agg(F.sum("n").alias("n"))
    sources = totals.groupBy("source").agg(F.sum("n").alias("total"))
    queue = F.row_number().over(Window.orderBy(F.desc("total"), F.col("source").asc_nulls_last())) - 1
    sources = store(sources.select("source", "total", queue.alias("queue")), "queues")
    # One number a source.
    per_queue = {r["queue"]: r["total"] for r in sources.select("queue", "total").collect()}
    plan = Schedule([per_queue[q] for q in range(len(per_queue))], window, quantum)
    inside = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = store(totals.alias("t").join(sources.alias("s"), F.expr("t.source <=> s.source")).select(F.col("t.source").alias("s"), F.col("part").alias("p"), "queue", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("base")), "bases")
    # One row for each source and partition: counted, it may go to every task, and then no token is shuffled.
    placed = tokens.join(F.broadcast(bases) if bases.count() <= MAX_BROADCAST else bases, F.expr("source <=> s and part = p")).select("id", "n", "ids", "source", "queue", (F.col("base") + F.col("at")).alias("first"))

    def run(batches):
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
        kinds = [pa.int64()] * 7 + [pa.string()]
        for b in batches:
            rows: list[list] = [[] for _ in names]
            for k, n, ids, source, q, first in zip(*(b.column(i).to_pylist() for i in range(6))):
                wide = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4")
                for row in plan.cut(*plan.pieces(q, first, n)):
                    crc = zlib.crc32(wide[row[0] : row[0] + row[1]].tobytes())
                    for col, v in zip(rows, (k, row[0], row[1], crc, n, row[2], row[3], source)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names)

    return placed.mapInArrow(run, "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")


def op10(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
