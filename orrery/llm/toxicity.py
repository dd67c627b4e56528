"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as its own embedding (words of the training texts that are not
rare) and as the mean embedding of its character n-grams. A window of 32 words
goes through a GRU in both directions; attention pools its states into one
logit. Windows overlap by half and cover the whole text; a text's score is
that of its most toxic window. Training sees only texts' labels: a text's
logit is the log-sum-exp of its windows', by Adam, in numpy in one task, from a
sample bounded by MAX_TRAIN and MAX_TRAIN_CHARS.

Edge cases: a null or blank text is scored as one window without words; rows
that share an id are scored one by one, and a label of theirs counts for each
in training; null labels are left out; without labels of both classes every
text gets the share of toxic labels seen (0 if none) as its score; an empty
table gives an empty table. Only the named columns are read, so further
columns can't clash. Labels, language, source and id are never inputs.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import split_words, table, text_slices, unused

#: At most this many labelled texts train the model: those whose hashed ids are smallest.
MAX_TRAIN = 4000
#: Longer texts are scored as any other but not trained on; with MAX_TRAIN it bounds the memory of the task that trains.
MAX_TRAIN_CHARS = 100_000
STEPS, STRIDE = 32, 16
WORD_DIM, CHAR_DIM, HIDDEN, BUCKETS, MAX_VOCAB = 8, 16, 8, 1 << 13, 20_000
EPOCHS, BATCH, RATE, TOXIC_WEIGHT = 4, 32, 0.01, 2.0
MARKS = " \t\n\r\x0b\x0c.,;:!?\"'()[]{}<>|*#$%&-_=+/\\~`^"


#: Multipliers of the hashes of character runs: odd, so that no character is lost.
RUN, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def plain(words: pa.Array) -> pa.Array:
    """Words in lower case without the marks around them."""
    return pc.utf8_trim(pc.utf8_lower(words), MARKS)


def bucket(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((h * SPREAD) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32)


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts): the character runs of three and five of each word, with its ends marked, and the whole.

    A run's hash is a polynomial of its code points. All words are hashed at
    once: runs that cross from one word into the next are left out.
    """
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    c = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), size)
    starts = np.cumsum(size) - size
    left = np.repeat(starts + size, size) - np.arange(len(c))
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(size.max(initial=1)), RUN, np.uint64))
        found, whose = [np.add.reduceat(c * power[left - 1], starts)], [np.arange(len(words))]
        for n in (3, 5):
            h = c[: len(c) - n + 1].copy()
            for k in range(1, n):
                h *= RUN
                h += c[k : len(c) - n + 1 + k]
            whole = left[: len(h)] >= n
            found.append(h[whole] + np.uint64(n))
            whose.append(owner[: len(h)][whole])
    whose = np.concatenate(whose)
    return bucket(np.concatenate(found))[np.argsort(whose, kind="stable")], np.bincount(whose, minlength=len(words)).astype(np.int32)


def window_starts(n: int) -> range:
    """Starts of overlapping windows that cover n words; one for an empty text."""
    return range(0, max(n - STRIDE, 1), STRIDE)


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def init(words: list[str], seed: int = 11) -> dict:
    g = np.random.default_rng(seed)
    f = lambda *s, scale=0.1: (g.standard_normal(s) * scale).astype(np.float32)
    d, h = WORD_DIM + CHAR_DIM, HIDDEN
    p = {"word": f(len(words) + 1, WORD_DIM), "char": f(BUCKETS, CHAR_DIM, scale=0.3), "wx": f(d, 6 * h, scale=d**-0.5), "b": np.zeros(6 * h, np.float32), "u0": f(h, 3 * h, scale=h**-0.5), "u1": f(h, 3 * h, scale=h**-0.5), "wa": f(2 * h, 2 * h, scale=(2 * h) ** -0.5), "va": f(2 * h, scale=0.5), "out": f(2 * h, scale=0.5), "bias": np.full(1, -3, np.float32)}
    p["word"][0] = 0
    return p


def gru(x, mask, u, keep=None):
    """States (T, B, H) of one direction over projected inputs x (T, B, 3H); masked steps keep the state."""
    t_max, n, h3 = x.shape
    h_dim = h3 // 3
    h = np.zeros((n, h_dim), np.float32)
    out = np.empty((t_max, n, h_dim), np.float32)
    for t in range(t_max):
        q = h @ u
        rz = sigmoid(x[t, :, : 2 * h_dim] + q[:, : 2 * h_dim])
        r, z = rz[:, :h_dim], rz[:, h_dim:]
        c = np.tanh(x[t, :, 2 * h_dim :] + r * q[:, 2 * h_dim :])
        m = mask[t][:, None]
        if keep is not None:
            keep.append((h, rz, c, q[:, 2 * h_dim :], m))
        h = h + m * (1 - z) * (c - h)
        out[t] = h
    return out


def gru_back(d_out, kept, u, d_u):
    """Gradients of the projected inputs; adds that of u to d_u."""
    t_max, n, h_dim = d_out.shape
    d_x = np.empty((t_max, n, 3 * h_dim), np.float32)
    d_h = np.zeros((n, h_dim), np.float32)
    for t in range(t_max - 1, -1, -1):
        h, rz, c, qn, m = kept[t]
        r, z = rz[:, :h_dim], rz[:, h_dim:]
        d_h = d_h + d_out[t]
        d_new = d_h * m
        d_z = d_new * (h - c) * z * (1 - z)
        d_c = d_new * (1 - z) * (1 - c * c)
        d_r = d_c * qn * r * (1 - r)
        d_x[t] = np.concatenate((d_r, d_z, d_c), axis=1)
        d_q = np.concatenate((d_r, d_z, d_c * r), axis=1)
        d_u += h.T @ d_q
        d_h = d_h * (1 - m) + d_new * z + d_q @ u.T
    return d_x


def forward(p, proj, at, mask, kept=None):
    """Window logits from rows ``at`` (T, B) of projected words; mask (T, B)."""
    h = HIDDEN
    k0, k1 = ([], []) if kept is not None else (None, None)
    ahead = gru(proj[:, : 3 * h][at], mask, p["u0"], k0)
    back = gru(proj[:, 3 * h :][at[::-1]], mask[::-1], p["u1"], k1)[::-1]
    s = np.concatenate((ahead, back), axis=2)
    a = np.tanh(s @ p["wa"])
    e = np.exp(a @ p["va"]) * mask
    w = e / (e.sum(axis=0) + 1e-9)
    pooled = (w[:, :, None] * s).sum(axis=0)
    if kept is not None:
        kept += [k0, k1, s, a, w, pooled]
    return pooled @ p["out"] + p["bias"][0]


def backward(p, at, kept, d_logit, rows, grad):
    """Gradient of the projected words; adds those of the other parameters to ``grad``."""
    k0, k1, s, a, w, pooled = kept
    h = HIDDEN
    grad["out"] += pooled.T @ d_logit
    grad["bias"] += d_logit.sum()
    d_pool = d_logit[:, None] * p["out"]
    d_w = (s * d_pool).sum(axis=2)
    d_e = w * (d_w - (w * d_w).sum(axis=0))
    grad["va"] += np.einsum("tb,tbk->k", d_e, a)
    d_a = d_e[:, :, None] * p["va"] * (1 - a * a)
    grad["wa"] += np.einsum("tbi,tbj->ij", s, d_a)
    d_s = w[:, :, None] * d_pool + d_a @ p["wa"].T
    d0 = gru_back(d_s[:, :, :h], k0, p["u0"], grad["u0"])
    d1 = gru_back(np.ascontiguousarray(d_s[::-1, :, h:]), k1, p["u1"], grad["u1"])[::-1]
    return sums(at.ravel(), np.concatenate((d0, d1), axis=2).reshape(-1, 6 * h), rows)


def sums(at, x, rows):
    """x summed by row number."""
    out = np.zeros((rows, x.shape[1]), np.float32)
    order = np.argsort(at, kind="stable")
    at = at[order]
    if len(at):
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        out[at[first]] = np.add.reduceat(x[order], first, axis=0)
    return out


def layout(lengths: list[int], starts_at: np.ndarray):
    """Indexes (T, B) into concatenated words, mask (T, B), and each window's text."""
    first, text = [], []
    for i, n in enumerate(lengths):
        for s in window_starts(n):
            first.append(starts_at[i] + s)
            text.append(i)
    text = np.array(text, np.int64)
    end = (starts_at + np.array(lengths, np.int64))[text]
    at = np.array(first, np.int64) + np.arange(STEPS)[:, None]
    mask = at < end
    return np.where(mask, at, 0), mask.astype(np.float32), text


def features(words: list[str], vocab: dict[str, int], most: int = 5_000):
    """(vocabulary places, n-gram buckets, their counts) of distinct words, so many at a time."""
    made = [ngrams(words[at : at + most]) for at in range(0, len(words), most)] or [ngrams([])]
    return np.array([vocab.get(w, 0) for w in words], np.int32), *(np.concatenate(x) for x in zip(*made))


def inputs(p, ids, grams, n):
    starts = np.concatenate(([0], np.cumsum(n)[:-1]))
    chars = np.add.reduceat(p["char"][grams], starts, axis=0) / n[:, None]
    return np.concatenate((p["word"][ids], chars), axis=1).astype(np.float32)


def coded_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, codes, counts) as split_words, of plain words."""
    words, codes, counts = split_words(texts)
    own = plain(words).dictionary_encode()
    return own.dictionary, own.indices.to_numpy()[codes], counts


def train(texts: list[str], labels: list[int], seed: int = 11):
    """(parameters, vocabulary) from whole texts; None without both classes."""
    if len(set(labels)) < 2:
        return None
    place: dict[str, int] = {}
    coded = []
    for at in range(0, len(texts), 500):
        words, codes, counts = coded_words(pa.array(texts[at : at + 500], pa.string()))
        codes = np.array([place.setdefault(w, len(place)) for w in words.to_pylist()], np.int32)[codes]
        coded += np.split(codes, np.cumsum(counts)[:-1])
    every = list(place) or [""]
    del place
    df = np.zeros(len(every), np.int64)
    for c in coded:
        df[np.unique(c)] += 1
    words = [every[i] for i in sorted(np.flatnonzero(df >= 3).tolist(), key=lambda i: (-df[i], every[i]))][:MAX_VOCAB]
    vocab = {w: i + 1 for i, w in enumerate(words)}
    ids, grams, n = features(every, vocab)
    gram_at = np.concatenate(([0], np.cumsum(n)))
    y = np.array(labels, np.float32)
    p = init(words, seed)
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    rng, step = np.random.default_rng(seed), 0
    epochs = max(EPOCHS, min(40, EPOCHS * 1000 // len(coded)))
    total = epochs * -(-len(coded) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(coded))
        for lo in range(0, len(order), BATCH):
            own = order[lo : lo + BATCH]
            lengths = [len(coded[i]) for i in own]
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            flat = np.concatenate([coded[i] for i in own] + [np.zeros(1, np.int64)])
            used, row = np.unique(flat, return_inverse=True)
            at, mask, text = layout(lengths, starts)
            g_at = np.concatenate([np.arange(gram_at[u], gram_at[u + 1]) for u in used])
            x = inputs(p, ids[used], grams[g_at], n[used])
            proj = x @ p["wx"] + p["b"]
            kept: list = []
            at = row[at]
            logit = forward(p, proj, at, mask, kept)
            top = np.full(len(own), -np.inf)
            np.maximum.at(top, text, logit)
            e = np.exp(logit - top[text])
            z = np.bincount(text, e, len(own))
            doc = top + np.log(z)
            target = y[own]
            d_doc = (sigmoid(doc) - target) * np.where(target > 0, TOXIC_WEIGHT, 1) / len(own)
            d_logit = (d_doc[text] * e / z[text]).astype(np.float32)
            grad = {k: np.zeros_like(v) for k, v in p.items()}
            d_proj = backward(p, at, kept, d_logit, len(used), grad)
            grad["wx"], grad["b"] = x.T @ d_proj, d_proj.sum(axis=0)
            d_x = d_proj @ p["wx"].T
            grad["word"] = sums(ids[used], d_x[:, :WORD_DIM], len(p["word"]))
            grad["word"][0] = 0
            per = np.repeat(np.arange(len(used)), n[used])
            grad["char"] = sums(grams[g_at], d_x[per, WORD_DIM:] / n[used][per, None], BUCKETS)
            step += 1
            rate = RATE * min(1.0, 2.0 * (1 - step / (total + 1)))
            norm = np.sqrt(sum(float((v * v).sum()) for v in grad.values()))
            scale = min(1.0, 1.0 / (norm + 1e-9))
            for k, v in grad.items():
                v *= scale
                m1[k] += 0.1 * (v - m1[k])
                m2[k] += 0.01 * (v * v - m2[k])
                p[k] -= (rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return p, vocab


def scores(p: dict, vocab: dict[str, int], texts: pa.Array) -> np.ndarray:
    """Scores of whole texts: that of each text's most toxic window."""
    out = [np.empty(0)]
    for lo, hi in text_slices(texts, 2 << 20):
        words, codes, counts = coded_words(texts.slice(lo, hi - lo))
        words = words.to_pylist() or [""]
        proj = np.empty((len(words), 6 * HIDDEN), np.float32)
        for at in range(0, len(words), 5_000):
            proj[at : at + 5_000] = inputs(p, *features(words[at : at + 5_000], vocab)) @ p["wx"] + p["b"]
        flat = np.append(codes, 0)
        at, mask, text = layout(counts.tolist(), np.cumsum(counts) - counts)
        logit = np.concatenate([forward(p, proj, flat[at[:, i : i + 1024]], mask[:, i : i + 1024]) for i in range(0, at.shape[1], 1024)])
        top = np.full(len(counts), -np.inf)
        np.maximum.at(top, text, logit)
        out.append(sigmoid(top.astype(np.float64)))
    return np.concatenate(out)


def held_out(id_col):
    """Ids whose labels are never learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MAX_TRAIN) -> DataFrame:
    """(text, y) of at most ``most`` rows with labelled ids that are not held out, in one partition."""
    own = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    own = own.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.md5(F.col("id").cast("string")), "id").limit(most)
    # ``most`` rows at the most.
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.make_valid_utf8(F.col(text_col).cast("string")), F.lit("")).alias("text")).where(F.length("text") <= MAX_TRAIN_CHARS).join(F.broadcast(own), "id")
    return rows.orderBy(F.md5(F.col("id").cast("string")), "id", "text").limit(most).select("text", "y")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    """(model, base rate) from the sample: one task trains, the driver gets the parameters, whose size is fixed."""

    def run(batches):
        texts, y = [], []
        for b in batches:
            texts += b.column(0).to_pylist()
            y += b.column(1).to_pylist()
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps((train(texts, y), sum(y) / len(y) if y else 0.0))], pa.binary())})

    made = sample(docs, labels, id_col, text_col).coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(made["model"]) if made else (None, 0.0)


def _scorer(model, docs: DataFrame, base_rate: float):
    """A function from texts (Arrow array) to scores, for use in tasks."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(texts: pa.Array) -> np.ndarray:
        return scores(*shared.value, texts) if shared.value else np.full(len(texts), base_rate)

    return of


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", base_rate: float = 0.0) -> DataFrame:
    """(id, score) of every row; model from ``train``."""
    of = _scorer(model, docs, base_rate)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(of(b.column(1)), pa.float64())], ["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.make_valid_utf8(F.col(text_col).cast("string")).alias("text")).mapInArrow(run, "id long, score double")


def keep(docs: DataFrame, model, text_col: str = "text", base_rate: float = 0.0, below: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores less than ``below``."""
    of = _scorer(model, docs, base_rate)
    (text,) = unused(docs, "toxicity_text")
    own = list(range(len(docs.columns)))

    def run(batches):
        for b in batches:
            yield b.select(own).filter(pa.array(of(b.column(len(own))) < below))

    return docs.withColumn(text, F.make_valid_utf8(docs[text_col].cast("string"))).mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row of ``docs``."""
    model, rate = fit(docs, labels, id_col, text_col)
    out = score(docs, model, id_col, text_col, rate)
    return out.select("id", held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")
