"""Language identification by a bidirectional gated recurrent network over bytes.

A forward and a backward GRU label every UTF-8 byte of the whole text, white space included, with a
probability for each language, and a document's probabilities are the pooled (mean) logs of those of all
its positions. So that many stretches run at once, a text is cut into cores of INNER bytes. Each direction
starts anew CONTEXT bytes before its core (or at the text's end) and carries its state through the core, so
every position is labelled once and sees at least CONTEXT and at most CONTEXT + INNER bytes on either side, as far as the
text has them. Nothing is left out, whatever the length.

Trained in numpy by backpropagation through time with Adam, on a sample of about SAMPLE_DOCS labelled
rows, as many of each language as there are (QUOTA at least), and PIECES stretches of PIECE characters
of each, from places all over the text that its hash decides. The bound does not depend on the input
but for the number of languages. Rows are chosen by a hash of id and text and copies count once, so rows that share an
id, have none, or repeat a text leave no language out. Rows that share the fate of held-out ones (crc32(doc_id as text)
mod 3 = 1) are never in the sample; lang, source and doc_id are no inputs of a prediction.

Null texts and texts without a letter are `und` with score 0. With no labelled row that is not held out, none can be learned and all are `und`, and an
empty table gives no rows. Of languages with equal probability the first by name wins. Repeated rows are
labelled like any other, each on its own. Other columns, whatever their names, are kept or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import on_workers

UND = "und"
SAMPLE_DOCS, QUOTA, PIECES, PIECE = 1200, 16, 8, 64
INNER, CONTEXT, ROWS, CELLS = 256, 64, 768, 1 << 22
HIDDEN, STEPS, BATCH, RATE = 12, 400, 128, 0.02
PAD = 256


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Gru:
    """One direction. Inputs are byte numbers, so the input weights are a table: W[byte] has update, reset and candidate parts."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.w = rng.normal(0, 0.3, (257, 3 * hidden)).astype(np.float32)
        self.u = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32)

    def run(self, x: np.ndarray, keep: bool = False):
        """x: (time, rows) byte numbers, PAD for padding -> states (time, rows, hidden). Padding leaves the state as it is."""
        steps, rows = x.shape
        h, n = np.zeros((rows, len(self.u)), np.float32), len(self.u)
        states, tape = np.empty((steps, rows, n), np.float32), []
        for t in range(steps):
            gates = self.w[x[t]]
            zr = _sigmoid(gates[:, : 2 * n] + h @ self.u[:, : 2 * n])
            z, r = zr[:, :n], zr[:, n:]
            c = np.tanh(gates[:, 2 * n :] + (r * h) @ self.u[:, 2 * n :])
            z = np.where((x[t] == PAD)[:, None], 0, z)
            new = h + z * (c - h)
            if keep:
                tape.append((h, z, r, c))
            states[t] = h = new
        return states, tape

    def walk(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """The states of run, one (hidden, rows) step at a time. Gates are halved, as sigmoid(v) = (1 + tanh(v / 2)) / 2."""
        n = len(self.u)
        w, u = self.w.T.copy(), self.u.T.copy()
        w[: 2 * n] *= 0.5
        u[: 2 * n] *= 0.5
        w[:n, PAD] = -1e3  # the update gate is 0 at padding
        h = np.zeros((n, x.shape[1]), np.float32)
        for at in x:
            gates = w.take(at, axis=1)
            zr = np.tanh(gates[: 2 * n] + u[: 2 * n] @ h)
            zr += 1
            zr *= 0.5
            c = np.tanh(gates[2 * n :] + u[2 * n :] @ (zr[n:] * h))
            c -= h
            c *= zr[:n]
            h = h + c
            yield h

    def back(self, x: np.ndarray, tape: list, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of w and u through all steps."""
        n = len(self.u)
        dw, du, dh = np.zeros_like(self.w), np.zeros_like(self.u), np.zeros(d_states.shape[1:], np.float32)
        d_gates = np.empty((*x.shape, 3 * n), np.float32)
        for t in range(len(x) - 1, -1, -1):
            h, z, r, c = tape[t]
            dh = dh + d_states[t]
            dc = dh * z * (1 - c * c)
            dz = dh * (c - h) * z * (1 - z)
            drh = dc @ self.u[:, 2 * n :].T
            dr = drh * h * r * (1 - r)
            d = d_gates[t] = np.concatenate([dz, dr, dc], axis=1)
            du[:, : 2 * n] += h.T @ d[:, : 2 * n]
            du[:, 2 * n :] += (r * h).T @ dc
            dh = dh * (1 - z) + drh * r + d[:, : 2 * n] @ self.u[:, : 2 * n].T
        order = np.argsort(x, axis=None, kind="stable")
        codes, first = np.unique(x.ravel()[order], return_index=True)
        dw[codes] = np.add.reduceat(d_gates.reshape(-1, 3 * n)[order], first)
        dw[PAD] = 0
        return dw, du


class Network:
    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs, self.hidden = langs, hidden
        self.ahead, self.behind = Gru(rng, hidden), Gru(rng, hidden)
        self.out = rng.normal(0, 0.3, (2 * hidden + 1, len(langs))).astype(np.float32)

    def labels(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities (time, stretch, language) of every byte position, and which positions are real."""
        x, real = _matrix(words)
        a, _ = self.ahead.run(x)
        b, _ = self.behind.run(x[::-1])
        return self._logits(a, b[::-1])[0], real

    def pooled(self, x: np.ndarray, before: int, inner: int) -> np.ndarray:
        """Sums (row, language) of the log probabilities of the real positions among x[before : before + inner]; the rest is context."""
        n, last = self.hidden, len(x) - 1
        out = self.out.T.copy()
        logits = np.empty((inner, len(self.langs), x.shape[1]), np.float32)
        for t, h in enumerate(self.ahead.walk(x[: before + inner])):
            if t >= before:
                logits[t - before] = out[:, :n] @ h + out[:, 2 * n :]
        for t, h in enumerate(self.behind.walk(x[: before - 1 if before else None : -1])):
            if (at := last - t - before) < inner:
                logits[at] += out[:, n : 2 * n] @ h
        logits -= logits.max(axis=1, keepdims=True)
        logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
        logits *= (x[before : before + inner] != PAD)[:, None, :]
        return logits.sum(axis=0, dtype=np.float64).T

    def _logits(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = np.concatenate([a, b, np.ones((*a.shape[:2], 1), np.float32)], axis=2)
        logits = both @ self.out
        logits -= logits.max(axis=2, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=2, keepdims=True)), both

    def step(self, words: list[bytes], target: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Gradients for one batch; every real position is to carry its document's language."""
        x, real = _matrix(words)
        a, tape_a = self.ahead.run(x, True)
        b, tape_b = self.behind.run(x[::-1], True)
        logs, both = self._logits(a, b[::-1])
        d = np.exp(logs)
        d[:, np.arange(len(words)), target] -= 1
        d *= (real * weight)[:, :, None] / max(1.0, float((real * weight).sum()))
        d = d.astype(np.float32)
        d_out = np.einsum("twh,twl->hl", both, d)
        d_both = d @ self.out.T
        n = self.hidden
        return [*self.ahead.back(x, tape_a, d_both[:, :, :n]), *self.behind.back(x[::-1], tape_b, d_both[::-1, :, n : 2 * n]), d_out]

    def parameters(self) -> list[np.ndarray]:
        return [self.ahead.w, self.ahead.u, self.behind.w, self.behind.u, self.out]


def _matrix(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    x = np.full((max(map(len, words)), len(words)), PAD, dtype=np.int64)
    for k, w in enumerate(words):
        x[: len(w), k] = np.frombuffer(w, np.uint8)
    return x, (x != PAD).astype(np.float32)


def train(sample: list[tuple[str, str]], hidden: int = HIDDEN, steps: int = STEPS, seed: int = 7) -> Network | None:
    """sample: (stretch of text, lang). Languages weigh alike, whatever their share."""
    pairs = [(text.encode("utf-8", "surrogatepass"), lang) for text, lang in sample if text]
    if not pairs:
        return None
    langs = sorted({lang for _, lang in pairs})
    net, rng = Network(langs, hidden, seed), np.random.default_rng(seed)
    words, target = [w for w, _ in pairs], np.array([langs.index(x) for _, x in pairs])
    share = np.bincount(target, minlength=len(langs)).astype(np.float32)
    weight = (len(target) / (len(langs) * share))[target].astype(np.float32)
    first, second = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()]
    for t in range(1, steps + 1):
        chosen = rng.integers(0, len(words), BATCH)
        rate = RATE * (1 - 0.9 * t / steps)
        for p, g, m, v in zip(net.parameters(), net.step([words[k] for k in chosen], target[chosen], weight[chosen]), first, second, strict=True):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return net


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of the texts (null: none) and where each text begins and ends in them."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8), ends


def predict(net: Network | None, texts: pa.Array) -> tuple[list[str], list[float]]:
    """The language and its pooled probability of each whole text."""
    if net is None or not len(texts):
        return [UND] * len(texts), [0.0] * len(texts)
    data, ends = _bytes(texts)
    known = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    size = np.diff(ends)
    cores = np.where(known, -(-size // INNER), 0)
    doc = np.repeat(np.arange(len(size)), cores)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(cores) - cores, cores)) * INNER  # of each core in its text
    length = np.minimum(INNER, size[doc] - start)
    logs = np.zeros((len(size), len(net.langs)))
    order = np.argsort(length, kind="stable")  # cores of like lengths pad little
    rows = max(16, min(ROWS, CELLS // (INNER * len(net.langs))))
    for at in range(0, len(order), rows):
        part = order[at : at + rows]
        inner, before = int(length[part[-1]]), min(CONTEXT, int(start[part].max()))
        after = CONTEXT if inner == INNER else 0  # a shorter core is its text's last
        place = start[part] + np.arange(-before, inner + after)[:, None]
        real = (place >= 0) & (place < size[doc[part]])
        x = np.where(real, data[np.where(real, place + ends[doc[part]], 0)].astype(np.int64), PAD)
        np.add.at(logs, doc[part], net.pooled(x, before, inner))
    p = np.exp(logs / np.maximum(size, 1)[:, None])
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    score = np.where(known, p[np.arange(len(p)), best], 0.0).round(6)
    return [net.langs[b] if k else UND for b, k in zip(best.tolist(), known.tolist(), strict=True)], score.tolist()


def _label(net: Network | None, field: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = batch.column("_row")
        langs, scores = predict(net, pc.struct_field(kept, [field]))
        yield pa.RecordBatch.from_arrays([kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["_row", "lang_pred", "score"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS, **options) -> Network | None:
    """Train on about sample_docs different labelled rows that are not held out, as many of each language, chosen by a hash of id and text."""
    fits = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}") & ~held_out(F.col(doc_id)))
    rows = fits.select(F.xxhash64(F.col(doc_id).cast("string"), text).alias("_order"), F.col(lang).alias("_lang"), F.col(text).alias("_text"))
    # one row for each language; copies count once, so neither one id nor one text can fill or empty a sample
    sizes = rows.groupBy("_lang").agg(F.greatest(F.lit(1), F.approx_count_distinct("_order")).alias("_n")).collect()
    if not sizes:
        return None
    quota = max(QUOTA, sample_docs // len(sizes))
    # a cut that about twice the quota passes, so that no task sorts more rows than the sample needs
    cuts = docs.sparkSession.createDataFrame([(r["_lang"], min(1 << 30, -(-(1 << 31) * quota // r["_n"]))) for r in sizes], "_of string, _cut long")
    some = rows.join(F.broadcast(cuts), F.col("_lang") == F.col("_of")).where(F.pmod("_order", F.lit(1 << 30)) < F.col("_cut"))
    step = F.greatest(F.length("_text") - PIECE, F.lit(0)) + 1
    pieces = F.array(*(F.substring(F.col("_text"), (F.pmod(F.xxhash64("_order", F.lit(k)), step) + 1).cast("int"), F.lit(PIECE)) for k in range(PIECES)))
    once = some.groupBy("_lang", "_order").agg(F.min(pieces).alias("_pieces"))
    chosen = once.withColumn("_nth", F.row_number().over(Window.partitionBy("_lang").orderBy("_order"))).where(F.col("_nth") <= quota)
    sample = sorted(((r["_lang"], r["_order"], r["_pieces"]) for r in chosen.select("_lang", "_order", "_pieces").collect()), key=lambda r: (r[1], r[0], r[2]))
    return train([(piece, name) for name, _, found in sample for piece in found], **options)


def predicted(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score beside their own columns (_row.*)."""
    on_workers(docs.sparkSession)
    rows, field = docs.select(F.struct(*docs.columns).alias("_row")), docs.columns.index(text)
    return rows.mapInArrow(lambda batches: _label(net, field, batches), f"_row {rows.schema['_row'].dataType.simpleString()}, lang_pred string, score double")


def identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    found = predicted(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t")), fit(docs, doc_id, text, lang), "_t")
    return found.select("_row.doc_id", held_out(F.col("_row.doc_id")).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows that have a language, with their own columns; `und` rows go."""
    found = predicted(docs, fit(docs, doc_id, text, lang), text).where(F.col("lang_pred") != UND)
    return found.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))
