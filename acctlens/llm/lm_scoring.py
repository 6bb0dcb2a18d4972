"""Language-model scores of whole texts: a small causal self-attention model over subword ids, in numpy.

A text is the sequence of the subword ids of its lower-cased words, then one end id. Each id is predicted in
two steps, p(id | before) = p(class | before) p(id | class). The class probabilities come from one layer of
causal self-attention over a window of ids; windows overlap, so that every id is scored once and with some
context. p(id | class) comes from the counts of ids in all training texts, and so do the ids with an input
vector of their own. Classes are clustered by the neighbours of ids in all training texts; the attention weights
begin with a fit on few texts, then every task goes on from there with its part of all training texts, and the
tasks' weights are averaged.

Beside it stands a unigram base over words. Its counts cover all training texts; words more frequent than a
threshold (chosen so that at most MAX_FREQUENT are) are broadcast, the others are joined by their hash. Words
are told apart by 64-bit hashes.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fold, joined, materialize, prefix_hash, slices, span_hash, spans, table

#: Ids of a window, ids that it scores, vector dimensions, classes, and inputs with a vector of their own.
WINDOW, STRIDE, DIM, CLASSES, OWN = 32, 24, 16, 64, 4_000
#: Most words that are broadcast, words in a worker's cache, and bytes of text handled at once.
MAX_FREQUENT, CACHE_WORDS, SLICE = 300_000, 100_000, 1 << 20
#: One training text in so many may be among those that fitting begins with, before it goes on with all, and the most subword ids of these.
FIT_EVERY, BEGIN_IDS = 24, 400_000
#: Neighbours that tell ids apart, ids that a task fits on at once, and windows of its steps.
NEAR, FIT_IDS, FIT_BATCH = 256, 400_000, 512
_CONTEXT = WINDOW - STRIDE
#: A product with it is a faster sum along a short axis.
_ONES = np.ones(max(WINDOW, CLASSES), np.float32)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


class Subwords:
    """Subword ids of words, with a bounded cache by hash."""

    def __init__(self, path: str | None):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("subwords", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        self.end = max(ranks.values()) + 1
        self.size = self.end + 1
        self.bytes = np.zeros(self.size, np.int64)
        self.bytes[list(ranks.values())] = list(map(len, ranks))
        self._clear()

    def _clear(self) -> None:
        self.at: dict[int, int] = {}
        self.first, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all their ids), each word encoded by itself with a space before it.

        ASCII words are encoded in one call, since pieces begin anew at a space; ids' lengths tell the words apart.
        """
        plain = np.fromiter(map(bytes.isascii, words), bool, len(words))
        together = [w for w, x in zip(words, plain) if x]
        got = np.array(self.encode((b" " + b" ".join(together)).decode()) if together else [], np.int32)
        ends, want = np.cumsum(self.bytes[got]), np.cumsum(np.fromiter(map(len, together), np.int64, len(together)) + 1)
        last = np.minimum(np.searchsorted(ends, want), max(0, len(ends) - 1))
        if len(together) and not np.array_equal(ends[last], want):
            plain[:] = False
        if plain.all():
            return np.diff(last, prepend=-1), got
        single = [self.encode(" " + w.decode("utf-8", "replace")) for w, x in zip(words, plain) if not x]
        size = np.zeros(len(words), np.int64)
        size[~plain] = list(map(len, single))
        if plain.any():
            size[plain] = np.diff(last, prepend=-1)
        out, of = np.empty(size.sum(), np.int32), np.repeat(plain, size)
        out[~of] = np.fromiter(chain.from_iterable(single), np.int32)
        if plain.any():
            out[of] = got
        return size, out

    def ids(self, words: np.ndarray, spelled) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, length, flat): word i's ids are flat[first[i] : first[i] + length[i]]. words: distinct hashes; spelled(i): the bytes of those at i."""
        if len(self.at) > CACHE_WORDS:
            self._clear()
        where = np.array([self.at.get(h, -1) for h in words.tolist()], np.int64)
        new = np.flatnonzero(where < 0)
        if len(new):
            size, flat = self.encoded(spelled(new))
            where[new] = len(self.first) - 1 + np.arange(len(new))
            self.at.update(zip(words[new].tolist(), where[new].tolist()))
            self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(size)))
            self.flat = np.concatenate((self.flat, flat))
        return self.first[where], self.first[where + 1] - self.first[where], self.flat


class Words:
    """The lower-cased words of some texts: text's index and hash of each, and the distinct ones."""

    def __init__(self, texts: list[bytes | None]):
        raw, at = joined(texts)
        self.data = _LOWER[raw]
        self.start, self.stop = spans(~_SPACE[self.data])
        self.hash = span_hash(prefix_hash(self.data), self.start, self.stop)
        self.doc = np.searchsorted(at, self.start, "right") - 1
        self.distinct, self.example, self.which, self.n = np.unique(self.hash, return_index=True, return_inverse=True, return_counts=True)

    def spelled(self, i: np.ndarray) -> list[bytes]:
        k, data = self.example[i], self.data.tobytes()
        return [data[a:b] for a, b in zip(self.start[k].tolist(), self.stop[k].tolist())]

    def distinct_bytes(self) -> pa.Array:
        """The distinct words, spelled, as an Arrow array in the order of `distinct`."""
        start, size = self.start[self.example], (self.stop - self.start)[self.example]
        offsets = np.concatenate(([0], np.cumsum(size)))
        at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
        return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(self.data[at].tobytes())])

    def stream(self, subwords: Subwords, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text by text with an end id each, and where each text begins."""
        first, length, flat = subwords.ids(self.distinct, self.spelled)
        n = length[self.which]
        per_doc = np.bincount(self.doc, n, texts).astype(np.int64) + 1
        cut = np.concatenate(([0], np.cumsum(per_doc)))
        out = np.full(cut[-1], subwords.end, np.int32)
        begin = np.concatenate(([0], np.cumsum(n)))[:-1]
        step = np.arange(n.sum()) - np.repeat(begin, n)
        out[np.repeat(begin + self.doc, n) + step] = flat[np.repeat(first[self.which], n) + step]
        return out, cut


def parts(text: bytes | None, most: int) -> list[bytes]:
    """The text in pieces of about `most` bytes, cut at white space; a longer word is not cut."""
    text, out, at = text or b"", [], 0
    while len(text) - at > most:
        end = max(text.rfind(c, at + 1, at + most) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f"))
        if end < 0:
            ends = [e for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f") if (e := text.find(c, at + most)) >= 0]
            end = min(ends) if ends else len(text)
        out.append(text[at:end])
        at = end
    return [*out, text[at:]] if at < len(text) or not out else out


def words_of(batch, most: int):
    """Parts of an Arrow batch (column 1: texts) as (first row, rows, Words) of about `most` bytes each; a longer text comes in several."""
    start = 0
    for b in slices(batch, most):
        k = b.num_rows
        texts = b.column(1).to_pylist()
        for piece in [texts] if k > 1 or len(texts[0] or b"") <= most else [[x] for x in parts(texts[0], most)]:
            yield start, k, Words(piece)
        start += k


def streams(batch, subwords: Subwords, most: int = SLICE):
    """(first row, rows, ids, where each text begins, Words pieces) of the parts of a batch; whole texts, each with its end id."""
    held: list = []
    for start, k, w in chain(words_of(batch, most), [(None, 0, None)]):
        if held and held[0][0] != start:
            first, rows = held[0][:2]
            got = [x.stream(subwords, rows) for _, _, x in held]
            if len(got) == 1:
                yield first, rows, *got[0], [held[0][2]]
            else:
                ids = np.concatenate([g[:-1] for g, _ in got[:-1]] + [got[-1][0]])
                yield first, rows, ids, np.array([0, len(ids)]), [x for _, _, x in held]
            held = []
        if w is not None:
            held.append((start, k, w))


def _windows(cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, first scored position within it) of every window."""
    count = -(-np.diff(cut) // STRIDE)
    doc = np.repeat(np.arange(len(count)), count)
    return doc, (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE


def _bias(distance: np.ndarray, first: bool) -> np.ndarray:
    """Additive mask with the learned bias by distance: rows are the scored positions, columns the window's."""
    i, j = np.arange(_CONTEXT, WINDOW)[:, None], np.arange(WINDOW)[None]
    out = np.where(j <= i, distance[np.clip(i - j, 0, WINDOW - 1)], -1e9)
    return np.where(j < _CONTEXT, -1e9, out).astype(np.float32) if first else out.astype(np.float32)


def _inputs(rows: np.ndarray, cut: np.ndarray, doc: np.ndarray, at: np.ndarray, begin: int) -> np.ndarray:
    """Input row of every position of the windows: that of the id before it, `begin` at a text's start."""
    p = (at - _CONTEXT)[:, None] + np.arange(WINDOW)
    # Only windows at a text's start reach before it, and only a text's last one beyond it.
    out = rows.take(p + (cut[doc] - 1)[:, None], mode="clip")
    early = np.flatnonzero(at <= _CONTEXT)
    out[early] = np.where(p[early] <= 0, begin, out[early])
    return out


def _by_row(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the values (a vector for each entry of rows) by row, of n rows."""
    k = values.shape[-1]
    cell = (rows.ravel() * k)[:, None] + np.arange(k)
    return np.bincount(cell.ravel(), values.ravel(), n * k).reshape(n, k).astype(np.float32)


class Model:
    """Weights of the attention layer and the tables by subword id."""

    def __init__(self, row: np.ndarray, klass: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.row, self.klass = row, klass
        self.begin = int(row.max()) + 1
        draw = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
        self.p = {"E": draw(self.begin + 1, DIM, s=0.3), **{k: draw(DIM, DIM, s=0.25) for k in ("Wq", "Wk", "Wv", "Wr")}, "D": np.zeros(WINDOW, np.float32), "Wc": draw(DIM, CLASSES, s=0.2), "bc": np.zeros(CLASSES, np.float32)}
        self.given = np.zeros(len(row), np.float32)

    def set_counts(self, counts: np.ndarray) -> None:
        """log p(id | class) from the ids' counts in all training texts."""
        c = counts + 0.1
        self.given = np.log(c / np.bincount(self.klass, c, CLASSES)[self.klass]).astype(np.float32)

    def fit(self, stream: np.ndarray, cut: np.ndarray, epochs: int = 2, batch: int = 96, lr: float = 0.01, seed: int = 2, anew: bool = True) -> None:
        """Adam on the cross-entropy of the classes; only windows with a whole context are used, then those at a text's start. anew: the classes' shares are counted first."""
        rows, target = self.row[stream], self.klass[stream]
        doc, at = _windows(cut)
        rng = np.random.default_rng(seed)
        if anew:
            self.p["bc"] = np.log((np.bincount(target, minlength=CLASSES) + 1) / (len(target) + CLASSES)).astype(np.float32)
        m, s, t = {k: np.zeros_like(w) for k, w in self.p.items()}, {k: np.zeros_like(w) for k, w in self.p.items()}, 0
        groups = []
        for _ in range(epochs):
            for first in (False, True):
                own = rng.permutation(np.flatnonzero((at == 0) == first))
                groups += [(first, own[i : i + batch]) for i in range(0, len(own), batch)]
        for first, w in groups:
            x = _inputs(rows, cut, doc[w], at[w], self.begin)
            pos = at[w][:, None] + np.arange(STRIDE)
            live = pos < np.diff(cut)[doc[w]][:, None]
            y = target[np.minimum(cut[doc[w]][:, None] + pos, len(target) - 1)]
            t += 1
            rate = lr * (1 - 0.9 * t / len(groups)) * (1 - 0.98**t) ** 0.5 / (1 - 0.9**t)
            for name, d in self.slopes(x, first, y, live).items():
                m[name] += 0.1 * (d - m[name])
                s[name] += 0.02 * (d * d - s[name])
                self.p[name] = self.p[name] - np.float32(rate) * m[name] / (np.sqrt(s[name]) + np.float32(1e-8))

    def slopes(self, x: np.ndarray, first: bool, y: np.ndarray, live: np.ndarray, most: int = 32) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy of the classes y at the live positions of windows of input rows; `most` windows at once."""
        p, scale, total = self.p, np.float32(DIM**-0.5), np.float32(max(1, live.sum()))
        to_kv, to_qr = np.hstack((p["Wk"], p["Wv"])), np.hstack((p["Wq"] * scale, p["Wr"]))
        kv_of, qr_of = p["E"] @ to_kv, p["E"] @ to_qr
        late, bias = x[:, _CONTEXT:], _bias(p["D"], first)
        g = {"Wc": np.zeros_like(p["Wc"]), "bc": np.zeros_like(p["bc"])}
        g_kv, g_qr = np.zeros_like(to_kv), np.zeros_like(to_qr)
        d_bias = np.zeros((STRIDE, WINDOW), np.float32)
        d_e = np.empty((*x.shape, DIM), np.float32)
        for i in range(0, len(x), most):
            kv, qr = kv_of.take(x[i : i + most], axis=0), qr_of.take(late[i : i + most], axis=0)
            k, v, q, r = kv[..., :DIM], kv[..., DIM:], qr[..., :DIM], qr[..., DIM:]
            a = q @ k.transpose(0, 2, 1)
            np.clip(a, -30, 30, out=a)
            a += bias
            np.exp(a, out=a)
            a /= (a @ _ONES[:WINDOW])[..., None]
            h = np.tanh(a @ v + r)
            flat = h.reshape(-1, DIM)
            dz = flat @ p["Wc"]
            dz += p["bc"]
            np.exp(dz, out=dz)
            weight = live[i : i + most].ravel() / total
            dz *= (weight / (dz @ _ONES[:CLASSES]))[:, None]
            dz[np.arange(len(dz)), y[i : i + most].ravel()] -= weight
            g["Wc"] += flat.T @ dz
            g["bc"] += np.ones(len(dz), np.float32) @ dz
            dh = (dz @ p["Wc"].T).reshape(h.shape)
            dh *= 1 - h * h
            ds = dh @ v.transpose(0, 2, 1)
            ds -= np.einsum("nij,nij->ni", ds, a)[..., None]
            ds *= a
            d_bias += ds.sum(axis=0)
            d_kv = np.concatenate((ds.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ dh), axis=2).reshape(-1, 2 * DIM)
            d_qr = np.concatenate((ds @ k, dh), axis=2).reshape(-1, 2 * DIM)
            e = p["E"].take(x[i : i + most], axis=0)
            g_kv += e.reshape(-1, DIM).T @ d_kv
            g_qr += e[:, _CONTEXT:].reshape(-1, DIM).T @ d_qr
            d_e[i : i + most] = (d_kv @ to_kv.T).reshape(e.shape)
            d_e[i : i + most, _CONTEXT:] += (d_qr @ to_qr.T).reshape(h.shape)
        at, back = np.arange(_CONTEXT, WINDOW)[:, None], np.arange(WINDOW)[None]
        g["D"] = np.bincount(np.clip(at - back, 0, WINDOW - 1).ravel(), (d_bias * (back <= at)).ravel(), WINDOW).astype(np.float32)
        g["Wk"], g["Wv"], g["Wq"], g["Wr"] = g_kv[:, :DIM], g_kv[:, DIM:], g_qr[:, :DIM] * scale, g_qr[:, DIM:]
        g["E"] = _by_row(x, d_e, len(p["E"]))
        return g

    def score(self, stream: np.ndarray, cut: np.ndarray, most: int = 128) -> np.ndarray:
        """log10 probability of each text; every id is scored in one window."""
        rows, klass, given = self.row[stream], self.klass[stream], self.given[stream]
        doc, at = _windows(cut)
        size, p = np.diff(cut), self.p
        total = np.add.reduceat(given.astype(np.float64), cut[:-1]) if len(size) else np.zeros(0)
        kv_of = p["E"] @ np.hstack((p["Wk"], p["Wv"]))
        qr_of = p["E"] @ np.hstack((p["Wq"] / np.float32(DIM**0.5), p["Wr"]))
        for first in (True, False):
            own, bias = np.flatnonzero((at == 0) == first), _bias(p["D"], first)
            for i in range(0, len(own), most):
                w = own[i : i + most]
                x = _inputs(rows, cut, doc[w], at[w], self.begin)
                kv, qr = kv_of.take(x, axis=0), qr_of.take(x[:, _CONTEXT:], axis=0)
                a = qr[..., :DIM] @ kv[..., :DIM].transpose(0, 2, 1)
                np.clip(a, -30, 30, out=a)
                a += bias
                np.exp(a, out=a)
                o = a @ kv[..., DIM:]
                o /= (a @ _ONES[:WINDOW])[..., None]
                o += qr[..., DIM:]
                z = np.tanh(o, out=o).reshape(-1, DIM) @ p["Wc"]
                z += p["bc"]
                pos = at[w][:, None] + np.arange(STRIDE)
                live = pos < size[doc[w]][:, None]
                y = klass[np.minimum(cut[doc[w]][:, None] + pos, len(klass) - 1)]
                chosen = z[np.arange(len(z)), y.ravel()]
                lp = (chosen - np.log(np.exp(z, out=z) @ _ONES[:CLASSES])).reshape(live.shape)
                total += np.bincount(doc[w], np.where(live, lp, 0).sum(axis=1, dtype=np.float64), len(size))
        return total / np.log(10)


def neighbours(stream: np.ndarray, lead: np.ndarray, place: np.ndarray) -> np.ndarray:
    """How often each id with a row in `lead` has each of the NEAR most frequent ids before it, and after it."""
    out = np.zeros((int(lead.max(initial=-1)) + 1) * 2 * NEAR, np.int64)
    for side, (mid, other) in enumerate(((stream[1:], stream[:-1]), (stream[:-1], stream[1:]))):
        ok = (lead[mid] >= 0) & (place[other] < NEAR)
        out += np.bincount(lead[mid[ok]] * 2 * NEAR + side * NEAR + place[other[ok]], minlength=len(out))
    return out


def leads(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row among the ids that are clustered or -1, place by frequency) of every id, from the ids' counts."""
    rank = np.argsort(-n, kind="stable")
    place, lead = np.empty(len(n), np.int64), np.full(len(n), -1)
    place[rank] = np.arange(len(n))
    own = rank[CLASSES // 4 : OWN][n[rank[CLASSES // 4 : OWN]] > 0]
    lead[own] = np.arange(len(own))
    return lead, place


def classes(n: np.ndarray, near: np.ndarray, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(input row, class) of every subword id, from the ids' counts and the counts of their neighbours.

    The most frequent ids have classes of their own; the next are clustered by what stands before and
    after them; the rest form two classes. Ids without an input row of their own share their class's.
    """
    size, single, rest = len(n), CLASSES // 4, 2
    lead, place = leads(n)
    rank, own = np.argsort(place), np.flatnonzero(lead >= 0)
    own = own[np.argsort(lead[own])]
    klass = CLASSES - rest + (np.arange(size) % rest)
    klass[rank[:single]] = np.arange(single)
    if len(own):
        x = np.sqrt(near.reshape(len(own), 2 * NEAR).astype(np.float32))
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)
        k = min(CLASSES - single - rest, len(own))
        rng = np.random.default_rng(seed)
        centre = x[rng.choice(len(own), k, replace=False, p=np.sqrt(n[own]) / np.sqrt(n[own]).sum())]
        for _ in range(10):
            near_to = (x @ centre.T).argmax(axis=1)
            for c in np.unique(near_to):
                centre[c] = (x[near_to == c] * n[own[near_to == c]][:, None]).sum(0)
            centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-6)
        klass[own] = single + near_to
    row = OWN + klass
    row[rank[:OWN]] = np.arange(min(OWN, size))
    return row.astype(np.int32), klass.astype(np.int32)


def count_words(docs: DataFrame) -> DataFrame:
    """(key, word, n): counts of all the documents' words, with their hashes; pre-aggregated by batches and tasks."""

    def counted(batches):
        for batch in batches:
            for _, _, w in words_of(batch, SLICE):
                yield pa.RecordBatch.from_arrays([pa.array(w.distinct.view(np.int64)), w.distinct_bytes(), pa.array(w.n.astype(np.int64))], names=["key", "word", "n"])

    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(counted, "key long, word binary, n long").groupBy("key", "word").agg(F.sum("n").alias("n"))


def count_subwords(words: DataFrame, path: str | None) -> DataFrame:
    """(id, n): counts of subword ids in all the documents whose words were counted; each distinct word is encoded once."""

    def counted(batches):
        subwords = Subwords(path)
        total = np.zeros(subwords.size, np.int64)
        for b in batches:
            size, ids = subwords.encoded(b.column(0).to_pylist())
            np.add.at(total, ids, np.repeat(np.asarray(b.column(1)), size))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    return words.select("word", "n").mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _frequent(words: DataFrame, most: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(threshold, hashes, counts) of the words counted at least `threshold` times; at most `most` of them."""
    octave = F.floor(F.log2("n") * 8).cast("int")
    held, threshold = 0, None
    for r in words.groupBy(octave.alias("o")).count().orderBy(F.desc("o")).collect():
        held += r["count"]
        if held > most:
            break
        threshold = r.o
    if threshold is None:
        return 1 << 62, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    top = words.filter(octave >= threshold).select("key", "n").toArrow()
    keys, n = top.column("key").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(keys)
    return threshold, keys[order], n[order]


def _counted_neighbours(texts: DataFrame, n: np.ndarray, path: str | None) -> np.ndarray:
    """Sums of `neighbours` over all texts; a table of fixed size, added up before it reaches the driver."""
    held = texts.sparkSession.sparkContext.broadcast(leads(n))

    def counted(batches):
        subwords, (lead, place) = Subwords(path), held.value
        total = np.zeros((int(lead.max(initial=-1)) + 1) * 2 * NEAR, np.int64)
        for batch in batches:
            for _, _, ids, _, _ in streams(batch, subwords):
                total += neighbours(ids, lead, place)
        used = np.flatnonzero(total)
        for i in range(0, len(used), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(used[i : i + (1 << 17)]), pa.array(total[used[i : i + (1 << 17)]])], names=["cell", "n"])

    out = np.zeros((int(leads(n)[0].max(initial=-1)) + 1) * 2 * NEAR, np.int64)
    for r in texts.mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.cell] = r.n
    return out


def _averaged(texts: DataFrame, model: Model, path: str | None) -> None:
    """Goes on fitting: every task from the model as it is with its part of the texts; the model gets the means of the tasks' weights, by their numbers of ids."""
    held = texts.sparkSession.sparkContext.broadcast(model)

    def fitted(batches):
        import copy

        own, subwords, seen = copy.deepcopy(held.value), Subwords(path), 0
        ids, cut = [], [0]

        def step():
            nonlocal seen
            stream = np.concatenate(ids)
            own.fit(stream, np.array(cut), epochs=1, batch=FIT_BATCH, lr=0.003, seed=seen, anew=False)
            seen += len(stream)

        for batch in batches:
            for _, _, got, at, _ in streams(batch, subwords, SLICE // 8):
                ids.append(got)
                cut += [cut[-1] + int(x) for x in at[1:]]
                if cut[-1] >= FIT_IDS:
                    step()
                    ids, cut = [], [0]
        if ids:
            step()
        if seen:
            flat = np.concatenate([own.p[k].ravel() for k in sorted(own.p)]).astype(np.float64) * seen
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat), pa.array(np.full(len(flat), seen))], names=["slot", "total", "n"])

    means = texts.mapInArrow(fitted, "slot long, total double, n long").groupBy("slot").agg((F.sum("total") / F.sum("n")).alias("x"))
    flat = np.concatenate([model.p[k].ravel() for k in sorted(model.p)])
    for r in means.toLocalIterator():
        flat[r.slot] = r.x
    at = 0
    for k in sorted(model.p):
        n = model.p[k].size
        model.p[k] = flat[at : at + n].reshape(model.p[k].shape).astype(np.float32)
        at += n


def _begun(sample: DataFrame, model: Model, subwords: Subwords) -> None:
    """Fits the model on the first texts of sample, of BEGIN_IDS subword ids (and a text) at most."""
    stream, cut = [], [0]
    for r in sample.toLocalIterator():
        for piece in parts(bytes(r.text) if r.text is not None else None, SLICE)[:1]:
            s, c = Words([piece]).stream(subwords, 1)
            stream.append(s)
            cut.append(cut[-1] + int(c[-1]))
        if cut[-1] >= BEGIN_IDS:
            break
    if stream:
        model.fit(np.concatenate(stream), np.array(cut))


def lm_scores(docs: DataFrame, path: str | None = None, folds: int = 10, held_out: int = 0, max_frequent: int = MAX_FREQUENT, fit_every: int = FIT_EVERY) -> DataFrame:
    """One row for each input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Counts cover every document outside the held-out fold, and so do the neighbours that tell the classes and
    the fit of the attention weights. Only the texts that the fit begins with are chosen: the first ones of one
    in fit_every, by a hash of doc_id and text. Whole texts are scored; null and empty ones are
    one end token; a long text is handled in pieces of SLICE bytes. Repeated rows count and are scored each; a
    null doc_id has the fold of the empty text. An empty table gives an empty result. Without training rows,
    or with none counted, base and model fall back to their smoothed form over no counts (N = 0). Further
    columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"), (fold("doc_id", folds) == held_out).alias("held_out"))
    training = rows.filter(~F.col("held_out"))
    n_train = training.count()
    words = materialize(count_words(training), "lm-words")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    threshold, keys, often = _frequent(words, max_frequent)

    subwords = Subwords(path)
    by_id = np.zeros(subwords.size)
    for r in count_subwords(words, path).toLocalIterator():
        by_id[r.id] = r.n
    by_id[subwords.end] += n_train
    texts = training.select("doc_id", "text")
    model = Model(*classes(by_id, _counted_neighbours(texts, by_id, path)))
    _begun(texts.filter(F.pmod(F.xxhash64(F.lit("lm"), "doc_id", "text"), F.lit(fit_every)) == 0), model, subwords)
    _averaged(texts, model, path)
    model.set_counts(by_id)
    held = docs.sparkSession.sparkContext.broadcast((model, keys, often))

    def scored(batches):
        model, keys, often = held.value
        subwords, gain = Subwords(path), np.log10(often + 0.1)
        for batch in batches:
            for at, k, stream, cut, pieces in streams(batch, subwords):
                n_words, n_common, common_sum, rare, whose = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k), [], []
                for w in pieces:
                    place = np.minimum(np.searchsorted(keys, w.distinct), max(0, len(keys) - 1))
                    common = keys[place] == w.distinct if len(keys) else np.zeros(len(w.distinct), bool)
                    value = np.where(common, gain[place], 0) if len(keys) else np.zeros(len(w.distinct))
                    is_common = common[w.which]
                    n_words += np.bincount(w.doc, minlength=k)
                    n_common += np.bincount(w.doc, is_common, k).astype(np.int64)
                    common_sum += np.bincount(w.doc, value[w.which], k)
                    rare.append(w.hash[~is_common])
                    whose.append(w.doc[~is_common])
                first = np.searchsorted(np.concatenate(whose), np.arange(k + 1)).astype(np.int32)
                b = batch.slice(at, k)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0), b.column(2), b.column(3), pa.array(n_words), pa.array(n_common), pa.array(common_sum),
                        pa.array(model.score(stream, cut)), pa.ListArray.from_arrays(pa.array(first), pa.array(np.concatenate(rare).view(np.int64))),
                    ],
                    names=["doc_id", "held_out", "rid", "n_words", "n_common", "common_sum", "score", "rare"],
                )

    shape = "doc_id long, held_out boolean, rid long, n_words long, n_common long, common_sum double, score double, rare array<long>"
    first_pass = materialize(rows.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(scored, shape), "lm-scored")
    rare = first_pass.select("rid", F.explode("rare").alias("key"))
    known = rare.join(words.select("key", "n"), "key").groupBy("rid").agg(F.count("*").alias("n_rare"), F.sum(F.log10(F.col("n") + 0.1)).alias("rare_sum"))
    all_tokens, vocabulary = int(total) + n_train, int(distinct) + (n_train > 0)
    share = float(np.log10(all_tokens + 0.1 * (vocabulary + 1)))
    out = first_pass.drop("rare").join(known, "rid", "left").fillna({"n_rare": 0, "rare_sum": 0.0})
    n_known = F.col("n_common") + F.col("n_rare")
    summed = F.col("common_sum") + F.col("rare_sum") - (F.col("n_words") - n_known) + F.lit(float(np.log10(n_train + 0.1)))
    return out.select(
        "doc_id", "held_out", (F.col("n_words") + 1).alias("n_tokens"), (n_known + int(n_train > 0)).cast("long").alias("n_known"), F.lit(all_tokens).cast("long").alias("train_tokens"),
        (summed - (F.col("n_words") + 1) * share).alias("base_score"), "score",
    )


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
