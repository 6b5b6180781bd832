"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as an embedding of itself and of its character n-grams, with the log-odds of
both among labelled texts. The network reads windows of ``WIDTH`` words forwards and backwards,
pools its states by attention and gives each window a probability; windows overlap by half and
cover the whole text. A text's score is that of its worst window.

It is trained on a bounded sample: at most about ``PER_LABEL`` labelled texts of each label,
chosen by a digest. Log-odds of a training text leave that text out. Which window of a text is
learned from is first decided by log-odds and then, round by round, by the network itself.

Cases: null, empty and wordless texts score 0; labels that are null, missing or repeated for
a row are not an input of any score; rows repeated stay repeated; without labels of both kinds
all texts score 0; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .bpe import in_parts
from .common import mix64, rolling

#: Labelled texts of a label to learn from, about so many: the bound of the driver's sample.
PER_LABEL = 1500
WIDTH, STEP = 32, 16
HIDDEN, PART, ATTEND = 12, 8, 12
WORD_SLOTS, GRAM_SLOTS = 1 << 17, 1 << 16
EMBEDDED = 1 << 12
THRESHOLD = 0.3
STRETCH = 4096 * STEP
KEPT_WORDS = 200_000
WORDS_AT_ONCE = 1 << 15
_INPUTS = 2 + 2 * PART
_WORDS = re.compile(r"\w+")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def slots_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word its slot; the slots of all its 3- to 5-grams, end to end; where each word's begin.

    Ends of a word are marked, so a word of one letter has a 3-gram too.
    """
    marked = [f"<{w}>" for w in words]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.array([len(m) for m in marked], np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)
    owners, slots = [], []
    for n in (3, 4, 5):
        h = rolling(points, n, n)
        inside = owner[: len(h)] == owner[n - 1 : n - 1 + len(h)]
        owners.append(owner[: len(h)][inside])
        slots.append((h[inside] % np.uint64(GRAM_SLOTS)).astype(np.int64))
    owners, slots = np.concatenate(owners), np.concatenate(slots)
    order = np.argsort(owners, kind="stable")
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(len(points)) - first[owner]
    sums = np.add.reduceat(mix64(points * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64)), first)
    word = (mix64(sums) % np.uint64(WORD_SLOTS)).astype(np.int64)
    return word, slots[order], np.searchsorted(owners[order], np.arange(len(words)))


def starts(n: int) -> range:
    """Where windows of a text of ``n`` words start."""
    return range(0, max(1, n - STEP), STEP)


class Odds:
    """Document counts of words and n-grams by label, and their shrunk log-odds."""

    def __init__(self, words: np.ndarray, grams: np.ndarray, prior: float):
        self.words, self.grams, self.prior = words, grams, prior

    def log(self, counts: np.ndarray, own: int | None = None) -> np.ndarray:
        """Of rows (label 0, label 1); ``own`` is the label of a text that is left out."""
        counts = counts.astype(np.float64)
        if own is not None:
            counts[:, own] = np.maximum(counts[:, own] - 1, 0)
        p, strength = self.prior, 2.0
        return np.log((counts[:, 1] + strength * p) / (counts[:, 0] + strength * (1 - p)) / (p / (1 - p)))


def _sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _flat(x: np.ndarray) -> np.ndarray:
    return x.reshape(-1, x.shape[-1])


def _summed(at: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
    """Sums of ``rows`` by the numbers ``at``."""
    order = np.argsort(at, kind="stable")
    ordered = at[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    out = np.zeros((count, rows.shape[1]), rows.dtype)
    out[ordered[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


class Network:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        h, k = HIDDEN, _INPUTS

        def some(*shape, scale=None):
            return rng.normal(0, scale or shape[0] ** -0.5, shape).astype(np.float32)

        self.p = {
            "word": some(EMBEDDED, PART, scale=0.1), "gram": some(EMBEDDED, PART, scale=0.1),
            "x": some(k, 6 * h), "bx": np.zeros(6 * h, np.float32),
            "uf": some(h, 3 * h), "ub": some(h, 3 * h), "bf": np.zeros(3 * h, np.float32), "bb": np.zeros(3 * h, np.float32),
            "wa": some(2 * h, ATTEND), "ba": np.zeros(ATTEND, np.float32), "va": some(ATTEND),
            "wo": some(2 * h), "bo": np.zeros(1, np.float32),
        }
        self.moments = {n: (np.zeros_like(v), np.zeros_like(v)) for n, v in self.p.items()}
        self.steps = 0

    def _run(self, a, u, b, mask, order, keep=None):
        """One direction over time-major inputs ``a``; states in the order of time."""
        h = np.zeros((a.shape[1], HIDDEN), np.float32)
        out = np.empty((len(a), *h.shape), np.float32)
        for t in order:
            v = h @ u
            v += b
            gates = _sigmoid(a[t, :, : 2 * HIDDEN] + v[:, : 2 * HIDDEN])
            r, z = gates[:, :HIDDEN], gates[:, HIDDEN:]
            n = np.tanh(a[t, :, 2 * HIDDEN :] + r * v[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            if mask is not None:
                new = np.where(mask[t][:, None], new, h)
            if keep is not None:
                keep.append((t, h, r, z, n, v[:, 2 * HIDDEN :]))
            out[t] = h = new
        return out

    def pool(self, states, mask):
        p = self.p
        k = np.tanh(states @ p["wa"] + p["ba"])
        e = k @ p["va"]
        if mask is not None:
            e = np.where(mask, e, -1e9)
        e = np.exp(e - e.max(0))
        share = e / e.sum(0)
        context = np.einsum("tb,tbh->bh", share, states)
        return k, share, context, context @ p["wo"] + p["bo"][0]

    def logits(self, a, mask=None):
        """Of windows whose projected inputs are ``a`` (time, window, 6 * HIDDEN)."""
        p, h3 = self.p, 3 * HIDDEN
        forth = self._run(a[:, :, :h3], p["uf"], p["bf"], mask, range(len(a)))
        back = self._run(a[:, :, h3:], p["ub"], p["bb"], mask, range(len(a) - 1, -1, -1))
        return self.pool(np.concatenate([forth, back], 2), mask)[3]

    def _back(self, keep, d_states, u, mask):
        d_u, d_b = np.zeros_like(u), np.zeros(3 * HIDDEN, np.float32)
        d_a = np.empty((len(d_states), d_states.shape[1], 3 * HIDDEN), np.float32)
        d_h = np.zeros(d_states.shape[1:], np.float32)
        for t, h, r, z, n, vn in reversed(keep):
            d_h = d_h + d_states[t]
            m = mask[t][:, None]
            d_new, d_prev = np.where(m, d_h, 0), np.where(m, 0, d_h)
            d_n = d_new * (1 - z) * (1 - n * n)
            d_z = d_new * (h - n) * z * (1 - z)
            d_r = d_n * vn * r * (1 - r)
            d_a[t] = np.concatenate([d_r, d_z, d_n], 1)
            d_v = np.concatenate([d_r, d_z, d_n * r], 1)
            d_u += h.T @ d_v
            d_b += d_v.sum(0)
            d_h = d_prev + d_new * z + d_v @ u.T
        return d_a, d_u, d_b

    def learn(self, odds, word_at, gram_at, gram_word, mask, labels, weights, rate) -> float:
        """One step on a batch of windows; returns its loss.

        ``odds`` (time, window, 2); ``word_at`` numbers the batch's distinct words, whose n-grams
        are the flat ``gram_at`` owned by ``gram_word``; ``mask`` tells words from padding.
        """
        p, h3 = self.p, 3 * HIDDEN
        slots, at = word_at
        count = np.maximum(np.bincount(gram_word, minlength=len(slots)), 1)[:, None].astype(np.float32)
        mean = np.add.reduceat(p["gram"][gram_at], np.searchsorted(gram_word, np.arange(len(slots))), axis=0)
        own = np.concatenate([p["word"][slots], mean / count], 1)
        x = np.concatenate([odds, own[at]], 2) * mask[:, :, None]
        a = x @ p["x"] + p["bx"]
        kept_f: list = []
        kept_b: list = []
        forth = self._run(a[:, :, :h3], p["uf"], p["bf"], mask, range(len(a)), kept_f)
        back = self._run(a[:, :, h3:], p["ub"], p["bb"], mask, range(len(a) - 1, -1, -1), kept_b)
        states = np.concatenate([forth, back], 2)
        k, share, context, logit = self.pool(states, mask)
        chance = _sigmoid(logit)
        d_logit = ((chance - labels) * weights / len(labels)).astype(np.float32)
        g = {"wo": context.T @ d_logit, "bo": np.array([d_logit.sum()])}
        d_context = d_logit[:, None] * p["wo"]
        d_share = np.einsum("bh,tbh->tb", d_context, states)
        d_e = share * (d_share - (share * d_share).sum(0))
        d_k = d_e[:, :, None] * p["va"] * (1 - k * k)
        g["va"] = d_e.ravel() @ _flat(k)
        g["wa"] = _flat(states).T @ _flat(d_k)
        g["ba"] = d_k.sum((0, 1))
        d_states = share[:, :, None] * d_context + d_k @ p["wa"].T
        d_f, g["uf"], g["bf"] = self._back(kept_f, d_states[:, :, :HIDDEN], p["uf"], mask)
        d_b, g["ub"], g["bb"] = self._back(kept_b, d_states[:, :, HIDDEN:], p["ub"], mask)
        d_a = np.concatenate([d_f, d_b], 2)
        g["x"] = _flat(x).T @ _flat(d_a)
        g["bx"] = d_a.sum((0, 1))
        d_own = _summed(at.ravel(), _flat((d_a @ p["x"][2:].T) * mask[:, :, None]), len(own))
        g["word"] = _summed(slots, d_own[:, :PART], EMBEDDED)
        g["gram"] = _summed(gram_at, (d_own[:, PART:] / count)[gram_word], EMBEDDED)
        self.steps += 1
        for name, grad in g.items():
            grad = np.clip(grad, -1, 1) + 1e-5 * p[name]
            m, v = self.moments[name]
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            fixed = np.sqrt(v / (1 - 0.999**self.steps)) + 1e-7
            p[name] -= (rate / (1 - 0.9**self.steps) * m / fixed).astype(np.float32)
        safe = np.clip(chance, 1e-6, 1 - 1e-6)
        return float(-(weights * (labels * np.log(safe) + (1 - labels) * np.log(1 - safe))).mean())


class Scorer:
    """Scores whole texts; what a word sends into the network is kept for the words seen."""

    def __init__(self, odds: Odds, network: Network):
        self.network = network
        self.word_odds, self.gram_odds = odds.log(odds.words), odds.log(odds.grams)
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, 6 * HIDDEN), np.float32)
        self.reset()

    def reset(self) -> None:
        self.rows.clear()
        self.table[0] = self.network.p["bx"]  # padding

    def meet(self, words) -> None:
        """Work out the rows of those words that have none yet."""
        fresh = [w for w in set(words) if w not in self.rows]
        for start in range(0, len(fresh), 8192):
            some = fresh[start : start + 8192]
            p, (slot, gram, first) = self.network.p, slots_of(some)
            count = np.diff(np.concatenate([first, [len(gram)]]))[:, None]
            mean = np.add.reduceat(p["gram"][gram % EMBEDDED], first, axis=0) / count
            worst = np.maximum.reduceat(self.gram_odds[gram], first)
            x = np.concatenate([self.word_odds[slot, None], worst[:, None], p["word"][slot % EMBEDDED], mean], 1)
            at = len(self.rows) + 1
            while at + len(some) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[at : at + len(some)] = x.astype(np.float32) @ p["x"] + p["bx"]
            self.rows.update(zip(some, range(at, at + len(some))))

    def windows(self, words: list[str]) -> np.ndarray:
        """Numbers of the words of each window, 0 for padding."""
        known = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        places = starts(len(words))
        padded = np.zeros(places[-1] + WIDTH, np.int64)
        padded[: len(known)] = known[: len(padded)]
        return np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[::STEP]

    def chances(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty(len(windows))
        full = (windows != 0).all(1)
        for part, masked in ((np.flatnonzero(full), False), (np.flatnonzero(~full), True)):
            for start in range(0, len(part), 512):
                at = part[start : start + 512]
                w = np.ascontiguousarray(windows[at].T)
                out[at] = _sigmoid(self.network.logits(self.table[w], w != 0 if masked else None))
        return out

    def scores(self, texts: list[str | None]) -> list[float]:
        out = [0.0] * len(texts)
        held: list[tuple[int, list[str]]] = []
        size = 0

        def settle():
            if held:
                if len(self.rows) > KEPT_WORDS:
                    self.reset()
                self.meet([w for _, words in held for w in words])
                windows = [self.windows(words) for _, words in held]
                first = np.cumsum([0, *(len(w) for w in windows[:-1])])
                worst = np.maximum.reduceat(self.chances(np.concatenate(windows)), first)
                for (doc, _), chance in zip(held, worst.tolist()):
                    out[doc] = max(out[doc], chance)
            held.clear()

        for n, text in enumerate(texts):
            words = words_of(text)
            # A very long text is read in stretches that share the windows across their seams.
            for at in range(0, max(len(words) - STEP, 1), STRETCH) if words else ():
                held.append((n, words[at : at + STRETCH + STEP]))
                size += len(held[-1][1])
                if size >= STRETCH:
                    settle()
                    size = 0
        settle()
        return out


def _listed(flat: np.ndarray, first: np.ndarray, lengths: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The n-gram slots of the chosen words, end to end."""
    count = lengths[chosen]
    shift = np.repeat(first[chosen] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    return flat[np.arange(count.sum()) + shift]


def _slots_in_parts(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``slots_of`` many words, some at a time, since its arrays are many times as large as what it returns."""
    parts = [slots_of(words[at : at + WORDS_AT_ONCE]) for at in range(0, len(words), WORDS_AT_ONCE)]
    before = np.cumsum([0, *(len(flat) for _, flat, _ in parts)])
    first = np.concatenate([f + b for (_, _, f), b in zip(parts, before)])
    return np.concatenate([w for w, _, _ in parts]), np.concatenate([f.astype(np.int32) for _, f, _ in parts]), first


def train(texts: Sequence[str], labels: Sequence[int], rounds: int = 3, passes: int = 3, seed: int = 3):
    """(odds, network) fitted on labelled texts; a list of texts is emptied. None unless both labels occur."""
    numbers: dict[str, int] = {}
    docs, y = [], []
    if not isinstance(texts, list):  # another sequence stays as it is
        texts = list(texts)
    # Texts and words go as soon as they are numbers: the driver holds the sample once.
    texts.reverse()
    for label in labels:
        words = words_of(texts.pop())
        if words:
            docs.append(np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64))
            y.append(int(label))
    y = np.array(y, np.int64)
    if len(set(y.tolist())) < 2:
        return None
    slots, flat, first = _slots_in_parts(list(numbers))
    del numbers
    lengths = np.diff(np.concatenate([first, [len(flat)]]))
    word_counts, gram_counts = np.zeros((WORD_SLOTS, 2), np.int32), np.zeros((GRAM_SLOTS, 2), np.int32)
    for doc, label in zip(docs, y):
        own = np.unique(doc)
        word_counts[np.unique(slots[own]), label] += 1
        gram_counts[np.unique(_listed(flat, first, lengths, own)), label] += 1
    odds = Odds(word_counts, gram_counts, float(np.clip(y.mean(), 0.02, 0.5)))
    # Log-odds of every word as a text of label 0 or 1 sees them, itself left out.
    seen = []
    for label in (0, 1):
        worst_gram = np.maximum.reduceat(odds.log(gram_counts, label)[flat], first)
        seen.append(np.stack([odds.log(word_counts, label)[slots], worst_gram], 1).astype(np.float32))
    network, rng = Network(seed), np.random.default_rng(seed)

    def evidence(doc, label):
        x = seen[label][doc].max(1)
        return np.array([np.sort(x[s : s + WIDTH])[-3:].sum() for s in starts(len(doc))])

    worst = [int(np.argmax(evidence(d, label))) * STEP for d, label in zip(docs, y)]
    for turn in range(rounds):
        chosen = []
        for n, (doc, label) in enumerate(zip(docs, y)):
            chosen.append((n, worst[n]))
            if not label:
                places = starts(len(doc))
                chosen.append((n, places[int(rng.integers(len(places)))]))
        balance = {1: 1.0, 0: 1.0 if turn < rounds - 1 else 1.2}
        for step in range(passes):
            order = rng.permutation(len(chosen))
            for start in range(0, len(order), 128):
                picked = [chosen[i] for i in order[start : start + 128]]
                numbers = np.zeros((WIDTH, len(picked)), np.int64)
                mask = np.zeros((WIDTH, len(picked)), bool)
                own = np.zeros((WIDTH, len(picked), 2), np.float32)
                for b, (n, at) in enumerate(picked):
                    words = docs[n][at : at + WIDTH]
                    numbers[: len(words), b] = words
                    mask[: len(words), b] = True
                    own[: len(words), b] = seen[y[n]][words]
                distinct, at = np.unique(numbers, return_inverse=True)
                listed = _listed(flat, first, lengths, distinct) % EMBEDDED
                target = np.array([y[n] for n, _ in picked], np.float32)
                network.learn(
                    own, (slots[distinct] % EMBEDDED, at.reshape(numbers.shape)), listed,
                    np.repeat(np.arange(len(distinct)), lengths[distinct]), mask, target,
                    np.array([balance[int(t)] for t in target], np.float32),
                    0.01 if turn + step < 2 else 0.004,
                )
        if turn + 1 < rounds:
            worst = _reselect(network, docs, y, seen, slots, flat, first, lengths)
    return odds, network


def _reselect(network, docs, y, seen, slots, flat, first, lengths):
    """The window of each text that the network now finds worst."""
    p = network.p
    sums = []
    for at in range(0, len(first), WORDS_AT_ONCE):
        own = first[at : at + WORDS_AT_ONCE]
        end = first[at + WORDS_AT_ONCE] if at + WORDS_AT_ONCE < len(first) else len(flat)
        sums.append(np.add.reduceat(p["gram"][flat[own[0] : end] % EMBEDDED], own - own[0], axis=0))
    base = np.concatenate([p["word"][slots % EMBEDDED], np.concatenate(sums) / lengths[:, None]], 1)
    worst = np.zeros(len(docs), np.int64)
    table, of = None, None
    # One label after the other, so that one table of all words stands at a time.
    for n in np.argsort(y, kind="stable").tolist():
        doc, label = docs[n], int(y[n])
        if label != of:
            table, of = None, label
            table = np.concatenate([seen[label], base], 1).astype(np.float32) @ p["x"] + p["bx"]
        places = starts(len(doc))
        padded = np.full(places[-1] + WIDTH, -1, np.int64)
        padded[: len(doc)] = doc[: len(padded)]
        w = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[::STEP].T)
        mask = w >= 0
        a = np.where(mask[:, :, None], table[np.maximum(w, 0)], p["bx"])
        worst[n] = int(np.argmax(network.logits(a, mask))) * STEP
    return worst.tolist()


def sample(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, id_col="doc_id", text_col="text") -> DataFrame:
    """(text, toxic) to learn from: labelled rows that are not held out, each label's share by a digest of the text."""
    known = labels.filter(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(~held_out()).select(F.col("doc_id").alias("_id"), "toxic")
    shares = known.groupBy("toxic").count().select(
        F.col("toxic").alias("_toxic"), (F.lit(float(per_label)) / F.col("count")).alias("_share")
    )
    known = known.join(F.broadcast(shares), F.col("toxic") == F.col("_toxic"))  # two rows
    known = known.filter(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < F.col("_share") * 1_000_000)
    # About 2 * per_label ids are left, so they may go to where the texts are.
    held = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text"))
    return held.join(F.broadcast(known.select("_id", "toxic")), F.col("_doc") == F.col("_id")).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, **columns):
    """(odds, network), or None if the sample lacks a label."""
    rows = sorted((r["toxic"], r["text"] or "") for r in sample(docs, labels, per_label, **columns).collect())
    known = [label for label, _ in rows]
    texts = [t for _, t in rows]
    del rows
    return train(texts, known)


def score(docs: DataFrame, model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The rows of ``docs`` with a column ``score_col``, in place of one of that name; only the text is looked at."""
    # Plain arrays travel, so executors need no copy of these classes.
    plain = None if model is None else (model[0].words, model[0].grams, model[0].prior, model[1].p)
    shared = docs.sparkSession.sparkContext.broadcast(plain)
    read_as = "_toxicity_text"

    def run(it):
        scorer = None
        if shared.value is not None:
            network = Network()
            *counts, network.p = shared.value
            scorer = Scorer(Odds(*counts), network)
        for batch in it:
            texts = batch.column(batch.schema.get_field_index(read_as))
            scores: list[float] = []
            for start in range(0, len(texts), 500):
                part = texts[start : start + 500].to_pylist()
                scores += scorer.scores(part) if scorer else [0.0] * len(part)
            rest = [n for n in batch.schema.names if n != read_as]
            arrays = [batch.column(batch.schema.get_field_index(n)) for n in rest] + [pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*rest, score_col])

    held = docs.select(*(c for c in docs.columns if c != score_col), F.col(text_col).alias(read_as))
    fields = [f for f in held.schema.fields if f.name != read_as]
    return held.mapInArrow(run, StructType([*fields, StructField(score_col, DoubleType())]))
