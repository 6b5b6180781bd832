"""Language identification in two steps: the family first, then the language within it.

A text is described by hashed letter n-grams of its whole length. Linear support vector
machines, one against the rest, tell families apart. Within a family there is one machine for
each two of its languages, fitted on the rows of those two only; the language with most votes
wins, among equals the one of greatest summed margins. They are fitted in numpy on a bounded
sample of labelled rows: about ``PER_LANGUAGE`` texts a language, chosen by a digest of the text.

Cases: a text that is null or has no letter is ``und`` with score 1; rows repeated stay
repeated; null labels are not learned from; without any label everything is ``und`` with
score 0; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import in_parts
from .common import batches, mix64

#: Labelled texts to learn from, about so many a language: the bound of the driver's sample.
PER_LANGUAGE = 600
DIMS = 1 << 12
UNKNOWN = "und"

# Languages by family. A language not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk"),
    "indo-aryan": ("hi", "ur", "bn", "mr"),
}


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), lang)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features(text: str) -> np.ndarray | None:
    """Square roots of the shares of letter 1- to 4-grams, hashed; None without a letter.

    Runs of other characters count as one break, so markup and numbers weigh little.
    """
    lowered = text.lower()
    points = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), "<u4")
    letters = _is_letter(points)
    if not letters.any():
        return None
    x = np.where(letters, points, 32)
    keep = letters.copy()
    keep[1:] |= letters[:-1]  # the first break after a letter
    x = np.concatenate([[32], x[keep], [32]]).astype(np.uint64)
    out = np.zeros(DIMS, np.float32)
    grams = x
    for n in range(1, 5):
        if n > 1:
            if len(x) < n:
                break
            grams = grams[:-1] * np.uint64(0x100000001B3) + x[n - 1 :]
        at = (mix64(grams + np.uint64(n)) >> np.uint64(52)).astype(np.int64)
        out += np.bincount(at, minlength=DIMS).astype(np.float32) / len(at)
    return np.sqrt(out / np.float32(4))


_LETTERS = None


def _is_letter(points: np.ndarray) -> np.ndarray:
    """Letters by Unicode's general category, looked up once for the first plane."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.array([chr(c).isalpha() for c in range(0x10000)])
    if not len(points) or points.max() < 0x10000:
        return _LETTERS[points]
    return np.array([chr(c).isalpha() for c in points.tolist()])


def fit_svm(x: np.ndarray, y: np.ndarray, classes: int, passes: int = 12, strength: float = 1e-4, seed: int = 7):
    """(weights, offsets) of one-against-the-rest machines: hinge loss, averaged stochastic steps.

    Classes weigh the same whatever their number of rows.
    """
    rng = np.random.default_rng(seed)
    x1 = np.hstack([x, np.ones((len(x), 1), np.float32)])
    sign = np.where(y[:, None] == np.arange(classes), 1.0, -1.0).astype(np.float32)
    count = np.maximum((sign > 0).sum(0), 1)
    weight = np.where(sign > 0, len(y) / (2 * count), len(y) / (2 * np.maximum(len(y) - count, 1))).astype(np.float32)
    w = np.zeros((x1.shape[1], classes), np.float32)
    total, steps, batch = np.zeros_like(w), 0, 64
    for n in range(passes):
        order = rng.permutation(len(y))
        for start in range(0, len(y), batch):
            rows = order[start : start + batch]
            steps += 1
            rate = 4.0 / (1 + 0.01 * steps)
            active = (sign[rows] * (x1[rows] @ w) < 1) * sign[rows] * weight[rows]
            w = (1 - rate * strength) * w + rate / len(rows) * (x1[rows].T @ active)
            if n >= passes // 2:
                total += w
    mean = total / max(1, (passes - passes // 2) * -(-len(y) // batch))
    return mean[:-1], mean[-1]


def fit_pairs(x: np.ndarray, y: np.ndarray, classes: int, seed: int = 7):
    """(weights, offsets) of one-versus-one machines, a column for each two classes (a, b); positive for b."""
    fitted = []
    for a, b in combinations(range(classes), 2):
        of_two = (y == a) | (y == b)
        weights, offsets = fit_svm(x[of_two], (y[of_two] == b).astype(np.int64), 2, seed=seed)
        fitted.append((weights[:, 1], offsets[1]))
    return np.stack([w for w, _ in fitted], axis=1), np.array([o for _, o in fitted], np.float32)


def decide(margins: np.ndarray, classes: int) -> tuple[int, np.ndarray]:
    """(class of most votes, mean margin of every class) from the margins of the pairs' machines."""
    votes, sums = np.zeros(classes, np.int64), np.zeros(classes, np.float64)
    for (a, b), margin in zip(combinations(range(classes), 2), margins):
        votes[b if margin > 0 else a] += 1
        sums[a] -= margin
        sums[b] += margin
    return max(range(classes), key=lambda c: (votes[c], sums[c])), sums / (classes - 1)


@dataclass
class Model:
    families: list[str]
    top: tuple[np.ndarray, np.ndarray]
    #: For each family its languages, and the machines of each two of them.
    within: list[tuple[list[str], tuple[np.ndarray, np.ndarray] | None]]

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        shares = _shares(x @ self.top[0] + self.top[1])
        best = int(np.argmax(shares))
        languages, machines = self.within[best]
        if machines is None:
            return languages[0], float(shares[best])
        at, means = decide(x @ machines[0] + machines[1], len(languages))
        return languages[at], float(shares[best] * _shares(means)[at])


def _shares(margins: np.ndarray) -> np.ndarray:
    e = np.exp(2.0 * (margins - margins.max()))
    return e / e.sum()


def excerpts(text: str, rng) -> list[str]:
    """A text and two short stretches of it, so that short texts are learned too."""
    out = [text]
    for size in (40, 160):
        if len(text) > 2 * size:
            at = int(rng.integers(0, len(text) - size))
            out.append(text[at : at + size])
    return out


def fit(texts: list[str], langs: list[str], seed: int = 7) -> Model | None:
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for text, lang in zip(texts, langs):
        for part in excerpts(text, rng):
            if (x := features(part)) is not None:
                rows.append(x)
                labels.append(lang)
    if not rows:
        return None
    x, y = np.array(rows), np.array(labels)
    families = sorted({family_of(lang) for lang in labels})
    family = np.array([families.index(family_of(lang)) for lang in labels])
    within = []
    for n, name in enumerate(families):
        own = sorted({lang for lang in labels if family_of(lang) == name})
        at = family == n
        codes = np.searchsorted(own, y[at])
        within.append((own, fit_pairs(x[at], codes, len(own), seed=seed) if len(own) > 1 else None))
    return Model(families, fit_svm(x, family, len(families), seed=seed), within)


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col="doc_id", text_col="text", lang_col="lang") -> DataFrame:
    """(text, lang) to learn from: never held-out rows; in each language the same share by a digest of text and id.

    The share of a language follows from its number of rows, so about ``per_language`` are drawn
    whatever repeats; rows that repeat under one id as well are drawn together.
    """
    known = docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    draw = F.pmod(F.xxhash64(text_col, id_col), F.lit(1_000_000_000))
    known = known.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), draw.alias("_draw"))
    shares = known.groupBy("lang").count().select(
        F.col("lang").alias("_lang"), (F.lit(float(per_language)) / F.col("count")).alias("_share")
    )
    met = known.join(F.broadcast(shares), F.col("lang") == F.col("_lang"))  # one row a language
    return met.filter(F.col("_draw") < F.col("_share") * 1_000_000_000).select("text", "lang")


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, **columns) -> Model | None:
    rows = sorted((r["lang"], r["text"]) for r in sample(docs, per_language, **columns).collect())
    return fit([t for _, t in rows], [lang for lang, _ in rows])


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row; only the text is looked at."""
    # Plain arrays travel, so executors need no copy of these classes.
    plain = None if model is None else (model.families, model.top, model.within)
    shared = docs.sparkSession.sparkContext.broadcast(plain)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def one(fitted: Model | None, text: str | None) -> tuple[str, float]:
        x = None if text is None else features(text)
        if x is None:
            return UNKNOWN, 1.0
        return (UNKNOWN, 0.0) if fitted is None else fitted.predict(x)

    def run(it):
        fitted = None if shared.value is None else Model(*shared.value)
        rows = ((doc, *one(fitted, text)) for ids, texts in batches(it, "doc_id", "text") for doc, text in zip(ids, texts))
        return in_parts(rows, schema)

    held = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return held.mapInArrow(run, "doc_id long, lang_pred string, score double")
