"""BPE encoding and decoding with forced-boundary splitting.

A merge only ever makes a vocabulary token, so two neighbouring bytes that stand together
inside no token are never joined: between them is a certain cut. Words are cut at all such
pairs, fragments are encoded on their own (and kept, for they repeat), and their ids are laid
end to end. The tokenizer file is read by the driver and broadcast; its size is that of one
vocabulary, whatever the corpus.

Normalizing and cutting into words is left to the tokenizer file's own rules. White space
separates words under these rules, so a text may first be cut there and each distinct word
be encoded once a task.

Cases: a null text counts as empty and has no ids; strings of added tokens inside a text are
encoded as those tokens, as the library does; rows repeated stay repeated; other columns of
the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, whole_text

KEPT_WORDS = 150_000
#: Words that a Python worker keeps from task to task, none of more characters than this.
WORKER_WORDS, WORKER_CHARS = 500_000, 64
BATCH_BYTES = 8 << 20


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(spark: SparkSession, path: str | None = None):
    """The tokenizer file as a broadcast variable."""
    with open(path or tokenizer_path(), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


# The rules under which ``Words`` may cut plain Latin text by itself.
KNOWN_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
KNOWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Words:
    """Cuts a stretch without white space into the pre-tokenizer's words, in byte-level letters.

    Most stretches are of Latin letters that normalizing only lowers; for those, and for the rules
    known here, a compiled pattern does what the file's rules do. All others go through the file's.
    """

    def __init__(self, tokenizer, spec: dict):
        self.normalizer, self.pre_tokenizer = tokenizer.normalizer, tokenizer.pre_tokenizer
        first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        known = spec.get("normalizer") == KNOWN_NORMALIZER and first.get("pattern") == {"Regex": KNOWN_PATTERN}
        letters = [chr(c) for c in [*range(0x21, 0x7F), *range(0xA1, 0x17F)]]
        alpha = re.escape("".join(c for c in letters if c.isalpha()))
        digits = re.escape("".join(c for c in letters if c.isnumeric()))
        # U+0130 becomes two characters when lowered.
        self.plain = re.compile(r"[!-~\u00a1-\u012f\u0131-\u017e]+" if known else r"(?!)").fullmatch
        self.plain_text = re.compile(r"[\x09-\x0d -~\u00a1-\u012f\u0131-\u017e]*" if known else r"(?!)").fullmatch
        self.cut = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{alpha}]+|[{digits}]|[^{alpha}{digits}\\x09-\\x0d ]+").findall
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: 256 + n for n, b in enumerate(hidden)}

    def __call__(self, text: str) -> list[str]:
        if self.plain(text):
            return [self.byte_level(w) for w in self.cut(text.lower())]
        plain = self.normalizer.normalize_str(text) if self.normalizer else text
        return [w for w, _ in self.pre_tokenizer.pre_tokenize_str(plain) if w]

    def byte_level(self, word: str) -> str:
        return word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)


class Merger:
    """The library's merges over many fragments at once, without its text rules."""

    def __init__(self, model, vocab: dict[str, int], suffix: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.lengths = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, ident in vocab.items():
            self.lengths[ident] = len(token.removesuffix(suffix) if suffix else token)

    def __call__(self, fragments: list[str]) -> list[bytes]:
        """Ids of each fragment; letters are byte-level, so none is white space or unknown."""
        out: list[bytes] = []
        for start in range(0, len(fragments), 2000):
            some = fragments[start : start + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            # Tokens of a fragment are as long together as the fragment.
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(f) for f in some])) + 1
            raw = ids.tobytes()
            out += [raw[4 * a : 4 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        return out


class Encoder:
    """A tokenizer file's BPE over stretches of text without white space between words.

    With ``split``, words are cut at every certain boundary and the fragments encoded apart.
    """

    def __init__(self, text: str, split: bool = True):
        from tokenizers import Tokenizer, models

        spec = json.loads(text)
        whole = Tokenizer.from_str(text)
        self.words = Words(whole, spec)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # Where several start at one place, the longest counts.
        longest = sorted(map(re.escape, self.added), key=len, reverse=True)
        self.added_in = re.compile("|".join(longest) or r"(?!)").finditer
        self.fragments: dict[tuple[str, bool], bytes] = {}
        self.last = Merger(whole.model, model["vocab"], suffix)
        #: Neighbours that some token holds; all other pairs are certain cuts. None: words are not cut.
        self.joined: set[str] | None = None
        if split:
            merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
            # Fragments inside a word have no end-of-word mark.
            self.inner = Merger(models.BPE(vocab=model["vocab"], merges=merges), model["vocab"], suffix)
            self.joined = set()
            for token in model["vocab"]:
                body = token.removesuffix(suffix) if suffix else token
                self.joined.update(map(str.__add__, body, body[1:]))

    def cuts(self, word: str) -> list[tuple[str, bool]]:
        """The fragments of a word, each with whether it ends the word."""
        joined = self.joined
        if joined is None or all(map(joined.__contains__, map(str.__add__, word, word[1:]))):
            return [(word, True)]
        out, start = [], 0
        for i in range(1, len(word)):
            if word[i - 1] + word[i] not in joined:
                out.append((word[start:i], False))
                start = i
        return [*out, (word[start:], True)]

    def planned(self, text: str) -> list:
        """What a stretch is made of: fragments, and ids of added tokens as they stand."""
        plan, at = [], 0
        for found in self.added_in(text):
            plan += self.pieces(text[at : found.start()])
            plan.append(self.added[found.group()])
            at = found.end()
        return plan + self.pieces(text[at:]) if at else self.pieces(text)

    def pieces(self, text: str) -> list[tuple[str, bool]]:
        return [f for w in self.words(text) for f in self.cuts(w)] if text else []

    def coded(self, plans: list[list]) -> list[bytes]:
        """Ids of each plan; fragments not met before are encoded together."""
        if len(self.fragments) >= KEPT_WORDS:
            self.fragments.clear()
        fresh = {f for plan in plans for f in plan if not isinstance(f, int)}.difference(self.fragments)
        for last in (False, True):
            some = [body for body, end in fresh if end is last]
            if some:
                made = (self.last if last else self.inner)(some)
                self.fragments.update(zip([(body, last) for body in some], made))
        known = self.fragments
        return [
            known[plan[0]] if len(plan) == 1 and not isinstance(plan[0], int)
            else b"".join([f.to_bytes(4, "little") if isinstance(f, int) else known[f] for f in plan])
            for plan in plans
        ]

    def many(self, texts: list[str]) -> list[bytes]:
        """Ids of each stretch of text."""
        return self.coded([self.planned(t) for t in texts])

    def lowered(self, words: list[str]) -> list[bytes]:
        """Ids of words that plain text was cut into."""
        if self.joined is None:
            return self.last([self.words.byte_level(w) for w in words])
        return self.coded([self.cuts(self.words.byte_level(w)) for w in words])


class Kept:
    """Ids of words, kept for those seen; when they are many, only for those just met."""

    def __init__(self, encoder: Encoder, limit: int | None = None):
        self.encoder, self.limit = encoder, KEPT_WORDS if limit is None else limit
        self.words: dict[str, bytes] = {}
        self.stretches: dict[str, bytes] = {}

    def _known(self, kept: dict, lists: list[list[str]], encode) -> None:
        met = set().union(*lists)
        fresh = met.difference(kept)
        if kept and len(kept) + len(fresh) > self.limit:
            still = {w: kept[w] for w in met.difference(fresh)}
            kept.clear()
            kept.update(still)
        listed = list(fresh)
        kept.update(zip(listed, encode(listed)))

    def texts(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts: plain ones cut by one pattern, others between ASCII white space."""
        words = self.encoder.words
        plain = [words.plain_text(t) is not None and "<|" not in t for t in texts]
        cut = [
            words.cut(t.lower()) if p else [w.decode("utf-8", "replace") for w in t.encode("utf-8", "replace").split()]
            for t, p in zip(texts, plain)
        ]
        self._known(self.words, [c for c, p in zip(cut, plain) if p], self.encoder.lowered)
        self._known(self.stretches, [c for c, p in zip(cut, plain) if not p], self.encoder.many)
        known, others = self.words.__getitem__, self.stretches.__getitem__
        return [b"".join(map(known if p else others, c)) for c, p in zip(cut, plain)]

    def rest(self) -> None:
        """Between tasks: fragments and long words go, and the number of words kept is within the limit again."""
        self.encoder.fragments.clear()
        for kept in (self.words, self.stretches):
            if len(kept) > self.limit:
                kept.clear()
            for word in [w for w in kept if len(w) > WORKER_CHARS]:
                del kept[word]


#: The tokenizer file that this Python worker encoded with last, and its words.
_worker: list[tuple[str, Kept]] = []


def kept_by_worker(text: str) -> Kept:
    """Ids of whole words that outlive a task: the next one in this worker need not merge them again."""
    if not _worker or _worker[0][0] != text:
        # Whole words go to the library's merges.
        _worker[:] = [(text, Kept(Encoder(text, split=False), WORKER_WORDS))]
    return _worker[0][1]


def in_stretches(it, names: tuple[str, str], limit: int = 4 << 20):
    """(ids, texts) of Arrow batches, a few megabytes of text at a time."""
    for ids, texts in batches(it, *names):
        start, size = 0, 0
        for n, text in enumerate(texts, 1):
            size += len(text)
            if size >= limit or n == len(texts):
                yield ids[start:n], texts[start:n]
                start, size = n, 0


def in_parts(rows, schema: pa.Schema):
    """Rows (tuples) as Arrow batches of about ``BATCH_BYTES``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def encode(docs: DataFrame, tokenizer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32-bit integers, end to end."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(it):
        kept = Kept(Encoder(tokenizer.value))
        rows = (row for ids, texts in in_stretches(it, ("doc_id", "text")) for row in zip(ids, kept.texts(texts)))
        return in_parts(rows, schema)

    held = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return held.mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, tokenizer) -> DataFrame:
    """(doc_id, ids, text): tokens as the file names them, joined by spaces where it has no decoder."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("text", pa.string())])

    def run(it):
        from tokenizers import Tokenizer

        text = tokenizer.value
        if (decoder := Tokenizer.from_str(text).decoder) is not None:
            def joined(tokens):
                return decoder.decode(tokens)
        else:
            joined = " ".join
        spec = json.loads(text)
        named = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        names = [named.get(i) for i in range(max(named) + 1)]
        rows = (
            (doc, ids, joined(list(map(names.__getitem__, np.frombuffer(ids, "<u4").tolist()))))
            for docs, all_ids in batches(it, "doc_id", "ids")
            for doc, ids in zip(docs, all_ids)
        )
        return in_parts(rows, schema)

    return encoded.mapInArrow(run, "doc_id long, ids binary, text string")
