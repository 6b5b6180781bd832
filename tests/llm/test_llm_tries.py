"""Pieces with spans, the trie of conversations and the filter audit against plain Python."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from llm_fixtures import make_docs  # noqa: F401

from shelfmark.llm import audit, pieces, prefix_trie
from shelfmark.llm import queries as q
from shelfmark.llm.bpe import tokenizer_path

SF = "/root/testdata/sf0.001"
ODD = [
    "", "hello world", " x", "  a  b ", "été \U0001f600 café", "a▁b ▁▁ c", "\n\t x\x00y", "<0x41> <s> </s> <unk>",
    "日本語 テキスト", "à ﬁ", "▁", " ", "   ", "中" * 50, "x" * 1000 + " 　 y", "\u0000", "é ½ ™",
]


@pytest.fixture(scope="module")
def blob():
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


# Pieces.


@pytest.mark.parametrize("stretch", [pieces.STRETCH, 3])
def test_pieces_and_spans_equal_the_library(blob, monkeypatch, stretch):
    monkeypatch.setattr(pieces, "STRETCH", stretch)
    library = sentencepiece.SentencePieceProcessor(model_proto=blob)
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choices("ab ▁é\n中<0x", k=rng.randint(1, 60))) for _ in range(300)]
    for text, (ids, begins, ends) in zip(texts, pieces.Model(blob).encode(texts)):
        assert ids.tolist() == library.encode(text, add_eos=True), text
        want = [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        assert list(zip(begins.tolist(), ends.tolist()))[:-1] == want, text
        assert begins[-1] == ends[-1] == len(text.encode())


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
def test_normalizing_by_a_compiled_map_equals_the_library(rule):
    for flags in itertools.product([True, False], repeat=3):
        names = ("add_dummy_prefix", "escape_whitespaces", "remove_extra_whitespaces")
        library = sentencepiece.SentencePieceNormalizer(rule_name=rule, **dict(zip(names, flags)))
        spec = b"".join(v for n, v in pieces.fields(library.serialized_model_proto()) if n == pieces.NORMALIZER)
        mine = pieces.Normalizer(spec)
        # The settings given to the constructor are not all in the serialized form.
        mine.dummy, mine.fewer, mine.blank = flags[0], flags[2], "▁".encode() if flags[1] else b" "
        rng = random.Random(7)
        texts = ODD + ["".join(rng.choices("aA éｱﾞ½①Å　​\n①ﷺ", k=rng.randint(1, 20))) for _ in range(100)]
        for text in texts:
            normal, places = mine(text)
            assert normal.decode() == library.normalize(text), (rule, flags, text)
            assert len(places) == len(normal) + 1 and (np.diff(places) >= 0).all()


def test_places_of_replaced_characters():
    spec = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    mine = pieces.Normalizer(b"".join(v for n, v in pieces.fields(spec) if n == pieces.NORMALIZER))
    mine.dummy, mine.blank = True, "▁".encode()
    normal, places = mine("  ½ ①  ")
    assert normal.decode() == "▁1⁄2▁1"
    # The mark and all of the fraction come from byte 2; trailing blanks end the source early.
    assert places.tolist() == [2] * 3 + [2] * 5 + [4] * 3 + [5, 8]


def test_pieces_of_odd_documents(spark, make_docs, blob):
    model, library = pieces.load(spark), sentencepiece.SentencePieceProcessor(model_proto=blob)
    rows = [(None, "no id"), (1, None), (2, ""), (3, "two rows"), (3, "two rows"), *((10 + n, t) for n, t in enumerate(ODD))]
    rows.append((99, "a long text, " * 200_000))
    coded = pieces.decode(pieces.encode(make_docs(*rows, extra=True), model), model).collect()
    found = collections.Counter((r["doc_id"], tuple(r["ids"]), r["text"]) for r in coded)
    want = collections.Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_eos=True)
        want[i, tuple(ids), library.decode(ids)] += 1
    assert found == want
    assert pieces.decode(pieces.encode(make_docs(), model), model).count() == 0


def test_query_of_pieces(spark, blob):
    library = sentencepiece.SentencePieceProcessor(model_proto=blob)
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = q.op11_piece_spans(spark, SF).collect()
    assert len(found) == len(docs)
    for r in found:
        ids = library.encode(docs[r["doc_id"]], add_eos=True)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(" ".join(map(str, ids))))
        assert r["decoded_sha256"] == sha(library.decode(ids))
        assert r["n_bytes_covered"] == len(docs[r["doc_id"]].encode())


def test_models_that_are_refused(blob):
    kept_whole = bytes([1 << 3 | 2, 5, 1 << 3 | 2, 1, 120, 3 << 3, 4])
    with pytest.raises(ValueError):
        pieces.Model(blob + kept_whole)


# Conversations.

TALK = StructType(
    [StructField("conv_id", LongType()), StructField("turn", LongType()), StructField("role", StringType()), StructField("text", StringType())]
)


def brute_trie(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    turns = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    members, ends = collections.defaultdict(set), collections.defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        full = turns.get(c - c % 5, [])[:h] + turns[c][h:]
        for d in range(len(full) + 1):
            members[tuple(full[:d])].add(c)
        ends[tuple(full)].append(c)
    below = collections.defaultdict(list)
    for node in members:
        for d in range(len(node) + 1):
            below[node[:d]].append(node)
    children = collections.Counter(n[:-1] for n in members if n)
    weight = lambda n: (len(members[n]) - 1) * len(n[-1][1].encode()) if n else 0
    return sorted(
        (
            min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), children[n],
            sum(not children[x] for x in below[n]), sum(map(weight, below[n])),
            hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest(),
        )
        for n, m in members.items()
    )


NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def found_trie(df):
    assert df.columns == list(NAMES)
    return sorted(tuple(-1 if r[n] is None else r[n] for n in NAMES) for r in df.collect())


@pytest.fixture(scope="module")
def talk():
    """A common first turn, copies, odd rows and ids without their group's first conversation."""
    rng = random.Random(2)
    rows = []
    for c in [*range(0, 150), *range(1001, 1200, 7)]:
        for t in range(rng.randint(1, 14)):
            text = "hello" if t == 0 and c % 3 else rng.choice(["yes", "no", "é" * 5, None, ""])
            rows.append((c, t, rng.choice(["user", None, ""]), text))
    rows += [(2000 + c, t, "user", f"same {t}") for c in range(60) for t in range(6)]
    return rows + [(3000, None, "user", "first"), (3000, 0, "user", "second"), (None, 1, "user", "lost"), (3005, 1, "a", "b")]


@pytest.mark.parametrize("shard", [100_000, 150, 20])
def test_trie_equals_brute_force_however_it_is_cut(spark, talk, shard):
    df = spark.createDataFrame(talk, TALK).withColumn("depth", F.lit("x")).withColumn("n", F.lit("y")).repartition(7)
    assert found_trie(prefix_trie.nodes(df, shard)) == brute_trie(talk)


def test_trie_with_chunks_and_tied_turns(spark, monkeypatch):
    rows = [(c, t % 2, None, f"tie {t}") for c in (10, 11, 12) for t in range(4)] * 2 + [(40 + c, 0, "u", "x") for c in range(50)]
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    assert found_trie(prefix_trie.nodes(spark.createDataFrame(rows, TALK))) == brute_trie(rows)


def test_long_conversation_and_empty_table(spark):
    rows = [(5, t, "user", f"turn {t}") for t in range(600)] + [(6, 0, "user", "short")]
    assert found_trie(prefix_trie.nodes(spark.createDataFrame(rows, TALK), 400)) == brute_trie(rows)
    assert prefix_trie.nodes(spark.createDataFrame([], TALK)).count() == 0


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(3)
    hi, lo = rng.integers(-(2**62), 2**62, (2, 5000))
    slots = prefix_trie.Slots(hi, lo)
    assert sorted(slots.of(hi, lo).tolist()) == list(range(5000))
    assert (slots.of(hi, lo + 1) == -1).all()
    with pytest.raises(ValueError):
        prefix_trie.Slots(np.zeros(2, np.int64), np.zeros(2, np.int64))


# Filters.


def brute_audit(docs, labels):
    good, toxic = ({i for i, *v in labels if v[n] == 1 and i is not None} for n in (0, 1))
    least = {}
    for i, t, *_ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    parts = collections.defaultdict(list)
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t],
        }
        parts[lang or ""].append(("".join(k for k, v in fails.items() if v), i in good, i in toxic))
    out = {}
    for part, rows in parts.items():
        shapley = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left, before = rows, ""
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[0]]
                shapley[x] += len(gone)
                failing = sum(x in r[0] for r in rows)
                left = [r for r in left if x not in r[0]]
                out[part, order, step] = [
                    len(left), len(gone), failing - len(gone), sum(r[0] == x for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)
                ]
                before += x
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


@pytest.fixture(scope="module")
def judged():
    rng = random.Random(6)
    header = "A long common opening of many texts that says nothing at all. " * 3
    pool = [header + str(n) * rng.randint(0, 3) + rng.choice(["", " #", " |x"]) for n in range(12)]
    pool += ["", "AB", " ".join(f"w{n}" for n in range(250)), " ".join(["same"] * 300), "é" * 10 + "A", "\t\n "]
    docs = [(i, rng.choice(pool), rng.choice(["en", "de", None, ""])) for i in rng.sample(range(500), 240)]
    docs += [(7000, None, "en"), (None, "", "en"), (None, pool[0], None), docs[0], docs[0], (docs[1][0], docs[1][1], "xx")]
    return docs, [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 500, 3)] + [(3, 1, 0), (None, 1, 1)]


LABELS = "doc_id long, quality int, toxic int"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


@pytest.mark.parametrize("range_bytes,share", [(audit.RANGE_BYTES, audit.SHARE_BYTES), (400, 1)])
def test_audit_equals_brute_force(spark, make_docs, judged, monkeypatch, range_bytes, share):
    monkeypatch.setattr(audit, "SHARE_BYTES", share)
    monkeypatch.setattr(audit, "STRETCH", 100)
    docs, labels = judged
    failed = audit.failures(make_docs(*docs, extra=True).repartition(5), range_bytes)
    found = audit.interactions(failed, spark.createDataFrame(labels, LABELS).withColumn("part", F.lit("x"))).collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COUNTS) for r in found}
    assert len(found) == len(got)
    assert got == brute_audit(docs, labels)


def test_audit_of_nothing(spark, make_docs):
    labels = spark.createDataFrame([], LABELS)
    assert audit.interactions(audit.failures(make_docs()), labels).count() == 0


def test_longer_prefixes_split_a_common_opening(spark, make_docs, judged):
    docs, _ = judged
    held = make_docs(*docs).select(F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("text"))
    spread = audit.by_adaptive_prefix(held, 400).select("text", F.length("prefix").alias("n"), F.spark_partition_id().alias("at"))
    rows = spread.collect()
    assert max(r["n"] for r in rows) > audit.FIRST_PREFIX
    at = collections.defaultdict(set)
    for r in rows:
        at[bytes(r["text"])].add(r["at"])
    assert all(len(v) == 1 for v in at.values()) and len({p for v in at.values() for p in v}) > 3


def test_radix_trie_holds_texts_and_least_ids():
    rng = random.Random(9)
    texts = ["".join(rng.choices("ab", k=rng.randint(0, 9))).encode() for _ in range(400)]
    trie, losers = audit.RadixTrie(), []
    for i, text in enumerate(texts):
        losers += trie.insert(text, 1000 - i, "p", 0, 1)
    least = {t: 1000 - i for i, t in enumerate(texts)}
    assert {t: n.least for t, n in trie.terminals()} == least
    assert len(losers) == len(texts) - len(least)
    assert [t for t, _ in trie.terminals()] == sorted(least)
