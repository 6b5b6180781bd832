"""Token files, BPE, pivots, toxicity, mixing, language and the pipeline."""

import collections
import hashlib
import random
import re
import zlib

import check
import numpy as np
import pytest
from pyspark.sql import functions as F
from llm_fixtures import make_docs  # noqa: F401
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from shelfmark.llm import bpe, langid, minhash, mixing, pivots, secrets, token_files, toxicity
from shelfmark.llm import queries as q
from shelfmark.session import scratch_path

SF = "/root/testdata/sf0.001"
ALPHABETS = (
    "abcdefghij klm nop'qrst uvw", "AÀÉ éèêçœ ßÄö'", "0123456789 .,;:!?-_=+|", "\t\n\x0b\x0c\r\x1c\x85\xa0  a",
    "日本語 русский עברית हिन्दी", "\U0001f600\U0001f468‍\U0001f469 ❤️", "éạ̈ ́", "'s't're've'm'll'd ",
    "ΑΣ σς İı ﬁ ﬀ Ⅷ ²", "<|>/wstartoftexend ",
)


@pytest.fixture(scope="module")
def library():
    tok = Tokenizer.from_file(bpe.tokenizer_path())
    tok.no_padding()
    tok.no_truncation()
    return tok


@pytest.fixture(scope="module")
def oddities():
    rng = random.Random(4)
    out = [None, "", " \n", "<|startoftext|>", "a<|endoftext|>b <|startoftext|><|startoftext|>", "a" * 5000, "aaa bbb</w> ccc"]
    for _ in range(250):
        letters = "".join(rng.sample(ALPHABETS, rng.randint(1, 4)))
        out.append("".join(rng.choice(letters) for _ in range(rng.randint(1, 80))))
    return out


def test_bpe_equals_the_library(spark, make_docs, library, oddities):
    tokenizer = bpe.load(spark)
    coded = bpe.decode(bpe.encode(make_docs(*enumerate(oddities), extra=True), tokenizer), tokenizer)
    got = {r["doc_id"]: (np.frombuffer(r["ids"], "<u4").tolist(), r["text"]) for r in coded.collect()}
    for n, text in enumerate(oddities):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[n] == (ids, library.decode(ids, skip_special_tokens=False)), text
    assert bpe.encode(make_docs(), tokenizer).count() == 0


def test_certain_boundaries_lie_between_tokens(library):
    with open(bpe.tokenizer_path(), encoding="utf-8") as f:
        coder = bpe.Encoder(f.read())
    cuts = 0
    for word in ("jqzx!!", "qxvkzz", "zxqjv", "xqwvz"):
        for w in coder.words(word):
            ends, at = set(), 0
            for i in np.frombuffer(coder.many([word])[0], "<u4"):
                at += len(library.id_to_token(int(i)).removesuffix("</w>"))
                ends.add(at)
            certain = {i for i in range(1, len(w)) if w[i - 1] + w[i] not in coder.joined}
            cuts += len(certain)
            assert certain <= ends
    assert cuts


def test_token_files_hold_what_was_written(spark, make_docs, library, oddities):
    rng = random.Random(1)
    rows = [(rng.randrange(10**6) if n else None, t) for n, t in enumerate(oddities)] + [(5, "same id"), (5, "again")]
    docs = make_docs(*rows, extra=True)
    manifest = token_files.write(docs, bpe.load(spark), scratch_path(spark, "test"))
    got = sorted(token_files.read_back(manifest).collect(), key=lambda r: r["start"])
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (-1 if r[0] is None else r[0], r[1]))
    at = 0
    for r, (i, t) in zip(got, ordered, strict=True):
        ids = library.encode(t, add_special_tokens=False).ids + [1]
        assert (r["doc_id"], r["start"]) == (i, at)
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        at += len(ids)
    assert token_files.read_back(token_files.write(make_docs(), bpe.load(spark))).count() == 0


def test_frames_are_independent_and_checked(tmp_path, monkeypatch):
    import zstandard
    from pyarrow import fs

    monkeypatch.setattr(token_files, "FRAME_BYTES", 64)
    local, path = fs.LocalFileSystem(), f"{tmp_path}/a.tok.zst"
    writer = token_files.Writer(local.open_output_stream(path, compression=None))
    texts = [b"", b"abcd" * 7, b"wxyz" * 100, b"1234"]
    for n, ids in enumerate(texts):
        writer.add(None if n == 1 else n, ids)
    writer.close()
    with local.open_input_file(path) as source:
        reader = token_files.Reader(source)
        assert [reader.ids(n) for n in (3, 0, 2, 1)] == [texts[n] for n in (3, 0, 2, 1)]
        assert [d[3] for d in reader.docs] == [1, 1, 7, 1] and not reader.docs[1][0]
        first = int(reader.starts[8])
    raw = open(path, "rb").read()
    # Any reader of the format sees plain frames and skips the tables.
    whole = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert whole == b"".join(texts)
    damaged = bytearray(raw)
    damaged[first + 10] ^= 1
    open(path, "wb").write(damaged)
    with local.open_input_file(path) as source, pytest.raises(Exception):  # noqa: B017, PT011
        token_files.Reader(source).ids(2)
        token_files.Reader(source).ids(3)


@pytest.mark.parametrize("name", ["op5_token_files", "op6_bpe_boundaries"])
def test_token_queries(spark, library, name):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows, at = {r["doc_id"]: r for r in q.queries()[name](spark, SF).collect()}, 0
    assert rows.keys() == docs.keys()
    for i in sorted(docs):
        ids, r = library.encode(docs[i], add_special_tokens=False).ids, rows[i]
        if name.startswith("op5"):
            x = np.array(ids + [1], "<u4")
            assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(x), zlib.crc32(x.tobytes()))
            at += len(x)
        else:
            sha = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            text = hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha, text)


def near(rng, x, cosine):
    noise = rng.normal(size=x.shape)
    noise -= noise @ x * x
    return cosine * x + (1 - cosine**2) ** 0.5 * noise / np.linalg.norm(noise)


def vectors():
    rng = np.random.default_rng(8)
    rows = []
    for n in range(400):
        x = rng.normal(size=64)
        x /= np.linalg.norm(x)
        rows.append(x)
        if n % 4 == 0:
            rows.append(near(rng, x, rng.uniform(0.951, 0.999)))
        if n % 9 == 0:
            rows.append(near(rng, x, 0.93))
    centre = rows[0]
    rows += [near(rng, centre, 0.99) for _ in range(120)] + [centre] * 30 + [centre * 3]
    return [[float(np.float32(v)) for v in x] for x in rows]


def brute_links(rows):
    x = np.array(rows, np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    return linked


def component_ids(linked):
    root = np.arange(len(linked))
    while True:
        new = np.minimum(root, np.where(linked, root[None, :], len(root)).min(1))
        if (new == root).all():
            return root
        root = new


def embedded(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


@pytest.mark.parametrize("block", [16, 512])
def test_links_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(pivots, "BLOCK", block)
    rows = vectors()
    found = {r["vec_id"]: r for r in pivots.near_duplicates(embedded(spark, list(enumerate(rows)))).collect()}
    linked = brute_links(rows)
    want = linked.sum(1)
    got = np.array([found[i]["n_links"] for i in range(len(rows))])
    assert (got <= want).all() and got.sum() >= 0.95 * want.sum()
    roots = component_ids(linked)
    assert np.mean([found[i]["component_id"] == r for i, r in enumerate(roots)]) > 0.97


def test_vectors_that_cannot_link(spark):
    x = [1.0] + [0.0] * 7
    rows = [
        (0, None), (1, []), (2, [0.0] * 8), (3, [None, *x[1:]]), (4, [float("nan"), *x[1:]]), (5, [float("inf"), *x[1:]]),
        (6, x), (7, [-0.0 if v == 0 else v for v in x]), (7, x), (None, x), (8, x + x), (9, x + x),
    ]
    df = embedded(spark, rows).withColumn("rep", F.lit("x")).withColumn("size", F.lit("y"))
    got = collections.Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in pivots.near_duplicates(df).collect())
    assert got == collections.Counter(
        [(i, 0, i, True) for i in range(6)]
        + [(6, 3, 6, True), (7, 3, 6, False), (7, 3, 6, False), (None, 3, 6, True), (8, 1, 8, True), (9, 1, 8, False)]
    )
    assert pivots.near_duplicates(embedded(spark, [])).count() == 0


def test_op7(spark):
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect())
    found = {r["vec_id"]: r for r in q.queries()["op7_pivot_permutations"](spark, SF).collect()}
    want = brute_links([v for _, v in rows]).sum(1)
    assert [found[i]["n_links"] for i, _ in rows] == want.tolist()


INSULTS = {"en": ["zargh", "blotto", "zarghen"], "de": ["krimplich", "krimpen"]}


def labelled(n, seed):
    rng = random.Random(seed)
    calm = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(800)]
    rows = []
    for i in range(n):
        words = [rng.choice(calm) for _ in range(rng.choice([5, 40, 200]))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS["en"] + INSULTS["de"]))
        rows.append((" ".join(words).capitalize() + ".", toxic))
    return rows


def test_network_learns_insults():
    fitted = toxicity.train(*zip(*labelled(500, 1)))
    scorer = toxicity.Scorer(*fitted)
    test = labelled(200, 2)
    scores = np.array(scorer.scores([t for t, _ in test]))
    flags = np.array([y for _, y in test])
    assert ((scores >= 0.3) == flags).mean() > 0.93
    assert scorer.scores([None, "", " ... "]) == [0.0, 0.0, 0.0]
    # The worst window decides, wherever it stands in a long text, and scoring is the same in any company.
    calm = " ".join(t for t, y in labelled(900, 3) if not y)
    for at in (0, len(calm) // 2, len(calm)):
        assert scorer.scores([calm[:at] + " zargh blotto zarghen " + calm[at:]])[0] > 0.3
    again = [scorer.scores([t])[0] for t, _ in test[:20]]
    assert np.allclose(again, scores[:20], atol=1e-5)


def test_network_gradient():
    rng = np.random.default_rng(0)
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    slots, at = np.array([1, 5, 9]), rng.integers(0, 3, (4, 2))
    mask = np.array([[1, 1], [1, 1], [1, 0], [1, 0]], bool)
    args = (rng.normal(size=(4, 2, 2)), (slots, at), np.array([3, 4, 4, 8]), np.array([0, 1, 1, 2]), mask, np.array([1.0, 0.0]), np.ones(2))
    kept = {k: v.copy() for k, v in net.p.items()}

    def loss(p):
        other = toxicity.Network()
        other.p = {k: v.copy() for k, v in p.items()}
        return other.learn(*args, 0.0)

    net.learn(*args, 1e-9)
    for name in ("x", "uf", "ub", "bf", "wa", "va", "wo", "word", "gram"):
        # The first step of the optimizer has moments of 0.1 times the gradient.
        grad = net.moments[name][0] / 0.1 - 1e-5 * kept[name]
        place = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        values = []
        for step in (1e-4, -1e-4):
            moved = {k: v.copy() for k, v in kept.items()}
            moved[name][place] += step
            values.append(loss(moved))
        assert (values[0] - values[1]) / 2e-4 == pytest.approx(grad[place], rel=0.05, abs=1e-6), name


def test_toxicity_cases(spark, make_docs):
    rows = [(i, t) for i, (t, _) in enumerate(labelled(150, 5))]
    docs = make_docs(*rows, (900, None), (901, ""), (3, rows[3][1]), extra=True)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(labelled(150, 5))] + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model)
    assert out.columns == [c for c in docs.columns if c != "score"] + ["score"] and out.count() == 153
    assert {r["score"] for r in out.filter("doc_id >= 900").collect()} == {0.0}
    assert toxicity.fit(docs, labels.filter("toxic = 0")) is None
    assert toxicity.score(docs, None).agg(F.max("score")).first()[0] == 0.0
    assert toxicity.score(make_docs(), model).count() == 0
    learned = {r["text"] for r in toxicity.sample(docs, labels).collect()}
    held = {t for i, t in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert learned and not learned & held


def test_op8_holds_out(spark):
    rows = q.queries()["op8_toxicity_network"](spark, "/root/testdata/sf0.01").collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    pairs = [(a > b) + (a == b) / 2 for a, y in held if y for b, z in held if not z]
    assert np.mean(pairs) > 0.85


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[n % len(weights)] for n, s in enumerate(names)}
    budget, out, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while True:
        left = budget - sum(out.values())
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * left / total > 2 * sizes[s]}
        if not over:
            return out | {s: weight[s] * left / total for s in open_}
        out |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over


def check_mix(rows, docs):
    sizes = collections.Counter()
    for i, text, source in docs:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = brute_targets(sizes)
    taken, largest = collections.Counter(), collections.Counter()
    for r in rows:
        s = r["source"]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert r["copies"] in (0, 1, 2)
        taken[s] += r["size"] * r["copies"]
        largest[s] = max(largest[s], r["size"])
    for s, target in want.items():
        assert abs(taken[s] - target) <= 2 * max(largest.values())
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())


@pytest.mark.parametrize("block", [7, 5000])
def test_mix_meets_targets(make_docs, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", block)
    rng = random.Random(6)
    sources = ["hot"] * 200 + ["a"] * 60 + ["b"] * 20 + ["é", "z", None, None] * 6
    docs = [(n, None if n == 9 else "word " * rng.choice([0, 1, 30, 300]), "en", s) for n, s in enumerate(sources)]
    df = make_docs(*docs, extra=True)
    rows = mixing.plan(df).collect()
    check_mix(rows, [(i, t, s) for i, t, _, s in docs])
    again = mixing.plan(df.repartition(3)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again)) if None not in sources else len(again) == len(rows)
    mixed = collections.Counter(r["doc_id"] for r in mixing.mix(df).collect())
    assert mixed == collections.Counter({r["doc_id"]: r["copies"] for r in rows if r["copies"]})
    assert mixing.mix(df).columns == df.columns


def test_mix_of_odd_tables(make_docs):
    assert mixing.plan(make_docs()).count() == 0 and mixing.mix(make_docs()).count() == 0
    blank = make_docs((1, None, "en", "a"), (2, "", "en", None))
    assert {(r["size"], r["target"], r["copies"]) for r in mixing.plan(blank).collect()} == {(0, 0.0, 0)}
    same = make_docs(*[(1, "a b c", "en", "s")] * 4, (2, "d e", "en", "s"))
    by = {(r["doc_id"], r["copies"]) for r in mixing.plan(same).collect()}
    assert len(by) == 2


def test_language_cases(spark, make_docs):
    rng = random.Random(2)
    stems = {"en": ["the", "wh", "ing", "ough"], "de": ["ung", "sch", "ein", "ä"], "fr": ["eau", "é", "que", "oi"], "es": ["ción", "ñ", "ar", "os"]}
    rows = []
    for n in range(240):
        lang = list(stems)[n % 4]
        rows.append((n, " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.choice([3, 60]))), lang))
    docs = make_docs(*rows, (900, None, "en"), (901, "", None), (902, "123 -- 4!", "de"), (903, "THE WHOUGHING", None), extra=True)
    out = {r["doc_id"]: r for r in langid.predict(docs, langid.train(docs)).collect()}
    assert [out[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "en"]
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([out[i]["lang_pred"] == lang for i, _, lang in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert langid.predict(make_docs(), langid.train(docs)).count() == 0
    nothing = langid.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}


CLOSE = {"sv": ["och", "är", "ör", "tt"], "da": ["og", "er", "ør", "ede"], "no": ["og", "er", "ør", "tt"]}


def close_texts(n, seed, langs=tuple(CLOSE)):
    rng = random.Random(seed)
    made = [(lang, " ".join("".join(rng.choice(CLOSE[lang]) for _ in range(2)) for _ in range(8))) for _ in range(n) for lang in CLOSE]
    kept = [(lang, t) for lang, t in made if lang in langs]
    return [t for _, t in kept], [lang for lang, _ in kept]


def test_sample_of_repeated_texts_is_bounded(spark):
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.when(F.col("id") % 3 > 0, F.col("id"))).alias("own"))
    docs = rows.select("doc_id", F.coalesce("own", F.lit("one text of a third of all rows")).alias("text"), F.lit("en").alias("lang"))
    for n in range(20):  # whatever the repeated text is
        drawn = langid.sample(docs.withColumn("text", F.concat("text", F.lit(f" {n}"))), 300).count()
        assert 200 < drawn < 420


def test_three_close_languages_have_a_machine_for_each_two():
    texts, langs = close_texts(80, 1)
    assert max(map(len, texts)) <= 80  # no excerpts are drawn
    model = langid.fit(texts, langs)
    [(own, (weights, offsets))] = model.within
    assert own == ["da", "no", "sv"] and weights.shape == (langid.DIMS, 3)
    for n, two in enumerate((("da", "no"), ("da", "sv"), ("no", "sv"))):
        [(_, (alone, at))] = langid.fit(*close_texts(80, 1, two)).within
        assert np.allclose(weights[:, n], alone[:, 0]) and np.isclose(offsets[n], at[0])
    held, true = close_texts(60, 2)
    assert np.mean([model.predict(langid.features(t))[0] == lang for t, lang in zip(held, true)]) > 0.95


def test_votes_count_before_margins():
    at, means = langid.decide(np.array([0.1, -0.5, -0.2]), 3)  # 1 beats 0 and 2 narrowly, 0 beats 2 by far
    assert at == 1 and np.argmax(means) == 0
    ring = langid.decide(np.array([0.1, -0.5, 0.3]), 3)  # each beats one other: margins decide
    assert ring[0] == 0


def test_op10_held_out_accuracy(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = q.queries()["op10_language_families"](spark, "/root/testdata/sf0.01").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.97


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_queries_with_sql(spark, name):
    ok, note = check.compare(spark, check.connect(SF), SF, name)
    assert ok, note


def test_pipeline_stages(spark, library):
    """Each stage against plain Python on what the stage before it kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    from test_llm_text import brute_components

    from shelfmark.session import cut_lineage

    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = cut_lineage(stage(spark, docs, SF))
        after = docs.collect()
        if name == "toxicity":
            model = toxicity.fit(spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long"), spark.read.parquet(f"{SF}/labels.parquet"))
            scores = toxicity.Scorer(*model).scores([r["text"] for r in before])
            want = {r["doc_id"] for r, s in zip(before, scores) if s < corpus_pipeline.REJECT}
            assert {r["doc_id"] for r in after} == want
        elif name == "near_dedup":
            roots = brute_components([(r["doc_id"], r["text"]) for r in before], 5, 80)
            assert {r["doc_id"] for r in after} == {i for i, root in roots.items() if i == root}
        elif name == "secrets":
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
            assert secrets.scan(docs)[1].filter(F.size(secrets.of_kinds(F.col("spans"), "access", "hex", "pem", "jwt")) > 0).count() == 0
        elif name == "mixing":
            plan = mixing.plan(spark.createDataFrame(before, docs.schema)).collect()
            check_mix(plan, [(r["doc_id"], r["text"], r["source"]) for r in before])
            assert collections.Counter(r["doc_id"] for r in after) == collections.Counter({r["doc_id"]: r["copies"] for r in plan if r["copies"]})
        else:
            texts = {r["doc_id"]: r["text"] for r in before}
            assert len(after) == len(before)
            assert all(np.frombuffer(r["ids"], "<u4").tolist() == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids for r in after)
        if name != "bpe":
            assert docs.columns == columns


def test_added_tokens_in_a_row():
    library = Tokenizer.from_file(bpe.tokenizer_path())
    with open(bpe.tokenizer_path(), encoding="utf-8") as f:
        coder = bpe.Kept(bpe.Encoder(f.read()))
    for text in ("<|endoftext|>" * 10_000, "a<|endoftext|>b<|startoftext|><|endoftext|> c", "<|endoftext", "<|endoftext|>"):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(coder.texts([text])[0], "<u4").tolist() == want


def test_token_files_are_read_by_as_many_tasks_as_files(spark, make_docs):
    folder, tokenizer, manifest = scratch_path(spark, "tokens"), bpe.load(spark), None
    for n in range(5):
        made = token_files.write(make_docs(*((10 * n + i, f"text {i}") for i in range(10))), tokenizer, folder)
        made = made.withColumn("part", F.col("part") + 100 * n)
        manifest = made if manifest is None else manifest.unionByName(made)
    held = token_files.read_back(manifest)
    used = held.select(F.spark_partition_id().alias("at")).distinct().count()
    assert used == manifest.count() >= 5 and held.count() == 50


def test_pipeline_is_registered(spark):
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    ops = sorted(int(n[2:].split("_")[0]) for n in entry.queries() if re.match(r"op\d+_", n))
    assert ops == list(range(1, 14))


def test_pipeline_odd_rows(spark, make_docs, tmp_path):
    """Nulls, empty texts, repeated rows and an empty table go through every stage."""
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "one two", "en", "a"), (3, "one two", "en", "a"), (None, "x y", "en", "b"), (4, "token=abcdef1 " * 40, None, "b")]
    for n, some in enumerate((rows, [])):
        folder = f"{tmp_path}/{n}"
        make_docs(*some, extra=True).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, folder).collect()
        assert bool(out) == bool(some)
    assert minhash.REGISTERS


@pytest.mark.parametrize("split", [False, True])
def test_kept_words_that_overflow(library, monkeypatch, split):
    """Few words are kept: those at hand stay, the others are encoded again, with the same ids."""
    monkeypatch.setattr(bpe, "KEPT_WORDS", 12)
    with open(bpe.tokenizer_path(), encoding="utf-8") as f:
        kept = bpe.Kept(bpe.Encoder(f.read(), split=split))
    lines = ["the same words again", "other words, 3 of them", "Ünïcode naïve 你好 words", "one<|endoftext|>two", "", "x " * 30]
    for n in range(12):
        texts = [f"{line} w{n} v{n * 7}" for line in lines[n % 3 :]] + lines
        want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
        assert kept.texts(texts) == want
        assert len(kept.words) <= 12 + len({w for t in texts for w in t.split()}) * 3


def test_words_outlive_a_task(library, monkeypatch):
    """What one task has encoded, the next one of the worker does not merge again; long words are not held."""
    monkeypatch.setattr(bpe, "_worker", [])
    with open(bpe.tokenizer_path(), encoding="utf-8") as f:
        text = f.read()
    long = "ab" * bpe.WORKER_CHARS
    texts = ["some words, kept", f"other words {long}", "naïve 你好 words", f"你好{long}"]
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    kept = bpe.kept_by_worker(text)
    assert kept.texts(texts) == want
    kept.rest()
    assert max(map(len, [*kept.words, *kept.stretches])) <= bpe.WORKER_CHARS and not kept.encoder.fragments
    merged = []
    monkeypatch.setattr(kept.encoder, "last", lambda words, last=kept.encoder.last: merged.extend(words) or last(words))
    again = bpe.kept_by_worker(text)
    assert again is kept and again.texts(texts[:1]) == want[:1] and not merged
    assert again.texts(texts) == want and merged
    again.limit = 2
    again.rest()
    assert not again.words and again.texts(texts) == want
    assert bpe.kept_by_worker(text.replace("<|endoftext|>", "<|end|>")) is not kept
