"""The other operators against plain readings of their definitions, round trips and held-out accuracy."""

import hashlib
import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat_format, exact_dedup, fingerprint, html_text, language_id, mixing, sentence_pieces
from tidemark.llm import queries as q
from tidemark.llm.common import with_share
from tidemark.sources.stage import clear_stages
from tools.compare import compare, connect

SF = "/root/testdata/sf0.001"
PIECES = q.PIECES
FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@pytest.fixture(autouse=True)
def tidy(spark):
    yield
    clear_stages(spark)


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_sql(spark, name):
    state, _, _, note = compare(spark, connect(SF), name, q.QUERIES[name], q.SQL[name], SF)
    assert state == "ok", note


# ---------------------------------------------------------------- exact dedup

@pytest.mark.parametrize("bits, digest_bits, capacity", [(64, 256, 4096), (3, 8, 2), (1, 4, 1)])
def test_exact_groups_with_colliding_keys(spark, bits, digest_bits, capacity):
    r = random.Random(bits)
    texts = [None, "", "É a", "é a", "É A", *["".join(r.choice("aAbB") for _ in range(r.randint(0, 3))) for _ in range(300)], "x" * 100_000]
    rows = [(i if i % 17 else None, t) for i, t in enumerate(texts)] + [(7, "ab"), (7, "ab")]
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(FOLD), []).append(i)
    want = []
    for i, t in rows:
        norm = (t or "").translate(FOLD)
        keep = max((x for x in groups[norm] if x is not None), default=None)
        want.append((str(i), str(keep), len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    df = spark.createDataFrame([(*x, "k", 1) for x in rows], "doc_id long, text string, key string, keep_id int")
    got = exact_dedup.exact_groups(df, capacity=capacity, bits=bits, digest_bits=digest_bits).collect()
    assert sorted((str(x.doc_id), str(x.keep_id), x.group_size, x.kept, x.text_sha256) for x in got) == sorted(want)


def test_directory_splits_overfull_buckets(spark):
    keys = spark.range(2000).select(F.xxhash64("id").alias("key"))
    leaves, depth = exact_dedup.directory(keys, capacity=50)
    rows = leaves.collect()
    assert depth > 5 and max(x.n_keys for x in rows) <= 50 and len({x.slot for x in rows}) == len(rows)
    assert sum(x.n_keys for x in {(x.bucket, x.local_depth): x for x in rows}.values()) == 2000


def test_hot_keys_are_joined_by_broadcast(spark):
    left = spark.createDataFrame([(1,)] * 900 + [(i,) for i in range(2, 102)], "k int")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("k") * 2)
    out = with_share(left, right, ["k"], "n", 1000, share=10).collect()
    assert len(out) == 1000 and all(x.v == 2 * x.k for x in out)


# ---------------------------------------------------------------- chat

def test_conversations_collapse(spark):
    rows = [
        (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 1, "assistant", "b"),
        (4, 0, "user", "ab"), (5, 0, "use", "ra"), (None, 0, None, None), (6, None, "user", "<|im_end|>"), (7, 0, "user", "a"), (7, 1, "assistant", "c"),
    ]
    df = spark.createDataFrame([(*x, "t") for x in rows], "conv_id long, turn long, role string, text string, turns string")
    got = {x.conv_id: (x.n_turns, x.n_copies, x.text) for x in chat_format.collapse(df).collect()}
    assert set(got) == {1, 4, 5, 6, 7, None}
    assert got[1] == (2, 2, "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n")
    assert got[6][2].count("<|im_end|>") == 1 and got[None][0] == 1
    assert chat_format.collapse(df.limit(0)).collect() == []


# ---------------------------------------------------------------- mixing

def test_rates_meet_reachable_targets(spark):
    r = random.Random(3)
    data = []
    for _ in range(400):
        a = r.random()
        data.append((r.randint(0, 500), [round(a, 6), round(1 - a, 6)]))
    docs = spark.createDataFrame(data, "__tokens long, __p array<double>")
    steps, report = mixing.fit_rates(docs, [0.7, 0.3])
    assert report["miss"] <= 1e-4
    rates = np.array([x.r for x in docs.select(mixing.rate_of(steps).alias("r")).collect()])
    tokens, p = np.array([d[0] for d in data]), np.array([d[1] for d in data])
    assert rates.min() >= 0 and np.allclose((tokens * rates) @ p, report["want"], rtol=1e-3)
    _, far = mixing.fit_rates(docs, [1.0, 0.0])  # no rates give this: the nearest mix is reported as such
    assert far["miss"] > 1e-4


def test_mix_edges(spark):
    docs = spark.createDataFrame([(1, "good fine text", 1), (2, None, 1), (None, "bad words here", 1), (3, "", 1), (1, "good fine text", 1)], "doc_id long, text string, rate int")
    labels = spark.createDataFrame([(1, "high"), (9, "low"), (None, "low"), (2, None)], "doc_id long, domain string")
    out = mixing.mix(docs, labels, {"high": 0.5, "low": 0.5}).collect()
    assert len(out) == 5 and all(x.rate >= 0 and x.copies >= 0 for x in out)
    assert mixing.mix(docs.limit(0), labels, {"high": 0.5, "low": 0.5}).collect() == []


def test_classifier_learns_its_labels(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(600):
        text = [r.choice(words) for _ in range(30)] + (["awful"] if i % 3 == 0 else [])
        rows.append((i, " ".join(text), "low" if i % 3 == 0 else "high"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, d string")
    model = mixing.train(mixing.training_rows(docs, docs.select("doc_id", F.col("d").alias("domain")), "doc_id", "text"), ["high", "low"])
    p = mixing.with_posteriors(docs, model).collect()
    assert np.mean([(x["__p"][1] > 0.5) == (x.d == "low") for x in p]) > 0.97


# ---------------------------------------------------------------- fingerprints

def test_fingerprints(spark):
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(None, None), (10**6, ""), (10**6 + 1, "Only THIS"), (5, rows[0][1]), (10**6 + 2, "only this")]
    df = spark.createDataFrame([(*x, "b") for x in rows], "doc_id long, text string, bucket string")
    got = fingerprint.with_edits(df).collect()
    assert len(got) == len(rows)
    by_text = {}
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0), reverse=True)
    edited = {}
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 3
        edited.setdefault(d, set()).add(hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest())
    texts = {}
    for d, t in rows:
        texts.setdefault(d, []).append(t or "")
    for x in got:
        assert 0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1
        if x.doc_id not in (5, 6):  # two rows share id 5, in an order of their own
            assert x.edited_sha256 in edited[x.doc_id]
            assert x.n_chars == len(texts[x.doc_id][0])
            assert by_text.setdefault(texts[x.doc_id][0], x.fingerprint) == x.fingerprint
    assert np.mean([x.near_edited for x in got]) > 0.2 > 0.05 > np.mean([x.near_next for x in got])
    one = fingerprint.with_edits(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    assert fingerprint.with_edits(df.limit(0)).collect() == []


# ---------------------------------------------------------------- SentencePiece

def samples():
    r = random.Random(2)
    odd = ["", "  a  b ", "日本語 ☃☃ \U0001f600", "\t\n x\x00y", " " * 50 + "z" * 300, "a" * 2000, "x\ry"]
    odd.append(" ".join("".join(r.choice("abcdefgh'é☃ÀТд1.,") for _ in range(r.randint(1, 14))) for _ in range(3000)))
    return odd


def test_bpe_equals_the_library(spark):
    sp = pytest.importorskip("sentencepiece")
    texts = samples() + [x.text for x in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = sp.SentencePieceProcessor(model_file=PIECES).encode(texts, num_threads=1)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*texts, None])], "doc_id int, text string, ids int")
    out = sentence_pieces.encode(df, PIECES, check_col="same")
    got = {x.doc_id: x for x in out.collect()}
    assert [list(got[i].ids) for i in range(len(texts))] == want and list(got[len(texts)].ids) == []
    assert all(x.same for x in got.values())
    back = {x.doc_id: x.decoded for x in sentence_pieces.decode(out, PIECES).collect()}
    assert [back[i] for i in range(len(texts))] == texts
    assert sentence_pieces.encode(df.limit(0), PIECES).collect() == []


def test_unigram_equals_the_library(tmp_path):
    sp = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as schema

    model, r = schema.ModelProto(), random.Random(1)
    with open(PIECES, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for p in model.pieces:
        if p.type == 1:
            p.score = -r.randint(1 << 14, 1 << 20) / (1 << 16)  # sums over a few words are exact in single precision too
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as f:
        f.write(model.SerializeToString())
    texts = [t[:40] for t in samples()] + samples()[-1].split(" ")
    own = [list(x) for x in sentence_pieces.Vocabulary(path).encode(texts)]
    assert own == sp.SentencePieceProcessor(model_file=path).encode(texts, num_threads=1)


# ---------------------------------------------------------------- languages and pages

def test_language_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {x.doc_id: x.lang for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = q.op9(spark, sf).collect()
    held = [x for x in got if x.held_out]
    assert len(got) == len(truth) and all(x.held_out == (language_id.fold_of(x.doc_id) == 0) for x in got)
    assert np.mean([x.lang_pred == truth[x.doc_id] for x in held]) > 0.98 and all(0 <= x.score <= 1 for x in got)


def test_language_edges(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "123 !?", "de"), (5, "und die Katze", None), (6, "", None)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, lang string, score int")
    got = {x.doc_id: x for x in language_id.predict(df, language_id.learn(df)).collect()}
    assert [got[i].lang_pred for i in range(1, 7)] == ["en", "de", "und", "und", "de", "und"] and got[3].score == 0
    assert {x.lang_pred for x in language_id.predict(df, {}).collect()} == {"und"}
    assert language_id.learn(df.limit(0)) == {} and language_id.predict(df.limit(0), {}).collect() == []


def test_a_long_text_is_bundled_like_its_pieces(monkeypatch):
    text = "The quick brown fox — jumps over 12 lazy dogs. " * 400
    whole = next(language_id.text_bundles([text]))[1]
    monkeypatch.setattr(language_id, "PIECE", 1000)
    parts = list(language_id.text_bundles(["a b c d", text, None, "x"]))
    by_id = {int(i): row for ids, rows in parts for i, row in zip(ids, rows, strict=True)}
    assert np.allclose(by_id[1], whole[0])


def test_pages(spark):
    chain = html_text.trained()
    wrong = total = 0
    for page in html_text.labelled_pages(80, seed=99):
        seq = html_text.blocks(page)
        states = chain.decode(html_text.features(seq))
        total += len(seq)
        wrong += sum((s == html_text.MAIN) != (b.mark == "main") for b, s in zip(seq, states, strict=True))
    assert wrong < 0.02 * total
    page = (
        "<html><body><nav><a href=/>Home</a></nav><header>Site</header><article><h1>A &amp; B</h1><p>One  <b>bold</b>\n line.<p>Two &lt;x&gt;&nbsp;y.</p>"
        "<script>no()</script></article><div class='comments'><p>Bob says: great post</p></div><form><label>Mail</label></form><footer>&copy; 2020</footer>"
    )
    df = spark.createDataFrame([(1, "u", page, "t"), (2, None, None, None), (3, "", "", ""), (4, "u", page, "t"), (5, "u", "plain <", "t")], "page_id long, url string, html string, text string")
    got = {x.page_id: x.text for x in html_text.extract(df).collect()}
    assert got[1] == got[4] == "A & B\n\nOne bold line.\n\nTwo <x> y." and got[2] == got[3] == ""
    assert html_text.extract(df.limit(0)).collect() == []


def test_page_blocks_survive_broken_markup():
    for page in ("<p", "<<<>", "</p></div>", "<p>a<!-- ", "<script>x", "&#xZZ; &am", "<li>a<li>b<ul><li>c</ul>d", "<a href='>x", "<table><tr><td>1<td>2<tr><td>3"):
        html_text.blocks(page)
    assert [b.text for b in html_text.blocks("<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>1<td>2<tr><td>3</table>")] == ["a", "b", "c", "1", "2", "3"]


def test_html_deep_and_late_cues():
    """Open tags that are never closed cost their number, not its square, and cues are looked for in whole blocks."""
    import time

    def seconds(n):
        start = time.process_time()
        seq = html_text.blocks("<div><p>" * n + "a text" + "</span></li></p>" * n)
        assert len(seq) == 1 and seq[0].path == {"html", "div", "p"}
        return time.process_time() - start

    seconds(2000)
    assert seconds(32_000) < 40 * max(seconds(2000), 0.02)
    late = " ".join(["word"] * 60) + " Copyright 2024 all rights reserved"
    cues = [x for x in html_text.features(html_text.blocks(f"<p>{late}</p>"))[0] if x.startswith("cue=")]
    early = [x for x in html_text.features(html_text.blocks("<p>Copyright 2024 all rights reserved</p>"))[0] if x.startswith("cue=")]
    assert cues and set(cues) == set(early)
