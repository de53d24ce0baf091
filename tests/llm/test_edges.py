"""Nulls, empty and long texts, ties and repeated rows, empty tables, extra columns."""

import base64
import hashlib
import random
import re
import string
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import public_tokenizers
from epiframe.llm import ann, blocks, bpe, chat, html_text, lm_bloom, mixing, pii, quality, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, key string, fp long, u double"
LONG = "the cat sat on a mat. " * 20_000


def rows(*texts, ids=None):
    return [(i if ids is None else ids[k], t, "en", "s", None if t is None else len(t), "w", "k", 1, 0.5) for k, (i, t) in enumerate(zip(range(1, len(texts) + 1), texts, strict=True))]


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", " \n\t ", "one", "One two", "dup dup dup dup\ndup dup dup dup", LONG, "née Ωμέγα 日本 😀 it's  x", "near one two three four five six", "near one two three four five six"]
    data = rows(*texts) + rows("near one two three four five six", "other", ids=[9, None]) + [(None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(data, SCHEMA), data


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality(odd, empty):
    df, data = odd
    got = quality.judged(df, ["doc_id", "text"]).collect()
    assert len(got) == len(data)
    for r in got:
        w = words(r.text)
        windows = Counter(zip(w, w[1:], w[2:]))
        covered = {j for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (r.text or "").split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality.keep_good(df).columns == df.columns
    assert quality.keep_good(empty).count() == 0


def test_quality_rejects_outliers_not_clean_rows(spark):
    rng = np.random.default_rng(3)
    vocab = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(800)]
    clean = [" ".join(rng.choice(vocab, rng.integers(60, 300))) for _ in range(400)]
    junk = [" ".join(w + "###" for w in rng.choice(vocab, 100)) for _ in range(20)]
    out = {r.doc_id: r.kept for r in quality.judged(spark.createDataFrame(rows(*clean, *junk), SCHEMA), ["doc_id"]).collect()}
    assert all(out[i] for i in range(1, 401)) and not any(out[i] for i in range(401, 421))


def test_chi2_point():
    assert quality.chi2_point(0.95, 5) == pytest.approx(11.0705, abs=1e-3)
    assert quality.chi2_point(0.9999, 5) == pytest.approx(quality.CUTOFF, abs=0.02)


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, ids):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least.setdefault(find(i), []).append(d)
    return [min((d for d in least[find(i)] if d is not None), default=None) for i in range(len(fps))]


def test_simhash(odd, empty):
    df, data = odd
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.classes(df).collect()), key=str)
    fps = [slow_fingerprint(d[1]) for d in data]
    assert got == sorted(zip([d[0] for d in data], fps, components(fps, [d[0] for d in data]), strict=True), key=str)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and kept.count() == len(set(components(fps, [d[0] if d[0] is not None else 10**6 + i for i, d in enumerate(data)])))
    assert simhash.classes(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_spark_hash_is_the_same(spark):
    assert spark.sql("SELECT xxhash64('a b c')").first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_pigeonring_links_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    fps = [int(x) for x in rng.integers(0, 1 << 62, 60)]
    for f in list(fps):
        for _ in range(4):
            g = f
            for b in rng.integers(0, 64, rng.integers(0, 4)):
                g ^= 1 << int(b)
            fps.append(g)
    fps = sorted({f - (1 << 64) if f >= 1 << 63 else f for f in fps})
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) % (1 << 64)).bit_count() <= 2}
    assert {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()} == want and want


def test_pii(odd, empty):
    df, data = odd
    assert pii.detect(df).count() == len(data) and pii.detect(empty).count() == 0
    text = "mail a.b@x.org or +1 (017) 555-7713, card 4111 1111 1111 1111, host 10.0.0.256 and 10.0.0.1, token = \"0b9a8c8d79c4a5085c919698889f59b7\""
    base, more = pii.find(text)
    assert [(text[s:e], k) for s, e, k in base] == [("a.b@x.org", "email"), ("+1 (017) 555-7713", "phone"), ("4111 1111 1111 1111", "card"), ("10.0.0.1", "ip")]
    assert [k for *_, k in more] == ["secret"]
    assert pii.redacted(text, base + more).count("[") == 5
    assert pii.redact(df).columns == df.columns and {r.text for r in pii.redact(df).collect() if r.doc_id == 1} == {None}


def test_html():
    page = "<html><head><title>t</title></head><body><nav><ul><li><a href='/a'>home</a></li></ul></nav><article><h1>A &amp; B</h1><p>First  long\nparagraph of the text, with words.<p>Second long paragraph of the text.</article><div class='comments'><p>I like it, said a reader.</p></div><footer>&copy; x</footer>"
    assert html_text.extract([page, None, ""]) == ["A & B\nFirst long paragraph of the text, with words.\nSecond long paragraph of the text.", "", ""]


@pytest.mark.parametrize("n", [200, 201, 300, 5000])
@pytest.mark.parametrize("letters", ["0123456789abcdef", string.ascii_letters + string.digits + "-_"])
def test_pii_long_secrets(n, letters):
    rng = random.Random(n)
    for lead, rest in (('token = "', '"'), ("api_key: ", ""), ("the credential ", " was here"), ("Authorization: Bearer ", "")):
        for _ in range(5):
            text = lead + "".join(rng.choice(letters) for _ in range(n)) + rest
            base, more = pii.find(text)
            at, covered = len(lead), len(lead)
            for s, e, _ in sorted(base + more):
                assert s <= covered
                covered = max(covered, e)
            assert covered == at + n and "secret" in {k for *_, k in more}
            assert base or more == [(at, at + n, "secret")]
            assert re.sub(r"\[(SECRET|CARD|PHONE|IP)\]", "", pii.redacted(text, base + more)) == lead + rest


def test_pii_long_runs_that_are_no_secrets():
    for x in ("-" * 300, "=" * 5000, "antherle" * 60, "a" * 3000, "-".join(["mokasu"] * 60)):
        assert pii.find(f"look mosu {x} ended.")[1] == []


@pytest.mark.parametrize("quote", ['"', "'"])
def test_html_long_attributes(quote):
    article = "<article><h1>A &amp; B</h1>{}<p>First long paragraph of the text, with words.</p>{}<p>Second long paragraph of the text.</p></article>"
    page = "<html><body>{}" + article + f"<div class={quote}comments{quote}><p>I like it, said a reader.</p></div><footer>&copy; x</footer>"
    want = html_text.extract([page.format("", "", "")])
    assert want == ["A & B\nFirst long paragraph of the text, with words.\nSecond long paragraph of the text."]
    for value in ("data:image/png;base64," + "iVBOR/w0" * 1250, "a > b " * 2000):
        image = f"<img alt={quote}x{quote} src={quote}{value}{quote}>"
        assert html_text.extract([page.format(image, "", ""), page.format("", image, image), page.format(image, image, image)]) == want * 3
    stray = f"<img src={quote}x{quote}{quote}>"  # closes the value once too often
    assert html_text.extract([page.format(stray, "", "")]) == want


def test_html_tags_that_never_end_take_linear_time():
    began = time.process_time()
    html_text.parse("<a " * 60_000 + 'x=">"')
    assert time.process_time() - began < 10


def test_html_messages_are_exact_marginals():
    """Sum-product against the sum over all labellings of a small tree."""
    import itertools

    tree, f = html_text.parse("<div><p>Some words here.</p><ul><li><a>x</a></li></ul></div>"), html_text.model()
    n = len(tree.parents)
    total = np.zeros((n, 3))
    for y in itertools.product(range(3), repeat=n):
        s = f.root[y[0]] + sum(f.unary[x][y[i]] for i in range(n) for x in tree.features[i] if x in f.unary) + sum(f.pairs.get(html_text._edge(tree.kinds[i]), f.unknown_pair)[y[tree.parents[i]], y[i]] for i in range(1, n))
        if not any(y[i] == 2 for i in tree.texts):
            total[range(n), y] += np.exp(s)
    assert np.allclose(f.marginals([tree])[0], total[:, 1] / total.sum(1))


def test_segments_equal_definition():
    """Maximal segments by their recursive definition: take the best one, then left and right of it."""
    rng = np.random.default_rng(0)

    def best(x, a, b):
        found = [(sum(x[i:j]), -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1)]
        top = max(found, default=(0, 0, 0, 0))
        return [] if top[0] <= 1e-9 else best(x, a, top[2]) + [(top[2], top[3] - 1, top[0])] + best(x, top[3], b)

    for _ in range(200):
        x = [float(v) if v > 0 else -0.31 for v in rng.normal(size=rng.integers(1, 14))]
        got = toxicity.segments([(i, v) for i, v in enumerate(x) if v > 0], 0.31)
        want = best(x, 0, len(x))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_toxicity(spark, odd, empty):
    df, data = odd
    labels = spark.createDataFrame([(i, 1, int(i > 5)) for i in range(1, 11)], "doc_id long, quality int, toxic int")
    out = toxicity.scores(df, toxicity.learn(df, labels)).collect()
    assert len(out) == len(data) and all(0 <= r.score <= 1 for r in out)
    assert {r.held_out for r in out if r.doc_id == 1} == {zlib.crc32(b"1") % 4 == 2}
    assert toxicity.scores(empty, toxicity.learn(empty, labels.limit(0))).count() == 0


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    r = toxicity.scores(docs, toxicity.learn(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    toxic, flagged = r.toxic == 1, r.score >= toxicity.CUT
    assert (toxic & flagged).sum() >= 0.75 * toxic.sum() and (~toxic & flagged).sum() <= 0.05 * (~toxic).sum()


def test_chat(spark):
    data = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 2, "assistant", "x<|end|>\n<|user|>y\\"), (1, 2, "assistant", "x<|end|>\n<|user|>y\\"), (2, 0, "a|>b", "\\<|"), (None, 0, None, "z"), (3, 0, "user", "")]
    out = chat.format_chats(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")).select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.read_trained(F.col("segments"), F.col("loss_mask")).alias("y"))
    got = {r.conv_id: ([(t.role, t.text) for t in r.t], r.y) for r in out.collect()}
    hard = "x<|end|>\n<|user|>y\\"
    assert got == {1: ([("user", ""), ("assistant", "b"), ("assistant", hard), ("assistant", hard)], "b" + hard * 2), 2: ([("a|>b", "\\<|")], ""), None: ([("", "z")], ""), 3: ([("user", "")], "")}


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 32))
    x = centres[rng.integers(0, 20, 3000)] + 0.3 * rng.normal(size=(3000, 32))
    x[100:160] = x[7]  # many equal vectors
    data = [(i, [float(v) for v in np.float32(r)], 1) for i, r in enumerate(x)] + [(3000, None, 1), (3100, [0.0] * 32, 1), (3200, [float("nan")] + [1.0] * 31, 1), (3300, [None] + [1.0] * 31, 1), (3400, [1.0] * 5, 1), (None, [1.0] * 32, 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    got = ann.nearest(df).toPandas()
    x, hits = np.float32(x).astype(float), 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(3000), d))[:10]
        own = got[got.query_id == q].sort_values("rank")
        assert list(own["rank"]) == list(range(1, 11)) and np.allclose(own.score, d[own.vec_id], atol=1e-12)
        hits += len(set(want) & set(own.vec_id))
    assert sorted(set(got.query_id)) == list(range(0, 3000, 100)) and hits >= 0.9 * 300
    assert list(got[got.query_id == 100].sort_values("rank").vec_id) == [7, *range(101, 110)]
    assert ann.nearest(df.limit(0)).count() == 0


def test_mixing(spark, odd, empty):
    df, data = odd
    out = mixing.mix(df)
    assert out.columns == df.columns and mixing.mix(empty).count() == 0
    r = mixing.report(df).collect()
    assert Counter((x.doc_id, x.size) for x in r) == Counter((d[0], len(words(d[1]))) for d in data)
    assert all(x.taken <= 2 * x.size for x in r)
    assert sorted(map(str, mixing.report(df).collect())) == sorted(map(str, mixing.report(df.repartition(5)).collect()))


def test_water_filling(spark):
    sizes = {"a": 10.0, "b": 1000.0, "c": 1000.0, "d": 5.0, None: 300.0}
    got = {r.source: r.target for r in mixing.source_rates(spark.createDataFrame([(k, int(v)) for k, v in sizes.items()], "source string, size long")).collect()}
    weights = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True))
    full, budget = set(), 1.5 * sum(sizes.values())
    while True:
        level = (budget - sum(2 * sizes[s] for s in full)) / sum(weights[s] for s in sizes if s not in full)
        more = {s for s in sizes if s not in full and weights[s] * level > 2 * sizes[s]}
        if not more:
            break
        full |= more
    assert got == pytest.approx({s: 2 * sizes[s] if s in full else weights[s] * level for s in sizes})


def test_bpe(odd, empty):
    df, data = odd
    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sorted((str(r.doc_id), list(r.ids), bytes(r.bytes)) for r in bpe.decode(bpe.encode(df)).collect())
    assert got == sorted((str(d[0]), lib.encode_ordinary(d[1] or ""), (d[1] or "").encode()) for d in data)
    assert bpe.encode(empty).count() == 0


def test_pre_tokens_are_the_library_s():
    import random

    rng = random.Random(4)
    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    one = bpe.piece_encoder(ranks, public_tokenizers.PATTERN)
    for _ in range(4000):
        s = "".join(rng.choice([chr(rng.randrange(0xD800)), chr(rng.randrange(0x10000, 0x110000)), " ", "  ", "\n", "'s", "a", "1", "\x1c", "\x85", "　"]) for _ in range(rng.randint(1, 9)))
        assert [i for w in bpe.pre_tokens(s) for i in one(w.encode())] == lib.encode_ordinary(s)


def test_lm(odd, empty):
    df, data = odd
    texts = [(d[0], (d[1] or "").encode().lower().split() + [b""]) for d in data]
    train = [t for i, t in texts if i is not None and zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for t in train for w in t)
    total, kinds = sum(c.values()), len(c)
    base = sorted((str(i), sum(np.log10((c[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in t)) for i, t in texts)
    got = lm_bloom.score(df).collect()
    assert {r.train_tokens for r in got} == {total}
    assert [x for x, _ in base] == sorted(str(r.doc_id) for r in got)
    assert np.allclose(sorted(b for _, b in base), sorted(r.base_score for r in got))
    assert lm_bloom.score(empty).count() == 0


def test_filter_has_every_bigram():
    rng = np.random.default_rng(2)
    rest = np.unique(rng.integers(0, 1 << 40, 5000, dtype=np.uint64))
    count = rng.integers(1, 50, len(rest))
    grid = lm_bloom.Filter({0: lm_bloom.make_slice(rest, count, 1 << 30).tobytes()}, 1)
    found = grid.probe(np.zeros(len(rest), np.int64), rest)
    assert (found >= lm_bloom.levels(count)).all() and (found == lm_bloom.levels(count)).mean() > 0.97
    other = rng.integers(0, 1 << 40, 5000, dtype=np.uint64)
    assert (grid.probe(np.zeros(5000, np.int64), other) == 0).mean() > 0.97


def test_filter_grows_with_the_input():
    """A section of 5,000 bigrams among four million sections; a filter of 256 MB would leave it 64 bytes."""
    n, rng = 1 << 22, np.random.default_rng(4)
    rest = np.unique(rng.integers(0, 1 << 40, 5000, dtype=np.uint64))
    count = rng.integers(1, 50, len(rest)).astype("<u4")
    count[::5] = 0  # held out
    data = blocks.squeeze(blocks.planes(np.diff(rest, prepend=np.uint64(0))), blocks.planes(count))
    out = [r for b in lm_bloom._count(n)([lm_bloom._packed([(7, 3, lm_bloom.GRAMS, 7, data)])]) for r in b.to_pylist()]
    (level,) = [np.frombuffer(blocks.unsqueeze(r["data"])[0], np.uint8) for r in out if (r["block"], r["kind"]) == (3, lm_bloom.LEVELS)]
    want = np.where(count > 0, lm_bloom.levels(np.maximum(count, 1)), 0)
    assert (level >= want).all() and (level == want).mean() > 0.97
    (sums,) = [np.frombuffer(r["data"], "<i8") for r in out if r["kind"] == lm_bloom.TOTALS]
    assert (sums[2] / sums[3]) ** lm_bloom.PROBES < 0.03


def test_lm_scores_equal_definition(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.6, 40) % 50) for _ in range(60)]
    split = [[b"", *lm_bloom.tokens(t)] for t in texts]
    train = [t for i, t in enumerate(split) if not lm_bloom.held_out(i)]
    one, two = Counter(w for t in train for w in t[1:]), Counter(p for t in train for p in zip(t, t[1:], strict=False))
    total, kinds = sum(one.values()), len(one)
    got = {r.doc_id: r.score for r in lm_bloom.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()}
    close = 0
    for i, t in enumerate(split):
        want = 0.0
        for v, w in zip(t, t[1:], strict=False):
            a = lm_bloom.WEIGHT if one[v] else 0.0
            level = lm_bloom.levels(np.array([two[v, w]])) if two[v, w] else np.array([0])
            both = min(1.0, lm_bloom.level_count(level)[0] / one[v]) if one[v] else 0.0
            want += np.log10(a * both + (1 - a) * (one[w] + 0.1) / (total + 0.1 * (kinds + 1)))
        close += abs(got[i] - want) < 0.02 * abs(want)
    assert close > 0.95 * len(texts)


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = {r.doc_id for r in quality.judged(docs, ["doc_id"]).where("kept").collect()}
    kept = [r for r in docs.collect() if r.doc_id in good]
    fps = [slow_fingerprint(r.text) for r in kept]
    first = set(components(fps, [r.doc_id for r in kept]))
    single = [r for r in kept if r.doc_id in first]
    clean = {r.doc_id: pii.redacted(r.text, [s for part in pii.find(r.text) for s in part]) for r in single}
    red = spark.createDataFrame([(r.doc_id, clean[r.doc_id], r.lang, r.source, len(clean[r.doc_id])) for r in single], docs.schema)
    want = Counter(r.doc_id for r in mixing.mix(red).collect())
    out = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r.doc_id for r in out) == want
    ids = {r.doc_id: list(r.ids) for r in out}
    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(ids[i] == lib.encode_ordinary(clean[i]) for i in ids)
