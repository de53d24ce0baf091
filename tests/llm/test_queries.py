"""Every opN_ query through the registry against brute force on whole small tables, and the operators' further cases."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import public_tokenizers
from epiframe.llm import ann, blocks, bpe, chat, common, html_text, lm_bloom, mixing, pii, quality, simhash, toxicity
from epiframe.llm.queries import QUERIES
from tests.llm.test_edges import components, slow_fingerprint, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def run(spark, n):
    (name,) = [q for q in QUERIES if q.startswith(f"op{n}_")]
    return QUERIES[name](spark, SF)


def inverse_scatter(c):
    return np.linalg.inv(c + np.diag(np.square(quality.FLOOR).astype(float)))


def brute_mcd(rows):
    """The estimate by its definition, in NumPy, over (lang, source, vector) rows that passed the base rule."""
    groups = {}
    for lang, source, x in rows:
        for key in ((0, None, None), (1, lang, None), (2, lang, source)):
            groups.setdefault(key, set()).add(x)
    v = {k: np.array(sorted(s), float) for k, s in groups.items()}
    d = quality.D

    def drawn(own):
        out = {}
        for k in sorted(own, key=lambda k: k[0]):
            n, m, c = own[k]
            if k[0]:
                um, uc = out[(0, None, None) if k[0] == 1 else (1, k[1], None)]
                w = n / (n + quality.PRIOR)
                m, c = um + w * (m - um), w * c + (1 - w) * uc + w * (1 - w) * np.outer(m - um, m - um)
            out[k] = m, c
        return out

    def step(params, share, factor):
        out = {}
        for k, x in v.items():
            m, c = params[k]
            d2 = np.einsum("ij,jk,ik->i", x - m, inverse_scatter(c), x - m)
            cell = np.rint(quality.CELLS * np.log1p(d2))
            if share is None:
                near = cell <= round(quality.CELLS * np.log1p(quality.chi2_point(0.975, d)))
            else:
                near = np.array([(cell < z).sum() < share * len(x) for z in cell])
            y = x[near]  # where none is near, the group above tells all
            out[k] = (len(y), y.mean(0), factor * np.cov(y.T, bias=True).reshape(d, d)) if len(y) else (0, np.zeros(d), np.zeros((d, d)))
        return out

    q = {k: np.quantile(x, (0.25, 0.5, 0.75), axis=0) for k, x in v.items()}
    own = {k: (len(v[k]), a[1], np.diag(((a[2] - a[0]) / 1.349) ** 2)) for k, a in q.items()}
    settled = None
    for _ in range(quality.STEPS):
        own = step(drawn(own), quality.H, quality.H / quality.chi2_cdf(quality.chi2_point(quality.H, d), d + 2))
        centres = {k: tuple(np.rint(m / quality.SETTLED)) for k, (_, m, _) in own.items()}
        if centres == settled:
            break
        settled = centres
    inner = 0.975 / quality.chi2_cdf(quality.chi2_point(0.975, d), d + 2)
    return drawn(step(drawn(own), None, inner))


def test_op1_verdicts_equal_a_numpy_estimate(spark, docs):
    out = run(spark, 1)
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    stats, share = [], lambda a, b: np.arcsin(np.sqrt(min(1.0, a / max(b, 1))))
    for r in docs:
        w, text = words(r.text), r.text or ""
        g, lines = got[r.doc_id], [x for x in text.split("\n") if words(x)]
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {j for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
        chars, symbols, again = sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines))
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == (len(w), chars, symbols, again, len(covered), failed)
        x = (np.log(max(chars, 1) / max(len(w), 1)), share(symbols, chars), share(again, len(lines)), share(len(covered), len(w)), share(sum("A" <= c <= "Z" for c in text), chars))
        stats.append((r.doc_id, failed, r.lang, r.source, tuple(int(v) for v in np.rint(1000 * np.array(x)))))
    final = brute_mcd([(a, b, x) for _, failed, a, b, x in stats if not failed])
    for i, failed, lang, source, x in stats:
        if failed:
            assert not got[i].kept
        else:
            m, c = final[2, lang, source]
            d2 = float((x - m) @ inverse_scatter(c) @ (x - m))
            assert got[i].d2 == pytest.approx(d2, rel=1e-6, abs=1e-6) and got[i].kept == (d2 <= quality.CUTOFF)


def test_quality_estimates_small_groups_and_rejects_repeats(spark):
    """Groups of a few documents are judged, also where none of their own is near; repeated words or lines alone reject."""
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    lines = lambda w: "\n".join(" ".join(w[i : i + 10]) for i in range(0, len(w), 10))
    rows = [(i, lines(prose(rng.randint(80, 300))), "en", f"s{i % 40}") for i in range(240)]
    w = prose(60)
    rows.append((900, lines(prose(157) + w + w), "en", "s1"))  # 43 % of the words repeat, and no line
    rows.append((901, "\n".join([*prose(20), *(x for _ in range(3) for x in rng.sample(w[:40], 40))]), "en", "tiny"))  # in a group of its own, lines of a word, half of them repeated
    out = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), ["doc_id"]).collect()}
    assert np.mean([out[i].kept for i in range(240)]) > 0.98
    assert not out[900].base_failed and not out[900].kept
    assert not out[901].base_failed and out[901].d2 > quality.CUTOFF and not out[901].kept


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), list(BASE).index(kind), m.end()))
    return sorted(out)


def test_op2_base_spans_equal_plain_patterns(spark, docs):
    got = {r.doc_id: r for r in run(spark, 2).collect()}
    for r in docs:
        want = plain_spans(r.text or "")
        g, joined = got[r.doc_id], ",".join(f"{list(BASE)[k]}:{s}:{e}" for s, k, e in want)
        n = Counter(list(BASE)[k] for _, k, _ in want)
        assert (g.n_email, g.n_ip, g.n_card, g.n_phone) == tuple(n[k] for k in BASE)
        assert g.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(g.spans.split(","))


def test_pii_overlaps_and_long_local_parts():
    taken = pii._merged([(0, 100), (5, 8), (20, 30), (40, 45), (50, 55), (58, 59)])
    assert taken == [(0, 100)] and not pii._free(taken, 60, 70) and pii._free(taken, 100, 110) and not pii._free(taken, 105, 120)
    text = "write to " + "a" * 90 + " (at) some dot org please"
    assert any(s == 9 and text[s:e].endswith("org") for s, e, *_ in pii.candidates(text))


def test_op3_columns_and_held_out_layouts(spark):
    out = run(spark, 3).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert {r.page_id for r in out} == set(pages)
    assert all(r.n_chars == len(r.text) and r.url == pages[r.page_id].url and "\n\n" not in r.text for r in out)
    rng, f, right, all_ = random.Random(1234), html_text.model(), 0, 0
    for _ in range(150):
        tree, labels = html_text._labelled(rng)
        p = f.marginals([tree])[0]
        right += sum((p[k] > 0.5) == (labels[k] == 1) for k in tree.texts)
        all_ += len(tree.texts)
    assert right >= 0.95 * all_


def test_html_leaves_out_what_is_not_displayed(spark):
    page = "<body><article><h1>Title here</h1><p style='color:red; display : none'>secret one</p><p>Seen <span hidden>unseen <span>x</span> y</span> words here in a long paragraph of text.<div hidden><p>gone</p></div><p class=hidden style='overflow:hidden'>This one is seen, and it is long enough.</p></article>"
    want = "Title here\nSeen words here in a long paragraph of text.\nThis one is seen, and it is long enough."
    df = spark.createDataFrame([(1, "u", page, "x"), (1, "u", page, "x"), (None, None, None, None), (2, "v", "", "y")], "page_id long, url string, html string, text string")
    assert sorted((str(r.page_id), str(r.url), r.text) for r in html_text.main_text(df).collect()) == sorted([("1", "u", want), ("1", "u", want), ("None", "None", ""), ("2", "v", "")])
    assert html_text.main_text(df.limit(0)).count() == 0


def test_op4_columns(spark, docs):
    out = run(spark, 4).collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)


def test_toxic_passages_are_returned(spark):
    rng = random.Random(2)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(300)]
    bad = ["zz" + w[:6] for w in vocab[:12]]
    text = lambda toxic: " ".join([rng.choice(vocab) for _ in range(60)] + ([rng.choice(bad) for _ in range(8)] if toxic else []) + [rng.choice(vocab) for _ in range(20)])
    rows = [(i, text(i % 4 == 0)) for i in range(400)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    out = toxicity.scores(docs, toxicity.learn(docs, labels)).collect()
    held = [r for r in out if r.held_out]
    assert np.mean([(r.score >= 0.3) == (r.doc_id % 4 == 0) for r in held]) > 0.95
    found = [s for r in held if r.doc_id % 4 == 0 for s in r.segments]
    assert found and all(58 <= s.first and s.last <= 70 and s.expected < 1 for s in found)


def test_op6_equals_brute_force(spark):
    got = run(spark, 6).toPandas()
    p = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x, ids, hits = np.stack(p.embedding.map(lambda e: np.array(e, float))), p.vec_id.to_numpy(), 0
    queries = [i for i in ids if i % 100 == 0]
    assert list(got.columns) == ["query_id", "rank", "vec_id", "score"] and sorted(set(got.query_id)) == sorted(queries)
    for q in queries:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        own = got[got.query_id == q].sort_values("rank")
        assert list(own["rank"]) == list(range(1, 11)) and q not in set(own.vec_id)
        assert np.allclose(own.score, [d[ids == v][0] for v in own.vec_id], rtol=0, atol=1e-12)
        d[ids == q] = np.inf
        hits += len(set(ids[np.lexsort((ids, d))[:10]]) & set(own.vec_id))
    assert hits >= 0.9 * 10 * len(queries)


def test_lists_beyond_the_centres_and_short_ones(spark):
    """Lists in two levels; outliers whose lists hold too few vectors; a vector that a third of all rows hold."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(900, 16)), np.repeat(rng.normal(size=(1, 16)), 500, 0), 50 + 30 * rng.normal(size=(100, 16))])
    data = [(i, [float(v) for v in r], "x") for i, r in enumerate(x)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, rank string")
    got, hits = ann.nearest(df, coarse=4).toPandas(), 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want, own = np.lexsort((np.arange(1500), d))[:10], got[got.query_id == q].sort_values("rank")
        assert list(own["rank"]) == list(range(1, 11)) and np.allclose(own.score, d[own.vec_id])
        if 900 <= q < 1400:
            assert list(own.vec_id) == list(want)
        hits += len(set(want) & set(own.vec_id))
    assert hits >= 135


def test_op7_equals_brute_force(spark, docs):
    fps = [slow_fingerprint(r.text) for r in docs]
    want = sorted(zip([r.doc_id for r in docs], [f"{f:016x}" for f in fps], components(fps, [r.doc_id for r in docs]), strict=True))
    assert sorted(map(tuple, run(spark, 7).collect())) == want


def test_op9_equals_the_library(spark, docs):
    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((r.doc_id, len(ids := lib.encode_ordinary(r.text or "")), sha(" ".join(map(str, ids)).encode()), sha((r.text or "").encode())) for r in docs)
    assert sorted(map(tuple, run(spark, 9).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == want


def test_bpe_in_plain_rows_is_the_same(spark):
    data = [(1, "the cat  sat"), (1, "the cat  sat"), (2, None), (3, ""), (None, "née 日本 😀 it's\n\n x"), (4, "a" * 5000)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    packed, plain = bpe.encode(df), bpe.encode_by_rows(df)
    key = lambda d: sorted((str(r.doc_id), list(r.ids)) for r in d.collect())
    assert key(packed) == key(plain)
    back = lambda d: sorted((str(r.doc_id), bytes(r.bytes)) for r in d.collect())
    assert back(bpe.decode(packed)) == back(bpe.decode_by_rows(plain)) == sorted((str(i), (t or "").encode()) for i, t in data)
    clash = bpe.decode(packed.withColumn("bytes", F.lit("x")))
    assert clash.columns == ["doc_id", "ids", "bytes"] and back(clash) == back(bpe.decode(packed))


@pytest.mark.parametrize("n", [8, 64, 200, 4096])
def test_payloads_spread(n):
    places = Counter(r[0] for k in range(1000) for r in blocks.payload_rows(k << 32, n, b"x" * 3 * blocks.PIECE))
    assert len(places) >= min(n, 1000) * 0.5 and max(places.values()) <= 3 * (3000 / n) + 12
    rows = blocks.payload_rows(5 << 32, n, bytes(range(256)) * 1000)
    assert blocks.split_payload([(0, 5 << 32, blocks.REPLY, 1, b"z"), *reversed(rows)]) == (bytes(range(256)) * 1000, [(0, 5 << 32, blocks.REPLY, 1, b"z")])


def test_sections_follow_the_input(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    few = blocks.sections(df)
    monkeypatch.setattr(blocks, "SECTION_BYTES", 10_000)
    assert few == 8 and blocks.sections(df) > 8


def test_op10_equals_its_definition(spark, docs):
    split = {r.doc_id: [b"", *lm_bloom.tokens(r.text or "")] for r in docs}
    train = [t for i, t in split.items() if zlib.crc32(str(i).encode()) % 10]
    one, two = Counter(w for t in train for w in t[1:]), Counter(p for t in train for p in zip(t, t[1:], strict=False))
    total, kinds, close = sum(one.values()), len(one), 0
    u = lambda w: (one[w] + 0.1) / (total + 0.1 * (kinds + 1))
    got = run(spark, 10).collect()
    for r in got:
        t = split[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0, len(t) - 1, sum(one[w] > 0 for w in t[1:]), total)
        assert r.base_score == pytest.approx(sum(np.log10(u(w)) for w in t[1:]), rel=1e-9)
        want = 0.0
        for v, w in zip(t, t[1:], strict=False):
            a = lm_bloom.WEIGHT if one[v] else 0.0
            both = 2.0 ** (two[v, w].bit_length() - 1) / one[v] if two[v, w] else 0.0
            want += np.log10(a * both + (1 - a) * u(w))
        close += abs(r.score - want) < 0.03 * abs(want)
    assert close >= 0.95 * len(got)
    # after any history, all words together have a probability of one at most, and four fifths at least
    rows = Counter()
    for (v, _), n in two.items():
        rows[v] += 2.0 ** (n.bit_length() - 1) / one[v]
    every = sum(u(w) for w in one)
    mass = [lm_bloom.WEIGHT * m + (1 - lm_bloom.WEIGHT) * every for v, m in rows.items() if one[v]]
    assert max(mass) <= 1 + 1e-9 and np.mean(mass) >= 0.8 and min(m for v, m in rows.items() if one[v] and v != b"") >= 0


def test_columns_named_like_the_operators_own(spark):
    names = "doc_id long, text string, lang string, source string, n_chars long, __rate double, __n int, __copy int, __fp long, __uid long, n_words string, kept string, d2 string, base_failed string"
    data = [(i, "one two three " * 30 + str(i // 2), "en", "s", 9, 1.0, 2, 3, 4, 5, "a", "b", "c", "d") for i in range(6)]
    df = spark.createDataFrame(data, names)
    for kept in (mixing.mix(df), simhash.keep_one(df), quality.keep_good(df)):
        assert kept.columns == df.columns and {tuple(r) for r in kept.collect()} <= set(data)
    assert common.free_name(df, "__N") == "___N"


def test_chat_edges(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(empty).count() == 0
    long = "word <|end|> " * 20_000
    df = spark.createDataFrame([(1, 0, "user", long, "x"), (1, 1, "assistant", long, "y")], "conv_id long, turn long, role string, text string, formatted string")
    r = chat.format_chats(df).select(chat.read_turns(F.col("formatted")).alias("t"), chat.read_trained(F.col("segments"), F.col("loss_mask")).alias("y")).first()
    assert [t.text for t in r.t] == [long, long] and r.y == long
    probe = {r.conv_id: r for r in QUERIES["op5_chat_format"](spark, SF).collect()}[-7]
    text = r"\### Assistant: </turn> ok"
    assert (probe.n_turns, probe.loss_chars, probe.loss_sha256) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())
